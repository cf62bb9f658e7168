"""fenestra: UI-resource analytics as composable PySpark DataFrame jobs."""
