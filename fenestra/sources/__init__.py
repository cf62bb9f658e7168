"""fenestra.sources"""
