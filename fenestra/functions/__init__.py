"""fenestra.functions"""
