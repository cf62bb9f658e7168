"""fenestra.streaming"""
