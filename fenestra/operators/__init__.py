"""fenestra.operators"""
