"""tableproof.operators"""
