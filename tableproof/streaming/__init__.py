"""tableproof.streaming"""
