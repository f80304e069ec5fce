"""tableproof.sources"""
