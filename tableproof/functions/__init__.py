"""tableproof.functions"""
