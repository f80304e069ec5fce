"""tableproof.plans"""
