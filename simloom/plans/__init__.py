"""simloom.plans"""
