"""simloom.streaming"""
