"""simloom.sources"""
