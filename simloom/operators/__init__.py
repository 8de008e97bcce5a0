"""simloom.operators"""
