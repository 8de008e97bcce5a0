"""simloom.functions"""
