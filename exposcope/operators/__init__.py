"""exposcope.operators"""
