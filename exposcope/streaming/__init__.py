"""exposcope.streaming"""
