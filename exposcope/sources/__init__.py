"""exposcope.sources"""
