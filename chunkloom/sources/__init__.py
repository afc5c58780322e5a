"""chunkloom.sources"""
