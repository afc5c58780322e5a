"""chunkloom.chunking"""
