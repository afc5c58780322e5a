"""chunkloom.plans"""
