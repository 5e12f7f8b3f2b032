"""markloom.sources"""
