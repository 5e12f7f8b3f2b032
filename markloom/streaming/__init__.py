"""markloom.streaming"""
