"""siftlark.streaming"""
