"""siftlark.operators"""
