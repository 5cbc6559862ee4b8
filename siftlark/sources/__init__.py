"""siftlark.sources"""
