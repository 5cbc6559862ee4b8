"""siftlark.functions"""
