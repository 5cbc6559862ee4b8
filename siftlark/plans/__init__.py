"""siftlark.plans"""
