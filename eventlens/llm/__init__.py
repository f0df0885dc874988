"""Operators for preparing training data: joins on near copies, packing, archives, scans and classifiers.

Nothing outside this subpackage imports it.
"""
