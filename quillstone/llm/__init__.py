"""Operators for large text corpora: scans, classifiers, dedup, packing and decontamination.

Nothing outside this subpackage imports it.
"""
