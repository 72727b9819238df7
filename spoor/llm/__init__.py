"""Operators for large text corpora: packing, deduplication, scans, classifiers and exports."""
