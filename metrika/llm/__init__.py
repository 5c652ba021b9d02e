"""Corpus operators: quality, deduplication, packing, formats and classifiers."""
