"""Training-data operators: search, extraction, dedup, scans, tokenising, scoring, packing.

Nothing outside this subpackage imports it.
"""
