"""Training-data operators: deduplication, filtering, formatting, mixing, archives, scans.

Nothing outside this package imports it.
"""
