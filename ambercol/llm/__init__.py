"""Training-data operators: scans, extraction, packing, decontamination, deduplication.

Nothing outside this subpackage imports it.
"""
