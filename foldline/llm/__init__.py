"""Training-data operators: extraction, privacy, deduplication, scoring, packing and token output.

Nothing outside this subpackage imports it.
"""
