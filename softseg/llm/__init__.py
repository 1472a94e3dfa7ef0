"""Operators for preparing text corpora: filtering, deduplication, mixing, packing.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
