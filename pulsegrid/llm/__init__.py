"""Training-data operators: deduplication, filtering, auditing and mixing at corpus scale.

Nothing outside this subpackage imports it.
"""
