"""Training-data operators: filters, tokenization, packing, archives and deduplication.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
