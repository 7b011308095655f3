"""Operators for preparing text, page and vector corpora: screening, de-duplication, search, tokenising, packing."""
