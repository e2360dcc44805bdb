"""Training-data operators: deduplication, filtering, tokenisation and formatting of text tables.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
