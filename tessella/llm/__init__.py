"""Training-data operators: sharding, deduplication, tokenising, filtering and scanning of documents.

Nothing else in the library imports this subpackage; it may be deleted as a whole.
"""
