"""Training-data operators: scoring, deduplication, decontamination, tokens, sharding.

Nothing else in the library imports this subpackage.
"""
