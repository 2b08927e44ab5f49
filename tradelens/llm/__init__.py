"""Operators of a training-data pipeline: deduplication, search, tokens, language, packing, sharding, secrets.

Nothing else in the library imports this subpackage.  Each module holds one operator with its
own general interface; ``queries`` registers one query per operator.
"""
