"""Training-data operators: extraction, scoring, deduplication, filtering, packing.

Nothing outside this folder imports it.  Each module holds one operator with
its own general interface; ``queries`` registers one query per operator.
"""
