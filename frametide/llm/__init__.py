"""Training-data operators: scoring, tokenising, de-duplicating, formatting and sharding text corpora.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``queries`` registers one full-table query per operator.
"""
