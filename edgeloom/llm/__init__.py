"""Training-data operators: packing, scoring, extraction, search, deduplication, token files.

Each operator has a module of its own; ``queries`` holds the thin contract queries and their SQL.
Nothing outside this subpackage imports it.
"""
