"""Operators on edge tables (src, dst: long)."""
