"""Expressions on sets."""
