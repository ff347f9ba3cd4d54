"""Operators of the shop-data engine."""
