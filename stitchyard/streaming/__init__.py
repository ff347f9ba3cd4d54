"""Streaming of the shop-data engine."""
