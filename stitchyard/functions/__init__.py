"""Functions of the shop-data engine."""
