"""Sources of the shop-data engine."""
