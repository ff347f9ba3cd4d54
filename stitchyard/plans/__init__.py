"""Plans of the shop-data engine."""
