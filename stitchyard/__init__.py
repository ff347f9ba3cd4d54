"""Analytics for print and embroidery shop data, as Spark DataFrame operators."""
