"""Quotes: area, quantity tiers and margins (A01, A02), and gang sheets."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchyard.functions.money import round2
from stitchyard.sources.tables import table

#: Dollars by square inch of each print method; others cost 1.
RATES = {"R": 1.15, "A": 0.55}


def unit_price(width: Column, height: Column, rate: Column) -> Column:
    return round2(2.5 + F.greatest(F.lit(1.0), width * height) * rate)


def line_total(unit: Column, qty: Column) -> Column:
    return round2(unit * qty * F.when(qty >= 25, 0.82).when(qty >= 10, 0.90).otherwise(1.0))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    rate = F.lit(1.0)
    for k, v in RATES.items():
        rate = F.when(F.col("l_returnflag") == k, v).otherwise(rate)
    unit = unit_price(F.col("p_size").cast("double"), F.col("l_linenumber").cast("double"), rate)
    return li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("double").alias("qty"), unit.alias("unit_price")).withColumn("total", line_total(F.col("unit_price"), F.col("qty")))


def price_line_quote(spark: SparkSession, d: str) -> DataFrame:
    """A01 for each line; totals are summed in cents, so their order doesn't matter."""
    cents = F.round(F.col("total") * 100).cast("long")
    return _lines(spark, d).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(cents).alias("cents"), F.max("unit_price").alias("top_unit"))


def price_order_quote(spark: SparkSession, d: str) -> DataFrame:
    """Subtotal, margin, total and price a piece of each job, rounded after the sum; a line counts as one piece at least."""
    q = _lines(spark, d).groupBy("l_orderkey").agg((F.sum(F.round(F.col("total") * 100).cast("long")) / 100).alias("subtotal"), F.sum(F.greatest(F.lit(1.0), F.col("qty"))).alias("pieces"))
    margin = round2(F.col("subtotal") * (F.col("l_orderkey") % 40) / 100)
    q = q.withColumn("margin", margin).withColumn("total", round2(F.col("subtotal") + F.col("margin")))
    return q.select("l_orderkey", "subtotal", "margin", "total", round2(F.col("total") / F.col("pieces")).alias("unit"))


def gang_layout(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a 22-inch sheet with gaps of 0.125 inches, as many as the part's size."""
    cols = F.greatest(F.lit(1), F.floor((22 + 0.125) / (F.col("w") + 0.125)).cast("int"))
    p = table(spark, d, "part").select("p_partkey", "p_size", (2 + F.col("p_partkey") % 5).cast("double").alias("w"))
    cells = p.select("p_partkey", "w", cols.alias("cols"), F.explode(F.sequence(F.lit(0), F.col("p_size") - 1)).alias("i"))
    return cells.select("p_partkey", "i", F.floor(F.col("i") / F.col("cols")).cast("int").alias("sheet_row"), (F.col("i") % F.col("cols")).cast("int").alias("sheet_col"), ((F.col("i") % F.col("cols")) * (F.col("w") + 0.125)).alias("x"))


_LINES = """lines AS (SELECT *, floor(unit_price*qty*CASE WHEN qty >= 25 THEN 0.82e0 WHEN qty >= 10 THEN 0.90e0 ELSE 1.0e0 END*100+0.5)/100 AS total FROM (
 SELECT l_orderkey, l_returnflag, CAST(l_quantity AS DOUBLE) AS qty, floor((2.5e0 + greatest(1.0e0, CAST(p_size AS DOUBLE)*CAST(l_linenumber AS DOUBLE))
 * CASE l_returnflag WHEN 'A' THEN 0.55e0 WHEN 'R' THEN 1.15e0 ELSE 1.0e0 END)*100+0.5)/100 AS unit_price FROM lineitem JOIN part ON l_partkey = p_partkey))"""
QUERIES = [price_line_quote, price_order_quote, gang_layout]
SQL = {
    "price_line_quote": f"WITH {_LINES} SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(round(total*100) AS BIGINT)) AS BIGINT) AS cents, max(unit_price) AS top_unit FROM lines GROUP BY 1",
    "price_order_quote": f"WITH {_LINES}, q AS (SELECT l_orderkey, CAST(sum(CAST(round(total*100) AS BIGINT)) AS BIGINT)/100 AS subtotal, sum(greatest(1, qty)) AS pieces FROM lines GROUP BY 1), m AS (SELECT *, floor(subtotal*(l_orderkey%40)/100*100+0.5)/100 AS margin FROM q), t AS (SELECT *, floor((subtotal+margin)*100+0.5)/100 AS total FROM m) SELECT l_orderkey, subtotal, margin, total, floor(total/pieces*100+0.5)/100 AS unit FROM t",
    "gang_layout": "SELECT p_partkey, CAST(i AS INT) AS i, CAST(i // cols AS INT) AS sheet_row, CAST(i % cols AS INT) AS sheet_col, (i % cols)*(w+0.125e0) AS x FROM (SELECT p_partkey, w, greatest(1, CAST(floor((22+0.125e0)/(w+0.125e0)) AS INT)) AS cols, unnest(range(p_size)) AS i FROM (SELECT p_partkey, p_size, CAST(2 + p_partkey % 5 AS DOUBLE) AS w FROM part))",
}
