"""Scores of op1 on rows that it has not learnt from."""

import __spark_entry__ as entry
from pyspark.sql import functions as F


def test_lm_held_out(spark):
    """A held-out text is scored near the base, which gives each unknown word a count; ranks alone scored at twice its digits."""
    rows = entry.queries()["op1_subword_lattice"](spark, "/root/testdata/sf0.01").filter("held_out")
    score, base, known, n, bad = rows.agg(F.sum("score"), F.sum("base_score"), F.sum("n_known"), F.sum("n_tokens"), F.count_if(F.col("score").isNull() | F.isnan("score"))).first()
    assert bad == 0 and score > 1.2 * base
    # an unknown word is spelled, and costs some digits more than the base's flat share
    assert score > base - 4.0 * (n - known)
