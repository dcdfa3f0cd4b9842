"""The sweep's flags as bits of one long: the same columns found, also beyond one long's worth of them."""

from pyspark.sql import functions as F

from doorstep.operators import quality as Q


def test_more_columns_than_bits(spark):
    n = 2 * Q._BITS + 3
    want = [i % 7 == 0 or i == n - 1 for i in range(n)]
    row = lambda k: F.struct(F.lit(f"o{k}").alias("order_id"), *[
        (F.lit(i) if want[i] == bool(k) else F.lit(None).cast("int")).alias(f"c{i}") for i in range(n)])
    df = spark.range(1).select(F.inline(F.array(row(0), row(1), row(1))))
    grain, masks, cols = Q._order_masks(df, "x", df)
    assert len(masks) == 3 and len(cols) == n and len(grain.columns) == 4
    got = {r.order_id: [r[f"c{i}"] for i in range(n)] for r in Q._order_grain("x", df, df).collect()}
    assert got == {"o1": want, "o0": [not w for w in want]}


def test_the_sweep_counts_rows_by_what_is_present(spark):
    rows = [(f"o{i}", True, i == 9, i % 2 == 0, i % 2 == 1, "COD" if i % 3 else "PREPAID") for i in range(10)]
    orders = spark.createDataFrame(rows, "order_id string, is_shipped boolean, is_censored boolean, rto_flag boolean, "
                                   "is_delivered boolean, payment_method string")
    extra = spark.createDataFrame([(f"o{i}", 1 if i % 2 == 0 else None, 1) for i in range(9)] + [("o0", None, 2)],
                                  "order_id string, only_returned int, always int")
    got = Q.conditional_sweep({"fct_order": orders, "more": extra}, ["more"]).collect()
    assert sorted((r.column, r.partition, r.n_on, r.n_off, r.rate_on, r.rate_off) for r in got) == [
        ("always", "is_censored", 1, 9, 0.0, 1.0), ("only_returned", "is_delivered", 4, 5, 0.0, 1.0),
        ("only_returned", "rto_flag", 5, 4, 1.0, 0.0)]
