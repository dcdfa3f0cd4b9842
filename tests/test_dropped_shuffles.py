"""What a written step has shuffled is gone when the next begins."""

import time

import pytest
from pyspark.sql import functions as F

from doorstep.session import cut, keep


def shuffled(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
    return {b for b in blocks if b.startswith("shuffle_")}


@pytest.mark.parametrize("write", [keep, cut])
def test_shuffle_files_end_with_the_step(spark, write):
    before = shuffled(spark)
    rows = spark.range(20000).repartition(7).groupBy((F.col("id") % 9000).alias("k")).agg(F.count("*").alias("n"))
    out = write(rows)
    for _ in range(100):
        if shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled(spark) <= before
    assert out.agg(F.sum("n")).first()[0] == 20000 and out.count() == 9000
    assert rows.count() == 9000  # what was written can be read again
    assert rows.agg(F.sum("n")).first()[0] == 20000


def test_families_of_the_suite_leave_no_shuffle_files(spark, model):
    from doorstep.operators import quality
    state = model["fct_customer_state_at_session"].count()
    before = shuffled(spark)
    row = cut(quality.pit_integrity(model)).first()
    for _ in range(100):
        if shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled(spark) <= before
    assert state > 0 and (row.status, row.actual) == ("PASS", "0")
