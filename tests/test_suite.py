"""The suite's rows come from every family that reads the tables."""

from doorstep.operators import quality as Q
from doorstep.plans.quality_queries import suite_results


def test_suite_covers_every_family(spark, model):
    rows = suite_results(model).collect()
    ids = [r.test_id for r in rows]
    assert len(ids) == len(set(ids))
    assert {i.split("-")[0] for i in ids} == {"VOL", "CAL", "DQ", "EC", "BR", "LK", "FA"}
    assert {"DQ-15", "DQ-16", "LK-01", "LK-02", "LK-04", "FA-01"} <= set(ids)
    assert {r.status for r in rows} <= {"PASS", "FAIL", "SKIP"}
    # a failure planted in any family reaches the verdict
    for family in ("VOL", "CAL", "DQ", "EC", "BR", "LK", "FA"):
        hard = next(i for i in ids if i.startswith(family))
        planted = [r.asDict() | {"severity": "HARD", "status": "FAIL" if r.test_id == hard else "PASS"} for r in rows]
        one = Q.verdict(spark.createDataFrame(planted)).first()
        assert one.verdict == "NOT READY" and one.failed_ids == hard
