"""Scores without their terms equal those with them, and only the audit sample's terms are worked out."""

import pytest
from pyspark.sql import functions as F

from doorstep.operators import traces


def test_scores_are_the_same_without_terms(model):
    frame = traces.scoring_frame(model)
    full, slim = traces.scored_frame(frame), traces.scored_frame(frame, terms=False)
    assert [c for c in full.columns if not c.endswith("_terms")] == slim.columns
    assert full.select(*slim.columns).exceptAll(slim).count() == 0 and slim.count() == full.count()
    some = full.orderBy("session_id").limit(9).select("session_id").persist()
    own = traces.scored_frame(frame, some)
    want = full.join(some, "session_id", "left_semi")
    assert sorted(own.collect()) == sorted(want.collect()) and own.count() == 9


def test_a_term_that_is_not_finite_still_fails(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    model = traces.LogOdds.build(0.5, {"x": 2.0}, {"x": F.col("x")})
    assert model.append_score(df.where("x = 1"), "m").first().m_lp == 2.5
    with pytest.raises(Exception, match="not finite"):
        model.append_score(df, "m").collect()
