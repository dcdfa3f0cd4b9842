"""Raw-event sessions and funnel, payload terms: against row-at-a-time Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from doorstep.operators import payloads, raw_funnel

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def folded(rows, steps, gap):
    """Sessions by one pass over each user's sorted events."""
    out, state = [], {}
    for e in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[1], r[0])):
        s = state.get(e[2])
        if s is None or (e[1] - s["last"]).total_seconds() >= gap:
            s = state[e[2]] = {"user": e[2], "start": e[1], "n": 0, "reached": 0}
            out.append(s)
        s["last"], s["n"] = e[1], s["n"] + 1
        if s["reached"] < len(steps) and e[3] == steps[s["reached"]]:
            s["reached"] += 1
    return sorted((s["user"], s["start"], s["last"], s["n"], s["reached"]) for s in out)


def test_sessions_against_a_fold(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):  # user 1 holds half of all events and hardly ever pauses
        user = 1 if rng.random() < 0.5 else rng.randrange(2, 9)
        at = T0 + dt.timedelta(seconds=rng.randrange(0, 90_000) // 10 * 10)  # ties in time
        rows.append((i, at, user, rng.choice(["view", "click", "purchase", "error", None]), 1.0, None))
    rows += rows[:5] + [(900, None, 1, "view", 1.0, None), (901, T0, None, "view", 1.0, None)]
    # exactly the gap apart: a new session; one microsecond less: the same
    rows += [(910, T0, 50, "view", 1.0, None), (911, T0 + dt.timedelta(seconds=600), 50, "click", 1.0, None),
             (912, T0, 51, "view", 1.0, None), (913, T0 + dt.timedelta(seconds=600, microseconds=-1), 51, "click", 1.0, None)]
    steps = ("view", "click", "purchase")
    found = raw_funnel.sessions(spark.createDataFrame(rows, SCHEMA), steps, 600)
    got = sorted(tuple(r)[:5] for r in found.collect())
    want = folded(rows, steps, 600)
    assert got == want and len({w[4] for w in want}) == 4 and sum(w[0] in (50, 51) for w in want) == 3
    per_step = {r.step: r.sessions for r in raw_funnel.funnel(found).collect()}
    assert per_step == {k: sum(w[4] >= k for w in want) for k in range(4)}
    assert found.where("reached = 3 AND NOT (t1 <= t2 AND t2 <= t3 AND session_start <= t1 AND t3 <= session_end)").count() == 0


def test_sessions_equal_the_session_window(spark, model):
    got = raw_funnel.sessions(model["events"]).select("user_id", "session_start", "events").collect()
    want = model["events"].groupBy("user_id", F.session_window("ts", f"{raw_funnel.GAP} seconds")).agg(
        F.count("*").alias("events")).select("user_id", "session_window.start", "events").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_no_window_over_raw_events(model):
    plan = raw_funnel.sessions(model["events"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("[cell#" in line for line in windows)  # they order cells, not events
    assert raw_funnel.sessions(model["events"].limit(0)).count() == 0


def test_terms_of_odd_payloads(spark):
    rows = [(1, None, 1, "a", 1.0, p) for p in (
        '{"k": 3, "s": "x"}', '{"k": 4.5}', '{"k": null}', '{"k": {"n": 1}}', "{broken", None, "7", "{}", '{"s": "12"}')]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.term, r.type): (r.events, r.total) for r in payloads.terms(df).collect()}
    assert got == {("k", "BIGINT"): (1, 3.0), ("s", "STRING"): (2, 12.0), ("k", "DECIMAL(2,1)"): (1, 4.5), ("k", "VOID"): (1, None),
                   ("k", "OBJECT<n: BIGINT>"): (1, None), (None, payloads.BAD): (1, None), (None, payloads.NONE): (1, None),
                   (None, payloads.OTHER): (2, None)}
    shape = payloads.shapes(df.where("props LIKE '{%' AND props <> '{}' AND props NOT LIKE '%n%'")).first()
    assert (shape.payloads, shape.bad, shape["shape"]) == (3, 0, "OBJECT<k: DECIMAL(21,1), s: STRING>")
