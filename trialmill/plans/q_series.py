"""Time-series and strategy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.operators import strategy as st
from trialmill.operators import timeseries as ts
from trialmill.plans.base import query, table, trials

C = F.col


@query("w07_counter_delta", "SELECT user_id, CASE WHEN count(*) >= 2 THEN arg_max(value, event_id) - arg_min(value, event_id) END AS delta FROM events GROUP BY 1", views=False)
def w07(spark, d):
    ordered = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    return ordered.select("user_id", ts.first_last_delta(F.col("s.value")).alias("delta"))


@query(
    "w08_wrapped_rate",
    ", c AS (SELECT seq, model, k, seq - lag(seq) OVER w AS dt, k - lag(k) OVER w AS step FROM trials WINDOW w AS (PARTITION BY model ORDER BY seq)) SELECT seq, CASE WHEN step < 0 THEN step + 100 ELSE step END / dt::DOUBLE AS rate FROM c",
)
def w08(spark, d):
    return ts.counter_rate(trials(spark, d), "k", "seq", ["model"], 100).select("seq", "rate")


@query(
    "w09_utilisation",
    ", c AS (SELECT seq, model, sum(k) OVER w AS idle, sum(k + wall_s) OVER w AS total FROM trials WINDOW w AS (PARTITION BY model ORDER BY seq)) "
    "SELECT seq, CASE WHEN total - lag(total) OVER v > 0 THEN 100 * (1 - (idle - lag(idle) OVER v) / (total - lag(total) OVER v)) END AS util FROM c WINDOW v AS (PARTITION BY model ORDER BY seq)",
)
def w09(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("model").orderBy("seq")
    counters = trials(spark, d).select("seq", "model", F.sum("k").over(w).alias("idle"), F.sum(C("k") + C("wall_s")).over(w).alias("total"))
    return ts.utilisation(counters, "idle", "total", "seq", ["model"]).select("seq", "util")


@query("w10_token_gaps", ", g AS (SELECT model, (seq - lag(seq) OVER (PARTITION BY model ORDER BY seq)) * 1000e0 AS gap FROM trials) SELECT model, sum(gap) AS total_ms, max(gap) AS max_ms FROM g GROUP BY 1")
def w10(spark, d):
    times = trials(spark, d).groupBy("model").agg(F.array_sort(F.collect_list(C("seq").cast("double"))).alias("t")).select("model", ts.gaps_ms(C("t")).alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda a, x: a + x)
    return times.select("model", F.when(F.size("g") > 0, total).alias("total_ms"), F.array_max("g").alias("max_ms"))


@query("w11_running", "SELECT seq, max(tok_s) OVER w AS running_max, min(tok_s) OVER w AS running_min, sum(tok_s) OVER w AS running_sum FROM trials WINDOW w AS (PARTITION BY model ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def w11(spark, d):
    return ts.running(trials(spark, d), "tok_s", ["seq"], ["model"]).select("seq", "running_max", "running_min", "running_sum")


@query("w14_carry_forward", "SELECT seq, last_value(CASE WHEN k % 5 = 0 THEN scenario END IGNORE NULLS) OVER (PARTITION BY model ORDER BY seq ROWS UNBOUNDED PRECEDING) AS header FROM trials")
def w14(spark, d):
    rows = trials(spark, d).select("seq", "model", F.when(C("k") % 5 == 0, C("scenario")).alias("header"))
    return ts.carry_forward(rows, "header", "seq", ["model"]).select("seq", "header")


@query("a37_by_timestamp", "SELECT user_id AS request, k AS t, coalesce(sum(event_id) FILTER (event_id % 2 = 0), 0)::DOUBLE AS read_mb, coalesce(sum(event_id) FILTER (event_id % 2 = 1), 0)::DOUBLE AS write_mb, sum(event_id)::DOUBLE AS total_mb FROM ev GROUP BY 1, 2")
def a37(spark, d):
    t = trials(spark, d)
    events = t.select(F.substring("model", 2, 10).cast("long").alias("request"), C("k").alias("t"), F.when(C("seq") % 2 == 0, "read").otherwise("write").alias("event"), C("seq").cast("double").alias("mb"))
    return ts.by_timestamp(events)


@query("t09_resample", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, arg_max(value, event_id) AS last FROM events GROUP BY 1", views=False)
def t09(spark, d):
    return ts.resample(table(spark, d, "events"), 3600)


CANDIDATES = ", c AS (SELECT model, scenario, rep AS index, det_passed, 4 AS det_total, dnf, out_chars AS chars FROM trials)"


def _candidates(spark, d):
    return trials(spark, d).select("model", "scenario", C("rep").alias("index"), "det_passed", F.lit(4).alias("det_total"), "dnf", C("out_chars").alias("chars"))


@query("w15_best_candidate", CANDIDATES + "SELECT model, scenario, index AS selected, count(*) OVER (PARTITION BY model, scenario) AS candidates FROM c QUALIFY row_number() OVER (PARTITION BY model, scenario ORDER BY det_passed / 4e0 DESC, dnf, chars DESC, index) = 1")
def w15(spark, d):
    return st.best(_candidates(spark, d), ["model", "scenario"])


@query(
    "w16_modal_candidate",
    CANDIDATES + ", b AS (SELECT *, count(*) OVER (PARTITION BY model, scenario, det_passed) AS votes FROM c) SELECT model, scenario, index AS selected, votes FROM b QUALIFY row_number() OVER (PARTITION BY model, scenario ORDER BY votes DESC, det_passed DESC, dnf, chars DESC, index) = 1",
)
def w16(spark, d):
    return st.modal(_candidates(spark, d), ["model", "scenario"])


@query("w17_draft_fallback", "SELECT seq, CASE WHEN dnf AND k % 4 <> 0 THEN 'draft' ELSE 'revised' END AS used FROM trials")
def w17(spark, d):
    return trials(spark, d).select("seq", st.revised_or_draft(C("dnf"), C("k") % 4 == 0, F.lit("revised"), F.lit("draft")).alias("used"))


@query("a46_strategy_totals", "SELECT model, scenario, sum(wall_s) AS wall_s, sum(in_tokens)::DOUBLE AS in_tokens, sum(out_tokens)::DOUBLE AS out_tokens, sum(k % 3)::DOUBLE AS retries FROM trials GROUP BY 1, 2")
def a46(spark, d):
    item = F.struct("wall_s", "in_tokens", "out_tokens", (C("k") % 3).alias("retries"))
    held = trials(spark, d).groupBy("model", "scenario").agg(F.collect_list(item).alias("c"))
    return held.select("model", "scenario", st.totals(C("c")).alias("t")).select("model", "scenario", "t.*")


@query("x_session_window", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
       "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.n", views=False)  # fmt: skip
def x_session(spark, d):
    """Extension: event-time sessions with a gap of half an hour."""
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", C("w.start").alias("start"), "n")
