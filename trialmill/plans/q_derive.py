"""Scalar derivation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmill.functions import derive as dv
from trialmill.plans.base import query, table, trials

C = F.col


@query(
    "p_efficiency",
    "SELECT seq, CASE WHEN tok_s > 0 THEN 1000 / tok_s END AS tpot_ms, size_bytes / 1e6 * tok_s AS bw_mb_s, least(size_bytes / 1e6 * tok_s / 30000e0, 1.5e0) AS mbu, 2 * params AS flops, "
    "CASE WHEN out_tokens > 0 THEN energy_wh / out_tokens * 1000 END AS wh_per_ktok, CASE WHEN det_score > 0 THEN energy_wh / det_score END AS wh_per_correct, "
    "CASE WHEN out_tokens > 0 AND energy_wh <> 0 THEN energy_wh * 3600 / out_tokens END AS j_per_tok, (mean_watts - 4e0) * wall_s / 3600 AS net_wh, energy_wh * 3600 / wall_s AS watts FROM trials WHERE tok_s > 0",
)
def p_efficiency(spark, d):
    bw = dv.achieved_bandwidth(C("size_bytes"), C("tok_s"))
    return trials(spark, d).filter("tok_s > 0").select(
        "seq", dv.tpot_ms(C("tok_s")).alias("tpot_ms"), bw.alias("bw_mb_s"), dv.bandwidth_share(bw, F.lit(30000.0)).alias("mbu"), dv.flops_per_token(C("params")).alias("flops"),
        dv.energy_per_kilotoken(C("energy_wh"), C("out_tokens")).alias("wh_per_ktok"), dv.energy_per_correct(C("energy_wh"), C("det_score")).alias("wh_per_correct"),
        dv.joules_per_token(C("energy_wh"), C("out_tokens")).alias("j_per_tok"), dv.net_energy(C("mean_watts"), F.lit(4.0), C("wall_s")).alias("net_wh"), dv.watts(C("energy_wh"), C("wall_s")).alias("watts"),
    )


@query(
    "p_text_rates",
    "SELECT seq, CASE WHEN out_tokens > 0 AND tok_s > 0 THEN out_chars / (out_tokens / tok_s) END AS chars_s, CASE WHEN thinking_chars > 0 THEN thinking_chars / out_chars::DOUBLE END AS thinking_strict, "
    "CASE WHEN thinking_chars >= 0 THEN thinking_chars / out_chars::DOUBLE END AS thinking_loose, 4 * 24 * 8 * (2048e0 / 32) * (in_tokens + out_tokens) / 1e6 AS kv_mb FROM trials",
)
def p_text_rates(spark, d):
    lit = lambda x: F.lit(x)
    return trials(spark, d).select(
        "seq", dv.chars_per_second(C("out_chars"), C("out_tokens"), C("tok_s")).alias("chars_s"), dv.thinking_ratio(C("thinking_chars"), C("out_chars"), False).alias("thinking_strict"),
        dv.thinking_ratio(C("thinking_chars"), C("out_chars"), True).alias("thinking_loose"), dv.kv_cache_mb(lit(24), lit(8), lit(32), lit(2048), C("in_tokens") + C("out_tokens")).alias("kv_mb"),
    )


@query(
    "p15_requestor_share",
    "SELECT seq, 100 * in_tokens::DOUBLE / nullif(in_tokens + out_tokens + k, 0) AS share, peak_swap_mb - k AS delta, coalesce(nullif(CASE WHEN k % 3 = 0 THEN '' ELSE memory END, ''), 'none') AS memory_or_none, "
    "100e0 / 100 * (det_passed / 4e0) * 4 + 1 AS rescaled FROM trials",
)
def p15(spark, d):
    blank = F.when(C("k") % 3 == 0, "").otherwise(C("memory"))
    return trials(spark, d).select(
        "seq", dv.share_of_sum(C("in_tokens"), C("out_tokens"), C("k")).alias("share"), (C("peak_swap_mb") - C("k")).alias("delta"), dv.or_default(blank).alias("memory_or_none"),
        (dv.det_score(C("det_passed"), F.lit(4)) * 4 + 1).alias("rescaled"),
    )


@query(
    "p18_finish_reason",
    "SELECT seq, CASE WHEN k % 4 = 0 THEN 'stop' WHEN k % 4 = 1 THEN finish_reason WHEN k % 4 = 2 THEN 'fatal:x' ELSE '?' END AS reason FROM trials",
)
def p18(spark, d):
    case = lambda n, x: F.when(C("k") % 4 == n, x)
    reasons = case(0, F.array(F.lit("stop"), F.lit("other")))
    return trials(spark, d).select("seq", dv.finish_reason(reasons, case(1, C("finish_reason")), case(2, F.lit("x"))).alias("reason"))


@query(
    "p21_classifications",
    "SELECT seq, CASE WHEN peak_swap_mb > 50 THEN 'capacity (swap)' WHEN k % 31 = 5 OR peak_c >= 90 THEN 'thermal' WHEN membw_mb_s / 32768e0 >= 0.45 THEN 'bandwidth' WHEN membw_mb_s IS NOT NULL THEN 'compute/latency' ELSE 'unknown (no membw)' END AS bottleneck, "
    "CASE WHEN k % 13 = 0 THEN 'REJECT (failed safety/guard scenario)' WHEN det_score IS NULL THEN 'n/a' WHEN k >= 70 AND NOT dnf AND tok_s >= 8 THEN 'SHIP: interactive' WHEN k >= 70 AND NOT dnf THEN 'BATCH-ONLY (accurate but slow)' WHEN det_score >= 0.6 THEN 'marginal (extraction/format only)' ELSE 'reject (weak reasoning)' END AS verdict, "
    "CASE WHEN starts_with(finish_reason, 'DNF') THEN CASE k % 60 WHEN 0 THEN 'before_response_headers' WHEN 10 THEN 'before_first_byte' WHEN 20 THEN 'before_first_json' WHEN 30 THEN 'before_first_token' WHEN 40 THEN 'during_decode' ELSE 'after_done_missing' END END AS phase, "
    "CASE WHEN k % 6 = 5 THEN 'unknown' WHEN k % 6 >= 4 THEN 'strong' WHEN k % 6 >= 3 THEN 'mid' ELSE 'weak' END AS band FROM trials",
)
def p21(spark, d):
    at = lambda n: F.when(C("k") % 60 >= n, F.lit(1.0))
    return trials(spark, d).select(
        "seq", dv.bottleneck(C("peak_swap_mb"), C("peak_c"), C("membw_mb_s") / 32768.0, C("k") % 31 == 5).alias("bottleneck"),
        dv.verdict(C("det_score"), C("k"), C("tok_s"), C("dnf").cast("int"), C("k") % 13 == 0).alias("verdict"),
        dv.stall_phase(C("finish_reason"), at(10), at(20), at(30), at(40), at(50)).alias("phase"), dv.security_band(F.when(C("k") % 6 != 5, C("k") % 6)).alias("band"),
    )


@query(
    "p24_states",
    "SELECT seq, CASE WHEN k % 2 = 0 THEN 'canceled' WHEN k % 3 = 0 THEN 'done' WHEN k % 5 = 0 THEN 'running' WHEN k % 7 = 0 THEN 'paused' WHEN k % 11 = 0 THEN 'stopped' ELSE 'idle' END AS state, "
    "CASE WHEN k % 2 = 0 THEN 'pushed' WHEN k % 5 = 0 THEN 'push_pending' WHEN k % 3 = 0 THEN 'commit_pending' WHEN k % 7 > 0 THEN 'judging' ELSE 'not_started' END AS persistence FROM trials",
)
def p24(spark, d):
    m = lambda n: C("k") % n == 0
    return trials(spark, d).select("seq", dv.run_state(m(2), m(3), m(5), m(7), m(11)).alias("state"), dv.persistence(m(2), m(3), m(5), C("k") % 7).alias("persistence"))


@query(
    "p26_effective_policy",
    ", a AS (SELECT *, 100 + k AS t0, 20 + k % 50 AS s0, CASE WHEN k % 3 = 0 THEN 'mistral:7b' ELSE model END AS m FROM trials), "
    "b AS (SELECT *, CASE WHEN memory <> 'none' THEN round_even(t0 * 1.35e0, 0)::INT ELSE t0 END AS t1, CASE WHEN memory <> 'none' THEN round_even(s0 * 1.25e0, 0)::INT ELSE s0 END AS s1 FROM a), "
    "c AS (SELECT *, CASE WHEN k % 3 = 0 THEN round_even(t1 * 1.35e0, 0)::INT ELSE t1 END AS t2, CASE WHEN k % 3 = 0 THEN round_even(s1 * 1.25e0, 0)::INT ELSE s1 END AS s2 FROM b), "
    "e AS (SELECT *, CASE strategy WHEN 'best_of_3_detcheck' THEN round_even(t2 * 1.15e0, 0)::INT WHEN 'evaluator_optimizer_1' THEN round_even(t2 * 1.25e0, 0)::INT ELSE t2 END AS t3 FROM c) "
    "SELECT seq, least(t3, 600) AS timeout_s, least(s2, 120) AS stall_s, concat_ws(',', 'scenario_or_default', CASE WHEN memory <> 'none' THEN 'memory_context' END, CASE WHEN k % 3 = 0 THEN 'known_slow_model' END, "
    "CASE strategy WHEN 'best_of_3_detcheck' THEN 'multi_candidate_strategy' WHEN 'evaluator_optimizer_1' THEN 'critique_revise_strategy' END) AS reasons FROM e",
)
def p26(spark, d):
    model = F.when(C("k") % 3 == 0, "mistral:7b").otherwise(C("model"))
    policy = dv.effective_policy((100 + C("k")).cast("int"), (20 + C("k") % 50).cast("int"), model, C("memory"), C("strategy"))
    rows = trials(spark, d).select("seq", policy.alias("p"))
    return rows.select("seq", "p.timeout_s", "p.stall_s", F.array_join("p.reasons", ",").alias("reasons"))


@query("p28_prompt_diagnostics", "SELECT doc_id, length(text) AS chars, greatest(1, length(text) // 4) AS tokens, left(string_split(text, chr(10))[1], 180) AS brief FROM documents", views=False)
def p28(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), dv.estimated_tokens(C("text")).alias("tokens"), dv.brief(C("text"), F.lit("")).alias("brief"))


@query(
    "p31_tag_parts",
    ", t AS (SELECT seq, concat(CASE WHEN k % 2 = 0 THEN 'org/' ELSE '' END, CASE WHEN k % 3 = 0 THEN 'qwen3' ELSE 'llama' END, CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN ':4b-q4_K_M' ELSE ':1b-fp16' END) AS tag, k FROM trials) "
    "SELECT seq, CASE WHEN k % 2 = 0 THEN 'org' ELSE 'library' END AS provider, CASE WHEN k % 7 = 0 THEN 'known' WHEN k % 3 = 0 THEN 'qwen' ELSE 'llama' END AS family, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'q4_K_M' ELSE 'fp16' END AS quant FROM t",
)
def p31(spark, d):
    tag = F.concat(
        F.when(C("k") % 2 == 0, "org/").otherwise(""), F.when(C("k") % 3 == 0, "qwen3").otherwise("llama"), F.when(C("k") % 5 == 0, "").when(C("k") % 5 == 1, ":4b-q4_K_M").otherwise(":1b-fp16")
    )
    known = F.when(C("k") % 7 == 0, "known").otherwise("")
    return trials(spark, d).select("seq", "k", tag.alias("tag")).select("seq", dv.tag_parts(C("tag"), known, F.lit("")).alias("p")).select("seq", "p.*")


@query("p33_roofline", ", b AS (SELECT model, min(size_bytes) AS size_bytes, median(membw_mb_s) / 32768e0 AS mbu FROM trials GROUP BY 1) SELECT model, g AS gbs, g * mbu / (size_bytes / 1e9) AS tok_s, CASE WHEN size_bytes < 700000000 THEN 'below' ELSE 'above' END AS regime FROM b, (VALUES (34e0), (68e0), (120e0)) t(g)")
def p33(spark, d):
    cells = trials(spark, d).groupBy("model").agg(F.min("size_bytes").alias("size_bytes"), (F.median("membw_mb_s") / 32768.0).alias("mbu"))
    targets = [cells.select("model", F.lit(g).alias("gbs"), dv.roofline(g, C("mbu"), C("size_bytes")).alias("tok_s"), dv.regime(C("size_bytes")).alias("regime")) for g in (34.0, 68.0, 120.0)]
    return targets[0].unionByName(targets[1]).unionByName(targets[2])


@query("p34_usage", "SELECT seq, coalesce(CASE WHEN k % 2 = 0 THEN in_tokens END, out_tokens) AS tokens FROM trials")
def p34(spark, d):
    named = trials(spark, d).select("seq", F.when(C("k") % 2 == 0, C("in_tokens")).alias("prompt_tokens"), C("out_tokens").alias("input_tokens"))
    return named.select("seq", dv.usage("prompt_tokens", "input_tokens").alias("tokens"))


@query("p35_footer", "SELECT seq, CASE WHEN k % 3 = 0 THEN k * 1000e0 WHEN k % 3 = 1 THEN k * 1000000e0 ELSE k * 1e0 END AS tokens FROM trials")
def p35(spark, d):
    suffix = F.when(C("k") % 3 == 0, "k").when(C("k") % 3 == 1, "m").otherwise("")
    footer = F.concat(F.lit("\x1b[32mUsage:\x1b[0m "), C("k").cast("string"), suffix, F.lit(" input tokens, 5 output tokens"))
    return trials(spark, d).select("seq", dv.footer_number(footer, "input").alias("tokens"))


@query(
    "p36_judgement",
    "SELECT seq, CASE WHEN k % 5 < 4 THEN 1e0 + k % 5 END AS score, CASE WHEN k % 5 = 4 THEN 'parse_error' WHEN k % 2 = 0 THEN 'good' ELSE 'unspecified' END AS verdict, "
    "CASE WHEN k % 5 = 4 THEN 'parse_error' ELSE 'because' END AS evidence, CASE WHEN k % 5 = 4 THEN 0 WHEN k % 2 = 0 THEN 2 ELSE 1 END AS n_met FROM trials",
)
def p36(spark, d):
    good = F.format_string('{"score": %d, "verdict": "good", "evidence": "because", "criteria_met": ["a", "b"]}', 1 + C("k") % 5)
    thin = F.format_string('{"score": %d, "reason": "because", "criteria_met": "a"}', 1 + C("k") % 5)
    reply = F.when(C("k") % 5 == 4, "not json").when(C("k") % 2 == 0, good).otherwise(thin)
    rows = trials(spark, d).select("seq", reply.alias("reply")).select("seq", dv.judgement(C("reply")).alias("j"))
    return rows.select("seq", "j.score", "j.verdict", "j.evidence", F.size("j.criteria_met").alias("n_met"))


@query(
    "p37_usage_rates",
    "SELECT seq, judge_model, greatest(tokens_in - coalesce(cache_read, 0), 0) AS uncached, 100 * coalesce(cache_read, 0)::DOUBLE / nullif(tokens_in, 0) AS read_pct, 100 * cache_write::DOUBLE / nullif(tokens_in, 0) AS write_pct, "
    "100 * tokens_out::DOUBLE / nullif(tokens_in, 0) AS out_pct FROM judged",
)
def p37(spark, d):
    from trialmill.plans.base import judged

    rates = dv.usage_rates(C("tokens_in"), C("cache_read"), C("cache_write"), C("tokens_out"))
    return judged(spark, d).select("seq", "judge_model", rates.alias("r")).select("seq", "judge_model", "r.*")


@query("p39_hashes", "SELECT doc_id, sha256(text) AS sha256, left(sha1(text), 8) AS sha1_8 FROM documents", views=False)
def p39(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.substring(F.sha1("text"), 1, 8).alias("sha1_8"))


@query("p40_file_stem", "SELECT seq, concat('org_', model, '_1b__', scenario, CASE WHEN k % 2 = 0 THEN '__r' || rep ELSE '' END) AS stem FROM trials")
def p40(spark, d):
    tag = F.concat(F.lit("org/"), C("model"), F.lit(":1b"))
    return trials(spark, d).select("seq", dv.file_stem(tag, C("scenario"), C("rep"), F.when(C("k") % 2 == 0, 5).otherwise(1)).alias("stem"))


@query("p27_prompt", "SELECT seq, concat(CASE WHEN k % 2 = 0 THEN 'MEMORY:' || chr(10) || memory || chr(10) || chr(10) ELSE '' END, scenario, chr(10), chr(10), class) AS prompt FROM trials")
def p27(spark, d):
    return trials(spark, d).select("seq", dv.prompt(C("scenario"), C("class"), F.when(C("k") % 2 == 0, C("memory")).otherwise("")).alias("prompt"))


@query("p38_display_cuts", "SELECT doc_id, left(text, 800) AS question, left(text, 400) AS gold FROM documents", views=False)
def p38(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 800).alias("question"), F.substring("text", 1, 400).alias("gold"))
