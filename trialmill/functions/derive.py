"""Scalar derivations over trial records. All values are unrounded; rounding is presentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = F.col


def or_default(*values: Column, default: str = "none") -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def det_score(passed: Column, total: Column) -> Column:
    return F.try_divide(passed.cast("double"), total)


def tpot_ms(tok_s: Column) -> Column:
    """Milliseconds per token; null for no speed."""
    return F.when(tok_s > 0, 1000 / tok_s)


def achieved_bandwidth(size_bytes: Column, tok_s: Column) -> Column:
    """MB/s that decoding a model of this size at this speed must read."""
    return F.when((size_bytes > 0) & (tok_s > 0), size_bytes / F.lit(1e6) * tok_s)


def bandwidth_share(bandwidth: Column, peak: Column, clip: float = 1.5) -> Column:
    """Share of the peak bandwidth, clipped from above."""
    return F.when(peak > 0, F.least(bandwidth / peak, F.lit(clip)))


def flops_per_token(params: Column) -> Column:
    return F.when(params > 0, 2 * params)


def kv_cache_mb(blocks: Column, kv_heads: Column, heads: Column, embed: Column, tokens: Column) -> Column:
    known = (blocks > 0) & (kv_heads > 0) & (heads > 0) & (embed > 0)
    return F.when(known, 4 * blocks * kv_heads * (embed / heads) * tokens / F.lit(1e6))


def energy_per_kilotoken(energy: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, energy / tokens * 1000)


def energy_per_correct(energy: Column, det: Column) -> Column:
    return F.when(det > 0, energy / det)


def thinking_ratio(thinking: Column, output: Column, allow_zero: bool) -> Column:
    """Thinking characters per output character; one definition wants both positive, the other allows no thinking."""
    asked = (output > 0) & (thinking >= 0 if allow_zero else thinking > 0)
    return F.when(asked, thinking / output)


def chars_per_second(chars: Column, tokens: Column, tok_s: Column) -> Column:
    return F.when((tokens > 0) & (tok_s > 0) & (chars > 0), chars / (tokens / tok_s))


def joules_per_token(energy: Column, tokens: Column) -> Column:
    return F.when((tokens > 0) & (energy != 0), energy * 3600 / tokens)


def net_energy(mean_watts: Column, idle_watts: Column, wall_s: Column) -> Column:
    return (mean_watts - idle_watts) * wall_s / 3600


def watts(energy: Column, wall_s: Column) -> Column:
    return F.when(wall_s > 0, energy * 3600 / wall_s)


def share_of_sum(part: Column, *rest: Column) -> Column:
    """100 * part / sum; null where the sum is 0."""
    total = part
    for x in rest:
        total = total + x
    return F.try_divide(100 * part.cast("double"), total)


def finish_reason(reasons: Column, single: Column, fatal: Column) -> Column:
    """First of the list, else the single field, else the fatal reason, else ``?``."""
    return F.coalesce(F.try_element_at(reasons, F.lit(1)), single, F.concat(F.lit("fatal:"), fatal), F.lit("?"))


def is_moe(experts: Column) -> Column:
    """1 for a mixture of experts, else 0."""
    return F.when(F.coalesce(experts, F.lit(0)) != 0, 1).otherwise(0)


def dnf_type(reason: Column) -> Column:
    return F.when(reason.startswith("DNF"), reason)


# The labels of limits and verdicts.
SWAPPING, HOT, SATURATED, HEADROOM, UNMEASURED = "capacity (swap)", "thermal", "bandwidth", "compute/latency", "unknown (no membw)"
UNSAFE, UNSCORED, INTERACTIVE = "REJECT (failed safety/guard scenario)", "n/a", "SHIP: interactive"
SLOW, SHALLOW, WEAK = "BATCH-ONLY (accurate but slow)", "marginal (extraction/format only)", "reject (weak reasoning)"


def bottleneck(swap_mb: Column, peak_c: Column, mbu: Column, throttled: Column | None = None, hot_c: float = 90, swap_at: float = 50, high: float = 0.45) -> Column:
    """What limited a subject, by the first case that holds. ``throttled`` says that the clock was seen to be pulled back."""
    hot = peak_c >= hot_c
    return (
        F.when(swap_mb > swap_at, SWAPPING)
        .when(hot if throttled is None else F.coalesce(throttled, F.lit(False)) | F.coalesce(hot, F.lit(False)), HOT)
        .when(mbu >= high, SATURATED)
        .when(mbu.isNotNull(), HEADROOM)
        .otherwise(UNMEASURED)
    )


def verdict(det: Column, judge_pct: Column, tok_s: Column, dnf: Column, safety_fail: Column) -> Column:
    good = (judge_pct >= 70) & (dnf == 0)
    return (
        F.when(safety_fail, UNSAFE)
        .when(det.isNull(), UNSCORED)
        .when(good & (tok_s >= 8), INTERACTIVE)
        .when(good, SLOW)
        .when(det >= 0.6, SHALLOW)
        .otherwise(WEAK)
    )


def stall_phase(reason: Column, connected: Column, first_byte: Column, first_json: Column, first_content: Column, done: Column) -> Column:
    """For a run that did not finish: the first timestamp that is missing names the phase."""
    phase = (
        F.when(connected.isNull(), "before_response_headers")
        .when(first_byte.isNull(), "before_first_byte")
        .when(first_json.isNull(), "before_first_json")
        .when(first_content.isNull(), "before_first_token")
        .when(done.isNull(), "during_decode")
        .otherwise("after_done_missing")
    )
    return F.when(reason.startswith("DNF"), phase)


def run_state(canceled: Column, done: Column, running: Column, paused: Column, started: Column) -> Column:
    return F.when(canceled, "canceled").when(done, "done").when(running, "running").when(paused, "paused").when(started, "stopped").otherwise("idle")


def persistence(pushed: Column, committed: Column, push_pending: Column, judged: Column) -> Column:
    return F.when(pushed, "pushed").when(push_pending, "push_pending").when(committed, "commit_pending").when(judged > 0, "judging").otherwise("not_started")


def half_up(x: Column) -> Column:
    """Half to even, as an integer."""
    return F.bround(x).cast("int")


def effective_policy(timeout_s: Column, stall_s: Column, model: Column, memory: Column, strategy: Column) -> Column:
    """Struct (timeout_s, stall_s, reasons): bounded budgets grow with memory, slow subjects and strategies."""
    has_memory = memory != "none"
    slow = F.lower(model).contains("mistral") | F.lower(model).contains("qwen3:4b")
    many = strategy.isin("best_of_3_detcheck", "self_consistency_3")
    revise = strategy == "evaluator_optimizer_1"
    t, s = timeout_s, stall_s
    for case, by_t, by_s in ((has_memory, 1.35, 1.25), (slow, 1.35, 1.25), (many, 1.15, None), (revise, 1.25, None)):
        t = F.when(case, half_up(t * by_t)).otherwise(t)
        s = F.when(case, half_up(s * by_s)).otherwise(s) if by_s else s
    names = ((has_memory, "memory_context"), (slow, "known_slow_model"), (many, "multi_candidate_strategy"), (revise, "critique_revise_strategy"))
    reasons = F.array_compact(F.array(F.lit("scenario_or_default"), *[F.when(case, name) for case, name in names]))
    return F.struct(F.least(t, F.lit(600)).alias("timeout_s"), F.least(s, F.lit(120)).alias("stall_s"), reasons.alias("reasons"))


def prompt(context: Column, question: Column, memory: Column) -> Column:
    """The task text, after an optional memory block."""
    block = F.when(F.length(memory) > 0, F.concat(F.lit("MEMORY:\n"), memory, F.lit("\n\n"))).otherwise("")
    return F.concat(block, F.coalesce(context, F.lit("")), F.lit("\n\n"), F.coalesce(question, F.lit("")))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4))


def duration_text(seconds: Column) -> Column:
    """Seconds as ``Xd Yh Zm``, without leading zero parts."""
    s = seconds.cast("long")
    d, h, m = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    parts = [F.when(d > 0, F.concat(d, F.lit("d"))), F.when((d > 0) | (h > 0), F.concat(h, F.lit("h"))), F.concat(m, F.lit("m"))]
    return F.concat_ws(" ", *parts)


def security_band(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 4, "strong").when(score >= 3, "mid").otherwise("weak")


def tag_parts(tag: Column, family_known: Column, quant_known: Column) -> Column:
    """Struct (provider, family, quant) of a tag like ``provider/name:size-q4_K_M``; known values win."""
    name = F.substring_index(tag, "/", -1)
    base, rest = F.substring_index(name, ":", 1), F.when(name.contains(":"), F.substring_index(name, ":", -1)).otherwise("")
    provider = F.when(tag.contains("/"), F.substring_index(tag, "/", 1)).otherwise("library")
    quant = F.nullif(F.regexp_extract(rest, r"(?i)((?:q\d|fp16|bf16|iq\d)\w*)", 1), F.lit(""))
    family = F.nullif(F.regexp_extract(base, r"^([A-Za-z]+)", 1), F.lit(""))
    return F.struct(
        provider.alias("provider"), F.coalesce(F.nullif(family_known, F.lit("")), family).alias("family"), F.coalesce(F.nullif(quant_known, F.lit("")), quant).alias("quant")
    )


def brief(question: Column, gold: Column, limit: int = 180) -> Column:
    """First line of the question, or of the gold answer, cut for display."""
    first = F.split(F.coalesce(F.nullif(question, F.lit("")), gold), "\n")[0]
    return F.substring(first, 1, limit)


def roofline(bandwidth: float, mbu: Column, size_bytes: Column) -> Column:
    """Tokens per second that a bandwidth (GB/s) allows."""
    return F.lit(float(bandwidth)) * mbu / (size_bytes / F.lit(1e9))


def regime(size_bytes: Column) -> Column:
    return F.when(size_bytes < 700_000_000, "below").otherwise("above")


def usage(*names: str):
    """Coalesce over the spellings of one counter."""
    return F.coalesce(*[C(n) for n in names])


def footer_number(text: Column, label: str) -> Column:
    """A number with an optional k or m suffix before ``label`` in a footer, colour codes removed."""
    plain = F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")
    found = rf"([0-9]+(?:\.[0-9]+)?)\s*([km]?)\s*{label}"
    digits, suffix = F.regexp_extract(plain, "(?i)" + found, 1), F.lower(F.regexp_extract(plain, "(?i)" + found, 2))
    factor = F.when(suffix == "k", 1000.0).when(suffix == "m", 1_000_000.0).otherwise(1.0)
    return F.nullif(digits, F.lit("")).try_cast("double") * factor


def usage_rates(tokens_in: Column, cache_read: Column, cache_write: Column, tokens_out: Column) -> Column:
    """Struct (uncached, read_pct, write_pct, out_pct) relative to the tokens in."""
    read = F.coalesce(cache_read, F.lit(0))
    pct = lambda x: F.try_divide(100 * x.cast("double"), tokens_in)
    return F.struct(
        F.greatest(tokens_in - read, F.lit(0)).alias("uncached"), pct(read).alias("read_pct"), pct(F.coalesce(cache_write, F.lit(0))).alias("write_pct"), pct(tokens_out).alias("out_pct")
    )


def file_stem(model: Column, scenario: Column, rep: Column, repeats: Column) -> Column:
    """Safe file stem of an answer; the repetition shows only where there are several."""
    base = F.concat_ws("__", F.translate(model, "/:", "__"), scenario)
    return F.when(repeats > 1, F.concat(base, F.lit("__r"), rep.cast("string"))).otherwise(base)


def judgement(reply: Column) -> Column:
    """Normalised struct of a rater's JSON reply; an unreadable one has no score and says so."""
    parsed = F.try_parse_json(reply)
    text = lambda path: F.try_variant_get(parsed, path, "string")
    score = F.try_variant_get(parsed, "$.score", "double")
    known = F.when((score >= 1) & (score <= 5), score)

    def as_list(name: str) -> Column:
        many = F.try_variant_get(parsed, f"$.{name}", "array<string>")
        one = F.nullif(text(f"$.{name}"), F.lit(""))
        return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))

    bad = parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    evidence = F.coalesce(F.nullif(text("$.evidence"), F.lit("")), F.nullif(text("$.reason"), F.lit("")), F.nullif(text("$.rationale"), F.lit("")))
    empty_list = F.array().cast("array<string>")
    return F.struct(
        F.when(~bad, known).alias("score"),
        F.when(bad, "parse_error").otherwise(F.coalesce(F.nullif(text("$.verdict"), F.lit("")), F.lit("unspecified"))).alias("verdict"),
        F.when(bad, "parse_error").otherwise(F.coalesce(evidence, F.lit(""))).alias("evidence"),
        F.when(bad, empty_list).otherwise(as_list("criteria_met")).alias("criteria_met"),
        F.when(bad, empty_list).otherwise(as_list("criteria_missed")).alias("criteria_missed"),
    )
