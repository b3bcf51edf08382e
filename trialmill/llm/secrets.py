"""Secret scans: fixed patterns, and Markov models that tell random strings from identifiers.

Two character Markov chains are counted from labelled samples: one of secrets, one of ordinary
identifiers. A token whose transitions are likelier under the first, by enough in all and on
average, is reported too. What no pattern finds counts as ordinary, and may be a secret all the same; so documents go into two folds by a hash
of their text, and tokens are judged by the chains of the other fold: none helps to train the chain that judges it, nor does a copy of its document.
The weight of unseen transitions is chosen for each class by how likely the pairs of one fold are under the chain of the other. Everything runs on DataFrame functions: positions come from the lengths
of matches and of the gaps between them, likelihoods from a constant table of log ratios.

Running sums over an array go by blocks of BLOCK items, and a token is split into characters
once, so the work grows with the length of a text, not with its square.

Defined cases: a null text has no spans. Positions count code points. Matches of a kind do not
overlap; a Markov span is dropped where it overlaps a pattern's. Without labelled secrets, or
without labelled identifiers, no Markov span is reported. Repeated rows get the same result; texts are read whole;
an empty table gives an empty result. Other columns come back unchanged; one that has the name of
the result is refused.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmill.llm.common import unused

#: kind, pattern, group whose length counts, least length. Fixed by the result contract, in its order.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ that are long enough
)
MARKOV = "markov"
#: What the Markov models look at: tokens of six characters or more that neither begin nor end with a dot.
CANDIDATE = r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9+/_=-]"
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_-=."
STATES = len(ALPHABET) + 1  # 0: any other character
SPAN = "array<struct<s:int,e:int,v:string>>"
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _last(x: Column) -> Column:
    return F.get(x, F.size(x) - 1)


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each item of a non-empty array what ``add`` makes of all items before it.

    Appending copies an array, so items are summed inside blocks first, then over blocks.
    """
    sums = lambda items, of: F.aggregate(items, F.array(zero), lambda acc, x: F.array_append(acc, add(_last(acc), of(x))))

    def spread(inner: Column) -> Column:
        before = F.slice(sums(inner, _last), F.lit(1), F.size(inner))
        return F.flatten(F.zip_with(inner, before, lambda a, o: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda x: add(o, x))))

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        return let(F.transform(starts, lambda at: sums(F.slice(v, at, F.lit(BLOCK)), lambda x: x)), spread)

    return let(values, blocks)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost, non-overlapping matches as structs (s, e, v): start, end, text of the group."""
    lit, none = F.lit(pattern), F.array().cast(SPAN)

    def pieces(found: Column) -> Column:
        values = F.regexp_extract_all(text, lit, F.lit(group)) if group else found
        pairs = F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("n"), v.alias("v")))
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return F.zip_with(pairs, gaps, lambda p, gap: F.struct(F.length(gap).alias("gap"), p["n"].alias("n"), p["v"].alias("v")))

    def spans(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda x: x["gap"] + x["n"]), F.lit(0), lambda a, b: a + b)
        return F.zip_with(
            steps, ends, lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["v"].alias("v"))
        )

    return F.when(F.regexp_like(text, lit), let(let(F.regexp_extract_all(text, lit, F.lit(0)), pieces), spans)).otherwise(none)


def _long(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda x: F.length(x["v"]) >= least)


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v")))


def pattern_spans(text: Column) -> Column:
    """Spans of the fixed patterns as structs (s, rank, e, kind, v), in the order of start and kind."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        found.append(_named(_long(located(text, pattern, group), least), rank, kind))
    return F.array_sort(F.concat(*found))


#: Weights of a pair of characters that was not seen, to choose from.
PRIORS = (0.02, 0.1, 0.5, 2.0, 8.0)
FOLDS = 2
#: Counts of character pairs by fold, class and pair.
Counts = dict[tuple[int, bool, str], int]


def fold_of(text: Column) -> Column:
    """The fold of a document: equal texts have the same."""
    return F.pmod(F.xxhash64(F.lit(11), text), F.lit(FOLDS)).cast("int")


def transitions(tokens: DataFrame) -> Counts:
    """Counts of character pairs of tokens (token, is_secret, fold); at most 2 x FOLDS x STATES^2 rows come back."""
    long = tokens.filter(F.length("token") > 1)
    pairs = long.select("fold", "is_secret", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"), "token").select(
        "fold", "is_secret", F.substring(F.col("token"), F.col("i"), F.lit(2)).alias("pair")
    )
    # a character outside the alphabet is state 0, whichever it is
    known = F.translate("pair", ALPHABET, "a" * len(ALPHABET))
    one = lambda k: F.when(F.substring(known, k, 1) == "a", F.substring("pair", k, 1)).otherwise(F.lit("?"))
    pairs = pairs.withColumn("pair", F.concat(one(1), one(2)))
    return {(r["fold"], r["is_secret"], r["pair"]): r["n"] for r in pairs.groupBy("fold", "is_secret", "pair").agg(F.count("*").alias("n")).collect()}


def _cells(counts: Counts, folds: set[int], label: bool) -> list[int]:
    index = {c: k + 1 for k, c in enumerate(ALPHABET)}
    table = [0] * (STATES * STATES)
    for (fold, is_secret, pair), n in counts.items():
        if fold in folds and is_secret == label and len(pair) == 2:
            table[index.get(pair[0], 0) * STATES + index.get(pair[1], 0)] += n
    return table


def _logs(cells: list[int], prior: float) -> list[float]:
    sums = [sum(cells[a * STATES : (a + 1) * STATES]) + prior * STATES for a in range(STATES)]
    return [math.log((n + prior) / sums[k // STATES]) for k, n in enumerate(cells)]


def fitted_prior(counts: Counts, label: bool, default: float) -> float:
    """The weight under which each fold's pairs are likeliest by the other fold's chain; the default without two folds."""
    folds = [_cells(counts, {f}, label) for f in range(FOLDS)]
    if not all(map(sum, folds)):
        return default
    gain = {p: sum(n * q for f in range(FOLDS) for n, q in zip(folds[f], _logs(folds[1 - f], p), strict=True) if n) for p in PRIORS}
    return max(PRIORS, key=gain.__getitem__)


def log_ratios(counts: Counts, folds: set[int] | None = None) -> list[float] | None:
    """log P(b | a, secret) - log P(b | a, identifier) at a * STATES + b, learned from these folds (all by default); None if a class is missing."""
    folds = set(range(FOLDS)) if folds is None else folds
    secret, ordinary = (_cells(counts, folds, label) for label in (True, False))
    if not sum(secret) or not sum(ordinary):
        return None
    p, q = _logs(secret, fitted_prior(counts, True, 2.0)), _logs(ordinary, fitted_prior(counts, False, 0.5))
    return [a - b for a, b in zip(p, q, strict=True)]


def judges(counts: Counts) -> list[list[float]] | None:
    """For each fold the table that judges its documents: that of the other fold, or of all where the other one lacks a class."""
    every = log_ratios(counts)
    return every and [log_ratios(counts, {1 - f}) or every for f in range(FOLDS)]


def labelled_tokens(docs: DataFrame, secret_docs: int = 20_000, ordinary_docs: int = 2_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled samples (token, is_secret, fold) out of a corpus: what the patterns find, and the other tokens.

    About ``secret_docs`` and ``ordinary_docs`` rows are read for them, chosen by a hash of the id.
    """
    n = max(docs.count(), 1)
    place = F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1_000_000))
    text = F.col(text_col).cast("string")
    chosen = lambda rows: docs.filter(text.isNotNull() & (place < int(1_000_000 * min(1.0, rows / n)) + 1)).select(text.alias("t"), fold_of(text).alias("fold"))
    secrets = chosen(secret_docs).select(F.explode(pattern_spans(F.col("t"))).alias("x"), "fold").select(F.col("x.v").alias("token"), F.lit(True).alias("is_secret"), "fold")
    bare = F.col("t")
    for _, pattern, _, _ in KINDS:
        bare = F.regexp_replace(bare, pattern, " ")
    ordinary = chosen(ordinary_docs).select(F.explode(F.regexp_extract_all(bare, F.lit(CANDIDATE), F.lit(0))).alias("token"), F.lit(False).alias("is_secret"), "fold")
    return secrets.unionByName(ordinary)


def held_out(tokens: DataFrame, least_total: float = 12.0, least_mean: float = 0.5) -> DataFrame:
    """How distinct labelled tokens (token, is_secret, fold) of six characters or more are judged by the other fold's chains: (is_secret, n, flagged).

    The flagged share of secrets is the recall; that of ordinary tokens is an upper bound of the false alarms, as some of these are secrets without a label.
    """
    tables = judges(transitions(tokens))
    rows = tokens.filter(F.length("token") >= 6).distinct()
    flagged = F.lit(False)
    for f, table in enumerate(tables or ()):
        flagged = F.when(F.col("fold") == f, is_random(F.col("token"), table, least_total, least_mean)).otherwise(flagged)
    return rows.groupBy("is_secret").agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged"))


def is_random(token: Column, table: list[float], least_total: float, least_mean: float) -> Column:
    return log_ratio(token, table) >= F.greatest(F.lit(least_total), least_mean * (F.length(token) - 1))


def log_ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token: positive for random strings, 0 for less than two characters."""
    values = F.expr("array(" + ",".join(f"{x:.6f}D" for x in table) + ")")
    states = F.expr("array(" + ",".join(str(ALPHABET.find(chr(c)) + 1) for c in range(128)) + ")")
    ratio = lambda a, b: F.get(values, a * STATES + b)

    def total(s: Column) -> Column:
        pairs = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), ratio)
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    return F.when(F.length(token) < 2, 0.0).otherwise(let(F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(states, F.ascii(c)), F.lit(0))), total))


def clear_of(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``: by the greatest end before each, and the least start after it."""
    fixed = lambda x, yes, no: F.when(x["rank"] < len(KINDS), yes).otherwise(F.lit(no))

    def swept(events: Column) -> Column:
        ends = running(F.transform(events, lambda x: fixed(x, x["e"], 0)), F.lit(0), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(events, lambda x: fixed(x, x["s"], 2**31 - 1))), F.lit(2**31 - 1), F.least))
        around = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        kept = F.zip_with(events, around, lambda x, a: F.when((x["rank"] == len(KINDS)) & (a["e"] <= x["s"]) & (x["e"] <= a["s"]), x))
        return F.filter(kept, lambda x: x.isNotNull())

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), let(F.array_sort(F.concat(base, spans)), swept)).otherwise(spans)


def scan(
    docs: DataFrame, tokens: DataFrame | None = None, least_total: float = 12.0, least_mean: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", into: str = "secrets",
) -> DataFrame:
    """``docs`` with a struct ``into`` (base, added): arrays of spans (s, rank, e, kind, v).

    ``tokens`` are labelled samples (token, is_secret); by default they come from the corpus.
    """
    unused(docs, into)
    labelled = labelled_tokens(docs, id_col=id_col, text_col=text_col) if tokens is None else tokens.withColumn("fold", F.lit(0))
    tables = judges(transitions(labelled))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.array().cast(SPAN)
    if tables:
        random = lambda table: F.filter(located(text, CANDIDATE), lambda x: is_random(x["v"], table, least_total, least_mean))
        found = random(tables[0]) if tables[0] == tables[1] else F.when(fold_of(text) == 0, random(tables[0])).otherwise(random(tables[1]))
    found = _named(found, len(KINDS), MARKOV)
    rows = docs.withColumn(into, F.struct(pattern_spans(text).alias("base"), found.alias("found")))
    base = F.col(into)["base"]
    return rows.withColumn(into, F.struct(base.alias("base"), clear_of(F.col(into)["found"], base).alias("added")))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined in the order of start and kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
