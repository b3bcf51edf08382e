"""Deterministic text checks, as column expressions over an array of check records.

A check is a struct (type, desc, patterns, pattern, value, field, allowed); ``value`` and ``allowed`` are JSON text.
Texts stay in the JVM; only regular expressions and JSON functions are used. Patterns are Python's; ``prepared`` writes them in Java's syntax,
each once in a process, before texts meet them. One that is no regular expression is taken literally.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trialmill.functions.patterns import java_or_literal

CHECKS = "array<struct<type:string,desc:string,patterns:array<string>,pattern:string,value:string,field:string,allowed:string>>"

# Phrases that negate what follows, looked for in the 18 characters before a match. Each phrase has its own reach out of
# these 18 characters, so the one with optional parts ("don't", with or without apostrophe and space) is listed by its cases: "n't"
# covers those with an apostrophe.
NEGATIONS = ("not", "no", "never", "avoid", "without", "n't", "dont", "do nt", "instead of")
NEGATION_REACH = 18
# Lexicons of the text flags.
HEDGE = (
    r"\b(i('?m| am) not sure|i (don'?t|do not) (know|have)|insufficient (information|context|data)|cannot determine|unable to (determine|tell)"
    r"|not enough (information|context)|it'?s unclear|hard to say|i can'?t be certain)\b"
)
REFUSAL = r"\b(i (cannot|can'?t|won'?t|will not)|i'?m (unable|not able)|as an ai|i must decline|i refuse|cannot assist|cannot help with)\b"
FENCE = "```"
#: Kinds of checks that pass if no pattern matches without a negation before it.
EXCLUDING = ("must_exclude", "must_exclude_action", "must_not_endorse")
# Fixed value: what counts as a code fence around JSON, so that the same text is parsed.
FENCED_JSON = r"(?s)```(?:json)?\s*(.+?)```"

#: A match is not negated if none of the phrases, plus non-word characters up to the reach, stands before it.
UNNEGATED = "(?<!(?:" + "|".join(rf"{x}[^\p{{L}}\p{{N}}_]{{0,{NEGATION_REACH - len(x)}}}" for x in NEGATIONS) + "))"


def unnegated(text: Column, pattern: Column) -> Column:
    """Some match of the (Java) pattern has no negation right before it; case does not matter."""
    return F.regexp_like(text, F.concat(F.lit("(?iu)" + UNNEGATED + "(?:"), pattern, F.lit(")")))


def java_pattern(kind: str | None, pattern: str | None) -> str | None:
    """The pattern of a check of a kind, in Java's syntax.

    Lists of patterns are lower-cased first, as the texts are. A pattern that this breaks is taken as it stands where a match is
    asked for, with case ignored, and literally where none may be.
    """
    if pattern is None:
        return None
    if kind == "regex":
        return java_or_literal(pattern, re.IGNORECASE | re.DOTALL)
    if kind in EXCLUDING:
        return java_or_literal(pattern.lower(), re.IGNORECASE)
    return java_or_literal(pattern.lower(), 0, pattern)


def prepare(check: dict) -> dict:
    """A check (as Python has it) with its patterns in Java's syntax."""
    kind = check.get("type")
    made = dict(check)
    if check.get("patterns") is not None:
        made["patterns"] = [java_pattern(kind, p) for p in check["patterns"]]
    if check.get("pattern") is not None:
        made["pattern"] = java_pattern(kind, check["pattern"])
    return made


def prepared(checks: Column) -> Column:
    """An array of checks with their patterns in Java's syntax. Best applied to a dimension of checks, not to each text."""

    @F.pandas_udf(CHECKS)
    def each(lists: pd.Series) -> pd.Series:
        return lists.map(lambda cs: None if cs is None else [None if c is None else prepare(dict(c) | {"patterns": None if c["patterns"] is None else list(c["patterns"])}) for c in cs])

    return each(checks)


def found_json(text: Column) -> Column:
    """VARIANT of the first JSON array, else object, in a text or in its first code fence; null if none parses."""
    body = F.when(F.regexp_like(text, F.lit(FENCED_JSON)), F.regexp_extract(text, FENCED_JSON, 1)).otherwise(text)

    def between(opener: str, closer: str) -> Column:
        i = F.instr(body, opener)
        back = F.instr(F.reverse(body), closer)
        j = F.length(body) - back + 1
        return F.when((i > 0) & (back > 0) & (j > i), F.try_parse_json(F.substring(body, i, j - i + 1)))

    return F.coalesce(between("[", "]"), between("{", "}"))


def json_items(value: Column) -> Column:
    """Items of a VARIANT array; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def canonical(value: Column) -> Column:
    """Items as JSON text with sorted keys, sorted: equal for arrays that are equal but for order."""
    return F.array_sort(F.transform(json_items(value), lambda x: F.to_json(x)))


def _keys(item: Column) -> Column:
    return F.array_sort(F.map_keys(F.try_variant_get(item, "$", "map<string,variant>")))


def json_key(value: Column) -> Column:
    """Text that is equal for equal JSON values: numbers by value, others by their JSON text; absent as null."""
    text = F.coalesce(F.to_json(value), F.lit("null"))
    return F.coalesce(F.when(text.rlike("^-?[0-9]"), text.try_cast("double").cast("string")), text)


def passes(check: Column, text: Column, parsed: Column, strict: bool = True) -> Column:
    """Whether one prepared check passes. ``parsed`` is found_json(text).

    Unknown types fail. ``max_len`` is such a type, unless ``strict`` is off.
    """
    low = F.lower(text)
    hit = lambda p: F.regexp_like(low, p)
    items = json_items(parsed)
    kind = check["type"]
    clear = ~F.exists(check["patterns"], lambda p: unnegated(low, p))
    allowed = F.transform(json_items(F.try_parse_json(check["allowed"])), json_key)
    wanted_keys = F.array_sort(F.from_json(check["value"], "array<string>"))
    found = (
        F.when(kind == "must_include", F.forall(check["patterns"], hit))
        .when(kind == "any_include", F.exists(check["patterns"], hit))
        .when(kind.isin(*EXCLUDING), clear)
        .when(kind == "valid_json_array", items.isNotNull())
        .when(kind == "json_len", F.size(items) == check["value"].try_cast("int"))
        .when(kind == "json_equals", canonical(parsed) == canonical(F.try_parse_json(check["value"])))
        .when(kind == "json_keys", F.forall(items, lambda x: F.coalesce(_keys(x) == wanted_keys, F.lit(False))))
        .when(
            kind == "json_field_values",
            F.forall(
                items,
                lambda x: F.coalesce(
                    F.array_contains(allowed, json_key(F.try_element_at(F.try_variant_get(x, "$", "map<string,variant>"), check["field"]))) & F.try_variant_get(x, "$", "map<string,variant>").isNotNull(), F.lit(False)
                ),
            ),
        )
        .when(kind == "regex", F.regexp_like(text, check["pattern"]))
    )
    if not strict:
        found = found.when(kind == "max_len", F.length(text) <= check["value"].try_cast("int"))
    return F.coalesce(found.otherwise(False), F.lit(False))


def run_checks(text: Column, parsed: Column, checks: Column, strict: bool = True, ready: bool = False) -> Column:
    """Array of (desc, type, pass) for an array of checks; ``ready`` if they are prepared. Give text and parsed as columns, not as expressions."""
    one = lambda c: F.struct(F.coalesce(c["desc"], c["type"]).alias("desc"), c["type"].alias("type"), passes(c, text, parsed, strict).alias("pass"))
    if ready:
        return F.transform(checks, one)
    # in an array of one, so that the patterns are written once a row
    return F.get(F.transform(F.array(prepared(checks)), lambda cs: F.transform(cs, one)), 0)


def passed(details: Column) -> Column:
    return F.size(F.filter(details, lambda d: d["pass"]))


def hedges(text: Column) -> Column:
    return F.regexp_like(text, F.lit("(?i)" + HEDGE))


def refuses(text: Column) -> Column:
    return F.regexp_like(text, F.lit("(?i)" + REFUSAL))


def has_fence(text: Column) -> Column:
    return text.contains(FENCE)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def repetition(words: Column, n: int = 3) -> Column:
    """1 - distinct n-grams / n-grams of an array of words; 0 without any. n-grams are told apart by 64-bit hashes."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    shifted = [F.slice(hashed, F.lit(k + 1), F.greatest(F.size(words) - (n - 1), F.lit(0))) for k in range(n)]
    grams = F.when(F.size(words) >= n, F.transform(F.arrays_zip(*[x.alias(f"w{k}") for k, x in enumerate(shifted)]), lambda g: F.xxhash64(*[g[f"w{k}"] for k in range(n)])))
    return F.when(F.size(words) < n, 0.0).otherwise(1 - F.size(F.array_distinct(grams)) / F.size(grams))


def first_svg(text: Column) -> Column:
    """The first SVG element of a text; empty if there is none."""
    return F.regexp_extract(text, r"(?is)<svg\b.*?</svg>", 0)


def keyword_answer(class_: Column, context: Column) -> Column:
    """A heuristic answer: for log classes the lines that look like trouble, else the first lines with key words."""
    lines = F.filter(F.split(context, "\n"), lambda x: F.trim(x) != "")
    trouble = F.filter(lines, lambda x: F.regexp_like(F.lower(x), F.lit("error|warn|fail|recent")))
    some = F.slice(F.when(F.size(trouble) > 0, trouble).otherwise(lines), 1, 5)
    as_json = F.to_json(F.transform(some, lambda x: F.create_map(F.lit("line"), F.trim(x))))
    return F.when(class_ == "test", as_json).otherwise(F.array_join(some, "\n"))


def random_answer(choices: list[str], seed: int, key: Column) -> Column:
    """One of the choices, by md5 of seed and key: the same in every run and engine."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8)
    at = F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(len(choices))).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in choices]), at + 1)
