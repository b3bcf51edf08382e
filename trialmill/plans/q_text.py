"""Text-check queries over documents and conversations."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from trialmill.functions import checks as ck
from trialmill.plans.base import query, table, trials

C = F.col


def _spec(*checks: dict):
    return F.from_json(F.lit(json.dumps([ck.prepare(c) for c in checks])), ck.CHECKS)


def _passed(df, key: str, text, *checks: dict, strict: bool = True):
    """(key, passed, total) of a fixed list of checks."""
    parsed = ck.found_json(C("text")) if any("json" in c["type"] for c in checks) else F.lit(None).cast("variant")
    rows = df.select(key, text.alias("text")).withColumn("parsed", parsed).withColumn("checks", _spec(*checks))
    rows = rows.withColumn("details", ck.run_checks(C("text"), C("parsed"), C("checks"), strict, ready=True))
    return rows.select(key, ck.passed(C("details")).alias("passed"), F.size("details").alias("total"))


@query(
    "c01_include_checks",
    "SELECT doc_id, (contains(lower(text), 'the') AND regexp_matches(lower(text), 'th(er|at)'))::INT + (regexp_matches(lower(text), 'que|sch'))::INT + (regexp_matches(text, '(?is)the.{0,20}of'))::INT AS passed, 4 AS total FROM documents",
    views=False,
)
def c01(spark, d):
    return _passed(
        table(spark, d, "documents"), "doc_id", C("text"),
        {"type": "must_include", "patterns": ["the", "th(er|at)"]}, {"type": "any_include", "patterns": ["que", "sch"]},
        {"type": "regex", "pattern": "the.{0,20}of"}, {"type": "no_such_type"},
    )


_NEG = "(not\\W{0,15}|no\\W{0,16}|never\\W{0,13}|avoid\\W{0,13}|without\\W{0,11}|n''t\\W{0,15}|dont\\W{0,14}|do nt\\W{0,13}|instead of\\W{0,8})delete"
_PHRASE = "CASE k % 6 WHEN 0 THEN 'please delete it' WHEN 1 THEN 'do not delete it' WHEN 2 THEN 'never, ever delete' WHEN 3 THEN 'do not delete; then delete it' WHEN 4 THEN 'keep it' ELSE 'instead of delete, wait' END"


@query("c03_unnegated", f"SELECT seq, (NOT contains(regexp_replace({_PHRASE}, '{_NEG}', '', 'g'), 'delete'))::INT * 2 AS passed, 2 AS total FROM trials")
def c03(spark, d):
    return _passed(trials(spark, d), "seq", F.expr(_PHRASE), {"type": "must_exclude", "patterns": ["delete"]}, {"type": "must_not_endorse", "patterns": ["delete", "(now"]})


@query(
    "c12_python_patterns",
    "SELECT doc_id, regexp_matches(text, '(?is)th[^ ]{0,3}e')::INT + regexp_matches(text, '(?is)[^.]\\z')::INT "
    "+ regexp_matches(text, '[0-9][0-9\\[]')::INT + (regexp_matches(lower(text), '(an|en)d') AND regexp_matches(lower(text), 'o{0,2}n'))::INT + contains(lower(text), '(?p<n>')::INT + (contains(lower(text), 'e') OR contains(lower(text), '[x'))::INT AS passed, 6 AS total FROM documents",
    views=False,
)
def c12_python(spark, d):
    """Named groups, open bounds, ends of texts and nested sets in Python's syntax; a list's pattern that is none once lower-cased."""
    return _passed(
        table(spark, d, "documents"), "doc_id", C("text"),
        {"type": "regex", "pattern": "(?P<first>th)(?:[^ ]{,3})e"}, {"type": "regex", "pattern": r"[^.]\Z"}, {"type": "regex", "pattern": r"(?s-i:[0-9])[\d[]{1,}"},
        {"type": "must_include", "patterns": ["(?P<v>AN|en)d", "o{,2}n"]}, {"type": "any_include", "patterns": ["(?P<n>"]}, {"type": "any_include", "patterns": ["(?i)E", "[x"]},
    )


@query("c03_python_patterns", f"SELECT seq, (NOT contains(regexp_replace({_PHRASE}, '{_NEG}', '', 'g'), 'delete'))::INT + (NOT contains({_PHRASE}, '(?p<n>'))::INT AS passed, 2 AS total FROM trials")
def c03_python(spark, d):
    return _passed(trials(spark, d), "seq", F.expr(_PHRASE), {"type": "must_exclude", "patterns": ["de{,1}l(e)te", r"(x)?(?(1)y|delete\b)"]}, {"type": "must_not_endorse", "patterns": ["(?P<n>delete)"]})


_REPLY = (
    "CASE k % 6 WHEN 0 THEN concat('Here: ```json\n[{\"id\": ', CAST(k AS VARCHAR(9)), ', \"sev\": \"high\"}]\n``` done') WHEN 1 THEN concat('[{\"id\": 1, \"sev\": \"low\"}, {\"sev\": \"high\", \"id\": 2}] is it') "
    "WHEN 2 THEN 'object {\"id\": 1}' WHEN 3 THEN 'broken [1, 2' WHEN 4 THEN 'empty []' ELSE 'prose only' END"
)


_BETWEEN = "CASE WHEN strpos(b, '{0}') > 0 AND strpos(reverse(b), '{1}') > 0 AND length(b) - strpos(reverse(b), '{1}') + 1 > strpos(b, '{0}') THEN substr(b, strpos(b, '{0}'), length(b) - strpos(reverse(b), '{1}') + 2 - strpos(b, '{0}')) END"


@query(
    "c05_json_checks",
    f", r AS (SELECT seq, {_REPLY} AS t FROM trials), f AS (SELECT seq, CASE WHEN regexp_matches(t, '(?s)```(?:json)?\\s*(.+?)```') THEN regexp_extract(t, '(?s)```(?:json)?\\s*(.+?)```', 1) ELSE t END AS b FROM r), "
    f"c AS (SELECT seq, {_BETWEEN.format('[', ']')} AS l, {_BETWEEN.format('{', '}')} AS o FROM f), "
    "j AS (SELECT seq, CASE WHEN json_valid(l) THEN l::JSON WHEN json_valid(o) THEN o::JSON END AS j FROM c), "
    "i AS (SELECT seq, json_type(j) = 'ARRAY' AS is_list, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [] END AS xs FROM j), "
    "k AS (SELECT seq, is_list, xs, list_sort(list_transform(xs, lambda x: array_to_string(list_transform(list_sort(json_keys(x)), lambda k: k || '=' || (x->k)::VARCHAR), ','))) AS canon FROM i) "
    "SELECT seq, (coalesce(is_list, false)::INT + coalesce(is_list AND len(xs) = 2, false)::INT + coalesce(is_list AND len(list_filter(xs, lambda x: list_sort(json_keys(x)) <> ['id', 'sev'])) = 0, false)::INT "
    "+ coalesce(is_list AND canon = ['id=1,sev=\"low\"', 'id=2,sev=\"high\"'], false)::INT + coalesce(is_list AND len(list_filter(xs, lambda x: (x->'sev')::VARCHAR NOT IN ('\"high\"', '\"low\"'))) = 0, false)::INT "
    "+ coalesce(is_list AND len(list_filter(xs, lambda x: (x->>'id')::INT NOT IN (1, 2))) = 0, false)::INT "
    "+ coalesce(is_list AND len(list_filter(xs, lambda x: (x->'id')::VARCHAR NOT IN ('\"1\"', '\"2\"', '\"k\"'))) = 0, false)::INT)::INT AS passed, 7 AS total FROM k",
)
def c05(spark, d):
    return _passed(
        trials(spark, d), "seq", F.expr(_REPLY),
        {"type": "valid_json_array"}, {"type": "json_len", "value": "2"}, {"type": "json_keys", "value": '["sev", "id"]'},
        {"type": "json_equals", "value": '[{"id": 2, "sev": "high"}, {"id": 1, "sev": "low"}]'}, {"type": "json_field_values", "field": "sev", "allowed": ["high", "low"]},
        {"type": "json_field_values", "field": "id", "allowed": [1, 2.0]}, {"type": "json_field_values", "field": "id", "allowed": ["1", "2", "k"], "desc": "numbers are no texts"},
    )


@query("c14_max_len", "SELECT doc_id, (length(text) <= 2000)::INT AS passed, 1 AS total FROM documents", views=False)
def c14(spark, d):
    return _passed(table(spark, d, "documents"), "doc_id", C("text"), {"type": "max_len", "value": "2000"}, strict=False)


_SAYS = "concat(CASE k % 5 WHEN 0 THEN 'I am not sure' WHEN 1 THEN 'As an AI I cannot assist' WHEN 2 THEN 'it''s unclear, hard to say' WHEN 3 THEN '```code```' ELSE 'fine' END, ' ', scenario)"


@query("c15_text_flags", "SELECT seq, k % 5 IN (0, 2) AS hedge, k % 5 = 1 AS refusal, k % 5 = 3 AS fence FROM trials")
def c15(spark, d):
    rows = trials(spark, d).select("seq", F.expr(_SAYS.replace("it''s", "it\\'s")).alias("t"))
    return rows.select("seq", ck.hedges(C("t")).alias("hedge"), ck.refuses(C("t")).alias("refusal"), ck.has_fence(C("t")).alias("fence"))


@query(
    "a47_repetition",
    "WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], ' ')) AS g FROM d) "
    "SELECT doc_id, CASE WHEN len(g) = 0 THEN 0e0 ELSE 1 - len(list_distinct(g)) / len(g)::DOUBLE END AS repetition FROM g",
    views=False,
)
def a47(spark, d):
    rows = table(spark, d, "documents").select("doc_id", ck.words_of(C("text")).alias("w"))
    return rows.select("doc_id", ck.repetition(C("w")).alias("repetition"))


@query(
    "c16_keyword_answers",
    ", c AS (SELECT seq, class, concat('all good', chr(10), CASE WHEN k % 3 = 0 THEN 'fine ' ELSE 'error: ' END, k, chr(10), chr(10), ' recent ', chr(10), 'bye') AS t FROM trials), l AS (SELECT seq, class, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM c), "
    "h AS (SELECT *, list_filter(l, lambda x: regexp_matches(lower(x), 'error|warn|fail|recent')) AS h FROM l), s AS (SELECT *, (CASE WHEN len(h) > 0 THEN h ELSE l END)[1:5] AS s FROM h) "
    "SELECT seq, CASE WHEN class = 'test' THEN to_json(list_transform(s, lambda x: {'line': trim(x)}))::VARCHAR ELSE array_to_string(s, chr(10)) END AS answer FROM s",
)
def c16(spark, d):
    context = F.concat(F.lit("all good\n"), F.when(C("k") % 3 == 0, "fine ").otherwise("error: "), C("k").cast("string"), F.lit("\n\n recent \nbye"))
    return trials(spark, d).select("seq", ck.keyword_answer(C("class"), context).alias("answer"))


@query("c17_random_answers", "SELECT seq, ['restart', 'scale', 'wait', '[]'][('0x' || substr(md5('42:' || seq), 1, 8))::BIGINT % 4 + 1] AS answer FROM trials")
def c17(spark, d):
    return trials(spark, d).select("seq", ck.random_answer(["restart", "scale", "wait", "[]"], 42, C("seq")).alias("answer"))


@query(
    "c18_first_svg",
    "SELECT page_id, regexp_extract(html, '(?is)<title\\b.*?</title>', 0) AS title, regexp_extract(t, '(?is)<svg\\b.*?</svg>', 0) AS svg "
    "FROM (SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN html ELSE concat(html, '<SVG id=', page_id, '>', chr(10), '<g/></svg> <svg/></svg>') END AS t FROM pages)",
    views=False,
)
def c18(spark, d):
    drawn = F.concat(C("html"), F.lit("<SVG id="), C("page_id").cast("string"), F.lit(">\n<g/></svg> <svg/></svg>"))
    pages = table(spark, d, "pages").withColumn("t", F.when(C("page_id") % 3 == 0, C("html")).otherwise(drawn))
    return pages.select("page_id", F.regexp_extract("html", r"(?is)<title\b.*?</title>", 0).alias("title"), ck.first_svg(C("t")).alias("svg"))
