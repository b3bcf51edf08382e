"""The thin queries over the operators, with their production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialmill.llm import collocations, decontamination, exact_dedup, html_text, jaccard_join, langid, mixing, packing, quality, secrets, sharding, url_filter, vector_codes

N_SHARDS = 40
#: Words in a bin.
CAPACITY = 1024
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A host is blocked if its posterior share of bad pages is over this, by the lower bound.
BAD_LIMIT = 0.3


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins of CAPACITY words; bin_used and bin_docs describe the whole bin."""
    packed = packing.pack(documents(spark, sf_dir), capacity=CAPACITY)
    return packed.withColumnRenamed("id", "doc_id")


def held_out(doc_id) -> object:
    """Documents that language models never learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out. A null doc_id is neither held out nor learned from."""
    docs = documents(spark, sf_dir)
    model = langid.train(docs, ~held_out("doc_id") & F.col("doc_id").isNotNull())
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score", "language.runner_up", "language.ambiguous")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document, by the production rules."""
    judged = quality.cascade(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "quality.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the one of equal text that stays: the largest doc_id."""
    found = exact_dedup.find_duplicates(documents(spark, sf_dir), keep="max")
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of pattern spans, their digest, and all spans with those of the Markov models."""
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.col("secrets.base")
    n = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.concat(base, F.col("secrets.added"))).alias("spans"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of N_SHARDS contiguous shards of nearly equal bytes."""
    placed = sharding.shard_by_bytes(documents(spark, sf_dir), N_SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document: copies times size."""
    planned = mixing.plan_mix(documents(spark, sf_dir), weights=(5, 2, 1), cap=3, seed=17)
    return planned.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id that links lead to."""
    found = jaccard_join.components(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, bad) of labelled pages: the number that ends a page's path is the doc_id of its labels."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    named = pages.select(url_filter.host_of(F.col("url")).alias("host"), number.try_cast("long").alias("doc_id"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return named.join(labels, "doc_id").select("host", bad.alias("bad")).filter("bad IS NOT NULL")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; reputation comes from pages with labels (page_outcomes)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = url_filter.judge(pages, page_outcomes(spark, sf_dir), URL_RULES, BAD_LIMIT)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, with its lines, list items and tables."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return pages.select("page_id", html_text.extract(F.col("html")).alias("x")).select("page_id", "x.*")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of every vector of finite numbers, its error, and that of its label."""
    coded, books = vector_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    columns = [F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")]
    return coded.select(*columns)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of the benchmark cover, and the items these are of."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("row"), "text")
    found = decontamination.find(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = decontamination.n_hit(F.col("spans"))
    return found.select(
        F.col("row").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of every language."""
    return collocations.mine(documents(spark, sf_dir).select("lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_language_id, op3_quality_rules, op4_exact_dedup, op5_secret_scan, op6_sharding,
        op7_mixing, op8_jaccard_join, op9_url_filter, op10_html_extraction, op11_vector_codes, op12_decontamination,
        op13_collocations,
    )
}



def _codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The SQL of op11: one pair of tables a round, every part against every entry."""
    steps = [
        f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS c FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, label, k AS part, c[k * (len(c) // 8) + 1 : (k + 1) * (len(c) // 8)] AS x FROM v, range(0, 8) r(k)),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y FROM p QUALIFY entry < 16)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (
            SELECT vec_id, any_value(label) AS label, part, any_value(x) AS x, min(d * 16 + entry) AS m
            FROM (SELECT vec_id, label, p.part, x, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))::BIGINT AS d FROM p JOIN b{k} b ON p.part = b.part)
            GROUP BY vec_id, part)""")
        if k < rounds:
            steps.append(f"""
        b{k + 1} AS MATERIALIZED (
            SELECT part, entry, coalesce(z, y) AS y FROM b{k} LEFT JOIN (
                SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS z
                FROM (SELECT part, m % 16 AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL)
                GROUP BY part, entry) USING (part, entry))""")
    return ",".join(steps) + f"""
        , e AS (
            SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(hex(m % 16)), 2, '0'), '' ORDER BY part) AS code, sum(m // 16)::BIGINT AS error
            FROM a{rounds} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, h"""


ORACLE_SQL = {
    "op11_vector_codes": _codes_sql(),
    "op13_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
        w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
        g AS MATERIALIZED (
            SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a
            FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 4) r(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
        c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND a >= 10),
        x AS MATERIALIZED (
            SELECT lang, phrase, a, cut, array_to_string(w[:cut], ' ') AS left_, array_to_string(w[cut + 1 :], ' ') AS right_ FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
        s AS (
            SELECT x.lang, x.phrase, x.a, cut, l.a AS l, r.a AS r, ((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
            FROM x JOIN g l ON l.lang = x.lang AND l.phrase = left_ JOIN g r ON r.lang = x.lang AND r.phrase = right_),
        m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        i AS (SELECT lang, array_to_string(w[j : j + 1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 3) t(j) WHERE k = 3 GROUP BY ALL)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM m LEFT JOIN i USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000
    """,
    "op12_decontamination": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item, l, array_to_string(w[i : i + l - 1], ' ') AS g
            FROM (SELECT item, w, least(10, len(w)) AS l, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        dw AS (
            SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT l FROM win) WHERE i + l - 1 <= len(w)),
        hit AS (SELECT DISTINCT doc_id, i, l, item FROM dw JOIN win USING (l, g)),
        cov AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM hit, range(0, 10) r(j) WHERE j < l GROUP BY 1),
        its AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS x FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.x, '')) AS items_sha256, cov.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
    "op3_quality_rules": r"""
        WITH w AS (
            SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        win AS (
            SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
        rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(0, 8) r(j) GROUP BY 1),
        b AS (
            SELECT doc_id, t, ws, ls, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                   coalesce(cov.n, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN cov USING (doc_id)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND (n_dup_lines < 3 OR 10 * n_dup_lines <= 3 * len(ls))
               AND 10 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) <= 7 * length(regexp_replace(t, '[^\p{L}]', '', 'g'))
               AND 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) >= 7 * n_words AS kept
        FROM f
    """,
    "op6_sharding": """
        WITH RECURSIVE tbl AS (
            SELECT list(c ORDER BY i) AS tbl
            FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(0, 256) r(i))),
        d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        s AS (
            SELECT doc_id, octet_length(b) + 16 AS size,
                   xor(4294967295, list_reduce(
                       list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)),
                       lambda c, x: xor(c // 256, tbl[xor(c % 256, x) + 1]))) AS text_crc32
            FROM d, tbl),
        p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM s),
        q AS (SELECT *, least(39, (40 * (2 * upto - size)) // (2 * total))::INT AS shard FROM p)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
               (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
        FROM q
    """,
    "op9_url_filter": r"""
        WITH h AS (SELECT page_id, strpos(url, '://') AS pos, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
        hp AS (
            SELECT page_id, CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                   CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM h),
        n AS (SELECT *, string_split(name, '.') AS parts, array_to_string(string_split(name, '.')[-2:], '.') AS two FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM hp)),
        k AS (
            SELECT *, CASE WHEN len(parts) < 2 THEN name WHEN two IN (LONG) THEN array_to_string(parts[-3:], '.') ELSE two END AS domain, CASE WHEN two IN (LONG) THEN two ELSE parts[-1] END AS suffix,
                   try_cast(regexp_extract(path, '/([0-9]{1,18})(?:\.[a-z]+)?/?$', 1) AS BIGINT) AS doc_id FROM n),
        lab AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
        hosts AS (
            SELECT host, domain, suffix, sum((quality = 0 OR toxic = 1)::INT)::DOUBLE AS bad, count(*)::DOUBLE AS n
            FROM k JOIN lab USING (doc_id) WHERE host <> '' AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY ALL),
        domains AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY ALL),
        suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY ALL),
        g AS (SELECT 'h' AS lv, bad, n FROM hosts UNION ALL SELECT 'd', bad, n FROM domains UNION ALL SELECT 's', bad, n FROM suffixes),
        st AS (SELECT lv, count(*) AS k, avg(bad / n) AS m, var_samp(bad / n) AS v, sum(1e0 / n) / count(*) AS mi FROM g GROUP BY 1),
        ks AS (
            SELECT lv, least(greatest(coalesce(CASE WHEN k >= 2 AND m * (1 - m) > 0 AND v / nullif(m * (1 - m), 0) - mi > 0 AND mi < 1
                   THEN (1 - mi) / (v / (m * (1 - m)) - mi) - 1 END, 200e0), 2e0), 200e0) AS s FROM st),
        c AS (
            SELECT coalesce((SELECT s FROM ks WHERE lv = 's'), 200e0) AS ss, coalesce((SELECT s FROM ks WHERE lv = 'd'), 200e0) AS sd, coalesce((SELECT s FROM ks WHERE lv = 'h'), 200e0) AS sh,
                   (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM hosts) AS m0),
        t AS (SELECT suffix, (bad + ss * m0) / (n + ss) AS m FROM suffixes, c),
        dm AS (SELECT domain, (d.bad + sd * t.m) / (d.n + sd) AS m FROM domains d JOIN t USING (suffix), c),
        hm AS (SELECT host, (h.bad + sh * dm.m) / (h.n + sh) AS m, h.n + sh AS w FROM hosts h JOIN dm USING (domain), c),
        b AS (
            SELECT k.page_id, k.host, k.path, coalesce(hm.m, dm.m, t.m, m0) AS m, CASE WHEN hm.m IS NOT NULL THEN hm.w WHEN dm.m IS NOT NULL THEN sh WHEN t.m IS NOT NULL THEN sd ELSE ss END AS w
            FROM k LEFT JOIN hm USING (host) LEFT JOIN dm USING (domain) LEFT JOIN t USING (suffix), c),
        r AS (
            SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                           WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                           WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM b)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
               WHEN m - 1.645e0 * sqrt(m * (1 - m) / (w + 1)) > 0.3 THEN 'block' ELSE 'allow' END AS verdict FROM r
    """.replace("LONG", ", ".join(f"'{x}'" for x in url_filter.LONG_SUFFIXES)),
    "op8_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
            HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))),
        c(a, b) AS (SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
        m AS (SELECT a AS doc_id, min(b) AS b FROM c GROUP BY 1)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m.b, doc_id)) AS component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (t)
    """,
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   (CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight
            FROM d GROUP BY source),
        c AS (SELECT *, source_size::DOUBLE * 3 AS cap, source_size::DOUBLE * 3 / weight AS full_at FROM s),
        l AS (
            SELECT *, row_number() OVER o AS pos,
                   ((SELECT sum(source_size)::DOUBLE FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                   / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM c WINDOW o AS (ORDER BY full_at, source IS NULL, source)),
        f AS (SELECT pos AS first_pos, level AS first_level FROM l WHERE level <= full_at ORDER BY pos LIMIT 1),
        t AS (
            SELECT source, source_size, CASE WHEN first_pos IS NULL OR pos < first_pos THEN cap ELSE least(weight * first_level, cap) END AS target
            FROM l LEFT JOIN f ON true),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
        SELECT d.doc_id, d.size, r.source_size, r.target,
               (floor(r.rate)::BIGINT + CASE WHEN d.u < r.rate - floor(r.rate) THEN 1 ELSE 0 END) * d.size AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
    """,
}
