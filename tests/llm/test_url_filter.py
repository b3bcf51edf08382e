import math
import re

import pytest

from trialmill.llm import url_filter as uf

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(len(r), r, v) for r, v in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/a?b#c", "http://example.com", "http://example.com/en/", "http://a.b.net/es/1", "http://net/es/", "http://notnet/es/", "x://a.org?q=/p", "x://a.org#/en/",
    "http://u@h.example.net:80/fr/x://y/", "http://é.com/ü?", "http://bad.example.org/1", "http://good.example.org/1", "http://new.example.org/1", "http://lonely.xyz/1", "http://a.example.com/de/\n2",
]


def posterior(outcomes, z=1.645):
    """Shrunken bounds in plain Python."""
    hosts = {}
    for h, bad in outcomes:
        if h:
            b, n = hosts.get(h, (0, 0))
            hosts[h] = (b + bad, n + 1)
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1]

    def grouped(key):
        out = {}
        for h, (b, n) in hosts.items():
            x = out.get(key(h), (0, 0))
            out[key(h)] = (x[0] + b, x[1] + n)
        return out

    def strength(groups):
        shares = [b / n for b, n in groups.values()]
        if len(shares) < 2:
            return 200.0
        m, inv = sum(shares) / len(shares), sum(1 / n for _, n in groups.values()) / len(groups)
        v = sum((s - m) ** 2 for s in shares) / (len(shares) - 1)
        if m * (1 - m) <= 0:
            return 200.0
        between = v / (m * (1 - m)) - inv
        return min(max((1 - inv) / between - 1 if between > 0 and inv < 1 else 200.0, 2.0), 200.0)

    top, mid = grouped(suffix), grouped(domain)
    mean = (sum(b for b, _ in hosts.values()) + 1) / (sum(n for _, n in hosts.values()) + 2)
    ks, kd, kh = strength(top), strength(mid), strength(hosts)

    def bound(h):
        m, w = mean, ks
        if suffix(h) in top:
            b, n = top[suffix(h)]
            m, w = (b + ks * m) / (n + ks), kd
            if domain(h) in mid:
                b, n = mid[domain(h)]
                m, w = (b + kd * m) / (n + kd), kh
                if h in hosts:
                    b, n = hosts[h]
                    m, w = (b + kh * m) / (n + kh), n + kh
        return m - z * math.sqrt(m * (1 - m) / (w + 1))

    return bound


def test_against_brute_force(spark):
    outcomes = [("bad.example.org", True)] * 60 + [("good.example.org", False)] * 60 + [("a.example.com", k % 3 == 0) for k in range(30)] + [("b.c.net", k % 2 == 0) for k in range(9)] + [("", True)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, rule int")
    bound = posterior(outcomes)
    got = {r["id"]: r for r in uf.judge(pages, spark.createDataFrame(outcomes, "host string, bad boolean"), RULES, 0.3).collect()}
    assert len(got) == 2 * len(URLS)
    for i, r in got.items():
        host, path = split(URLS[i % len(URLS)])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if host and ":" not in host:
            assert r["bound"] == pytest.approx(bound(host), abs=1e-12)
        assert r["verdict"] == (verdict or ("block" if r["bound"] > 0.3 else "allow"))
    verdicts = {URLS[i]: r["verdict"] for i, r in got.items() if i < len(URLS)}
    assert verdicts["http://bad.example.org/1"] == "block" and verdicts["http://good.example.org/1"] == "allow"


def test_no_labels_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad boolean")
    assert [r["verdict"] for r in uf.judge(pages, none, RULES).collect()] == ["allow"]
    assert uf.judge(pages.limit(0), none, RULES).count() == 0


def test_long_suffixes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("u@x.y.org:81",), ("localhost",)], "host string")
    domain, suffix = uf.levels_of(F.col("host"))
    assert [tuple(r) for r in df.select(domain, suffix).collect()] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("y.org", "org"), ("localhost", "localhost")]
    assert [tuple(r) for r in df.select(*uf.levels_of(F.col("host"), ["y.org"])).collect()][:3] == [("co.uk", "uk"), ("co.uk", "uk"), ("x.y.org", "y.org")]


def test_query_against_its_sql_with_long_suffixes(spark, tmp_path):
    import duckdb

    from trialmill.llm import queries

    hosts = ["a.bad.co.uk", "b.bad.co.uk", "good.co.uk", "co.uk", "x.org", "y.x.org", "localhost", "u@z.co.uk:81", "www.example.com"]
    pages = [(k, f"http://{hosts[k % 9]}/p/{k}") for k in range(180)] + [(900 + k, f"http://{h}/new") for k, h in enumerate([*hosts, "new.bad.co.uk", "other.co.uk", "q.uk"])]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    labels = [(k, int("bad" not in hosts[k % 9] and k % 7 != 0), 0) for k in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.op9_url_filter(spark, str(tmp_path))
    key = lambda r: tuple(map(str, r))
    want = sorted(map(key, con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op9_url_filter']})").fetchall()))
    assert sorted(map(key, got.collect())) == want
    assert {v for *_, v in want} == {"allow", "block"}
