import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmill.llm import langid

SYLLABLES = {"aa": ["the", "ing", "and", "er"], "bb": ["que", "eau", "oi", "é"], "cc": ["sch", "ung", "ö", "ie"], "dd": ["ción", "ar", "os", "ñ"], "ee": ["ka", "mu", "to", "ri"], "ff": ["zz", "yx", "wq", "vk"]}
SCHEMA = "doc_id long, text string, lang string, score int, language string"


def text(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def docs(spark, langs, n=300):
    rng = random.Random(1)
    rows = [(i, text(langs[i % len(langs)], rng, rng.randrange(3, 60)), langs[i % len(langs)], 1, "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def accuracy(spark, langs):
    rows, df = docs(spark, langs)
    model = langid.train(df, F.floor(F.col("doc_id") / 7) % 3 != 1)
    out = langid.identify(df, model, into="found").filter("floor(doc_id / 7) % 3 = 1").select("lang", "found.*").collect()
    assert all(0 <= r["score"] <= 1 for r in out)
    return sum(r["lang"] == r["lang_pred"] for r in out) / len(out)


def test_held_out_accuracy(spark):
    assert accuracy(spark, ["aa", "bb", "cc", "dd"]) > 0.97
    assert accuracy(spark, list(SYLLABLES)) > 0.97
    assert accuracy(spark, ["aa", "bb"]) > 0.97


def test_codewords_differ_in_several_bits():
    for n in (3, 4, 5, 8, 20):
        code = langid.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (2 if n == 3 else 3)
        assert (np.abs(code.sum(0, dtype=int)) < n).all()


def test_one_flipped_bit_is_corrected():
    code = langid.codewords(5)
    for k in range(5):
        for b in range(code.shape[1]):
            z = code[k].astype(float).copy()
            z[b] = -z[b]
            model = langid.Model(list("abcde"), code, np.zeros((1, 1)), np.ones(code.shape[1]), np.zeros(code.shape[1]), np.full(code.shape[1], 1 / code.shape[1]), 0.05)
            assert int(np.argmin(model.losses(z))) == k


def test_und_nulls_and_empty_tables(spark):
    rows, df = docs(spark, ["aa", "bb"])
    model = langid.train(df.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang"))), F.lit(True))
    odd = spark.createDataFrame([(1, None, None, 1, "x"), (2, "", None, 1, "x"), (3, "12 !? 34", None, 1, "x"), (4, "THE ANDING", None, 1, "x"), (5, "the and " * 200000, None, 1, "x")], SCHEMA)
    got = {r["doc_id"]: r["found"] for r in langid.identify(odd, model, into="found").collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "aa" and got[5]["lang_pred"] == "aa"
    assert langid.identify(odd.limit(0), model, into="found").count() == 0
    nothing = langid.train(df.limit(0), F.lit(True))
    assert {r["found"]["lang_pred"] for r in langid.identify(odd, nothing, into="found").collect()} == {"und"}


def test_letters_alone_make_a_language(spark):
    rows, df = docs(spark, ["aa", "bb"])
    model = langid.train(df, F.lit(True))
    odd = spark.createDataFrame([(i, t, None, 1, "x") for i, t in enumerate(["½ ² ①", "Ⅳ _ 12", "é", None])], SCHEMA)
    got = {r["doc_id"]: r["f"]["lang_pred"] for r in langid.identify(odd, model, into="f").collect()}
    assert got[0] == got[1] == got[3] == "und" and got[2] != "und"
    with pytest.raises(ValueError, match="language"):
        langid.identify(odd, model)


def test_every_label_is_learned(spark):
    letters = [chr(0x400 + 3 * k) + chr(0x401 + 3 * k) for k in range(90)]  # more than were learned once
    rows = [(i, " ".join([letters[i % 90]] * (5 + i % 7)), f"l{i % 90:02d}", 1, "x") for i in range(720)]
    df = spark.createDataFrame([*rows, (9000, "zq zq zq zq", "rare", 1, "x")], SCHEMA)
    model = langid.train(df, F.lit(True))
    assert model.langs == sorted({r[2] for r in rows} | {"rare"})
    out = langid.identify(df, model, into="f").select("lang", "f.lang_pred").collect()
    assert sum(r[0] == r[1] for r in out) / len(out) > 0.95


def plain_features(text):
    raw = " " + " ".join("".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).split()) + " "
    data = raw.encode()
    for order in (2, 3):
        for i in range(len(data) - order + 1):
            code = order
            for byte in data[i : i + order]:
                code = (code * 257 + byte) % 2**32
            yield (code * 0x9E3779B1 % 2**32) >> 16


def test_decoder_against_plain_counts_and_losses(spark):
    rows, df = docs(spark, ["aa", "bb", "cc", "dd", "ee", "ff"], 240)  # 40 a language: nothing is held back
    model = langid.train(df, F.lit(True), per_lang=10**6)
    assert (model.slope == 20).all() and (model.shift == 0).all()
    counts = {lang: Counter() for lang in SYLLABLES}
    for _, t, lang, *_ in rows:
        counts[lang].update(plain_features(t))
    share = lambda lang, f: (counts[lang][f] + 0.5) / (counts[lang].total() + 0.5 * 65536)
    bits = range(model.code.shape[1])
    sides = [[[lang for k, lang in enumerate(model.langs) if model.code[k, b] == side] for side in (1, -1)] for b in bits]
    mean = lambda langs, f: sum(share(x, f) for x in langs) / len(langs)
    weight = lru_cache(None)(lambda b, f: math.log(mean(sides[b][0], f)) - math.log(mean(sides[b][1], f)))
    rng = random.Random(9)
    for lang in SYLLABLES:
        t = text(lang, rng, 6) + "; É 7"
        seen = list(plain_features(t))
        margins = [sum(weight(b, f) for f in seen) / len(seen) for b in bits]
        loss = [sum(math.log1p(math.exp(-model.code[k, b] * 20 * margins[b])) for b in bits) / len(bits) for k in range(len(model.langs))]
        assert np.allclose(model.margins(t), margins, atol=1e-5)
        near = [math.exp((min(loss) - x) * len(bits)) for x in loss]
        pred, score, second, _ = model.decide(t)
        order = sorted(range(len(loss)), key=loss.__getitem__)
        assert (pred, second) == (model.langs[order[0]], model.langs[order[1]]) and math.isclose(score, max(near) / sum(near), rel_tol=1e-3)


def test_calibration_sees_only_rows_that_were_held_back(spark):
    rows, df = docs(spark, ["aa", "bb"], 400)
    back = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(langid.HELD_BACK)) == 0
    noisy = df.withColumn("lang", F.when(back & (F.rand(1) < 0.5), F.when(F.col("lang") == "aa", "bb").otherwise("aa")).otherwise(F.col("lang")))
    sure, unsure = langid.train(df, F.lit(True)), langid.train(noisy, F.lit(True))
    assert (sure.weights == unsure.weights).all()  # labels of held-back rows teach no n-grams
    assert sure.decide("the anding er")[1] > unsure.decide("the anding er")[1] + 0.1


def test_null_ids_and_repeated_rows(spark):
    rows, df = docs(spark, ["aa", "bb"], 60)
    odd = df.unionByName(df.limit(10).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(df.limit(10))
    out = langid.identify(odd, langid.train(odd, F.lit(True)), into="f").select("lang", "f.lang_pred").collect()
    assert len(out) == 80 and sum(r[0] == r[1] for r in out) >= 78


def test_training_deals_no_text_by_language(spark, monkeypatch):
    rows, df = docs(spark, ["aa", "bb"], 60)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    seen = []
    plain = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: (seen.append(self._jdf.queryExecution().executedPlan().toString()), plain(self, *a, **k))[1])
    try:
        langid.train(df, F.lit(True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in seen)


def test_long_texts_are_sliced_without_loss(monkeypatch):
    t = text("bb", random.Random(2), 400)
    whole = np.sort(np.concatenate(list(langid.features(t))))
    monkeypatch.setattr(langid, "SLICE", 64)
    assert (np.sort(np.concatenate(list(langid.features(t)))) == whole).all()
