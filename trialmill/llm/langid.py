"""Language identification by error-correcting output codes.

Every language gets a codeword of +1/-1 bits. For each bit a linear classifier over hashed byte
n-grams (log ratio of the mean n-gram distributions of the languages on either side) gives a
margin, which a one-dimensional logistic fit turns into a calibrated one. Decoding sums, for each
codeword, the logistic loss of the margins against its bits, weighted by how reliable the bit's
classifier was on labelled rows; the least loss wins. A small lead over the runner-up is flagged.

Training learns every label. It reads about ``per_lang`` labelled rows of a language (default 4000),
chosen by a hash of the id; of languages with FOLD_FROM rows or more, a fifth of the rows is left out
and only calibrates. What comes to the driver is one row a language, one a feature (N_FEATURES at
most) and the margins of at most ``calibrate`` rows. Prediction reads every whole text and nothing else.

Defined cases: null, empty and letterless texts are ``und`` with score 0. Rows with a null label
are never learned from. Without labelled rows everything is ``und``. Repeated rows and ties change
nothing (equal losses: the language first in code-point order). Very long texts are read in slices
of bounded size. All columns of the input come back unchanged; one that has the name of the result is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmill.llm.common import broadcast_if_few, unused

#: n-grams of these many bytes, hashed to so many features.
ORDERS, FEATURE_BITS = (2, 3), 16
N_FEATURES = 1 << FEATURE_BITS
SLICE = 1 << 20
SMOOTHING = 0.5
#: Languages with so many labelled rows leave one row in HELD_BACK to calibration.
FOLD_FROM, HELD_BACK = 50, 5
BLOCKS = 64  # of features, in training
UND = "und"
RESULT = "lang_pred string, score double, runner_up string, ambiguous boolean"
#: ASCII bytes other than letters become spaces.
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of a text, slice by slice."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + max(ORDERS) - 1]
        for order in ORDERS:
            n = min(len(part) - order + 1, SLICE)
            if n <= 0:
                continue
            code = np.full(n, order, np.uint32)
            for i in range(order):
                code = code * np.uint32(257) + part[i : i + n]
            yield (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)


def codewords(n: int) -> np.ndarray:
    """n codewords: all distinct splits for up to five languages, else the best of seeded random draws."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(2 ** (n - 1) - 1)] for i in range(n)], np.int8)
    rng, bits, best, apart = np.random.default_rng(7), max(15, int(np.ceil(10 * np.log2(n)))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0, dtype=int)) < n]
        agree = code.astype(np.float32) @ code.T.astype(np.float32)
        distance = int((code.shape[1] - agree[~np.eye(n, dtype=bool)].max()) // 2)
        if distance > apart:
            best, apart = code, distance
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    slope: np.ndarray
    shift: np.ndarray
    trust: np.ndarray  # of each bit, sums to 1
    min_lead: float

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for f in features(text):
            total += self.weights[f].sum(axis=0, dtype=np.float64)
            n += len(f)
        return total / max(n, 1)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        z = self.slope * margins + self.shift
        return (self.trust * np.logaddexp(0, -self.code * z)).sum(axis=1)

    def decide(self, text: str | None) -> tuple[str, float, str | None, bool]:
        if not self.langs or text is None or not any(map(str.isalpha, text)):
            return UND, 0.0, None, False
        loss = self.losses(self.margins(text))
        near = np.exp((loss.min() - loss) * self.code.shape[1])
        share = near / near.sum()
        first, *rest = np.argsort(loss, kind="stable")
        lead = share[first] - share[rest[0]] if rest else 1.0
        return self.langs[first], float(share[first]), self.langs[rest[0]] if rest else None, bool(lead < self.min_lead)


def train(
    docs: DataFrame, labelled: Column, per_lang: int = 4000, calibrate: int = 4000, min_lead: float = 0.02,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Learn from the rows of ``docs`` for which ``labelled`` holds and the label is not null."""
    rows = docs.filter(labelled & F.col(lang_col).isNotNull() & (F.col(lang_col) != UND))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    per_label = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    sizes = {r["lang"]: r["rows"] for r in per_label.collect()}  # one row a language
    langs = sorted(sizes)
    code = codewords(len(langs))

    place = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000))
    # One row a label: broadcast, or texts would be dealt by language.
    sized = rows.filter("text IS NOT NULL").join(broadcast_if_few(per_label, len(sizes)), "lang")
    back = (F.col("rows") >= FOLD_FROM) & (F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(HELD_BACK)) == 0)
    taken = lambda seed, bound: place(seed) < F.floor(1_000_000 * F.least(F.lit(1.0), F.lit(float(bound)) / F.col("rows"))) + 1
    learned = sized.filter(~back & taken(1, per_lang)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                held = np.zeros(N_FEATURES, np.int64)
                for text in texts:
                    for f in features(text):
                        held += np.bincount(f, minlength=N_FEATURES)
                (at,) = held.nonzero()
                yield pd.DataFrame({"lang": lang, "feature": at, "n": held[at]})

    found = learned.mapInPandas(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    weights = _weights(found, langs, code)
    bits = code.shape[1]
    model = Model(langs, code, weights, np.full(bits, 20.0), np.zeros(bits), np.full(bits, 1.0 / bits), min_lead)
    if len(langs) < 2:
        return model
    held_back = sum(n for n in sizes.values() if n >= FOLD_FROM) / HELD_BACK
    return _calibrated(model, sized.filter(back & (place(2) < int(1_000_000 * min(1.0, calibrate / max(held_back, 1))) + 1)).select("lang", "text"))


def _weights(found: DataFrame, langs: list[str], code: np.ndarray) -> np.ndarray:
    """Features x bits: log ratio of the mean n-gram distributions of the languages on either side of each bit.

    Counts (lang, feature, n) of all languages meet in blocks of features, on executors.
    """
    weights = np.zeros((N_FEATURES, code.shape[1]), np.float32)
    if len(langs) < 2:
        return weights
    totals = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    mass = np.array([totals.get(lang, 0) + SMOOTHING * N_FEATURES for lang in langs])
    sides = [(code == side) / (code == side).sum(axis=0) / mass[:, None] for side in (1, -1)]  # languages x bits
    index = {lang: k for k, lang in enumerate(langs)}

    def weigh(block: pd.DataFrame) -> pd.DataFrame:
        names, rows = np.unique(block["feature"], return_inverse=True)
        n = np.full((len(names), len(index)), SMOOTHING)
        n[rows, block["lang"].map(index)] += block["n"]
        ratio = np.log(n @ sides[0]) - np.log(n @ sides[1])
        return pd.DataFrame({"feature": names, "weights": list(ratio)})

    weights[:] = np.log(SMOOTHING * sides[0].sum(axis=0)) - np.log(SMOOTHING * sides[1].sum(axis=0))  # features that nothing has
    blocks = found.withColumn("block", F.col("feature") % BLOCKS).groupBy("block").applyInPandas(weigh, "feature long, weights array<double>")
    for r in blocks.toLocalIterator():  # at most N_FEATURES rows
        weights[r["feature"]] = r["weights"]
    return weights


def _calibrated(model: Model, sample: DataFrame) -> Model:
    """Logistic slope and shift of each bit, and its trust, from the margins of a bounded sample."""
    shared = sample.sparkSession.sparkContext.broadcast(vars(model))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw = Model(**shared.value)
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "margins": [raw.margins(t) for t in batch["text"]]})

    rows = sample.mapInPandas(measure, "lang string, margins array<double>").collect()
    if not rows:
        return model
    x = np.array([r["margins"] for r in rows])
    y = model.code[[model.langs.index(r["lang"]) for r in rows]] > 0
    for b in range(x.shape[1]):
        scale = x[:, b].std() or 1.0
        a = np.column_stack([x[:, b] / scale, np.ones(len(x))])
        w, ridge = np.zeros(2), np.diag([0.01, 0.01])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            gradient = a.T @ (p - y[:, b]) + ridge @ w
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, gradient)
        model.slope[b], model.shift[b] = w[0] / scale, w[1]
        wrong = np.clip(((a @ w > 0) != y[:, b]).mean(), 1e-3, 0.499)
        model.trust[b] = np.log((1 - wrong) / wrong)
    model.trust /= model.trust.sum()
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into`` (lang_pred, score, runner_up, ambiguous); only texts leave the JVM."""
    unused(docs, into)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf(RESULT)
    def decide(texts: pd.Series) -> pd.DataFrame:
        learned = Model(**shared.value)
        decided = [learned.decide(t) for t in texts]
        return pd.DataFrame(decided, columns=["lang_pred", "score", "runner_up", "ambiguous"])

    return docs.withColumn(into, decide(F.col(text_col)))
