"""Quality rules as a short-circuit cascade.

Rules look at one text at a time and share what has been computed for it. On a bounded sample of
rows that pass the base rules, executors measure what each rule adds to the base figures, which are
there in any case, and which rules reject each row. The first rule is the one with most rejections
per second; each later one has most among the rows that the rules before it let pass. A text leaves
at its first failure. The order changes the cost, never the verdict: a text is kept if no rule rejects it.

Defined cases: a null or empty text has no words and fails the base. Ties between rules keep the
order in which they are given; a rule that rejects nothing comes last. Repeated rows get the same
result. A very long text is read whole, in memory linear in its length. An empty table gives an
empty result. Other columns come back unchanged; one that has the name of the result is refused.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmill.llm.common import WORD_PATTERN, unused

#: Characters that count as symbols. Fixed by the result contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_WORD = re.compile(WORD_PATTERN)
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def repeated_words(words: Sequence[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more; exact, by numbering pairs, fours, eights."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) > n - 1:
        return 0
    width = 1
    while width < window:
        step = min(width, window - width)
        pair = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        width += step
        if len(counts) == len(ids):
            return 0
    twice = (counts[ids] > 1).astype(np.int64)
    edges = np.zeros(n + 1, np.int64)
    edges[: len(twice)] += twice
    edges[window : window + len(twice)] -= twice
    return int((np.cumsum(edges[:n]) > 0).sum())


class Page:
    """One text with what its rules ask for, computed once."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @property
    def figures(self) -> tuple[int, int, int, int, int]:
        """The base figures, as they are returned."""
        return len(self.words), self.word_chars, self.n_symbols, self.n_dup_lines, self.n_repeat_words

    @property
    def base_failed(self) -> bool:
        return len(self.words) < 20 or 100 * self.n_repeat_words > 30 * len(self.words)


@dataclass(frozen=True)
class Rule:
    """``rejects`` sees a Page that passed the base rules."""

    name: str
    rejects: Callable[[Page], bool]


def _shouts(p: Page) -> bool:
    upper = sum(c.isupper() and c.isalpha() for c in p.text)  # letters only: there are upper-case numerals, too
    return 10 * upper > 7 * sum(map(str.isalpha, p.text))


def _few_letters(p: Page) -> bool:
    return 10 * sum(any(map(str.isalpha, w)) for w in p.words) < 7 * len(p.words)


#: Production rules.
RULES = (
    Rule("symbols", lambda p: 10 * p.n_symbols > len(p.words)),
    Rule("word_length", lambda p: not 2 * len(p.words) <= p.word_chars <= 15 * len(p.words)),
    Rule("repeated_lines", lambda p: p.n_dup_lines >= 3 and 10 * p.n_dup_lines > 3 * len(p.lines)),
    Rule("shouting", _shouts),
    Rule("few_letters", _few_letters),
)


def best_order(costs: Sequence[float], rejected: dict[int, int]) -> list[int]:
    """Rules by rejections per cost among what is left; ``rejected`` counts rows by the set of rules (as bits) that reject them."""
    order, rest = [], list(range(len(costs)))
    while rest:
        worth = lambda k: sum(n for bits, n in rejected.items() if bits >> k & 1) / max(costs[k], 1e-9)
        first = max(rest, key=lambda k: (worth(k), -k))
        order.append(first)
        rest.remove(first)
        rejected = {bits: n for bits, n in rejected.items() if not bits >> first & 1}
    return order


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The rules in their best order, measured on about ``sample_rows`` rows chosen by a hash of the id."""
    n = docs.count()
    share = min(1.0, sample_rows / max(n, 1))
    sample = docs.filter(F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(F.col(text_col).alias("text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent, seen = np.zeros(len(rules)), Counter()
        for batch in batches:
            for text in batch["text"]:
                page = Page(text)
                page.figures  # noqa: B018  every row pays for these
                if page.base_failed:
                    continue
                bits = 0
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    bits |= bool(rule.rejects(page)) << k
                    spent[k] += time.perf_counter() - began
                seen[bits] += 1
        yield pd.DataFrame({"bits": list(seen) + [-1] * len(rules), "rule": [-1] * len(seen) + list(range(len(rules))), "rows": [*seen.values(), *[0] * len(rules)], "spent": [0.0] * len(seen) + list(spent)})

    sums = sample.mapInPandas(measure, "bits long, rule int, rows long, spent double").groupBy("bits", "rule").agg(F.sum("rows").alias("rows"), F.sum("spent").alias("spent"))
    got = sums.collect()  # one row a rule, and one for each set of rules that some row of the sample fails
    costs = {r["rule"]: r["spent"] for r in got if r["rule"] >= 0}
    return [rules[k] for k in best_order([costs.get(k, 0.0) for k in range(len(rules))], {r["bits"]: r["rows"] for r in got if r["bits"] >= 0})]


def judge(ordered: Sequence[Rule]) -> Callable[[Column], Column]:
    """A column function text -> struct of the base figures and the verdict."""

    @F.pandas_udf(RESULT)
    def verdicts(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            p = Page(text)
            figures, failed = p.figures, p.base_failed
            kept = not failed and not any(rule.rejects(p) for rule in ordered)
            out.append((*figures, failed, kept))
        return pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return verdicts


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct ``into``: the base figures, base_failed and kept."""
    unused(docs, into)
    ordered = order_rules(docs, rules, sample_rows, id_col, text_col)
    return docs.withColumn(into, judge(ordered)(F.col(text_col)))
