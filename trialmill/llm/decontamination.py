"""Benchmark decontamination: an FM-index of every training shard is searched for the windows of test items.

Documents go into shards of at most SHARD_WORDS words (a task indexes one after the other, so memory does not grow with
the data). A shard is a sequence of word numbers, every document closed by a mark of its own. Its index:

* the suffix array, by doubling of compared lengths; only suffixes that still tie are compared again;
* the Burrows-Wheeler transform in a wavelet tree (as a matrix: one bit vector a level, with ranks by 64-bit words);
* the positions of every SAMPLE-th suffix and of every document's start.

Test items are cut into windows of ``window`` words (an item of fewer is one window). All windows are searched backwards at
once: a step narrows each range of suffixes by two ranks in the wavelet tree, and windows whose range is empty
drop out. Positions in the remaining ranges follow the transform back to a sampled suffix. Occurrences are merged to removal spans.

Windows are sent to tasks in blocks of about BLOCK_WORDS words; a larger benchmark takes one pass over the documents a block,
and the spans of all passes are merged by document.

Defined cases: a null text has no words; a null or wordless item has no windows. Windows never cross documents. Rows that share a doc_id
are told apart. Items that share an id are one item; the id is a text, `null` if there is none. A document of over SHARD_WORDS
words is cut into pieces that overlap by a window less one word. Repeated items and empty tables are no special case. Columns
of any other name are not read, or (in ``remove``) go through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialmill.llm.common import shared_dir, store, unused

#: Words of documents and items once A-Z are lower-cased. Fixed by the result contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHARD_WORDS, SAMPLE, BLOCK_WORDS = 10, 1 << 20, 16, 1 << 20
#: Words of an item that stay together: longer ones are cut, with an overlap, before they reach the driver.
ITEM_WORDS = 1 << 16
#: Occurrences that are followed back at once.
FOLLOWED = 1 << 20

_UPPER = range(65, 91)
_FOLD = bytes(c + 32 if c in _UPPER else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_CUT = 1 << 24  # bytes of a text that are split into words at once

SPANS = "array<struct<start:int,end:int>>"


class Bits:
    """A bit vector that tells how many ones stand before a position."""

    def __init__(self, bits: np.ndarray) -> None:
        packed, some = np.zeros((len(bits) // 64 + 1) * 8, np.uint8), np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet tree over symbols, as a matrix: at each level zeros go before ones."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, (n_symbols - 1).bit_length()))):
            ones = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(ones), int(len(ones) - np.count_nonzero(ones))))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        every = np.arange(n_symbols)
        self.base = self._down(every, np.zeros(n_symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, at) - self.base[symbol]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.base[symbol]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of numbers in order. The end of the sequence must be a number that is there once."""
    n, bits = len(s), max(1, int(s.max()).bit_length())
    width = max(1, min(4, 62 // bits))
    padded = np.concatenate([s, np.zeros(width, np.int64)])
    key = padded[:n].copy()
    for k in range(1, width):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    places, key = np.arange(n), key[order]  # places in the order that are open, and what was compared there
    compared = width
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        rank[order[places]] = places[starts][group]
        ties = np.diff(np.append(starts, len(key)))[group] > 1
        places = places[ties]
        if not len(places):
            return order
        some = order[places]
        key = rank[some] * n + rank[some + compared]
        by = np.argsort(key)
        order[places], key = some[by], key[by]
        compared *= 2


class FMIndex:
    """An index of documents, given as arrays of word numbers below n_words."""

    def __init__(self, docs: Sequence[np.ndarray], n_words: int) -> None:
        sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        n, marks = int((sizes + 1).sum()), len(docs)
        s = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.starts + sizes] = False
        s[inside] = np.concatenate(docs) + marks
        s[~inside] = np.arange(marks)
        order = suffix_array(s)
        symbols = np.maximum(s - (marks - 1), 0)  # 0 is any mark, words start at 1
        self.wavelet = Wavelet(symbols[order - 1], n_words + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_words + 1))])
        sampled = np.zeros(n, bool)
        sampled[::SAMPLE] = True
        sampled[self.starts] = True
        self.marked = Bits(sampled[order])
        self.sample = order[sampled[order]]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (rows of word numbers, set right) that occur, with their ranges of suffixes."""
        which, width = np.arange(len(windows)), windows.shape[1]
        symbol = windows[:, -1] + 1 if len(windows) else np.empty(0, np.int64)
        low, high = self.before[symbol], self.before[symbol + 1]
        for k in range(2, width + 1):
            live = low < high
            which, low, high = which[live], low[live], high[live]
            more = lengths[which] >= k
            symbol = windows[which[more], width - k] + 1
            low[more] = self.before[symbol] + self.wavelet.rank(symbol, low[more])
            high[more] = self.before[symbol] + self.wavelet.rank(symbol, high[more])
        live = low < high
        return which[live], low[live], high[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions in the sequence of the suffixes in the given rows."""
        found, steps, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            done = self.marked.get(rows)
            found[open_[done]] = self.sample[self.marked.rank(rows[done])] + steps
            open_, rows = open_[~done], rows[~done]
            symbol, before = self.wavelet.read(rows)
            rows, steps = self.before[symbol] + before, steps + 1
        return found


class Patterns:
    """Distinct windows of items as rows of word numbers (set right), with the items of each."""

    def __init__(self, items: Sequence[tuple[str, Sequence[str]]], window: int) -> None:
        numbers: dict[str, int] = {}
        seen: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, words in items:
            ids = [numbers.setdefault(w, len(numbers)) for w in words]
            for k in range(max(len(ids) - window, 0) + 1 if ids else 0):
                seen[tuple(ids[k : k + window])].add(item)
        self.words = [w.encode() for w in numbers]
        self.lengths = np.array([len(w) for w in seen], np.int64)
        self.windows = np.zeros((len(seen), window), np.int64)
        for row, w in enumerate(seen):
            self.windows[row, window - len(w) :] = w
        self.used = np.arange(window)[None, :] >= window - self.lengths[:, None]
        self.items = [sorted(x) for x in seen.values()]


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    start = 0
    while start < len(text):
        end = start + _CUT
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        yield text[start:end].translate(_FOLD).split()
        start = end


def _pieces(texts: Sequence[bytes | None], overlap: int, most: int) -> Iterator[tuple[list[tuple[int, int]], list[np.ndarray], dict, list[tuple[int, int]]]]:
    """Shards of a batch: (row, first word) of each piece, its word numbers, the numbers by word, and (row, words) of rows that ended."""
    fresh = lambda: defaultdict(count().__next__)
    at, docs, numbers, ended, n = [], [], fresh(), [], 0
    for row, text in enumerate(texts):
        first, tail = 0, []
        for words in words_of(text or b""):
            words = tail + words
            while True:
                room = max(most - n, overlap + 1)
                part = words[:room]
                if len(part) > len(tail) or not first:
                    at.append((row, first))
                    docs.append(np.fromiter(map(numbers.__getitem__, part), np.int64, len(part)))
                    n += len(part)
                    tail = part[-overlap:] if overlap else []
                    first += len(part) - len(tail)
                words = tail + words[room:]
                if n < most:
                    break
                yield at, docs, numbers, ended
                at, docs, numbers, ended, n = [], [], fresh(), [], 0
                if len(words) <= len(tail):
                    break
        ended.append((row, first + len(tail)))
    if at or ended:
        yield at, docs, numbers, ended


def search_shard(docs: Sequence[np.ndarray], numbers: dict, patterns: Patterns, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of merged spans and distinct (piece, window) of a shard."""
    known = np.array([numbers.get(w, -1) for w in patterns.words], np.int64)
    ids = known[patterns.windows]
    possible = np.flatnonzero(((ids >= 0) | ~patterns.used).all(1))
    none = np.empty(0, np.int64)
    if not len(possible):
        return none, none, none, none, none
    index = FMIndex(docs, len(numbers))
    which, low, high = index.search(np.maximum(ids[possible], 0), patterns.lengths[possible])
    which = possible[which]
    many = high - low
    delta, pairs = np.zeros(int(index.starts[-1] + sizes[-1]) + 2, np.int64), []
    ends = np.cumsum(many)
    for start in range(0, int(ends[-1]) if len(ends) else 0, FOLLOWED):
        k = np.arange(start, min(start + FOLLOWED, int(ends[-1])))
        of = np.searchsorted(ends, k, "right")
        at = index.locate(high[of] - (ends[of] - k))
        delta += np.bincount(at, minlength=len(delta)) - np.bincount(at + patterns.lengths[which[of]], minlength=len(delta))
        piece = np.searchsorted(index.starts, at, "right") - 1
        pairs.append(np.unique(piece * len(patterns.lengths) + which[of]))
    inside = np.cumsum(delta) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    piece = np.searchsorted(index.starts, first, "right") - 1
    both = np.unique(np.concatenate(pairs)) if pairs else none
    return piece, first - index.starts[piece], last - index.starts[piece], both // max(len(patterns.lengths), 1), both % max(len(patterns.lengths), 1)


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scan(patterns: Patterns, window: int, most: int, only_hits: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            items: dict[int, set[str]] = defaultdict(set)
            n_words = np.zeros(batch.num_rows, np.int64)
            for at, docs, numbers, ended in _pieces(batch.column(1).to_pylist(), window - 1, most):
                for row, n in ended:
                    n_words[row] = n
                if not docs:
                    continue
                piece, start, end, hit, which = search_shard(docs, numbers, patterns, np.array([len(d) for d in docs]))
                for p, s, e in zip(piece.tolist(), start.tolist(), end.tolist(), strict=True):
                    spans[at[p][0]].append((at[p][1] + s, at[p][1] + e))
                for p, w in zip(hit.tolist(), which.tolist(), strict=True):
                    items[at[p][0]].update(patterns.items[w])
            rows = sorted(spans) if only_hits else range(batch.num_rows)
            found = [[{"start": s, "end": e} for s, e in merged(spans[r])] if r in spans else [] for r in rows]
            columns = [batch.column(0), pa.array(n_words)]
            if only_hits:
                columns = [c.take(pa.array(rows, pa.int64())) for c in columns]
            lists = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array([sorted(items[r]) if r in items else [] for r in rows], pa.list_(pa.string()))], ["row", "n_words", "spans", "items"])

    return each


def item_pieces(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words) of a benchmark; long items in pieces that hold each of their windows once."""
    upper, lower = "".join(map(chr, _UPPER)), "".join(chr(c + 32) for c in _UPPER)
    words = F.regexp_extract_all(F.translate(F.col(text_col), upper, lower), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(ITEM_WORDS))
    cut = items.select("item", "words", F.explode(starts).alias("from"))
    return cut.select("item", F.slice("words", F.col("from") + 1, F.lit(ITEM_WORDS + window - 1)).alias("words")).distinct()


def find(
    rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(row, n_words, spans, items) for rows (row, text): ``row`` is any column. Spans are of word positions, merged, without their ends."""
    spark = rows.sparkSession
    path = shared_dir(spark)
    pieces = store(item_pieces(benchmark, window, item_col, item_text), f"{path}/items")
    blocks = -(-(pieces.agg(F.sum(F.size("words"))).first()[0] or 1) // block_words)
    block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    patterns = lambda b: Patterns([tuple(r) for r in pieces.filter(block == b).collect()], window)
    schema = lambda kind: f"row {kind}, n_words long, spans {SPANS}, items array<string>"
    texts = rows.select("row", F.col("text").cast("binary").alias("text"))
    if blocks == 1:
        return texts.mapInArrow(_scan(patterns(0), window, shard_words, False), schema(rows.schema["row"].dataType.simpleString()))
    keyed = store(texts.withColumn("key", F.monotonically_increasing_id()), f"{path}/texts")
    hits = [store(keyed.select("key", "text").mapInArrow(_scan(patterns(b), window, shard_words, True), schema("long")), f"{path}/hits{b}") for b in range(1, blocks)]
    every = store(keyed.select("key", "text").mapInArrow(_scan(patterns(0), window, shard_words, False), schema("long")), f"{path}/hits0")
    for more in hits:
        every = every.unionByName(more)
    one = every.groupBy(F.col("row").alias("key")).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return keyed.select("key", "row").join(one, "key").select("row", "n_words", _merged("spans").alias("spans"), "items")


def _merged(spans: str) -> Column:
    """Sorted spans without overlaps, as ``merged`` gives them."""
    last = lambda out: F.element_at(out, -1)

    def add(out: Column, span: Column) -> Column:
        longer = F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], span["end"]).alias("end"))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))
        touches = (F.size(out) > 0) & (span["start"] <= F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(-1)))
        return F.when(touches, joined).otherwise(F.concat(out, F.array(span)))

    return F.aggregate(F.col(spans), F.array().cast(SPANS), add)


def n_hit(spans: Column) -> Column:
    """Words in spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def places(text: Column, spans: Column) -> Column:
    """Spans of word positions as spans of code points, from the first letter of their first word to the last one of their last."""
    # capitals are letters of words, too, before they are lower-cased
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    @F.pandas_udf(SPANS)
    def each(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str | None, s: list | None) -> list[dict]:
            if t is None or s is None or not len(s):
                return []
            at = [m.span() for m in pattern.finditer(t)]
            return [{"start": at[x["start"]][0], "end": at[x["end"] - 1][1]} for x in s]

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return each(text, spans)


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", into: str = "contamination", **options) -> DataFrame:
    """``docs`` with all their columns, the spans of ``text_col`` that benchmark windows cover cut out, and a struct ``into`` (n_words, n_hit, spans of code points in the old text, items)."""
    unused(docs, into)
    found = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text")), benchmark, **options)
    text = F.col("row")[text_col]
    placed = found.withColumn("places", F.when(F.size("spans") > 0, places(text, F.col("spans"))).otherwise(F.array().cast(SPANS)))
    ends = F.concat(F.array(F.lit(0)), F.transform("places", lambda p: p["end"]))
    starts = F.concat(F.transform("places", lambda p: p["start"]), F.array(F.char_length(text)))
    left = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a)), "")
    cut = F.when(F.size("places") > 0, left).otherwise(text)
    columns = [cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return placed.select(*columns, F.struct("n_words", n_hit(F.col("spans")).alias("n_hit"), F.col("places").alias("spans"), "items").alias(into))
