"""Phrase collocation mining by HAT-trie counting.

Each task counts phrases of words (as numbers) in a HAT-trie: a shallow trie by word, whose leaves are hash containers, at first
of many first words together. A container that grows beyond BURST entries bursts into a node with containers for each next
word. When a task's tries hold more than CAPACITY entries, whole subtrees, the largest first, are spilled as sorted runs.

Runs are dealt out by prefix: a block of a run holds the phrases of one prefix partition (a hash of language and first two words).
Spark shuffles the blocks and sorts them by their first phrase, and each prefix partition is merged as a stream:
what lies before the first phrase of the next block is final. Counts under ``least`` end here.

Words and pairs are counted in a first pass. Phrases of three words are counted in a second one, and only where both their pairs may be
frequent, by a bit filter of bounded size: no phrase is more frequent than its parts, so nothing is lost. Pairs that hold more
than one in 10,000 words spread their phrases over all prefix partitions.

Scores, the drop rule and the ranks are DataFrame operations on the frequent phrases. A language's best phrases are found in salted parts first.

Defined cases: a null text is empty; a null language is `und`, as is that text. Words hold any characters but the separators,
control characters too. Repeated rows count each time. A language without candidates has no rows; an empty table gives an empty
result. Very long texts are read piece by piece. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialmill.llm.common import BROADCAST_KEYS, BUCKET_BITS, MAX_FILTER_BITS, broadcast_if_few, joined_by_key, shared_dir, store

C = F.col
LEAST, SHARE, TOP, UND = 10, 50, 2000, "und"
#: Entries of a container before it bursts, and of a task's tries before subtrees are spilled.
BURST, CAPACITY = 1 << 14, 3 << 19
#: Entries that a container lets wait, however small it is.
SETTLE = 1024
#: Bits of a word's number: so many words a task knows before it spills everything and starts anew.
WORD_BITS = 21
#: Bytes of text that are split at once, bytes of text for each prefix partition, and the most of these.
CHUNK, PART_BYTES, MAX_PARTS = 1 << 22, 1 << 22, 1 << 16
#: Phrases of a block, and those that a merge holds before it lets go what is final.
BLOCK, HELD = 1 << 15, 1 << 19
#: Phrases whose texts a task builds at once, and bytes of blocks that it sends at once.
LINES, SENT_BYTES = 1 << 17, 1 << 22
#: Pairs with more than one in so many of all words are split over prefix partitions: no more of them than this.
MOST_HOT = 10_000
SALTS = 256

# Fixed by the result contract: pieces end at these, words end at space and tab; A-Z are lower-cased.
_ENDS, _NEXT = b".,;:!?\n\x0b\x0c\r", 10
_FOLD = bytes(c + 32 if 65 <= c <= 90 else _NEXT if c in _ENDS else 32 if c == 9 else c for c in range(256))
_LOW = (1 << WORD_BITS) - 1
#: What a packed phrase is shifted by for the prefix of a container: 1024 first words together, 16, one, and first and second word.
_SHIFT = (2 * WORD_BITS + 10, 2 * WORD_BITS + 4, 2 * WORD_BITS, WORD_BITS)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Container:
    """Distinct phrases in order with their counts, and what came since, which is merged in when it is as much again."""

    def __init__(self) -> None:
        self.phrases, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def __len__(self) -> int:
        return len(self.phrases) + self.waiting

    def put(self, phrases: np.ndarray, n: np.ndarray) -> None:
        self.new.append((phrases.copy(), n.copy()))
        self.waiting += len(phrases)
        if self.waiting > max(len(self.phrases), SETTLE):
            self.settle()

    def settle(self) -> None:
        if self.new:
            self.phrases, self.n = added_up([(self.phrases, self.n), *self.new])
            self.new, self.waiting = [], 0


def added_up(runs: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases of sorted runs, in order, and their summed counts."""
    runs = [r for r in runs if len(r[0])]
    if len(runs) < 2:
        return runs[0] if runs else (np.zeros(0, np.int64),) * 2
    phrases, n = np.concatenate([p for p, _ in runs]), np.concatenate([c for _, c in runs])
    order = np.argsort(phrases)
    phrases = phrases[order]
    first = np.ones(len(phrases), bool)
    np.not_equal(phrases[1:], phrases[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    return phrases[starts], np.add.reduceat(n[order], starts)


class HatTrie:
    """Counts of phrases of up to three words, packed as their words' numbers (0: none).

    Neighbouring first words share a hash container. One that grows beyond ``burst`` entries bursts into containers of fewer first
    words, down to one, and that into containers of one second word.
    """

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.boxes, self.size = burst, {}, 0
        self.nodes: set[tuple[int, int]] = set()  # what has burst: (depth, prefix)

    def add(self, phrases: np.ndarray, n: np.ndarray) -> None:
        """Counts of distinct phrases, in order."""
        self._add(0, phrases, n)

    def _add(self, depth: int, phrases: np.ndarray, n: np.ndarray) -> None:
        if not len(phrases):
            return
        prefix = phrases >> _SHIFT[depth]
        starts = np.flatnonzero(np.diff(prefix, prepend=-1)).tolist()
        for at, s, e in zip(prefix[starts].tolist(), starts, [*starts[1:], len(phrases)], strict=True):
            place = (depth, at)
            if place in self.nodes:
                self._add(depth + 1, phrases[s:e], n[s:e])
                continue
            box = self.boxes.get(place)
            if box is None:
                box = self.boxes[place] = Container()
            self.size -= len(box)
            box.put(phrases[s:e], n[s:e])
            if len(box) > self.burst and depth + 1 < len(_SHIFT):
                box.settle()
            self.size += len(box)
            if len(box) > self.burst and depth + 1 < len(_SHIFT):
                self.nodes.add(place)
                del self.boxes[place]
                self.size -= len(box)
                self._add(depth + 1, box.phrases, box.n)

    def settle(self) -> None:
        """Merges what waits, so that ``size`` is the number of distinct phrases."""
        for box in self.boxes.values():
            box.settle()
        self.size = sum(map(len, self.boxes.values()))

    def cut(self, down_to: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes the largest subtrees out, until no more than so many entries are left: (phrases, counts)."""
        if down_to > 0:
            self.settle()
        runs = []
        for place in sorted(self.boxes, key=lambda p: len(self.boxes[p]), reverse=True):
            if self.size <= down_to:
                break
            box = self.boxes.pop(place)
            self.size -= len(box)
            runs += [(box.phrases, box.n), *box.new]
        return added_up(runs)


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _hashes(words: Sequence[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array([*words, None], object)[:-1], categorize=False)


def mixed(seed: np.uint64, *hashes: np.ndarray) -> np.ndarray:
    """One hash of a language and words, in order."""
    out = np.full(len(hashes[0]), seed, np.uint64)
    for k, h in enumerate(hashes):
        out = (out ^ h) * _K[k]
        out ^= out >> np.uint64(31)
    return out


class Numbers:
    """Words and their numbers, as a task learns them; 0 ends a piece."""

    def __init__(self) -> None:
        self.of: dict[bytes, int] = defaultdict(count().__next__)
        self.of[b"\n"]

    def read(self, texts: Sequence[bytes]) -> np.ndarray:
        """The numbers of the words of texts, each piece closed by 0."""
        text, out, start = b"\n".join([*texts, b""]), [np.zeros(0, np.int64)], 0
        while start < len(text):
            end = start + CHUNK
            while end < len(text) and _FOLD[text[end]] not in (32, _NEXT):
                end += 1
            spaced = text[start:end].translate(_FOLD).replace(b"\n", b" \n ")
            words = pc.split_pattern(pa.array([spaced], pa.large_binary()), b" ").flatten().dictionary_encode()
            of = np.array([self.of[w] if w else -1 for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int64)
            ids = of[words.indices.to_numpy()]
            out.append(ids[ids >= 0])
            start = end
        return np.concatenate(out)


def _grouped(texts: Sequence[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def distinct(ids: np.ndarray, size: int, allowed=None) -> tuple[np.ndarray, np.ndarray]:
    """(packed phrase, count) of the phrases of so many words within pieces, in order; ``allowed`` says which positions count."""
    n = len(ids) - size + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2
    inside = ids[:n] > 0
    for k in range(1, size):
        inside &= ids[k : k + n] > 0
    if allowed is not None:
        at = np.flatnonzero(inside)
        at = at[allowed(at)]
    else:
        at = np.flatnonzero(inside)
    key = ids[at]
    for k in range(1, 3):
        key = key << WORD_BITS | (ids[at + k] if k < size else 0)
    return np.unique(key, return_counts=True)


def _blocks(lang: str, words: np.ndarray, hashed: np.ndarray, run: tuple[np.ndarray, np.ndarray], parts: int, hot: np.ndarray) -> Iterator[tuple]:
    """A run, sorted, as blocks (lang, part, first phrase, phrases, counts): one prefix partition each."""
    phrases, n = run
    if not len(phrases):
        return
    first, second, third = phrases >> (2 * WORD_BITS), phrases >> WORD_BITS & _LOW, phrases & _LOW
    used = np.unique(np.concatenate([first, second, third]))
    used = used[used > 0]
    texts = words[used].tolist()
    place = np.empty(len(texts), np.int64)
    place[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(1, len(texts) + 1)
    rank = np.zeros(len(words), np.int64)
    rank[used] = place
    prefix = mixed(_seed(lang), hashed[first], np.where(second > 0, hashed[second], np.uint64(0)))
    if len(hot):
        split = (third > 0) & np.isin(prefix, hot)
        prefix[split] = mixed(_seed(lang), hashed[first[split]], hashed[second[split]], hashed[third[split]])
    part = (prefix % np.uint64(parts)).astype(np.int64)
    order = np.argsort(rank[first] << (2 * WORD_BITS) | rank[second] << WORD_BITS | rank[third])
    order = order[np.argsort(part[order].astype(np.uint16), kind="stable")]  # MAX_PARTS fit
    part, n = part[order], n[order]
    at = np.zeros(len(words), np.int64)
    at[used] = np.arange(1, len(texts) + 1)
    heads, tails = pa.array([b"", *texts], pa.large_binary()), pa.array([b"", *[b" " + t for t in texts]], pa.large_binary())
    blank, end = pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary())
    first, second, third = (at[x[order]].astype(np.int32) for x in (first, second, third))
    bounds = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    cuts = [(k, min(k + BLOCK, e)) for s, e in zip(bounds, [*bounds[1:], len(part)], strict=True) for k in range(s, e, BLOCK)]
    ends, built = np.array([last for _, last in cuts]), 0
    for k, last in cuts:
        if last > built:  # the texts of some blocks at a time
            base, built = k, int(max(last, ends[np.searchsorted(ends, k + LINES, "right") - 1]))
            lines = pc.binary_join_element_wise(heads.take(first[base:built]), tails.take(second[base:built]), tails.take(third[base:built]), end, blank)
            offsets, data = np.frombuffer(lines.buffers()[1], np.int64), lines.buffers()[2]
        start, stop = int(offsets[k - base]), int(offsets[last - base]) - 1
        some = data.slice(start, stop - start).to_pybytes()
        yield lang, int(part[k]), min(some.split(b"\n")), some, n[k:last].astype("<i8").tobytes()


def _runs(sizes: Sequence[int], parts: int, bits: np.ndarray | None, hot: np.ndarray, capacity: int, burst: int):
    """Counts phrases of the given numbers of words in (lang, text) and gives blocks of sorted runs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, tries, seen = Numbers(), defaultdict(lambda: HatTrie(burst)), defaultdict(int)
        hashes = np.zeros(0, np.uint64)

        def known() -> np.ndarray:
            nonlocal hashes
            if len(hashes) < len(numbers.of):
                hashes = np.concatenate([hashes, _hashes(list(islice(numbers.of, len(hashes), None)))])
            return hashes

        def spilled(down_to: int) -> Iterator[pa.RecordBatch]:
            words = np.array([*numbers.of, None], object)[:-1]
            share = down_to / max(1, sum(t.size for t in tries.values()))
            for lang in list(tries):
                yield from _sent(_blocks(lang, words, known(), tries[lang].cut(int(tries[lang].size * share)), parts, hot))

        for batch in batches:
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                for some in _grouped(texts):
                    ids = numbers.read(some)
                    seen[lang] += int((ids > 0).sum())
                    allowed = None
                    if bits is not None:
                        h = known()[ids]
                        slot = mixed(_seed(lang), h[:-1], h[1:]) % np.uint64(len(bits) * 8) if len(ids) > 1 else np.zeros(0, np.uint64)
                        may = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                        allowed = lambda at, may=may: may[at] & may[at + 1]
                    for size in sizes:
                        tries[lang].add(*distinct(ids, size, allowed))
                    if len(numbers.of) > _LOW // 2:
                        yield from spilled(0)
                        numbers, hashes = Numbers(), np.zeros(0, np.uint64)
                        tries.clear()
                    elif sum(t.size for t in tries.values()) > capacity:
                        yield from spilled(capacity // 2)
        yield from spilled(0)
        yield from _sent([(lang, 0, b"", b"", np.array([n], "<i8").tobytes()) for lang, n in seen.items()])  # the number of words, as a block without phrases

    return each


def _sent(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], ["lang", "part", "first", "phrases", "counts"])
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[3]) + len(row[4])
        if size >= SENT_BYTES:
            yield batch(some)
            some, size = [], 0
    if some:
        yield batch(some)


def _summed(phrases: list[bytes], n: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Sorted distinct phrases and their counts. Python's sort merges the runs that it finds."""
    order = sorted(range(len(phrases)), key=phrases.__getitem__)
    ranked = np.array([phrases[k] for k in order] + [None], object)[:-1]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[starts].tolist(), np.add.reduceat(n[order], starts)


def _merge(least: int, held: int):
    """Merges blocks that come in order of (lang, part, first phrase): frequent phrases, and the number of words as a row without a phrase."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, phrases, n = None, [], []

        def final(before: bytes | None) -> pa.RecordBatch:
            nonlocal phrases, n
            done, many = _summed(phrases, np.concatenate(n))
            cut = len(done) if before is None else bisect_left(done, before)
            phrases, n = done[cut:], [many[cut:]]
            done, many = done[:cut], many[:cut]
            keep = np.flatnonzero(many >= least)
            rows = [done[k] for k in keep.tolist()]
            spaces = np.array([p.count(b" ") for p in rows], np.int64)
            hashes = np.zeros(len(rows), np.int64)
            pairs = np.flatnonzero(spaces == 1)
            if len(pairs):
                sides = [rows[k].split(b" ") for k in pairs.tolist()]
                hashes[pairs] = mixed(_seed(key[0]), _hashes([s[0] for s in sides]), _hashes([s[1] for s in sides])).view(np.int64)
            return found([key[0]] * len(rows), [r.decode() for r in rows], spaces + 1, many[keep], hashes)

        def found(langs: list[str], some: list[str | None], sizes, many, hashes) -> pa.RecordBatch:
            columns = [pa.array(langs, pa.string()), pa.array(some, pa.string()), pa.array(sizes, pa.int32()), pa.array(many, pa.int64()), pa.array(hashes, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "a", "hash"])

        for batch in batches:
            for lang, part, first, some, many in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not some:
                    yield found([lang], [None], [0], np.frombuffer(many, "<i8"), [0])
                    continue
                if (lang, part) != key:
                    if phrases:
                        yield final(None)
                    key, phrases, n = (lang, part), [], []
                elif len(phrases) > held:
                    yield final(first)
                phrases += some.split(b"\n")
                n.append(np.frombuffer(many, "<i8"))
        if phrases:
            yield final(None)

    return each


def count_phrases(
    texts: DataFrame, sizes: Sequence[int], parts: int, least: int, path: str, bits: np.ndarray | None = None, hot: np.ndarray | None = None, capacity: int = CAPACITY, burst: int = BURST, held: int = HELD
) -> DataFrame:
    """Stored (lang, phrase, words, a, hash) of phrases with ``least`` occurrences in (lang, text), and rows without a phrase that sum up to the number of words."""
    runs = texts.mapInArrow(_runs(sizes, parts, bits, np.zeros(0, np.uint64) if hot is None else hot, capacity, burst), "lang string, part int, first binary, phrases binary, counts binary")
    dealt = runs.repartition("lang", "part").sortWithinPartitions("lang", "part", "first")
    return store(dealt.mapInArrow(_merge(least, held), "lang string, phrase string, words int, a long, hash long"), path)


def _pair_bits(pairs: DataFrame, n: int) -> np.ndarray:
    """A bit filter of the hashes of pairs, of MAX_FILTER_BITS at most."""
    bits = BUCKET_BITS
    while bits < min(MAX_FILTER_BITS, n * 64):
        bits *= 2
    slot = C("hash").bitwiseAND(F.lit(bits - 1))  # bits is a power of two: the same as the remainder of the unsigned hash
    maps = pairs.select(slot.alias("slot")).groupBy(F.floor(C("slot") / BUCKET_BITS).alias("bucket")).agg(F.bitmap_construct_agg(C("slot") % BUCKET_BITS).alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():  # 8 MB at most
        out[r["bucket"] * (BUCKET_BITS // 8) : (r["bucket"] + 1) * (BUCKET_BITS // 8)] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    return out


def _with_count(cuts: DataFrame, known: DataFrame, few: bool, side: str, into: str, path: str) -> DataFrame:
    """``cuts`` with the number of occurrences of (lang, side). A word may be part of very many phrases."""
    counts = known.select("lang", C("phrase").alias(side), C("a").alias(into))
    if few:
        return cuts.join(F.broadcast(counts), ["lang", side])
    keys = cuts.groupBy("lang", side).agg(F.count("*").alias("__n")).join(counts, ["lang", side])
    keys = store(keys.select(F.struct("lang", side).alias("__pair"), into, "__n"), path)
    return joined_by_key(cuts.withColumn("__pair", F.struct("lang", side)), keys, "__pair", "__n").drop("__pair").filter(C(into).isNotNull())


def mine(
    docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text", capacity: int = CAPACITY, burst: int = BURST, held: int = HELD
) -> DataFrame:
    """Each language's best phrases of two and three words: lang, rank, phrase, a, l, r, n, score.

    A candidate has ``least`` occurrences. One that lies inside a longer candidate with ``share`` percent of its occurrences is dropped.
    """
    path = shared_dir(docs.sparkSession)
    texts = docs.select(F.coalesce(C(lang_col).cast("string"), F.lit(UND)).alias("lang"), C(text_col).cast("string").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(1, -(-size // PART_BYTES)), MAX_PARTS)
    limits = {"capacity": capacity, "burst": burst, "held": held}
    short = count_phrases(texts, (1, 2), parts, least, f"{path}/short", **limits)
    totals = store(short.filter("phrase IS NULL").groupBy("lang").agg(F.sum("a").alias("n")), f"{path}/totals")
    pairs = short.filter("words = 2")
    seen = short.agg(F.count_if(C("words") == 2).alias("pairs"), F.count("phrase").alias("known")).first()
    words = totals.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in pairs.filter(C("a") > max(words // MOST_HOT, 1000)).select("hash").collect()]  # MOST_HOT at most
    bits = _pair_bits(pairs, seen["pairs"])
    long = count_phrases(texts, (3,), parts, least, f"{path}/long", bits, np.array(hot, np.int64).view(np.uint64), **limits).filter("phrase IS NOT NULL")
    known = short.filter("phrase IS NOT NULL").select("lang", "phrase", "words", "a")

    candidates = known.filter("words = 2").unionByName(long.select("lang", "phrase", "words", "a"))
    word = F.split("phrase", " ")
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice(word, 1, k), " ").alias("left"), F.array_join(F.slice(word, k + 1, 3), " ").alias("right"))
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.when(C("words") == 2, F.array(cut(1))).otherwise(F.array(cut(1), cut(2)))).alias("c")).select("lang", "phrase", "words", "a", "c.*")
    few = seen["known"] <= BROADCAST_KEYS
    for side, into in (("left", "l"), ("right", "r")):
        cuts = _with_count(cuts, known, few, side, into, f"{path}/{side}")
    number = lambda c, digits: C(c).cast(f"decimal({digits},0)")
    scored = cuts.withColumn("above", number("a", 14) * number("a", 14) * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", number("l", 18) * number("r", 18)).withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r")).alias("m")).select("lang", "phrase", "m.*")

    inner = long.select("lang", F.explode(F.array(*[F.array_join(F.slice(word, k, 2), " ") for k in (1, 2)])).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    free = lowest.join(inner, ["lang", "phrase"], "left").filter(C("outer").isNull() | (100 * C("outer") < share * C("a")))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    salted = free.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(C("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(C("rank") <= top)
    return ranked.join(broadcast_if_few(totals, totals.count()), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
