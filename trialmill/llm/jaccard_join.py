"""N-gram Jaccard join with signature trees.

The result links documents whose sets of word shingles have a Jaccard similarity of at least the
threshold, exactly, and names each document's connected component.

1. Every text becomes a sorted set of 64-bit shingle hashes. Documents with equal sets (by size and two
   sums of 64-bit hashes) form a class; only its first document goes on, so copies cost nothing.
2. Candidate groups are lossless: with shingles in one global order (those frequent in a
   sample of documents last, the most frequent at the end), two similar sets share a shingle among their
   first n - ceil(t n) + 1. Classes that share one form a group; of groups with the same members one is enough.
3. A signature tree joins each group: leaves hold a bitmap of the set and its size, inner nodes the OR of
   the bitmaps and the range of sizes. A dual traversal of the tree with itself skips pairs of nodes whose
   largest possible overlap is too small, or that are connected already. Pairs of leaves that pass
   connect their classes; connected components are the clusters. No link leaves a cluster, and
   clusters hold little else than links.
4. The sets of each cluster meet in one task, and a signature tree finds the links, set against set.
5. A cluster of over ``max_cluster`` classes or MAX_WORDS shingles is cut into blocks, by hash. Blocks are
   joined alone, then one member of each component found so far with others like it; at last every class outside
   its cluster's largest component meets the blocks of its own and the neighbouring ranges of sizes, as no other
   can hold a similar set. No pair of unconnected classes goes unseen. (A group of over ``max_group``
   classes is not joined by itself: it becomes one cluster.)

Defined cases: null or wordless texts have no shingles and link with nothing. Rows without an id get
their own n_shingles, a null component, and take no part in links. Rows that share an id are one
document with several texts. Repeated rows link with each other. An empty table gives an empty result.
Texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialmill.llm.common import bit_filter, broadcast_if_few, passing, shared_dir, store, without

#: A-Z to a-z and the separators of words to a space, in UTF-8 bytes.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_BYTE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SHINGLE = 5
PERCENT = 80
#: One document in so many is looked at for frequent shingles; more than MAX_FREQUENT are cut to the most frequent. Both bear on speed alone.
FREQUENT_SAMPLE, FREQUENT_AT, MAX_FREQUENT = 40, 3, 1 << 20
#: Classes of a group, and classes and shingles of a cluster, that one task joins.
MAX_GROUP, MAX_CLUSTER, MAX_WORDS = 2000, 256, 1 << 20
LEAF = 12
#: Classes with more documents than this, and than one in MOST_HOT of all, are joined by broadcast: MOST_HOT at most.
HOT_CLASS, MOST_HOT = 1000, 10_000
#: Graphs of up to so many edges are put together by one task.
SMALL_GRAPH = 100_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; of all its words if they are fewer."""
    data = np.frombuffer((text or "").encode("utf-8", "replace").translate(_FOLD), np.uint8)
    inside = data != 32
    letters = data[inside].astype(np.uint64)
    if not len(letters):
        return np.empty(0, np.uint64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first[inside])
    lengths = np.diff(starts, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _BYTE))
    words = _mixed(np.add.reduceat((letters + np.uint64(1)) * powers[place], starts) + lengths.astype(np.uint64))
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + len(out)]) * _WORD
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


def required(n: int, percent: int = PERCENT) -> int:
    """The least overlap that a set of n may have with a similar one."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles of a sorted set that come first in the global order: rare ones by hash, then frequent ones by rank."""
    n = len(tokens) - required(len(tokens), percent) + 1
    if len(frequent) and n < len(tokens):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        common = frequent[at] == tokens
        rare = tokens[~common]
        tokens = rare if len(rare) >= n else np.concatenate([rare, tokens[common][np.argsort(rank[at[common]])]])
    return tokens[:n]


class Groups:
    """Union-find over positions; the smallest member is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def bit_width(n: int) -> int:
    """Bits of a set's bitmap, as a power of two: at least one for each element, within bounds. Similar sets differ by one step at most."""
    return min(max((n - 1).bit_length(), 6), 16)


def bitmap(tokens: np.ndarray) -> bytes:
    """The bitmap of a set: the bit that the low bits of each hash name."""
    width = bit_width(len(tokens))
    marks = np.zeros(1 << width, np.uint8)
    marks[(tokens & np.uint64((1 << width) - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


class Node:
    """A node of the signature tree: OR of bitmaps, range of sizes, most elements beyond distinct bits."""

    __slots__ = ("bits", "children", "high", "low", "members", "slack")

    def __init__(self, bits: int, low: int, high: int, slack: int, children: Sequence[Node] = (), members: Sequence[int] = ()) -> None:
        self.bits, self.low, self.high, self.slack, self.children, self.members = bits, low, high, slack, children, members


class SignatureTree:
    """Trees over sets, by their sizes and bitmaps: one for each width of bitmaps, and one folded to the next smaller width.

    ``exact`` may say whether two sets (by position) are similar; without it, what the bitmaps cannot rule out is.
    """

    def __init__(self, sizes: Sequence[int], bitmaps: Sequence[bytes], exact: Callable[[int, int], bool] | None = None, percent: int = PERCENT) -> None:
        self.sizes, self.exact, self.percent = sizes, exact, percent
        self.bits = [int.from_bytes(b, "little") for b in bitmaps]
        self.by_width: dict[int, list[int]] = {}
        for i in sorted(range(len(sizes)), key=sizes.__getitem__):
            self.by_width.setdefault(bit_width(sizes[i]), []).append(i)

    def folded(self, chosen: Sequence[int], width: int) -> dict[int, int]:
        """Bitmaps of sets of the next larger width, halved."""
        half = 1 << width
        return {i: (self.bits[i] | self.bits[i] >> half) & ((1 << half) - 1) for i in chosen}

    def tree(self, chosen: Sequence[int], bits: dict[int, int] | list[int]) -> Node:
        """The tree over some of the sets, given in the order of sizes: LEAF sets to a leaf, LEAF children to a node."""
        nodes = []
        for at in range(0, len(chosen), LEAF):
            part = chosen[at : at + LEAF]
            union = 0
            for i in part:
                union |= bits[i]
            slack = max(self.sizes[i] - bits[i].bit_count() for i in part)
            nodes.append(Node(union, self.sizes[part[0]], self.sizes[part[-1]], slack, members=part))
        while len(nodes) > 1:
            above = []
            for at in range(0, len(nodes), LEAF):
                part, union = nodes[at : at + LEAF], 0
                for node in part:
                    union |= node.bits
                above.append(Node(union, part[0].low, part[-1].high, max(x.slack for x in part), children=part))
            nodes = above
        return nodes[0]

    def may_link(self, a: Node, b: Node) -> bool:
        """False if no set below a can be similar to one below b: the maximum possible overlap is too small."""
        p = self.percent
        if 100 * a.high < p * b.low or 100 * b.high < p * a.low:
            return False
        overlap = min((a.bits & b.bits).bit_count() + min(a.slack, b.slack), a.high, b.high)
        return (100 + p) * overlap >= p * (a.low + b.low)

    def linked(self, i: int, j: int, x: int, y: int) -> bool:
        p, both = self.percent, self.sizes[i] + self.sizes[j]
        shared = x & y
        most = min(self.sizes[i] - (x ^ shared).bit_count(), self.sizes[j] - (y ^ shared).bit_count())
        return (100 + p) * most >= p * both and (self.exact is None or self.exact(i, j))

    def join(self, groups: Groups, left: set[int] | None = None) -> None:
        """Connect all similar pairs in ``groups``; with ``left``, those of one of these sets with any."""
        for width, chosen in self.by_width.items():
            mine = chosen if left is None else [i for i in chosen if i in left]
            whole = self.tree(chosen, self.bits)
            if mine:
                self._descend(whole if left is None else self.tree(mine, self.bits), self.bits, whole, self.bits, groups)
            if larger := self.by_width.get(width + 1):
                halved = self.folded(larger, width)
                other = self.tree(larger, halved)
                if mine:
                    self._descend(whole if left is None else self.tree(mine, self.bits), self.bits, other, halved, groups)
                if left is not None and (theirs := [i for i in larger if i in left]):
                    self._descend(whole, self.bits, self.tree(theirs, halved), halved, groups)

    def _descend(self, a: Node, a_bits: object, b: Node, b_bits: object, groups: Groups) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not self.may_link(a, b):
                continue
            if a.members and b.members:
                self._compare(a, a_bits, b, b_bits, groups)
            elif a is b:
                kids = a.children
                todo.extend((kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids)))
            elif b.members or (a.children and len(a.children) >= len(b.children)):
                todo.extend((c, b) for c in a.children)
            else:
                todo.extend((a, c) for c in b.children)

    def _compare(self, a: Node, a_bits: object, b: Node, b_bits: object, groups: Groups) -> None:
        root = groups.root
        if len({root(i) for i in a.members} | {root(i) for i in b.members}) == 1:
            return
        for i in a.members:
            for j in b.members:
                if (a is not b or i < j) and i != j and root(i) != root(j) and self.linked(i, j, a_bits[i], b_bits[j]):
                    groups.join(i, j)


def _links_in(ids: Sequence[int], groups: Groups) -> list[tuple[int, int]]:
    """(id, smallest id of its group) for all but the smallest; ids ascend."""
    return [(ids[k], ids[groups.root(k)]) for k in range(len(ids)) if groups.root(k) != k]


def join_sets(
    ids: Sequence[int], sets: Sequence[np.ndarray], percent: int = PERCENT, left: Sequence[int] | None = None, known: Sequence[object] | None = None
) -> list[tuple[int, int]]:
    """Links (id, smallest id of its group) among some sets; ``known`` labels say what is connected already."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    sets, groups = [sets[i] for i in order], Groups(len(ids))
    if known is not None:
        seen: dict[object, int] = {}
        for k, i in enumerate(order):
            groups.join(seen.setdefault(known[i], k), k)
    sizes = [len(s) for s in sets]

    def exact(i: int, j: int) -> bool:
        a, b = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return (100 + percent) * int((b[at] == a).sum()) >= percent * (sizes[i] + sizes[j])

    chosen = None if left is None else {k for k, i in enumerate(order) if i in set(left)}
    SignatureTree(sizes, [bitmap(s) for s in sets], exact, percent).join(groups, chosen)
    return _links_in([ids[i] for i in order], groups)


def _components_in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    yield pd.DataFrame([(x, root(x)) for x in list(up)], columns=["node", "component"], dtype=np.int64)


def connected_components(edges: DataFrame, path: str, rounds: int = 40, small: int = SMALL_GRAPH) -> DataFrame:
    """(node, component) for all nodes of edges (u, v); the component is its smallest node.

    A graph of up to ``small`` edges, by count, is put together by one task. Otherwise this alternates two steps that turn components into stars around their smallest node: every node
    hands its larger neighbours, then its smaller ones, to the smallest it knows. Each round is written, so
    lineage stays short; it takes about the logarithm of the longest path.
    """
    now = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, state = store(now, f"{path}/round0"), None
    if now.count() <= small:
        return store(now.coalesce(1).mapInPandas(_components_in_one_task, "node long, component long"), f"{path}/small")
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        larger = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").select("u", "v", "m")
        hung = smaller.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = store(hung.distinct(), f"{path}/round{k}")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select("v", "v").toDF("node", "component").distinct())


def _sketches(docs: DataFrame, path: str, percent: int, k: int) -> DataFrame:
    """For each row: id, n, digest of the set (d1, d2), bitmap, prefix."""
    spark = docs.sparkSession

    def all_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                found = [shingles(t, k) for t in batch["text"].iloc[at : at + 256]]
                yield pd.DataFrame({"token": np.concatenate(found).view(np.int64)})

    sample = docs.filter(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(FREQUENT_SAMPLE)) == 0).select("text")
    counted = sample.mapInPandas(all_tokens, "token long").groupBy("token").count().filter(F.col("count") >= FREQUENT_AT)
    common = counted.orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).select("token").toPandas()["token"].to_numpy(np.int64)  # at most 8 MB
    by_hash = np.argsort(common.view(np.uint64))
    frequent = spark.sparkContext.broadcast((common.view(np.uint64)[by_hash], (-by_hash).astype(np.int32)))  # the most frequent have the last rank

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part, rows = batch.iloc[at : at + 1024], []
                for text in part["text"]:
                    s = shingles(text, k)
                    first = prefix(s, *frequent.value, percent).view(np.int64) if len(s) else np.empty(0, np.int64)
                    d1, d2 = (int(x.sum(dtype=np.uint64).view(np.int64)) for x in (s, _mixed(s ^ _MIX1)))
                    rows.append((len(s), d1, d2, bitmap(s) if len(s) else b"", first))
                yield pd.DataFrame(rows, columns=["n", "d1", "d2", "bits", "prefix"]).assign(id=part["id"].array)

    return store(docs.mapInPandas(sketch, "id long, n long, d1 long, d2 long, bits binary, prefix array<long>"), f"{path}/sketches")


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (d1, d2, n, ...) with the other columns of their class; ``classes`` has the number of ``rows`` of each.

    Classes that hold many of the rows are few, by the bound on their share, and are broadcast.
    """
    key = ["d1", "d2", "n"]
    total = classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    is_hot = F.col("rows") > max(HOT_CLASS, -(-total // MOST_HOT))
    hot = classes.filter(is_hot)
    if hot.isEmpty():
        return rows.join(classes.drop("rows"), key)
    names = F.broadcast(hot.drop("rows"))
    return rows.join(names, key).unionByName(rows.join(names.select(key), key, "left_anti").join(classes.filter(~is_hot).drop("rows"), key))


def _clusters(sketches: DataFrame, classes: DataFrame, path: str, percent: int, max_group: int) -> DataFrame:
    """(d1, cluster) for classes that may be linked with another."""
    linkable = sketches.filter("n > 0 AND id IS NOT NULL").select("id", "n", "d1", "d2", "bits", "prefix")
    copies = _with_class(linkable.select("id", "n", "d1", "d2"), classes).filter("id != rep").select("id", "d1", "d2", "n").distinct()
    firsts = without(linkable, store(copies, f"{path}/copies"), ["id", "d1", "d2", "n"], f"{path}/firsts")
    rows = firsts.select("d1", "n", F.explode("prefix").alias("token"))
    # Members are told apart by number, sum (as bits) and least. For the many shingles of one class the last two are one number.
    groups = rows.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor("d1").alias("sum"), F.min("d1").alias("low"))
    groups = store(groups.filter("size > 1").groupBy("size", "sum", "low").agg(F.min("token").alias("token")), f"{path}/groups")
    n = groups.count()
    if not n:
        return classes.limit(0).select("d1", F.col("d1").alias("cluster"))

    def of(tokens: DataFrame, n_tokens: int, name: str) -> DataFrame:
        """Rows whose shingle may be one of ``tokens``."""
        return passing(rows, ["token"], store(bit_filter(tokens, ["token"], n_tokens), f"{path}/{name}"))

    # Most groups are two classes that share a shingle by chance, and often their sizes alone keep them apart.
    spans = of(groups, n, "shared").groupBy("token").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    apart = (F.col("size") == 2) & (100 * F.col("least") < percent * F.col("most"))
    kept = store(groups.filter(F.col("size") <= max_group).join(spans, "token").filter(~apart).select("token"), f"{path}/kept")

    def join_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            rows = sorted({r.d1: r for r in rows}.values(), key=lambda r: r.d1)
            found = Groups(len(rows))
            SignatureTree([r.n for r in rows], [r.bits for r in rows], None, percent).join(found)
            return _links_in([r.d1 for r in rows], found)

        for group in _runs(batches, "token"):
            if found := links(group):
                yield pd.DataFrame(found, columns=["u", "v"], dtype=np.int64)

    # Narrow rows find out which classes are needed, whatever passes the filter by chance; only then do bitmaps move.
    small = of(kept, kept.count(), "small").select("token", "d1").join(kept, "token").join(firsts.select("d1", "n", "bits"), "d1").select("token", "d1", "n", "bits")
    links = small.repartition("token").sortWithinPartitions("token").mapInPandas(join_groups, "u long, v long")
    large = store(groups.filter(F.col("size") > max_group).select("token", F.col("low").alias("v")), f"{path}/large")
    n_large = large.count()
    if n_large:
        members = of(large, n_large, "pivots").select("token", F.col("d1").alias("u"))
        links = links.unionByName(members.join(broadcast_if_few(large, n_large), "token").filter("u != v").select("u", "v"))
    return connected_components(links, f"{path}/clusters").toDF("d1", "cluster")


def _runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[list[tuple]]:
    """Runs of rows with one key, from batches that are sorted by it."""
    held: list[tuple] = []
    at = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if (k := getattr(row, key)) != at:
                if held:
                    yield held
                held, at = [], k
            held.append(row)
    if held:
        yield held


def _set_of(row: tuple) -> np.ndarray:
    return np.frombuffer(row, np.uint64)


def components(
    docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, max_cluster: int = MAX_CLUSTER, max_group: int = MAX_GROUP, max_words: int = MAX_WORDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """For each row of ``docs``: id, n_shingles, component (the smallest id that links lead to)."""
    path = shared_dir(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = _sketches(narrow, path, percent, k)
    classes = store(sketches.filter("n > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), f"{path}/classes")
    members = store(classes.join(_clusters(sketches, classes, path, percent, max_group), "d1").select("rep", "d1", "d2", "n", "cluster"), f"{path}/members")
    sizes = store(members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("words")).filter("size > 1"), f"{path}/sizes")
    links = _links(narrow, members, sizes, path, percent, k, max_cluster, max_words) if not sizes.isEmpty() else None
    linkable = sketches.filter("n > 0 AND id IS NOT NULL").select("id", "n", "d1", "d2")
    same = linkable.groupBy("id").agg((F.min("d1") < F.max("d1")).alias("a"), (F.min("d2") < F.max("d2")).alias("b")).filter("a OR b").select("id")
    same = store(same, f"{path}/same_id")
    if not same.isEmpty():  # an id with several texts holds their classes together
        pairs = linkable.join(same, "id").join(classes.drop("rows"), ["d1", "d2", "n"]).select("id", "rep").distinct()
        ties = pairs.join(pairs.groupBy("id").agg(F.min("rep").alias("low")), "id").filter("rep != low").select(F.col("rep").alias("u"), F.col("low").alias("v"))
        if links is not None:
            ties = ties.unionByName(links.select(F.col("id").alias("u"), F.col("component").alias("v")))
        links = connected_components(ties, f"{path}/ids").toDF("id", "component")
    named = classes.select("d1", "d2", "n", "rep", "rows")
    if links is not None:
        named = named.join(links.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "n", "rows", F.coalesce("component", "rep").alias("component"))
    else:
        named = named.withColumnRenamed("rep", "component")
    linked = _with_class(linkable, store(named, f"{path}/named")).select("id", "n", "component")
    alone = sketches.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    out = linked.unionByName(alone).withColumnRenamed("n", "n_shingles")
    return out


def _links(narrow: DataFrame, members: DataFrame, sizes: DataFrame, path: str, percent: int, k: int, max_cluster: int, max_words: int) -> DataFrame:
    """(id, component) of class representatives that are linked to a smaller one."""
    columns = ["cluster", "id", "d1", "d2", "n", "text"]

    def texts_of(clusters: DataFrame, name: str) -> DataFrame:
        """Rows of ``columns`` of the representatives in some clusters; a bit filter keeps all other texts where they are."""
        wanted = store(members.join(clusters.select("cluster"), "cluster").withColumnRenamed("rep", "id"), f"{path}/wanted_{name}")
        n = wanted.count()
        filt = store(bit_filter(wanted, ["id"], n), f"{path}/reps_{name}")
        return passing(narrow, ["id"], filt).join(broadcast_if_few(wanted, n), "id").select(columns)

    def own_set(row: tuple) -> np.ndarray | None:
        """The set of a row, unless another row with this id gave the class its digest."""
        s = shingles(row.text, k)
        return s if len(s) == row.n and int(s.sum(dtype=np.uint64).view(np.int64)) == row.d1 else None

    def join_clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            found = {(r.id, r.d2): s for r in rows if (s := own_set(r)) is not None}
            return join_sets([i for i, _ in found], list(found.values()), percent) if len(found) > 1 else []

        for cluster in _runs(batches, "cluster"):
            if found := links(cluster):
                yield pd.DataFrame(found, columns=["id", "component"], dtype=np.int64)

    fits = (F.col("size") <= max_cluster) & (F.col("words") <= max_words)
    found = texts_of(sizes.filter(fits), "small").repartition("cluster").sortWithinPartitions("cluster").mapInPandas(join_clusters, "id long, component long")
    large = sizes.filter(~fits)
    if large.isEmpty():
        return store(found, f"{path}/links")
    found = store(found, f"{path}/links")

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                rows = [(r.cluster, r.id, len(s), s.tobytes()) for r in batch.iloc[at : at + 256].itertuples(index=False) if (s := own_set(r)) is not None]
                yield pd.DataFrame(rows, columns=["cluster", "id", "n", "tokens"])

    sets = texts_of(large, "large").mapInPandas(to_sets, "cluster long, id long, n long, tokens binary")
    sets = store(sets, f"{path}/sets")
    return found.unionByName(_large_clusters(sets, f"{path}/large", percent, max_cluster, max_words))


def _large_clusters(sets: DataFrame, path: str, percent: int, block: int, max_words: int) -> DataFrame:
    """(id, component) for clusters (cluster, id, n, tokens) that are too large for one task."""

    def join_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (unit, id, tokens, left, label), sorted by unit: left rows meet all rows of the unit."""

        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            found: dict[tuple[int, bytes], tuple[bool, object]] = {}
            for r in rows:
                key = (r.id, r.tokens)
                found[key] = (found[key][0] or r.left if key in found else r.left, r.label)
            ids = [i for i, _ in found]
            left = [at for at, (is_left, _) in enumerate(found.values()) if is_left]
            known = [label for _, label in found.values()]
            return join_sets(ids, [_set_of(t) for _, t in found], percent, None if len(left) == len(ids) else left, known)

        for unit in _runs(batches, "unit"):
            if found := links(unit):
                yield pd.DataFrame(found, columns=["u", "v"], dtype=np.int64)

    def run(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select("unit", "id", "tokens", "left", "label")
        return store(rows.repartition("unit").sortWithinPartitions("unit").mapInPandas(join_groups, "u long, v long"), f"{path}/{name}")

    def counted(rows: DataFrame, keys: Sequence[str], into: str, most: int) -> DataFrame:
        """How many blocks the rows of each key make, by number and by shingles."""
        n = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / (max_words * most // block)), F.lit(1))
        return rows.groupBy(*keys).agg(n.cast("long").alias(into))

    def dealt(rows: DataFrame, seed: int) -> DataFrame:
        """Rows in the blocks of their clusters, all of which meet all of their block."""
        placed = rows.join(counted(rows, ["cluster"], "blocks", block), "cluster")
        unit = F.concat_ws(":", "cluster", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks")))
        return placed.withColumn("unit", unit).withColumn("left", F.lit(True))

    def labelled_by(edges: DataFrame, name: str) -> DataFrame:
        labels = connected_components(edges, f"{path}/{name}").withColumnRenamed("node", "id")
        return sets.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")

    edges = run(dealt(sets.withColumn("label", F.col("id")), 1), "own")
    for turn in range(2):  # one member of each component so far, with others
        firsts = labelled_by(edges, f"turn{turn}").filter("label = id")
        edges = edges.unionByName(run(dealt(firsts, turn + 101), f"firsts{turn}"))
    # Neighbouring ranges hold all sizes that similar sets may have; they are a little wider, for rounding.
    span = F.floor(F.log("n") / float(np.log(101 / percent))).cast("long")
    labelled = labelled_by(edges, "before").withColumn("span", span)
    by_label = labelled.groupBy("cluster", "label").agg(F.count("*").alias("rows"))
    main = by_label.groupBy("cluster").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count("*").alias("labels"))
    main = store(main.filter("labels > 1").drop("labels"), f"{path}/main")
    if main.isEmpty():
        return connected_components(edges, f"{path}/after").toDF("id", "component")
    # A class outside its cluster's main component meets the blocks of the ranges next to its own; a block meets every part of the rest there.
    placed = labelled.join(main, "cluster")
    rest = placed.filter("label != main")
    parts = store(counted(rest, ["cluster", "span"], "parts", max(block // 2, 1)), f"{path}/parts")
    blocks = store(counted(placed, ["cluster", "span"], "blocks", block), f"{path}/blocks")
    near = F.explode(F.array(*[F.col("span") + d for d in (-1, 0, 1)]))
    mine = rest.join(parts, ["cluster", "span"]).withColumn("part", F.pmod(F.xxhash64(F.lit(211), "id"), F.col("parts"))).withColumn("to", near)
    mine = mine.join(blocks.withColumnRenamed("span", "to"), ["cluster", "to"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = placed.join(blocks, ["cluster", "span"]).withColumn("block", F.pmod(F.xxhash64(F.lit(223), "id"), F.col("blocks"))).withColumn("from", near)
    every = every.join(parts.withColumnRenamed("span", "from"), ["cluster", "from"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    row = ["id", "tokens", "label"]
    left = mine.select(F.concat_ws(":", "cluster", "span", "part", "to", "block").alias("unit"), *row, F.lit(True).alias("left"))
    right = every.select(F.concat_ws(":", "cluster", "from", "part", "span", "block").alias("unit"), *row, F.lit(False).alias("left"))
    edges = edges.unionByName(run(left.unionByName(right), "rest"))
    return connected_components(edges, f"{path}/after").toDF("id", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``docs`` without those that are linked to one with a smaller id; all columns stay."""
    path = shared_dir(docs.sparkSession)
    found = components(docs, id_col=id_col, text_col=text_col, **options)
    dropped = store(found.filter("component < id").select("id").distinct(), f"{path}/linked")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"))
    return without(rows, dropped, ["id"], path).select("row.*")
