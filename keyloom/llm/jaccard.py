"""N-gram Jaccard join with signature trees.

Documents are sets of hashed five-word shingles; two link at a Jaccard similarity of 75 % or more.
Equal sets are one class.  Routing brings every pair that could link into one group; in a group a
signature tree (nodes: OR of token bitmaps, size range, component) is traversed against itself, node
pairs are pruned by the largest overlap they allow, and what reaches the leaves is verified on whole
sets.  The result is exact: routing by prefixes and the certificate below lose no pair.

1.  Prefixes.  Of n tokens in hash order, any partner shares all but n - ceil(0.75 n); so the first
    n - ceil(0.75 n) + l(n) tokens of both hold at least l(ceil(0.75 n)) common ones.  Documents that
    share fewer prefix tokens with other sets link with nothing (most of a corpus ends here).
2.  First round: groups by the smallest shared prefix tokens find most links.
3.  Certificate: a link between two components needs ceil(0.75 n) tokens of both documents that occur
    in other components.  Documents with fewer are done.
4.  Second round: of the open documents' c such tokens, ordered by frequency, a pair shares one of the
    first c - ceil(0.75 n) + 1 of each.  In groups by these, trees over bitmaps alone find which
    documents might link; connected ones form clusters, and in a cluster whole sets are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import components, grouped, materialize, materialize_bucketed, partitions, scratch, sliced, spread_join

NUM, DEN = 75, 100
K = 5
FIRST_KEYS = 2
#: Tokens of a block: groups of more are dealt as pairs of blocks.
BLOCK = 1 << 20
#: The same for groups of bitmaps alone, in rows.
ROWS = 4096
FAN = 16
#: Routing looks at a token's high 48 bits: tokens that agree there only seem shared, which loses no pair.
ROUTING = np.uint64(0xFFFF_FFFF_FFFF_0000)

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of the whole sequence if it is shorter; none without words.

    ``bytes.lower`` lowers A-Z alone and ``bytes.split`` splits at space and U+0009 to U+000D alone.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(K, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for j in range(k):
        h = (h ^ (h >> np.uint64(31))) * _M1 + w[j : j + len(h)]
    h = (h ^ (h >> np.uint64(33))) * _M2
    h = np.sort(h ^ (h >> np.uint64(29)))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def need(n: int) -> int:
    """ceil(0.75 n)."""
    return -(-NUM * n // DEN)


def slack(n: int) -> int:
    """l(n), the common prefix tokens that a prefix is long enough for."""
    return 1 + n // 10


_SHORT = f"1 + floor(ceil({NUM} * n / {DEN}.0) / 10)"


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sizes, ones, twos, prefixes = [], [], [], []
        for text in batch.column("text"):
            s = shingles(text.as_py())
            d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            sizes.append(len(s))
            ones.append(int.from_bytes(d[:8], "little", signed=True))
            twos.append(int.from_bytes(d[8:], "little", signed=True))
            prefixes.append(s[: len(s) - need(len(s)) + slack(len(s))] & ROUTING if len(s) else s)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), _lists(prefixes)], names=["doc_id", "n", "d1", "d2", "prefix"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [shingles(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), batch.column("keys"), _lists(sets)], names=["doc_id", "n", "keys", "tokens"])


def width_of(n: int) -> int:
    """Bits of the bitmap of n tokens: a power of two, twice n or more up to 2**16."""
    return min(1 << 16, max(256, 1 << (2 * n - 1).bit_length()))


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    """Packed bits, one set for each token's low bits.  Its halves ORed are the bitmap of half the width."""
    flags = np.zeros(width, bool)
    flags[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags).view(np.uint64)


class SignatureTree:
    """Leaves are documents in the given order; each node above joins ``FAN`` neighbours."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, part: np.ndarray) -> None:
        """``bits``: a bitmap a row; ``part``: a number a row; rows of one part need not be compared."""
        self.levels = [(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), part)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra, part = self.levels[-1]
            starts = np.arange(0, len(bits), FAN)
            same = np.minimum.reduceat(part, starts) == np.maximum.reduceat(part, starts)
            same &= np.minimum.reduceat(part, starts) >= 0
            self.levels.append((np.bitwise_or.reduceat(bits, starts, axis=0), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(extra, starts), np.where(same, part[starts], -1)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs can hold a link: not of one part, sizes within range, overlap large enough.

        Common tokens set common bits; those that share a bit are no more than either side's ``extra``
        (tokens beyond distinct bits of its worst document).
        """
        bits, low, high, extra, part = self.levels[level]
        most, least = np.minimum(high[a], high[b]), np.maximum(low[a], low[b])
        ok = ((part[a] != part[b]) | (part[a] < 0)) & (DEN * most >= NUM * least)
        at = np.flatnonzero(ok)
        common = np.bitwise_count(bits[a[at]] & bits[b[at]]).sum(axis=1, dtype=np.int64) + np.minimum(extra[a[at]], extra[b[at]])
        ok[at] = (DEN + NUM) * np.minimum(common, most[at]) >= NUM * (low[a[at]] + low[b[at]])
        return ok

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal: leaf pairs (i < j) that may link, some thousands at a time."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 2048:
                stack += [(level, a[2048:], b[2048:]), (level, a[:2048], b[:2048])]
                continue
            keep = self._possible(level, a, b) if level else self._possible(0, a, b) & (a != b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if not level:
                yield a, b
                continue
            below = len(self.levels[level - 1][0])
            step = np.arange(FAN)
            i = (a[:, None, None] * FAN + step[:, None] + 0 * step).ravel()
            j = (b[:, None, None] * FAN + step + 0 * step[:, None]).ravel()
            fits = (i < below) & (j < below) & ((i <= j) if level > 1 else (i < j))
            stack.append((level - 1, i[fits], j[fits]))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if DEN * min(len(x), len(y)) < NUM * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def tree_links(sets: list[np.ndarray], label: np.ndarray, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning set of links among ``sets`` that joins all components links join; equal labels are joined already.

    With ``block``, pairs within a block are left to another call.
    """
    n = len(sets)
    root = list(range(n))
    first: dict[int, int] = {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(label.tolist()):
        root[i] = first.setdefault(x, i)
    links: list[tuple[int, int]] = []

    def test(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b and (block is None or block[i] != block[j]) and similar(sets[i], sets[j]):
            root[max(a, b)] = min(a, b)
            links.append((i, j))

    order = sorted(range(n), key=lambda i: (len(sets[i]), sets[i][0], i))
    for i, j in zip(order, order[1:], strict=False):
        test(i, j)
    if n > 2:
        for j in order[1:]:
            test(order[0], j)
        part = np.array([find(i) for i in range(n)])
        if (part != part[0]).any():
            by = np.lexsort((np.array([len(s) for s in sets]), part))
            sizes = np.array([len(sets[i]) for i in by])
            width = width_of(int(sizes.max()))
            tree = SignatureTree(np.array([bitmap(sets[i], width) for i in by]), sizes, part[by])
            for a, b in tree.pairs():
                for i, j in zip(by[a].tolist(), by[b].tolist(), strict=True):
                    test(i, j)
    return links


def _join(group: pa.Table) -> Iterator[pa.RecordBatch]:
    if group.num_rows < 2:
        return
    group = group.combine_chunks()
    ids, label, block = (group.column(c).to_numpy() for c in ("doc_id", "label", "block"))
    tokens = group.column("tokens").combine_chunks()
    flat, offsets = tokens.flatten().to_numpy().view(np.uint64), tokens.offsets.to_numpy()
    offsets = offsets - offsets[0]
    sets = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
    links = tree_links(sets, label, block if (block != block[0]).any() else None)
    if links:
        i, j = np.array(links).T
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["u", "v"])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [np.array(x.values, np.int64).view(np.uint64) for x in batch.column("tokens")]
        bits = [bitmap(s, width_of(len(s))).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("label"), pa.array(bits, pa.binary())], names=["doc_id", "n", "label", "bits"])


def _meet(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs of different components that a group's bitmaps allow to link.

    A link's sizes differ by a third at most, so its bitmaps' widths are equal or one is twice the
    other: each width meets itself and the next, halved.
    """
    if group.num_rows < 2:
        return
    ids, n, label, block = (group.column(c).to_numpy() for c in ("doc_id", "n", "label", "block"))
    bits = [np.frombuffer(x, np.uint64) for x in group.column("bits").to_pylist()]
    words = np.array([len(x) for x in bits])
    part = np.unique(label, return_inverse=True)[1]
    across = (block != block[0]).any()
    root = np.arange(len(ids))
    for k in np.unique(words).tolist():
        own = np.flatnonzero((words == k) | (words == 2 * k))
        own = own[np.lexsort((n[own], part[own]))]
        rows = np.array([bits[i] if len(bits[i]) == k else bits[i][:k] | bits[i][k:] for i in own])
        for a, b in SignatureTree(rows, n[own], part[own]).pairs():
            a, b = own[a], own[b]
            keep = (words[a] == k) | (words[b] == k)
            if across:
                keep &= block[a] != block[b]
            for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                while root[j] != j:
                    root[j] = j = root[root[j]]
                root[max(i, j)] = min(i, j)
    other = np.flatnonzero(root != np.arange(len(ids)))
    if len(other):
        yield pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[root[other]])], names=["u", "v"])


def _dealt(keyed: DataFrame, weight: Column, most: int, whole: bool) -> DataFrame:
    """``keyed(doc_id, key)`` as (doc_id, task, block): groups of a total weight over ``most`` in pairs of blocks.

    All pairs of them if ``whole``, else each block with block 0 (the certificate finds what that leaves).
    """
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(weight).alias("size")).filter("c > 1").select("key", "c", F.ceil(F.col("size") / most).cast("int").alias("blocks"))
    keyed = spread_join(keyed, sizes, ["key"], keyed.count()).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    keyed = keyed.withColumn("k", F.explode(every if whole else F.when(F.col("block") == 0, every).otherwise(F.array(F.lit(0), F.col("block")))))
    return keyed.withColumn("task", F.xxhash64("key", F.least("block", "k"), F.greatest("block", "k"))).select("doc_id", "task", "block").distinct()


def _round(sets: DataFrame, whole: bool) -> DataFrame:
    """Links among ``sets(doc_id, n, label, keys, tokens)`` that share a key."""
    dealt = _dealt(sets.select("doc_id", "n", F.explode("keys").alias("key")), F.col("n"), BLOCK, whole)
    dealt = dealt.join(sets.select("doc_id", "label", "tokens"), "doc_id").repartition(partitions(sets.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(grouped("task", _join), "u long, v long")


def _clusters(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, keys) of documents that some other may link to: the smallest doc_id of its cluster, as the only key.

    Only bitmaps are dealt to the groups of ``keys(doc_id, keys)``; whole sets meet once, in clusters.
    """
    signed = sets.mapInArrow(_sign, "doc_id long, n long, label long, bits binary")
    dealt = _dealt(keys.select("doc_id", F.explode("keys").alias("key")), F.lit(1), ROWS, whole=True)
    dealt = dealt.join(signed, "doc_id").repartition(partitions(sets.sparkSession), "task").sortWithinPartitions("task")
    reached = components(materialize(dealt.mapInArrow(grouped("task", _meet), "u long, v long"), "candidates"))
    return reached.select(F.col("id").alias("doc_id"), F.array("component").alias("keys"))


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n) of all documents, (id, component) of those in components of several); two narrow tables."""
    with scratch(docs.sparkSession):
        sketch, reached = _classes_of(docs)
        return materialize(sketch.select("doc_id", "n"), "sizes", keep=True), materialize(reached, "reached", keep=True)


def _classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    sketch = materialize(docs.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, n long, d1 long, d2 long, prefix array<long>"), "sketch")
    own = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    copies = own.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c"))
    tokens = own.select("doc_id", F.explode("prefix").alias("token"))
    shared = own.select("d1", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).filter("a <> b").select("token")
    met = tokens.join(shared, "token").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.collect_list("token").alias("keys"))
    met = met.join(own.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id").filter(f"c >= {_SHORT}").select("doc_id", F.slice(F.array_sort("keys"), 1, FIRST_KEYS).alias("keys"))
    alive = materialize(met.join(copies.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "alive")
    texts = docs.select("doc_id", "text").join(alive.hint("shuffle_hash"), "doc_id")  # the same way at every size
    sets = texts.mapInArrow(_sets, "doc_id long, n long, keys array<long>, tokens array<long>").filter("n > 0")
    sets = materialize_bucketed(sets, "sets", "doc_id")

    first = components(materialize(_round(sets.withColumn("label", F.col("doc_id")), whole=False), "links"))
    first = materialize(first, "first")

    def named(frame: DataFrame) -> DataFrame:
        """``frame`` with the component of each document as label."""
        return frame.join(first, frame["doc_id"] == first["id"], "left").select(*frame.columns, F.coalesce("component", "doc_id").alias("label"))

    def crossing(frame: DataFrame) -> DataFrame:
        """(doc_id, token, df) of tokens that occur in several components."""
        high = F.col("token").bitwiseAND(F.lit(int(ROUTING.astype(np.int64)))).alias("token")
        rows = frame.select("doc_id", F.explode("tokens").alias("token")).select("doc_id", high)
        by_label = named(frame.select("doc_id", "tokens")).select("label", F.explode("tokens").alias("token")).select("label", high)
        cross = by_label.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("df")).filter("a <> b").select("token", "df")
        return rows.join(cross, "token")

    sizes = sets.groupBy("doc_id").agg(F.max("n").alias("n"))
    least = F.ceil(F.col("n") * NUM / DEN)
    open_ = crossing(sets).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).join(sizes, "doc_id").filter(F.col("c") >= least).select("doc_id")
    open_ = materialize(open_, "open")
    rest = materialize(named(sets.drop("keys").join(open_, "doc_id", "left_semi")), "rest")
    rare = crossing(rest.drop("label")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    rare = rare.join(sizes, "doc_id").filter(F.col("c") >= least).select("doc_id", F.expr(f"transform(slice(t, 1, greatest(0, cast(c - ceil(n * {NUM} / {DEN}) + 1 AS int))), x -> x.token)").alias("keys"))
    rare = materialize(rare, "rare")
    near = materialize(_clusters(rest, rare), "clusters")
    second = materialize(_round(rest.join(near, "doc_id"), whole=True), "second")
    links = first.filter("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v")).union(second)
    reps = spread_join(own.select("doc_id", "d1", "d2", "n"), copies.filter("c > 1"), ["d1", "d2", "n"], own.count()).filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    return sketch, components(links.union(reps))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: the smallest doc_id that links reach.

    Null or empty texts and texts without words have no shingles and link with nothing, as do rows
    without a doc_id.  Repeated rows are documents that link; rows that share a doc_id share its
    component.  Ties: the smallest doc_id names a component, whatever the order of rows.  Very long
    texts: a worker holds one text's shingles at a time, a group of sets of over ``BLOCK`` tokens is
    dealt in blocks.  Equal texts cost one document.  Other columns are not read, so none clashes.
    Empty input: empty result.
    """
    sketch, reached = classes_of(docs)
    full = sketch.select("doc_id", "n").join(reached, F.col("doc_id") == F.col("id"), "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row, with all columns, of each group of linked documents: that of the smallest doc_id.

    Every row is a document here: rows that share a doc_id, and rows without one, link by their texts
    alone, so of equal rows one stays; a null doc_id comes after all others, and of rows that agree in
    doc_id any one stays.  Where doc_ids are unique they name the rows; a table in which some repeat
    or are null is written once with row numbers instead.  Rows without words link with nothing and
    all stay.  Other columns pass unread, whatever their names but ``__row`` and ``__gone``.  Empty
    input: empty result.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.max((F.col("c") > 1) | F.col("doc_id").isNull()), F.lit(False)))
    if not ids.first()[0]:
        _, reached = classes_of(docs.select("doc_id", "text"))
        gone = reached.filter("id <> component").select(F.col("id").alias("__gone"))
        return _without(docs, docs["doc_id"], gone)
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    with scratch(docs.sparkSession):
        _, reached = classes_of(numbered.select(F.col("__row").alias("doc_id"), "text"))
        named = numbered.select("__row", F.col("doc_id").alias("__id")).join(reached, F.col("__row") == F.col("id"))
        first = named.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row"))["__row"].alias("__first"))
        gone = materialize(named.join(first, "component").filter("__row <> __first").select(F.col("__row").alias("__gone")), "gone", keep=True)
    return _without(numbered, numbered["__row"], gone).select(*[numbered[c] for c in docs.columns])


def _without(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``rows`` but for those whose key is in ``gone(__gone)``.

    Joined the same way at every size; the built side is unique numbers, dealt evenly by hash.
    """
    return rows.join(gone.hint("shuffle_hash"), key == F.col("__gone"), "left_anti")
