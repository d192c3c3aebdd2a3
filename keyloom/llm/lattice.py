"""Embedding near-duplicates by lattice hashing.

Random projections to eight dimensions are decoded to points of the E8 lattice.  A cell is the points
of several projections together, so its number of bits follows the number of vectors.  A vector lies
in its own cell of each of several tables and probes the neighbouring cells nearest to it (one or two
lattice points moved by one of the 240 shortest vectors); pairs that meet in a cell are verified by
cosine.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import components, materialize, partitions, scratch, spread_join

PROBES = 2
WIDTH = 2.2
#: What one projection parts, in bits: -log2 of the share of random pairs of unit vectors in one cell at ``WIDTH``.
BITS = 7.6
#: Nearest neighbours of each lattice point that probes choose from.
NEAR = 4
BLOCK = 1024


def codes_for(n: int) -> int:
    """Projections a cell: as many as part ``n`` vectors, so a vector meets about one unrelated one a table at every size."""
    return max(1, math.ceil(math.log2(max(n, 2)) / BITS))


def tables_for(codes: int) -> int:
    """Tables with which pairs at a cosine of 0.98 are found at a rate of 0.98 or more (measured; see the tests)."""
    return codes + 3 if codes < 4 else 3 * codes - 3


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers of even sum."""
    r = np.rint(x)
    d = x - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    worst = np.abs(d[odd]).argmax(axis=1)
    r[odd, worst] += np.where(d[odd, worst] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 moved by a half in each coordinate."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _hash(points: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed.copy()
    for k in range(8):
        h = (h ^ np.rint(2 * points[..., k]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _moves(codes: int) -> list[tuple[tuple[int, int], ...]]:
    """What a probe may move: one point to its j-th nearest neighbour, or two points to near ones."""
    single = [(k, j) for k in range(codes) for j in range(NEAR)]
    return [(m,) for m in single] + [(a, b) for a, b in itertools.combinations(single, 2) if a[0] != b[0] and a[1] + b[1] < NEAR - 1]


def cells(x: np.ndarray, label: np.ndarray, codes: int, tables: int, probes: int = PROBES, width: float = WIDTH, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (n, tables) and probed cells (n, tables, probes) of unit vectors, hashed with label and dimension."""
    near, moves = roots(), _moves(codes)
    own, other = np.empty((len(x), tables), np.int64), np.empty((len(x), tables, probes), np.int64)
    for t in range(tables):
        s = (label.astype(np.int64) * np.int64(1_000_003) + np.int64(t * 8191 + x.shape[1])).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        sums, changes, costs = np.zeros(len(x), np.uint64), [], []
        for k in range(codes):
            rng = np.random.default_rng((seed, t, k, x.shape[1]))
            y = x @ rng.standard_normal((x.shape[1], 8)) / width + rng.random(8)
            p = decode(y)
            gain = (y - p) @ near.T
            best = np.argpartition(-gain, NEAR, axis=1)[:, :NEAR]
            gain = np.take_along_axis(gain, best, axis=1)
            order = np.argsort(-gain, axis=1, kind="stable")
            best, gain = np.take_along_axis(best, order, axis=1), np.take_along_axis(gain, order, axis=1)
            salt = np.full(len(x), (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
            h = _hash(p, salt).view(np.uint64)
            sums += h
            changes.append(_hash(p[:, None, :] + near[best], np.repeat(salt[:, None], NEAR, axis=1)).view(np.uint64) - h[:, None])
            costs.append(2 - 2 * gain)  # how much farther the moved point is, squared
        cost = np.stack([sum(costs[k][:, j] for k, j in m) for m in moves], axis=1)
        pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        moved = np.stack([sum((changes[k][:, j] for k, j in m), sums) for m in moves], axis=1)
        own[:, t] = _mixed(sums, s)
        other[:, t] = _mixed(np.take_along_axis(moved, pick, axis=1), s[:, None])
    return own, other


def _mixed(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) + seed
    return (h ^ (h >> np.uint64(33))).view(np.int64)


def _unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _encode(codes: int, tables: int, probes: int):
    """Cells of each class; the vector goes along in its own precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, flat = batch.column("label").to_numpy(), batch.column("embedding")
            sizes = np.diff(flat.offsets.to_numpy())
            values = flat.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = values[starts[at][:, None] + np.arange(dim)]
                own, other = cells(_unit(x), label[at], codes, tables, probes)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").take(take), batch.column("w").take(take), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(other.reshape(len(at), -1)), pa.list_(pa.int64()))],
                    names=["rep", "w", "x", "own", "other"],
                )

    return run


def _find(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index in reach of each of n nodes over edges i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


#: Groups up to this size are compared together; larger ones each by a product of matrices.
SMALL = 32


def _pairs(x: np.ndarray, ends: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i < j) of one group at a cosine of ``least`` or more; ``ends`` are the groups' ends."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        a, b = np.triu_indices(n, 1)
        own = starts[sizes == n]
        step = max(1, 100_000 // len(a))
        for at in range(0, len(own), step):
            i, j = ((own[at : at + step, None] + k).ravel() for k in (a, b))
            keep = np.einsum("ij,ij->i", x[i], x[j]) >= least
            yield i[keep], j[keep]
    for start, end in zip(starts[sizes > SMALL].tolist(), ends[sizes > SMALL].tolist(), strict=True):
        for a in range(start, end, 512):  # a strip of the matrix at a time
            i, j = np.nonzero(x[a : min(a + 512, end)] @ x[start:end].T >= least)
            i, j = i + a, j + start
            yield i[i < j], j[i < j]


def _meet(least: float, tables: int, probes: int, dtype: str):
    """Links among the members of each cell, or between two blocks of them; rows come sorted by key."""

    def work(g: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rep, w, t, home, block, key = (g.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "w", "t", "home", "block", "key"))
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        x = _rows(g.column("x"), dtype)
        own = g.column("own").flatten().to_numpy().reshape(len(rep), tables)
        other = g.column("other").flatten().to_numpy().reshape(len(rep), tables, probes)
        across = np.repeat(np.minimum.reduceat(block, np.append(0, ends[:-1])) != np.maximum.reduceat(block, np.append(0, ends[:-1])), np.diff(ends, prepend=0))
        kept = []
        for length, at in x:
            # rows of one length in the order of their groups
            group = np.searchsorted(ends, at, side="right")
            stops = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
            for i, j in _pairs(length, stops, least):
                i, j = at[i], at[j]
                keep = (home[i] | home[j]) & (rep[i] != rep[j]) & (~across[i] | (block[i] != block[j]))
                kept.append((i[keep], j[keep]))
        if not kept:
            return
        i, j = (np.concatenate(p) for p in zip(*kept, strict=True))
        # Each pair counts once: in the first table where it meets; where both probe the other's
        # cell, in the cell of the smaller id.
        fresh = np.ones(len(i), bool)
        for s in range(tables):
            i_by_j = (own[i, s][:, None] == other[j, s]).any(axis=1)
            j_by_i = (own[j, s][:, None] == other[i, s]).any(axis=1)
            fresh &= (s >= t[i]) | ~(i_by_j | j_by_i | (own[i, s] == own[j, s]))
            low = np.where(rep[i] < rep[j], i, j)
            fresh &= (s != t[i]) | ~(i_by_j & j_by_i) | home[low]
        i, j = i[fresh], j[fresh]
        if not len(i):
            return
        links = np.bincount(i, w[j], len(rep)) + np.bincount(j, w[i], len(rep))
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))
        root = rep[order][_find(len(rep), place[i], place[j])[place]]
        has = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(rep[has]), pa.array(links[has].astype(np.int64)), pa.array(root[has])], names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            key = batch.column(batch.schema.get_field_index("key"))
            last = key[batch.num_rows - 1].as_py()
            # all but the last group are whole
            cut = int(np.flatnonzero(key.to_numpy() != last)[-1]) + 1 if key[0].as_py() != last else 0
            if held and held[0].column("key")[0].as_py() != key[0].as_py():
                yield from work(pa.concat_batches(held))
                held = []
            if cut:
                yield from work(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from work(pa.concat_batches(held))

    return run


def _rows(column: pa.Array, dtype: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(unit vectors, their rows) for each length of vector: one matrix a length."""
    sizes, whole = pc.binary_length(column).to_numpy(), column.to_pylist()
    return [(_unit(np.frombuffer(b"".join([whole[k] for k in at]), dtype).reshape(len(at), -1)), at) for at in (np.flatnonzero(sizes == n) for n in np.unique(sizes))]


def near_duplicates(embeddings: DataFrame, least: float = 0.98, codes: int | None = None, tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector of ``embeddings(vec_id, embedding, label)``.

    Vectors of one label (and dimension) link at a cosine of ``least`` or more in double precision.
    Equal vectors of a label are one class with a weight, so copies cost one row; ``codes`` follows
    the largest label's classes (``codes_for``), so the pairs compared a vector do not grow with the
    input; cells of over ``BLOCK`` members are dealt as pairs of blocks; links are counted where they
    are verified, and only counts and a spanning forest leave a task, never pairs.  Found links are
    exact; recall is that of the tables and probes (measured in the tests).

    Null, zero-norm or empty vectors, vectors with a null or non-finite component, null labels and
    null vec_ids link with nothing: n_links 0, component_id their own vec_id.  Rows that repeat a
    vec_id are vectors of their own.  Ties: the smallest vec_id names a component.  Vectors of any
    length are compared whole.  Other columns are not read, so none clashes.  Empty input: empty result.
    """
    with scratch(embeddings.sparkSession):
        return _near_duplicates(embeddings, least, codes, tables, probes)


def _near_duplicates(embeddings: DataFrame, least: float, codes: int | None, tables: int | None, probes: int) -> DataFrame:
    rows = embeddings.select("vec_id", "embedding", "label")
    finite = "vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, v -> v IS NULL OR isnan(v) OR abs(v) = float('infinity')) AND exists(embedding, v -> v <> 0)"
    classes = rows.filter(finite).groupBy("label", "embedding").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("w"))
    # a vec_id that repeats with other vectors would name two classes: each class is known by its row
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    if codes is None:
        codes = codes_for(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    tables = tables or tables_for(codes)
    dtype = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    vectors = classes.select("rep", "w", F.xxhash64("label").alias("label"), "embedding" if dtype == "<f4" else F.col("embedding").cast("array<double>").alias("embedding"))
    coded = materialize(vectors.mapInArrow(_encode(codes, tables, probes), "rep long, w long, x binary, own array<long>, other array<long>"), "cells")
    home = F.transform("own", lambda c, t: F.struct(c.alias("cell"), t.alias("t"), F.lit(True).alias("home")))
    probe = F.transform("other", lambda c, i: F.struct(c.alias("cell"), F.floor(i / probes).cast("int").alias("t"), F.lit(False).alias("home")))
    spots = coded.select("rep", F.explode(F.concat(home, probe)).alias("s")).select("rep", "s.*")
    live = spots.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("own")).filter("n > 1 AND own > 0").select("cell", F.col("n").alias("c"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    spots = spread_join(spots, live, ["cell"], coded.count() * tables * (1 + probes)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # block b meets every block: pairs (b, k) in order
    spots = spots.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spots = spots.withColumn("key", F.xxhash64("cell", F.least("block", "k"), F.greatest("block", "k")))
    met = spots.select("rep", "t", "home", "block", "key").join(coded, "rep").repartition(partitions(embeddings.sparkSession), "key").sortWithinPartitions("key")
    found = materialize(met.mapInArrow(_meet(least, tables, probes, dtype), "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("rep", "vec")
    edges = found.filter("rep <> root").select("rep", "root").distinct()
    edges = edges.join(named, "rep").select("root", F.col("vec").alias("u")).join(named.withColumnRenamed("rep", "root"), "root").select("u", F.col("vec").alias("v"))
    reached = components(edges)
    # only classes that link with anything go back to the rows
    full = classes.join(counts, "rep", "left").join(reached, F.col("vec") == F.col("id"), "left").filter("w > 1 OR links IS NOT NULL OR component IS NOT NULL")
    full = full.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "vec").alias("component"))
    full = materialize(full, "linked", keep=True)
    ok = rows.withColumn("ok", F.coalesce(F.expr(finite), F.lit(False)))
    joined = ok.join(full, F.col("ok") & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
