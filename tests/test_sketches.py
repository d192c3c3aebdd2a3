"""Hashes, cardinality sketches, Bloom filters, bitmaps, capacities, scans and streams."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import capacity, hashing
from keyloom.operators import bloom, roaring
from keyloom.operators.batch import exclusive_scan
from keyloom.operators.hll import THRESHOLDS, HyperLogLog, _bias
from keyloom.operators.keyed import StaticSet
from keyloom.sources import tables
from keyloom.streaming.microbatch import StreamingState


def test_hash_vectors(spark):
    def one(col):
        return spark.range(1).select(col).first()[0]

    def u(x):
        return x & (2**64 - 1)

    k32 = lambda v: F.lit(v).cast("int")
    k64 = lambda v: F.lit(v).cast("long")
    for v, want in ((0, 4246796580750024372), (42, 15516826743637085169), (123456789, 9462334144942111946)):
        assert u(one(hashing.xxhash64(k32(v), 0))) == want
    for v, want in ((0, 3803688792395291579), (42, 13066772586158965587), (123456789, 14662639848940634189)):
        assert u(one(hashing.xxhash64(k64(v), 0))) == want
    assert u(one(hashing.xxhash64(k32(0)))) == 3614696996920510707
    assert u(one(hashing.xxhash64(k64(0)))) == 13194218611613725804
    for v in (0, 42, 123456789, -5):
        assert one(hashing.xxhash64_arrow(k64(v), 7)) == one(hashing.xxhash64(k64(v), 7))
        assert one(hashing.xxhash64_arrow(k32(v), 7, wide=False)) == one(hashing.xxhash64(k32(v), 7))
    assert one(hashing.fmix32(k32(0x41424344), 0xFFFFEEEE)) == 0x570DF661
    assert u(one(hashing.fmix64(k64(0x41424344), 0xFFFFEEEE))) == 0x5EE45A8EB612F708
    assert one(hashing.murmur32(k32(0x41424344), 0xFFFFEEEE)) == 0xD6BDBBB4
    assert one(hashing.xxhash32(k32(123456789))) == 0xB20A85EE
    assert one(hashing.xxhash32(k32(42))) == 0x454235D1


def test_capacities():
    assert [capacity.rounded(c, 5) for c in (0, 1, 5, 6)] == [10, 5, 5, 10]
    assert [capacity.rounded(c, b, "double") for c, b in ((20, 5), (8, 1), (21, 3))] == [25, 11, 21]
    assert capacity.usable(10_000) == 0 and capacity.usable(40_000) == 14_000
    assert capacity.Growth.of(40_000).reserved(50_000).segments == (40_000, 80_000)
    with pytest.raises(ValueError):
        capacity.rounded(-1)


def test_growth():
    """A batch goes whole into one segment; the next is at least twice the last and takes twice what is there."""
    g = capacity.Growth.of(0)
    assert g.segments == (2,) and g.room == 0
    assert g.reserved(1).segments == (2, *(4 << k for k in range(14))) and sum(map(capacity.usable, g.reserved(1).segments)) >= 1
    one = g.after(1, 1)
    assert one.segments == (2, 32_768) and one.filled == (0, 1) and one.room == capacity.usable(32_768) - 1 == 9_659
    assert one.after(9_659, 9_659).segments == (2, 32_768)
    two = one.after(9_660, 9_000)
    assert two.segments == (2, 32_768, 65_536) and two.filled == (0, 1, 9_000)
    assert two.ready is None and two.erased(500).filled == (0, 0, 8_501) and two.cleared().filled == (0, 0, 0)
    many = two.after(20_000, 20_000)  # spread over segments, and too little room is left for as many again
    assert many.filled == (0, 1, 29_000)[:2] + (9_000, 20_000) or many.ready is not None
    grown = capacity.Growth.of(100_000).after(40_000, 40_000).after(40_000, 40_000)
    assert grown.segments == (100_000, 200_000) and grown.filled == (40_000, 40_000)
    assert capacity.usable(1_000_000_000) == 599_990_000 + 23  # the load is a 32-bit float's


@pytest.mark.parametrize(("n", "p"), [*((n, 13) for n in (0, 1, 2, 3, 7, 128, 1024, 4096, 65_537, 1_048_576)), *((65_537, p) for p in range(14, 19)), (1_048_576, 18)])
def test_estimates_stay_within_the_bound(spark, n, p):
    keys = spark.range(2 * n).select((F.col("id") % max(n, 1) + 1).alias("key"))
    got = HyperLogLog.create(spark, p=p).add(keys).estimate()
    assert abs(got - n) <= n * 3 * 1.04 / math.sqrt(1 << p)


def test_bias_is_the_mean_of_the_six_nearest(spark):
    module = getattr(getattr(spark._jvm.org.apache.spark.sql.catalyst.util, "HyperLogLogPlusPlusHelper$"), "MODULE$")
    raw, bias = (list(x[13 - 4]) for x in (module.RAW_ESTIMATE_DATA(), module.BIAS_DATA()))
    for e in (raw[0] - 5, raw[40] + 1.5, raw[120] - 0.25, raw[-1] + 100):
        near = sorted(range(len(raw)), key=lambda i: abs(raw[i] - e))[:6]
        assert math.isclose(spark.range(1).select(_bias(spark, 13, F.lit(e))).first()[0], sum(bias[i] for i in near) / 6)
    assert sorted(THRESHOLDS) == list(range(13, 19))


@pytest.mark.parametrize("p", range(13, 19))
def test_estimates_are_corrected_without_a_jvm(spark, p):
    """A remote session has no JVM to ask for the known biases; they are the same there."""
    module = getattr(getattr(spark._jvm.org.apache.spark.sql.catalyst.util, "HyperLogLogPlusPlusHelper$"), "MODULE$")
    raw, bias = (list(x[p - 4]) for x in (module.RAW_ESTIMATE_DATA(), module.BIAS_DATA()))
    asked = [2.6 * (1 << p), raw[len(raw) // 2], 4.9 * (1 << p)]
    want = [sum(bias[i] for i in sorted(range(len(raw)), key=lambda i: abs(raw[i] - e))[:6]) / 6 for e in asked]
    got = spark.range(1).select(*[_bias(object(), p, F.lit(e)) for e in asked]).first()
    assert all(w and math.isclose(g, w) for g, w in zip(got, want, strict=True))


def test_linear_counting_holds_up_to_the_threshold(spark):
    """The rule's branches at given (raw estimate, empty registers), against plain arithmetic."""
    m = float(1 << 13)
    new = HyperLogLog.create(spark, p=13)
    for filled, rank in ((0, 1), (3000, 2), (8192, 3), (8000, 3), (8191, 2), (8192, 14)):
        sketch = HyperLogLog(spark.range(filled).select(F.col("id").cast("int").alias("idx"), F.lit(rank).alias("rank")), 13)
        z, zeros = filled * 2.0**-rank + (m - filled), int(m) - filled
        e = 0.7213 / (1 + 1.079 / m) * m * m / z
        h = m * math.log(m / zeros) if zeros else None
        if h is not None and (e <= 2.5 * m or h <= THRESHOLDS[13]):
            want = h
        else:
            want = e - (spark.range(1).select(_bias(spark, 13, F.lit(e))).first()[0] if e < 5 * m else 0.0)
        assert sketch.estimate() == math.floor(want + 0.5)
    assert new.estimate() == 0


def test_sketch_parameters_merge_and_registers(spark):
    assert [HyperLogLog.create(spark, kb=k).p for k in (8, 256)] == [13, 18]
    assert HyperLogLog.create(spark, deviation=0.01).p == 14
    for bad in ({"kb": 9}, {"p": 12}, {"p": 19}, {"deviation": -1.0}, {}):
        with pytest.raises(ValueError):
            HyperLogLog.create(spark, **bad)
    a, b = spark.range(500).withColumnRenamed("id", "key"), spark.range(300, 900).withColumnRenamed("id", "key")
    new = lambda: HyperLogLog.create(spark, p=13)
    both = {tuple(r) for r in new().add(a).merge(new().add(b)).registers.collect()}
    assert both == {tuple(r) for r in new().add(a.union(b)).registers.collect()}
    with pytest.raises(ValueError):
        new().merge(HyperLogLog.create(spark, p=14))
    want = {}
    for r in a.select("key", hashing.xxhash64(F.col("key"), 0).alias("h")).collect():
        h = r["h"] & (2**64 - 1)
        tail = (h << 13 | 1 << 12) & (2**64 - 1)
        want[h >> 51] = max(want.get(h >> 51, 0), 64 - tail.bit_length() + 1)
    assert {r["idx"]: r["rank"] for r in new().add(a).registers.collect()} == want


@pytest.mark.parametrize("policy", [bloom.ARROW, bloom.Policy(4, 8, seed=3), bloom.Policy(1, 2)])
def test_bloom_bits(spark, policy):
    blocks, keys = 257, list(range(1, 400))
    f = bloom.BloomFilter.create(spark, blocks, policy).add(spark.createDataFrame([(k,) for k in keys], "key long"))
    hashed = spark.createDataFrame([(k,) for k in keys], "key long").select(hashing.xxhash64(F.col("key"), policy.seed)).collect()
    per, want = policy.bits // policy.words, {}
    for (h,) in hashed:
        h &= 2**64 - 1
        words = want.setdefault((h >> 32) * blocks >> 32, [0] * policy.words)
        for w in range(policy.words):
            for b in range(per):
                words[w] |= 1 << ((bloom.SALTS[w * per + b] * (h & 0xFFFFFFFF) & 0xFFFFFFFF) >> 27)
    assert {r[0]: list(r)[1:] for r in f.table.collect()} == want


def test_bloom_queries(spark):
    mk = lambda ks: spark.createDataFrame([(k, k % 2) for k in ks], "key long, stencil int")
    new = lambda: bloom.BloomFilter.create(spark, 1021)
    a, b = new().add(mk(range(200))), new().add(mk(range(100, 300)))
    assert all(r["found"] for r in a.merge(b).contains(mk(range(300))).collect())
    assert all(r["found"] for r in a.intersect(b).contains(mk(range(100, 200))).collect())
    odd = new().add(mk(range(200)), lambda s: s == 1)
    assert all(r["found"] for r in odd.contains(mk(range(1, 200, 2))).collect())
    assert not any(r["found"] for r in a.contains(mk(range(200)), lambda s: s > 5).collect())
    assert sum(r["found"] for r in a.contains(mk(range(10_000, 12_000))).collect()) < 40
    assert not any(r["found"] for r in a.clear().contains(mk(range(10))).collect())
    assert (a.num_words, a.size_bytes) == (8168, 32672)
    with pytest.raises(ValueError):
        a.merge(bloom.BloomFilter.create(spark, 5))
    with pytest.raises(ValueError):
        bloom.BloomFilter.create(spark, 0)
    for bad in ((3, 3), (8, 4), (8, 12), (64, 64)):
        with pytest.raises(ValueError):
            bloom.Policy(*bad)


def test_bitmap_files_of_known_size():
    v = {*range(0, 100_000, 1000), *range(300_000, 600_000, 3), *range(700_000, 800_000)}
    assert (len(roaring.serialize32(v)), len(roaring.serialize32(v, True))) == (72_616, 48_056)
    w = [b + x for b in (0, 1 << 32) for x in [*range(0x9001), *range(0xA000, 0x10001), 0x20000, 0x20005, *range(0x80000, 0x90000, 2)]]
    assert len(roaring.serialize64(w, True)) == 16_506
    # the public files' digests
    assert hashlib.sha256(roaring.serialize32(v)).hexdigest() == "d719ae2e0150a362ef7cf51c361527585891f01460b1a92bcfb6a7257282a442"
    assert hashlib.sha256(roaring.serialize32(v, True)).hexdigest() == "1f1909bfdd354fa2f0694fe88b8076833ca5383ad9fc3f68f2709c84a2ab70e3"
    assert hashlib.sha256(roaring.serialize64(w, True)).hexdigest() == "b5a553a759167f5f9ccb3fa21552d943b4c73235635b753376f4faf62067d178"


@pytest.mark.parametrize("runs", [False, True])
def test_bitmap_membership(spark, runs, tmp_path):
    r = random.Random(3)
    v = {*r.sample(range(1 << 22), 3000), *range(200_000, 280_000), 0, (1 << 32) - 1}
    data = roaring.serialize32(v, runs)
    bitmap = roaring.RoaringBitmap(spark, data)
    asked = [0, 1, 199_999, 200_000, 279_999, 280_000, (1 << 32) - 1, *r.sample(sorted(v), 200), *[r.randrange(1 << 22) for _ in range(200)]]
    got = bitmap.contains(spark.createDataFrame(list(enumerate(asked)), "ord long, key long")).collect()
    assert all(x["found"] == (x["key"] in v) for x in got) and len(got) == len(asked)
    assert bitmap.cardinality == len(v) and not bitmap.empty and all(k in bitmap for k in asked if k in v)
    (tmp_path / "a.bin").write_bytes(data)
    held = tables.read_bitmaps(spark, str(tmp_path))
    assert held.agg(F.sum("card")).first()[0] == len(v)


def test_wide_bitmap(spark):
    v = [1, 5, (1 << 32) + 7, (1 << 63) + 9]
    b = roaring.RoaringBitmap(spark, roaring.serialize64(v), 64)
    asked = [1, 2, (1 << 32) + 7, 7, (1 << 63) + 9 - (1 << 64)]
    got = b.contains(spark.createDataFrame(list(enumerate(asked)), "ord long, key long")).orderBy("ord").collect()
    assert [x["found"] for x in got] == [True, False, True, False, True]


def test_malformed_bitmaps_are_refused():
    good = roaring.serialize32([1, 70_000, 140_000], False)
    for bad in (b"", b"\x00" * 8, good[:-1], good[:9], good[:8] + good[12:16] + good[8:12] + good[16:]):
        with pytest.raises(ValueError):
            roaring.parse32(bad)


def test_exclusive_scan(spark):
    r = random.Random(5)
    ords = [*{r.randrange(-(1 << 62), 1 << 62) for _ in range(300)}, *range(100)]
    data = [(o, r.randint(0, 9)) for o in ords]
    got = {x["ord"]: x["before"] for x in exclusive_scan(spark.createDataFrame(data, "ord long, v long"), F.col("v"), "before").collect()}
    total, want = 0, {}
    for o, v in sorted(data):
        want[o] = total
        total += v
    assert got == want


def test_snapshots_and_streams(spark, tmp_path):
    s = StaticSet.create(spark, "long", -1)
    src = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(10 * i + j, (10 * i + j) % 7) for j in range(10)], "ord long, key long").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("ord long, key long").option("maxFilesPerTrigger", 1).parquet(str(src))
    state = StreamingState(s, lambda c, b: c.insert_async(b), str(tmp_path / "state"))
    q = state.start(stream, str(tmp_path / "cp"))
    q.processAllAvailable()
    last = q.lastProgress["batchId"]
    q.stop()
    done = max(i for i in range(last + 1) if (tmp_path / "state" / f"batch={i}").exists())
    assert {r["key"] for r in state.at(spark, done).to_df().collect()} == set(range(7))
    tables.save(s.insert_async(spark.createDataFrame([(0, 5)], "ord long, key long")).to_df(), str(tmp_path / "snap"))
    assert tables.load(spark, str(tmp_path / "snap")).count() == 1
