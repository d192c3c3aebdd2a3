"""The pipeline against brute force, stage by stage, over driver rows and over nasty ones."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from keyloom.llm import pii, quality
from keyloom.llm.queries import ORACLES, QUERIES
from tests.llm import test_pii
from tests.llm.test_jaccard import assert_one_of_each
from tests.llm.test_langid import exact
from tests.llm.test_mixing import targets
from tests.llm.test_quality import counts
from tests.llm.test_tokens import WORD, brute_bins, plain

D = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_registered():
    assert [int(q[2:].split("_")[0]) for q in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
    assert list(STAGES) == ["language_id", "jaccard_dedup", "pii", "mixing", "packing"]
    assert len(quality.PATH) > 0


def check_language_id(rows, kept):
    """Exact n-gram sets say which texts a learned language knows; rows near the bar may go either way."""
    languages = sorted({r["lang"] for r in rows if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 or r["doc_id"] is None and r["lang"] and r["text"]})
    share = exact(rows, languages)
    stays, goes = Counter(), Counter()
    for r in rows:
        hits, n = share[r["doc_id"]] if r["doc_id"] is not None else ({}, 0)
        best = max(hits.values(), default=0) / n if n else 0.0
        if r["doc_id"] is None:
            continue
        (stays if best > 0.03 else goes if best < 0.01 else Counter())[tuple(r)] += 1
    left = Counter(tuple(r) for r in kept)
    assert not stays - left and not goes & left and not left - Counter(tuple(r) for r in rows)


def check_pii(rows, clean):
    texts = [r["text"] or "" for r in rows]
    good = test_pii.brute_trusted(texts)
    want = Counter()
    for r in rows:
        found = [x.split(":") for x in test_pii.brute_spans(r["text"] or "", good).split(",") if x]
        text = pii.redact(r["text"], [(int(a), int(b), k) for k, a, b in found]) if found else r["text"]
        want[r["doc_id"], text, len(text) if found else r["n_chars"]] += 1
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in clean) == want


def check_mixing(rows, mixed):
    """Systematic sampling in plain Python: one offset a source, a copy for each integer crossed."""
    size, by = Counter(), defaultdict(list)
    for r in rows:
        n = counts(r["text"])[0]
        size[r["source"]] += n
        digest = hashlib.md5(("null" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
        by[r["source"]].append((n, digest, r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"]))
    goal, want = targets(dict(size)), Counter()
    for source, own in by.items():
        rate = goal[source] / size[source] if size[source] else 0.0
        u = int(hashlib.md5(f"17:{chr(0) + 'null' if source is None else source}".encode()).hexdigest()[:8], 16) / 2**32
        for rank, (n, *_, doc_id) in enumerate(sorted(own, key=lambda x: x[:4]), 1):
            want[doc_id, source, n] += min(math.floor(rank * rate + u) - math.floor((rank - 1) * rate + u), math.ceil(rate))
    assert Counter((r["doc_id"], r["source"], counts(r["text"])[0]) for r in mixed) == +want


def check_packing(rows, packed):
    encode, want, lengths = plain(WORD), Counter(), []
    for r in rows:
        ids = np.array([*encode(r["text"]).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r["doc_id"], k // 4096, k, len(part), zlib.crc32(part.tobytes())] += 1
            lengths.append(len(part))
    assert Counter(tuple(p)[:5] for p in packed) == want
    bins = defaultdict(list)
    for p in packed:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    left = []
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        left.append(4096 - at)
    assert sorted(left) == brute_bins(lengths, 4096)


def run_checked(spark, docs):
    rows = docs.collect()
    kept = STAGES["language_id"](spark, docs, D).cache()
    assert kept.columns == docs.columns
    check_language_id(rows, kept.collect())
    one = STAGES["jaccard_dedup"](spark, kept, D).cache()
    assert one.columns == docs.columns
    assert_one_of_each([(r["doc_id"], r["text"]) for r in kept.collect()], [(r["doc_id"], r["text"]) for r in one.collect()])
    clean = STAGES["pii"](spark, one, D).cache()
    assert clean.columns == docs.columns
    check_pii(one.collect(), clean.collect())
    mixed = STAGES["mixing"](spark, clean, D).cache()
    assert mixed.columns == docs.columns
    check_mixing(clean.collect(), mixed.collect())
    packed = STAGES["packing"](spark, mixed, D).collect()
    check_packing(mixed.collect(), packed)
    return packed


@pytest.mark.skipif(not os.path.isdir(D), reason="driver tables are not here")
def test_stages_over_driver_rows(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    packed = run_checked(spark, docs)
    assert sorted(map(str, corpus_pipeline.run(spark, D).collect())) == sorted(map(str, packed))


def test_stages_over_nasty_and_no_rows(spark, nasty, none):
    assert run_checked(spark, nasty)
    assert run_checked(spark, none) == []
