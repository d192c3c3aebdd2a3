import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import tokens
from keyloom.llm.queries import tokenizer_path
from tests.llm.conftest import SCHEMA, prose

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def plain(name, special_as_text=None):
    """The library as it comes, or with its switch set."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    if special_as_text is not None:
        t.encode_special_tokens = special_as_text
    return lambda x: t.encode(x or "", add_special_tokens=False)


@pytest.mark.parametrize("name", [BYTE, WORD])
@pytest.mark.parametrize("special_as_text", [None, True])
def test_cached_encoding_is_the_tokenizers(name, special_as_text):
    r, whole = random.Random(7), plain(name, special_as_text)
    e = tokens.Encoder(tokenizer_path(name), bool(special_as_text))
    chars = [*" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u200b\u3000\u2028", *"aZé'st.!1٣ΣσςİßÀ中,", "'s", "  ", "\n\n", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", " don't ", "word", "Éa, b", "ĀB. "]
    for k in range(8000):
        s = "".join(r.choice(chars) for _ in range(r.randrange(14)))
        s = s.strip().replace("\t", " ") if k % 2 else s
        assert np.frombuffer(e.ids(s), "<u4").tolist() == whole(s).ids, ascii(s)
        if k % 8 == 0:
            a, b = e.offsets(s)
            assert list(zip(a.tolist(), b.tolist(), strict=True)) == whole(s).offsets


def test_special_strings_get_their_ids_through_the_operators(spark):
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "<|ENDOFTEXT|> c", "<|startoftext|>d e"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    for name, end, run in ((BYTE, 0, lambda d, p: tokens.read_token_files(tokens.write_token_files(d, p))), (WORD, 1, tokens.pack)):
        got = {r["doc_id"]: r["ids_crc32"] for r in run(docs, tokenizer_path(name)).collect()}
        assert got == {i: zlib.crc32(np.array([*plain(name)(t).ids, end], "<u4").tobytes()) for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.section_tokens(docs, tokenizer_path(BYTE)).collect()}
    assert counts == {i: len(plain(BYTE)(t).ids) for i, t in enumerate(texts)}


def test_repeated_ids_are_in_one_order_over_all_shards(spark):
    rows = [(i % 3 if i % 4 else None, prose(i, 1 + i % 5), "en", "s", 1) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole = plain(BYTE)
    want = [(r[0], zlib.crc32(np.array([*whole(r[1]).ids, 0], "<u4").tobytes())) for r in sorted(df.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect(), key=lambda r: (r[0] is None, r[0] or 0, r[2]))]
    got = tokens.read_token_files(tokens.write_token_files(df, tokenizer_path(BYTE), seq_len=32)).collect()
    assert [(r["doc_id"], r["ids_crc32"]) for r in sorted(got, key=lambda r: r["start"])] == want


def test_clearing_the_cache_changes_nothing(monkeypatch):
    e, texts = tokens.Encoder(tokenizer_path(BYTE)), [prose(i, 80) for i in range(20)]
    want = [e.ids(t) for t in texts]
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    assert [tokens.Encoder(tokenizer_path(BYTE)).ids(t) for t in texts] == want == [e.ids(t) for t in texts]


def test_token_files_round_trip(spark, nasty, none, tmp_path):
    manifest = tokens.write_token_files(nasty, tokenizer_path(BYTE), seq_len=64, folder=f"file://{tmp_path}/t")
    got = sorted((tuple(r) for r in tokens.read_token_files(manifest).collect()), key=lambda r: r[1])
    whole = plain(BYTE)
    rows = [tuple(r)[:2] for r in sorted(nasty.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect(), key=lambda r: (r[0] is None, r[0] or 0, r[2]))]
    at, want, flat = 0, [], []
    for i, t in rows:
        ids = np.array([*whole(t).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
        flat.append(ids)
    assert got == want
    shards = manifest.orderBy("shard").collect()
    first = np.concatenate(flat)[: shards[0]["n_tokens"]]
    path = shards[0]["path"]
    file = pa.ipc.open_file(pa.memory_map(path.removeprefix("file://") + ".arrow"))
    assert pa.types.is_fixed_size_list(file.schema.field("ids").type) and file.schema.field("ids").type.value_type == pa.uint16()
    for i in (0, len(first) // 64):
        ids, mask = tokens.read_sequence(path, i)
        assert (ids[mask] == first[64 * i : 64 * (i + 1)]).all() and len(ids) == 64 and mask.sum() == len(first[64 * i : 64 * (i + 1)])
    empty = tokens.write_token_files(none, tokenizer_path(BYTE))
    assert empty.count() == 0 and tokens.read_token_files(empty).count() == 0


def test_the_manifest_is_one_file_and_tasks_read_a_few_shards(spark):
    df = spark.createDataFrame([(i, prose(i, 3 + i % 7), "en", "s", 1) for i in range(480)], SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        manifest = tokens.write_token_files(df, tokenizer_path(BYTE), seq_len=32)
        assert len(manifest.inputFiles()) == 1
        shards = [r["n_docs"] for r in manifest.orderBy("shard").collect()]
        got = tokens.read_token_files(manifest).selectExpr("*", "spark_partition_id() AS task").orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(shards) > 16 and len({r["task"] for r in got}) == 6
    assert [r["doc_id"] for r in got] == list(range(480)) and [r["task"] for r in got] == sorted(r["task"] for r in got)
    ends = np.cumsum(shards).tolist()
    firsts = [next(i for i, r in enumerate(got) if r["task"] == k) for k in range(1, 6)]
    assert set(firsts) <= set(ends) and max(np.diff([0, *[ends.index(x) + 1 for x in firsts], len(shards)])) <= 5
    whole, at = plain(BYTE), 0
    for r in got:
        ids = np.array([*whole(prose(r["doc_id"], 3 + r["doc_id"] % 7)).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def brute_bins(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_capacity_tree():
    r, tree, open_ = random.Random(1), tokens.CapacityTree(100), set()
    for _ in range(3000):
        c = r.randrange(101)
        tree.set(c, c not in open_)
        open_ ^= {c}
        n = r.randrange(101)
        assert tree.tightest(n) == min((x for x in open_ if x >= n), default=-1)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 50): r.randint(1, 40) for _ in range(25)}
    bins = {}
    for length, _, n, first, q, offset in tokens.pack_plan(counts, 50).tolist():
        for k in range(n):
            bins.setdefault(first + k // q, []).append((offset + k % q * length, length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 50
    lengths = [k for k, v in counts.items() for _ in range(v)]
    assert sorted(x for b in bins.values() for _, x in b) == sorted(lengths)
    assert sorted(50 - sum(x for _, x in b) for b in bins.values()) == brute_bins(lengths, 50)


def test_packing(spark, nasty, none):
    got = tokens.pack(nasty, tokenizer_path(WORD), capacity=256).collect()
    whole, want = plain(WORD), []
    for r in nasty.collect():
        ids = np.array([*whole(r["text"]).ids, 1], "<u4")
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want.append((r["doc_id"], k // 256, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) == len(brute_bins([w[3] for w in want], 256))
    assert tokens.pack(none, tokenizer_path(WORD)).count() == 0


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_sections_add_up(spark, nasty, none, rule):
    got = {}
    for r in tokens.section_tokens(nasty.filter("doc_id IS NOT NULL AND doc_id <> 11"), tokenizer_path(BYTE), rule).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"], r["n_tokens"]))
    whole = plain(BYTE)
    for r in nasty.filter("doc_id IS NOT NULL AND doc_id <> 11").collect():
        text, sections = r["text"] or "", sorted(got[r["doc_id"]])
        assert "".join(text[a:b] for _, a, b, _ in sections) == text
        want = [0] * len(sections)
        for a, b in whole(text).offsets:
            inside = [max(0, min(b, e) - max(a, s)) for _, s, e, _ in sections]
            touched = [i for i, x in enumerate(inside) if x] or [max(i for i, x in enumerate(sections) if x[1] <= a)]
            want[touched[0] if rule == "start" else touched[-1] if rule == "end" else inside.index(max(inside)) if max(inside) else touched[0]] += 1
        assert [n for *_, n in sections] == want
    assert tokens.section_tokens(none, tokenizer_path(BYTE), rule).count() == 0


def test_crossing_tokens():
    starts, ends, sections = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3])
    assert tokens.attribute(starts, ends, sections, "start").tolist() == [0, 0, 1]
    assert tokens.attribute(starts, ends, sections, "end").tolist() == [0, 1, 1]
    assert tokens.attribute(starts, ends, sections, "most").tolist() == [0, 1, 1]
    with pytest.raises(ValueError):
        tokens.section_tokens(None, "", rule="other")
