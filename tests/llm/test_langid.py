import os
import zlib
from collections import Counter

import numpy as np
import pytest

from keyloom.llm import langid
from tests.llm.conftest import SCHEMA, prose

ALPHABETS = {"aa": ["bado", "kelu", "mira", "tosa"], "bb": ["schuv", "dreck", "plotz", "grunz"], "cc": ["été", "çavé", "ouère", "naïl"]}


def corpus(spark):
    rows = [(i, prose(i, 5 + i % 60, ALPHABETS[k]), k, k, 1) for i, k in ((i, list(ALPHABETS)[i % 3]) for i in range(600))]
    return spark.createDataFrame(rows, SCHEMA)


def test_held_out_accuracy_and_reproducibility(spark):
    docs = corpus(spark)
    rows = langid.identify(docs, langid.fit(docs)).collect()
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in want if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in out]) > 0.99
    assert all(0 <= r["score"] <= 1 and 0 <= r["known"] <= 1 for r in rows)
    again = langid.identify(docs.repartition(5), langid.fit(docs.repartition(3))).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def exact(docs, languages, least_rate=2e-5):
    """Plain sets of n-grams, no hashes and no filters: the share of each text's n-grams that each language has."""
    def grams(text):
        s = langid.normal(text)
        return [s[i : i + n] for n in langid.SIZES for i in range(len(s) - n + 1)]

    seen = {k: Counter() for k in languages}
    for r in docs:
        if r["text"] is not None and r["lang"] in seen and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            seen[r["lang"]].update(grams(r["text"]))
    kept = {k: {g for g, n in c.items() if n >= max(2, sum(c.values()) * least_rate)} for k, c in seen.items()}
    out = {}
    for r in docs:
        own = grams(r["text"])
        out[r["doc_id"]] = {k: sum(g in kept[k] for g in own) for k in languages}, len(own)
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_same_as_exact_sets_on_overlapping_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    model = langid.fit(docs)
    want = exact(rows, model.languages)
    for r in langid.identify(docs, model).collect():
        hits, n = want[r["doc_id"]]
        if not n:
            assert r["lang_pred"] == "und"
            continue
        best = sorted(hits.values())
        if best[-1] - best[-2] > 0.02 * n:
            assert r["lang_pred"] == max(hits, key=hits.get)
        if n > 200:
            assert abs(r["known"] - best[-1] / n) < 0.02
            assert abs(r["score"] - best[-1] / max(1, sum(best))) < 0.03


def test_rows_without_a_doc_id_are_sampled_one_by_one(spark):
    rows = [(None, f"{prose(i, 6, ALPHABETS['aa'])} u{chr(97 + i % 26)}{chr(97 + i // 26)}q", "aa", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    few, all_ = (langid.fit(docs, sample=n).false_rate[0] for n in (100, 400))
    assert 0 < few < all_


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.fit(corpus(spark))


def test_filters_return_all_languages_of_an_ngram():
    words = [np.zeros(1 << 10, np.uint64) for _ in range(2)]
    grams = np.array([5, 77, 1234567], np.uint64)
    for lang in (3, 70):
        for at in langid.slots(grams, 10):
            words[lang // 64][at] |= np.uint64(1 << (lang % 64))
    model = langid.Model([f"l{i:02}" for i in range(80)], 10, words, np.zeros(80), "l00")
    found = [words[w][a] & words[w][b] & words[w][c] for w in range(2) for a, b, c in [langid.slots(grams, 10)]]
    assert (found[0] >> np.uint64(3) & np.uint64(1)).all() and (found[1] >> np.uint64(6) & np.uint64(1)).all()
    assert model.score("qqqq zzzz")[0] in model.languages


def test_chunks_do_not_change_ngrams(monkeypatch):
    text = langid.normal(prose(5, 400))
    whole = np.sort(np.concatenate(list(langid.ngrams(text))))
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert (np.sort(np.concatenate(list(langid.ngrams(text)))) == whole).all()


def test_nasty_and_empty(spark, nasty, none):
    model = langid.fit(nasty)
    rows = langid.identify(nasty, model).collect()
    assert len(rows) == nasty.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (4, 5, 6, 13))
    assert by[9]["lang_pred"] in ("en", "fr")
    kept = langid.keep_identified(nasty, model)
    assert kept.columns == nasty.columns and not {4, 5, 6, 13} & {r["doc_id"] for r in kept.collect()}
    nothing = langid.fit(none)
    assert {r["lang_pred"] for r in langid.identify(nasty, nothing).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0
