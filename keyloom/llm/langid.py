"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter: one table of slots, each a bitmask over all languages.  ANDing the slots
of an n-gram returns every language that contains it at once.  Per-language popcounts over a text's
n-grams, corrected for each slice's false-positive rate, decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import materialize, scratch

SIZES = (3, 4)
HASHES = 3
CHUNK = 1 << 16
#: N-grams that a task of ``fit`` holds before it counts them: some 30 MB with the sort.
HELD = 1 << 20
#: Languages that a model may have: 16 MB of slots for each 64 of them go to all executors.
LANGUAGES = 1024
_GAP = re.compile(r"[\W\d_]+")
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def normal(text: str | None) -> str:
    """Lower case, letters only, one space between and around words; empty without a letter."""
    s = _GAP.sub(" ", (text or "").lower()).strip()
    return f" {s} " if any(map(str.isalpha, s)) else ""


def ngrams(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the character n-grams of a normal text, in bounded chunks."""
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        for n in SIZES:
            m = min(len(codes) - n + 1, CHUNK)
            if m > 0:
                h = np.full(m, np.uint64(n))
                for k in range(n):
                    h = (h + codes[k : k + m]) * _STEP[k]
                    h ^= h >> np.uint64(32)
                h *= _MIX
                yield h ^ (h >> np.uint64(29))


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(21 * k)) & mask).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    """``words[w]`` is the slot table of languages 64 w to 64 w + 63."""

    languages: list[str]
    bits: int
    words: list[np.ndarray]
    false_rate: np.ndarray
    fallback: str

    def score(self, text: str | None) -> tuple[str, float, float]:
        """(language, its share of the corrected hits, the share of n-grams that it contains)."""
        s = normal(text)
        if not s or not self.languages:
            return "und", 0.0, 0.0
        hits, n = np.zeros(len(self.languages)), 0
        for h in ngrams(s):
            n += len(h)
            at = slots(h, self.bits)
            for w, table in enumerate(self.words):
                found = table[at[0]]
                for a in at[1:]:
                    found = found & table[a]
                if table.dtype == np.uint8:
                    counts = np.bincount(found, minlength=256)
                    own = [int(counts[(np.arange(256) >> b) & 1 == 1].sum()) for b in range(len(self.languages))]
                else:
                    own = [int(((found >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(min(64, len(self.languages) - 64 * w))]
                hits[64 * w : 64 * w + len(own)] += own
        hits = np.maximum(0.0, (hits - n * self.false_rate) / (1.0 - self.false_rate))
        if not hits.any():
            return self.fallback, 0.0, 0.0
        best = int(np.argmax(hits))
        return self.languages[best], float(hits[best] / hits.sum()), float(min(1.0, hits[best] / n))


def fit(docs: DataFrame, sample: int = 4000, bits: int = 21, least_rate: float = 2e-5) -> Model:
    """Learn from text and non-null lang of the documents whose crc32(doc_id) mod 4 is not 2.

    About ``sample`` documents of each language are read, chosen by a hash (all, if it has fewer).
    An n-gram enters a language's slice if it makes up ``least_rate`` of the language's n-grams in
    the sample and occurs twice, so a slice holds at most 1/least_rate of them at every input size,
    and the model, 2**bits slots of a bit for each language, is the same size for any corpus.

    The driver sees one row a language and its slice's n-grams; more than ``LANGUAGES`` languages are
    an error.  Null texts and null langs teach nothing; rows with a null doc_id are in no held-out
    part.  Repeated rows count as often as they come, all or none of them sampled.  Empty input: a
    model without languages.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], bits, [], np.zeros(0), "und")
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample / counts[k])))])
    unit = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k, np.int32)), pa.array(grams.view(np.int64)), pa.array(n)], names=["k", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                for h in ngrams(normal(text.as_py())):
                    held.setdefault(index[lang.as_py()], []).append(h)
                    size += len(h)
                if size > HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    grams = rows.filter(unit < share[F.col("lang")]).mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    with scratch(docs.sparkSession):
        grams = materialize(grams, "grams")
        least = F.create_map(*[x for k, total in grams.groupBy("k").agg(F.sum("n")).collect() for x in (F.lit(k), F.lit(max(2.0, total * least_rate)))] or [F.lit(0), F.lit(2.0)])  # one row a language
        kept = grams.filter(F.col("n") >= least[F.col("k")]).select("k", "gram").toArrow()  # at most 1/least_rate a language
    k, h = kept.column("k").to_numpy(), kept.column("gram").to_numpy().view(np.uint64)
    dtype = np.uint8 if len(languages) <= 8 else np.uint64
    words = [np.zeros(1 << bits, dtype) for _ in range(-(-len(languages) // 64))]
    rate = np.zeros(len(languages))
    for i in range(len(languages)):
        for at in slots(h[k == i], bits):
            words[i // 64][at] |= dtype(1 << (i % 64))
        fill = np.count_nonzero(words[i // 64] & dtype(1 << (i % 64))) / (1 << bits)
        rate[i] = fill**HASHES
    return Model(languages, bits, words, rate, min(languages, key=lambda x: (-counts[x], x)))


def held_out():
    """Whether crc32 of the doc_id as text is 2 mod 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, known) of every whole text.

    ``score`` is the language's share of all languages' corrected hits, ``known`` the share of the
    text's n-grams in its slice.  Null text or one without letters: ``und``, 0, 0.  Letters but no
    n-gram of any language: the language with most labelled rows, score 0.  Ties: the first language
    in code-point order.  Very long texts: whole, in chunks.  Null doc_ids and repeated rows: each its
    own row.  No labelled rows: ``und`` for all.  Other columns are not read, so none clashes.  Empty
    input: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits slots, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "known"])

    return docs.select("doc_id", held_out().alias("h"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, known double")


def keep_identified(docs: DataFrame, model: Model, least_known: float = 0.02) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language.

    Rejected: ``und`` (null and empty texts, texts without letters), and texts of which the best
    language knows less than ``least_known``.  doc_id and the other columns are not read; each row is
    judged alone.  Empty input: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(x.as_py()) for x in batch.column("text")]
            yield batch.filter(pa.array([x[0] != "und" and x[2] >= least_known for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
