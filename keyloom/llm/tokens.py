"""Tokenizing on executors: cached encoding, Arrow token files, best-fit packing, token attribution.

Encoding is by the tokenizers library.  For the two pre-tokenizers supported here no token crosses
the start of a run of white space, nor the place between a letter and a full stop or comma, so a
text's ids are those of its words joined; words repeat, and each is encoded once a worker.  Texts
with other white space than single spaces and newlines are cut into segments (a white-space run and
the word after it) instead.  The cache is cleared at ``CACHE_WORDS`` entries, which bounds a worker's
memory and changes no result.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import distributed_rank, fresh_path, materialize, partitions, scratch

CACHE_WORDS = 800_000
CACHED_CHARS = 48
#: Token files that one task reads again: what it returns of each is small.
SHARDS_A_TASK = 4

#: White space as Unicode's White_Space has it (Python's ``\s`` has U+001C to U+001F besides).
SEGMENT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+\Z")
_ODD_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]*)")
#: Beyond these, lower case by Python and by the tokenizer may differ.
_NO_LOWER = re.compile(r"[\u0130\u0250-\U0010ffff]")


def byte_alphabet() -> list[str]:
    """The characters by which byte-level models write the bytes 0 to 255: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class _Words(dict):
    """word -> ids after ``lead``; encodes what it lacks."""

    def __init__(self, encoder: Encoder, lead: str) -> None:
        self.encoder, self.lead = encoder, lead

    def __missing__(self, word: str) -> bytes:
        return self.encoder._word(word, self, self.lead)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; one a worker, file and choice.

    A special token's string in a text gets that token's id, as the library has it by default;
    ``special_as_text`` takes it as ordinary text.
    """

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        #: Strings that lower case must not bring about: only as written do they name a token.
        self.special = [] if special_as_text else [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.lower = self.tokenizer.normalizer is not None
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_alphabet()))
        self.space = self.letters[32]
        self.after_space = _Words(self, "" if self.lower else " ")
        self.alone = _Words(self, "")
        self.stops: dict[str, bytes] = {}
        self.spans: dict[str, tuple[int, bytes, bytes]] = {}

    @classmethod
    def of(cls, path: str, special_as_text: bool = False) -> Encoder:
        if (path, special_as_text) not in cls._made:
            cls._made[path, special_as_text] = cls(path, special_as_text)
        return cls._made[path, special_as_text]

    def _whole(self, text: str) -> bytes:
        return self.pack(*self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model(self, word: str) -> bytes:
        """Ids of what is one pre-token for certain."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        elif word[0] == " ":
            word = self.space + word[1:]
        return self.pack(*[t.id for t in self.model.tokenize(word)])

    @staticmethod
    def pack(*ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str, cache: dict[str, bytes], lead: str) -> bytes:
        """Ids of a word after ``lead``, from the model by way of its letters and its stops."""
        m = _PLAIN.fullmatch(word)
        if not m:
            ids = self._whole(lead + word)
        elif m[2]:
            stops = self.stops.get(m[2])
            if stops is None:
                stops = self.stops[m[2]] = self._model(m[2])
            ids = cache[m[1]] + stops
        else:
            ids = self._model(lead + word)
        if len(word) <= CACHED_CHARS:
            cache[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.after_space) + len(self.alone) > CACHE_WORDS:
            self.after_space.clear()
            self.alone.clear()
            self.stops.clear()
        alone, after_space = self.alone.__getitem__, self.after_space.__getitem__
        if self.lower:
            if _ODD_SPACE.search(text) or not text.isascii() and _NO_LOWER.search(text):
                return b"".join(map(self._whole, SEGMENT.findall(text)))
            lowered = text.lower()
            if any(x in lowered for x in self.special):
                return b"".join(map(self._whole, SEGMENT.findall(text)))
            return b"".join(map(after_space, lowered.split()))
        if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text):
            return b"".join(map(alone, SEGMENT.findall(text)))
        newline, out = alone("\n"), []
        for line in text.split("\n"):
            words = line.split(" ")
            if out:
                out.append(newline)
            out.append(alone(words[0]))
            out.extend(map(after_space, words[1:]))
        return b"".join(out)

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last code point of each token of ``text``."""
        segments = SEGMENT.findall(text)
        if len(self.spans) > CACHE_WORDS:
            self.spans.clear()
        new = list(set(segments).difference(self.spans))
        rare: dict[str, tuple[int, bytes, bytes]] = {}
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for x, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                span = np.array(e.offsets, dtype="<i8").reshape(-1, 2)
                (self.spans if len(x) <= CACHED_CHARS else rare)[x] = (len(span), span[:, 0].tobytes(), span[:, 1].tobytes())
        found = [rare[x] if x in rare else self.spans[x] for x in segments] if rare else list(map(self.spans.__getitem__, segments))
        counts, firsts, lasts = zip(*found, strict=True) if found else ((), (), ())
        size = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        base = np.repeat(np.cumsum(size) - size, np.array(counts, dtype=np.int64))
        return np.frombuffer(b"".join(firsts), dtype="<i8") + base, np.frombuffer(b"".join(lasts), dtype="<i8") + base


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch, texts one at a time."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


# ---------------------------------------------------------------------------------------------
# Token files


def write_token_files(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 0, folder: str | None = None, special_as_text: bool = False) -> DataFrame:
    """Tokenize ``docs(doc_id, text)`` into Arrow files in ascending doc_id order.

    Rows are range-partitioned by doc_id; partition k writes ``shard-k.arrow``, whose record batches
    hold ``ids`` (fixed-size lists of ``seq_len`` unsigned integers, 16 bits where the vocabulary
    allows) and ``mask`` (fixed-size lists of booleans: false on the padding of the shard's last
    sequence), and ``shard-k.docs.arrow`` with doc_id and n_tokens of its documents in order.  Equal
    sizes and no compression give zero-copy random access: sequence i is row i mod batch size of
    batch i div batch size of the memory-mapped file.  Files are written beside their names and
    renamed, so a retried or speculative task replaces a whole file or none.

    Null or empty text: the end id alone.  Very long texts: whole, one at a time a worker.  Null
    doc_ids come last; repeated doc_ids and rows are documents of their own, ordered by a hash of the
    text, then the text, over all shards.  Other columns are not read, so none clashes.  Empty input:
    no files.  ``folder`` needs a URI that pyarrow.fs opens on executors; the default is in
    spark.checkpoint.dir.  The files are the output and stay; only the caller deletes them.

    Returns the manifest (shard, path, n_docs, n_tokens), one row a file, written as one Parquet file:
    the JVM may start processes for each that it creates, so not one for each row.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    n = partitions(spark)
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    keys = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    dealt = narrow.repartitionByRange(n, *keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first()).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = Encoder.of(tokenizer, special_as_text)
        dtype = np.dtype("<u2" if encoder.vocab_size <= 1 << 16 else "<u4")
        files = _Shard(folder, shard, seq_len, dtype)
        for batch in batches:
            for doc_id, text in _rows(batch, "doc_id", "text"):
                ids = np.frombuffer(encoder.ids(text), dtype="<u4").astype(dtype)
                files.add(doc_id, np.append(ids, np.array([end_id], dtype)))
        if files.docs:
            files.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": pa.array([files.path]), "n_docs": pa.array([files.docs], pa.int64()), "n_tokens": pa.array([files.tokens], pa.int64())})

    return materialize(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long").repartition(1), "manifest")


class _Shard:
    """Writes one shard's two files in a stream; holds less than ``BATCH`` sequences."""

    BATCH = 128

    def __init__(self, folder: str, shard: int, seq_len: int, dtype: np.dtype) -> None:
        from pyarrow import fs

        self.path = f"{folder}/shard-{shard:06d}"
        self.fs, self.place = fs.FileSystem.from_uri(self.path)
        self.fs.create_dir(os.path.dirname(self.place), recursive=True)
        self.mark, self.seq_len, self.dtype = f".{uuid.uuid4().hex}", seq_len, dtype
        value = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", value, nullable=False), seq_len)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), seq_len))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.out = None
        self.held: list[np.ndarray] = []
        self.waiting = self.docs = self.tokens = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.out is None:
            self.streams = [self.fs.open_output_stream(f"{self.place}{x}{self.mark}") for x in (".arrow", ".docs.arrow")]
            self.out, self.index = pa.ipc.new_file(self.streams[0], self.schema), pa.ipc.new_file(self.streams[1], self.index_schema)
        self.held.append(ids)
        self.waiting += len(ids)
        self.docs += 1
        self.tokens += len(ids)
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        if self.waiting >= self.BATCH * self.seq_len:
            self._flush()
        if len(self.ids) >= 10_000:
            self._flush_index()

    def _flush(self, last: bool = False) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        step = self.BATCH * self.seq_len
        at = 0
        while len(flat) - at >= step:
            self._write(flat[at : at + step], step)
            at += step
        flat = flat[at:]
        if last and len(flat):
            whole = -(-len(flat) // self.seq_len) * self.seq_len
            self._write(np.concatenate([flat, np.zeros(whole - len(flat), self.dtype)]), len(flat))
            flat = flat[:0]
        self.held, self.waiting = [flat], len(flat)

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in ((flat, self.schema.field(0)), (mask, self.schema.field(1)))]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def _flush_index(self) -> None:
        self.index.write_batch(pa.record_batch([pa.array(self.ids, pa.int64()), pa.array(self.sizes, pa.int64())], schema=self.index_schema))
        self.ids, self.sizes = [], []

    def close(self) -> None:
        self._flush(last=True)
        self._flush_index()
        for writer in (self.out, self.index, *self.streams):
            writer.close()
        for x in (".docs.arrow", ".arrow"):
            self.fs.move(f"{self.place}{x}{self.mark}", f"{self.place}{x}")


def read_sequence(path: str, i: int, batch_rows: int = _Shard.BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``i`` of a local shard, without reading or copying the others."""
    from pyarrow import fs

    _, place = fs.FileSystem.from_uri(path)
    file = pa.ipc.open_file(pa.memory_map(place + ".arrow"))
    batch = file.get_batch(i // batch_rows)
    row = i % batch_rows
    return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values.to_numpy(zero_copy_only=False)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone.

    ``start`` counts the tokens of all documents before it: the shards before (a prefix sum over the
    manifest, one row a shard) and those before it in its shard.  Tasks read ``SHARDS_A_TASK`` files
    that follow each other, one batch of sequences at a time.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start in _rows(batch, "path", "start"):
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_file(place + ".arrow") as a, files.open_input_file(place + ".docs.arrow") as b:
                    data, index = pa.ipc.open_file(a), pa.ipc.open_file(b)
                    flat, k = np.zeros(0, "<u4"), 0
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        sizes = docs.column(1).to_numpy()
                        crcs = np.zeros(len(sizes), np.int64)
                        for j, size in enumerate(sizes):
                            crc, need = 0, int(size)
                            while need:
                                if not len(flat):
                                    rows = data.get_batch(k)
                                    flat, k = rows.column(0).flatten().to_numpy().astype("<u4"), k + 1
                                crc = zlib.crc32(flat[:need].tobytes(), crc)
                                need, flat = need - len(flat[:need]), flat[need:]
                            crcs[j] = crc
                        ends = start + np.cumsum(sizes)
                        yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(ends - sizes), docs.column(1), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start = int(ends[-1]) if len(ends) else start

    tasks = -(-partitions(manifest.sparkSession) // SHARDS_A_TASK)
    return placed.repartitionByRange(tasks, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


# ---------------------------------------------------------------------------------------------
# Best-fit packing


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, special_as_text: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents' ids with the end id, cut only beyond ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, special_as_text)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in _rows(batch, "doc_id", "text"):
                ids = encoder.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Segment tree over remaining capacities 0..n: which have open bins, and the tightest that fits."""

    def __init__(self, n: int) -> None:
        self.base = 1 << n.bit_length()
        self.any = bytearray(2 * self.base)

    def set(self, capacity: int, open_: bool) -> None:
        i = self.base + capacity
        self.any[i] = open_
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The smallest open capacity of ``least`` or more; -1 if there is none."""
        i = self.base + least
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return -1


def pack_plan(counts: dict[int, int], capacity: int = 4096) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths: rows (length, first rank, n, first bin, per bin, offset).

    Documents of one length are alike, so one step of the plan stands for a run of them: documents
    ``first rank`` to ``first rank + n - 1`` (from 0) of that length fill the bins from ``first bin``,
    ``per bin`` in each, from ``offset``.  That is where best-fit puts them one by one: a bin that
    has just taken one is the tightest for the next while it still fits.  The plan's size follows
    from the number of distinct lengths, not of documents.
    """
    tree = CapacityTree(capacity)
    spans: dict[int, list[tuple[int, int]]] = {}
    steps: list[tuple[int, ...]] = []
    bins = 0

    def open_(left: int, first: int, n: int) -> None:
        if n and left:
            spans.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left < 0:
                left, q = capacity, capacity // length
                first, n = bins, -(-todo // q)
                bins += n
            else:
                q = left // length
                first, n = spans[left].pop()
                if not spans[left]:
                    tree.set(left, False)
            used = min(todo, n * q)
            full, part = divmod(used, q)
            steps.append((length, rank, used, first, q, capacity - left))
            open_(left - q * length, first, full)
            if part:
                open_(left - part * length, first + full, 1)
            open_(left, first + full + bool(part), n - full - bool(part))
            rank, todo = rank + used, todo - used
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, special_as_text: bool = False) -> DataFrame:
    """Best-fit-decreasing packing of all documents into sequences of at most ``capacity`` tokens.

    One pass encodes and cuts; the histogram of lengths (at most ``capacity`` rows) goes to the
    driver, which plans for the whole corpus; ranks within a length are distributed, and each piece
    finds its step by binary search in the broadcast plan.  Global best fit, no per-partition bins.

    Null or empty text: a piece of the end id alone.  Very long texts: cut into pieces, none dropped.
    Null and repeated doc_ids: each row a document, packed as often as it comes.  Ties in length are
    ranked by doc_id and piece.  Other columns are not read, so none clashes.  Empty input: empty
    result.  Rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    with scratch(spark):
        cut = materialize(pieces(docs, tokenizer, capacity, end_id, special_as_text), "pieces")
        ranked = materialize(distributed_rank(cut, ["length"], ["doc_id", "piece"], "_rank"), "ranked", keep=True)
    counts = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(pack_plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = plan.value
        order = np.lexsort((steps[:, 1], -steps[:, 0]))
        steps = steps[order]
        most = int(steps[:, 2].sum()) + 1 if len(steps) else 1
        keys = (capacity - steps[:, 0]) * most + steps[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            own = steps[np.searchsorted(keys, (capacity - length) * most + rank - 1, side="right") - 1]
            k = rank - 1 - own[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(own[:, 3] + k // own[:, 4]), pa.array(own[:, 5] + k % own[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


# ---------------------------------------------------------------------------------------------
# Token attribution


def line_sections(text: str) -> list[int]:
    """Starts of the lines of a text; a line ends after its newline."""
    starts = [0]
    at = text.find("\n") + 1
    while 0 < at < len(text):
        starts.append(at)
        at = text.find("\n", at) + 1
    return starts


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; ``sections`` are the sections' starts, from 0.

    A token that crosses a boundary goes, by ``rule``, to the section of its first character
    (``start``), of its last (``end``), or to the one that holds most of it, the earlier of equals (``most``).
    """
    first = np.searchsorted(sections, starts, side="right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(sections, np.maximum(ends - 1, starts), side="right") - 1
    if rule == "end":
        return last
    best, held = first.copy(), np.zeros(len(starts), np.int64)
    bounds = np.append(sections, np.iinfo(np.int64).max)
    for k in range(int((last - first).max(initial=0)) + 1):
        at = np.minimum(first + k, last)
        inside = np.minimum(ends, bounds[at + 1]) - np.maximum(starts, bounds[at])
        best, held = np.where(inside > held, at, best), np.maximum(held, inside)
    return best


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "start", sections=line_sections, special_as_text: bool = False) -> DataFrame:
    """Tokens of each section of each document: (doc_id, section, start, end, n_tokens).

    Whole texts are encoded once with character offsets; an interval join (binary search of section
    starts, both sides sorted) maps tokens to sections, boundary-crossing ones by ``rule`` (see
    ``attribute``), so the sections of a document always add up to its tokens.  Offsets are code
    points, ``end`` exclusive.  Null or empty text: one section 0 of no characters and no tokens.
    Very long texts: whole, one at a time a worker.  Null and repeated doc_ids and repeated rows: each
    row is counted as often as it comes.  Other columns are not read, so none clashes.  Empty input:
    empty result.  No shuffle.
    """
    if rule not in ("start", "end", "most"):
        raise ValueError(f"rule must be start, end or most, not {rule}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, special_as_text)
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            ids: list[int | None] = []
            for doc_id, text in _rows(batch, "doc_id", "text"):
                text = text or ""
                bounds = np.array(sections(text), np.int64)
                held = np.bincount(attribute(*encoder.offsets(text), bounds, rule), minlength=len(bounds))
                ids += [doc_id] * len(bounds)
                for column, x in zip(out[1:], (np.arange(len(bounds)), bounds, np.append(bounds[1:], len(text)), held), strict=True):
                    column.append(x)
            if ids:
                arrays = [pa.array(ids, pa.int64()), *(pa.array(np.concatenate(x).astype(np.int64)) for x in out[1:])]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "start", "end", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, section long, start long, end long, n_tokens long")
