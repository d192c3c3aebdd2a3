"""Personal data: exact base patterns, then bootstrapped contextual extraction.

Seed entities induce lexical patterns (what stands left and right of them, and their shape); a graph of
patterns and instances is scored in rounds; trusted patterns find identifiers that no base pattern
knows.  A pattern is contradicted by instances that fail a check, and by its words' standing elsewhere.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import materialize, scratch, sliced

#: Kinds in the order in which spans of one start are listed; the method adds the last two.
KINDS = ("email", "ip", "card", "phone", "secret", "context")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails from the first digit of a run fails from its others, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}(?![A-Za-z0-9])")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*")
_ORDINARY = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with its whole run of local characters and its domain: one step a character, however long a run."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four base kinds, sorted by start, then kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        if text.count(".") >= 3:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _shape(token: str) -> str:
    """What a token is made of, so that a pattern admits instances of the lengths and letters it was seen with."""
    return ("a" if any(c.isalpha() for c in token) else "") + "9" + ("-" if "-" in token or "_" in token else "")


def _named(s: str) -> str:
    """``s``, or the digest of all of it if it is long."""
    return s if len(s) <= 64 else hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _before(text: str, at: int) -> tuple[str, int]:
    """(what stands left of ``at``, its start): a word in lower case with up to four marks after it,
    ``^`` at a line's start, ``#`` after something with a digit; empty for anything else."""
    j = at
    while j and at - j < 4 and text[j - 1] != "\n" and not (text[j - 1].isalnum() or text[j - 1] == "_"):
        j -= 1
    if not j or text[j - 1] == "\n":
        return "^", j
    k = j
    while k and text[k - 1].isalpha():
        k -= 1
    if k and (text[k - 1].isalnum() or text[k - 1] == "_"):
        return "#" + text[j:at], k
    return (_named(text[k:j].lower()) + text[j:at], k) if k < j else ("", k)


def _after(text: str, at: int) -> str:
    """The marks and the word right of ``at``, in lower case; empty if no whole word is there."""
    j = at
    while j < len(text) and j - at < 4 and text[j] != "\n" and not (text[j].isalnum() or text[j] == "_"):
        j += 1
    k = j
    while k < len(text) and text[k].isalpha():
        k += 1
    if k == j or k < len(text) and (text[k].isalnum() or text[k] == "_"):
        return ""
    return text[at:j] + _named(text[j:k].lower())


def contexts(text: str, a: int, b: int) -> list[str]:
    """What characters ``a`` to ``b`` of ``text`` stand in: one word before, two words before, and what is on both sides."""
    left, k = _before(text, a)
    right = _after(text, b)
    out = []
    if left and left[0] not in "^#":
        out.append(f"1\x1f{left}")
        if further := _before(text, k)[0]:
            out.append(f"2\x1f{further}\x1f{left}")
    if left and right:
        out.append(f"3\x1f{left}\x1f{right}")
    return out


def words_of(context: str) -> list[str]:
    """The words of a context; each has one at least."""
    return [w for part in context.split("\x1f")[1:] if part[0] not in "^#" and (w := re.sub(r"^\W+|\W+$", "", part))]


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str, list[str], str, bool]]:
    """(start, end, instance, contexts, shape, seed) of entities and of identifier-like tokens outside them.

    Identifier-like: six characters or more of letters, digits, ``_`` and inner ``-``, with a digit or a
    ``_``.  An instance is the token, or the digest of a long one.  One pass: spans are sorted.
    """
    taken = sorted([(a, b) for _, a, b in base] + ([m.span() for m in _SECRET.finditer(text)] if len(text) >= 32 else []))
    starts, ends = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    spans = [(a, b, True) for a, b in taken]
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if b - a >= 6 and ("_" in m[0] or any("0" <= c <= "9" for c in m[0])):
            i = bisect.bisect_left(starts, b)
            if not i or ends[i - 1] <= a:
                spans.append((a, b, False))
    return [(a, b, _named(text[a:b]), found, _shape(text[a:b]), seed) for a, b, seed in spans if (found := contexts(text, a, b))]


def count_words(text: str, wanted: frozenset[str] | None, found: Counter[str]) -> None:
    """Adds the words (letters alone, in lower case) of a text to ``found``: those ``wanted``, or all."""
    words = list(map(str.lower, _ORDINARY.findall(text)))
    if max(map(len, words), default=0) > 64:
        words = list(map(_named, words))
    found.update(words if wanted is None else filter(wanted.__contains__, words))


#: A run of as many digits as a card has that fails the check digit: what the scan itself contradicts.
CONTRARY = "instance RLIKE '^[0-9](-?[0-9]){13,18}$' AND NOT luhn_check(replace(instance, '-', ''))"
_MENTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("contexts", pa.list_(pa.string())), ("shape", pa.string()), ("seed", pa.bool_())])
_SPAN = pa.struct([("start", pa.int64()), ("k", pa.int32()), ("end", pa.int64())])
#: Contexts or patterns up to which they go to all executors (some 10 MB); beyond, tables are joined.  The rows are the same.
SENT = 100_000


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _rounds(graph: DataFrame, rounds: int, least_score: float, least_support: int) -> DataFrame:
    """(context, pattern, score) of the patterns that the last round trusts."""
    confident = graph.filter("seed").select("instance").distinct().withColumn("conf", F.lit(1.0))
    for _ in range(rounds):
        known = graph.join(confident, "instance", "left").withColumn("conf", F.when(F.col("seed"), 1.0).when(F.col("contrary"), 0.0).otherwise(F.col("conf")))
        scored = known.groupBy("context", "pattern", "instance").agg(F.max("conf").alias("c"))  # null: neither confirmed nor contradicted
        patterns = scored.groupBy("context", "pattern").agg((F.sum("c") / (F.count("c") + 1)).alias("score"), F.count_if(F.col("c") >= least_score).alias("support"))
        good = materialize(patterns.filter((F.col("support") >= least_support) & (F.col("score") >= least_score)).select("context", "pattern", "score"), "patterns")
        trusted = graph.join(good, ["context", "pattern"]).groupBy("instance").agg(F.max("score").alias("conf"))
        seeds = graph.filter("seed").select("instance", F.lit(1.0).alias("conf"))
        confident = trusted.union(seeds).groupBy("instance").agg(F.max("conf").alias("conf"))
    return good


def _frequencies(docs: DataFrame, words: DataFrame, sent: int) -> DataFrame:
    """(word, total): how often each of ``words(word)`` stands in all texts."""
    few = [r[0] for r in words.limit(sent + 1).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(few) if len(few) <= sent else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                count_words(text.as_py() or "", shared.value, found)
            if len(found) > 200_000:
                yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})
                found.clear()
        if found:
            yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})

    counts = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("total"))
    return materialize(counts.join(words, "word", "left_semi"), "frequencies")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(c, w) for c in batch.column("context").to_pylist() for w in words_of(c)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["context", "word"])


def _graph(docs: DataFrame, rounds: int, least_score: float, least_support: int, least_share: float, sent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned rows, their mentions (a row a context), and the patterns that the last round trusts."""
    schema = "doc_id long, uid long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, own array<struct<start:long,k:int,end:long>>, mentions array<struct<start:long,end:long,instance:string,contexts:array<string>,shape:string,seed:boolean>>"
    rows = materialize(docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text").mapInArrow(_scan, schema), "pii", keep=True)
    graph = rows.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")
    graph = graph.withColumn("contrary", ~F.col("seed") & F.expr(CONTRARY)).withColumn("context", F.explode("contexts")).drop("contexts")
    graph = graph.withColumn("pattern", F.concat("context", F.lit("\x1e"), "shape"))
    # frequencies can only take trust away, so they are counted for contexts that would have it without them
    at_best = materialize(_rounds(graph, rounds, least_score, least_support).select("context").distinct(), "contexts")
    words = materialize(at_best.mapInArrow(_split, "context string, word string"), "words")
    totals = _frequencies(docs, words.select("word").distinct(), sent)
    rarest = words.join(totals, "word").groupBy("context").agg(F.min("total").alias("total"))
    used = graph.join(at_best, "context", "left_semi").groupBy("context").agg(F.count(F.lit(1)).alias("n"))
    open_ = materialize(used.join(rarest, "context").filter(F.col("n") >= least_share * F.col("total")).select("context"), "open")
    good = _rounds(graph.join(open_, "context", "left_semi"), rounds, least_score, least_support)
    return rows, graph, materialize(good, "trusted", keep=True)


def extract(docs: DataFrame, rounds: int = 3, least_score: float = 0.8, least_support: int = 5, least_share: float = 0.5, sent: int = SENT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and ``found`` (array of start, k, end).

    Base entities and long hexadecimal secrets are the seeds.  Their mentions and those of
    identifier-like tokens make a graph of patterns and instances.  A pattern is a context (the word
    before; two words before; what stands on both sides) with the token's shape, an instance the
    token.  Spark scores the graph for ``rounds`` rounds: a pattern by the mean confidence of its
    confirmed and contradicted instances (one pseudo-instance of 0 added), if ``least_support``
    different instances confirm it, and an instance by its best pattern.  Confirmed are seeds and
    instances of trusted patterns, contradicted are card numbers that fail their check digit; an
    instance that is neither says nothing about its pattern.  Negative evidence is where a context's
    words stand besides: the mentions in it must be ``least_share`` of all occurrences, in all texts, of
    its rarest word, so words of general use make no pattern.  Mentions of trusted patterns get the kind ``context``; secrets get ``secret``.  Base spans
    are never changed.

    Only mentions (a few a document) are shuffled, with partial aggregation by pattern and instance.
    Null or empty text: no spans.  Very long texts, words and identifiers: whole, each step linear in
    them.  Repeated rows and null or repeated doc_ids: each its own row; instances count once however
    often they repeat.  Overlapping spans of several kinds all stay.  Other columns are not read, so
    none clashes.  Empty input: empty result.
    """
    with scratch(docs.sparkSession):
        rows, graph, good = _graph(docs, rounds, least_score, least_support, least_share, sent)
    new = graph.filter("NOT seed").join(good, ["context", "pattern"], "left_semi").select("uid", "start", "end").distinct()
    new = new.groupBy("uid").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("context")).alias("k"), "end")).alias("more"))
    full = rows.drop("mentions").join(new, "uid", "left")
    empty = F.array().cast("array<struct<start:long,k:int,end:long>>")
    full = full.withColumn("found", F.array_sort(F.concat("own", F.coalesce("more", empty))))
    kind = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform("found", lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["start"].cast("string"), x["end"].cast("string")))
    return full.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(text, ",").alias("spans"), "found", "uid")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        columns: list[list] = [[] for _ in range(7)]
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            secrets = [] if len(text) < 32 else [("secret", *m.span()) for m in _SECRET.finditer(text)]
            for c, kind in zip(columns, BASE, strict=False):
                c.append(sum(x[0] == kind for x in base))
            columns[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            columns[5].append([{"start": a, "k": KINDS.index(k), "end": b} for k, a, b in base + secrets])
            columns[6].append([dict(zip(("start", "end", "instance", "contexts", "shape", "seed"), m, strict=True)) for m in mentions(text, base)])
        types = (*[pa.int64()] * 4, pa.string(), pa.list_(_SPAN), pa.list_(_MENTION))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "uid", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "own", "mentions"])


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each (start, end, kind) replaced by <KIND>; overlapping spans are replaced as one."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, kind in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, rounds: int = 3, least_score: float = 0.8, least_support: int = 5, least_share: float = 0.5, sent: int = SENT) -> DataFrame:
    """``docs``, all columns, with the found spans of each text replaced; n_chars follows, if there is one.

    The trusted patterns are counted; up to ``sent`` of them are broadcast and a second scan redacts
    each text where it is, else texts and spans meet by row number.  The rows are the same.  Texts
    without spans, null and empty texts stay as they are; repeated doc_ids are no matter; other columns
    pass unread, whatever their names but ``__row``, ``__hit`` and ``__found``.  Empty input: empty result.
    """
    columns = list(docs.columns)

    def rewrite(batch: pa.RecordBatch, spans: Iterator[list[tuple[int, int, str]]]) -> pa.RecordBatch:
        out = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
        found = list(spans)
        texts = [redact(t, f) if f else t for t, f in zip(out["text"].to_pylist(), found, strict=True)]
        if "n_chars" in out:
            out["n_chars"] = pa.array([len(t) if f else n for t, f, n in zip(texts, found, out["n_chars"].to_pylist(), strict=True)], out["n_chars"].type)
        out["text"] = pa.array(texts, out["text"].type)
        return pa.RecordBatch.from_arrays(list(out.values()), names=columns)

    with scratch(docs.sparkSession):
        narrow = docs.select(F.lit(0).cast("long").alias("doc_id"), "text")
        good = _graph(narrow, rounds, least_score, least_support, least_share, sent)[2]
        trusted = {r[0] for r in good.select("pattern").limit(sent + 1).collect()}
    if len(trusted) <= sent:
        patterns = docs.sparkSession.sparkContext.broadcast(frozenset(trusted))

        def spans(text: str | None) -> list[tuple[int, int, str]]:
            text = text or ""
            base = base_spans(text)
            more = [("secret", *m.span()) for m in _SECRET.finditer(text)] if len(text) >= 32 else []
            if patterns.value:
                more += [("context", a, b) for a, b, _, found, shape, seed in mentions(text, base) if not seed and any(f"{c}\x1e{shape}" in patterns.value for c in found)]
            return [(a, b, kind) for kind, a, b in base + more]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                yield rewrite(batch, (spans(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))))

        return docs.mapInArrow(scan, docs.schema)

    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    hits = extract(numbered.select(F.col("__row").alias("doc_id"), "text"), rounds, least_score, least_support, least_share, sent)
    hits = hits.filter(F.size("found") > 0).select(F.col("doc_id").alias("__hit"), F.col("found").alias("__found"))
    joined = numbered.join(hits, F.col("__row") == F.col("__hit"), "left")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = batch.column(batch.schema.get_field_index("__found")).to_pylist()
            yield rewrite(batch, ([(x["start"], x["end"], KINDS[x["k"]]) for x in f or []] for f in found))

    return joined.select(*columns, "__found").mapInArrow(merge, docs.schema)
