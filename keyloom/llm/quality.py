"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Base counts of each whole text, then cutoffs on rates of them.  The cutoffs of all rules are tightened
along one fixed path, a step at a time from lax to strict, so the documents that a step rejects only
grow.  In each stratum the path is followed as far as labelled good documents certify it: with k of
n of them rejected, the exact binomial tail P(Bin(n, ALPHA) <= k) must be at most DELTA divided by
the number of strata (Bonferroni; along a path of growing rejections testing in a fixed order needs
no correction of its own).  Then, with probability 1 - DELTA, no stratum loses more than ``ALPHA`` of
its good documents that pass the base rule, whatever the other documents are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import materialize, null_safe_join, scratch

ALPHA = 0.03
DELTA = 0.05
_WS = " \\t\\n\\u000b\\u000c\\r"  # Spark SQL escapes; it has none for a form feed but \\u

#: name -> (rate as SQL over the base counts, +1 if high rates are bad or -1, cutoffs from lax to strict)
RULES: dict[str, tuple[str, int, tuple[float, ...]]] = {
    "symbols": ("n_symbols / cast(greatest(word_chars, 1) as double)", 1, (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05)),
    "long_words": ("word_chars / cast(greatest(n_words, 1) as double)", 1, (30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.5, 7.0)),
    "short_words": ("word_chars / cast(greatest(n_words, 1) as double)", -1, (1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0, 3.25, 3.5)),
    "dup_lines": ("n_dup_lines / cast(greatest(n_lines, 1) as double)", 1, (0.9, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35)),
    "repeats": ("n_repeat_words / cast(greatest(n_words, 1) as double)", 1, (0.5, 0.48, 0.46, 0.44, 0.42, 0.4, 0.38, 0.36, 0.34, 0.32, 0.3)),
}
#: The path: step -> (rule, cutoff).  Each round tightens every rule by one cutoff.
PATH = [(rule, RULES[rule][2][i]) for i in range(max(len(cuts) for _, _, cuts in RULES.values())) for rule in RULES if i < len(RULES[rule][2])]


def first_step(cast: str = "double") -> str:
    """SQL of the first step (from 1) of the path that rejects a document; null if none does."""
    cases = []
    for rule, (rate, way, _) in RULES.items():
        when = " ".join(f"WHEN {rate} {'>' if way > 0 else '<'} {cut!r} THEN {i}" for i, (own, cut) in enumerate(PATH, 1) if own == rule)
        cases.append(f"coalesce(CASE {when} END, {len(PATH) + 1})")
    return f"nullif(least({', '.join(cases)}), {len(PATH) + 1})".replace("as double", f"as {cast}")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    Each text stays in its row: no shuffle.  Windows of 3 words that may repeat are found by sorting
    hashes whose low bits are replaced by the position, so equal windows are neighbours; those are
    sorted by their words, which alone decide, at every length.  A word is counted once however many
    repeated windows hold it.
    """
    t = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    t = t.selectExpr("doc_id", "lang", "t", f"btrim(t, '{_WS}') AS s")
    t = t.selectExpr(
        "doc_id", "lang", "t",
        "CASE WHEN s = '' THEN cast(array() AS array<string>) ELSE split(s, '[\\\\x20\\\\x09-\\\\x0D]+') END AS w",
        f"filter(split(t, '\\n'), l -> btrim(l, '{_WS}') <> '') AS lines",
    )
    t = t.selectExpr(
        "doc_id", "lang", "cast(size(w) AS bigint) AS n_words", "cast(length(array_join(w, '')) AS bigint) AS word_chars",
        "cast(regexp_count(t, '[#*$%&|<>]') AS bigint) AS n_symbols",
        "cast(size(lines) - size(array_distinct(lines)) AS bigint) AS n_dup_lines", "cast(size(lines) AS bigint) AS n_lines",
        "length(bin(size(w))) AS b",
        "w", "transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))) AS h",
    )
    kept = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    t = t.selectExpr(*kept, "w", "b", "sort_array(transform(h, (x, i) -> shiftleft(shiftright(x, b), b) | cast(i AS bigint))) AS z")
    same = "shiftright(x, b) = shiftright(get(z, k {}), b)"
    t = t.selectExpr(*kept, "w", f"transform(filter(z, (x, k) -> {same.format('- 1')} OR {same.format('+ 1')}), x -> cast(x & (shiftleft(1L, b) - 1L) AS int)) AS p")
    t = t.selectExpr(*kept, "sort_array(transform(p, i -> named_struct('a', get(w, i), 'b', get(w, i + 1), 'c', get(w, i + 2), 'i', i))) AS q")
    same = "x.a = get(q, k {0}).a AND x.b = get(q, k {0}).b AND x.c = get(q, k {0}).c"
    t = t.selectExpr(*kept, f"sort_array(transform(filter(q, (x, k) -> coalesce({same.format('- 1')}, false) OR coalesce({same.format('+ 1')}, false)), x -> cast(x.i AS bigint))) AS p")
    return t.selectExpr(*kept, "aggregate(transform(p, (x, k) -> least(3L, coalesce(get(p, k + 1) - x, 3L))), 0L, (a, x) -> a + x) AS n_repeat_words")


def _tail(n: Column, k: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), exactly summed with terms in logarithms."""
    odds = math.log(risk) - math.log1p(-risk)
    first = (n * F.lit(math.log1p(-risk))).cast("double")

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))
    ks = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(ks, start, step)["sum"]


def certified_steps(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, steps): how far along the path each stratum's labelled good documents certify it.

    ``labelled`` holds (stratum, first), ``first`` being the step that rejects the document or null.
    A histogram of at most ``len(PATH) + 1`` rows a stratum is all that the tests see.
    """
    counts = labelled.groupBy("stratum", "first").agg(F.count(F.lit(1)).alias("c"))
    stratum = Window.partitionBy("stratum")
    strata = labelled.agg(F.countDistinct(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("null"))).alias("m"))
    rows = counts.withColumn("n", F.sum("c").over(stratum)).filter("first IS NOT NULL")
    rows = rows.withColumn("k", F.sum("c").over(stratum.orderBy("first")))
    none = counts.groupBy("stratum").agg(F.sum("c").alias("n")).select("stratum", F.lit(0).alias("first"), "n", F.lit(0).cast("long").alias("k"))
    tests = none.union(rows.select("stratum", "first", "n", "k")).join(F.broadcast(strata))  # one row
    likely = F.col("k") <= F.col("n") * alpha  # beyond, the tail is near a half or more
    passed = F.when(likely, _tail(F.col("n"), F.when(likely, F.col("k")).otherwise(F.lit(0)), alpha) <= F.lit(delta) / F.col("m")).otherwise(F.lit(False))
    failed = tests.withColumn("passed", passed).groupBy("stratum").agg(F.min(F.when(~F.col("passed"), F.col("first"))).alias("failed"))
    return failed.select("stratum", F.greatest(F.coalesce(F.col("failed") - 1, F.lit(len(PATH))), F.lit(0)).alias("steps"))


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Base counts, base_failed and kept of every document; then ``first_step`` and its stratum's ``steps``.

    Strata are languages.  Good documents are those labelled quality 1 (the least of several labels
    of a doc_id; null labels count as none) that pass the base rule.  A stratum without enough of
    them (about 144 of four strata at the defaults) has no cutoff: nothing is rejected there beyond
    ``base_failed``.  Null or empty text: all counts 0, base_failed.  Very long texts: whole, in their
    row; counts are exact.  Null lang: a stratum of its own.  Repeated rows and doc_ids: each its own
    row.  A rate equal to a cutoff passes it.  Other columns are not read, so none clashes.  Empty
    input: empty result.
    """
    with scratch(docs.sparkSession):
        counts = base_counts(docs).withColumnRenamed("lang", "stratum")
        counts = counts.withColumns({"base_failed": F.expr(BASE_FAILED), "first": F.expr(first_step())})
        counts = materialize(counts, "quality", keep=True)
        good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("good_id")).agg(F.min("quality").alias("q")).filter("q = 1")
        labelled = counts.filter("NOT base_failed").join(good, F.col("doc_id") == F.col("good_id"), "left_semi").select("stratum", "first")
        steps = materialize(certified_steps(labelled, alpha, delta), "steps", keep=True)
    full = null_safe_join(counts, steps, ["stratum"], "left").withColumn("steps", F.coalesce("steps", F.lit(0)))
    beyond = F.coalesce(F.col("first") <= F.col("steps"), F.lit(False))
    return full.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~beyond).alias("kept"), F.col("first").alias("first_step"), "steps")


def judge_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """DuckDB SQL for the rows of ``judge`` over documents and labels."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT uid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT uid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT uid, i FROM g QUALIFY count(*) OVER (PARTITION BY uid, gram) > 1),
rep AS (SELECT uid, count(DISTINCT j) AS n FROM (SELECT uid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY uid),
ln AS (SELECT uid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup
       FROM (SELECT uid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY uid),
c AS (SELECT d.doc_id, d.lang AS stratum, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
       len(regexp_extract_all(d.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(ln.dup, 0)::BIGINT AS n_dup_lines,
       coalesce(ln.n_lines, 0)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (uid) LEFT JOIN ln USING (uid) LEFT JOIN rep USING (uid)),
f AS (SELECT *, {BASE_FAILED} AS base_failed, {first_step("DOUBLE")}::INT AS first_step FROM c),
good AS (SELECT * FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
n AS (SELECT stratum, count(*) AS n FROM good GROUP BY stratum),
tests AS (SELECT n.stratum, s AS step, n.n, (SELECT count(*) FROM good g WHERE g.stratum IS NOT DISTINCT FROM n.stratum AND g.first_step <= s) AS k, (SELECT count(*) FROM n) AS m
          FROM n, range(0, {len(PATH) + 1}) t(s)),
passed AS (SELECT *, k <= n * {alpha!r} AND list_sum(list_transform(range(0, least(k, ceil(n * {alpha!r})::BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
       + j * ln({alpha!r}) + (n - j) * ln(1 - {alpha!r})))) <= {delta!r} / m AS ok FROM tests),
steps AS (SELECT stratum, greatest(coalesce(min(step) FILTER (NOT ok) - 1, {len(PATH)}), 0)::INT AS steps FROM passed GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(first_step <= steps, false) AS kept, first_step, coalesce(steps, 0) AS steps
FROM f LEFT JOIN steps ON f.stratum IS NOT DISTINCT FROM steps.stratum
"""
