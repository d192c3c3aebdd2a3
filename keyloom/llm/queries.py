"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import chat, jaccard, langid, lattice, mixing, pii, quality, tokens
from keyloom.llm.common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    count = chat.tokenizer_count(tokenizer_path("byte_bpe_50k.json"))
    return chat.digest(materialize(chat.format_windows(turns.union(extra), count), "windows", keep=True))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(table(spark, sf_dir, "documents")).drop("found", "uid")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return tokens.read_token_files(manifest)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_language_id": op3_language_id,
    "op4_chat_format": op4_chat_format,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op9_pii": op9_pii,
    "op7_token_files": op7_token_files,
    "op8_packing": op8_packing,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {}

ORACLES["op1_mixing"] = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS most FROM totals),
lv AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level0
  FROM w WINDOW f AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fl AS (SELECT *, level0 * w >= most AS isfull FROM lv),
tg AS (
  SELECT source, source_size,
         CASE WHEN isfull THEN most ELSE max(CASE WHEN NOT isfull THEN level0 END) OVER () * w END AS target,
         ('0x' || substr(md5('17:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM fl),
rk AS (
  SELECT b.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY b.source ORDER BY size, h, doc_id) AS r
  FROM base b JOIN tg t ON b.source IS NOT DISTINCT FROM t.source),
cp AS (SELECT rk.*, least(floor(r * rate + u) - floor((r - 1) * rate + u), ceil(rate))::BIGINT AS copies FROM rk)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM cp
"""

ORACLES["op6_quality"] = quality.judge_sql()

ORACLES["op2_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS reach FROM v UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, m.vec_id) AS component_id,
       coalesce(m.vec_id = coalesce(c.component_id, m.vec_id), true) AS kept
FROM embeddings m LEFT JOIN c ON c.id = m.vec_id LEFT JOIN n ON n.a = m.vec_id
"""

ORACLES["op5_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS id, doc_id AS reach FROM n UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""
