"""The registered queries of this subpackage and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, read_table
from . import kdtree, packing, personal, pieces, quality, quotes, simhash, suffixtree, toxicity, warc
from .common import bucket


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity.train(docs, toxicity.trainable(read_table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, field)
    return found.select("doc_id", F.coalesce(bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "toxic_tokens", "toxic_spans")


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.conversations(read_table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "role", "position", "parent_turn", "root_turn", "n_passages", "max_depth", "n_linked", "n_other_conv", F.md5(F.col("clean_text").cast("binary")).alias("text_md5"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, model, ("n_ids", "ids_crc32", "parity", "round_trip")).drop("text")


def op4_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    made = materialize(personal.candidates(docs).drop("text"), "personal-candidates")
    found = personal.choose(made, personal.train(made))
    counts = [personal.count(F.col("base"), k).alias(f"n_{k}") for k in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), personal.listed(F.col("found")).alias("spans"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.language_model(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(spark, warc.archive(read_table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM w
"""


def op7_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read_table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.rules(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(c.split()[0] for c in quality.OUTPUT.split(", ") if c.split()[0] not in ("js_characters", "js_words", "kept")), "kept", "js_characters", "js_words")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can say."""
    return op8_quality(spark, sf_dir).drop("kept", "js_characters", "js_words")


QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"quality_base": quality_base}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op7_kdtree": OP7_SQL, "quality_base": QUALITY_BASE_SQL}
