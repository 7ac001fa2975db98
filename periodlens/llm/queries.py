"""Named queries of the operators in this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodlens.llm import (
    importance, jaccard, language, lines, merkle, mixing, nearest, packing, quality, secrets, spans, vectors, whitening,
)
from periodlens.llm.manifest_sql import documents_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language, learned from two thirds of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, carry=["doc_id"])
    return found.select(
        "row.doc_id", language.held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log ratio of good to all texts, its draw, and whether it is kept."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return importance.resample(docs, good)


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of three-word shingles and its class at 90 %."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.overlap_classes(docs, width=3, num=90, den=100)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines it loses and a digest of the text it keeps."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the spans of its secrets."""
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in secrets.STRONG],
        F.sha2(secrets.listed(F.col("strong")), 256).alias("base_sha256"),
        secrets.listed(F.sort_array(F.concat("strong", "linked"))).alias("spans"),
    )


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and its class."""
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that earlier documents hold and a digest of the others."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its rule counts and the classifier's verdict."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.tokenise(docs, tokenizer_path(), ids=False)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's four leading whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id 100 divides."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(nearest.build(rows), rows.where("vec_id % 100 = 0"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof, folded from a tampered text where 5 divides its id's checksum."""
    docs = _table(spark, sf_dir, "documents").select(*merkle.DOCUMENT)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return merkle.verify_documents(docs, changed).drop("siblings")


OP4_SQL = """
WITH ws AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM ws WHERE len(w) >= 13),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM win),
marked AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM keyed) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM marked),
per AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM ws),
kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS t
  FROM word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT ws.doc_id, len(ws.w) AS n_words, coalesce(len(per.g), 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM ws LEFT JOIN per ON per.doc_id = ws.doc_id LEFT JOIN kept ON kept.doc_id = ws.doc_id
"""

OP8_SQL = """
WITH line AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
filled AS (
  SELECT doc_id, i, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS t FROM line),
numbered AS (
  SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o FROM filled WHERE t <> ''),
win AS (
  SELECT doc_id, o, concat(t, chr(10), lead(t) OVER d, chr(10), lead(t, 2) OVER d) AS k, lead(t, 2) OVER d AS third
  FROM numbered WINDOW d AS (PARTITION BY doc_id ORDER BY o)),
later AS (
  SELECT doc_id, o FROM (
    SELECT doc_id, o, row_number() OVER (PARTITION BY k ORDER BY doc_id, o) AS r FROM win WHERE third IS NOT NULL)
  WHERE r > 1),
gone AS (SELECT DISTINCT l.doc_id, n.i FROM later l JOIN numbered n ON n.doc_id = l.doc_id AND n.o BETWEEN l.o AND l.o + 2),
res AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed,
       sha256(coalesce(r.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN res r ON r.doc_id = d.doc_id
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_secret_scan, op3_vector_dedup, op4_span_dedup, op5_language_id, op6_importance_resampling,
        op7_shingle_join, op8_line_dedup, op9_quality_rules,
        op10_best_fit_packing, op11_whitening, op12_nearest_neighbours, op13_merkle_manifest,
    )
}
ORACLES = {"op4_span_dedup": OP4_SQL, "op8_line_dedup": OP8_SQL, "op13_merkle_manifest": documents_sql()}
