"""TF-IDF, splits, hashing vectors, pooling and feature assembly."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodlens.functions import text as tx
from periodlens.operators.ordered import numbered
from periodlens.session import lookup_join

MAX_FEATURES = 5000


def tfidf_fit(df: DataFrame, text: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """Vocabulary (term, idx, tf, df, idf): the most frequent terms, indexed alphabetically.

    Terms are sorted inside the row, so the first of each run also counts the row once; corpus
    and document frequencies then come from a single aggregation.
    """
    rows = df.where(F.col(text).isNotNull())
    bag = rows.select(F.array_sort(tx.terms(F.col(text))).alias("bag"))
    long = bag.select("bag", F.posexplode("bag").alias("i", "term")).select(
        "term", (F.coalesce(F.get("bag", F.col("i") - 1) != F.col("term"), F.lit(True))).alias("first")
    )
    top = (
        long.groupBy("term")
        .agg(F.count("*").alias("tf"), F.count_if(F.col("first")).alias("df"))
        .orderBy(F.desc("tf"), "term")
        .limit(max_features)
    )
    n = rows.select(F.count("*")).scalar()
    # The window runs over the chosen terms only, at most max_features rows.
    return top.select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
        "tf",
        "df",
        (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"),
    )


def tfidf_weights(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """L2-normalised sparse rows (key, idx[], weight[]).

    Terms outside the vocabulary go before the shuffle; both aggregations share one
    partitioning by the key.
    """
    long = df.select(key, F.explode(tx.terms(F.col(text))).alias("term"))
    known = lookup_join(long, vocabulary.select("term", "idx", "idf"), ["term"])
    cells = (
        known.repartition(key)
        .groupBy(key, "idx", "idf")
        .agg(F.count("*").alias("n"))
        .select(key, "idx", (F.col("n") * F.col("idf")).alias("w"))
    )
    rows = cells.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("c"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
    )
    return rows.select(
        key,
        F.col("c.idx").alias("idx"),
        F.transform("c", lambda c: c["w"] / F.col("norm")).alias("weight"),
    )


def tfidf_model(vocabulary: DataFrame) -> PipelineModel:
    """The same transform as an ML pipeline over a ``terms`` column: no shuffle when applied.

    The vocabulary is bounded by ``max_features``, so it may live on the driver.
    """
    rows = vocabulary.orderBy("idx").collect()
    return PipelineModel(
        [
            CountVectorizerModel.from_vocabulary([r["term"] for r in rows], "terms", "counts"),
            ElementwiseProduct(
                scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="counts", outputCol="scaled"
            ),
            Normalizer(p=2.0, inputCol="scaled", outputCol="features"),
        ]
    )


def tfidf_features(df: DataFrame, text: str, model: PipelineModel) -> DataFrame:
    termed = df.withColumn("terms", F.coalesce(tx.terms(F.col(text)), F.array().cast("array<string>")))
    return model.transform(termed).drop("terms", "counts", "scaled")


def _unit(key: Column, seed: int | str) -> Column:
    """A uniform number in [0, 1) that depends on the key and the seed alone."""
    return tx.digest_number(key, seed) / float(2**48)


def random_split(df: DataFrame, fraction: float, seed: int | str, key: str) -> DataFrame:
    """Split by key: rows with the same key always land on the same side. No shuffle."""
    side = F.when(_unit(F.col(key), seed) < fraction, "train").otherwise("validation")
    return df.withColumn("split", side)


def stratified_split(
    df: DataFrame, fraction: float, seed: int, key: str, label: str, exact: bool = False
) -> DataFrame:
    """Validation share per label; ``exact`` takes exactly ``round(fraction * n)`` keys of each.

    The exact form numbers the keys of a label in hash order. Hashes are spread evenly, so the
    segments of that order are even too and no label is handled by a single task.
    """
    if not exact:
        side = F.when(_unit(F.col(key), seed) < fraction, "validation").otherwise("train")
        return df.withColumn("split", side)
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**40)))
    placed = numbered(hashed, [label], "_h", "_n", tie=[key], segment=2**24, block=2**32)
    sizes = df.groupBy(label).agg(F.round(F.count("*") * fraction).cast("bigint").alias("_take"))
    side = F.when(F.col("_n") <= F.col("_take"), "validation").otherwise("train")
    return lookup_join(placed, sizes, [label], nulls=True).withColumn("split", side).select(*df.columns, "split")


def split_members(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen.select(key).distinct(), key, "left_semi")


def split_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of distinct keys on both sides."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("overlap"))


def hashing_vector(words: Column, dims: int = 64) -> Column:
    """Signed hashing vector of a word list, in the row: word -> one slot, one sign.

    The number of a word is that of ``digest_number``; each distinct word of an Arrow batch is
    hashed once, and the signs of a slot are summed for the whole batch.
    """

    # Slot and sign of a word as one number: 2 * slot, plus 1 for a minus.
    def code(word: str | None) -> int:
        return int(hashlib.md5((word or "").encode()).hexdigest()[:12], 16) % (2 * dims)

    @F.arrow_udf("array<double>")
    def summed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            known = part.drop_null()
            flat = known.flatten().dictionary_encode()
            codes = np.array([code(w) for w in [*flat.dictionary.to_pylist(), None]])
            c = codes[flat.indices.fill_null(len(codes) - 1).to_numpy()]
            slot = np.repeat(np.arange(len(known)), np.diff(known.offsets)) * dims + (c >> 1)
            sums = np.bincount(slot, 1.0 - 2.0 * (c & 1), len(known) * dims)
            rows = pa.ListArray.from_arrays(np.arange(len(known) + 1, dtype="int32") * dims, sums)
            null = part.is_null().to_numpy(zero_copy_only=False)
            yield rows.take(pa.array(np.cumsum(~null) - 1, mask=null))

    return summed(words)


def embed_text(
    df: DataFrame, text: str, encode: Callable[[pd.Series], list] | None = None, dims: int = 64
) -> DataFrame:
    """Add ``vec``: from a user function over Arrow batches, else the hashing vector.

    ``encode`` gets a pandas Series of texts and returns one sequence of floats per text.
    """
    if encode is None:
        vec = hashing_vector(tx.tokenize(F.lower(text)), dims).cast("array<float>")
        return df.withColumn("vec", vec)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(vec=list(encode(part[text])))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(batches, f"{fields}, vec array<float>")


def _vec(col: str) -> Column:
    return array_to_vector(F.col(col).cast("array<double>"))


def masked_mean_pool(df: DataFrame, key: str, vec: str, mask: str | None = None) -> DataFrame:
    """Mean vector of a key's real positions. Vectors are summed in every map task first."""
    rows = df.where(F.col(mask)) if mask else df
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(_vec(vec))).alias("pooled"))


def max_pool(df: DataFrame, key: str, vec: str, mask: str | None = None) -> DataFrame:
    rows = df.where(F.col(mask)) if mask else df
    return rows.groupBy(key).agg(vector_to_array(Summarizer.max(_vec(vec))).alias("pooled"))


def first_position_pool(df: DataFrame, key: str, vec: str, pos: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(vec, pos).alias("pooled"))


def dot(vec: Column, weights: list[float]) -> Column:
    """Dot product of an array column with given weights, inside the row."""
    literal = F.array(*[F.lit(float(w)) for w in weights])
    products = F.zip_with(vec.cast("array<double>"), literal, lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def attention_pool(
    df: DataFrame,
    key: str,
    vec: str,
    score: str,
    mask: str | None = None,
    masked: bool = True,
    epsilon: float | None = None,
) -> DataFrame:
    """Softmax-weighted vector sum per key.

    A softmax pool is a mean weighted by ``exp(score - max)``, which aggregates partially, so a
    key of any size is pooled without collecting it. ``masked=False`` lets padding take part.
    With ``epsilon`` the softmax runs over all positions, padding is zeroed afterwards and the
    rest is divided by its sum plus epsilon.
    """
    real = F.col(mask) if mask else F.lit(True)
    taken = df.where(real) if masked and epsilon is None else df
    tops = taken.groupBy(key).agg(F.max(score).alias("_top"))
    weight = F.exp(F.col(score) - F.col("_top"))
    weighted = lookup_join(taken, tops, [key]).select(
        key, _vec(vec).alias("_vec"), weight.alias("_all"), F.when(real, weight).otherwise(0.0).alias("_real")
    )
    if epsilon is None:
        return weighted.groupBy(key).agg(
            vector_to_array(Summarizer.mean(F.col("_vec"), F.col("_all"))).alias("pooled")
        )
    share = F.sum("_real") / F.sum("_all")
    shares = weighted.groupBy(key).agg((share / (share + epsilon)).alias("f"))
    means = weighted.where(F.col("_real") > 0).groupBy(key).agg(
        vector_to_array(Summarizer.mean(F.col("_vec"), F.col("_real"))).alias("m")
    )
    return means.join(shares, key).select(
        key, F.transform("m", lambda x: x * F.col("f")).alias("pooled")
    )


def pooled_concat(df: DataFrame, key: str, vec: str, score: str, mask: str | None = None) -> DataFrame:
    """Attention, mean and maximum pool of a key behind one another in one array.

    Mean and maximum of a key share one aggregation with the attention pool.
    """
    taken = df.where(F.col(mask)) if mask else df
    tops = taken.groupBy(key).agg(F.max(score).alias("_top"))
    rows = lookup_join(taken, tops, [key]).select(
        key, _vec(vec).alias("_vec"), F.exp(F.col(score) - F.col("_top")).alias("_w")
    )
    return rows.groupBy(key).agg(
        vector_to_array(Summarizer.mean(F.col("_vec"), F.col("_w"))).alias("_a"),
        vector_to_array(Summarizer.mean(F.col("_vec"))).alias("_m"),
        vector_to_array(Summarizer.max(F.col("_vec"))).alias("_x"),
    ).select(key, F.concat("_a", "_m", "_x").alias("pooled"))


def assemble_features(pooled: DataFrame, extra: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Append scalar feature columns to the pooled vector of each key."""
    added = F.array(*[F.col(c).cast("double") for c in columns])
    return pooled.join(extra.select(key, *columns), key).select(
        key, F.concat("pooled", added).alias("features")
    )


def select_feature_columns(df: DataFrame, key: str, features: str, indices: list[int]) -> DataFrame:
    picked = F.array(*[F.get(features, F.lit(i)) for i in indices])
    return df.select(key, picked.alias(features))


def columns_side_by_side(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Columns of two tables next to each other by key instead of by position."""
    return left.join(right, key)


def token_vectors(
    df: DataFrame, key: str, text: str, vectors: DataFrame, dims: int, max_len: int = 50
) -> DataFrame:
    """The first ``max_len`` tokens of a text as vectors, zeros for unknown words and padding.

    The padding of a text travels through the join as one row without a word, spread by a salt.
    """
    # A generated column is worked out once; a lambda would repeat the expression for every place.
    tokens = F.explode(F.array(F.slice(tx.tokenize(F.lower(text)), 1, max_len))).alias("_t")
    none = F.array().cast("array<string>")
    run = F.slice(F.concat(F.coalesce("_t", none), F.array(F.lit(None).cast("string"))), 1, max_len)
    padding = F.col("word").isNull()
    long = (
        df.select(key, tokens)
        .select(key, F.posexplode(run).alias("pos", "word"))
        .withColumn("_salt", F.when(padding, F.xxhash64(key, "pos")).otherwise(F.lit(0)))
    )
    zeros = F.array_repeat(F.lit(0.0), dims)
    known = vectors.select("word", "vec", F.lit(0).cast("bigint").alias("_salt"))
    return lookup_join(long, known, ["word", "_salt"], "left").select(
        key,
        F.explode(F.sequence("pos", F.when(padding, max_len - 1).otherwise(F.col("pos")))).alias("pos"),
        "word",
        F.coalesce(F.col("vec").cast("array<double>"), zeros).alias("vec"),
    )
