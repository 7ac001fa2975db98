"""Quality rules: counted rules, then a logistic regression over hashed n-grams.

The classifier sees, for every text, the shares of its hashed words and of its hashed runs of four
bytes. It is fitted on at most about ``fit_rows`` labelled rows, chosen by a hash of the id; a
second, disjoint sample calibrates its scores to probabilities (Platt scaling). Scoring reads a
text once, in Arrow batches, with a weight vector of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.llm import wordhash as wh
from periodlens.llm.tables import saved

BITS = 16
FIT_ROWS = 6000
KEEP_AT = 0.5
MIN_WORDS = 10
REPEAT_PERCENT = 20
# Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


def rule_counts(w: wh.Words) -> dict[str, np.ndarray]:
    """The counts of the rules for each row."""
    n, row_of = len(w.hashes), w.row_of
    letter = ((w.data & 0xC0) != 0x80) & ~wh.IS_SPACE[w.data]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    # Lines: the rows cut at newlines; a line counts if a word starts in it.
    breaks = np.flatnonzero(w.data == 10)
    starts = np.sort(np.concatenate([w.rows[:-1], breaks + 1]))
    owner = np.searchsorted(w.rows[1:], starts, "right")
    # A newline at the very end of a row opens an empty line, which never counts.
    ends = np.minimum(np.append(starts[1:], len(w.data)), w.rows[1:][np.minimum(owner, len(w.rows) - 2)])
    ends = np.where((ends > starts) & (w.data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends)
    filled = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, owner = starts[filled], ends[filled], owner[filled]
    lines = wh.mix(w.span_hashes(starts, ends) ^ wh.mix(owner.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(lines, return_index=True)
    rows = len(w.rows) - 1
    dup = np.bincount(owner, minlength=rows) - np.bincount(owner[first], minlength=rows)
    runs = wh.windows(w.hashes, 5)
    inside = wh.in_row(w.first, 5, n)
    key = wh.mix(runs ^ wh.mix(row_of[: len(runs)].astype(np.uint64) + np.uint64(1)))
    at = np.flatnonzero(inside)
    _, back, count = np.unique(key[at], return_inverse=True, return_counts=True)
    marked = np.zeros(n, bool)
    marked[at[count[back] > 1]] = True
    return {
        "n_words": np.diff(w.first),
        "word_chars": _sums(letter, w.rows),
        "n_symbols": _sums(symbol[w.data], w.rows),
        "n_dup_lines": dup,
        "n_repeat_words": _sums(wh.covered(marked, 5, n), w.first),
    }


def _slots(w: wh.Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature slot of each word, of each run of four bytes, and each row's range of runs."""
    words = (w.hashes >> np.uint64(64 - bits)).astype(np.int64)
    d = w.data.astype(np.uint32)
    if len(d) < 4:
        return words, np.zeros(0, np.int64), np.zeros(len(w.rows), np.int64)
    runs = d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24
    runs = ((runs * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64) + (1 << bits)
    # Runs that reach into the next row belong to neither.
    edges = np.minimum(w.rows, len(runs))
    return words, runs, edges


def _run_ranges(w: wh.Words, n_runs: int) -> tuple[np.ndarray, np.ndarray]:
    start = np.minimum(w.rows[:-1], n_runs)
    return start, np.maximum(start, np.minimum(w.rows[1:] - 3, n_runs))


def features(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(id, label, slots, shares) of (id, text, label): the input of the fit."""
    schema = T.StructType(
        [
            docs.schema["id"], docs.schema["label"],
            T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.DoubleType())),
        ]
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, shares = [], []
            for _, _, data, rows in wh.blocks(batch.column("text"), wh.BLOCK // 4):
                w = wh.words(data, rows)
                words, runs, _ = _slots(w, bits)
                lo, hi = _run_ranges(w, len(runs))
                for r in range(len(rows) - 1):
                    one = words[w.first[r] : w.first[r + 1]]
                    two = runs[lo[r] : hi[r]]
                    s, back = np.unique(np.concatenate([one, two]), return_inverse=True)
                    weight = np.concatenate([np.full(len(one), 1 / max(1, len(one))), np.full(len(two), 1 / max(1, len(two)))])
                    slots.append(s.astype(np.int32))
                    shares.append(np.bincount(back, weight, len(s)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(slots, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))],
                names=schema.names,
            )

    return docs.select("id", "text", "label").mapInArrow(extract, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, bits: int, fit_rows: int):
    """(weights, bias, slope, shift) of the classifier, or None when only one class is labelled.

    ``fit_rows`` bounds the labelled rows read: ids are taken in order of a hash, two thirds for
    the weights and one third for the calibration.
    """
    order = F.xxhash64(F.lit(9), F.col("id"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label")).where(
        "id is not null and label in (0.0, 1.0)"
    )
    sample = known.dropDuplicates(["id"]).orderBy(order, "id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null")
    rows = texts.join(saved(sample, "quality-sample"), "id")
    vector = F.udf(lambda s, v: Vectors.sparse(2 << bits, s, v), VectorUDT())
    table = saved(features(rows, bits), "quality-features").withColumn(
        "x", vector("slots", "shares")
    ).withColumn("held", F.pmod(order, F.lit(3)) == 0)
    train, rest = table.where("not held"), table.where("held")
    if train.select("label").distinct().count() < 2 or rest.select("label").distinct().count() < 2:
        return None
    model = LogisticRegression(featuresCol="x", labelCol="label", maxIter=40, regParam=1e-5, standardization=False).fit(train)
    weights, bias = model.coefficients.toArray(), float(model.intercept)
    raw = model.transform(rest).select("label", F.udf(lambda v: Vectors.dense([v[1]]), VectorUDT())("rawPrediction").alias("raw"))
    platt = LogisticRegression(featuresCol="raw", labelCol="label", maxIter=50, regParam=1e-6, standardization=False).fit(raw)
    return weights, bias, float(platt.coefficients[0]), float(platt.intercept)


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
    bits: int = BITS, fit_rows: int = FIT_ROWS, keep_at: float = KEEP_AT,
) -> DataFrame:
    """(id, the rule counts, base_failed, kept, quality) of every row of ``docs``.

    ``quality`` is the calibrated probability that a text is good. Null texts have no words, fail
    the rules and are not kept. Without labels of both classes every probability is 1, so the
    rules decide alone. Rows are judged one by one; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text, label, bits, fit_rows)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, plain.schema["id"].dataType),
            *[T.StructField(c, T.LongType()) for c in COUNTS],
            T.StructField("base_failed", T.BooleanType()),
            T.StructField("kept", T.BooleanType()),
            T.StructField("quality", T.DoubleType()),
        ]
    )
    # A vector of 2 << bits numbers, whatever the table's size.
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shipped.value
        for batch in batches:
            for lo, hi, data, rows in wh.blocks(batch.column(1), wh.BLOCK // 2):
                w = wh.words(data, rows)
                counts = rule_counts(w)
                n = counts["n_words"]
                failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * n)
                if fitted is None:
                    p = np.ones(hi - lo)
                else:
                    weights, bias, slope, shift = fitted
                    words, runs, _ = _slots(w, bits)
                    a, b = _run_ranges(w, len(runs))
                    sums = np.concatenate([np.zeros(1), np.cumsum(weights[runs])])
                    raw = bias + _sums(weights[words], w.first) / np.maximum(1, n) + (sums[b] - sums[a]) / np.maximum(1, b - a)
                    p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        *[pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                        pa.array(failed),
                        pa.array(~failed & (p >= keep_at)),
                        pa.array(p),
                    ],
                    names=schema.names,
                )

    return plain.mapInArrow(score, schema)
