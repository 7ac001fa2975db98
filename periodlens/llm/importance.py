"""Choose texts that look like a target sample, by importance resampling.

Hashed one- and two-word counts of the target texts and of all texts give two generative models. A
text's weight is the mean log ratio of its words and word pairs under the two, times
``SHARPNESS``; with Gumbel noise added, the top k are a sample without replacement in proportion
to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.llm import wordhash as wh
from periodlens.llm.tables import saved, uniform

SLOT_BITS = 13
SHARPNESS = 200.0
#: Weight of all texts in the target model, as a part of the target's own counts.
PRIOR = 0.5
BINS = 1024


def _slots(w: wh.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and row of each word, then of each pair of words of a row."""
    row = w.row_of
    pairs = wh.windows(w.hashes, 2)
    inside = wh.in_row(w.first, 2, len(w.hashes))
    hashes = np.concatenate([w.hashes, pairs[inside]])
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([row, row[: len(pairs)][inside]])


def slot_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(slot, raw, target) of (text, wanted), over all rows; ``1 << bits`` rows at most."""
    schema = "slot long, raw long, target long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            wanted = batch.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
            for lo, _, data, offsets in wh.blocks(batch.column("text")):
                slot, row = _slots(wh.words(data, offsets, lower=True), bits)
                raw += np.bincount(slot, minlength=1 << bits)
                target += np.bincount(slot[wanted[lo + row]], minlength=1 << bits)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["slot", "raw", "target"])

    return rows.mapInArrow(count, schema).groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, bits: int) -> np.ndarray:
    """Log of target share over raw share of each slot: ``1 << bits`` numbers."""
    raw, target = np.ones(1 << bits), np.zeros(1 << bits)
    for slot, a, b in counts.collect():
        raw[slot] += a
        target[slot] += b
    raw /= raw.sum()
    if not target.sum():
        return np.zeros(1 << bits)
    # Slots that the target happens not to hold lean on all texts.
    mixed = (target / target.sum() + PRIOR * raw) / (1 + PRIOR)
    return np.log(mixed / raw)


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest of a double column, by counting in ever narrower bins."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if k <= 0 or low is None:
        return float("inf")
    above = 0
    inside = rows
    for _ in range(12):
        if high <= low:
            return low
        cell = F.least(F.lit(BINS - 1), F.floor((F.col(key) - low) / (high - low) * BINS))
        found = {
            r["cell"]: r
            for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        }
        for c in sorted(found, reverse=True):
            if above + found[c]["n"] >= k:
                break
            above += found[c]["n"]
        else:
            return low
        low, high = found[c]["lo"], found[c]["hi"]
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
    return low


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", share: float | None = None,
    bits: int = SLOT_BITS, sharpness: float = SHARPNESS, seed: int = 23,
) -> DataFrame:
    """(id, log_ratio, draw, kept) of every row of ``docs``.

    ``target`` is a table (id, good) of judged rows; the good ones are the target, and ``share``,
    the part of the rows that is kept, is by default the good ones' share of the judged. Texts
    without a word, null ones included, have no ratio and are not kept. Equal rows are drawn
    alike, so ties at the limit stay together. Without a target every ratio is the same.
    """
    judged = target.select(F.col(id_col).alias("id"), F.col("good").cast("boolean").alias("wanted")).where("id is not null")
    judged = saved(judged.groupBy("id").agg(F.coalesce(F.max("wanted"), F.lit(False)).alias("wanted")), "sample-judged")
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The judged ids have no size bound, so they are merged at every size, never broadcast.
    marked = plain.join(judged.where("wanted").hint("merge"), "id", "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    ratios = log_ratios(slot_counts(marked, bits), bits)
    if share is None:
        good, total = judged.agg(F.count_if("wanted"), F.count("*")).first()
        share = good / total if good else 1.0
    shipped = docs.sparkSession.sparkContext.broadcast(ratios)  # 1 << bits numbers
    schema = T.StructType([plain.schema["id"], T.StructField("log_ratio", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            for lo, hi, data, offsets in wh.blocks(batch.column("text")):
                slot, row = _slots(wh.words(data, offsets, lower=True), bits)
                n = np.bincount(row, minlength=hi - lo)
                mean = np.bincount(row, table[slot], hi - lo) / np.maximum(1, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(mean, mask=n == 0)], names=schema.names
                )

    gumbel = -F.log(-F.log(uniform(F.lit(seed), F.col("id")) + 2.0**-54))
    drawn = saved(
        plain.mapInArrow(score, schema).withColumn("draw", F.col("log_ratio") * sharpness + gumbel), "sample-draws"
    )
    filled = drawn.where("draw is not null")
    limit = kth_largest(filled, "draw", round(share * filled.count()))
    return drawn.select(
        F.col("id").alias(id_col), "log_ratio", "draw", F.coalesce(F.col("draw") >= limit, F.lit(False)).alias("kept")
    )
