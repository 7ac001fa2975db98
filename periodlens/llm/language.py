"""Language of texts by interpolated Kneser-Ney character models.

A text becomes lower-case letters with single spaces between words. Runs of four characters are
counted per language over all training texts; lower orders count how many different characters
precede a run. The models are kept as sorted arrays of run keys with log probabilities and back-off
weights, all of them, in parts that are shipped and loaded one by one. A text gets the language of
the lowest cross-entropy per character. Texts that fit their best language far worse than its
training texts do are marked as rejected.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.llm.tables import discard, saved, then_freed

ORDER = 4
CLASS_BITS = 12
#: Entries of a part of the model: what the driver gathers at a time. No entry is left out.
PART = 1 << 20
#: Entries of the parts that a task keeps loaded; they go when it ends.
LOADED = 1 << 23
REJECT_AT = 8.0
#: Runs of a training text that a language's limits are taken from.
LONG = 50
BLOCK_CHARS = 1 << 18
#: Characters that are looked up together, so that parts are loaded once for many texts.
TOGETHER = 1 << 20
#: Distinct runs that a task counts before it hands them on.
TALLY = 1 << 20
EDGE = 1
SPACE = 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its class of ``CLASS_BITS`` bits."""
    points = np.arange(0x32000)
    letter = np.array([chr(p).isalpha() for p in points])
    folded = (points ^ (points >> CLASS_BITS) * 0x9D) & ((1 << CLASS_BITS) - 1)
    # Classes of high code points stay clear of the marks for an edge and a space.
    return letter, np.where((points >= 1 << CLASS_BITS) & (folded <= SPACE), folded + 64, folded)


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the runs of ``ORDER`` characters, row of each, letters per row)."""
    letter, classes = _letters()
    mark = "\x02"
    joined = "".join(mark + t.replace(mark, " ").lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    edge = points == 2
    points = np.minimum(points, len(letter) - 1)
    is_letter = letter[points]
    row = np.cumsum(edge) - 1
    letters = np.bincount(row[is_letter], minlength=len(texts))
    code = np.where(edge, EDGE, np.where(is_letter, classes[points], SPACE)).astype(np.int64)
    gap = code <= SPACE
    keep = np.ones(len(code), bool)
    keep[1:] = ~((code[1:] == SPACE) & gap[:-1])
    code, row = code[keep], row[keep]
    # Edges fill up the context of the first characters of a row.
    times = np.where(code == EDGE, ORDER - 1, 1)
    code, row = np.repeat(code, times), np.repeat(row, times)
    n = len(code) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    keys = np.zeros(n, np.int64)
    for j in range(ORDER):
        keys = keys << CLASS_BITS | code[j : n + j]
    real = code[ORDER - 1 :] != EDGE
    return keys[real], row[ORDER - 1 :][real], letters


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    start, texts, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= BLOCK_CHARS:
            yield start, texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, texts


class _Tally:
    """Counts of keys; ``add`` merges, so memory follows the distinct keys."""

    def __init__(self):
        self.keys, self.counts, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray) -> None:
        code, distinct = pd.factorize(keys)
        self.waiting.append((distinct, np.bincount(code, minlength=len(distinct))))
        if sum(len(k) for k, _ in self.waiting) > max(1 << 18, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
        counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
        code, self.keys = pd.factorize(keys)
        self.counts = np.bincount(code, counts, len(self.keys)).astype(np.int64)
        self.waiting = []


def count_runs(rows: DataFrame) -> DataFrame:
    """(lang, g, c) of (lang, text): how often each run occurs in each language."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("g", T.LongType()), T.StructField("c", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, _Tally] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, tally in tallies.items():
                tally.merge()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(tally.keys), pa.string()), pa.array(tally.keys), pa.array(tally.counts)], names=schema.names
                )
            tallies.clear()

        for batch in batches:
            names = batch.column("lang").to_pylist()
            for start, texts in _blocks(batch.column("text")):
                keys, row, _ = runs(texts)
                lang, which = pd.factorize(np.array(names[start : start + len(texts)], object))
                of = lang[row]
                for k, name in enumerate(which):
                    tallies.setdefault(name, _Tally()).add(keys[of == k])
                if sum(len(t.keys) for t in tallies.values()) > TALLY:
                    yield from flush()
        yield from flush()

    return rows.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "g").agg(F.sum("c").alias("c"))


_loaded: OrderedDict[int, tuple[Broadcast, int]] = OrderedDict()


def _unload() -> None:
    for number in [*_loaded]:
        old, _ = _loaded.pop(number)
        if hasattr(old, "_path"):  # else it can't be read again
            old.__dict__.pop("_value", None)


def _load(shipped: Broadcast, size: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The part ``shipped`` of ``size`` entries; parts not used for longest make room for it."""
    _loaded[id(shipped)] = (shipped, size)
    _loaded.move_to_end(id(shipped))
    while len(_loaded) > 1 and sum(n for _, n in _loaded.values()) > LOADED:
        old, _ = _loaded.popitem(last=False)[1]
        if hasattr(old, "_path"):  # else it can't be read again
            old.__dict__.pop("_value", None)
    return shipped.value


class Model:
    """Sorted arrays per language and order: run keys with log2 p, context keys with log2 weight.

    ``tables`` has the parts of each table (language, order, whether of contexts), dealt by the
    remainder of the key, as numbers of ``shipped``; ``sizes`` has the entries of what is shipped.
    """

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.tables: dict[tuple[str, int, bool], list[int]] = {}
        self.shipped: list[Broadcast] = []
        self.sizes: list[int] = []

    def ship(self, table: DataFrame, order: int, contexts: bool, key: str, value: str, part: int) -> None:
        """Broadcast ``table``; a part has about ``part`` entries of one or of several languages."""
        parts: list[tuple[list[str], int, int]] = []
        small, room = [], 0
        for lang, n in sorted(tuple(r) for r in table.groupBy("lang").count().collect()):
            if n > part:
                of = -(-n // part) | 1  # odd, so that every bit of a key counts
                parts += [([lang], of, i) for i in range(of)]
                continue
            if n > room:
                small, room = [], part
                parts.append((small, 1, 0))
            small.append(lang)
            room -= n
        for langs, of, i in parts:
            arrays = _arrays(table.where(F.col("lang").isin(langs) & (F.col(key) % of == i)), key, value)
            for lang in langs:
                self.tables.setdefault((lang, order, contexts), []).append(len(self.shipped))
            self.shipped.append(table.sparkSession.sparkContext.broadcast(arrays))
            self.sizes.append(sum(len(k) for k, _ in arrays.values()))

    def _find(self, lang: str, order: int, contexts: bool, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, whether there is one) of every key in ``wanted``."""
        out, hit = np.zeros(len(wanted)), np.zeros(len(wanted), bool)
        numbers = self.tables.get((lang, order, contexts), [])
        part = wanted % max(1, len(numbers))
        for i, number in enumerate(numbers):
            to = np.flatnonzero(part == i)
            if not len(to) or lang not in (arrays := _load(self.shipped[number], self.sizes[number])):
                continue
            keys, values = arrays[lang]
            at = np.minimum(np.searchsorted(keys, wanted[to]), len(keys) - 1)
            hit[to] = keys[at] == wanted[to]
            out[to] = np.where(hit[to], values[at], 0.0)
        return out, hit

    def log2(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """log2 p of the last character of each run given the others."""
        out, weight = np.zeros(len(keys)), np.zeros(len(keys))
        todo = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            own = keys[todo] & ((1 << (CLASS_BITS * order)) - 1)
            value, hit = self._find(lang, order, False, own)
            out[todo[hit]] = weight[todo[hit]] + value[hit]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                return out
            weight[todo] += self._find(lang, order, True, own >> CLASS_BITS)[0]
        out[todo] = weight[todo] - CLASS_BITS  # below single characters every class is as likely
        return out


def _level(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, g, h, c, own) and (lang, h, c, weight) of one order from its (lang, g, c)."""
    discount = grams.groupBy("lang").agg(
        F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")
    ).select("lang", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("d"))
    with_d = grams.join(discount, "lang").withColumn("h", F.shiftright("g", CLASS_BITS))
    contexts = with_d.groupBy("lang", "h").agg(
        F.sum("c").alias("total"), F.count("*").alias("kinds"), F.max("d").alias("d")
    )
    own = with_d.join(contexts.select("lang", "h", "total"), ["lang", "h"]).select(
        "lang", "g", "h", "c", ((F.col("c") - F.col("d")) / F.col("total")).alias("own")
    )
    weight = F.col("d") * F.col("kinds") / F.col("total")
    return own, contexts.select("lang", "h", F.col("total").alias("c"), weight.alias("weight"))


def _arrays(table: DataFrame, key: str, value: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    got = table.select("lang", key, value).toArrow()
    langs, keys = np.array(got.column("lang").to_pylist(), object), got.column(key).to_numpy()
    logs = np.log2(got.column(value).to_numpy()).astype(np.float32)
    out = {}
    for lang in set(langs):
        at = np.flatnonzero(langs == lang)
        at = at[np.argsort(keys[at])]
        out[lang] = (keys[at], logs[at])
    return out


def train(rows: DataFrame, part: int = PART) -> Model:
    """Models of every language of (lang, text), with every run and context.

    The driver gathers them in parts of about ``part`` entries, and only names of languages whole.
    """
    counts = {ORDER: saved(count_runs(rows), "lang-runs")}
    for order in range(ORDER - 1, 0, -1):
        mask = (1 << (CLASS_BITS * order)) - 1
        shorter = counts[order + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit(mask)).alias("g"))
        counts[order] = saved(shorter.agg(F.count("*").alias("c")), "lang-runs")
    model = Model(sorted(r[0] for r in counts[1].select("lang").distinct().collect()))
    lower, done = None, []
    for order in range(1, ORDER + 1):
        own, weights = _level(counts[order])
        weights = saved(weights, "lang-weights")
        done.append(weights)
        if lower is None:
            below = own.withColumn("low", F.lit(2.0**-CLASS_BITS))
        else:
            mask = (1 << (CLASS_BITS * (order - 1))) - 1
            suffix = lower.select("lang", F.col("g").alias("s"), F.col("p").alias("low"))
            below = own.withColumn("s", F.col("g").bitwiseAND(F.lit(mask))).join(suffix, ["lang", "s"])
        lower = saved(
            below.join(weights.drop("c"), ["lang", "h"]).select(
                "lang", "g", "c", (F.col("own") + F.col("weight") * F.col("low")).alias("p")
            ),
            "lang-model",
        )
        done.append(lower)
        model.ship(lower, order, False, "g", "p", part)
        model.ship(weights, order, True, "h", "weight", part)
    for table in [*done, *counts.values()]:
        discard(table)
    return model


def _scored(docs: DataFrame, text: str, label: Column, model: Model, carry: list[str]) -> DataFrame:
    """(row, label, pred, score, ce, n) of every row; ``row`` holds the columns ``carry``."""
    row = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    plain = docs.select(row.alias("row"), F.col(text).alias("text"), label.alias("label"))
    schema = T.StructType(
        [
            plain.schema["row"], T.StructField("label", T.StringType()), T.StructField("pred", T.StringType()),
            T.StructField("score", T.DoubleType()), T.StructField("ce", T.DoubleType()), T.StructField("n", T.LongType()),
        ]
    )

    names = np.array([*model.languages, UNKNOWN], object)

    def judged(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
        which, distinct = pd.factorize(np.concatenate([own for *_, own in waiting]))
        which = np.split(which, np.cumsum([len(own) for *_, own in waiting])[:-1])
        runs_of = [np.bincount(row, minlength=len(letters)) for _, _, letters, row, _, _ in waiting]
        all_ce = [np.zeros((len(n), len(model.languages))) for n in runs_of]
        for k, lang in enumerate(model.languages):
            logs = model.log2(lang, distinct)
            for ce, n, to, (_, _, _, row, code, _) in zip(all_ce, runs_of, which, waiting):
                ce[:, k] = -np.bincount(row, logs[to][code], len(n)) / np.maximum(1, n)
        for ce, n, (carried, labels, letters, *_) in zip(all_ce, runs_of, waiting):
            known = (letters > 0) & bool(model.languages)
            best = ce.argmin(axis=1) if model.languages else np.zeros(len(n), np.int64)
            least = ce.min(axis=1) if model.languages else np.zeros(len(n))
            # The share of the best language if up to 20 characters spoke for themselves.
            share = 1 / np.maximum(1, np.exp2((least[:, None] - ce) * np.minimum(n, 20)[:, None]).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    carried, labels, pa.array(names[np.where(known, best, -1)], pa.string()),
                    pa.array(np.where(known, share, 0.0)), pa.array(least), pa.array(n),
                ],
                names=schema.names,
            )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for start, texts in _blocks(batch.column("text")):
                keys, row, letters = runs(texts)
                code, distinct = pd.factorize(keys)
                here = [batch.column(c).slice(start, len(texts)) for c in ("row", "label")]
                waiting.append((*here, letters, row.astype(np.int32), code.astype(np.int32), distinct))
                size += len(keys)
                if size >= TOGETHER:
                    yield from judged(waiting)
                    waiting, size = [], 0
        if waiting:
            yield from judged(waiting)

    return plain.mapInArrow(lambda batches: then_freed(score(batches), _unload), schema)


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: a third, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    part: int = PART, reject_at: float = REJECT_AT, carry: list[str] | None = None,
) -> DataFrame:
    """(row, lang_pred, score, cross_entropy, rejected) of every row; ``row`` holds its columns.

    ``carry`` names the columns that ``row`` holds, all by default. Given names, the scores are
    kept in a table; otherwise texts are scored a second time rather than written once more.

    Learned from the rows that are not held out and have a text and a language; language and id
    are never inputs of a prediction. Texts that are null or without a letter are ``und``, score 0,
    and rejected. Other texts are rejected when their cross-entropy lies ``reject_at`` deviations
    above the mean of their language's training texts; the deviation allows for short texts. A
    language without longer training texts takes the mean and deviation of all languages.
    Repeated rows are judged one by one; an empty table gives an empty result.
    """
    learn = ~held_out(id_col) & F.col(text).isNotNull() & F.col(lang).isNotNull()
    model = train(docs.where(learn).select(F.col(lang).alias("lang"), F.col(text).alias("text")), part)
    label = F.when(learn, F.col(lang))
    kept = saved(_scored(docs, text, label, model, carry or []), "lang-scored")
    right = kept.where(F.col("label") == F.col("pred"))
    limits = [F.avg("ce").alias("mean"), F.coalesce(F.stddev_pop("ce"), F.lit(0.0)).alias("spread")]
    fits = right.where(F.col("n") >= LONG).groupBy("pred").agg(*limits)
    # A language without longer texts takes the limits of all longer ones, or else of all texts.
    pooled = right.where(F.col("n") >= LONG).agg(*limits).first()
    if pooled["mean"] is None:
        pooled = right.agg(*limits).first()
    limit = {c: F.coalesce(F.col(c), F.lit(pooled[c]).cast("double")) for c in ("mean", "spread")}
    allowed = (limit["spread"] + 0.02) * F.sqrt(1 + 200 / F.col("n")) * reject_at
    fits = saved(fits, "lang-fits")
    if carry is None:
        discard(kept)
        kept = _scored(docs, text, label, model, docs.columns)
    return kept.join(fits, "pred", "left").select(
        "row",
        F.col("pred").alias("lang_pred"),
        "score",
        F.col("ce").alias("cross_entropy"),
        ((F.col("pred") == UNKNOWN) | F.coalesce(F.col("ce") > limit["mean"] + allowed, F.lit(False))).alias("rejected"),
    )
