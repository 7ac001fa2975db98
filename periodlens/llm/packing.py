"""Pack tokenised documents into sequences by hierarchical residual packing.

Chunks of about ``CHUNK`` pieces are packed best-fit side by side. Nearly full bins are done; every
other bin becomes an item itself, and these items are packed best-fit in chunks again, level by
level, until one chunk is left or a level joins next to nothing. No task ever sees more than a
chunk, and a bin moves as one row, whatever is in it.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.llm.tables import saved, then_freed

LIMIT = 4096
END_ID = 1
CHUNK = 8192
FULL = 0.98
BIG_ENDIAN = sys.byteorder == "big"
#: Words whose ids a worker remembers; with as many new ones, those not met since are forgotten.
KNOWN_WORDS = 1 << 19
#: Words that stay with a worker that rests between tasks: the first met, so mostly frequent ones.
KEPT_WORDS = 1 << 17


class WordEncoder:
    """Token ids of texts, word by word, for a tokenizer that drops white space between words.

    Words are cut at single spaces and newlines only; other white space stays inside and is
    left to the tokenizer. Ids are packed as unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def _learn(self, items: list[str]) -> None:
        for item, e in zip(items, self.tokenizer.encode_batch_fast(items, add_special_tokens=False)):
            self.known[item] = np.array(e.ids, dtype="<u4").tobytes() if BIG_ENDIAN else array("I", e.ids).tobytes()

    def rest(self) -> None:
        """Forget most words between tasks."""
        self.known, self.before = dict(islice(self.known.items(), KEPT_WORDS)), {}

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            text, plain = text.lower(), True  # the tokenizer lowers too; here it is one to one
        except UnicodeEncodeError:
            plain = False
        words = text.replace("\n", " ").split(" ")
        parts = list(map(self.known.get, words))
        if None in parts:
            missing = {w for w, p in zip(words, parts) if p is None}
            if len(self.known) > KNOWN_WORDS:
                self.known, self.before = {"": b""}, self.known
                missing = set(words) - {""}
            again = {w: self.before[w] for w in missing if w in self.before}
            self.known.update(again)
            missing.difference_update(again)
            # A stop or comma after a letter is a token of its own.
            split = {w: w[:-1] for w in missing if plain and w[-1] in ".," and w[-2:-1].isalpha()}
            fresh = {split.get(w, w) for w in missing} | {"." , ","}
            self._learn([w for w in fresh if w not in self.known])
            for w, stem in split.items():
                self.known[w] = self.known[stem] + self.known[w[-1]]
            parts = map(self.known.__getitem__, words)
        return b"".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenise(
    docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID,
    ids: bool = True, rest: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's pieces of at most ``limit`` ids.

    With ``rest`` workers forget most words when a task ends: a little slower, for jobs whose other
    steps need the memory.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Only longer
    documents are cut, into pieces of ``limit`` and a rest. Rows that repeat give their pieces
    again; an empty table gives an empty result.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    fields = [
        T.StructField(id_col, plain.schema["id"].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc, values = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                body = code.encode(value.as_py() or "") + end
                n = len(body) // 4
                for k, at in enumerate(range(0, n, limit)):
                    part = body[4 * at : 4 * (at + limit)]
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        values.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                *[pa.array(v, pa.int64()) for v in (start, length, crc)],
            ]
            if ids:
                columns.append(pa.array(values, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    def rested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then_freed(cut(batches), encoder(path).rest)

    return plain.mapInArrow(rested if rest else cut, T.StructType(fields))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and bin fill of every item: longest first, each into the fullest bin that takes it."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    rooms: list[int] = []  # distinct free sizes, ascending
    with_room: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect_left(rooms, need)
        if at == len(rooms):
            which = len(fill)
            fill.append(0)
        else:
            free = rooms[at]
            which = with_room[free].pop()
            if not with_room[free]:
                del rooms[at], with_room[free]
        bins[i], offsets[i] = which, fill[which]
        fill[which] += need
        left = capacity - fill[which]
        if left:
            if left not in with_room:
                insort(rooms, left)
                with_room[left] = []
            with_room[left].append(which)
    return bins, offsets, np.array(fill, np.int64)[bins] if len(lengths) else bins


def _packed(items: DataFrame, length: str, chunks: int, capacity: int, level: int, names: tuple[str, str, str]) -> DataFrame:
    """``items`` with bin, offset and fill, packed in ``chunks`` chunks dealt by a hash of the row."""
    cell = F.pmod(F.xxhash64(F.lit(level), *items.columns), F.lit(chunks))
    schema = T.StructType([*items.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    columns = items.columns

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.select(columns)
        bins, offsets, fill = best_fit(table.column(length).to_numpy(), capacity)
        ids = (np.int64(level) << 58) | (np.int64(key[0].as_py()) << 24) | bins
        for name, v in zip(names, (ids, offsets, fill)):
            table = table.append_column(name, pa.array(v, pa.int64()))
        return table

    return items.withColumn("_cell", cell).groupBy("_cell").applyInArrow(fit, schema)


def pack(
    pieces: DataFrame, length: str = "length", capacity: int = LIMIT, chunk: int = CHUNK, full: float = FULL,
    late: str = "ids",
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: bins of at most ``capacity``, without gaps.

    Lengths are from 1 to ``capacity``. Rows that repeat are packed one by one. The column ``late``,
    if there is one, stays in its table until the places are final, and crosses one shuffle then.
    """
    if late not in pieces.columns:
        return _places(saved(pieces, "pack-pieces"), length, capacity, chunk, full)
    whole = saved(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    places = saved(_places(whole.drop(late), length, capacity, chunk, full), "pack-places")
    return whole.select("_row", late).join(places, "_row").select(*pieces.columns, "sequence_id", "offset")


def _places(pieces: DataFrame, length: str, capacity: int, chunk: int, full: float) -> DataFrame:
    """``pieces``, a table, with ``sequence_id`` and ``offset``."""
    chunks = max(1, -(-pieces.count() // chunk))
    placed = saved(_packed(pieces, length, chunks, capacity, 0, ("_bin", "_at", "_fill")), "pack-placed")
    open_ = placed.where((F.col("_at") == 0) & (F.col("_fill") < full * capacity)).select(
        F.col("_bin").alias("bin"), F.col("_fill").alias("fill")
    )
    moves, level = None, 0
    while chunks > 1:
        before = open_.count()
        chunks, level = max(1, -(-before // chunk)), level + 1
        step = saved(_packed(open_, "fill", chunks, capacity, level, ("into", "base", "total")), "pack-level")
        heads = step.where(F.col("base") == 0)
        open_ = heads.where(F.col("total") < full * capacity).select(
            F.col("into").alias("bin"), F.col("total").alias("fill")
        )
        here = step.select("bin", "into", "base")
        if moves is None:
            moves = here
        else:
            later = here.select(F.col("bin").alias("_b"), F.col("into").alias("_i"), F.col("base").alias("_s"))
            moves = saved(
                moves.join(later, F.col("into") == F.col("_b"), "left").select(
                    "bin", F.coalesce("_i", "into").alias("into"), (F.col("base") + F.coalesce("_s", F.lit(0))).alias("base")
                ),
                "pack-moves",
            )
        if before - heads.count() <= before // 100:
            break
    if moves is None:
        return placed.select(*pieces.columns, F.col("_bin").alias("sequence_id"), F.col("_at").alias("offset"))
    return placed.join(moves, F.col("_bin") == F.col("bin"), "left").select(
        *pieces.columns,
        F.coalesce("into", "_bin").alias("sequence_id"),
        (F.col("_at") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
