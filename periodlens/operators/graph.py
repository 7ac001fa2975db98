"""Word co-occurrence graphs per period and the two event detectors on top of them.

A graph is an edge table (MatchID, PeriodID, a, b, w) with ``a < b``. No matrix is built.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.functions import text as tx
from periodlens.operators.rows import dedup
from periodlens.session import lookup_join

PERIOD = ["MatchID", "PeriodID"]
# The recorded best settings of the deviation detector.
DEVIATION_WINDOW = 12
DEVIATION_THRESHOLD = 1.06


def graph_posts(
    posts: DataFrame, scope: str = "MatchID", anchored: bool = False, nan_token: bool = False
) -> DataFrame:
    """Cleaned posts, each distinct text kept once per match at its first row.

    Empty texts are dropped, or become the word ``nan`` with ``nan_token``.
    """
    text = tx.clean_graph(F.col("Tweet"), anchored)
    if nan_token:
        text = F.coalesce(F.when(F.length(text) > 0, text), F.lit("nan"))
    # A generated column is worked out once; a filter on the expression would repeat it.
    text = F.explode(F.array(text)).alias("Preprocessed_Tweet")
    cleaned = posts.select("row_id", *PERIOD, text)
    return dedup(cleaned.where(F.length("Preprocessed_Tweet") > 0), ["Preprocessed_Tweet"], "row_id", [scope])


def _token_units(clean: DataFrame) -> DataFrame:
    units = F.sort_array(F.array_distinct(tx.tokenize(F.col("Preprocessed_Tweet"))))
    return clean.select("row_id", *PERIOD, units.alias("units")).withColumn("n_units", F.size("units"))


def _char_units(clean: DataFrame) -> DataFrame:
    """Units are the characters that occur as one-character words of the match.

    The divisor counts every distinct character of the text, the space included.
    """
    words = clean.select("MatchID", F.explode(tx.tokenize(F.col("Preprocessed_Tweet"))).alias("w"))
    single = (
        words.where(F.char_length("w") == 1).groupBy("MatchID").agg(F.collect_set("w").alias("single"))
    )
    chars = F.array_distinct(F.regexp_extract_all("Preprocessed_Tweet", F.lit("(?s)."), F.lit(0)))
    return (
        lookup_join(clean, single, ["MatchID"])
        .select("row_id", *PERIOD, chars.alias("chars"), "single")
        .select(
            "row_id",
            *PERIOD,
            F.sort_array(F.array_intersect("chars", "single")).alias("units"),
            F.size("chars").alias("n_units"),
        )
    )


def word_pairs(clean: DataFrame, unit: str = "token") -> DataFrame:
    """Every unordered pair of distinct units of a post with weight ``1 / number of units``.

    Both generators run inside the row, so pairs are streamed into the next aggregation; a
    post of any length is taken whole.
    """
    units = {"token": _token_units, "char": _char_units}[unit](clean)
    return (
        units.select(
            "row_id", *PERIOD, "units", "n_units", F.posexplode("units").alias("i", "a")
        )
        .select(
            "row_id",
            *PERIOD,
            "a",
            F.explode(F.slice("units", F.col("i") + 2, F.size("units"))).alias("b"),
            (F.lit(1.0) / F.col("n_units")).alias("w"),
        )
    )


def edge_list_per_tweet(clean: DataFrame, unit: str = "token") -> DataFrame:
    return word_pairs(clean, unit).select("row_id", "a", "b")


def placed_pairs(clean: DataFrame, unit: str = "token", pairs_per_task: int = 1_000_000) -> DataFrame:
    """(MatchID, PeriodID, a, b, w): the pairs of ``word_pairs``, all of one left word of a match
    in one partition.

    A post travels as one row per left word with the words right of it, and turns into pairs
    behind the shuffle: a pair costs one word there instead of two words, a key and a weight. All
    steps that group by match and left word, whatever else is in their key, need no further
    shuffle. The number of partitions follows the number of pairs of words, so that the sums of a
    task stay in memory.
    """
    units = {"token": _token_units, "char": _char_units}[unit](clean)
    right = F.array_join(F.slice("units", F.col("i") + 2, F.size("units")), " ")
    return (
        units.select(*PERIOD, "units", "n_units", F.posexplode("units").alias("i", "a"))
        .where(F.col("i") + 1 < F.size("units"))
        .select(*PERIOD, "a", right.alias("right"), "n_units")
        .repartition(1 + int(pair_count(clean) // pairs_per_task), "MatchID", "a")
        .select(*PERIOD, "a", F.explode(F.split("right", " ")).alias("b"), (F.lit(1.0) / F.col("n_units")).alias("w"))
    )


def pair_count(clean: DataFrame) -> float:
    """Number of pairs of words in all posts, before repeated words of a post are dropped."""
    text = F.col("Preprocessed_Tweet")
    n = F.char_length(text) - F.char_length(F.replace(text, F.lit(" "))) + 1
    return clean.agg(F.sum(n.cast("double") * (n - 1) / 2)).first()[0] or 0


# One character stands for a frequent word: first those of one byte in UTF-8, then of two and of
# three. "=" marks a word that has none.
CODES = [chr(c) for c in (*range(0x21, 0x3D), *range(0x3E, 0x7F), *range(0xA1, 0xD800)) if not chr(c).isspace()]


def _packed(codes: dict[str, str], entries_per_block: int):
    """Rows (MatchID, a, right) of all posts of a block: ``right`` has a line per post that holds ``a``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, dict[str, list[str]]] = {}
        n = 0

        def out() -> pa.RecordBatch:
            rows = [(m, a, "\n".join(v)) for m, own in held.items() for a, v in own.items()]
            types = [pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["MatchID", "a", "right"])

        for batch in batches:
            for match, period, text, size in zip(*(batch.column(c).to_pylist() for c in ("MatchID", "PeriodID", "text", "n_units"))):
                words = text.split(" ")
                if len(words) < 2:
                    continue
                own = held.setdefault(match, defaultdict(list))
                head = f"{'' if period is None else period} {size} "
                # Codes ascend as words get rarer, so the left word is the rarer one of a pair.
                known = "".join(sorted([codes.get(w, "") for w in words]))
                for i in range(1, len(known)):
                    own[known[i]].append(head + known[:i])
                if len(known) < len(words):
                    right = head + known
                    for k, word in enumerate(sorted([w for w in words if w not in codes])):
                        if known or k:
                            own["=" + word].append(right)
                        right += "\t=" + word
                n += len(words)
                if n >= entries_per_block:
                    yield out()
                    held, n = {}, 0
        if n:
            yield out()

    return pack


def _packed_posts(
    clean: DataFrame, units: DataFrame, pairs_per_task: int, n_codes: int, entries_per_block: int
) -> DataFrame:
    """(MatchID, a, right) of posts as ``units``, all of one left word of a match in one partition."""
    words = clean.select(F.explode(F.split("Preprocessed_Tweet", " ")).alias("word")).groupBy("word").count()
    top = words.orderBy(F.desc("count"), "word").limit(min(n_codes, len(CODES))).collect()
    codes = {r["word"]: c for r, c in zip(top, CODES)}
    packed = units.select(*PERIOD, F.array_join("units", " ").alias("text"), "n_units").mapInArrow(
        _packed(codes, entries_per_block), "MatchID int, a string, right string"
    )
    return packed.repartition(1 + int(pair_count(clean) // pairs_per_task), "MatchID", "a")


def coded_pairs(
    clean: DataFrame, unit: str = "token", pairs_per_task: int = 1_000_000, n_codes: int = len(CODES),
    entries_per_block: int = 1 << 19,
) -> DataFrame:
    """(MatchID, PeriodID, a, b, w) as ``placed_pairs`` for steps that only tell pairs apart: ``a``
    and ``b`` are codes of words, and the left word is the rarer one.

    The ``n_codes`` most frequent words become one character each, all others stay words behind
    a "=". So a pair costs one character in the shuffle, mostly of one or two bytes, and the posts
    of a block that share a left word travel as one row. The list of codes has a fixed size and
    goes to the tasks. A frequent word is right of nearly all others, so that it makes no long task.
    """
    units = {"token": _token_units, "char": _char_units}[unit](clean)
    coded, others = F.split(F.col("words")[0], ""), F.slice("words", 2, F.size("words"))
    b = F.when(F.size("words") == 1, coded).when(F.col("words")[0] == "", others).otherwise(F.concat(coded, others))
    return (
        _packed_posts(clean, units, pairs_per_task, n_codes, entries_per_block)
        .select("MatchID", "a", F.explode(F.split("right", "\n")).alias("post"))
        .select("MatchID", "a", F.split("post", " ", 3).alias("post"))
        .select(
            "MatchID",
            F.col("post")[0].try_cast(clean.schema["PeriodID"].dataType).alias("PeriodID"),
            "a",
            (F.lit(1.0) / F.col("post")[1].cast("int")).alias("w"),
            F.split(F.col("post")[2], "\t").alias("words"),
        )
        .select(*PERIOD, "a", F.explode(b).alias("b"), "w")
    )


@dataclass
class PackedPairs:
    """The pairs of ``coded_pairs``, left packed by left word: who takes them makes and sums them in arrays."""

    clean: DataFrame
    unit: str = "token"
    pairs_per_task: int = 4_000_000
    n_codes: int = len(CODES)
    entries_per_block: int = 1 << 19

    def ranked(self, ranks: DataFrame) -> DataFrame:
        """(MatchID, a, right) in the order of left words; the lines of ``right`` have ranks in place of periods."""
        units = {"token": _token_units, "char": _char_units}[self.unit](self.clean)
        units = lookup_join(units, ranks.select(*PERIOD, "rank"), PERIOD).drop("PeriodID").withColumnRenamed("rank", "PeriodID")
        packed = _packed_posts(self.clean, units, self.pairs_per_task, self.n_codes, self.entries_per_block)
        return packed.sortWithinPartitions("MatchID", "a")


#: Right words without a code are numbered from here, above all characters.
UNCODED = 0x110000


def _numbers(u: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The decimal numbers that stand at ``start`` to ``end`` of the characters ``u``."""
    out, width = np.zeros(len(start), np.int64), end - start
    for k in range(int(width.max(initial=0))):
        on = width > k
        out[on] = out[on] * 10 + u[start[on] + k] - ord("0")
    return out


def _unpacked(right: pa.Array, others: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``right``, right word, rank, weight) of all pairs; ``others`` numbers the words without a code."""
    text = "\n".join(right.to_pylist())
    u = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32)
    cut, space, tab = (np.flatnonzero(u == ord(c)) for c in "\n \t")
    start, end = np.r_[0, cut + 1], np.r_[cut, len(u)]
    rank_end, size_end = space[::2], space[1::2]
    rank, weight = _numbers(u, start, rank_end), 1.0 / _numbers(u, rank_end + 1, size_end)
    row = np.repeat(np.arange(len(right)), pc.count_substring(right, "\n").to_numpy(zero_copy_only=False) + 1)
    first, stop = size_end + 1, end.copy()
    lines, at = np.unique(np.searchsorted(end, tab), return_index=True)
    stop[lines] = tab[at]
    size = stop - first
    line = np.repeat(np.arange(len(start)), size)
    b = u[np.arange(len(line)) + np.repeat(first - np.cumsum(size) + size, size)]
    if len(lines):
        words = [text[s:e].split("\t") for s, e in zip((stop[lines] + 1).tolist(), end[lines].tolist())]
        line = np.r_[line, np.repeat(lines, [len(w) for w in words])]
        b = np.r_[b, np.array([others.setdefault(w, UNCODED + len(others)) for own in words for w in own], np.int32)]
    return row[line], b, rank[line], weight[line]


def _cells(group: np.ndarray, b: np.ndarray, rank: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weights summed per group, right word and rank, in that order."""
    n_b, n_rank = int(b.max(initial=0)) + 1, int(rank.max(initial=0)) + 1
    low = int(group.min(initial=0))
    if (int(group.max(initial=0)) - low + 1) * n_b * n_rank < 1 << 63:
        order = np.argsort(((group - low) * n_b + b) * n_rank + rank)
    else:
        order = np.lexsort((rank, b, group))
    group, b, rank = group[order], b[order], rank[order]
    at = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (b[1:] != b[:-1]) | (rank[1:] != rank[:-1])][: len(group)])
    return group[at], b[at], rank[at], np.add.reduceat(w[order], at) if len(at) else w[:0]


def sum_pairs(pairs: DataFrame | PackedPairs) -> DataFrame | PackedPairs:
    """Pair weights summed per period. The key holds the pair, so a busy period spreads out.

    Packed pairs stay packed: whoever unpacks them sums them first.
    """
    if isinstance(pairs, PackedPairs):
        return pairs
    return pairs.groupBy(*PERIOD, "a", "b").agg(F.sum("w").alias("w"))


def cooccurrence_edges(clean: DataFrame, unit: str = "token") -> DataFrame:
    return sum_pairs(placed_pairs(clean, unit))


def period_graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges and total weight per period; nodes are counted from distinct endpoints."""
    sizes = edges.groupBy(*PERIOD).agg(F.count("*").alias("n_edges"), F.sum("w").alias("weight"))
    nodes = (
        edges.select(*PERIOD, F.explode(F.array("a", "b")).alias("node"))
        .distinct()
        .groupBy(*PERIOD)
        .agg(F.count("*").alias("n_nodes"))
    )
    return sizes.join(nodes, PERIOD)


def period_rank(posts: DataFrame, order: str = "period") -> DataFrame:
    """Position of each existing period in its match, by number or by first appearance.

    Posts collapse to one row per period first; the window sees the periods of a match only.
    """
    periods = posts.groupBy(*PERIOD).agg(F.min("row_id").alias("first_row"))
    by = {"period": "PeriodID", "first_seen": "first_row"}[order]
    rank = F.row_number().over(Window.partitionBy("MatchID").orderBy(by))
    return periods.select(*PERIOD, rank.alias("rank"))


def ranked_edges(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    return lookup_join(edges, ranks, PERIOD).select("MatchID", "rank", "a", "b", "w")


def evolution_distance(weights: DataFrame, ranks: DataFrame) -> DataFrame:
    """Frobenius distance of every period's graph to that of the previous existing period.

    ``weights`` are summed edges or the raw pairs: a cell is summed first. A cell counts with its
    difference to the period before, and alone for the next period if that lacks the pair. Both
    neighbours are beside it in the order of the periods, so there is no self-join. Each pair
    stands for two matrix cells.
    """
    cell = Window.partitionBy("b", "a", "MatchID").orderBy("rank")
    before = F.when(F.lag("rank").over(cell) == F.col("rank") - 1, F.lag("w").over(cell))
    again = F.coalesce(F.lead("rank").over(cell) == F.col("rank") + 1, F.lit(False))
    d = F.col("w") - F.coalesce("before", F.lit(0.0))
    own = F.struct(F.col("rank").alias("rank"), (d * d).alias("sq"))
    left = F.struct((F.col("rank") + 1).alias("rank"), (F.col("w") * F.col("w")).alias("sq"))
    squares = (
        ranked_edges(weights, ranks)
        .groupBy("MatchID", "rank", "a", "b")
        .agg(F.sum("w").alias("w"))
        .select("MatchID", "rank", "w", before.alias("before"), again.alias("again"))
        .select("MatchID", F.inline(F.when(F.col("again"), F.array(own)).otherwise(F.array(own, left))))
        .where(F.col("rank") > 1)
        .groupBy("MatchID", "rank")
        .agg(F.sum("sq").alias("sq"))
    )
    return ranks.join(squares, ["MatchID", "rank"], "left").select(
        "MatchID",
        "PeriodID",
        "rank",
        F.when(F.col("rank") > 1, F.sqrt(2 * F.coalesce("sq", F.lit(0.0)))).alias("distance"),
    )


def _parity(exceeds: Column, *keys: str) -> Column:
    order = (
        Window.partitionBy(*keys)
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (F.sum(F.coalesce(exceeds, F.lit(False)).cast("int")).over(order) % 2).cast("int")


def detect_evolution(distances: DataFrame, threshold: float) -> DataFrame:
    """The state flips whenever the distance exceeds the threshold, starting from "no event"."""
    flag = _parity(F.col("distance") > threshold, "MatchID")
    return distances.select("MatchID", "PeriodID", "rank", "distance", flag.alias("is_event"))


def sweep_evolution(distances: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    """``detect_evolution`` for a list of thresholds at once; the list is exploded in the row."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    flag = _parity(F.col("distance") > F.col("threshold"), "MatchID", "threshold")
    return distances.select("MatchID", "PeriodID", "rank", "distance", grid).select(
        "MatchID", "PeriodID", "rank", "threshold", flag.alias("is_event")
    )


def edge_history(edges: DataFrame, ranks: DataFrame, window: int) -> DataFrame:
    """Current edges with their weight in each of up to ``window`` earlier periods, 0 if absent.

    A range frame over the periods of one word pair replaces the range join: the frame holds
    at most ``window`` rows.
    """
    ranked = ranked_edges(edges, ranks)
    frame = (
        Window.partitionBy("b", "a", "MatchID").orderBy("rank").rangeBetween(-window, -1)
    )
    past = F.map_from_entries(F.collect_list(F.struct("rank", "w")).over(frame))
    lags = F.sequence(F.lit(1), F.least(F.lit(window), F.col("rank") - 1))
    return (
        ranked.select("*", past.alias("past"))
        .where(F.col("rank") > 1)
        .select("MatchID", "rank", "a", "b", "w", "past", F.explode(lags).alias("lag"))
        .select(
            "MatchID",
            "rank",
            "a",
            "b",
            "w",
            "lag",
            F.coalesce(F.element_at("past", F.col("rank") - F.col("lag")), F.lit(0.0)).alias("w_before"),
        )
    )


def deviation_by_previous(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """The deviation score for a window of one period in closed form: ``sum(xy) / sum(xx)``."""
    pair = Window.partitionBy("b", "a", "MatchID").orderBy("rank")
    before = F.when(F.lag("rank").over(pair) == F.col("rank") - 1, F.lag("w").over(pair))
    sums = (
        ranked_edges(edges, ranks)
        .select("MatchID", "rank", "w", before.alias("x"))
        .groupBy("MatchID", "rank")
        .agg(F.sum(F.col("x") * F.col("w")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    )
    return ranks.join(sums, ["MatchID", "rank"], "left").select(
        "MatchID",
        "PeriodID",
        "rank",
        F.when(F.col("rank") == 1, F.lit(-1.0))
        .otherwise(F.coalesce(F.try_divide("xy", "xx"), F.lit(0.0)))
        .alias("score"),
    )


GRAM_SCHEMA = "MatchID int, rank int, live array<int>, gram array<double>, cross array<double>"


def _gram_parts(window: int, chunk: int, edges_per_cell: int):
    """Partial Gram matrices from batches of edges in the order of their pairs and ranks."""

    def block_parts(match: int, pdf: pd.DataFrame) -> Iterator[tuple]:
        own = (pdf["rank"].to_numpy() - 1) // chunk
        upto = (pdf["rank"].to_numpy() - 1 + window) // chunk
        for part in np.union1d(own, upto):
            start = int(part) * chunk + 1
            first = max(1, start - window)
            cell = pdf[(own <= part) & (part <= upto)]
            edge, at = np.unique(cell["edge"].to_numpy(), return_inverse=True)
            block = np.zeros((len(edge), start + chunk - first))
            block[at, cell["rank"].to_numpy() - first] = cell["w"].to_numpy()
            for t in np.unique(cell["rank"].to_numpy()):
                now = block[:, t - first]
                rows = now > 0
                lo = max(first, t - window)
                if t < start or t == 1:
                    continue
                past = block[rows, lo - first : t - first]
                live = np.flatnonzero(past.any(axis=0))
                if not len(live):
                    continue
                past = past[:, live]
                yield match, int(t), (lo + live).tolist(), (past.T @ past).ravel().tolist(), (past.T @ now[rows]).tolist()

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def out() -> pd.DataFrame:
            pdf = pd.concat(held)
            rows = [r for match, own in pdf.groupby("MatchID") for r in block_parts(int(match), own)]
            return pd.DataFrame(rows, columns=["MatchID", "rank", "live", "gram", "cross"])

        edge = 0
        for pdf in batches:
            pdf = pdf.assign(edge=edge + pdf["opens"].to_numpy().cumsum())
            if not len(pdf):
                continue
            edge = int(pdf["edge"].iloc[-1])
            # The last pair may go on in the next batch.
            done = pdf["edge"].to_numpy() < edge
            held.append(pdf[done])
            n += int(done.sum())
            if done.any() and n >= edges_per_cell:
                yield out()
                held, n = [], 0
            held.append(pdf[~done])
            n += len(pdf) - int(done.sum())
        if n:
            yield out()

    return parts


def _add_grams(
    grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], match: int, window: int, chunk: int,
    edge: np.ndarray, rank: np.ndarray, w: np.ndarray,
) -> None:
    """Add the equations of cells, in the order of their edges and ranks, to those of their match and rank.

    An edge's weights lie side by side in a row per rank, for a chunk of ranks at a time.
    """
    own, upto = (rank - 1) // chunk, (rank - 1 + window) // chunk
    for part in np.unique(own):
        start = int(part) * chunk + 1
        here = (own <= part) & (part <= upto)
        at, t_all, v = edge[here], rank[here], w[here]
        column = np.cumsum(np.r_[0, at[1:] != at[:-1]])
        first = max(1, start - window)
        block = np.zeros((int(t_all.max()) - first + 1, column[-1] + 1))
        block[t_all - first, column] = v
        for t in np.unique(t_all).tolist():
            lo = max(first, t - window)
            if t < start or t == lo:
                continue
            now = block[t - first]
            edges = np.flatnonzero(now)
            past = block[lo - first : t - first, edges]
            if (match, t) not in grams:
                n = t - max(1, t - window)
                grams[match, t] = np.zeros((n, n)), np.zeros(n)
            gram, cross = grams[match, t]
            gram += past @ past.T
            cross += past @ now[edges]


def _packed_gram_parts(window: int, chunk: int, pairs_held: int, edges_per_cell: int, most: int = 1 << 12):
    """Partial Gram matrices from packed pairs in the order of their left words.

    Pairs are made and summed for about ``pairs_held`` of them at a time. Sums of a left word that
    goes on are kept and added to; all others turn into equations, which leave the task at its end
    or when there are ``most`` of them.
    """

    def out(grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows = []
        for (match, t), (gram, cross) in grams.items():
            live = np.flatnonzero(gram.diagonal())
            if len(live):
                rows.append((match, t, live + t - len(cross), gram[np.ix_(live, live)].ravel(), cross[live]))
        grams.clear()
        types = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        columns = list(zip(*rows)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["MatchID", "rank", "live", "gram", "cross"])

    def equations(grams: dict, matches: list[int], group: np.ndarray, b: np.ndarray, rank: np.ndarray, w: np.ndarray) -> None:
        """Add what the cells, whose groups are whole, contribute."""
        same = np.r_[False, (group[1:] == group[:-1]) & (b[1:] == b[:-1]) & (rank[1:] - rank[:-1] <= window)][: len(group)]
        near = same | np.r_[same[1:], False][: len(group)]
        # A run of near periods opens where the one before is too far to matter.
        edge, rank, w = np.cumsum(~same)[near], rank[near], w[near]
        match = np.array(matches)[group[near]] if len(matches) else group[near]
        for m in np.unique(match).tolist():
            own = np.flatnonzero(match == m)
            opens = np.flatnonzero(np.r_[True, np.diff(edge[own]) != 0])
            cuts = opens[np.unique(np.searchsorted(opens, np.arange(0, len(own), edges_per_cell)).clip(max=len(opens) - 1))]
            for s, e in zip(cuts, [*cuts[1:], len(own)]):
                _add_grams(grams, m, window, chunk, edge[own[s:e]], rank[own[s:e]], w[own[s:e]])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        others: dict[str, int] = {}
        matches, last, held, n, limit = [], None, [], 0, pairs_held
        for batch in batches:
            # The text of a batch has a bounded size, however long its rows are.
            ends = np.cumsum(pc.binary_length(batch.column("right")).to_numpy())
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs_held, "right")))
                group = []
                for key in zip(batch.column("MatchID")[at:stop].to_pylist(), batch.column("a")[at:stop].to_pylist()):
                    if key != last:
                        last = key
                        matches.append(key[0])
                    group.append(len(matches) - 1)
                row, b, rank, w = _unpacked(batch.column("right")[at:stop], others)
                held.append((np.array(group)[row], b, rank, w))
                n, at = n + len(w), stop
                if n < limit:
                    continue
                cells = _cells(*(np.concatenate(c) for c in zip(*held)))
                whole = int(np.searchsorted(cells[0], len(matches) - 1))
                equations(grams, matches, *(c[:whole] for c in cells))
                b, rank, w = (c[whole:] for c in cells[1:])
                words, kept = list(others), np.unique(b[b >= UNCODED])
                others = {words[k - UNCODED]: UNCODED + i for i, k in enumerate(kept.tolist())}
                b = np.where(b >= UNCODED, UNCODED + np.searchsorted(kept, b), b)
                held, n, matches = [(np.zeros(len(b), np.int64), b, rank, w)], len(b), matches[-1:]
                # One left word may have more cells than that; they are summed anew only after as many more pairs.
                limit = max(pairs_held, 2 * n)
                if len(grams) >= most:
                    yield out(grams)
        if n:
            equations(grams, matches, *_cells(*(np.concatenate(c) for c in zip(*held))))
        yield out(grams)

    return parts


@F.pandas_udf(T.DoubleType())
def _coefficient_sum(keys: pd.Series, values: pd.Series) -> pd.Series:
    """Sum of the minimum-norm least-squares coefficients from summed Gram cells."""

    def solve(cells, sums) -> float:
        i, j = np.array([c["i"] for c in cells]), np.array([c["j"] for c in cells])
        axis = np.unique(i)
        gram, cross = np.zeros((len(axis), len(axis))), np.zeros(len(axis))
        target = j < 0
        cross[np.searchsorted(axis, i[target])] = np.asarray(sums)[target]
        at = ~target
        gram[np.searchsorted(axis, i[at]), np.searchsorted(axis, j[at])] = np.asarray(sums)[at]
        return float((np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ cross).sum())

    return pd.Series([solve(c, v) for c, v in zip(keys, values)], dtype="float64")


def normal_equations(
    edges: DataFrame | PackedPairs,
    ranks: DataFrame,
    window: int = DEVIATION_WINDOW,
    edges_per_cell: int = 50_000,
    periods_per_chunk: int = 64,
    pairs_held: int = 1 << 20,
) -> DataFrame:
    """(MatchID, rank, i, j, v): normal equations of every period on up to ``window`` earlier ones.

    ``i`` and ``j`` are earlier ranks; ``j`` -1 is the period itself. The equations of a smaller
    window are a part of those of a larger one. They are additive over edges: the edges of a
    pair, in the order of their periods, stream through blocks of about ``edges_per_cell`` edges
    and chunks of periods. An edge without another one of its pair within the window adds nothing
    and stays behind. Blocks emit small partial matrices, which are summed and solved per period.
    Only window-sized matrices reach the solver, whatever the data size. Packed pairs are made,
    summed and put into blocks in one step behind their shuffle, about ``pairs_held`` at a time.
    """
    chunk = max(window, periods_per_chunk)
    if isinstance(edges, PackedPairs):
        grams = _packed_gram_parts(window, chunk, pairs_held, edges_per_cell)
        return _summed_grams(edges.ranked(ranks).mapInArrow(grams, GRAM_SCHEMA))
    pair = Window.partitionBy("b", "a", "MatchID").orderBy("rank")
    gap = F.col("rank") - F.lag("rank").over(pair)
    ahead = F.lead("rank").over(pair) - F.col("rank")
    near = (
        ranked_edges(edges, ranks)
        .select("MatchID", "rank", "w", gap.alias("gap"), ahead.alias("ahead"))
        .where((F.col("gap") <= window) | (F.col("ahead") <= window))
        # A run of near periods opens where the one before is too far to matter.
        .select("MatchID", "rank", "w", F.coalesce(F.col("gap") > window, F.lit(True)).cast("int").alias("opens"))
    )
    return _summed_grams(near.mapInPandas(_gram_parts(window, chunk, edges_per_cell), GRAM_SCHEMA))


def _summed_grams(parts: DataFrame) -> DataFrame:
    """Partial matrices as summed cells (MatchID, rank, i, j, v)."""
    k = F.size("live")
    gram = F.transform(
        F.col("gram"),
        lambda v, n: F.struct(
            F.get("live", F.floor(n / k).cast("int")).alias("i"),
            F.get("live", (n % k).cast("int")).alias("j"),
            v.alias("v"),
        ),
    )
    cross = F.transform(
        F.col("cross"),
        lambda v, n: F.struct(F.get("live", n).alias("i"), F.lit(-1).alias("j"), v.alias("v")),
    )
    return (
        parts.select("MatchID", "rank", F.inline(F.concat(gram, cross)))
        .groupBy("MatchID", "rank", "i", "j")
        .agg(F.sum("v").alias("v"))
    )


def solved_scores(equations: DataFrame, ranks: DataFrame, window: int = DEVIATION_WINDOW) -> DataFrame:
    """Scores for a window from the equations of that or a larger window."""
    first = F.col("rank") - window
    summed = (
        equations.where((F.col("i") >= first) & ((F.col("j") >= first) | (F.col("j") < 0)))
        .groupBy("MatchID", "rank")
        .agg(F.array_sort(F.collect_list(F.struct("i", "j", "v"))).alias("m"))
    )
    solved = summed.select(
        "MatchID",
        "rank",
        _coefficient_sum(
            F.transform("m", lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"))), F.col("m.v")
        ).alias("sum"),
    )
    return ranks.join(solved, ["MatchID", "rank"], "left").select(
        "MatchID",
        "PeriodID",
        "rank",
        F.when(F.col("rank") == 1, F.lit(-1.0)).otherwise(F.coalesce("sum", F.lit(0.0))).alias("score"),
    )


def deviation_score(
    edges: DataFrame | PackedPairs, ranks: DataFrame, window: int = DEVIATION_WINDOW, **options: int
) -> DataFrame:
    """Sum of least-squares coefficients of a period's edges on up to ``window`` earlier periods."""
    return solved_scores(normal_equations(edges, ranks, window, **options), ranks, window)


def detect_deviation(scores: DataFrame, threshold: float = DEVIATION_THRESHOLD) -> DataFrame:
    return scores.select(
        "MatchID", "PeriodID", "rank", "score", (F.col("score") >= threshold).cast("int").alias("is_event")
    )


def sweep_deviation(scores: DataFrame, thresholds: Iterable[float]) -> DataFrame:
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return scores.select("MatchID", "PeriodID", "rank", "score", grid).select(
        "MatchID",
        "PeriodID",
        "rank",
        "threshold",
        (F.col("score") >= F.col("threshold")).cast("int").alias("is_event"),
    )
