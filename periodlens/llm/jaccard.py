"""Classes of texts whose word shingles overlap, by token-combination prefixes.

A text is the set of its hashed shingles; texts of one set are one row from then on. Shingles are
ordered by how many sets hold them, rarest first. A set that may miss at most ``m`` of its shingles
in a partner files itself under the first ``m + 1`` of them: rare ones (in at most ``RARE`` sets)
each alone, frequent ones in pairs. Frequent shingles fall into classes by hash, and a pair is made
inside a class only; every class in use costs one shingle more of prefix. Whoever overlaps enough
shares a file. Files are compared against their most central member, their pivot, first; members
found to belong together need no comparison among each other. Members of different classes are
compared in small files; in large ones they are filed again under the rarest shingles of their differences to the pivot, and only those that meet
there are compared. A set's shingles that no other candidate holds bound every overlap, so most
edited copies that miss the threshold are never paired.

Large sets store only the shingles of a fixed slice of the hash range (and all if that is too few),
since prefixes are short. Counting, filing and ordering use the stored shingles of all sets alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodlens.llm import wordhash as wh
from periodlens.llm.components import components
from periodlens.llm.tables import discard, saved

RARE = 16
WHOLE = 256
#: Members of a file that is compared pair by pair.
SMALL = 16


def _shingles(w: wh.Words, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer words is one shingle."""
    runs = wh.windows(w.hashes, width)
    for s, e in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if e - s >= width:
            yield np.unique(runs[s : e - width + 1])
        elif e > s:
            yield wh.windows(w.hashes[s:e], e - s, 0x94D049BB133111EB + 2 * (e - s))
        else:
            yield np.zeros(0, np.uint64)


class Plan:
    """What a threshold of ``num / den`` means for a set of ``n`` shingles."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.slice = min(1.0, 2 * (den - num) / den)
        self.limit = np.uint64(min(2**64 - 1, int(self.slice * 2**64)))

    def misses(self, n: int) -> int:
        return n - -(-self.num * n // self.den)

    def levels(self, n: int) -> range:
        """Powers of two between which all partners' sizes lie; partners share one."""
        low, high = max(1, -(-self.num * n // self.den)), max(1, self.den * n // self.num)
        return range(low.bit_length() - 1, high.bit_length())

    def classes(self, level: int) -> int:
        return max(1, (self.den - self.num) * (1 << level) // self.den // 4)

    def alone(self, n: int) -> bool:
        """No other set can overlap enough."""
        return self.den * n < self.num * (n + 1)

    def stored(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if self.alone(n):
            return s[:0]
        inside = int(np.searchsorted(s, self.limit))
        enough = self.misses(n) + 1 + max(self.classes(v) for v in self.levels(n))
        return s if n <= WHOLE or inside < enough else s[:inside]

    def files(self, n: int, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The files of a set, from its stored tokens and how many sets hold each."""
        late = tokens >= self.limit
        order = np.lexsort((tokens, counts, late))
        tokens, counts, late = tokens[order], counts[order], late[order]
        frequent = counts > RARE
        spread = wh.mix(tokens) >> np.uint64(20)
        out = []
        for level in self.levels(n):
            group = np.where(frequent, (spread % np.uint64(self.classes(level))).astype(np.int64), -1)
            # Tokens of the slice come first and are classed apart from the late ones.
            group = np.where(frequent & late, group + (1 << 40), group)
            opens = np.zeros(len(tokens), bool)
            opens[np.unique(group, return_index=True)[1]] = True
            units = np.cumsum(~(opens & frequent))
            end = int(np.searchsorted(units, self.misses(n) + 1)) + 1
            salt = np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
            single = (~frequent & (counts > 1))[:end]
            out.append(wh.mix(tokens[:end][single] + salt))
            pairs = np.flatnonzero(frequent[:end])
            if len(pairs) > 1:
                by = pairs[np.argsort(group[pairs], kind="stable")]
                for part in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
                    i, j = np.triu_indices(len(part), 1)
                    a, b = tokens[part[i]], tokens[part[j]]
                    out.append(wh.mix(wh.mix(np.minimum(a, b) + salt) * np.uint64(3) + np.maximum(a, b)))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _list(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(wh.signed(flat.astype(np.uint64))))


def _sets(docs: DataFrame, width: int, plan: Plan | None) -> DataFrame:
    """(id, n, f1, f2, tokens): size, 128-bit fingerprint and stored shingles (all without a plan)."""
    longs = T.LongType()
    schema = T.StructType(
        [docs.schema["id"], *[T.StructField(c, longs) for c in ("n", "f1", "f2")], T.StructField("tokens", T.ArrayType(longs))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, rows in wh.blocks(batch.column("text"), wh.BLOCK // 2):
                sets = list(_shingles(wh.words(data, rows, lower=True), width))
                prints = [[int(wh.mix(s ^ np.uint64(k)).sum(dtype=np.uint64)) for s in sets] for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *[pa.array(np.array(p, np.uint64).view(np.int64)) for p in prints],
                        _list([plan.stored(s) if plan else s for s in sets]),
                    ],
                    names=schema.names,
                )

    return docs.select("id", "text").mapInArrow(scan, schema)


def _filed(sets: DataFrame, plan: Plan) -> DataFrame:
    """(file, id, n) of sets (id, n, tokens, known), ``known`` the tokens that several sets hold."""
    schema = T.StructType([T.StructField("file", T.LongType()), sets.schema["id"], T.StructField("n", T.LongType())])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_pylist()
            tokens, known = batch.column("tokens"), batch.column("known")
            t_at, k_at = tokens.offsets.to_numpy(), known.offsets.to_numpy()
            t_flat = tokens.values.to_numpy().view(np.uint64)
            k_tok = known.values.field("token").to_numpy().view(np.uint64)
            k_df = known.values.field("df").to_numpy()
            files = []
            for i, n in enumerate(sizes):
                own = t_flat[t_at[i] : t_at[i + 1]]
                held, count = k_tok[k_at[i] : k_at[i + 1]], k_df[k_at[i] : k_at[i + 1]]
                counts = np.ones(len(own), np.int64)
                at = np.searchsorted(own, held)
                counts[at] = count
                files.append(plan.files(n, own, counts))
            times = np.array([len(f) for f in files], np.int64)
            at = pa.array(np.repeat(np.arange(len(files)), times))
            flat = np.concatenate(files) if files else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wh.signed(flat)), batch.column("id").take(at), batch.column("n").take(at)], names=schema.names
            )

    return sets.select("id", "n", "tokens", "known").mapInArrow(file, schema)


def _verified(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs whose sets overlap enough, by their whole sets."""
    left = whole.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = whole.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - both
    return pairs.join(left, "a").join(right, "b").where(den * both >= num * union).select("a", "b")


def _may_link(n: str, s: str, m: str, t: str, num: int, den: int) -> Column:
    """Whether sets of ``n`` and ``m`` shingles can link, of which ``s`` and ``t`` can be shared at all."""
    most = F.least(s, t)
    return most * den >= (F.col(n) + F.col(m) - most) * num


def _apart(num: int, den: int, d: Column, n: Column) -> Column:
    """Whether sets of ``n`` shingles together that differ in ``d`` are too far apart to link."""
    return d * (den + num) > n * (den - num)


def _beyond_pivot(near: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs of (pivot, id, n, m, comp) that may link: members of one pivot, in different components.

    Sets are compared by how they differ from their pivot (of ``m`` shingles). Two sets differ by
    their differences less twice what these share, so a set that does not link with the pivot links
    only with sets that share a good part of its difference: about half of it with others that do
    not link with the pivot either. Both hold one of the rarest of these shingles, up to as many as
    may be missing, and a pair is made at the first such shingle only.
    """
    mine = whole.select("id", F.col("tokens").alias("t"))
    theirs = whole.select(F.col("id").alias("pivot"), F.col("tokens").alias("u"))
    step = F.concat(F.array_except("t", "u"), F.array_except("u", "t"))
    diffs = saved(
        near.where("id <> pivot").join(mine, "id").join(theirs, "pivot").select("pivot", "id", "n", "m", "comp", step.alias("step")),
        "jac-diffs",
    )
    each = diffs.select("pivot", "id", F.explode("step").alias("token"))
    held = each.groupBy("pivot", "token").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(held, ["pivot", "token"]).groupBy("pivot", "id").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("k"))
    d, n, m = F.size("step"), F.col("n"), F.col("m")
    both, less = den + num, den - num
    # What has to be shared: with a set that does not link with the pivot, and with one that does.
    far = F.greatest(F.lit(1), F.floor((d * both - (n - m) * less) / (2 * both)) + 1)
    close = F.greatest(F.lit(1), F.ceil((d * both - (n + m) * less + 2 * num) / (2 * both)))
    lone = d - F.size("k")
    rarest = lambda need: F.slice(F.transform("k", lambda x: x["token"]), 1, F.greatest(F.lit(0), d - need + 1 - lone).cast("int"))
    rows = diffs.join(shared, ["pivot", "id"]).select(
        "pivot", "id", "n", "comp", d.alias("d"), _apart(num, den, d, n + m).alias("out"),
        rarest(far).alias("far"), rarest(F.least(far, close)).alias("close"),
    )
    rows = saved(rows, "jac-prefixes")
    discard(diffs)

    def side(df: DataFrame, tokens: str, suffix: str) -> DataFrame:
        cols = [F.col(c).alias(c + suffix) for c in ("pivot", "id", "n", "comp", "d")]
        return df.select(*cols, F.col(tokens).alias("k" + suffix), F.explode(tokens).alias("token" + suffix))

    def pairs(left: DataFrame, right: DataFrame, more: Column) -> DataFrame:
        first = F.get(F.array_intersect("kx", "ky"), F.lit(0)) == F.col("tokenx")
        reach = ~_apart(num, den, F.abs(F.col("dx") - F.col("dy")), F.col("nx") + F.col("ny"))
        same = (F.col("pivotx") == F.col("pivoty")) & (F.col("tokenx") == F.col("tokeny"))
        return left.join(right, same & (F.col("compx") != F.col("compy")) & reach & more & first).select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b"))

    out, close_ = rows.where("out"), rows.where("not out")
    among = pairs(side(out, "far", "x"), side(out, "far", "y"), F.col("idx") < F.col("idy"))
    across = pairs(side(out, "close", "x"), side(close_, "far", "y"), F.lit(True))
    return among.unionByName(across)


def overlap_classes(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Two documents link when ``den`` times the shingles they share is at least ``num`` times those
    that either has. Null texts and texts without words have no shingles and link with nothing.
    Rows of one id are one document: all of them get its class, and a link of any of its texts
    counts. Rows without an id have none. An empty table gives an empty result.
    """
    plan = Plan(num, den)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    sets = saved(_sets(plain, width, plan), "jac-sets")
    print_ = ["n", "f1", "f2"]
    filled = sets.where("id is not null and n > 0")
    # From here on ``id`` is the number of a set, and ``rep`` the smallest document that has it.
    numbered = filled.groupBy(*print_).agg(F.min("id").alias("rep"), F.first("tokens").alias("tokens"))
    reps = saved(numbered.withColumn("id", F.monotonically_increasing_id()), "jac-reps")
    prints = saved(sets.select("id", *print_), "jac-prints")
    classes = saved(reps.select(*print_, "rep", "id"), "jac-reps")
    discard(sets)
    tokens = reps.select("id", F.explode("tokens").alias("token"))
    several = saved(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "jac-frequency")
    known = saved(
        tokens.join(several, "token").groupBy("id").agg(F.collect_set(F.struct("token", "df")).alias("known")), "jac-known"
    )
    # Only a set with a shared shingle can have a partner.
    filed = saved(_filed(reps.where(F.size("tokens") > 0).select("id", "n", "tokens").join(known, "id"), plan), "jac-filed")
    for table in (reps, several, known):
        discard(table)
    shared = filed.groupBy("file").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("file")
    sharing = saved(filed.join(shared, "file", "left_semi"), "jac-sharing")
    discard(filed)
    active = classes.join(sharing.select("id").distinct(), "id", "left_semi")
    active = saved(active.select(F.col("rep").alias("id"), F.col("id").alias("set"), *[F.col(c).alias(f"_{c}") for c in print_]), "jac-active")
    # Texts cross one shuffle, at every size alike, and take the numbers of their sets along. A
    # document with several texts meets all of its numbers; each set keeps its own.
    met = plain.join(active.hint("merge"), "id").select(F.struct("set", *[f"_{c}" for c in print_]).alias("id"), "text")
    own = [F.col(c) == F.col(f"id._{c}") for c in print_]
    whole = saved(_sets(met, width, None).where(own[0] & own[1] & own[2]).select(F.col("id.set").alias("id"), "tokens"), "jac-whole")
    # Shingles that no other of these sets holds can't be shared: they bound every overlap.
    lone = (
        whole.select("id", F.explode("tokens").alias("token"))
        .groupBy("token").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
        .groupBy("id").agg(F.count("*").alias("lone"))
    )
    bounded = saved(
        sharing.join(saved(lone, "jac-lone"), "id", "left")
        .withColumn("s", F.col("n") - F.coalesce("lone", F.lit(0)))
        .where(F.col("s") * den >= F.col("n") * num)
        .select("file", "id", "n", "s"),
        "jac-bounded",
    )
    discard(sharing)
    # Every file is compared with its most central member, to which edited copies are nearest.
    pivot = F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("apart"), F.xxhash64("id").alias("h"), "id", "n", "s")
    pivots = bounded.groupBy("file").agg(F.min(pivot).alias("p"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    pivots = saved(pivots.select("file", F.col("p.id").alias("pivot"), F.col("p.n").alias("m"), F.col("p.s").alias("t")), "jac-pivots")
    stars = saved(
        bounded.join(pivots, "file")
        .where((F.col("id") != F.col("pivot")) & _may_link("n", "s", "m", "t", num, den))
        .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
        .distinct(),
        "jac-stars",
    )
    links = saved(_verified(stars, whole, num, den), "jac-links")
    first = components(links)
    placed = saved(
        bounded.join(first, F.col("id") == F.col("node"), "left")
        .select("file", "id", "n", "s", F.coalesce("component", "id").alias("comp")),
        "jac-placed",
    )
    discard(bounded)
    mixed = placed.groupBy("file").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    open_ = saved(placed.join(mixed.select("file", "members"), "file"), "jac-open")
    discard(placed)
    # A small file is compared pair by pair; a large one goes on by differences to its pivot.
    x, y = (
        open_.where(F.col("members") <= SMALL).select(F.col("file").alias("file" + c), *[F.col(v).alias(v + c) for v in ("id", "n", "s", "comp")])
        for c in ("x", "y")
    )
    differ = (F.col("filex") == F.col("filey")) & (F.col("idx") < F.col("idy")) & (F.col("compx") != F.col("compy"))
    few = x.join(y, differ & _may_link("nx", "sx", "ny", "sy", num, den)).select(F.col("idx").alias("a"), F.col("idy").alias("b"))
    near = open_.where(F.col("members") > SMALL).join(pivots, "file").select("pivot", "id", "n", "m", "comp").distinct()
    beyond = _beyond_pivot(near, whole, num, den)
    untried = saved(few.unionByName(beyond).distinct().join(stars, ["a", "b"], "left_anti"), "jac-rest")
    more = saved(_verified(untried, whole, num, den), "jac-links")
    for table in (whole, stars, open_, pivots, untried):
        discard(table)
    # The sets of one document belong together.
    texts = prints.join(classes.withColumnRenamed("id", "set"), print_).where(F.col("id").isNotNull())
    several = texts.groupBy("id").agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a < b")
    together = texts.join(several.select("id", "a"), "id").where("set <> a").select("a", F.col("set").alias("b"))
    final = components(links.unionByName(more).unionByName(together))
    placed = classes.join(final, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    named = saved(
        placed.join(least, "component").select(*[F.col(c).alias(f"_{c}") for c in print_], F.col("least").alias("component")),
        "jac-classes",
    )
    same = [F.col(c) == F.col(f"_{c}") for c in print_]
    return (
        prints.join(named, same[0] & same[1] & same[2] & F.col("id").isNotNull(), "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
        )
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id stands for its class; of rows of one id the least one, and rows without id."""
    found = overlap_classes(docs, id_col, **options)
    stay = saved(
        found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_stay")).distinct(), "jac-stay"
    )
    others = [c for c in docs.columns if c != id_col]
    named = docs.where(F.col(id_col).isNotNull())
    return (
        named.join(stay, F.col(id_col) == F.col("_stay"), "left_semi")
        .groupBy(id_col)
        .agg(F.min(F.struct(*others)).alias("_row"))
        .select(*[F.col(c) if c == id_col else F.col(f"_row.{c}").alias(c) for c in docs.columns])
        .unionByName(docs.where(F.col(id_col).isNull()))
    )
