"""Mix sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times. The whole part of that
number is certain; the fraction is a probability. Documents of a source are paired: words move
from one to the other until one of the two probabilities is 0 or 1, in a random direction that
keeps both expectations, and the pair's expected words never change. The one still open meets the
next document. Chunks of at most about ``fan`` documents do this side by side, each leaves one
open document, and these meet in chunks of ``fan`` chunks, and so on up a tree; the last one of a
source is decided by a draw. So the words taken miss the target by less than one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodlens.llm.tables import saved, uniform, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
FAN = 128


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, from 0; no task sees more than a range."""
    order = F.col("source").asc_nulls_last()
    ranged = saved(
        sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    # One row per partition of the range exchange.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("part")
        .agg(F.count("*").alias("n"))
        .select(F.col("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    )
    inside = Window.partitionBy("part").orderBy(order)
    return ranged.join(offsets, "part").select(
        "source", "source_size", "docs", (F.col("skip") + F.row_number().over(inside) - 1).alias("rank")
    )


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size, docs): shares by weight, none above ``most`` times.

    A source is full when its weight times the water level reaches its bound. What full sources
    leave over raises the level for the others, until no further source fills up. Only the level,
    one number, is on the driver.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = saved(
        _ranked(sources).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))),
        "mix-ranks",
    )
    bound = F.col("source_size") * F.lit(float(most))
    level, full_before = 0.0, -1
    while True:
        full = bound <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count_if(full).alias("full"),
        ).first()
        if row["full"] == full_before or not row["open"]:
            break
        full_before = row["full"]
        level = (share * row["all"] - most * row["held"]) / row["open"]
    everything_full = not row["open"]
    target = bound if everything_full else F.least(bound, F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", target.cast("double"))


def _duel(acc: Column, x: Column, seed: int) -> Column:
    """One step of the fold: the open document ``acc.held`` meets ``x``."""
    a, b = acc["held"], x
    up_room, up_give = (1 - a["p"]) * a["size"], b["p"] * b["size"]
    down_room, down_give = a["p"] * a["size"], (1 - b["p"]) * b["size"]
    raised, lowered = F.least(up_room, up_give), F.least(down_room, down_give)
    up = uniform(F.lit(seed), a["h"], b["h"]) * (raised + lowered) < lowered
    a_done = F.when(up, up_room <= up_give).otherwise(down_room <= down_give)
    moved = F.when(up, raised).otherwise(-lowered)
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    decided = F.when(
        a_done, F.struct(a["id"].alias("id"), a["size"].alias("size"), F.when(up, 1).otherwise(0).alias("extra"))
    ).otherwise(F.struct(b["id"].alias("id"), b["size"].alias("size"), F.when(up, 0).otherwise(1).alias("extra")))

    def item(v, p):
        return F.struct(
            v["order"].alias("order"), v["h"].alias("h"), v["id"].alias("id"), v["size"].alias("size"), p.alias("p")
        )

    still = F.when(a_done, item(b, unit(b["p"] - moved / b["size"]))).otherwise(
        item(a, unit(a["p"] + moved / a["size"]))
    )
    return F.when(
        a.isNull(), F.struct(acc["done"].alias("done"), item(x, x["p"]).alias("held"))
    ).otherwise(F.struct(F.array_append(acc["done"], decided).alias("done"), still.alias("held")))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    fan: int = FAN,
    seed: int = 17,
    keep: tuple[Column, ...] = (),
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row of ``docs``.

    ``keep`` are further columns that become part of the id, a struct ``_key``, for callers that
    join the result. Null texts have size 0; a null source is one more source. Rows of size 0 are
    taken by independent draws and never change the words taken. Repeated rows are decided one by
    one. An empty table gives an empty result.
    """
    key = F.struct(F.col(id_col).alias("id"), *[c.alias(f"k{i}") for i, c in enumerate(keep)])
    sizes = saved(
        docs.select(key.alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")),
        "mix-sizes",
    )
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goal = saved(targets(sources, weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    h = F.xxhash64(F.lit(seed), F.col("id.id"), F.col("size"))
    per_source = goal.select(
        F.col("source").alias("_s"), "rank", "source_size", "target", "docs", F.floor(rate).alias("base"),
        (rate - F.floor(rate)).alias("p"),
    )
    items = sizes.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("source", "_s").withColumn("h", h)
    constant = ["rank", "source_size", "target", "base"]
    plain = (F.col("p") == 0) | (F.col("size") == 0)
    drawn = (uniform(F.lit(seed + 1), F.col("h")) < F.col("p")).cast("int").alias("extra")
    decided = [items.where(plain).select("id", "size", drawn, *constant)]
    most_docs = goal.agg(F.max("docs")).first()[0] or 0
    chunks = F.greatest(F.lit(1), F.ceil(F.col("docs") / fan))
    open_ = items.where(~plain).select(
        *constant,
        F.pmod(F.xxhash64(F.lit(seed + 2), F.col("h")), chunks).alias("chunk"),
        F.struct((-F.col("size")).alias("order"), "h", "id", "size", "p").alias("item"),
    )
    held_type = open_.schema["item"].dataType.simpleString()
    id_type = items.schema["id"].dataType.simpleString()
    start = F.struct(
        F.expr(f"cast(array() as array<struct<id:{id_type},size:bigint,extra:int>>)").alias("done"),
        F.expr(f"cast(null as {held_type})").alias("held"),
    )
    width = max(1, -(-most_docs // fan))
    level = 0
    while True:
        # Large documents first, so that small ones settle what they leave open.
        folded = open_.groupBy(*constant, "chunk").agg(F.sort_array(F.collect_list("item")).alias("items"))
        step = saved(
            folded.select(
                *constant,
                "chunk",
                F.aggregate("items", start, lambda acc, x: _duel(acc, x, seed + 3 + level)).alias("r"),
            ).select(*constant, "chunk", "r.done", "r.held"),
            "mix-level",
        )
        decided.append(step.select(*constant, F.inline("done")).select("id", "size", "extra", *constant))
        open_ = step.select(*constant, F.floor(F.col("chunk") / fan).alias("chunk"), F.col("held").alias("item"))
        if width == 1:
            break
        width, level = -(-width // fan), level + 1
    last = (uniform(F.lit(seed + 1), F.col("item.h")) < F.col("item.p")).cast("int").alias("extra")
    decided.append(open_.select("item.id", "item.size", last, *constant))
    copies = (F.col("base") + F.col("extra")).cast("long")
    return reduce(DataFrame.unionByName, decided).select(
        *([F.col("id").alias("_key")] if keep else [F.col("id.id").alias(id_col)]),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    Rows equal in id and text are one document here: it is written as often as all of them
    are taken together.
    """
    id_col, text = options.get("id_col", "doc_id"), options.get("text", "text")
    mark = F.xxhash64(F.col(text))
    taken = (
        mix(docs, keep=(mark,), **options)
        .groupBy(F.col("_key.id").alias("_i"), F.col("_key.k0").alias("_m"))
        .agg(F.sum("copies").alias("_n"))
        .where("_n > 0")
    )
    rows = docs.withColumn("_m0", mark).dropDuplicates([id_col, "_m0"])
    on = F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_m0") == F.col("_m"))
    return rows.join(taken, on).select(
        *docs.columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")
    ).drop("_copy")
