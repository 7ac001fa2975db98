"""Remove passages of lines that appeared before, by overlapping windows of lines.

Lines without a word never take part and always stay. The others, stripped of outer white space,
form windows of ``width`` consecutive ones. Of equal windows the first by (id, position) stays;
the lines under every later one go, however many windows cover them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodlens.llm.tables import SPACE_CHARS, discard, let, saved

WIDTH = 3


def _filled(lines: Column) -> Column:
    """(i, t) of the lines that hold a word, ``i`` counting all lines."""
    stripped = F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.btrim(line, F.lit(SPACE_CHARS)).alias("t")))
    return F.filter(stripped, lambda x: x["t"] != "")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with the kept text, and ``n_lines`` and ``n_removed`` (columns of these names are replaced).

    A window is known by the 64-bit hashes of its lines, so two windows are confused only if all
    their differing lines collide. Null texts stay null with 0 lines; texts of fewer than
    ``width`` lines lose nothing; rows equal in id and text are one document and keep their text;
    an empty table gives an empty result.
    """
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    mark = F.xxhash64(F.col(text))
    hashes = F.transform(_filled(F.split(F.col(text), "\n")), lambda x: F.xxhash64(x["t"]))
    rows = docs.select(F.col(id_col).alias("id"), mark.alias("mark"), hashes.alias("h"))
    keys = [f"h{j}" for j in range(width)]
    windows = saved(
        rows.where(F.size("h") >= width)
        .select("id", "mark", "h", F.explode(F.sequence(F.lit(0), F.size("h") - width)).alias("at"))
        .select("id", "mark", "at", *[F.get("h", F.col("at") + j).alias(keys[j]) for j in range(width)]),
        "line-windows",
    )
    place = F.struct("id", "mark", "at")
    firsts = (
        windows.groupBy(*keys)
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    later = windows.join(firsts, keys).where(~place.eqNullSafe(F.col("first")))
    covered = saved(
        later.groupBy("id", "mark")
        .agg(F.collect_set("at").alias("ats"))
        .select(
            F.col("id").alias("_id"),
            F.col("mark").alias("_mark"),
            F.array_distinct(
                F.flatten(F.transform("ats", lambda a: F.array(*[a + j for j in range(width)])))
            ).alias("_covered"),
        ),
        "line-covered",
    )
    discard(windows)
    # The row travels as one value, so its columns may have any name.
    named = docs.select(F.struct(*cols).alias("row"), F.col(id_col).alias("id"), F.col(text).alias("text"), mark.alias("mark"))
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    # Covered lines grow with the documents, so the plan is a merge at every size.
    joined = named.join(covered.hint("merge"), on, "left")

    def cut(lines: Column) -> Column:
        gone = let(_filled(lines), lambda filled: F.transform("_covered", lambda o: F.get(filled, o)["i"]))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
        return F.struct(kept.alias("kept"), F.size("_covered").alias("gone"))

    lines = F.split(F.col("text"), "\n")
    done = joined.select(
        "row",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("_covered").isNotNull(), let(lines, cut)).alias("cut"),
    )
    kept = F.when(F.col("cut").isNotNull(), F.col("cut.kept")).otherwise(F.col("row")[text])
    return done.select(
        *[kept.alias(c) if c == text else F.col("row")[c].alias(c) for c in cols],
        "n_lines",
        F.coalesce("cut.gone", F.lit(0)).cast("long").alias("n_removed"),
    )
