"""Ordered running aggregates that hold when one key owns most of the rows.

A plain window puts a whole key into one task. Here the integer order column is cut into
segments and the segments into blocks. Inside a segment a window runs over at most
``segment`` distinct order values; what earlier segments and blocks contribute comes from
their totals, which are computed by a normal aggregation. The result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodlens.session import null_safe_join

SEGMENT = 2**20
BLOCK = 2**36


@dataclass(frozen=True)
class Running:
    """``kind`` is ``sum``, ``max`` or ``count``; ``value`` is the column it runs over."""

    kind: str
    value: Column | None = None

    def total(self, value: Column) -> Column:
        return F.max(value) if self.kind == "max" else F.sum(value)

    def combine(self, before: Column, within: Column) -> Column:
        if self.kind == "max":
            return F.greatest(before, within)
        zero = F.lit(0)
        return F.coalesce(before, zero) + F.coalesce(within, zero)


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: dict[str, Running],
    tie: list[str] | None = None,
    segment: int = SEGMENT,
    block: int = BLOCK,
) -> DataFrame:
    """Add running aggregates (current row included) over integer ``order`` inside ``keys``.

    Null is a key like any other; rows without an order value come first in a segment of their own.
    """
    values = {
        name: F.lit(1).cast("bigint") if spec.kind == "count" else spec.value
        for name, spec in columns.items()
    }
    staged = df.select(
        "*",
        F.floor(F.col(order) / block).cast("bigint").alias("_blk"),
        F.floor(F.col(order) / segment).cast("bigint").alias("_seg"),
        *[value.alias(f"_v_{name}") for name, value in values.items()],
    )
    cell = [*keys, "_blk", "_seg"]
    by_row = (
        Window.partitionBy(*cell)
        .orderBy(order, *(tie or []))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = staged.select(
        *[c for c in staged.columns if not c.startswith("_v_")],
        *[spec.total(F.col(f"_v_{n}")).over(by_row).alias(f"_w_{n}") for n, spec in columns.items()],
    )
    segments = staged.groupBy(*cell).agg(
        *[spec.total(F.col(f"_v_{n}")).alias(f"_t_{n}") for n, spec in columns.items()]
    )
    blocks = segments.groupBy(*keys, "_blk").agg(
        *[spec.total(F.col(f"_t_{n}")).alias(f"_b_{n}") for n, spec in columns.items()]
    )
    before_block = (
        Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    before_segment = (
        Window.partitionBy(*keys, "_blk")
        .orderBy("_seg")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    block_offsets = blocks.select(
        *keys,
        "_blk",
        *[spec.total(F.col(f"_b_{n}")).over(before_block).alias(f"_ob_{n}") for n, spec in columns.items()],
    )
    offsets = segments.select(
        *cell,
        *[spec.total(F.col(f"_t_{n}")).over(before_segment).alias(f"_os_{n}") for n, spec in columns.items()],
    )
    offsets = null_safe_join(offsets, block_offsets, [*keys, "_blk"])
    return null_safe_join(within, offsets, cell).select(
        *df.columns,
        *[
            spec.combine(
                spec.combine(F.col(f"_ob_{n}"), F.col(f"_os_{n}")), F.col(f"_w_{n}")
            ).alias(n)
            for n, spec in columns.items()
        ],
    )


def numbered(
    df: DataFrame, keys: list[str], order: str, name: str = "pos", **options: object
) -> DataFrame:
    """Exact 1-based row number over a unique integer ``order`` inside ``keys``."""
    return running(df, keys, order, {name: Running("count")}, **options)
