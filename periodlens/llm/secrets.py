"""Find secrets in texts, and link weak parts of credentials that stand together.

Strong kinds are reported wherever they match. A weak kind (a user name, a bare 40-character key,
an endpoint) is common in harmless text, so it is reported only when its complement starts within
``scope`` code points of it: a user name needs a secret, a bare key needs an identifier, an
endpoint needs both. The interval join behind this runs on cells of ``scope`` code points: a part
can only link to parts of its own cell and the two beside it, and of a neighbour cell only the
nearest start counts, so no pairs are listed. Text is read once; all else moves spans only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodlens.llm.tables import let, saved

SCOPE = 400
# The patterns of the kinds, in the order in which equal starts are listed.
STRONG = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
WEAK = {
    "user": r"""(?i)(?:user_?name|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "key40": r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "endpoint": r"""(?i)(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+""",
}
KINDS = {**STRONG, **WEAK}
LEAST_VALUE = 6
IDENTIFIERS = ("access", "user")
SECRETS = ("assign", "hex", "key40")
# A private-use character that no pattern matches; a text's own ones are replaced before.
FENCE, OTHER = "\ue000", "\ufffd"

#: Parts of a text that one growing list is made from; an even number.
CHUNK = 512

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def spans_of(text: Column, kind: str) -> Column:
    """array of (start, rank, kind, end): the leftmost non-overlapping matches, in code points."""
    pattern = KINDS[kind]
    fenced = F.regexp_replace(F.replace(text, F.lit(FENCE), F.lit(OTHER)), pattern, FENCE + "$0" + FENCE)
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("match"), empty.alias("found"))
    rank = list(KINDS).index(kind)

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.char_length(part)
        span = F.struct(
            acc["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")
        )
        good = acc["match"]
        if kind == "assign":
            good = good & (F.char_length(F.regexp_extract(part, pattern, 2)) >= LEAST_VALUE)
        found = F.when(good, F.array_append(acc["found"], span)).otherwise(acc["found"])
        return F.struct(end.alias("at"), (~acc["match"]).alias("match"), found.alias("found"))

    def walked(parts: Column) -> Column:
        # Fences come in pairs, so every second part is a match, and each chunk starts with none.
        # A list that grows is copied at every step, so chunks keep it short.
        chunks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int"))
        local = F.transform(chunks, lambda c: F.aggregate(F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)), start, step))
        return let(local, placed)

    def placed(local: Column) -> Column:
        none = F.expr("cast(array() as array<bigint>)")
        first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("all"))
        grown = F.aggregate(
            local, first, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
        )["all"]

        def moved(x: Column, base: Column) -> Column:
            return F.transform(
                x["found"],
                lambda s: F.struct((s["start"] + base).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + base).alias("end")),
            )

        return F.flatten(F.zip_with(local, grown, moved))

    return F.when(text.rlike(pattern), let(F.split(fenced, FENCE), walked)).otherwise(empty)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, strong, linked) of every row: arrays of (start, rank, kind, end), by start and kind.

    Null texts are empty. Rows equal in id and text link the same parts. An empty table gives an
    empty result.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), value.alias("text"), F.xxhash64(value).alias("mark"))
    both = lambda kinds: F.sort_array(reduce(lambda a, b: F.concat(a, b), [spans_of(F.col("text"), k) for k in kinds]))
    found = saved(plain.select("id", "mark", both(STRONG).alias("strong"), both(WEAK).alias("weak")), "secret-parts")
    parts = (
        found.where(F.size("weak") > 0)
        .select("id", "mark", F.explode(F.concat("strong", "weak")).alias("p"))
        .select("id", "mark", "p", F.floor(F.col("p.start") / scope).alias("cell"))
    )
    near = {"identifier": IDENTIFIERS, "secret": SECRETS}
    cells = parts.groupBy("id", "mark", "cell").agg(
        *[
            f(F.when(F.col("p.kind").isin(*kinds), F.col("p.start"))).alias(f"{role}_{n}")
            for role, kinds in near.items()
            for n, f in (("first", F.min), ("last", F.max))
        ]
    ).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("cell").alias("_cell"),
             *[f"{r}_{n}" for r in near for n in ("first", "last")])
    weak = parts.where(F.col("p.kind").isin(*WEAK)).distinct().select(
        "id", "mark", "p", "cell", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)])).alias("side")
    )
    at = F.col("p.start")

    def beside(role: str) -> Column:
        here = F.col(f"{role}_first").isNotNull()
        return (
            F.when(F.col("side") == 0, here)
            .when(F.col("side") < 0, F.col(f"{role}_last") >= at - scope)
            .otherwise(F.col(f"{role}_first") <= at + scope)
        )

    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")) & (F.col("cell") + F.col("side") == F.col("_cell"))
    seen = (
        weak.join(cells, on)
        .groupBy("id", "mark", "p")
        .agg(*[F.coalesce(F.bool_or(beside(r)), F.lit(False)).alias(r) for r in near])
    )
    kind = F.col("p.kind")
    linked = (
        seen.where(
            F.when(kind == "user", F.col("secret"))
            .when(kind == "key40", F.col("identifier"))
            .otherwise(F.col("secret") & F.col("identifier"))
        )
        .groupBy("id", "mark")
        .agg(F.sort_array(F.collect_list("p")).alias("linked"))
        .select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), "linked")
    )
    return found.join(
        linked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left"
    ).select(
        F.col("id").alias(id_col), "strong",
        F.coalesce("linked", F.expr(f"cast(array() as array<{SPAN}>)")).alias("linked"),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
