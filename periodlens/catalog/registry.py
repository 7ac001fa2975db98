"""Registration of named queries and shared SQL fragments."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from periodlens.functions import text as tx
from periodlens.sources.testtables import POSTS_SQL, RUNS_SQL, TRIALS_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = {"posts": POSTS_SQL, "runs": RUNS_SQL, "trials": TRIALS_SQL}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register ``name``; ``sql`` is its twin, ``views`` the named views it starts from.

    The twin may itself start with ``WITH``; the views are put in front.
    """

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            heads = [VIEWS[v].strip() for v in views.split()]
            body = sql.strip()
            if heads and body.startswith("WITH"):
                body = ",\n" + body[4:]
            ORACLES[name] = ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body
        return run

    return wrap


def sql_remove(expr: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{new}', 'g')"


def sql_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '[{tx.SPACE}]+'), lambda w: w <> '')"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# The stop words the queries use; operators take any list.
STOPWORDS = "a and are as at by der des die el en es et for in is la le les los of on que the to und un".split()

SQL_CLEAN_BASE = sql_remove(
    sql_remove(sql_remove(sql_remove("lower(Tweet)", tx.URL_GRAPH), tx.MENTION_GRAPH), tx.HASHTAG),
    tx.NONWORD_RUN,
    " ",
)


def sql_clean_tokens(after_retweets: str) -> str:
    """Every step of the literal rule order, including those the Spark expression can leave out."""
    return sql_tokens(
        sql_remove(
            sql_remove(sql_remove(after_retweets, tx.MENTION_HANDLE), tx.NONWORD_RUN, " "), f"[{tx.SPACE}+]", " "
        )
    )


SQL_CLEAN_TOKENS = sql_clean_tokens(sql_remove(SQL_CLEAN_BASE, tx.RETWEET))
SQL_CLEAN_TOKENS_ANCHORED = sql_clean_tokens(sql_remove(SQL_CLEAN_BASE, f"(^|[^{tx.WORD}]){tx.RETWEET}", "\\1"))


def sql_digest(text: str, digits: int = 12) -> str:
    """The head of an MD5 digest as a number."""
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def sql_distinct(words: str) -> str:
    """First occurrences of a list column, in order."""
    return f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"


SQL_ML_TOKENS = (
    "list_filter("
    + sql_tokens(
        sql_remove(
            sql_remove(sql_remove("lower(Tweet)", tx.URL_CLASSICAL), tx.MENTION_CLASSICAL),
            f"[^{tx.WORD}{tx.SPACE}#]",
        )
    )
    + f", lambda w: NOT list_contains({sql_list(STOPWORDS)}, w))"
)
SQL_EXPLORE_TOKENS = (
    "list_filter("
    + sql_tokens(sql_remove(sql_remove("lower(Tweet)", f"[^{tx.WORD}{tx.SPACE}]"), r"\p{Nd}+"))
    + f", lambda w: NOT list_contains({sql_list(STOPWORDS)}, w))"
)
SQL_IS_CLEAN = (
    f"(Tweet IS NOT NULL AND NOT contains(Tweet, '@') AND NOT regexp_matches(lower(Tweet), '{tx.URL_FILTER}') "
    f"AND NOT regexp_matches(lower(Tweet), '{tx.RETWEET_FILTER}'))"
)

VIEWS["texts"] = (
    """
texts AS (
  SELECT row_id, PeriodID, Tweet FROM posts
  UNION ALL
  SELECT -1 - page_id, CAST(page_id % 25 AS INT), concat('RT @page', page_id, ': ', url, ' #page', page_id % 7, ' ', html)
  FROM pages)
"""
)
VIEWS["graph"] = f"""
gtok AS (SELECT row_id, MatchID, PeriodID, {SQL_CLEAN_TOKENS} AS ws FROM posts),
gtext AS (SELECT row_id, MatchID, PeriodID, array_to_string({sql_distinct('ws')}, ' ') AS t FROM gtok WHERE len(ws) > 0),
clean AS (
  SELECT min(row_id) AS row_id, MatchID, arg_min(PeriodID, row_id) AS PeriodID, t,
         list_sort(string_split(t, ' ')) AS units
  FROM gtext GROUP BY MatchID, t),
ranks AS (
  SELECT MatchID, PeriodID, row_number() OVER (PARTITION BY MatchID ORDER BY PeriodID) AS rank
  FROM (SELECT DISTINCT MatchID, PeriodID FROM clean)),
left_unit AS (
  SELECT row_id, MatchID, PeriodID, units, unnest(units) AS a, generate_subscripts(units, 1) AS i FROM clean),
pairs AS (
  SELECT row_id, MatchID, PeriodID, a, unnest(units[i + 1:]) AS b, 1.0::DOUBLE / len(units) AS w FROM left_unit),
edges AS (
  SELECT MatchID, PeriodID, a, b, sum(w) AS w FROM pairs GROUP BY ALL),
redges AS (
  SELECT e.MatchID, r.rank, e.a, e.b, e.w FROM edges e JOIN ranks r USING (MatchID, PeriodID))
"""
