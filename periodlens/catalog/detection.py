"""Word graphs, detectors and their sweeps."""

from pyspark.sql import functions as F

from periodlens.catalog.registry import query
from periodlens.operators import evaluate as ev
from periodlens.operators import graph
from periodlens.plans import detection
from periodlens.session import materialise
from periodlens.sources import testtables as tt

THRESHOLDS = [5.0, 7.5, 10.0, 12.5, 15.0, 20.0, 25.0, 30.0]
VALUES = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
CUTS = [0.2, 0.4, 0.6, 0.8, 0.9, 1.0, 1.06, 1.1, 1.2]
CUT_VALUES = ", ".join(f"({t}::DOUBLE)" for t in CUTS)

DIST_SQL = """
sq AS (
  SELECT coalesce(c.MatchID, p.MatchID) AS MatchID, coalesce(c.rank, p.rank + 1) AS rank,
         sum((coalesce(c.w, 0) - coalesce(p.w, 0)) * (coalesce(c.w, 0) - coalesce(p.w, 0))) AS s
  FROM redges c FULL JOIN redges p ON c.MatchID = p.MatchID AND c.rank = p.rank + 1 AND c.a = p.a AND c.b = p.b
  GROUP BY ALL),
dist AS (
  SELECT r.MatchID, r.PeriodID, r.rank, CASE WHEN r.rank > 1 THEN sqrt(2 * coalesce(s, 0)) END AS distance
  FROM ranks r LEFT JOIN sq ON r.MatchID = sq.MatchID AND r.rank = sq.rank)
"""

P1_SQL = """
ls AS (SELECT c.MatchID, c.rank, sum(c.w * p.w) / sum(p.w * p.w) AS s
       FROM redges c JOIN redges p ON c.MatchID = p.MatchID AND c.rank = p.rank + 1 AND c.a = p.a AND c.b = p.b GROUP BY ALL),
score AS (SELECT r.MatchID, r.PeriodID, r.rank, CASE WHEN r.rank = 1 THEN -1.0 ELSE coalesce(ls.s, 0) END AS score
          FROM ranks r LEFT JOIN ls ON r.MatchID = ls.MatchID AND r.rank = ls.rank)
"""

# Two earlier periods: Cramer's rule on the 2 x 2 normal equations.
P2_SQL = """
h AS (SELECT c.MatchID, c.rank, c.w AS y, coalesce(p.w, 0) AS x1, coalesce(q.w, 0) AS x2
      FROM redges c
      LEFT JOIN redges p ON c.MatchID = p.MatchID AND c.rank = p.rank + 1 AND c.a = p.a AND c.b = p.b
      LEFT JOIN redges q ON c.MatchID = q.MatchID AND c.rank = q.rank + 2 AND c.a = q.a AND c.b = q.b),
n AS (SELECT MatchID, rank, sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22, sum(x1 * y) AS c1, sum(x2 * y) AS c2
      FROM h GROUP BY ALL),
ls AS (SELECT MatchID, rank,
         CASE WHEN g22 = 0 AND g11 = 0 THEN 0 WHEN g22 = 0 THEN c1 / g11 WHEN g11 = 0 THEN c2 / g22
              ELSE (c1 * g22 - c2 * g12 + c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) END AS s FROM n),
score AS (SELECT r.MatchID, r.PeriodID, r.rank, CASE WHEN r.rank = 1 THEN -1.0 ELSE coalesce(ls.s, 0) END AS score
          FROM ranks r LEFT JOIN ls ON r.MatchID = ls.MatchID AND r.rank = ls.rank)
"""

def deviation_sql(window: int, name: str = "score") -> str:
    """Scores for any number of earlier periods: normal equations by self-joins, solved on lists.

    Gauss-Jordan steps invert the matrix with a small number added to its diagonal, and each of a
    few refinements takes most of that number's effect back. Where the equations leave freedom,
    this leads to the solution of least length.
    """
    lags = range(1, window + 1)
    joins = "\n".join(
        f"LEFT JOIN redges p{k} ON c.MatchID = p{k}.MatchID AND c.rank = p{k}.rank + {k} AND c.a = p{k}.a AND c.b = p{k}.b" for k in lags
    )
    sums = [f"sum(x{i} * x{j}) AS g{i}_{j}" for i in lags for j in lags if i <= j] + [f"sum(x{i} * y) AS c{i}" for i in lags]
    cell = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    gram = ", ".join("[" + ", ".join(cell(i, j) for j in lags) + "]" for i in lags)
    right = ", ".join(f"c{i}" for i in lags)
    trace = " + ".join(cell(k, k) for k in lags)
    steps = "".join(
        f"""{name}_m{k} AS (SELECT MatchID, rank, g, c, list_transform(m, lambda r, i: CASE WHEN i = {k}
            THEN list_transform(r, lambda v: v / m[{k}][{k}])
            ELSE list_transform(r, lambda v, j: v - r[{k}] * m[{k}][j] / m[{k}][{k}]) END) AS m FROM {name}_m{k - 1}),
        """
        for k in lags
    )
    rounds = range(1, 7)
    refined = "".join(
        f"""{name}_r{k} AS (SELECT MatchID, rank, g, c, m, b, list_transform(c, lambda v, i: v - list_dot_product(g[i], b)) AS e FROM {name}_b{k - 1}),
        {name}_b{k} AS (SELECT MatchID, rank, g, c, m, list_transform(b, lambda v, i: v + list_dot_product(m[i][{window + 1}:], e)) AS b FROM {name}_r{k}),
        """
        for k in rounds
    )
    return f"""
{name}_h AS (SELECT c.MatchID, c.rank, c.w AS y, {', '.join(f'coalesce(p{k}.w, 0) AS x{k}' for k in lags)} FROM redges c
{joins}),
{name}_n AS (SELECT MatchID, rank, {', '.join(sums)} FROM {name}_h GROUP BY ALL),
{name}_l AS (SELECT MatchID, rank, [{gram}]::DOUBLE[][] AS g, [{right}]::DOUBLE[] AS c, 1e-8::DOUBLE * ({trace}) + 1e-30::DOUBLE AS lam FROM {name}_n),
{name}_m0 AS (SELECT MatchID, rank, g, c, list_transform(g, lambda r, i: list_concat(
    list_transform(r, lambda v, j: CASE WHEN i = j THEN v + lam ELSE v END),
    list_transform(r, lambda v, j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS m FROM {name}_l),
{steps}
{name}_b0 AS (SELECT MatchID, rank, g, c, m, list_transform(c, lambda v: 0.0::DOUBLE) AS b FROM {name}_m{window}),
{refined}
{name}_ls AS (SELECT MatchID, rank, list_sum(b) AS s FROM {name}_b{rounds[-1]}),
{name} AS (SELECT r.MatchID, r.PeriodID, r.rank, CASE WHEN r.rank = 1 THEN -1.0 ELSE coalesce(l.s, 0) END AS score
  FROM ranks r LEFT JOIN {name}_ls l ON r.MatchID = l.MatchID AND r.rank = l.rank)
"""


METRICS_SQL = """
SELECT threshold, count(*) AS n,
  round(count(*) FILTER (WHERE e = y) / count(*)::DOUBLE, 6) AS accuracy,
  round(coalesce(count(*) FILTER (WHERE e = 1 AND y = 1) / nullif(count(*) FILTER (WHERE e = 1), 0)::DOUBLE, 0), 6) AS precision,
  round(coalesce(count(*) FILTER (WHERE e = 1 AND y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2 * count(*) FILTER (WHERE e = 1 AND y = 1) / nullif(count(*) FILTER (WHERE e = 1) + count(*) FILTER (WHERE y = 1), 0)::DOUBLE, 0), 6) AS f1
FROM flags GROUP BY threshold
"""


def r4(col: str):
    return F.round(F.col(col), 4).alias(col)


# Sums of 1/n are compared on a grid that holds 1/2 .. 1/16 and the powers of two exactly, so
# that the order of summation cannot tip a value lying half way between two results.
GRID = 720720 * 64


def on_grid(value):
    return F.round(value * GRID).cast("bigint")


def graphs(spark, sf, **options):
    return detection.graphs(tt.posts(spark, sf), **options)


@query("graph_posts", "SELECT row_id, MatchID, PeriodID, t AS Preprocessed_Tweet FROM clean", "posts graph")
def graph_posts(spark, sf):
    return graph.graph_posts(tt.posts(spark, sf))


@query(
    "graph_edge_list",
    "SELECT row_id, count(*) AS n, min(concat(a, ' ', b)) AS first_pair, max(concat(a, ' ', b)) AS last_pair FROM pairs GROUP BY row_id",
    "posts graph",
)
def graph_edge_list(spark, sf):
    pairs = graph.edge_list_per_tweet(graph.graph_posts(tt.posts(spark, sf)))
    pair = F.concat_ws(" ", "a", "b")
    return pairs.groupBy("row_id").agg(
        F.count("*").alias("n"), F.min(pair).alias("first_pair"), F.max(pair).alias("last_pair")
    )


@query(
    "graph_edges",
    """SELECT MatchID, PeriodID, a, count(*) AS n, CAST(round(sum(w) * 46126080) AS BIGINT) AS w,
    min(b) AS first_b, max(b) AS last_b FROM edges GROUP BY MatchID, PeriodID, a""",
    "posts graph",
)
def graph_edges(spark, sf):
    """All edges, reported per left word: number, weights, and the range of right words."""
    edges, _ = graphs(spark, sf)
    return edges.groupBy("MatchID", "PeriodID", "a").agg(
        F.count("*").alias("n"),
        on_grid(F.sum("w")).alias("w"),
        F.min("b").alias("first_b"),
        F.max("b").alias("last_b"),
    )


CHAR_SQL = """
WITH single AS (SELECT DISTINCT MatchID, unnest(units) AS c FROM clean),
one AS (SELECT MatchID, list(c) AS single FROM single WHERE length(c) = 1 GROUP BY MatchID),
ch AS (SELECT MatchID, PeriodID, list_distinct(string_split(t, '')) AS chars FROM clean),
u AS (SELECT MatchID, PeriodID, list_sort(list_intersect(chars, single)) AS units, len(chars) AS n FROM ch JOIN one USING (MatchID)),
l AS (SELECT MatchID, PeriodID, units, n, unnest(units) AS a, generate_subscripts(units, 1) AS i FROM u),
p AS (SELECT MatchID, PeriodID, a, unnest(units[i + 1:]) AS b, 1.0::DOUBLE / n AS w FROM l)
SELECT MatchID, PeriodID, a, b, round(sum(w), 6) AS w FROM p GROUP BY MatchID, PeriodID, a, b
"""


@query("graph_edges_char", CHAR_SQL, "posts graph")
def graph_edges_char(spark, sf):
    edges, _ = detection.graphs(tt.posts(spark, sf), unit="char")
    return edges.select("MatchID", "PeriodID", "a", "b", F.round("w", 6).alias("w"))


@query(
    "graph_stats",
    """WITH nd AS (SELECT MatchID, PeriodID, a AS node FROM edges UNION SELECT MatchID, PeriodID, b FROM edges),
    nn AS (SELECT MatchID, PeriodID, count(*) AS n_nodes FROM nd GROUP BY ALL)
    SELECT MatchID, PeriodID, count(*) AS n_edges, CAST(round(sum(w) * 46126080) AS BIGINT) AS weight, any_value(n_nodes) AS n_nodes
    FROM edges JOIN nn USING (MatchID, PeriodID) GROUP BY ALL""",
    "posts graph",
)
def graph_stats(spark, sf):
    edges, _ = graphs(spark, sf)
    stats = graph.period_graph_stats(materialise(edges, "edges"))
    return stats.select("MatchID", "PeriodID", "n_edges", on_grid(F.col("weight")).alias("weight"), "n_nodes")


@query("graph_period_rank", "SELECT MatchID, PeriodID, rank FROM ranks", "posts graph")
def graph_period_rank(spark, sf):
    return graph.period_rank(graph.graph_posts(tt.posts(spark, sf)))


@query(
    "graph_period_rank_first_seen",
    """SELECT MatchID, PeriodID, row_number() OVER (PARTITION BY MatchID ORDER BY first_row) AS rank
    FROM (SELECT MatchID, PeriodID, min(row_id) AS first_row FROM clean GROUP BY ALL)""",
    "posts graph",
)
def graph_period_rank_first_seen(spark, sf):
    return graph.period_rank(graph.graph_posts(tt.posts(spark, sf)), "first_seen")


@query(
    "graph_edge_history",
    """WITH g AS (SELECT c.*, unnest(generate_series(1, least(12, c.rank - 1))) AS lag FROM redges c)
    SELECT g.MatchID, g.rank, g.lag, count(*) AS n, count(p.w) AS n_known, round(sum(g.w * coalesce(p.w, 0)), 4) AS xy
    FROM g LEFT JOIN redges p ON g.MatchID = p.MatchID AND p.rank = g.rank - g.lag AND p.a = g.a AND p.b = g.b GROUP BY ALL""",
    "posts graph",
)
def graph_edge_history(spark, sf):
    """The whole edge history, reported per period and lag."""
    past = graph.edge_history(*graphs(spark, sf, coded=True), graph.DEVIATION_WINDOW)
    return past.groupBy("MatchID", "rank", "lag").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("w_before") > 0).alias("n_known"),
        F.round(F.sum(F.col("w") * F.col("w_before")), 4).alias("xy"),
    )


@query(
    "evolution_distance",
    "WITH " + DIST_SQL + "SELECT MatchID, PeriodID, rank, round(distance, 4) AS distance FROM dist",
    "posts graph",
)
def evolution_distance(spark, sf):
    return graph.evolution_distance(*detection.pairs_and_ranks(tt.posts(spark, sf))).select("MatchID", "PeriodID", "rank", r4("distance"))


@query(
    "detect_evolution",
    "WITH " + DIST_SQL + """SELECT MatchID, PeriodID, rank, round(distance, 4) AS distance,
    CAST(count(*) FILTER (WHERE distance > 10) OVER (PARTITION BY MatchID ORDER BY rank) % 2 AS INT) AS is_event FROM dist""",
    "posts graph",
)
def detect_evolution(spark, sf):
    flags = detection.detect(tt.posts(spark, sf), "evolution", threshold=10.0)
    return flags.select("MatchID", "PeriodID", "rank", r4("distance"), "is_event")


@query(
    "sweep_evolution",
    "WITH " + DIST_SQL + f""",
    flags AS (SELECT threshold, EventType AS y,
        CAST(count(*) FILTER (WHERE distance > threshold) OVER (PARTITION BY MatchID, threshold ORDER BY rank) % 2 AS INT) AS e
      FROM dist JOIN lab USING (MatchID, PeriodID), (VALUES {VALUES}) v(threshold))""" + METRICS_SQL,
    "posts graph",
)
def sweep_evolution(spark, sf):
    report = detection.threshold_report(tt.posts(spark, sf), tt.period_labels(spark, sf), "evolution", THRESHOLDS)
    return report.select(
        "threshold", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    )


@query(
    "deviation_previous",
    "WITH " + P1_SQL + "SELECT MatchID, PeriodID, rank, round(score, 6) AS score FROM score",
    "posts graph",
)
def deviation_previous(spark, sf):
    pairs, ranks = detection.pairs_and_ranks(tt.posts(spark, sf))
    scores = graph.deviation_by_previous(graph.sum_pairs(pairs), ranks)
    return scores.select("MatchID", "PeriodID", "rank", F.round("score", 6).alias("score"))


@query(
    "deviation_window_1",
    "WITH " + P1_SQL + "SELECT MatchID, PeriodID, rank, round(score, 6) AS score FROM score",
    "posts graph",
)
def deviation_window_1(spark, sf):
    pairs, ranks = detection.pairs_and_ranks(tt.posts(spark, sf), packed=True)
    scores = graph.deviation_score(graph.sum_pairs(pairs), ranks, window=1)
    return scores.select("MatchID", "PeriodID", "rank", F.round("score", 6).alias("score"))


@query(
    "deviation_window_2",
    "WITH " + P2_SQL + "SELECT MatchID, PeriodID, rank, round(score, 6) AS score FROM score",
    "posts graph",
)
def deviation_window_2(spark, sf):
    pairs, ranks = detection.pairs_and_ranks(tt.posts(spark, sf), packed=True)
    scores = graph.deviation_score(graph.sum_pairs(pairs), ranks, window=2)
    return scores.select("MatchID", "PeriodID", "rank", F.round("score", 6).alias("score"))


@query(
    "deviation_window_12",
    "WITH " + deviation_sql(12) + """SELECT MatchID, PeriodID, rank, round(score, 6) AS score,
    CASE WHEN score >= 0.9 THEN 1 ELSE 0 END AS is_event FROM score""",
    "posts graph",
)
def deviation_window_12(spark, sf):
    flags = detection.detect(tt.posts(spark, sf), "deviation", threshold=0.9)
    return flags.withColumn("score", F.round("score", 6))


@query(
    "sweep_deviation",
    "WITH " + deviation_sql(12) + f""",
    flags AS (SELECT threshold, EventType AS y, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS e
      FROM score JOIN lab USING (MatchID, PeriodID), (VALUES {CUT_VALUES}) v(threshold))""" + METRICS_SQL,
    "posts graph",
)
def sweep_deviation(spark, sf):
    report = detection.threshold_report(
        tt.posts(spark, sf), tt.period_labels(spark, sf), "deviation", CUTS, windows=[graph.DEVIATION_WINDOW]
    )
    return report.select(
        "threshold", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    )


WINDOWS = [1, 5, 12]


@query(
    "sweep_deviation_windows",
    "WITH " + ", ".join(deviation_sql(w, f"score{w}") for w in WINDOWS) + f""",
    scores AS ({' UNION ALL '.join(f'SELECT *, {w} AS win FROM score{w}' for w in WINDOWS)}),
    flags AS (SELECT win, threshold, EventType AS y, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS e
      FROM scores JOIN lab USING (MatchID, PeriodID), (VALUES {CUT_VALUES}) v(threshold))"""
    + METRICS_SQL.replace("SELECT threshold", 'SELECT win AS "window", threshold').replace("GROUP BY threshold", "GROUP BY win, threshold"),
    "posts graph",
)
def sweep_deviation_windows(spark, sf):
    report = detection.threshold_report(
        tt.posts(spark, sf), tt.period_labels(spark, sf), "deviation", CUTS, windows=WINDOWS
    )
    return report.select(
        "window", "threshold", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    )


@query(
    "submission_overridden",
    "WITH " + DIST_SQL + """, f AS (SELECT MatchID, PeriodID, rank,
      CAST(count(*) FILTER (WHERE distance > 10) OVER (PARTITION BY MatchID ORDER BY rank) % 2 AS INT) AS e FROM dist)
    SELECT concat(MatchID, '_', PeriodID) AS ID, CASE WHEN rank <= 5 THEN 0 WHEN rank BETWEEN 123 AND 127 THEN 1
      WHEN rank > 127 THEN 0 ELSE e END AS EventType FROM f""",
    "posts graph",
)
def submission_overridden(spark, sf):
    return detection.submission(detection.detect(tt.posts(spark, sf), "evolution", threshold=10.0))


@query(
    "submission_keep_if_better",
    "WITH " + DIST_SQL + """, f AS (SELECT MatchID, PeriodID, rank, EventType AS y,
      CAST(count(*) FILTER (WHERE distance > 10) OVER (PARTITION BY MatchID ORDER BY rank) % 2 AS INT) AS e
      FROM dist JOIN lab USING (MatchID, PeriodID)),
    o AS (SELECT *, CASE WHEN rank <= 5 THEN 0 WHEN rank BETWEEN 123 AND 127 THEN 1 WHEN rank > 127 THEN 0 ELSE e END AS e2 FROM f),
    acc AS (SELECT MatchID, count(*) FILTER (WHERE e2 = y) > count(*) FILTER (WHERE e = y) AS better FROM o GROUP BY MatchID)
    SELECT MatchID, PeriodID, y AS EventType, CASE WHEN better THEN e2 ELSE e END AS is_event FROM o JOIN acc USING (MatchID)""",
    "posts graph",
)
def submission_keep_if_better(spark, sf):
    flags = detection.detect(tt.posts(spark, sf), "evolution", threshold=10.0)
    return detection.evaluated(flags, tt.period_labels(spark, sf)).select("MatchID", "PeriodID", "EventType", "is_event")


@query(
    "align_labels",
    "SELECT MatchID, PeriodID, rank, EventType FROM ranks JOIN lab USING (MatchID, PeriodID)",
    "posts graph",
)
def align_labels(spark, sf):
    ranks = graph.period_rank(graph.graph_posts(tt.posts(spark, sf)))
    return ev.align_labels(ranks, tt.period_labels(spark, sf))
