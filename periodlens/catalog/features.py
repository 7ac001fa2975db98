"""TF-IDF, splits, pooling and neighbour queries."""

from pyspark.sql import functions as F

from periodlens.catalog.counts import FEATURES_SQL
from periodlens.catalog.registry import query, sql_digest, sql_tokens
from periodlens.functions import text as tx
from periodlens.operators import features as ft
from periodlens.operators import neighbours as nb
from periodlens.plans import exploration
from periodlens.session import materialise
from periodlens.sources import testtables as tt

DIMS = 64


def r6(col: str):
    return F.round(F.col(col), 6).alias(col)


TFIDF_SQL = f"""
d AS (SELECT row_id, regexp_extract_all(lower(Tweet), '{tx.TERM}') AS ts FROM posts WHERE Tweet IS NOT NULL),
x AS (SELECT row_id, unnest(ts) AS term FROM d),
top AS (SELECT term, count(*) AS tf, count(DISTINCT row_id) AS df FROM x GROUP BY term ORDER BY tf DESC, term LIMIT 5000),
voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, tf, df,
               ln((1 + (SELECT count(*) FROM d)) / (1 + df)::DOUBLE) + 1 AS idf FROM top)
"""


@query("tfidf_fit", "WITH" + TFIDF_SQL + "SELECT term, idx, tf, df, round(idf, 6) AS idf FROM voc", "posts")
def tfidf_fit(spark, sf):
    return ft.tfidf_fit(tt.posts(spark, sf), "Tweet").select(
        "term", F.col("idx").cast("bigint").alias("idx"), "tf", "df", r6("idf")
    )


@query(
    "tfidf_weights",
    "WITH" + TFIDF_SQL + """, c AS (SELECT row_id, idx, count(*) * any_value(idf) AS w FROM x JOIN voc USING (term) GROUP BY ALL),
    n AS (SELECT row_id, sqrt(sum(w * w)) AS norm FROM c GROUP BY row_id)
    SELECT row_id, idx, round(w / norm, 6) AS weight FROM c JOIN n USING (row_id)""",
    "posts",
)
def tfidf_weights(spark, sf):
    posts = tt.posts(spark, sf)
    vocabulary = materialise(ft.tfidf_fit(posts, "Tweet"), "vocabulary")
    sparse = ft.tfidf_weights(posts, "row_id", "Tweet", vocabulary)
    cells = sparse.select("row_id", F.inline(F.arrays_zip("idx", "weight")))
    return cells.select("row_id", F.col("idx").cast("bigint").alias("idx"), r6("weight"))


def sql_side(key: str, seed: int, fraction: float, below: str, above: str) -> str:
    return f"CASE WHEN {sql_digest(f"concat_ws('-', {key}, {seed})")} / 281474976710656.0::DOUBLE < {fraction}::DOUBLE THEN '{below}' ELSE '{above}' END"


@query(
    "random_split",
    f"SELECT {sql_side('row_id', 42, 0.8, 'train', 'validation')} AS split, EventType, count(*) AS n FROM posts GROUP BY ALL",
    "posts",
)
def random_split(spark, sf):
    done = ft.random_split(tt.labelled_posts(spark, sf), 0.8, 42, "row_id")
    return done.groupBy("split", "EventType").agg(F.count("*").alias("n"))


@query(
    "stratified_split_exact",
    "SELECT EventType, CAST(round(count(*) * 0.1::DOUBLE) AS BIGINT) AS validation, count(*) AS n FROM posts GROUP BY EventType",
    "posts",
)
def stratified_split_exact(spark, sf):
    done = ft.stratified_split(tt.labelled_posts(spark, sf), 0.1, 7, "row_id", "EventType", exact=True)
    return done.groupBy("EventType").agg(
        F.count_if(F.col("split") == "validation").alias("validation"), F.count("*").alias("n")
    )


@query(
    "stratified_split",
    f"SELECT EventType, {sql_side('row_id', 7, 0.1, 'validation', 'train')} AS split, count(*) AS n FROM posts GROUP BY ALL",
    "posts",
)
def stratified_split(spark, sf):
    done = ft.stratified_split(tt.labelled_posts(spark, sf), 0.1, 7, "row_id", "EventType")
    return done.groupBy("EventType", "split").agg(F.count("*").alias("n"))


@query(
    "split_members",
    "SELECT row_id, doc_id FROM posts WHERE doc_id IN (SELECT doc_id FROM labels)",
    "posts",
)
def split_members(spark, sf):
    return ft.split_members(tt.posts(spark, sf), tt.table(spark, sf, "labels"), "doc_id").select("row_id", "doc_id")


@query(
    "split_overlap",
    """SELECT count(*) AS overlap FROM (SELECT Tweet FROM posts WHERE MatchID = 9 INTERSECT SELECT Tweet FROM posts WHERE MatchID <> 9)""",
    "posts",
)
def split_overlap(spark, sf):
    posts = tt.posts(spark, sf)
    return ft.split_overlap(posts.where("MatchID = 9"), posts.where("MatchID <> 9"), "Tweet")


def sql_hashing(words: str, dims: int, name: str = "v") -> str:
    """One column per slot: the words of the slot with a plus less those with a minus."""
    codes = f"list_transform({words}, lambda w: {sql_digest('w')} % {2 * dims})"
    count = lambda c: f"len(list_filter({codes}, lambda c: c = {c}))"
    return ", ".join(f"({count(2 * i)} - {count(2 * i + 1)})::DOUBLE AS {name}{i}" for i in range(dims))


@query(
    "embed_text_hashing",
    f"WITH t AS (SELECT row_id, list_transform({sql_tokens('lower(Tweet)')}, lambda w: w) AS ws FROM posts)"
    f" SELECT row_id, {sql_hashing('ws', 16)} FROM t",
    "posts",
)
def embed_text_hashing(spark, sf):
    done = ft.embed_text(tt.posts(spark, sf).select("row_id", "Tweet"), "Tweet", dims=16)
    return done.select("row_id", *[F.get("vec", F.lit(i)).cast("double").alias(f"v{i}") for i in range(16)])


def positions(spark, sf):
    """Embeddings as positions of ten groups; a vector counts as padding if its first entry is negative."""
    vectors = tt.table(spark, sf, "embeddings")
    return vectors.select(
        F.col("label").alias("ID"),
        F.col("vec_id").alias("pos"),
        F.col("embedding").alias("vec"),
        (F.get("embedding", F.lit(0)) >= 0).alias("is_real"),
        ft.dot(F.col("embedding"), [1.0] * DIMS).alias("score"),
    )


POS_SQL = """
e AS (SELECT label AS ID, vec_id AS pos, list_transform(embedding, lambda v: v::DOUBLE) AS vec, embedding[1] >= 0 AS is_real,
             list_sum(list_transform(embedding, lambda v: v::DOUBLE)) AS score FROM embeddings),
x AS (SELECT ID, pos, is_real, score, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM e)
"""


def exploded(df, out: str = "v"):
    """Vectors as (ID, dim, value) rows for comparison."""
    return df.select("ID", F.posexplode("pooled").alias("dim", out)).select(
        "ID", F.col("dim").cast("bigint").alias("dim"), r6(out)
    )


@query("pool_mean_masked", "WITH" + POS_SQL + "SELECT ID, dim, round(avg(v), 6) AS v FROM x WHERE is_real GROUP BY ALL")
def pool_mean_masked(spark, sf):
    return exploded(ft.masked_mean_pool(positions(spark, sf), "ID", "vec", "is_real"))


@query("pool_max", "WITH" + POS_SQL + "SELECT ID, dim, round(max(v), 6) AS v FROM x WHERE is_real GROUP BY ALL")
def pool_max(spark, sf):
    return exploded(ft.max_pool(positions(spark, sf), "ID", "vec", "is_real"))


@query("pool_first", "WITH" + POS_SQL + "SELECT ID, dim, round(arg_min(v, pos), 6) AS v FROM x GROUP BY ALL")
def pool_first(spark, sf):
    first = ft.first_position_pool(positions(spark, sf), "ID", "vec", "pos")
    return exploded(first.withColumn("pooled", F.col("pooled").cast("array<double>")))


SOFT_SQL = """
s AS (SELECT *, exp(score - max(score) OVER (PARTITION BY ID)) AS w FROM x {where})
SELECT ID, dim, round({value}, 6) AS v FROM s GROUP BY ALL
"""


@query("pool_attention", "WITH" + POS_SQL + "," + SOFT_SQL.format(where="WHERE is_real", value="sum(w * v) / sum(w)"))
def pool_attention(spark, sf):
    return exploded(ft.attention_pool(positions(spark, sf), "ID", "vec", "score", "is_real"))


@query("pool_attention_unmasked", "WITH" + POS_SQL + "," + SOFT_SQL.format(where="", value="sum(w * v) / sum(w)"))
def pool_attention_unmasked(spark, sf):
    return exploded(ft.attention_pool(positions(spark, sf), "ID", "vec", "score", "is_real", masked=False))


@query(
    "pool_attention_epsilon",
    "WITH" + POS_SQL + "," + SOFT_SQL.format(
        where="",
        value="(sum(w * v) FILTER (WHERE is_real) / sum(w)) / (sum(w) FILTER (WHERE is_real) / sum(w) + 1e-8::DOUBLE)",
    ),
)
def pool_attention_epsilon(spark, sf):
    return exploded(ft.attention_pool(positions(spark, sf), "ID", "vec", "score", "is_real", epsilon=1e-8))


@query(
    "pool_concat",
    "WITH" + POS_SQL + """, s AS (SELECT *, exp(score - max(score) OVER (PARTITION BY ID)) AS w FROM x),
    p AS (SELECT ID, dim, sum(w * v) / sum(w) AS a, avg(v) AS m, max(v) AS x FROM s GROUP BY ALL)
    SELECT ID, dim, round(a, 6) AS v FROM p UNION ALL SELECT ID, dim + 64, round(m, 6) FROM p
    UNION ALL SELECT ID, dim + 128, round(x, 6) FROM p""",
)
def pool_concat(spark, sf):
    return exploded(ft.pooled_concat(positions(spark, sf), "ID", "vec", "score"))


@query(
    "assemble_features",
    "WITH" + POS_SQL + """, p AS (SELECT ID, dim, avg(v) AS v FROM x GROUP BY ALL),
    f AS (SELECT label AS ID, count(*) AS n, avg(vec_id) AS m FROM embeddings GROUP BY label)
    SELECT ID, dim, round(v, 6) AS v FROM p UNION ALL SELECT ID, 64, n FROM f UNION ALL SELECT ID, 65, round(m, 6) FROM f""",
)
def assemble_features(spark, sf):
    rows = positions(spark, sf)
    extra = rows.groupBy("ID").agg(F.count("*").alias("n"), F.avg("pos").alias("m"))
    done = ft.assemble_features(ft.masked_mean_pool(rows, "ID", "vec"), extra, "ID", ["n", "m"])
    return exploded(done.withColumnRenamed("features", "pooled"))


@query(
    "select_feature_columns",
    "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS f0, round(embedding[4]::DOUBLE, 6) AS f3, round(embedding[64]::DOUBLE, 6) AS f63 FROM embeddings",
)
def select_feature_columns(spark, sf):
    picked = ft.select_feature_columns(tt.table(spark, sf, "embeddings"), "vec_id", "embedding", [0, 3, 63])
    return picked.select(
        "vec_id", *[F.round(F.get("embedding", F.lit(i)).cast("double"), 6).alias(n) for i, n in enumerate(("f0", "f3", "f63"))]
    )


WV_SQL = f"""
wr AS (SELECT word, min(doc_id) AS vec_id FROM (SELECT doc_id, unnest({sql_tokens('lower(Tweet)')}) AS word FROM posts) GROUP BY word),
wv AS (SELECT word, list_transform(embedding, lambda v: v::DOUBLE) AS vec FROM wr JOIN embeddings USING (vec_id)),
tk AS (SELECT row_id, {sql_tokens('lower(Tweet)')} AS ws FROM posts),
pl AS (SELECT row_id, CAST(g AS INT) AS pos, ws[g + 1] AS word FROM tk, generate_series(0, 19) t(g))
"""


@query(
    "token_vectors",
    "WITH" + WV_SQL + """SELECT row_id, pos, pl.word, round(coalesce(vec[1], 0), 6) AS v0, round(coalesce(vec[64], 0), 6) AS v63
    FROM pl LEFT JOIN wv ON pl.word = wv.word""",
    "posts",
)
def token_vectors(spark, sf):
    """A word takes the vector numbered like the first document it occurs in; others are unknown."""
    posts = tt.posts(spark, sf)
    words = posts.select("doc_id", F.explode(tx.tokenize(F.lower("Tweet"))).alias("word"))
    firsts = words.groupBy("word").agg(F.min("doc_id").alias("vec_id"))
    table = firsts.join(tt.table(spark, sf, "embeddings"), "vec_id").select("word", F.col("embedding").alias("vec"))
    done = ft.token_vectors(posts, "row_id", "Tweet", table, DIMS, 20)
    return done.select(
        "row_id", "pos", "word",
        F.round(F.get("vec", F.lit(0)), 6).alias("v0"), F.round(F.get("vec", F.lit(63)), 6).alias("v63"),
    )


KNN_SQL = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, b.label, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d)
"""


@query("knn_join", "WITH" + KNN_SQL + "SELECT vec_id, neighbour, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10")
def knn_join(spark, sf):
    vectors = tt.table(spark, sf, "embeddings")
    near = nb.knn_join(vectors, vectors, 10, "vec_id", "embedding", exclude_self=True)
    return near.select("vec_id", "neighbour", r6("distance"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "knn_classify",
    "WITH" + KNN_SQL + """, c AS (SELECT vec_id, label, count(*) AS n FROM r WHERE rank <= 10 GROUP BY ALL)
    SELECT vec_id, label AS predicted FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1""",
)
def knn_classify(spark, sf):
    vectors = tt.table(spark, sf, "embeddings")
    return nb.knn_classify(vectors, vectors, 10, "vec_id", "embedding", exclude_self=True)


@query(
    "id_lookup",
    "SELECT p.row_id, l.EventType FROM post0 p JOIN lab l USING (MatchID, PeriodID)",
    "posts",
)
def id_lookup(spark, sf):
    return tt.labelled_posts(spark, sf).select("row_id", "EventType")


VECTORS_SQL = f"""{FEATURES_SQL},
ht AS (SELECT ID, {sql_tokens('lower(Tweet)')} AS ws FROM kept),
hv AS (SELECT ID, {sql_hashing('ws', 16)} FROM ht),
hm AS (SELECT ID, {', '.join(f'round(avg(v{i}), 6) AS f{i}' for i in range(16))} FROM hv GROUP BY ID),
hz AS (SELECT ID, {', '.join(
    f'round(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 6) AS f{i}'
    for i, c in enumerate(('NumTweets', 'AvgTweetLength', 'PeriodID'), 16)
)} FROM feat)
SELECT * FROM hm JOIN hz USING (ID)
"""


@query("period_feature_vectors", "WITH" + VECTORS_SQL, "posts")
def period_feature_vectors(spark, sf):
    """Hashed text vectors pooled per period with the normalised features appended."""
    posts = materialise(exploration.prepared(tt.labelled_posts(spark, sf)), "prepared-posts")
    vectors = ft.embed_text(posts, "Tweet", dims=16)
    pooled = ft.masked_mean_pool(vectors, "ID", "vec")
    extra = exploration.normalised_periods(posts)
    done = ft.assemble_features(pooled, extra, "ID", ["NumTweets", "AvgTweetLength", "NormalizedPeriod"])
    return done.select("ID", *[F.round(F.get("features", F.lit(i)), 6).alias(f"f{i}") for i in range(19)])
