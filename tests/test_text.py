import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from periodlens.functions import text as tx

GOLDEN = [
    ("GOAL!! Messi scores, goal goal #ARG http://t.co/x", "goal messi scores", False),
    ("RT @fifa: Half time", "time", False),
    ("support them now", "suppo now", False),
    ("start game", "sta", True),
    ("start the game", "sta game", False),
    ("mail me a@b.co", "mail me a co", False),
    ("https", "https", False),
    ("http", "http", True),
    ("Too good :)", "too good", True),
    ("#WorldCup", "", True),
    ("Ünïcode ñandú 2-1", "ünïcode ñandú 2 1", True),
    (None, None, False),
]


def test_golden_rows(spark):
    rows = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, Tweet string")
    c = F.col("Tweet")
    got = rows.select("i", tx.clean_graph(c).alias("clean"), tx.is_clean(c).alias("keep")).orderBy("i").collect()
    for row, (text, clean, keep) in zip(got, GOLDEN):
        assert (row["clean"], bool(row["keep"])) == (clean, keep), text


def test_anchored_retweets_keep_words(spark):
    rows = spark.createDataFrame([("support them now rt @me: hi",)], "t string")
    # Mentions go before the retweet rule, which then takes the next word.
    assert rows.select(tx.clean_graph(F.col("t"), anchored=True)).first()[0] == "support them now"


def python_clean(text):
    """The rules in their full literal order, in Python."""
    text = text.lower()
    for pattern, new in [
        (r"https?://\S+", ""), (r"@\w+", ""), (r"#\w+", ""), (r"\W+", " "),
        (r"rt @?[a-zA-Z0-9_]+:?", ""), (r"@[a-zA-Z0-9_]+:?", ""), (r"\W+", " "), (r"[\s+]", " "),
    ]:
        text = re.sub(pattern, new, text)
    return " ".join(dict.fromkeys(text.split()))


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abrt @#:/+.\n_éñ19hps", max_size=40), min_size=1, max_size=50))
def test_clean_graph_equals_all_steps(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(tx.clean_graph(F.col("t"))).collect()]
    assert got == [python_clean(t) for t in texts]


@pytest.mark.parametrize(
    "value,digits,want", [(0.125, 2, "0.12"), (0.5, 2, "0.5"), (2.0, 2, "2"), (0.7656, 3, "0.766"), (None, 2, None)]
)
def test_fixed_digits(spark, value, digits, want):
    rows = spark.createDataFrame([(value,)], "v double")
    assert rows.select(tx.fixed_digits(F.col("v"), digits)).first()[0] == want


def test_scientific_and_numbers(spark):
    rows = spark.createDataFrame([(0.0001, "0.5"), (0.00025, "x"), (1e-10, None)], "v double, s string")
    got = rows.select(tx.scientific(F.col("v")), tx.to_number(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("1.0e-4", 0.5), ("2.5e-4", None), ("1.0e-10", None)]


def test_placeholders_and_ids(spark):
    rows = spark.createDataFrame([([None, "a"],), ([],), (None,)], "t array<string>")
    got = [r[0] for r in rows.select(tx.empty_list_placeholder(F.col("t"))).collect()]
    assert got == [["[Empty Tweet]", "a"], ["[No Tweets]"], ["[No Tweets]"]]


def test_stopwords_keep_repeats_and_ml_cleaner(spark):
    rows = spark.createDataFrame([("The goal the GOAL! www.x.y @me #tag http://a",)], "t string")
    assert rows.select(tx.clean_ml(F.col("t"), ["the"])).first()[0] == "goal goal #tag"
    assert rows.select(tx.clean_explore(F.col("t"), ["the"])).first()[0] == "goal goal wwwxy me tag httpa"
