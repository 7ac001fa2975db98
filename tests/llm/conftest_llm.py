"""Rows and small helpers shared by the tests here."""

import re

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
#: Null and empty texts, white space alone, one word, very long texts that are equal, repeated lines.
EDGE_ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "word", None, "b"),
    (5, LONG, "en", "a"), (6, LONG, "en", "a"), (7, "é ü ñ ß 漢字 \U0001f600 x", "de", "z"), (8, "a b c\na b c\n\na b c", "de", "a"),
]


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def read_rows(path, columns):
    table = pq.read_table(path, columns=columns).to_pydict()
    return list(zip(*[table[c] for c in columns]))
