"""Cases that single-row tables don't show: repeated ids, clashing columns, long texts."""

import random
import time

from conftest_llm import word_list
from pyspark.sql import functions as F

from periodlens.llm import jaccard, language, lines, secrets, spans


def classes(rows, width, num, den=100):
    """{(id, text): least id reachable}; the texts of one id belong together."""
    sets = []
    for i, text in rows:
        w = [x.lower() for x in word_list(text)]
        s = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append((i, s))
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and den * len(s & t) >= num * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def test_links_of_every_text_of_an_id_count(docs_of):
    base = [f"a{i}" for i in range(50)]
    near = base[:25] + ["x"] + base[25:]
    other = [f"b{i}" for i in range(42)]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (6, " ".join(near)), (7, " ".join(other[:41])), (8, "alone in here")]
    want = classes(rows, 3, 90)
    assert want[6] == 5 and want[7] == 5
    for docs in (docs_of(rows), docs_of(rows * 3)):
        got = {r["doc_id"]: r["component_id"] for r in jaccard.overlap_classes(docs, width=3, num=90).collect()}
        assert got == want


def test_many_copies_just_below_the_threshold(docs_of):
    """One base text with edits from a small set of words: most pairs miss the threshold, some meet it."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(260):
        text = list(base)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(text))
            kind = rng.randrange(3)
            if kind == 0:
                text[at] = f"e{rng.randrange(4)}"
            elif kind == 1:
                del text[at]
            else:
                text.insert(at, f"e{rng.randrange(4)}")
        rows.append((i + 10, " ".join(text)))
    for width, num in ((3, 90), (5, 80)):
        want = classes(rows, width, num)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.overlap_classes(docs_of(rows), width=width, num=num).collect()}
        assert got == want and len(set(want.values())) > 10


def test_lines_keep_columns_of_any_name(spark, docs_of):
    docs = docs_of([(1, "a b\nc d\ne f\ng"), (2, "x\na b\nc d\ne f")])
    for c in ("id", "_id", "mark", "_mark", "_m", "_covered", "_gone", "row", "cut", "lines"):
        docs = docs.withColumn(c, F.create_map(F.lit(1), F.col("doc_id")))
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs).select(*docs.columns, "n_removed").collect()}
    assert out[2]["text"] == "x" and out[2]["n_removed"] == 3 and out[1]["text"] == "a b\nc d\ne f\ng"
    assert all(out[i][c] == {1: i} for i in out for c in ("_id", "row", "cut"))


def test_lines_of_a_long_text_take_linear_time(docs_of):
    def seconds(n):
        text = "\n".join(f"line {i % 700} {i // 1400}" for i in range(n))
        start = time.perf_counter()
        got = lines.dedup_lines(docs_of([(1, text), (2, text)])).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got}[2] == n
        return time.perf_counter() - start

    seconds(500)
    few, many = seconds(8_000), seconds(64_000)
    assert many < 8 * few + 5


def removed(rows, width=13):
    """{(id, text): words removed} by looking every run up in all smaller ids."""
    runs = {}
    for i, text in rows:
        w = word_list(text)
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            runs[key] = min(i, runs.get(key, i))
    out = {}
    for i, text in rows:
        w, gone = word_list(text), set()
        for j in range(len(w) - width + 1):
            if runs[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        out[i, text] = (len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_spans_of_repeated_rows(docs_of):
    words = [f"w{i}" for i in range(14)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:13], "x", *words[1:]]))]
    for times in (1, 2, 3):
        got = spans.remove_repeats(docs_of(rows * times)).collect()
        want = removed(rows)
        assert len(got) == 2 * times
        assert {(r["doc_id"], r["n_removed"], r["kept"]) for r in got} == {(i, *v) for (i, _), v in want.items()}


def test_secrets_of_long_texts(docs_of):
    def text(n):
        return " ".join(f"token = abcdef{i} AKIA{i:016d} {i:024x} plain" for i in range(n))

    def seconds(n):
        start = time.perf_counter()
        got = secrets.scan(docs_of([(1, text(n))])).collect()[0]["strong"]
        assert len(got) == 3 * n
        return time.perf_counter() - start, got

    import re

    _, got = seconds(700)
    want = sorted(
        (m.start(), rank, kind, m.end()) for rank, (kind, p) in enumerate(secrets.STRONG.items()) for m in re.finditer(p.replace("\\x20", " "), text(700))
    )
    assert [tuple(s) for s in got] == want
    few, many = seconds(2_000)[0], seconds(16_000)[0]
    assert many < 8 * few + 5


def test_a_language_of_short_texts_rejects_junk(docs_of):
    rng = random.Random(9)
    words = "the house stands near river where people walk every morning with their dogs".split()
    rows = [(i, " ".join(rng.choices(words, k=40)), "en") for i in range(60)]
    rows += [(100 + i, rng.choice(["\u4f60\u597d", "\u8c22\u8c22", "\u518d\u89c1", "\u4f60\u518d"]), "zh") for i in range(60)]
    junk = "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(400))
    rows += [(1000, "\u4f60\u597d" + junk, None)]
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language.identify(docs_of(rows)).collect()}
    assert got[1000] == ("zh", True) or got[1000][1]
    assert not any(bad for i, (_, bad) in got.items() if i < 1000)
