"""Language, importance and shingle classes against brute force, and the pipeline's stages."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest_llm import EDGE_ROWS, SF, read_rows, word_list
from tokenizers import Tokenizer

import corpus_pipeline
from periodlens.llm import importance, jaccard, language, lines, mixing, packing
from periodlens.llm.components import components


@pytest.fixture(scope="module")
def real():
    return read_rows(f"{SF}/documents.parquet", ["doc_id", "text", "lang", "source"])


# Components


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(5)
    n = 120
    edges = {
        "path": [(i, i + 1) for i in range(n)],
        "star": [(0, i) for i in range(1, n)] + [(500, 501)],
        "random": [tuple(int(x) for x in rng.integers(0, n, 2)) for _ in range(70)],
    }[shape]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# Shingle classes


def lowered(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in word_list(text)]


def brute_classes(rows, width, num, den):
    sets = {}
    for r in rows:
        ws = lowered(r[1])
        runs = {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()
        sets[r[0]] = runs
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = set()
    for ids in holders.values():
        for a, b in combinations(sorted(ids), 2):
            if (a, b) not in seen:
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def families():
    """Groups of edited copies around the threshold, short and long, with shared passages."""
    rng = np.random.default_rng(7)
    words = [f"v{i}" for i in range(3000)]
    common = [words[i] for i in rng.integers(0, 3000, 40)]
    rows, i = [], 0
    for length in (9, 10, 11, 12, 20, 40, 80, 250, 262, 300, 900, 1500):
        for copies in (2, 30 if length < 300 else 5):
            base = [words[k] for k in rng.integers(0, 3000, length)] + (common if length < 100 else [])
            for _ in range(copies):
                text = list(base)
                for _ in range(int(rng.integers(0, max(2, length // 18)))):
                    text[int(rng.integers(0, len(text)))] = words[int(rng.integers(0, 3000))]
                if rng.random() < 0.3:
                    text = text[: -int(rng.integers(1, 3))]
                rows.append((i, " ".join(text)))
                i += 1
    return [rows[k] for k in rng.permutation(len(rows))]


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_classes_of_edited_copies(docs_of, width, num):
    rows = families()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.overlap_classes(docs_of(rows), width=width, num=num).collect()}
    assert got == brute_classes(rows, width, num, 100)


def test_classes_of_real_rows(real, docs_of):
    rows = EDGE_ROWS + [(r[0] + 100, *r[1:]) for r in real]
    docs = docs_of(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.overlap_classes(docs, width=3, num=90).collect()}
    assert got == brute_classes(rows, 3, 90, 100)
    assert jaccard.overlap_classes(docs.limit(0)).collect() == []
    stay = jaccard.one_of_each(docs)
    want = brute_classes(rows, 5, 80, 100)
    assert stay.columns == docs.columns and {r["doc_id"] for r in stay.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_frequent_shingles_use_pairs():
    plan = jaccard.Plan(90, 100)
    tokens = np.sort(np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64) * np.uint64(2))
    rare = plan.files(200, tokens, np.full(200, 2))
    frequent = plan.files(200, tokens, np.full(200, 1000))
    assert len(rare) == len(plan.levels(200)) * (plan.misses(200) + 1) and 0 < len(frequent) < 20 * plan.misses(200)


def test_repeated_ids_and_rows(docs_of):
    text = " ".join(f"a{i}" for i in range(50))
    got = jaccard.overlap_classes(docs_of([(5, text), (5, text), (5, "other"), (6, text + " z"), (None, text)]), num=90).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("5", "5")] * 3 + [("6", "5"), ("None", "None")]


# Language


def test_language(spark, docs_of):
    rows = read_rows("/root/testdata/sf0.01/documents.parquet", ["doc_id", "text", "lang", "source"])
    odd = [(-1, None, "en", None), (-2, "", "en", None), (-3, "123 !? \n", None, None), (-4, "the of", None, None), (-5, "x" * 200000, None, None)]
    docs = docs_of(rows + odd)
    got = {r["row"]["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3 and got[-4]["lang_pred"] == "en"
    assert got[-5]["rejected"] and np.mean([got[r[0]]["rejected"] for r in rows]) < 0.01
    assert language.identify(docs.limit(0)).collect() == []
    nothing = language.identify(docs.where("doc_id < 0 and doc_id > -4").selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in nothing)


def brute_kneser_ney(texts, order):
    """Probability of a character after a context, by the textbook recursion."""
    keys = [language.runs([t])[0] for t in texts]
    counts = {order: Counter(int(k) for ks in keys for k in ks)}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g & ((1 << 12 * n) - 1) for g in counts[n + 1])

    def p(g, n):
        if n == 0:
            return 2.0**-12
        c = counts[n]
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones else 0.5
        same = [v for x, v in c.items() if x >> 12 == g >> 12]
        low = p(g & ((1 << 12 * (n - 1)) - 1), n - 1)
        if not same:
            return low
        return (max(c.get(g, 0) - d, 0) + d * len(same) * low) / sum(same)

    return p


def test_language_model_is_kneser_ney(spark):
    texts = ["abra cadabra", "a bra cad", "dab arc", "cab cab cab bard"]
    model = language.train(spark.createDataFrame([("x", t) for t in texts], "lang string, text string"))
    p = brute_kneser_ney(texts, language.ORDER)
    keys = np.unique(language.runs(["abra dab zebra card a", *texts])[0])
    got = model.log2("x", keys)
    assert np.allclose(got, [math.log2(p(int(k), language.ORDER)) for k in keys], atol=1e-4)


def test_language_model_in_parts(spark, monkeypatch):
    monkeypatch.setattr(language, "LOADED", 20)
    texts = ["abra cadabra", "a bra cad", "dab arc", "cab cab cab bard"]
    rows = [("x", t) for t in texts] + [("y", "dab"), ("z", "xyz")]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"), part=7)
    assert len(model.tables["x", 4, False]) > 1 and max(model.sizes) < 20
    keys = np.unique(language.runs(["abra dab zebra card a xyz", *texts])[0])
    for lang, of in (("x", texts), ("y", ["dab"]), ("z", ["xyz"])):
        p = brute_kneser_ney(of, language.ORDER)
        assert np.allclose(model.log2(lang, keys), [math.log2(p(int(k), language.ORDER)) for k in keys], atol=1e-4)


def test_language_model_keeps_every_run(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 4000, 6000))) for _ in range(200)]
    model = language.train(spark.createDataFrame([("zh", t) for t in texts], "lang string, text string"))
    want = len(np.unique(language.runs(texts)[0]))
    assert want > 1 << 20 and sum(model.sizes[i] for i in model.tables["zh", 4, False]) == want


def test_many_languages(spark, docs_of, monkeypatch):
    monkeypatch.setattr(language, "TOGETHER", 50)
    docs = docs_of([(3 * i + j, chr(0x4E00 + 40 * i) * 9, f"l{i:03}", None) for i in range(230) for j in range(3)])
    got = language.identify(docs, part=100).collect()
    learned = {r["doc_id"] // 3 for r in docs.where(~language.held_out("doc_id")).collect()}
    assert len(learned) > 200 and len(got) == 690
    assert all(r["lang_pred"] == f"l{r['row']['doc_id'] // 3:03}" for r in got if r["row"]["doc_id"] // 3 in learned)


# Importance


def test_importance(spark, docs_of):
    good = [(i, " ".join(f"g{(i * 7 + j) % 50}" for j in range(60))) for i in range(150)]
    bad = [(1000 + i, " ".join(f"b{(i * 5 + j) % 50}" for j in range(60))) for i in range(50)]
    docs = docs_of([*good, *bad, (5000, None), (5001, ""), (5002, "g1 " * 30000)])
    labels = spark.createDataFrame([(i, True) for i in range(0, 150, 2)] + [(1000 + i, False) for i in range(0, 50, 2)], "doc_id long, good boolean")
    got = {r["doc_id"]: r for r in importance.resample(docs, labels).collect()}
    assert len(got) == 203 and not got[5000]["kept"] and not got[5001]["kept"] and got[5000]["log_ratio"] is None
    assert np.mean([got[i]["kept"] for i, _ in good]) > 0.95 and np.mean([got[i]["kept"] for i, _ in bad]) < 0.15
    kept = sorted((r["draw"] for r in got.values() if r["kept"]), reverse=True)
    assert len(kept) == round(0.75 * 201) and kept[-1] > max(r["draw"] for r in got.values() if r["draw"] is not None and not r["kept"])
    assert importance.resample(docs.limit(0), labels).collect() == []
    assert importance.resample(docs, labels.limit(0)).where("kept").count() == 201


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = [*rng.standard_normal(500).tolist(), *[0.25] * 300, -1e12, 1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 250, 400, 802):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


# Pipeline


def test_pipeline_stages(spark, real, docs_of):
    docs = docs_of(EDGE_ROWS + [(r[0] + 100, *r[1:]) for r in real])
    now, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != names[-1]:
            assert out.columns == docs.columns
        rows = out.collect()
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "language_id":
            want = {r["row"]["doc_id"] for r in language.identify(now).where("not rejected").collect()}
            assert {r["doc_id"] for r in rows} == want and len(want) >= len(real) - 2
        elif name == "line_dedup":
            want = {r["doc_id"]: r["text"] for r in lines.dedup_lines(now).collect()}
            assert {r["doc_id"]: r["text"] for r in rows} == want
        elif name == "shingle_join":
            want = brute_classes(list(before.items()), 5, 80, 100)
            assert {r["doc_id"] for r in rows} == {i for i, (_, c) in want.items() if i == c}
        elif name == "source_mix":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(now).collect() if r["copies"]}
            assert Counter(r["doc_id"] for r in rows) == want
        else:
            assert sum(r["start"] == 0 for r in rows) == sum(1 for _ in now.collect())
        sizes.append(len(rows))
        now = spark.createDataFrame(rows, out.schema)
    assert all(sizes)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_packs_ids(spark, docs_of):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e"), (2, None), (3, "word " * 9000), (4, "A, b.")]
    plain = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = Counter(tuple(plain.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    got = corpus_pipeline.packing_stage(spark, docs_of(rows), SF).collect()
    sequences = defaultdict(dict)
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["offset"] not in sequences[r["sequence_id"]]
        sequences[r["sequence_id"]][r["offset"]] = r["ids"]
    for parts in sequences.values():
        at = 0
        for offset, ids in sorted(parts.items()):
            assert offset == at
            at += len(ids)
        assert at <= 4096
    long = sorted((r for r in got if r["doc_id"] == 3), key=lambda r: r["piece"])
    found = Counter(tuple(r["ids"][:-1]) for r in got if r["doc_id"] != 3)
    found[tuple([i for r in long for i in r["ids"]][:-1])] += 1
    assert len(long) > 1 and found == want


def test_late_column_stays_with_its_row(spark):
    pieces = spark.range(3000, numPartitions=7).selectExpr("1 doc_id", "id % 90 + 1 length", "array(cast(id as int)) ids")
    got = packing.pack(pieces, capacity=100, chunk=64).collect()
    assert sorted(r["ids"][0] for r in got) == list(range(3000))
    assert all(r["length"] == r["ids"][0] % 90 + 1 for r in got)
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 3000
