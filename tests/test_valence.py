import pyarrow as pa
import pyarrow.parquet as pq

from periodlens.catalog.counts import valence


def test_only_words_of_labelled_documents_are_taken_apart(spark, tmp_path):
    docs = [(1, "en", "Good good\tday\nbad"), (1, "en", "good  night"), (2, "de", "bad day"), (3, "en", "unknown"), (4, "en", None), (None, "en", "lost")]
    ids, langs, texts = map(list, zip(*docs))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": langs, "text": texts}), tmp_path / "documents.parquet")
    labels = pa.table({"doc_id": pa.array([1, 2, 2, 4, None], pa.int64()), "quality": pa.array([1, 0, 1, 1, 1], pa.int32())})
    pq.write_table(labels, tmp_path / "labels.parquet")
    scores = valence(spark, str(tmp_path))
    got = {r["word"]: r["score"] for r in scores.collect()}
    assert got == {"good": 1.0, "night": 1.0, "day": round(2 / 3 * 4 - 3, 2), "bad": round(2 / 3 * 4 - 3, 2)}
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("explode") < plan.index("LeftSemi")
