import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as ch
from tessera.operators import fulltext as ft
from tessera.operators import hybrid as hy
from tessera.operators import vectors as vec

SCHEMA = "id string, embedding array<float>, metadata map<string,string>, content string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = [(f"r{i:03d}", v.tolist(), {"topic": "ml" if i % 2 else "dl"} if i % 3 else None, f"word{i % 7} common text") for i, v in enumerate(rng.normal(size=(200, 8)))]
    bad = [("nul", None, None, None), ("zer", [0.0] * 8, None, ""), ("sho", [1.0], None, "x"), ("nan", [float("nan")] * 8, None, "x")]
    return out + bad + out[:50]  # some are delivered again


def cosines(rows, q):
    q = np.array(q) / np.linalg.norm(q)
    return {i: float(np.dot(v, q) / np.linalg.norm(v)) for i, v, *_ in rows if v and len(v) == 8 and np.isfinite(v).all() and any(v)}


def test_top_k_with_repeats_and_unusable_vectors(spark, rows):
    q = rows[7][1]
    want = sorted(cosines(rows, q).items(), key=lambda x: (-x[1], x[0]))[:12]
    df = spark.createDataFrame(rows, SCHEMA)
    for hits in (vec.top_k(df, q, 12, "id", repeated=True), vec.top_k(df.dropDuplicates(["id"]), q, 12, "id")):
        got = [(r.id, r.score, r["rank"]) for r in hits.orderBy("rank").collect()]
        assert [g[0] for g in got] == [w[0] for w in want] and [g[2] for g in got] == list(range(1, 13))
        assert [g[1] for g in got] == pytest.approx([(1 + c) / 2 for _, c in want], abs=1e-6)
    assert vec.top_k(df, q, 500, "id", repeated=True).count() == 200
    least = vec.top_k(df, q, 12, "id", mode="one_minus", min_score=want[4][1] - 1e-6, repeated=True)
    assert least.count() == 5


def test_metadata(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id for r in vec.with_metadata(df, {"topic": "ml"}).select("id").collect()}
    assert got == {r[0] for r in rows if (r[2] or {}).get("topic") == "ml"}


def test_batch(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).dropDuplicates(["id"])
    asked = spark.createDataFrame([("a", rows[3][1]), ("b", rows[9][1]), ("none", None)], "query_id string, embedding array<float>")
    got = {}
    for r in vec.batch_top_k(df, asked, 4, 8).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    want = lambda q: [i for i, _ in sorted(cosines(rows, q).items(), key=lambda x: (-x[1], x[0]))[:4]]
    assert got == {"a": want(rows[3][1]), "b": want(rows[9][1])}


def test_text_with_repeats(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    once = ft.search(df.dropDuplicates(["id"]), F.col("content"), "word3 common", 10, "id").select("id", "score", "rank")
    again = ft.search(df, F.col("content"), "word3 common", 10, "id", repeated=True).select("id", "score", "rank")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    assert ft.search(df, F.col("content"), "...", 10, "id").count() == 0


def test_modes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    q = rows[7][1]
    run = lambda query, **kw: hy.hybrid_search(df, "id", F.col("content"), query, q, 5, repeated=True, **kw).orderBy("rank").collect()
    assert run("word3", mode="vector")[0].id == rows[7][0]
    assert [r.score for r in run("nothing")] == pytest.approx([c for _, c in sorted(cosines(rows, q).items(), key=lambda x: -x[1])[:5]], abs=1e-6)
    assert run("nothing", empty_text_fallback=False)[0].score == pytest.approx(0.5 / 61)
    assert run("word3", mode="text")[0].score == pytest.approx(1 / 61)
    assert run("word3", min_score=0.5) == []


def test_neighbours(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", i, f"t{i}") for i in range(5)] + [("c1", "d", 1, "t1")], "id string, doc string, chunk_index int, content string")
    hits = spark.createDataFrame([("d", 2), ("d", 0), ("e", 1)], "doc string, chunk_index int")
    got = {(r.doc, r.chunk_index): (r.context_before, r.context_after) for r in ch.with_neighbours(hits, chunks, "doc", 2, 1).collect()}
    assert got == {("d", 2): ("t0\n\nt1", "t3"), ("d", 0): ("", "t1"), ("e", 1): (None, None)}
