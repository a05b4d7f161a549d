import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as ch
from tessera.operators import fulltext as ft
from tessera.operators.ann import VectorIndex
from tessera.operators.postings import TextIndex
from tessera.operators.vectors import top_k
from tessera.plans.lineage import discard, written
from tessera.plans.metrics import observed
from tessera.plans.shared import Folder
from tessera.sources.embedding import Provider, hash_embedder


def test_text_index_ranks_like_a_scan(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "i.e.", "delta", "Omega"] + [f"w{i}" for i in range(40)]
    rows = [(f"d{i:03d}", " ".join(rng.choices(words, k=rng.randint(0, 60))) or None) for i in range(300)]
    df = spark.createDataFrame([*rows, *rows[:20]], "id string, text string")
    once = spark.createDataFrame(rows, "id string, text string")
    index = TextIndex(spark, str(tmp_path / "index")).build(df, "id", F.col("text"))
    for query in ("alpha omega", "i.e. beta", "alpha-beta", "nothing", "?"):
        want = [(r.id, round(r.score, 9), r["rank"]) for r in ft.search(once, F.col("text"), query, 15, "id").orderBy("rank").collect()]
        got = [(r.id, round(r.score, 9), r["rank"]) for r in index.search(query, 15).orderBy("rank").collect()]
        assert got == want
    files = index.search("alpha", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in files and "bucket" in files


def test_cells_find_most_of_the_nearest(spark, tmp_path):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 16))
    x = (middles[rng.integers(0, 40, 4_000)] + 0.4 * rng.normal(size=(4_000, 16))).astype(np.float32)
    rows = [(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("zero", [0.0] * 16), ("short", [1.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path / "cells"), 16).build(df)
    again, found = VectorIndex(spark, str(tmp_path / "cells"), 16), 0
    for i in range(0, 4_000, 400):
        query = x[i].tolist()
        true = {r.id for r in top_k(df, query, 10, "id").collect()}
        found += len(true & {r.id for r in again.search(query, 10, probes=12).collect()})
    assert found >= 0.9 * 100
    assert {r.id for r in index.search(x[0].tolist(), 10, probes=10_000).collect()} == {r.id for r in top_k(df, x[0].tolist(), 10, "id").collect()}
    assert VectorIndex(spark, str(tmp_path / "empty"), 16).build(df.limit(0)).search([1.0] * 16, 3).count() == 0


def test_cover_density_and_stems(spark):
    df = spark.createDataFrame([(1, "The cats chase a mouse. Mouse and cat!"), (2, "cat"), (3, "mice"), (4, None), (5, "cities cat city mouse boxes classes")], "id int, text string")
    got = {r.id: round(r.score, 6) for r in ft.match_stemmed(df, F.col("text"), "the cat mouses").collect()}
    # cats .. mouse is four words; then Mouse and cat three
    assert got == {1: round(1 / 4 + 1 / 3, 6), 5: round(1 / 3, 6)}
    assert ft.match_stemmed(df, F.col("text"), "the of").count() == 0
    stems = spark.createDataFrame([(w,) for w in ("cities", "boxes", "class", "bus", "cats", "aes", "shoes")], "w string").select(ft.stem(F.col("w")).alias("s")).collect()
    assert [r.s for r in stems] == ["city", "boxe", "class", "bus", "cat", "ae", "shoe"]


def test_windows_with_their_neighbours(spark):
    text = " ".join(f"w{i}" for i in range(23))
    rows = ch.fixed_chunks(spark.createDataFrame([(1, text), (2, "one"), (3, None), (4, " ")], "id int, text string"), "id", "text", 5, 1, around=2).orderBy("id", "chunk_index").collect()
    mine = [r.content for r in rows if r.id == 1]
    for i, r in enumerate(r for r in rows if r.id == 1):
        assert r.context_before == "\n\n".join(mine[max(0, i - 2) : i]) and r.context_after == "\n\n".join(mine[i + 1 : i + 3])
    assert [(r.content, r.context_before, r.context_after) for r in rows if r.id == 2] == [("one", "", "")] and {r.id for r in rows} == {1, 2}


def test_files_are_created_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    assert folder.names() == [] and folder.create("a/b", "text") and not folder.create("a/b", "other")
    assert folder.read("a/b") == "text" and folder.names("a")[-1] == "b"
    folder.delete("a")
    assert folder.names("a") == []


def test_written_tables_can_be_discarded(spark):
    t = written(spark.range(3).toDF("id"), "t")
    assert t.count() == 3
    discard(t)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        spark.read.parquet(t._written_at).count()


def test_counters_of_a_run(spark):
    df, seen = observed(spark.range(10).toDF("id"), "rows", n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    df.where("id < 3").collect()
    assert seen.get == {"n": 10, "odd": 5}


def test_provider_rules():
    p = Provider(hash_embedder(8), 8, limit=3)
    assert p.one("a b").shape == (8,) and np.array_equal(p.batch(["a b", "", None])[0], p.one("a b")) and not p.batch(["", None]).any()
    for wrong in (lambda: p.one(" "), lambda: p.batch(["x"] * 4)):
        with pytest.raises(ValueError):
            wrong()


def test_own_chunkers():
    ch.STRATEGIES["lines"] = lambda text, limit, overlap, embed: ((x, len(x.split())) for x in text.split("\n"))
    try:
        assert list(ch.cut("a b\nc", " Lines ", None, None, None)) == [("a b", 2), ("c", 1)] == list(ch.cut("a b\nc", "lines", 5, 0, None))
    finally:
        del ch.STRATEGIES["lines"]
    assert list(ch.cut("a b c", None, 2, 0, None)) == [("a b", 2), ("c", 1)]
