import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import formatting as fmt
from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.functions.keys import code, is_blank
from tessera.operators import chunking as ch
from tessera.operators import fulltext as ft
from tessera.operators import hybrid as hy


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "n"), [("kitten", "sitting", 3), ("saturday", "sunday", 3), ("", "abc", 3), ("abc", "abc", 0), ("é", "e", 2)]
)
def test_edit_distance_in_bytes(spark, a, b, n):
    assert one(spark, sim.edit_distance(F.lit(a), F.lit(b))) == n


def test_similarity(spark):
    assert one(spark, sim.similarity(F.lit("abc"), F.lit("abc"))) == 1
    assert one(spark, sim.similarity(F.lit(""), F.lit("abc"))) == 0
    assert one(spark, sim.similarity(F.lit("acme corporaton"), F.lit("acme corporation"))) == pytest.approx(1 - 1 / 16)


@pytest.mark.parametrize(
    ("name", "initials"),
    [("International Business Machines", "IBM"), ("The United States of America", "USA"), ("Single", ""), ("Microsoft Corporation", "MC")],
)
def test_initialism(spark, name, initials):
    assert one(spark, sim.initialism(F.lit(name))) == initials


@pytest.mark.parametrize(
    ("a", "b", "c"), [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 1.0], [-1.0, -1.0], -1), ([], [], 0), ([1.0], [1.0, 2.0], 0), ([0.0], [1.0], 0)]
)
def test_cosine(spark, a, b, c):
    array = lambda v: F.array(*(F.lit(x) for x in v)).cast("array<float>")
    assert one(spark, sim.cosine(array(a), array(b))) == pytest.approx(c)


@pytest.mark.parametrize(("text", "n"), [("   spaces   everywhere   ", 2), ("", 0), ("a\tb\nc d", 4)])
def test_words(spark, text, n):
    assert one(spark, tx.word_count(F.lit(text))) == n


@pytest.mark.parametrize(
    ("text", "n"), [("Hello! How are you? I'm fine.", 3), ("Dr. Smith went home. He was tired.", 3), ("No period", 1), ("", 0)]
)
def test_sentences(spark, text, n):
    assert one(spark, F.size(tx.sentences(F.lit(text)))) == n == len(ch.split_sentences(text))


@pytest.mark.parametrize(("text", "n"), [("Windows\r\n\r\nLine endings", 2), ("\n\n\n", 0)])
def test_paragraphs(spark, text, n):
    assert one(spark, F.size(tx.paragraphs(F.lit(text)))) == n == len(ch.split_paragraphs(text))


def test_fixed_chunks(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, ""), (3, None), (4, "a b")], "id long, text string")
    got = [tuple(r) for r in ch.fixed_chunks(docs, "id", "text", 4, 1).orderBy("id", "chunk_index").collect()]
    assert got == [(1, 0, "one two three four", 4), (1, 1, "four five six seven", 4), (1, 2, "seven eight nine ten", 4), (4, 0, "a b", 2)]
    assert ch.sizes(0, -3) == (512, 512) and ch.sizes(8, 9) == (8, 6)


def test_packing():
    assert [n for _, n in ch.sentence_chunks("One two three. Four five six. Seven eight nine. Ten eleven twelve.", 10, 0)] == [9, 3]
    assert [c for c, _ in ch.paragraph_chunks("a b\n\nc d\n\ne f", 3, 0)] == ["a b", "c d", "e f"]
    assert [n for _, n in ch.sentence_chunks("w " * 25, 10, 2)] == [10, 10, 9]


def test_semantic_breaks():
    import numpy as np

    assert ch.breakpoints(np.array([[1.0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 1, 0]]), 0.5) == [2]
    text = "Cat sat. Cat ran. Cat ate. Sun hot. Sun set. Sun rose."
    embed = lambda texts: np.array([[t.count("Cat"), t.count("Sun")] for t in texts], float)
    chunks = [c for c, _ in ch.semantic_chunks(text, 100, 0, embed, width=1)]
    assert chunks == ["Cat sat. Cat ran. Cat ate.", "Sun hot. Sun set. Sun rose."]


def test_bm25_equals_sqlite(spark):
    docs = [(1, "alpha beta gamma alpha"), (2, "beta gamma"), (3, "alpha delta epsilon zeta eta theta"), (4, "iota kappa"), (5, "lambda mu nu xi omicron")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", docs)
    want = dict(con.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ?", (ft.prepare("alpha beta"),)).fetchall())
    got = {r.id: r.score for r in ft.bm25(spark.createDataFrame(docs, "id long, x string"), F.col("x"), "alpha beta").collect()}
    assert got == pytest.approx(want) and got[1] == pytest.approx(0.7852811098090335)


def test_query_preparation():
    assert ft.prepare('say "hi" a') == '"say" OR """hi"""'
    assert ft.prepare("a") == '"a"' and ft.phrases("state-of art") == [("state", "of"), ("art",)]


def test_phrases_overlap(spark):
    df = spark.createDataFrame([(1, "a-a a"), (2, "a b")], "id int, x string")
    assert {r.id for r in ft.match_all(df, F.col("x"), "a-a").collect()} == {1}


def test_fusion(spark):
    v = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    t = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    got = {r.id: r.score for r in hy.fuse(v, t, "id").collect()}
    assert got == pytest.approx({"b": 0.5 / 62 + 0.5 / 61, "a": 0.5 / 61, "c": 0.5 / 62})
    mirrored = {r.id: r.score for r in hy.fuse(t, v, "id", 0.3).collect()}
    assert mirrored == pytest.approx({r.id: r.score for r in hy.fuse(v, t, "id", 0.7).collect()})


def test_backoff_and_hash(spark):
    assert one(spark, fmt.backoff_seconds(F.lit(3))) == 8 and one(spark, fmt.backoff_seconds(F.lit(30))) == 300
    assert one(spark, fmt.backoff_seconds(F.lit(3), "fixed")) == 5
    text = "a long identifier that overflows 64 bits"
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & (2**64 - 1)
    assert one(spark, fmt.polynomial_hash(F.lit(text))) == h - (2**64 if h >= 2**63 else 0)


def test_keys(spark):
    assert one(spark, code(F.lit("  ABC　"))) == "abc"
    assert one(spark, code(F.lit("  "))) is None
    assert one(spark, is_blank(F.lit(" \n"))) is True and math.isfinite(1)


def test_string_map(spark):
    assert one(spark, fmt.string_map(F.lit('{"a":"x","b":3,"c":[1]}'))) == {"a": "x", "b": "3", "c": "[1]"}
    assert one(spark, fmt.string_map(F.lit("[1]"))) is None


def test_observed(spark):
    from tessera.plans.metrics import observed

    df, seen = observed(spark.range(10), "n", rows=F.count("*"), top=F.max("id"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "top": 9}
