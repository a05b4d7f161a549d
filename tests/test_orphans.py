from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import orphans as o

T = [datetime(2025, 1, d) for d in range(1, 6)]
REFS = "table_name string, record_id string, target string, key string, created_at timestamp_ntz"
KNOWN = "target string, key string, created_at timestamp_ntz"


def brute(refs, known, gone):
    out = set()
    born = {}
    for t, k, at in known:
        if (t, k) not in born or (at is not None and (born[t, k] is None or at < born[t, k])):
            born[t, k] = at
    for table, rid, t, k, at in refs:
        if (t, k) in gone:
            out.add((table, rid, "deleted"))
        elif (t, k) not in born:
            out.add((table, rid, "missing"))
        elif born[t, k] is not None and at is not None and born[t, k] > at:
            out.add((table, rid, "late"))
    return out


def run(spark, refs, known, gone, ranges=3):
    got = o.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(known, KNOWN), spark.createDataFrame(list(gone), "target string, key string"), ranges)
    return [(r.table_name, r.record_id, r.ref_state) for r in got.collect()]


key = st.text("ab", min_size=1, max_size=2)
at = st.sampled_from(T)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    refs=st.lists(st.tuples(st.sampled_from(["x", "y"]), key, at), max_size=30),
    known=st.dictionaries(st.tuples(st.sampled_from(["x", "y"]), key), at, max_size=8),
    gone=st.sets(st.tuples(st.sampled_from(["x", "y"]), key), max_size=3),
)
def test_equals_brute_force(spark, refs, known, gone):
    rows = [("t", f"r{i}", t, k, a) for i, (t, k, a) in enumerate(refs)]
    parents = [(t, k, a) for (t, k), a in known.items()]
    got = run(spark, rows, parents, gone)
    assert len(got) == len(set(got)) and set(got) == brute(rows, parents, gone)


def test_hot_key_is_spread_and_whole(spark):
    rows = [("t", f"r{i}", "x", "hot" if i % 3 else f"k{i}", T[2]) for i in range(3000)]
    parents = [("x", "hot", T[3])] + [("x", f"k{i}", T[0]) for i in range(0, 3000, 6)]
    assert set(run(spark, rows, parents, set(), 8)) == brute(rows, parents, set())


def test_nulls_blanks_repeats_and_empty_tables(spark):
    chunks = spark.createDataFrame([("c1", " DOC-1 ", T[0]), ("c2", None, T[0]), ("c3", " ", T[0]), ("c4", "doc-2", None), ("c5", "doc-9", None), ("c5", "doc-9", None)], "id string, document_id string, created_at timestamp_ntz")
    docs = spark.createDataFrame([("doc-1", T[0], 1), ("doc-2", T[4], 2), (None, T[0], 3)], "id string, created_at timestamp_ntz, h int")
    deletions = spark.createDataFrame([], "table_name string, record_id string, deleted_at timestamp_ntz, restored_at timestamp_ntz")
    refs = o.references(chunks, "chunks", "document_id", F.lit("documents"))
    got = o.find_orphans(refs, o.parents(docs, "documents"), o.tombstones(deletions))
    assert [(r.record_id, r.ref_state) for r in got.collect()] == [("c5", "missing")]
    assert o.find_orphans(refs.limit(0), o.parents(docs, "documents"), o.tombstones(deletions)).count() == 0
    none = o.find_orphans(refs, o.parents(docs.limit(0), "documents"), o.tombstones(deletions))
    assert {r.record_id for r in none.collect()} == {"c1", "c4", "c5"}
    report = o.orphan_report(none).collect()
    assert sum(r.n_refs for r in report) == 3 and {r.month for r in report} == {"2025-01", ""}
