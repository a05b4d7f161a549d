import random
from datetime import datetime, timedelta

from tessera.operators import delete_vectors as dv

SCHEMA = "id long, namespace string, run_id string, key string, value string, version long, operation string, updated_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def feed(n, seed, first=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((first + i, "n", rng.choice([None, "", "r1"]), rng.choice(["hot", "hot", "a", "b", "c", None]), str(i), rng.randint(1, 5), rng.choice(["set", " SET", "Merge", "delete", "odd", None]), T0 + timedelta(seconds=rng.randint(0, 40))))
    return out


def brute(rows):
    state = {}
    for r in sorted(rows, key=lambda r: (r[7], r[5], r[0])):
        op = (r[6] or "").strip().lower()
        if op in dv.OPERATIONS:
            state[r[1], r[2] or "", r[3]] = (r, op)
    return {(k, r[5], r[0]) for k, (r, op) in state.items() if op != "delete"}


def entries(df):
    return {((r.namespace, r.run_id or "", r.key), r.version, r.id) for r in df.collect()}


def test_current_entries(spark, tmp_path):
    rows = feed(400, 1)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "f"))
    assert entries(dv.current_entries(spark.read.parquet(str(tmp_path / "f")))) == brute(rows)


def test_batches_in_any_order_end_alike(spark, tmp_path):
    rows = feed(300, 2)
    for order in (0, 1):
        parts = [rows[:100], rows[100:200], rows[200:]]
        random.Random(order).shuffle(parts)
        t = dv.DeleteVectorTable(spark, str(tmp_path / f"t{order}"))
        for p in parts:
            t.apply(spark.createDataFrame(p, SCHEMA))
        assert entries(t.read()) == brute(rows)


def test_empty_feed_and_deliveries_again(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "e"))
    assert dv.current_entries(spark.read.parquet(str(tmp_path / "e"))).count() == 0
    rows = feed(60, 3)
    again = rows + [(r[0] + 1000, *r[1:]) for r in rows]
    spark.createDataFrame(again, SCHEMA).write.parquet(str(tmp_path / "a"))
    got = dv.current_entries(spark.read.parquet(str(tmp_path / "a")))
    assert {(k, v) for k, v, _ in entries(got)} == {(k, v) for k, v, _ in brute(rows)}


def test_many_rows_cross_bitmaps(spark, tmp_path):
    n = 70_000
    spark.range(n).selectExpr("id", "'n' AS namespace", "'' AS run_id", "concat('k', id % 40000) AS key", "'1' AS value", "id AS version", "'set' AS operation", "timestamp_ntz '2025-01-01' AS updated_at").coalesce(1).write.parquet(str(tmp_path / "m"))
    got = dv.current_entries(spark.read.parquet(str(tmp_path / "m")))
    assert got.count() == 40_000 and got.selectExpr("min(id)").first()[0] == 30_000
