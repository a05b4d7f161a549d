from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera import store
from tessera.sources import files, jdbc
from tessera.streaming import queue as q

T0 = datetime(2025, 1, 1)


def test_queue_stream(spark, tmp_path):
    rows = [(i, "partnership news" if i % 2 else "nothing", f"m{i}", 4 if i == 3 else 0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, content string, source_id string, attempts int")
    df.write.parquet(str(tmp_path / "in"))

    def extract(text):
        if "bad" in text:
            raise RuntimeError
        return '[{"name": "Acme", "type": "Organization", "confidence": 0.9}]'

    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = q.process(stream, extract, str(tmp_path / "out"), str(tmp_path / "cp"), mode="whitelist", trigger={"availableNow": True}, keywords=("Partnership",))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/entities"))
    assert got.count() == 3 and {r.type for r in got.collect()} == {"organization"}
    assert {r.new_status for r in spark.read.parquet(str(tmp_path / "out/states")).collect()} == {"completed"}
    states = {r.id: r.new_status for r in spark.read.parquet(str(tmp_path / "out/states")).collect()}
    assert len(states) == 6  # items that the mode passes over have a state too
    failed = q.extracted(spark.createDataFrame([(1, "bad")], "id long, content string"), extract).first()
    assert failed.ok is False


def test_expiry(spark, tmp_path):
    schema = "key string, value string, ts timestamp"
    for n, rows in enumerate([[("a", "1", T0), ("b", "1", T0)], [("b", "2", T0 + timedelta(hours=3))], [("c", "1", T0 + timedelta(hours=4))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    seen = []
    query = q.expiring(stream, timedelta(hours=1)).writeStream.foreachBatch(lambda df, _n: seen.extend((r.key, r.value, r.expired) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert ("a", "1", True) in seen and ("b", "2", False) in seen


def test_processor_resolves_and_tries_again(spark, tmp_path):
    now = [T0]
    answers = {"one": '[{"name": " ACME ", "type": "organization", "aliases": ["AC"], "attributes": {"size": 3}, "confidence": 2}, {"name": "Bolt", "type": "odd"}]', "none": "no entities"}
    known = spark.createDataFrame([("e1", "n", "Acme", None, T0)], "id string, namespace string, name string, aliases array<string>, first_seen_at timestamp_ntz")
    run = q.Processor(spark, lambda t: answers[t], str(tmp_path / "out"), entities=lambda: known, max_attempts=2, now=lambda: now[0])
    items = spark.createDataFrame([(1, "n", "conversation", "m1", "one", 0), (2, "n", "conversation", "m2", "bad", 0), (3, "n", "conversation", "m3", "none", 0)], q.ITEM)
    run(items, 0)
    read = lambda name, n: spark.read.parquet(str(tmp_path / f"out/{name}/batch={n}")).collect()
    got = {r.name: r for r in read("entities", 0)}
    assert (got["ACME"].entity_id, got["ACME"].match, got["ACME"].aliases, got["ACME"].attributes, got["ACME"].confidence) == ("e1", "exact", ["AC"], {"size": "3"}, 1.0)
    assert got["Bolt"].match == "new" and got["Bolt"].type == "concept"
    assert len(read("mentions", 0)) == 2 and [r.relation_type for r in read("relationships", 0)] == ["related_to"]
    assert {r.id: r.new_status for r in read("states", 0)} == {1: "completed", 2: "pending", 3: "completed"}
    run(items.limit(0), 1)  # not due yet
    assert read("states", 1) == [] and [r.id for r in read("carried", 1)] == [2]
    now[0] = T0 + timedelta(days=1)
    run(items.limit(0), 2)
    assert [(r.id, r.new_status, r.attempts) for r in read("states", 2)] == [(2, "dead_letter", 2)] and read("carried", 2) == []


def test_late_changes_do_not_replace_newer_ones(spark, tmp_path):
    schema = "key string, value string, ts timestamp"
    for n, rows in enumerate([[("a", "new", T0 + timedelta(minutes=5))], [("a", "old", T0)], [("z", "1", T0 + timedelta(hours=9))], [("z", "2", T0 + timedelta(hours=9))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    seen = []
    query = q.expiring(stream, timedelta(hours=1)).writeStream.foreachBatch(lambda df, _n: seen.extend((r.key, r.value, r.expired) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [x for x in seen if x[0] == "a"] == [("a", "new", False), ("a", "new", True)]


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("alpha\nbeta")
    (tmp_path / "d/b.md").write_text("x")
    (tmp_path / "d/bad.txt").write_bytes(b"\xff\xfe\xfa")
    got = files.text_files(spark, str(tmp_path / "d"), glob="*.txt").orderBy("title").collect()
    assert [(r.title, r.content, r.error) for r in got] == [("a.txt", "alpha\nbeta", None), ("bad.txt", None, "not UTF-8")]
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([],), ([3.0],)], "v array<float>")
    packed = df.select(files.vector_bytes(df.v).alias("b"))
    assert [r.b and bytes(r.b) for r in packed.collect()] == [b"\0\0\x80?\0\0\0@", None, b"", b"\0\0@@"]
    assert [r.v for r in packed.select(files.bytes_vector(packed.b).alias("v")).collect()] == [[1.0, 2.0], None, [], [3.0]]
    assert spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(files.bytes_vector(F.col("b")).alias("v")).first().v is None
    assert files.batch(spark, [{"title": "t", "content": "c"}]).first().content_type == "text"
    tables = {"t": spark.createDataFrame([("n", "x", [1.0]), ("m", "y", [2.0])], "namespace string, id string, embedding array<float>")}
    sections = {"messages": spark.createDataFrame([("x", "n"), ("y", "n"), ("z", "m")], "id string, namespace string"), "message_embeddings": spark.createDataFrame([("x", [1.0])], "message_id string, embedding array<float>")}
    out = files.export_json(files.export_sections(sections.get, "n", True, ("messages",)), str(tmp_path / "x"))
    assert sorted((r.id, r.embedding) for r in spark.read.json(out["messages"]).collect()) == [("x", [1.0]), ("y", None)]
    assert files.export_sections(sections.get, "n", False, ("messages",))["messages"].columns == ["id", "namespace"]
    files.backup(tables, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/t.parquet")).count() == 2


def test_jdbc_and_backends(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).select(F.concat(F.lit("a"), "id").alias("alias"), F.lit("n").alias("namespace"), F.col("id").cast("string").alias("entity_id"), F.col("id").alias("n"))
    jdbc.jdbc_write(rows, url, "entity_aliases", driver)
    got = jdbc.jdbc_table(spark, url, "entity_aliases", driver, split_on="n", splits=4)
    assert got.rdd.getNumPartitions() == 4 and got.where("n = 7").first().alias == "a7" and got.count() == 100
    s = store.open_store(spark, {"backend": "jdbc", "root": str(tmp_path / "s"), "url": url, "properties": driver, "tables": ["entity_aliases"]})
    assert s.read("entity_aliases").count() == 100
    assert store.open_store(spark, {"root": str(tmp_path / "s")}).read("entity_aliases").count() == 100
    with pytest.raises(ValueError):
        store.open_store(spark, {"backend": "odd", "root": "x"})
