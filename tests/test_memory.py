from datetime import datetime, timedelta

import pytest

from tessera.memory import Memory
from tessera.operators import context as ctx
from tessera.operators import entities as ent
from tessera.operators import extraction as ex
from tessera.store import AlreadyExists, NotFound, Store, VersionConflict

T0 = datetime(2025, 1, 1)


@pytest.fixture
def memory(spark, tmp_path):
    return Memory(Store(spark, str(tmp_path / "store")), "ns")


def test_conversation(memory):
    for i, (role, text) in enumerate([("user", "where is the harbour"), ("assistant", "by the sea"), ("user", "and the compiler")]):
        memory.conversation_append("t1", role, text, at=T0 + timedelta(minutes=i))
    with pytest.raises(ValueError):
        memory.conversation_append("t1", "user", "")
    page = memory.conversation_history("t1", limit=2).orderBy("position").collect()
    assert [r.content for r in page] == ["and the compiler", "by the sea", "where is the harbour"]
    after = memory.conversation_history("t1", limit=2, after=(page[1].created_at, page[1].id)).collect()
    assert [r.content for r in after] == ["where is the harbour"]
    assert memory.conversation_search("harbour", k=1).first().content == "where is the harbour"
    assert memory.conversation_summarize("t1", lambda t: t.upper(), keep=1).startswith("[USER]: WHERE")
    assert memory._mine("messages").where("summarized").count() == 2
    memory.conversation_clear("t1")
    with pytest.raises(NotFound):
        memory.conversation_clear("t1")


def test_summaries_take_in_every_message(memory):
    """More messages than the 10,000 that were read once: all enter a summary, which is carried on."""
    n = 10_050
    rows = memory.spark.range(n).selectExpr("concat('m', lpad(id, 6, '0')) AS id", "'ns' AS namespace", "'t1' AS thread_id", "'user' AS role", "concat('text', id) AS content", "false AS summarized", "timestamp'2025-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS created_at")
    schema = memory._rows("messages", []).schema
    have = set(rows.columns)
    memory.store.append("messages", rows.selectExpr(*[(f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" if f.name in have else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}") for f in schema]))
    memory.store.append("threads", memory._rows("threads", [{"id": "t1", "namespace": "ns", "created_at": T0, "updated_at": T0}]))
    seen = []

    def summarize(text):
        seen.append(text)
        return f"summary {len(seen)}"

    assert memory.conversation_summarize("t1", summarize, keep=10) == f"summary {len(seen)}"
    read = [line.split("text")[1] for text in seen for line in text.split("\n\n") if line.startswith("[user]: ")]
    assert read == [str(i) for i in range(n - 10)] and memory._mine("messages").where("summarized").count() == n - 10
    assert seen[1].startswith("[system]: [Previous summary]: summary 1\n\n")
    calls = len(seen)
    assert memory.conversation_summarize("t1", summarize, keep=10) is None and len(seen) == calls
    memory.conversation_append("t1", "user", "more", at=datetime(2026, 1, 1))
    memory.conversation_summarize("t1", summarize, keep=10)
    assert seen[-1] == f"[system]: [Previous summary]: summary {calls}\n\n[user]: text{n - 10}"


def test_knowledge(memory):
    col = memory.knowledge_collection("docs", "fixed", 4, 0)
    with pytest.raises(AlreadyExists):
        memory.knowledge_collection("docs")
    got = memory.knowledge_bulk_ingest(col, [{"content": "alpha beta gamma delta epsilon zeta", "title": "greek"}, {"content": ""}])
    assert sorted((r.succeeded, r.n_chunks) for r in got.collect()) == [(False, 0), (True, 2)]
    hit = memory.knowledge_search("epsilon", k=1).first()
    assert hit.content == "epsilon zeta" and hit.context_before == "alpha beta gamma delta" and hit.title == "greek"


def test_context(memory):
    assert memory.context_set("k", {"a": 1}) == 1
    assert memory.context_merge("k", {"b": [1]}) == 2
    with pytest.raises(VersionConflict):
        memory.context_set("k", 3, expected_version=1)
    assert memory.context_get("k") == {"a": 1, "b": [1]}
    memory.context_delete("k")
    with pytest.raises(NotFound):
        memory.context_get("k")
    assert memory.context_history("k").count() == 3
    assert memory.context_set("k", 1) == 1 and [r.key for r in memory.context_list("k").collect()] == ["k"]


def test_entities(memory):
    a, b = memory.entity_create("Acme Corporation", "organization", ["Acme"]), memory.entity_create("Bolt Ltd", "organization")
    assert memory.entity_create(" acme corporation", "organization") == a
    c = memory.entity_create("Acme Corp", "organization")
    memory.entity_mention(c, "manual", "x")
    memory.entity_relate(a, b, "supplies")
    memory.entity_relate(c, b, "supplies")
    assert memory.entity_query("ACME")["match"] == "alias" and memory.entity_query("Acme Corporaton")["match"] == "fuzzy"
    assert memory.entity_merge(c, a)["mention_count"] == 1
    edges = memory.entity_relationships(a).collect()
    assert len(edges) == 1 and edges[0].mention_count == 2
    memory.entity_update(a, attributes={"city": "X"})
    assert memory._entity(a)["attributes"] == {"city": "X"} and "Acme Corp" in memory._entity(a)["aliases"]
    assert [r.name for r in memory.entity_list().orderBy("position").collect()] == ["Acme Corporation", "Bolt Ltd"]
    assert memory.entity_search("bolt", k=1).first().name == "Bolt Ltd"


def test_upserts_keep_aliases_and_descriptions(memory):
    memory.entity_relate("a", "b", "supplies", "old")
    memory.entity_relate("a", "b", "supplies", "latest")
    memory.entity_relate("a", "b", "supplies")
    assert [(r.description, r.mention_count) for r in memory.entity_relationships("a").collect()] == [("latest", 3)]
    rows = [("1", "ns", "Acme", "organization", ["AC", None], T0), ("2", "ns", "ACME", "organization", ["Acme Co", "AC"], T0 + timedelta(days=1)), ("3", "ns", "acme", "organization", None, T0)]
    got = ent.upserted(memory.spark.createDataFrame(rows, "id string, namespace string, name string, type string, aliases array<string>, extracted_at timestamp")).first()
    assert (got.name, got.aliases, got.n_observations) == ("ACME", ["AC", "Acme Co"], 3)


def test_upkeep(memory, tmp_path):
    memory.conversation_append("old", "user", "hi", at=T0)
    memory.conversation_append("new", "user", "hi", at=T0 + timedelta(days=100))
    memory.conversation_update("new", title="t")
    assert memory._mine("threads").where("title = 't'").count() == 1
    assert memory.gc(T0 + timedelta(days=60), conversation_days=30, dry_run=True)["threads"] == 1
    assert memory.gc(T0 + timedelta(days=60), conversation_days=30)["threads"] == 1
    assert memory.namespace_stats()["messages"] == 1
    memory.context_set("k", 1, ttl=T0)
    memory.context_set("r", 1, run_id="run")
    memory.context_set("s", 1)
    assert memory.context_cleanup() == 1 and memory.context_cleanup(run_id="run") == 1 and memory.context_get("s") == 1
    assert set(memory.export(str(tmp_path / "x"))) >= {"messages", "chunks"}
    memory.namespace_delete()
    assert sum(memory.namespace_stats().values()) == 0
    with pytest.raises(PermissionError):
        Memory(memory.store, "other", allowed="ns")


@pytest.mark.parametrize(
    ("old", "new", "strategy", "arrays", "want"),
    [
        ("x", "new", "replace", "replace", "new"),
        (["a", "b"], ["c"], "append", "replace", ["a", "b", "c"]),
        (10, 15, "max", "replace", 15),
        (10, 5, "min", "replace", 5),
        (10, 5, "sum", "replace", 15.0),
        (["a", "b"], ["b", "c"], "deep_merge", "concat_unique", ["a", "b", "c"]),
        ({"name": 1, "config": {"a": 1, "b": 2}}, {"config": {"b": 3, "c": 4}, "n": 0}, "deep_merge", "replace", {"name": 1, "config": {"a": 1, "b": 3, "c": 4}, "n": 0}),
    ],
)
def test_merging(old, new, strategy, arrays, want):
    assert ctx.merge_values(old, new, strategy, arrays) == want


def test_invalid_sum():
    with pytest.raises(ctx.InvalidMerge):
        ctx.merge_values("a", 1, "sum")


def test_fold(spark):
    rows = [(i, "n", None, "k", v, i, op, T0 + timedelta(seconds=i)) for i, (v, op) in enumerate([('{"a":1}', "set"), ('{"b":2}', "MERGE"), ("x", "delete"), ("[1]", "set"), ("[1,2]", "merge")])]
    log = spark.createDataFrame(rows, "id long, namespace string, run_id string, key string, value string, version long, operation string, updated_at timestamp_ntz")
    assert ctx.folded(log.where("id < 2"), "deep_merge").first().value == '{"a":1,"b":2}'
    assert ctx.folded(log, "deep_merge", "concat_unique").first().value == "[1,2]"
    assert ctx.folded(log.where("id < 3"), "deep_merge").count() == 0


@pytest.mark.parametrize("text", ['[{"name":"A"}]', '```json\n[{"name":"A"}]\n```', 'Here: [{"name":"A"}] done', '{"name":"A"}'])
def test_responses(text):
    assert ex.parse_response(text) == [{"name": "A"}]
    assert ex.parse_response("nothing") == []


def test_deletes_cascade(memory):
    memory.conversation_append("t", "user", "hi", at=T0)
    memory.conversation_append("u", "user", "ho", at=T0)
    memory.conversation_clear("t")
    assert memory.store.read("message_embeddings").count() == 1
    col = memory.knowledge_collection("c", "sentence", 4, 0)
    got = memory.knowledge_bulk_ingest(col, [{"content": "One two. Three four five."}, {"content": "Six."}], extract=True).orderBy("n_chunks").collect()
    assert memory.store.read("extraction_queue").count() == memory.store.read("chunks").count() == 3
    assert memory.document(got[0].document_id)["content"] == "Six." and memory.collection(col)["name"] == "c"
    memory.knowledge_document_delete(got[0].document_id)
    assert memory.store.read("chunks").count() == 2
    with pytest.raises(NotFound):
        memory.document(got[0].document_id)
    memory.knowledge_collection_delete(col)
    assert memory.namespace_stats() == {"threads": 1, "messages": 1, "collections": 0, "documents": 0, "chunks": 0, "entities": 0}
    a, b = memory.entity_create("A", "person"), memory.entity_create("B", "person")
    memory.entity_relate(a, b, "knows")
    memory.entity_mention(a, "manual", "x")
    memory.entity_delete(a)
    assert [memory.store.read(t).count() for t in ("entity_relationships", "entity_mentions", "entity_embeddings")] == [0, 0, 1]
    memory.namespace_delete()
    assert [memory.store.read(t).count() for t in ("message_embeddings", "entity_embeddings", "entity_aliases", "extraction_queue")] == [0, 0, 0, 0]


def test_vectors_are_upserted(memory):
    memory.conversation_append("t", "user", "hi", at=T0)
    key = memory.store.read("message_embeddings").first().message_id
    memory.embeddings_upsert("message_embeddings", memory.spark.createDataFrame([(key, [1.0]), ("other", [2.0])], "message_id string, embedding array<float>"))
    assert {r.message_id: r.embedding for r in memory.store.read("message_embeddings").collect()} == {key: [1.0], "other": [2.0]}


def test_two_writers(memory):
    """A version that another writer has made in between turns the second away, or makes it look again."""
    other = Memory(memory.store, "ns")
    version = memory.store.version("context_history")
    memory.context_set("k", 1)
    with pytest.raises(VersionConflict):
        memory.store.append("context_history", memory.store.read("context_history"), version)
    original, calls = ctx.current, []

    def slow(log):
        calls.append(1)
        got = original(log)
        if len(calls) == 1:
            got.collect()
            other.context_set("k", 2)
        return got

    ctx.current = slow
    try:
        assert memory.context_set("k", 3) == 3 and memory.context_get("k") == 3
        with pytest.raises(VersionConflict):
            memory.context_merge("k", 4, expected_version=2)
    finally:
        ctx.current = original
    assert [r.version for r in memory.context_history("k").orderBy("position").collect()] == [3, 2, 1]


def test_arrays_concatenate_unless_told_otherwise(memory):
    memory.context_set("k", {"a": [1]})
    memory.context_merge("k", {"a": [1, 2]})
    assert memory.context_get("k") == {"a": [1, 1, 2]}
    memory.context_merge("k", {"a": [2]}, arrays="concat_unique")
    memory.context_merge("k", {"b": 1, "a": 3})
    assert memory.context_get("k") == {"a": [1, 2, 3], "b": 1}
    assert ctx.merge_values([1], [2], arrays="replace") == [2] and ctx.merge_values(1, 2) == 2 and ctx.merge_values(None, [1]) == [1]


def test_six_rules(memory):
    memory.context_set("k", 1)
    memory.context_set("k", 2)
    memory.context_set("r", 1, run_id="run")
    memory.context_set("t", 1, ttl=T0)
    later = datetime(2100, 1, 1)
    want = {"threads": 0, "entities": 0, "chunks": 0, "history": 1, "runs": 1, "expired": 1}
    assert memory.gc(later, history_days=1, run_days=1, dry_run=True) == want == memory.gc(later, history_days=1, run_days=1)
    assert [r.key for r in memory.context_list().collect()] == ["k"] and memory.context_get("k") == 2
    assert sum(memory.gc(later, history_days=1, run_days=1).values()) == 0


def test_long_threads_are_summarised_when_read(memory):
    memory.summarizer = lambda text: f"{text.count('[user]')} messages"
    rows = [{"id": f"m{i:03d}", "namespace": "ns", "thread_id": "t", "role": "user", "content": "x", "created_at": T0 + timedelta(minutes=i)} for i in range(60)]
    memory.store.append("messages", memory._rows("messages", rows))
    memory.store.append("threads", memory._rows("threads", [{"id": "t", "namespace": "ns", "created_at": T0, "updated_at": T0}]))
    page = memory.conversation_history("t", limit=3, reading_order=True).collect()
    assert [r.id for r in page] == ["m057", "m058", "m059"] and memory.thread("t")["summary"] == "50 messages"
    memory.conversation_update("t", metadata={"a": "1"})
    memory.conversation_update("t", title="x", metadata={"b": "2"})
    assert memory.thread("t")["metadata"] == {"a": "1", "b": "2"} and memory.thread("t")["title"] == "x"


def test_entity_calls(memory):
    with pytest.raises(ValueError):
        memory.entity_create("X", "odd")
    a, b = memory.entity_create("Acme", "organization", ["AC"]), memory.entity_create("Bolt", "organization")
    assert memory.entity_create("acme", "organization", ["Acme Co"]) == a and memory._entity(a)["aliases"] == ["AC", "Acme Co"]
    memory.entity_add_alias(b, "AC")
    owner = {r.alias: r.entity_id for r in memory.store.read("entity_aliases").collect()}
    assert owner["ac"] == b and owner["acme co"] == a


def test_export_and_backup(memory, tmp_path):
    memory.conversation_append("t", "user", "hi", at=T0)
    memory.entity_create("Acme", "organization")
    memory.context_set("k", 1)
    out = memory.export(str(tmp_path / "x"), embeddings=True)
    read = lambda s: memory.spark.read.json(out[s])
    assert len(out) == 11 and len(read("messages").first().embedding) == 64 and read("aliases").first().alias == "acme" and read("context").first().key == "k"
    assert list(memory.export(str(tmp_path / "y"), sections=("threads",))) == ["threads"]
    told = []
    memory.store.backup(str(tmp_path / "b"), lambda name, n: told.append((name, n)))
    assert ("messages", 1) in told


def test_rows_of_an_older_schema_are_migrated(memory):
    old = memory._rows("context_history", [{"id": 1, "namespace": "ns", "run_id": "", "key": "k", "value": "7", "version": 1, "operation": "set", "updated_at": T0}]).drop("ttl_expires_at")
    old.write.parquet(f"{memory.store.root}/context_history/part-old")
    memory.store._commit("context_history", 1, [["part-old", 1]])
    assert memory.context_get("k") == 7 and memory.context_set("k", 8) == 2


def test_namespaces_may_be_restricted(memory):
    assert Memory(memory.store, "ns", allowed="ns").namespace == "ns"
    with pytest.raises(PermissionError):
        Memory(memory.store, "ns", allowed="other")
