import json

from tessera.cli import main
from tessera.memory import Memory
from tessera.store import Store
from tests.oracle import DATA


def test_calls(spark, tmp_path):
    said = []
    main(["queries"], spark, said.append)
    assert "p4_found" in said[0] and "context_latest" in said[0]
    said.clear()
    main(["run", "dashboard_stats", str(DATA)], spark, said.append)
    assert json.loads(said[0])["documents"] > 0
    service = Memory(Store(spark, str(tmp_path / "s")), "ns")
    collection = service.knowledge_collection("c", "fixed", 8, 0)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("the harbour lies by the sea")
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xff")
    said.clear()
    main(["ingest", str(tmp_path / "s"), "ns", collection, str(tmp_path / "in")], spark, said.append)
    assert json.loads(said[0])["ingested"] == 1 and json.loads(said[0])["failed"][0].endswith("b.txt")
    said.clear()
    main(["search", str(tmp_path / "s"), "ns", "harbour", "-k", "1"], spark, said.append)
    assert json.loads(said[0])["content"] == "the harbour lies by the sea"
    said.clear()
    main(["stats", str(tmp_path / "s"), "ns"], spark, said.append)
    main(["gc", str(tmp_path / "s"), "ns", "--dry-run"], spark, said.append)
    main(["export", str(tmp_path / "s"), "ns", str(tmp_path / "x")], spark, said.append)
    main(["backup", str(tmp_path / "s"), "ns", str(tmp_path / "b")], spark, said.append)
    assert json.loads(said[0])["documents"] == 1 and set(json.loads(said[1])) == {"threads", "entities", "chunks", "history", "runs", "expired"}
    assert len(json.loads(said[2])) == 11 and "documents: 1" in said
