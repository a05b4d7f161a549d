import random

from tessera.llm import leakage
from tessera.llm.leakage import leaks


def test_found_and_not_found(spark):
    rng = random.Random(1)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(600)]
    passages = [(i, " ".join([*(rng.choice(vocab) for _ in range(40)), "in", str(1900 + i), "percent", "Kalon"])) for i in range(12)]
    docs, want = [], set()
    for d in range(120):
        text = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        item, p = rng.choice(passages)
        w = p.split()
        at = rng.randrange(len(w) - 22)
        kind = d % 4
        if kind == 0:
            part = w[at : at + 22]
        elif kind == 1:
            part = [x if i % 5 != 4 else rng.choice(vocab) + "x" for i, x in enumerate(w[at : at + 22])]
        elif kind == 2:
            part = [x for i, x in enumerate(w[at : at + 22]) if i % 7 != 6]
            part.insert(9, "inserted")
        else:
            part = w[at : at + 10]
        pos = rng.randrange(len(text))
        text[pos:pos] = [f"<b>{x.upper()}</b>," if rng.random() < 0.3 else x for x in part]
        docs.append((d, " ".join(text), "x"))
        if kind != 3:
            want.add((d, item))
    docs += [(900, None, "x"), (901, "", "x"), (902, "word " * 5000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*passages, passages[0], (77, None), (78, "too short")], "item_id long, passage string")
    everything = leaks(df, items).collect()
    assert len(everything) == len({(r.doc_id, r.item_id) for r in everything})
    got = [r for r in everything if r.kind == "words"]
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert leaks(df, items.limit(0)).count() == 0 and leaks(df.limit(0), items).count() == 0


def test_slots(spark):
    passage = "the rover carried 12 crates to Kalon and then 12 barrels to Pritot while Kalon sent nothing back to the old harbour town"
    consistent = passage.replace("12", "34")
    mixed = passage.replace("12 crates", "34 crates").replace("12 barrels", "56 barrels")
    got = leaks(spark.createDataFrame([(1, consistent), (2, mixed)], "doc_id long, text string"), spark.createDataFrame([(5, passage)], "item_id long, passage string")).collect()
    assert {r.doc_id: r.slots_agree for r in got} == {1: True, 2: False}


SLOTS = "on day 3 Kalon sold 14 crates to Pritot for 250 coins and on day 8 Pritot sold 14 barrels to Kalon for 90 coins at the old harbour"
#: All eight values exchanged, one to one: ten of any twenty words, far more than exact agreement allows.
CHANGED = {"3": "5", "Kalon": "Vostrik", "14": "77", "Pritot": "Ulmeda", "250": "613", "8": "9", "90": "41"}


def test_slots_decide_what_words_can_not(spark):
    other = " ".join(CHANGED.get(w, w) for w in SLOTS.split())
    mixed = other.replace("77 barrels", "78 barrels")
    merged = other.replace("Ulmeda sold", "Vostrik sold")
    unlike = " ".join("the" if i % 3 else w for i, w in enumerate(other.split()))
    docs = [(1, SLOTS), (2, f"Before it. {other} And after."), (3, mixed), (4, merged), (5, unlike), (6, f"{other} {SLOTS}")]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, SLOTS)], "item_id long, passage string")).collect()
    assert {r.doc_id: (r.kind, r.slots_agree) for r in got} == {1: ("words", True), 2: ("template", True), 3: ("template", False), 4: ("template", False), 6: ("words", True)}


def test_blocks_of_items_share_one_scan(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", 2)
    passages = [(i, " ".join(f"w{i}x{j}" for j in range(25))) for i in range(9)]
    docs = spark.createDataFrame([(i, f"start {p} end <a title='{'long ' * 100}'>") for i, p in passages], "doc_id long, text string")
    got = leaks(docs, spark.createDataFrame(passages, "item_id long, passage string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(9)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
