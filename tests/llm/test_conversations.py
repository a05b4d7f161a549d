import random
from datetime import datetime, timedelta

from tessera.llm import conversations as c

T0 = datetime(2025, 1, 1)
SCHEMA = "id string, namespace string, thread_id string, role string, content string, created_at timestamp_ntz, turn int"


def msg(i, thread, role, at, content="x"):
    return (f"m{i:05d}", "n", thread, role, content, None if at is None else T0 + timedelta(minutes=at), i)


def brute(rows, threads=()):
    ids = {r[2] for r in rows if r[2]} | set(threads)
    drop = set()
    for t in ids:
        mine = sorted({r for r in rows if r[2] == t and r[4] and r[4].strip()}, key=lambda r: (r[5] or datetime.min, r[0]))
        roles = [c.ROLES.get((r[3] or "").strip().lower()) for r in mine]
        said = [r for r in roles if r in ("user", "assistant")]
        bad = any(r[5] is None for r in mine) or None in roles or "user" not in said or "assistant" not in said or said[0] != "user"
        bad = bad or any(a == "user" and b != "assistant" for a, b in zip(said, [*said[1:], None], strict=True))
        if bad:
            drop.add(t)
    return ids, drop


def test_random_threads_and_a_hot_one(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for t in range(60):
        for at in range(rng.randint(0, 7)):
            i += 1
            role = ["user", "assistant"][at % 2] if rng.random() < 0.85 else rng.choice(["system", " TOOL", "Human", "bot", "moderator", None])
            rows.append(msg(i, f"t{t}", role, rng.choice([at, at, at, 0]) if rng.random() < 0.98 else None, rng.choice(["hi"] * 9 + ["  ", None, ""])))
    for at in range(2000):
        i += 1
        rows.append(msg(i, "hot", ["Human", "AI"][at % 2], at))
    rows += rows[::7] + [msg(99999, None, "user", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    threads = spark.createDataFrame([("t0", "a"), ("nobody", "b"), (None, "c")], "id string, turn string")
    ids, drop = brute(rows, ["t0", "nobody"])
    got = c.verdicts(df, threads).collect()
    assert len(got) == len(ids) and {r.thread_id for r in got} == ids
    assert {r.thread_id for r in got if not r.kept} == drop and "hot" not in drop
    turns = c.conversations(df, threads).where("thread_id = 'hot'").orderBy("turn").collect()
    assert [r.turn for r in turns] == list(range(1, 2001)) and {r.role for r in turns} == {"user", "assistant"}


def test_empty(spark):
    assert c.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0
