import itertools
import random

from pyspark.sql import functions as F

from tessera.llm import neardup
from tessera.llm.neardup import NearDuplicates, tokens


def texts(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for d in range(80):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        out.append(("a", f"d{d}", " ".join(base)))
        for v in range(rng.choice([0, 0, 1, 3])):
            other = list(base)
            for _ in range(max(1, len(base) // 25)):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            out.append((rng.choice("ab"), f"d{d}v{v}", rng.choice([" ".join(other), "<b>" + ", ".join(other).upper()])))
    out += [("a", "copy1", out[0][2]), ("a", "copy2", out[0][2].upper()), ("a", "copy2", out[0][2].upper())]
    return out


def brute(rows, width, threshold, least):
    sets = {}
    for c, i, t in rows:
        w = tokens(t or "")
        if i and len(w) >= least:
            sets[c, i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return {(c, *sorted((i, j))) for ((c, i), x), ((e, j), y) in itertools.combinations(sets.items(), 2) if c == e and i != j and len(x & y) / len(x | y) >= threshold}


def test_pairs_equal_brute_force(spark):
    rows = [*texts(1), ("a", "null", None), ("a", "empty", ""), ("a", "short", "one two"), ("a", None, texts(1)[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "collection string, id string, text string, rid string")
    got = [tuple(r) for r in NearDuplicates(df, 3, 0.6, 20).pairs().collect()]
    want = brute(rows, 3, 0.6, 20)
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= 0.02 * len(want)


def _footed(n, own, footer, seed, alike=0.0):
    """n distinct texts with one footer; some come in pairs that share their own words but one."""
    rng = random.Random(seed)
    foot = [f"f{i}" for i in range(footer)]
    out = []
    while len(out) < n:
        words = [f"o{rng.randrange(1 << 30)}" for _ in range(own)]
        out.append([*words, *foot])
        if rng.random() < alike:
            other = list(words)
            other[own // 2] = "changed"
            out.append([*other, *foot])
    return [("a", f"x{i:05d}", " ".join(w)) for i, w in enumerate(out[:n])]


def _links(spark, rows, threshold=0.6):
    return NearDuplicates(spark.createDataFrame(rows, "collection string, id string, text string"), 3, threshold, 20)


def test_one_long_body_links_all(spark):
    body = [f"b{i}" for i in range(300)]
    rows = [("a", f"x{i:03d}", " ".join([*body, f"tail{i}"])) for i in range(150)]
    assert _links(spark, rows, 0.8).pairs().count() == 150 * 149 // 2


def test_footer_of_many_distinct_texts(spark, monkeypatch):
    """2,000 texts, half of each a shared footer: the linked ones are found, and few pairs are ever looked at."""
    looked_at = []
    original = neardup._common_runs
    monkeypatch.setattr(neardup, "_common_runs", lambda pairs, sets: (looked_at.append(pairs.count()), original(pairs, sets))[1])
    rows = _footed(2_000, 40, 40, 3, 0.2)
    got = {(r.id_a, r.id_b) for r in _links(spark, rows).pairs().collect()}
    assert got == {(a[1], b[1]) for a, b in itertools.pairwise(rows) if len(set(a[2].split()) - set(b[2].split())) < 3}
    assert len(looked_at) == 2 and sum(looked_at) < 20 * len(rows)


def test_boilerplate_of_every_share_equals_brute_force(spark):
    for own, footer in ((30, 60), (24, 66), (20, 30)):
        rows = _footed(150, own, footer, own, 0.3) + _footed(100, own + 20, footer, 9, 0.3)
        rows = [(c, f"{i:04d}", t) for i, (c, _, t) in enumerate(rows)]
        got = {tuple(r) for r in _links(spark, rows).pairs().collect()}
        want = brute(rows, 3, 0.6, 20)
        assert got <= want and len(want - got) <= 0.01 * len(want)


def test_a_thousand_and_one_copies(spark):
    text = " ".join(f"w{i}" for i in range(30))
    nd = _links(spark, [("a", f"i{i:04d}", text) for i in range(1_001)] + [("a", "z", text + " more")])
    assert nd.pairs().count() == 1_002 * 1_001 // 2
    assert {(r.group_id, r.n_links) for r in nd.groups().collect()} == {(nd.groups().first().group_id, 1)}


def test_numbers_of_classes_that_collide(spark, monkeypatch):
    original = neardup._rid
    monkeypatch.setattr(neardup, "_rid", lambda seed: F.pmod(original(seed), F.lit(3)) if seed == 0 else original(seed))
    rows = texts(2)[:60]
    got = {tuple(r) for r in _links(spark, rows).pairs().collect()}
    assert got <= brute(rows, 3, 0.6, 20) and len(got) >= 0.9 * len(brute(rows, 3, 0.6, 20))


def test_copies_and_groups(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [("a", f"i{i}", text) for i in range(5)] + [("a", "j", text + " more"), ("a", "k", " ".join(f"z{i}" for i in range(30)))]
    nd = NearDuplicates(spark.createDataFrame(rows, "collection string, id string, text string"), 3, 0.6, 20)
    assert nd.pairs().count() == 15
    groups = nd.groups().collect()
    assert len(groups) == 6 and len({r.group_id for r in groups}) == 1 and {r.n_links for r in groups} == {1}


def test_empty(spark):
    nd = NearDuplicates(spark.createDataFrame([], "collection string, id string, text string"), 3, 0.6, 20)
    assert nd.pairs().count() == 0 and nd.groups().count() == 0
