import random

import pytest

from tessera.llm import names as n

FORMS = n.Forms(frozenset("foods energy logistics engineering board pilot fort saint cooperative shipping".split()), frozenset("andrew andre christopher rebecca".split()), {"location": frozenset("fort saint lake".split())})


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Andrew Baivwujast", "Baivwujast, Andrew", True),
        ("Andrew Baivwujast", "Dr. Andrew K. Baivwujsat", True),
        ("Christopher Foundshamzou", "Chris Foundshamzou", True),
        ("Christopher Foundshamzou", "christopher.foundshamzou", True),
        ("Andrew Smithers", "André Smithers", False),
        ("Rebecca Fevak", "Becky Fevak", True),
        ("Bairfiel Foods GmbH", "The Bairfiel Foods", True),
        ("Bairfiel Foods GmbH", "Bairfiel Energy GmbH", False),
        ("Groasvost Logistics Limited", "Groasvost Log., Ltd", True),
        ("Kadroru Cooperative Limited", "Kadroru Co-op, Ltd", True),
        ("Boathoajouv Board 2", "BoathoajouvBoard 2.0", True),
        ("Boathoajouv Board 2", "Board v2 by Boathoajouv", True),
        ("Boathoajouv Board 2", "Boathoajouv Board 3", False),
        ("Fort Ruxshist", "Ft. Ruxshist", True),
        ("Fort Ruxshist", "Ruxshist, Fort", True),
    ],
)
def test_forms(a, b, same):
    assert FORMS.same(FORMS.parse(a, None)[0], FORMS.parse(b, None)[0]) is same


def test_an_initial_stands_for_the_only_common_word_of_its_kind():
    form = lambda x, k: FORMS.parse(x, k)[0]
    assert form("L. Voapi", "location") == form("Voapi, Lake", "location") != form("L. Voapi", "organization")
    assert n.Forms(frozenset(), frozenset(), {"location": frozenset(("lake", "lodge"))}).initial == {}


def test_one_typing_error_leaves_a_block_in_common():
    rng = random.Random(5)
    letters = "aeioubcdfglmnprstvz"
    for _ in range(4_000):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(4, 12)))
        i, x = rng.randrange(len(w) - 1), rng.choice(letters)
        v = rng.choice([w[:i] + x + w[i:], w[:i] + w[i + 1 :], w[:i] + x + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
        assert set(n.codes(w)) & set(n.codes(v)) or not any(n.phonetic(x) for x in (w, v))


def test_crowded_blocks_are_cut_up(spark, monkeypatch):
    """Many forms of one sound: the variants are linked, and few pairs are compared."""
    rng = random.Random(1)
    surnames = sorted({"".join((rng.choice("bpfv"), rng.choice("aeiou"), rng.choice("dt"), rng.choice("aeiou"), rng.choice("mn"), rng.choice("aeiou"), rng.choice("lr"), *rng.choices("aeiou", k=2))) for _ in range(3_000)})[:1_500]
    rows = [(f"e{i:04d}", "n", f"Robert {s.title()}", None, "person", None) for i, s in enumerate(surnames)] + [(f"z{i}", "n", f"Bob {s.title()}", None, "person", None) for i, s in enumerate(surnames[:50])]
    compared = []
    original = n._meeting
    monkeypatch.setattr(n, "_meeting", lambda parsed: (compared.append((m := original(parsed)).count()), m)[1])
    df = spark.createDataFrame(rows, SCHEMA)
    thing = {r.id: r.thing for r in n.link_names(df).collect()}
    assert all(thing[f"e{i:04d}"] == thing[f"z{i}"] for i in range(50))
    assert compared[0] < len(surnames) * n.CROWD / 2


def test_sure_words_always_meet():
    """Words of a similarity of SURE, whatever their number of typing errors, and long words with two errors share a key."""
    rng = random.Random(6)
    letters, seen = "aeioubcdfglmnprstvz", 0
    for _ in range(20_000):
        w = v = "".join(rng.choice(letters) for _ in range(rng.randint(3, 16)))
        for _ in range(rng.randint(1, 4)):
            i, x = rng.randrange(len(v)), rng.choice(letters)
            v = rng.choice([v[:i] + x + v[i:], v[:i] + v[i + 1 :] or v, v[:i] + x + v[i + 1 :], v[:i] + v[i + 1 : i + 2] + v[i] + v[i + 2 :], v + x])
        if n.close(w, v) and w != v:
            seen += 1
            assert set(n.sure_codes(w)) & set(n.sure_codes(v)) if n.jaro_winkler(w, v) >= n.SURE else set(n.codes(w)) & set(n.codes(v))
    assert seen > 5_000


@pytest.mark.parametrize("most", [n.CROWD, 1])
def test_no_pair_that_is_alike_is_left_out(spark, monkeypatch, most):
    """Short words, swaps, endings, two errors, a wrong first letter beside another error, words alike in another order: as comparing all forms."""
    monkeypatch.setattr(n, "CROWD", most)
    texts = """Rebecca Lin; Rebecca Ling; Rebecca Bavurido; Rebecca Bavuirod; Rebecca Robert; Rebecca Robertson; Rebecca Lailoutieth;
        Rebecca Lairoutiemh; Zelmira Fairnbin; Xelmira Fairnbim; R. Robertsen; Abc Foods; Abcd Foods; Bavurido Foods; Bavuirod Foods;
        Bavuridol Bavurido Foods; Bavurido Bavuridola Foods; Xyabcdefgh Foods; Abcdefgh Foods; Kol Nuv Foods; Kol Nuvs Foods""".split(";")
    df = spark.createDataFrame([("n", t.strip(), None) for t in texts], "namespace string, text string, kind string")
    forms = spark.sparkContext.broadcast(FORMS)
    parsed = df.mapInArrow(n._parse(forms), "namespace string, text string, kind string, form string, keys array<string>, words array<string>, groups array<string>, members array<string>, initials string")
    got = {(r.a, r.b) for r in n._meeting(parsed).mapInArrow(n._compare(forms), "namespace string, a string, b string").collect()}
    every = sorted(FORMS.parse(t, None)[0] for t in texts)
    assert got == {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if FORMS.same(a, b)} and len(got) >= 10
    same = lambda a, b: FORMS.same(*(FORMS.parse(x, None)[0] for x in (a, b)))
    assert same("Rebecca Lin", "Rebecca Ling") and same("Abc Foods", "Abcd Foods") and not same("Rebecca Lin", "Rebecca Lim")


def test_pairs_of_a_sure_similarity_are_linked(spark):
    names = ["Robert Bavurido", "Robert Bavuirod", "Robert Lailoutieth", "Robert Lairoutiemh", "Robert Lin", "Robert Ling"]
    df = spark.createDataFrame([(f"e{i}", "n", x, None, "person", None) for i, x in enumerate(names)], SCHEMA)
    assert {(r.id_a, r.id_b) for r in n.pairs(n.link_names(df)).collect()} == {("e0", "e1"), ("e2", "e3"), ("e4", "e5")}


def test_distances():
    assert n.edits("abcd", "abdc", 2) == 1 and n.edits("abcd", "xy", 1) == 2
    assert n.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and n.jaro_winkler("", "a") == 0


ROWS = [
    ("e1", "n", "Anthony Lailoutieth", None, "person", None),
    ("e2", "n", "Susan Lailoutieth", [], "person", None),
    ("x1", "n", "A. Lailoutieth", None, "person", None),
    ("x2", "n", "Tony Lailouttieth", None, None, None),
    ("x3", "n", " anthony  lailoutieth", ["A. Lailoutieth"], "concept", None),
    ("e3", "n", "Stournzefo and Zaiwethrn Logistics Company", None, "organization", None),
    ("x4", "n", "S.Z.L.", None, "organization", None),
    ("x5", "m", "Anthony Lailoutieth", None, "person", None),
    ("x6", "n", None, None, None, None),
    ("x7", "n", "  ", None, "person", None),
    ("x2", "n", "Tony Lailouttieth", None, None, None),
    ("e8", "n", "Robert Fairnbin", None, "person", "Rome"),
    ("e9", "n", "Richard Fairnbin", None, "person", "Oslo"),
    ("x8", "n", "R. Fairnbin", None, "person", "Oslo"),
    ("x9", "n", "R. Fairnbin", None, "person", None),
]
SCHEMA = "id string, namespace string, name string, aliases array<string>, type string, city string"


def test_links(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.id_a, r.id_b) for r in n.pairs(n.link_names(df)).collect()}
    things = [{"e1", "x1", "x2", "x3"}, {"e3", "x4"}, {"e9", "x8"}]
    assert got == {(a, b) for t in things for a in t for b in t if a < b}
    linked = n.link_names(df).collect()
    assert sorted(r.id for r in linked) == sorted({r[0] for r in ROWS})
    assert n.pairs(n.link_names(df.limit(0))).count() == 0
