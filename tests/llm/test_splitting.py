from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import splitting as s

words = lambda t: s._WORD.findall(t)
piece = st.sampled_from(["alpha", "beta.", "Gamma", "# Head\n", "\n\n", "- item", "\n", "<p>", "</p>", "ends.", "Next", "　", "e.g.", "x" * 300, "！？。"])


@settings(max_examples=200, deadline=None)
@given(st.lists(piece, max_size=120).map(" ".join), st.integers(1, 20), st.integers(-2, 25), st.sampled_from(["fixed", "sentence", "paragraph", None]))
def test_pieces_cover_stay_within_and_overlap(text, limit, overlap, strategy):
    pieces = s.split_text(text, limit, overlap, strategy)
    if len(words(text)) <= limit:
        assert pieces == []
        return
    assert len(pieces) > 1
    assert "".join(text[fresh:end] for _, fresh, end, *_ in pieces) == text
    _, want = s.settings(limit, overlap)
    before = None
    for start, fresh, end, n, n_overlap, _ in pieces:
        mine = words(text[start:end])
        assert len(mine) == n <= limit
        if before is not None:
            assert n_overlap == min(want, len(before)) and mine[:n_overlap] == (before[-n_overlap:] if n_overlap else [])
        before = mine


def test_natural_ends():
    text = "# One\n\nAa bb cc. Dd ee ff.\n\n# Two\n\nGg hh ii. Jj kk ll."
    kinds = [(text[f:e].strip(), k) for _, f, e, _, _, k in s.split_text(text, 9, 0, "paragraph")]
    assert kinds == [("# One\n\nAa bb cc. Dd ee ff.", "section"), ("# Two\n\nGg hh ii. Jj kk ll.", "end")]
    assert [k for *_, k in s.split_text(text, 9, 0, "fixed")] == ["word", "end"]


def shown(text, limit, overlap=0, strategy=None, unit="words"):
    return [(text[f:e].strip(), k) for _, f, e, _, _, k in s.split_text(text, limit, overlap, strategy, unit)]


def test_a_heading_stays_with_its_text():
    text = "Aa bb cc dd ee.\n\n## Two words\n\nGg hh ii. Jj kk ll.\n\n<h2>Three</h2><p>Mm nn oo pp.</p>"
    assert [p for p, _ in shown(text, 8)] == ["Aa bb cc dd ee.", "## Two words\n\nGg hh ii.", "Jj kk ll.", "<h2>Three</h2><p>Mm nn oo pp.</p>"]
    long = "# " + " ".join(f"w{i}" for i in range(9)) + "\n\nGg hh."
    assert shown(long, 10) == [(long.split("\n")[0], "line"), ("Gg hh.", "end")]


def test_the_rest_of_an_oversized_section_stays_in_it():
    text = "# One\n\n" + " ".join(f"A{i} b c." for i in range(5)) + "\n\n# Two\n\nDd ee.\n\n# Three\n\nFf gg."
    assert [p for p, _ in shown(text, 11)] == ["# One\n\nA0 b c. A1 b c. A2 b c.", "A3 b c. A4 b c.", "# Two\n\nDd ee.\n\n# Three\n\nFf gg."]


def test_characters_as_units():
    text = "漢" * 250
    pieces = s.split_text(text, 100, 10, None, "characters")
    assert [(p[2] - p[0], p[4], p[5]) for p in pieces] == [(100, 0, "character"), (100, 10, "character"), (70, 10, "end")]
    assert "".join(text[f:e] for _, f, e, *_ in pieces) == text and s.split_text(text, 100, 10, None) == []
    assert [p for p, _ in shown("one two three. Four five", 9, unit="characters")] == ["one two", "three.", "Four five"]


def test_settings():
    assert s.settings(None, None) == (512, 0) and s.settings(-1, 600) == (512, 128) and s.settings(64, -4) == (64, 0)


def test_operator(spark):
    docs = spark.createDataFrame([(1, "c", "a b c d e"), (2, "c", "a b c"), (3, None, "w " * 600), (4, "?", None), (5, "c", ""), (6, "n", "w " * 513)], "doc_id long, collection_id string, text string")
    cols = spark.createDataFrame([("c", ("fixed", 3, 1, None), 1), ("n", None, 2)], "id string, chunk_config struct<strategy:string,max_tokens:int,overlap:int,separator:string>, doc_id int")
    got = s.split_documents(docs, cols)
    by = {}
    for r in got.orderBy("doc_id", "piece").collect():
        by.setdefault(r.doc_id, []).append(r.content)
    assert by[1] == ["a b c ", "c d e"] and set(by) == {1, 3, 6} and len(by[3]) == 2
    assert s.split_documents(docs.limit(0), cols, with_content=False).count() == 0
    assert s.split_documents(docs, cols.limit(0), with_content=False).where("piece = 0").count() == 2
