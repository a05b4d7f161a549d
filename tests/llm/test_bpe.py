import base64
import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def reference():
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.DEFAULT_PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["", " ", "  a  b ", "\n\n a\n b", "a" * 3000, "don't  <|endoftext|> x", " \t x　y ​", "0" * 500 + "é" * 300, "\x1c a \x1c b", "東京の記録 🙂👩🏽‍🔬", "x" * 70 + " y"]


@pytest.mark.parametrize("text", HARD)
def test_equals_public_library(reference, text):
    assert bpe.encoder().encode(text) == reference.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_round_trip(reference, text):
    ids = bpe.encoder().encode(text)
    assert ids == reference.encode_ordinary(text) and reference.decode(ids) == text


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=50), st.binary(max_size=8), st.integers(0, 50), st.integers(0, 6))
def test_edits_and_appends(data, new, start, length):
    inner = bpe.encoder().inner
    start = min(start, len(data))
    end = min(start + length, len(data))
    e = bpe.EditableEncoding(inner, data)
    e.replace(start, end, new)
    assert e.data == data[:start] + new + data[end:] and e.ids() == inner.encode(e.data)
    e.append(b" more")
    assert e.ids() == inner.encode(e.data) and e.ids(len(e.data) - 5) == inner.encode(e.data[:-5])


def test_operator(spark, reference):
    rows = [(i, t) for i, t in enumerate([*HARD, None, HARD[2]])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_texts(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in rows}
    assert bpe.encode_texts(df.limit(0)).count() == 0
