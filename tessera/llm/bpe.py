"""Encoding texts by byte-pair vocabularies through prefix dynamic programming.

For a byte string, the encoding of each prefix ends in exactly one token, so one table (prefix
length -> its last token) holds the encodings of all prefixes. The table grows from left to right:
the last token of a prefix is the one token that ends there and may stand after the last token of
the prefix before it. Two tokens may stand side by side if merging their joined bytes from scratch
gives the same two tokens again. Each prefix looks back over the length of the longest token at most,
so long unbroken strings take linear time; appended bytes extend the table, and an edit rebuilds it
from the edited byte on and keeps what lies before.

The vocabulary's split pattern cuts a text into pieces that are encoded apart, and pieces repeat, so
a worker keeps the ids of the pieces it has met. A piece never spans a single space between two
other characters; hence texts are first cut at those, which costs no regular expression.

Defined results: null, empty texts have the empty list of ids; blank ones the ids of their white
space; strings of special tokens are ordinary text. Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
DEFAULT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a worker keeps of each table before it starts anew: a bound of memory, not of results.
KEEP = 400_000


class PrefixEncoder:
    """Encodes byte strings; one per worker and vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.fits: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition: merge the pair of lowest rank until none is left. For short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        at = left << 32 | right
        known = self.fits.get(at)
        if known is None:
            if len(self.fits) > 4 * KEEP:
                self.fits.clear()
            known = self.fits[at] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """last[i]: the last token of data[:i + 1]. Fills it from its present length on, in place."""
        ranks, longest = self.ranks, self.longest
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is not None and (start == 0 or self.may_follow(last[start - 1], token)) and (end - start < 2 or self._whole(token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def _whole(self, token: int) -> bool:
        """True if the token's bytes encode to the token itself; false for tokens that no merge reaches."""
        at = token << 32 | 0xFFFFFFFF
        known = self.fits.get(at)
        if known is None:
            known = self.fits[at] = self.merged(self.bytes_of[token]) == [token]
        return known

    def read_back(self, last: list[int], end: int | None = None) -> list[int]:
        """The ids of the prefix of `end` bytes, from the table alone."""
        out, at = [], len(last) if end is None else end
        while at > 0:
            out.append(token := last[at - 1])
            at -= len(self.bytes_of[token])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        if (token := self.ranks.get(data)) is not None and self._whole(token):
            return [token]
        return self.read_back(self.extend(data, []))


class EditableEncoding:
    """One byte string with its table, to append to and edit."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b"") -> None:
        self.encoder, self.data, self.last = encoder, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put `new` in place of data[start:end]. Behind it, the table is read off again as soon as it agrees
        with the old one over the length of the longest token, since every entry depends on no more than that."""
        old, tail = self.last, self.data[end:]
        self.data = self.data[:start] + new + tail
        shift = start + len(new) - end
        self.last = old[:start]
        agreed, at = 0, start + len(new)
        self.encoder.extend(self.data, self.last, at)
        while at < len(self.data):
            if agreed >= self.encoder.longest:
                self.last += old[at - shift :]
                break
            at += 1
            self.encoder.extend(self.data, self.last, at)
            agreed = agreed + 1 if self.last[at - 1] == old[at - 1 - shift] else 0

    def ids(self, end: int | None = None) -> list[int]:
        return self.encoder.read_back(self.last, end)


class TextEncoder:
    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        import regex

        self.inner = PrefixEncoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())})
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...] | None] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = tuple(self.inner.encode(piece.encode()))
            if len(piece) <= 64:
                if len(self.pieces) >= KEEP:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _any(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._piece, self.pattern.findall(text))))

    def _word(self, word: str, first: bool) -> tuple[int, ...] | None:
        """Ids of a stretch between single spaces with the space before it; None where the spaces aren't single."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        ids = tuple(self._any(word if first else " " + word))
        if not first and len(word) <= 64:
            if len(self.words) >= KEEP:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        head, *rest = text.split(" ")
        known = self.words
        out = []
        if (ids := self._word(head, True)) is None:
            return self._any(text)
        out.append(ids)
        for word in rest:
            ids = known.get(word)
            if ids is None and (ids := self._word(word, False)) is None:
                return self._any(text)
            out.append(ids)
        return list(chain.from_iterable(out))


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY, pattern: str = DEFAULT_PATTERN, vocabulary: bytes | None = None) -> TextEncoder:
    """The encoder of a vocabulary file, or of its bytes, which go by the path's name; a worker keeps it."""
    if (path, pattern) not in _ENCODERS:
        if vocabulary is None:
            with open(path, "rb") as f:
                vocabulary = f.read()
        _ENCODERS[path, pattern] = TextEncoder(vocabulary, pattern)
    return _ENCODERS[path, pattern]


def encode_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY,
    pattern: str = DEFAULT_PATTERN,
) -> DataFrame:
    """id_col and ids, the list of the text's token ids. One narrow stage: nothing is shuffled.

    The driver reads the vocabulary's file and sends it to the workers, which need not have it."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # the file's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern, shared.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                lists = [enc.encode(t) if t else [] for t in part[1].to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(lists), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([part[0], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded_sizes(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY, pattern: str = DEFAULT_PATTERN) -> DataFrame:
    """id_col, n_ids, n_bytes: how many ids a text has, and how many bytes they stand for."""
    with open(vocabulary, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.zeros(0, np.int64)
        for batch in batches:
            if not len(lengths):
                of = encoder(vocabulary, pattern, shared.value).inner.bytes_of
                lengths = np.zeros(max(of) + 1, np.int64)
                lengths[list(of)] = [len(b) for b in of.values()]
            offsets = batch[1].offsets.to_numpy()
            total = np.concatenate([[0], np.cumsum(lengths[batch[1].values.to_numpy()])])
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(np.diff(offsets).astype(np.int64)), pa.array(total[offsets[1:]] - total[offsets[:-1]])],
                names=[id_col, "n_ids", "n_bytes"],
            )

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, n_ids long, n_bytes long")
