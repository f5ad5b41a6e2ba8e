"""Token ids of whole texts by a public byte-level BPE tokenizer, as a monoid tree reduction.

A text longer than a leaf is halved down to leaves, each leaf is encoded by itself, and neighbours are joined up the tree. The
splitting pattern of byte-level BPE is a left-to-right scan that keeps no memory but its position and looks at most two
characters past a piece, and merges never cross pieces. So two facts hold for a join at m:

* a piece boundary s of the left part with s <= m - LOOK is a boundary of the joined text, and nothing left of it changes;
* if a scan of the joined text and the scan of the right part both have a boundary p, they agree from p on.

The join therefore encodes a window from s to some way past m and doubles the window until a boundary p of it, at least LOOK before the
window's end, is a boundary of the right part too (or the window reaches the end). Pieces left of s and right of p are
kept as they are. Decoding concatenates the bytes of the ids up a tree of pairs.

There is one encoder, whatever the length: a leaf or window is cut into pieces, and a piece has the ids the `tokenizers` library gives it, which
are remembered, since texts repeat their words.

Defined results: null and empty texts have the empty list; strings that look like special tokens are ordinary text; no
special tokens are added. Invalid UTF-8 can't occur in a Spark string. Repeated rows are encoded each, extra columns ignored.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
LEAF_CHARS = 512
WINDOW_CHARS = 32
LOOK = 4
# fixed value: how byte-level BPE of this family splits text before merging
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
ROWS_AT_ONCE = 512
#: Pieces of at most so many characters are remembered, and at most so many of them.
PIECE_CHARS, PIECES_KEPT = 64, 500_000

_loaded: dict[str, TreeEncoder] = {}


class Part:
    """Encoding of text[low:high] scanned from low: the starts of its pieces and the ids of each."""

    __slots__ = ("low", "high", "starts", "ids")

    def __init__(self, low: int, high: int, starts: list[int], ids: list[list[int]]):
        self.low, self.high, self.starts, self.ids = low, high, starts, ids


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in vocabularies of this family: printable ones for themselves, the others from 256 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class TreeEncoder:
    """Encodes texts by the definition of a byte-level tokenizer of the `tokenizers` library."""

    def __init__(self, definition: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.leaf, self.window = max(leaf, 1), max(window, 1)
        self.kept: dict[str, list[int]] = {}
        self.known, self.odd = set(map(chr, range(128))), set()
        self.table: dict[int, bytes] | None = None
        self.joins = 0

    def _learn(self, new: set[str]) -> None:
        """Sort characters not met before: odd are those the tokenizer's own tables and the pattern's put into different classes."""
        for c in new:
            probe = f"a{c}1{c}!{c} "
            same = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] == [m.span() for m in PIECES.finditer(probe)]
            (self.known if same else self.odd).add(c)

    def pieces(self, text: str) -> list[str]:
        """text cut before merging, as the tokenizer does it: by the pattern, or by the tokenizer itself if a character is odd."""
        if not text.isascii():
            chars = set(text)
            if new := chars - self.known - self.odd:
                self._learn(new)
            if not chars.isdisjoint(self.odd):
                return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return PIECES.findall(text)

    def _ids(self, piece: str) -> list[int]:
        found = self.kept.get(piece)
        if found is None:
            found = self.tokenizer.encode(piece, add_special_tokens=False).ids
            if len(piece) <= PIECE_CHARS:
                if len(self.kept) >= PIECES_KEPT:
                    self.kept.clear()
                self.kept[piece] = found
        return found

    def part(self, text: str, low: int, high: int) -> Part:
        """A stretch encoded by itself."""
        pieces = self.pieces(text[low:high])
        kept = self.kept
        ids = [kept[p] if p in kept else self._ids(p) for p in pieces]
        return Part(low, high, list(accumulate(map(len, pieces[:-1]), initial=low)) if pieces else [], ids)

    def join(self, text: str, left: Part, right: Part) -> Part:
        """The encoding of two neighbouring parts."""
        self.joins += 1
        middle = left.high
        k = max(bisect.bisect_right(left.starts, middle - LOOK) - 1, 0)
        start = left.starts[k]
        width = self.window
        while True:
            end = min(right.high, middle + width)
            seen = self.part(text, start, end)
            if end == right.high:
                return Part(left.low, right.high, left.starts[:k] + seen.starts, left.ids[:k] + seen.ids)
            for j in range(bisect.bisect_left(seen.starts, middle), len(seen.starts)):
                p = seen.starts[j]
                if p > end - LOOK:
                    break
                r = bisect.bisect_left(right.starts, p)
                if r < len(right.starts) and right.starts[r] == p:
                    return Part(left.low, right.high, left.starts[:k] + seen.starts[:j] + right.starts[r:], left.ids[:k] + seen.ids[:j] + right.ids[r:])
            width *= 2

    def _tree(self, text: str, low: int, high: int) -> Part:
        if high - low <= self.leaf:
            return self.part(text, low, high)
        middle = (low + high) // 2
        return self.join(text, self._tree(text, low, middle), self._tree(text, middle, high))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        return list(chain.from_iterable(self._tree(text, 0, len(text)).ids)) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their bytes, joined pair by pair up a tree."""
        if self.table is None:
            letters = byte_letters()
            self.table = {i: bytes(letters[c] for c in token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        parts = [self.table[i] for i in ids]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0].decode() if parts else ""


def _encoder(key: str, definition: str) -> TreeEncoder:
    """One encoder a Python worker."""
    if key not in _loaded:
        _loaded[key] = TreeEncoder(definition)
    return _loaded[key]


def encode_texts(df: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """key and ids (array<int>) of every row. The vocabulary (files of fixed size, under 3 MB) is read on the driver and broadcast."""
    with open(f"{folder}/{tokenizer}.json", encoding="utf-8") as f:
        definition = f.read()
    shared = df.sparkSession.sparkContext.broadcast(definition)
    name = f"{folder}/{tokenizer}"
    kind = next(f.dataType.simpleString() for f in df.schema.fields if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, count=int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["_key", "ids"])

    return spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))).mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)
