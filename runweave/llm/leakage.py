"""Evaluation texts that leak into training text, found by a generalised suffix automaton.

Items and documents are reduced to one normal stream: escapes and entities resolved, markup dropped, Unicode compatibility forms
folded, case folded, and letters and digits kept, with the word boundaries beside them. The automaton of all items' streams is
walked once over each document's stream; at each character it knows the longest suffix that some item contains, and its states know where in
which items. Where a document's word ends, that length decides: an item's passage has leaked if the match goes back to a word's
beginning in both texts, ends with a word in both, and holds ``words`` words of the item or more. So spacing and punctuation inside a passage
don't matter, and a passage must begin and end with whole words. What looks like markup may be text: a document with markup is read
a second time with it kept.

The automaton holds at most ``chunk_chars`` characters of items: more items are split into several automata, which pass a document on with the spans
they found; limits and cuts are judged on all spans together, so results don't depend on the split. Documents are never shuffled. Items are a held-out
set that every task gets, so their size is checked: more than MOST_ITEM_CHARS characters are refused before any is fetched.

Defined results: null, empty and blank documents and items match nothing, items of fewer than ``words`` words neither. An
opening sentence that ``shared_share`` of the items (SHARED_LEAST different ones at least) have in common is an instruction, not part of them.
Repeated items are reported under each of their ids, repeated documents each. Keys may be of any type. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from runweave.session import spread

WORDS = 10
CHUNK_CHARS, MOST_ITEM_CHARS = 2_000_000, 20_000_000
SHARED_SHARE, SHARED_LEAST = 0.1, 3
LINK, LENGTH, ENDS, KIDS = "link", "length", "ends", "kids"  # keys of a state that are no single characters

_ESCAPE = re.compile(r"\\{1,8}(?:u\{?([0-9a-fA-F]{4,6})\}?|x([0-9a-fA-F]{2})|([nrtbfv]))")
_PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
_TAG = re.compile(r"<[/!?]?[a-zA-Z][^<>]*>")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_ROW = re.compile(r"\|[ \t]{0,40}(?:\r?\n[ \t]{0,40}\|)?[ \t]{0,40}\d{1,6}[ \t]{0,40}\|")
_WORD = re.compile(r"[^\W_]+")


def _unescape(m) -> str:
    digits = m.group(1) or m.group(2)
    if not digits:
        return " "
    code = int(digits, 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else " "


def _unpercent(m) -> str:
    return bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace")


def _resolved(text: str) -> str:
    """Text without escapes and entities."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    for _ in range(3):
        if "&" not in text or (now := html.unescape(text)) == text:
            break
        text = now
    return _PERCENT.sub(_unpercent, text) if "%" in text else text


def _comments_end(text: str) -> int:
    """Where the last comment may end: looking for ends only up to there keeps the search linear."""
    return text.rfind("-->") + 3 if "<!--" in text and "-->" in text else 0


def _unmarked(text: str) -> str:
    """Text without tags, comments, link targets and numbers of table rows."""
    if "<" in text:
        if end := _comments_end(text):
            text = _COMMENT.sub(" ", text[:end]) + text[end:]
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    return _ROW.sub(" ", text) if "|" in text else text


def _folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def plain(text: str) -> str:
    """Text without escapes, entities and markup, in compatibility form and folded case."""
    return _folded(_unmarked(_resolved(text)))


def words_of(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def readings(text: str) -> list[Stream]:
    """The normal streams of a text: without markup and, where it has some, with it."""
    resolved = _resolved(text)
    bare = _unmarked(resolved)
    return [Stream(_WORD.findall(_folded(t))) for t in ([bare] if bare == resolved else [bare, resolved])]


class Stream:
    """The letters and digits of a text, and where words begin and end in them."""

    __slots__ = ("chars", "words", "_starts", "_ends")

    def __init__(self, words: list[str]):
        self.chars, self.words, self._starts, self._ends = "".join(words), words, None, None

    @property
    def starts(self) -> list[int]:
        if self._starts is None:
            self._starts = [0, *accumulate(map(len, self.words))][: len(self.words)]
        return self._starts

    @property
    def ends(self) -> set[int]:
        if self._ends is None:
            self._ends = set(accumulate(map(len, self.words)))
        return self._ends


class SuffixAutomaton:
    """Generalised suffix automaton of several strings, as lists of transitions, suffix links and lengths."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: dict[int, list[tuple[int, int]]] = {}
        self.root: dict | None = None

    def _state(self, length: int, moves: dict[str, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def add(self, text: str, name: int = 0) -> None:
        """Insert a string from the initial state; the state of each of its beginnings notes the string's name and the place."""
        self.root, last = None, 0
        for i, c in enumerate(text, 1):
            last = self._extend(last, c)
            self.ends.setdefault(last, []).append((name, i))

    def _extend(self, last: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: str) -> int:
        nxt, link = self.next, self.link
        clone = self._state(self.length[p] + 1, dict(nxt[q]), link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def linked(self) -> dict:
        """The initial state, with states as dictionaries of each other: a step is one look-up. LINK, LENGTH, ENDS and KIDS (states whose suffix link this is) are keys beside the characters."""
        states: list[dict] = [{} for _ in self.link]
        for i, (state, moves, link, length) in enumerate(zip(states, self.next, self.link, self.length)):
            state.update((c, states[to]) for c, to in moves.items())
            state[LINK], state[LENGTH] = states[max(link, 0)], length
            if i in self.ends:
                state[ENDS] = self.ends[i]
            if link >= 0:
                states[link].setdefault(KIDS, []).append(state)
        return states[0]

    def matches(self, text: str, least: int) -> list[tuple[int, dict, int]]:
        """(end, state, length) of the longest match of ``least`` characters or more that ends at each place of text."""
        if self.root is None:
            self.root = self.linked()
        root = state = self.root
        found = []
        matched = 0
        for i, c in enumerate(text, 1):
            to = state.get(c)
            if to is None:
                while to is None and state is not root:
                    state = state[LINK]
                    to = state.get(c)
                matched = state[LENGTH]
                if to is None:
                    continue
            state = to
            matched += 1
            if matched >= least:
                found.append((i, state, matched))
        return found

    def regions(self, text: str, least: int) -> list[tuple[int, int]]:
        """Stretches [start, end) of text made of matches of ``least`` characters or more."""
        return _merged([(end - n, end) for end, _, n in self.matches(text, least)])

    @staticmethod
    def places(state: dict, but: dict | None) -> Iterator[tuple[int, int]]:
        """(name, end) wherever the strings of a state end, except where those of ``but``, a state whose suffix link it is, do."""
        work = [state]
        while work:
            s = work.pop()
            yield from s.get(ENDS, ())
            work += [k for k in s.get(KIDS, ()) if k is not but]


class Detector:
    """The automaton of a set of items, and where words begin and end in them."""

    def __init__(self, items: list[tuple[object, list[str]]], words: int = WORDS):
        self.automaton, self.words = SuffixAutomaton(), words
        self.ids: list[list] = []
        self.begins: list[dict[int, int]] = []
        self.finishes: list[dict[int, int]] = []
        known: dict[tuple[str, ...], int] = {}
        self.least = 0
        for item, own in items:
            if len(own) < words:
                continue
            if tuple(own) not in known:
                known[tuple(own)] = len(self.ids)
                ends = list(accumulate(map(len, own)))
                self.ids.append([])
                self.begins.append({e - len(w): k for k, (e, w) in enumerate(zip(ends, own))})
                self.finishes.append({e: k + 1 for k, e in enumerate(ends)})
                shortest = min(ends[k + words - 1] - (ends[k] - len(own[k])) for k in range(len(own) - words + 1))
                self.least = min(self.least or shortest, shortest)
                self.automaton.add("".join(own), known[tuple(own)])
            self.ids[known[tuple(own)]].append(item)

    def hits(self, stream: Stream) -> list[tuple[int, int, set]]:
        """(start, end, items) in the stream's characters: for each place where a passage ends, the longest one of each item."""
        if not self.least or len(stream.chars) < self.least:
            return []
        found = self.automaton.matches(stream.chars, self.least)
        if not found:
            return []
        spans: dict[tuple[int, int], set] = {}
        ends = stream.ends
        for end, state, length in found:
            if end not in ends:
                continue
            below = None
            while length >= self.least:
                for item, place in self.automaton.places(state, below):
                    start = self._start(stream, item, place, end, length)
                    if start is not None:
                        spans.setdefault((start, end), set()).update(self.ids[item])
                below, state = state, state[LINK]
                length = state[LENGTH]
        return [(a, b, items) for (a, b), items in sorted(spans.items())]

    def _start(self, stream: Stream, item: int, place: int, end: int, length: int) -> int | None:
        """Where the longest passage begins that ends at ``end`` in the stream and at ``place`` in the item, both agreeing over ``length`` characters."""
        last = self.finishes[item].get(place)
        if last is None:
            return None
        starts, begins = stream.starts, self.begins[item]
        for k in range(bisect.bisect_left(starts, end - length), len(starts)):
            if end - starts[k] < self.least:
                return None
            first = begins.get(place - (end - starts[k]))
            if first is not None:
                return starts[k] if last - first >= self.words else None
        return None


def shared_opening(texts: list[str], share: float = SHARED_SHARE) -> set[tuple[str, ...]]:
    """Opening sentences, as words, that a share of the texts begins with (SHARED_LEAST different texts at least; repeats count once)."""
    texts = list({tuple(words_of(t)): t for t in texts}.values())
    opening = Counter(tuple(words_of(t[: _sentence_end(t)])) for t in texts)
    need = max(SHARED_LEAST, share * len(texts))
    return {o for o, n in opening.items() if o and n >= need and any(len(words_of(t)) > len(o) for t in texts)}


def _sentence_end(text: str) -> int:
    m = regex.search(r"[.!?:](?=\s|$)|\n", text)
    return m.end() if m else len(text)


def item_words(rows: list[tuple[object, str | None]]) -> list[tuple[object, list[str]]]:
    """Words of each item without a shared instruction."""
    texts = [t for _, t in rows if t and t.strip()]
    openings = shared_opening(texts)
    out = []
    for item, text in rows:
        own = words_of(text) if text else []
        for o in openings:
            if tuple(own[: len(o)]) == o:
                own = own[len(o) :]
                break
        out.append((item, own))
    return out


def chunks(items: list[tuple[object, list[str]]], most: int) -> list[list[tuple[object, list[str]]]]:
    """Items cut into lists of at most ``most`` characters (a longer item stands alone)."""
    out: list[list[tuple[object, list[str]]]] = []
    size = most + 1
    for item in items:
        n = sum(map(len, item[1]))
        if size + n > most:
            out.append([])
            size = 0
        out[-1].append(item)
        size += n
    return out


_detectors: dict[str, Detector] = {}
KEPT_DETECTORS = 64


def _detector(key: str, items: list[tuple[object, list[str]]], words: int) -> Detector:
    """One detector a Python worker and chunk; older ones go when there are many."""
    if key not in _detectors:
        if len(_detectors) >= KEPT_DETECTORS:
            _detectors.clear()
        _detectors[key] = Detector(items, words)
    return _detectors[key]


#: Spans of a document so far: the reading they are of (MAPPED for the one that keeps places in the text), start, end, and the item's number.
MAPPED = -1
_SPAN = pa.list_(pa.struct([("reading", pa.int8()), ("start", pa.int32()), ("end", pa.int32()), ("item", pa.int32())]))
_SPANS = "array<struct<reading: tinyint, start: int, end: int, item: int>>"


def _spans(detector: Detector, text: str, mapped: bool) -> list[dict]:
    out = []
    streams = list(enumerate(readings(text)))
    for reading, stream in streams:
        out += [{"reading": reading, "start": a, "end": b, "item": x} for a, b, items in detector.hits(stream) for x in sorted(items)]
    if mapped and out:
        out += [{"reading": MAPPED, "start": a, "end": b, "item": x} for a, b, items in detector.hits(mapped_stream(text)[0]) for x in sorted(items)]
    return out


def _held(items: DataFrame, item: str, item_text: str) -> list[tuple[object, str | None]]:
    """The items, once their size is known to be bounded."""
    rows = items.where(F.col(item).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if chars > MOST_ITEM_CHARS:
        raise ValueError(f"{chars} characters of items, of at most {MOST_ITEM_CHARS}: give them in parts")
    return [(r[0], r[1]) for r in rows.orderBy("i", "t").toLocalIterator()]


def _over(documents: DataFrame, parts: list, words: int, mapped: bool, conclude, schema: str, names: list[str]) -> DataFrame:
    """documents(_key, _text) through the automata of all parts, then ``conclude`` over a batch's keys, texts and spans; one scan."""
    spark = documents.sparkSession
    kind = documents.schema["_key"].dataType.simpleString()
    source = spread(documents)
    for part in parts[:-1]:
        if "_spans" not in source.columns:
            source = source.withColumn("_spans", F.array().cast(_SPANS))
        source = source.mapInArrow(_pass(spark.sparkContext.broadcast(part), uuid.uuid4().hex, words, mapped, None), f"_key {kind}, _text string, _spans {_SPANS}")
    last = spark.sparkContext.broadcast(parts[-1] if parts else [])
    return source.mapInArrow(_pass(last, uuid.uuid4().hex, words, mapped, conclude), schema).toDF(*names)


def _pass(shared, name: str, words: int, mapped: bool, conclude):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = _detector(name, shared.value, words)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [s or [] for s in batch.column(2).to_pylist()] if batch.num_columns > 2 else [[] for _ in texts]
            for own, text in zip(spans, texts):
                if text:
                    own += _spans(detector, text, mapped)
            if conclude is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPAN)], ["_key", "_text", "_spans"])
            else:
                yield conclude(batch.column(0), texts, spans)

    return run


def _covered(text: str, spans: list[dict]) -> tuple[int, float]:
    """(words, share of all words) of the passages, in the reading where they cover most."""
    best = (0, 0.0)
    for reading, stream in enumerate(readings(text)):
        own = [(s["start"], s["end"]) for s in spans if s["reading"] == reading]
        if own:
            n = _words_in(stream, own)
            best = max(best, (n, n / len(stream.words)))
    return best


def leaked_items(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                 words: int = WORDS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """key, item: a row for every document and item whose passage of ``words`` words it holds; words_covered and share: the document's words in passages of any item."""
    rows = _held(items, item, item_text)
    parts = chunks([(i, own) for i, (_, own) in enumerate(item_words(rows))], chunk_chars)
    kind, item_kind = documents.schema[key].dataType, items.schema[item].dataType
    arrow_kind, ids = to_arrow_type(item_kind), [i for i, _ in rows]

    def conclude(keys: pa.Array, texts: list[str | None], spans: list[list[dict]]) -> pa.RecordBatch:
        at, found, covered, share = [], [], [], []
        for i, (text, own) in enumerate(zip(texts, spans)):
            if own:
                n, part = _covered(text, own)
                for x in sorted({s["item"] for s in own}):
                    at.append(i)
                    found.append(ids[x])
                    covered.append(n)
                    share.append(part)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(found, arrow_kind), pa.array(covered, pa.int32()), pa.array(share, pa.float64())], ["_key", "_item", "words_covered", "share"])

    source = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = T.StructType([T.StructField("_key", kind), T.StructField("_item", item_kind), T.StructField("words_covered", T.IntegerType()), T.StructField("share", T.DoubleType())])
    return _over(source, parts, words, False, conclude, schema, [key, item, "words_covered", "share"])


def _words_in(stream: Stream, spans: list[tuple[int, int]]) -> int:
    """Words of the document that begin inside one of the spans."""
    spans = sorted(spans)
    n = k = 0
    reach = -1
    for a in stream.starts:
        while k < len(spans) and spans[k][0] <= a:
            reach = max(reach, spans[k][1])
            k += 1
        n += a < reach
    return n


_UNITS = r"\\{1,8}(?:u\{?[0-9a-fA-F]{4,6}\}?|x[0-9a-fA-F]{2}|[nrtbfv])|&(?:amp;)*#?\w{1,31};|(?:%[0-9a-fA-F]{2})+|<[/!?]?[a-zA-Z][^<>]*>|&lt;/?\w[^&<>]*&gt;"
_MORE = r"|\]\([^()\s]*\)|\|[ \t]{0,40}(?:\r?\n[ \t]{0,40}\|)?[ \t]{0,40}\d{1,6}[ \t]{0,40}\||."
_UNIT, _UNIT_OR_COMMENT = regex.compile(_UNITS + _MORE, regex.S), regex.compile("<!--.*?-->|" + _UNITS + _MORE, regex.S)


def mapped_stream(text: str) -> tuple[Stream, list[int], list[int]]:
    """The normal stream of a text, unit by unit, with where each of its characters begins and ends in the text."""
    words: list[list[str]] = []
    begins: list[int] = []
    ends: list[int] = []
    open_word = False
    end = _comments_end(text)
    for units in (_UNIT_OR_COMMENT.finditer(text, 0, end), _UNIT.finditer(text, end)):
        for m in units:
            unit = m.group()
            for c in plain(unit) if len(unit) > 1 or not unit.isascii() else unit.lower():
                if c.isalnum() and _WORD.match(c):
                    if open_word:
                        words[-1].append(c)
                    else:
                        words.append([c])
                        open_word = True
                    begins.append(m.start())
                    ends.append(m.end())
                else:
                    open_word = False
    return Stream(["".join(w) for w in words]), begins, ends


def _cleaned(text: str, spans: list[dict], most_share: float) -> tuple[str | None, int, bool]:
    """(text without the passages, words removed, whether the document is to be dropped)."""
    if not spans:
        return text, 0, False
    removed, share = _covered(text, spans)
    stream, begins, ends = mapped_stream(text)
    placed = [s for s in spans if s["reading"] == MAPPED]
    if {s["item"] for s in spans} - {s["item"] for s in placed} or share > most_share:
        return None, removed, True
    out, at = [], 0
    for a, b in _merged([(begins[s["start"]], ends[s["end"] - 1]) for s in placed]):
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]]), removed, False


def scrubbed(detector: Detector, text: str, most_share: float) -> tuple[str | None, int, bool]:
    """(text without leaked passages, words removed, whether the document is to be dropped).

    Dropped are documents with more than ``most_share`` of their words in leaked passages, and those in which a passage shows only
    after normalising the text as a whole, so that its place in the text isn't known.
    """
    return _cleaned(text, _spans(detector, text, True), most_share)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_leaks(documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS,
                  chunk_chars: int = CHUNK_CHARS, most_share: float = 0.5) -> DataFrame:
    """key, text without leaked passages (null if dropped or null before), words_removed, dropped; one row a document."""
    rows = _held(items, item, item_text)
    parts = chunks([(i, own) for i, (_, own) in enumerate(item_words(rows))], chunk_chars)

    def conclude(keys: pa.Array, texts: list[str | None], spans: list[list[dict]]) -> pa.RecordBatch:
        done = [_cleaned(t, own, most_share) for t, own in zip(texts, spans)]
        kept, counts, flags = zip(*done) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([keys, pa.array(kept, pa.string()), pa.array(counts, pa.int32()), pa.array(flags, pa.bool_())], ["_key", "_text", "words_removed", "dropped"])

    source = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = T.StructType([T.StructField("_key", documents.schema[key].dataType), T.StructField("_text", T.StringType()), T.StructField("words_removed", T.IntegerType()), T.StructField("dropped", T.BooleanType())])
    return _over(source, parts, words, True, conclude, schema, [key, text, "words_removed", "dropped"])
