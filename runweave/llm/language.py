"""Languages of documents and of their segments, by character language models.

For each language an interpolated Kneser-Ney model over characters is fitted to labelled sentences. The models share one table an
order: sorted hashes of the n-grams and, beside them, each language's discounted probability and the back-off weight it
passes on as a context. A batch of segments is scored in numpy: a binary search for every character and order, then one
recursion over the orders for all languages at once. A segment gets the language of the lowest cross-entropy a character; it is
rejected (no language) if that entropy is above the bound calibrated on held-out sentences of that language, or if the lowest belongs to
the model of what is no language: that one is fitted to what code fences leave when it is cut like text, so it knows the
code, logs and data of the corpus at hand and no pattern names them.

Text is cut at the marks that end sentences and at line ends; tokens with the marks of code, paths and identifiers are left out. A
document is written in each language that has a sentence of enough letters; a further language that shows in one sentence only must be as sure
as SURE_ALONE and no less likely than 98 of 100 held-out sentences of it.

Defined results: null, empty and blank texts and texts of code only have no segments and one row without a language. Labels are read case-blind, with
or without a region, as code or name; a label that names none of the languages known by name or by the samples counts as none. Extra columns are
ignored; repeated documents are judged each.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.session import spread

ORDER = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
ALPHABET = 20_000
DEFAULT_DISCOUNT = 0.75
#: Letters a sentence must have to prove a language, where letters stand for sounds and where they stand for words.
LEAST_LETTERS, LEAST_SIGNS = 18, 6
#: Characters scored in one set of arrays.
PIECE_CHARS = 50_000
#: Confidence from which a single segment shows one of several languages.
SURE_ALONE = 0.999
#: Nats a character by which a sentence may lie above 98 of 100 held-out ones.
SLACK = 1.2
STRETCH = 24
#: Bounds of what the models are fitted to: sentences and documents a language, characters a document.
SENTENCES_PER_LANGUAGE, SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 2000, 200, 4000
#: The class of what is no language, and how many different texts it takes to fit one.
NONE, LEAST_NONE = "", 10
#: Confidence from which a segment counts; a text without a long and sure segment takes the language of its longest one of this many letters.
SURE, SHORTEST = 0.8, 6
ROWS_AT_ONCE, CHARS_AT_ONCE, SEEN_AT_MOST = 500, 120_000, 150_000

# fixed values: names and codes of the languages, lower case, without region
LABELS = {
    "en": "en eng english englisch anglais inglés ingles inglês inglese engels английский 英語 英语",
    "de": "de deu ger german deutsch allemand alemán aleman alemão tedesco duits немецкий ドイツ語 德语",
    "fr": "fr fra fre french französisch franzoesisch français francais francés frances francês francese frans французский フランス語 法语",
    "es": "es spa spanish spanisch espagnol español espanol castellano castilian espanhol spagnolo spaans испанский スペイン語 西班牙语",
    "pt": "pt por portuguese portugiesisch portugais portugués portugues português portoghese portugees португальский ポルトガル語 葡萄牙语",
    "it": "it ita italian italienisch italien italiano italiaans итальянский イタリア語 意大利语",
    "nl": "nl nld dut dutch niederländisch niederlaendisch néerlandais neerlandais neerlandés holandés holandês olandese nederlands flemish vlaams нидерландский オランダ語 荷兰语",
    "ru": "ru rus russian russisch russe ruso russo русский ロシア語 俄语",
    "ja": "ja jpn jp japanese japanisch japonais japonés japones japonês giapponese japans японский 日本語 日语",
    "zh": "zh zho chi cn chinese mandarin chinesisch chinois chino chinês cinese chinees cmn китайский 中国語 中文 汉语 漢語 普通话",
}
LANGUAGES = tuple(LABELS)
_LABEL_OF = {name: code for code, names in LABELS.items() for name in names.split()}

_FENCE = re.compile(r"(```|~~~).*?\1", re.S)
_TICKS = re.compile(r"`[^`\n]*`")
_TAGS = re.compile(r"<[/!?]?[a-zA-Z][^<>]{0,2000}>")
_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
# repeats before a required mark are bounded, so that long runs of one character cost no more than their length
_URL = re.compile(r"\w{1,20}://\S+")
_MAIL = re.compile(r"[\w.+-]{1,64}@[\w-]{1,64}\.\w[\w.]{0,64}")
_JSON_KEY = re.compile(r'"[A-Za-z_][\w.-]*"\s*:\s*')
_PREFIX = re.compile(r"^[ \t>*/#|+-]+")
_PATHLIKE = re.compile(r"[\w.\-]{1,100}(?:[/\\][\w.\-]+)+(?<!\.)")
_CODED = re.compile(r"[/\\_=(){}\[\]<>$@#|~^*+]|\w\.\w|\d[^\W\d_]|[^\W\d_]\d|[a-z][A-Z]|::|->")
_SENTENCE = re.compile(r"[.!?;…][\"'»”)]*\s+|[。！？]|\n+")
_LETTER = re.compile(r"[^\W\d_]")
_SIGNS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_KEEP = regex.compile(r"[^\p{L}\p{M}']+")
_RUN = re.compile(r"(.)\1{3,}")
_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_INVISIBLE = regex.compile(r"\p{Cf}")
_MOJIBAKE = re.compile(r"[ÂÃÄÅÐÑâãåæçèéäï][\u0080-ÿŒ-Ÿˆ-˜–-›€™]")
_ASCII_LETTERS = {i: chr(i).lower() if chr(i).isalpha() or i == 39 else " " for i in range(128)}


def label_language(label: str | None, more: Sequence[str] = ()) -> str | None:
    """Code of the language a label names, None if it names none of the known ones, nor one of ``more``."""
    if not label:
        return None
    plain = unicodedata.normalize("NFKC", label).strip().casefold()
    head = regex.split(r"[-_\s(,;./]", plain, maxsplit=1)[0]
    return _LABEL_OF.get(plain) or _LABEL_OF.get(head) or next((x for x in (plain, head) if x in more), None)


def sample_language(label: str | None) -> str | None:
    """The same for the samples, whose labels are right: one that isn't known by name stands for itself."""
    return label_language(label) or (unicodedata.normalize("NFKC", label).strip().casefold() or None if label else None)


def _mended(text: str) -> str:
    """A line of UTF-8 once read as Latin-1 or Windows-1252, read again as UTF-8."""
    if len(_MOJIBAKE.findall(text)) < 2:
        return text
    raw = bytearray()
    for c in text:
        o = ord(c)
        if o < 256:
            raw.append(o)
        else:
            try:
                raw += c.encode("cp1252")
            except UnicodeEncodeError:
                raw += c.encode()
    again = raw.decode("utf-8", "replace")
    return again if again.count("�") * 4 < len(_MOJIBAKE.findall(text)) else text


def _bare(sentence: str) -> str:
    """A sentence without tokens that look like code, paths or identifiers."""
    if not _CODED.search(sentence):
        return sentence
    kept = []
    for token in sentence.split():
        core = token.strip("\"'“”‘’«»()[]{}<>.,;:!?…*_#>|-–—`")
        if core.isalpha() or not core or not _CODED.search(core) or (not core.isascii() and _SIGNS.search(core)):
            kept.append(token)
        elif token[-1] in ".!?;":
            kept.append(token[-1])
    return " ".join(kept)


def _sentences(line: str) -> Iterator[str]:
    """A line cut after the marks that end sentences."""
    at = 0
    for m in _SENTENCE.finditer(line):
        yield line[at : m.end()].strip()
        at = m.end()
    yield line[at:].strip()


def _unwrapped(lines: list[str]) -> list[str]:
    """Lines, with those joined that only wrap a sentence: the first doesn't end one, the next begins in lower case."""
    out: list[list[str]] = []
    open_end = False
    for line in lines:
        if not line or line.isspace():
            open_end = False
            continue
        bare = _PREFIX.sub("", line, count=1)
        if open_end and bare[:1].islower():
            out[-1].append(bare)
        else:
            out.append([line])
        end = line.rstrip()[-1:]
        open_end = end.isalnum() or end in ",'\"»)"
    return [" ".join(parts) for parts in out]


def _readable(text: str) -> str:
    """Text with damaged encodings mended, compatibility forms folded, and escapes, entities, controls and invisible characters resolved."""
    if not text.isascii():
        text = "\n".join(line if line.isascii() else _mended(line) for line in text.split("\n"))
        text = unicodedata.normalize("NFKC", text)
    if "\x1b" in text:
        text = _ANSI.sub(" ", text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\\" in text:
        text = text.replace("\\n", "\n").replace('\\"', '"')
    text = text.replace("\t", " ")
    if not text.replace("\n", " ").isprintable():
        text = _CONTROLS.sub(" ", _INVISIBLE.sub("", text))
    return html.unescape(text) if "&" in text and ";" in text else text


def _cut(line: str) -> Iterator[str]:
    """The sentences of a line, without tokens that look like code, where letters are left."""
    if "`" in line:
        line = _TICKS.sub(" ", line)
    if "://" in line:
        line = _URL.sub(" ", line)
    if "@" in line:
        line = _MAIL.sub(" ", line)
    if "<" in line:
        line = _TAGS.sub(" ", line)
    if '":' in line or '" :' in line:
        line = _JSON_KEY.sub("\n", line)
    if not line.isascii() and ("/" in line or "_" in line or "\\" in line):  # elsewhere blanks part paths from words
        line = _PATHLIKE.sub(" ", line)
    for sentence in _sentences(line):
        if sentence:
            bare = _bare(sentence)
            if _LETTER.search(bare):
                yield bare


def segments_and_code(text: str, joined: bool = True) -> tuple[list[str], list[str]]:
    """(sentences of a text, in order; what its code fences leave when cut the same way). Lines that wrap a sentence are joined first, unless asked not to."""
    if not text or text.isspace():
        return [], []
    text = _readable(text)
    fenced: list[str] = []
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(lambda m: fenced.append(m.group()) or "\n", text)
    lines = text.split("\n")
    return [s for line in (_unwrapped(lines) if joined else lines) for s in _cut(line)], [s for f in fenced for line in f.split("\n") for s in _cut(line)]


def segments(text: str) -> list[str]:
    """Sentences of a text, in order; what stands in code fences is left out."""
    return segments_and_code(text)[0]


def letters(segment: str) -> str:
    """What the models read of a segment: letters in folded case, everything else one blank; no letter more than three times in a row."""
    if segment.isascii():
        bare = " ".join(segment.translate(_ASCII_LETTERS).split())
    else:
        bare = _KEEP.sub(" ", segment.casefold()).strip()
    return _RUN.sub(r"\1\1\1", bare)


def bare_accents(text: str) -> str:
    """Text without the accents of Latin letters."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not (0x300 <= ord(c) < 0x370))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order the hash of the k-gram that ends at each place (places before the k-th are meaningless)."""
    out, raw, power = [], np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(order):
            shifted = np.zeros(len(codes), np.uint64)
            shifted[k:] = codes[: len(codes) - k] if k else codes
            raw = raw + (shifted + np.uint64(1)) * power
            power = power * BASE
            out.append(_mixed(raw + np.uint64(k)))
    return out


class SortedHashes:
    """Sorted distinct hashes with an index of their leading bits: a look-up starts where its bits begin and takes a few steps."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(int(len(keys)).bit_length() + 2, 8)
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(keys, np.arange(2**bits, dtype=np.uint64) << self.shift).astype(np.int32)
        counts = np.diff(np.append(self.begins, len(keys)))
        self.steps = int(counts.max(initial=0))

    def __len__(self) -> int:
        return len(self.keys) - 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, len(self) for those that aren't there."""
        at = self.begins[(hashes >> self.shift).astype(np.int64)]
        found = np.where(self.keys[at] == hashes, at, len(self))
        last = len(self)
        for k in range(1, self.steps):
            rest = np.flatnonzero((found == last) & (self.keys[np.minimum(at + k - 1, last)] < hashes))
            if not len(rest):
                break
            spot = np.minimum(at[rest] + k, last)
            hit = self.keys[spot] == hashes[rest]
            found[rest[hit]] = spot[hit]
        return found


def _coded(texts: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each after ``order`` blanks and with one at its end; which places are predicted; the text of each place."""
    pad = " " * order
    joined = "".join(pad + t + " " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) + order + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    offset = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return codes, offset >= order, owner


def _fit_language(texts: Sequence[str], order: int):
    """[(grams, discounted probabilities, contexts, back-off weights)] for k = 1..order."""
    codes, predicted, _ = _coded(texts, order)
    hashes = gram_hashes(codes, order)
    places = np.flatnonzero(predicted)
    tables = []
    for k in range(1, order + 1):
        own = hashes[k - 1][places]
        if k == order:
            grams, first, counts = np.unique(own, return_index=True, return_counts=True)
            at = places[first]
        else:  # number of distinct characters to the left
            _, first_long = np.unique(hashes[k][places], return_index=True)
            shorter = own[first_long]
            grams, first, counts = np.unique(shorter, return_index=True, return_counts=True)
            at = places[first_long][first]
        counts = counts.astype(float)
        n1, n2 = float((counts == 1).sum()), float((counts == 2).sum())
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else DEFAULT_DISCOUNT
        context_of = hashes[k - 2][at - 1] if k > 1 else np.zeros(len(grams), np.uint64)
        contexts, inverse = np.unique(context_of, return_inverse=True)
        total = np.bincount(inverse, counts)
        kinds = np.bincount(inverse)
        tables.append((grams, np.maximum(counts - discount, 0) / total[inverse], contexts, discount * kinds / total))
    return tables


class LanguageModels:
    """Kneser-Ney models of several languages in common sorted tables, and each language's entropy bound."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.order, self.languages = order, sorted(texts)
        fitted = [_fit_language(texts[lang], order) for lang in self.languages]
        n = len(self.languages)
        self.grams: list[SortedHashes] = []
        self.direct: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        for k in range(1, order + 1):
            keys = [f[k - 1][0] for f in fitted] + ([f[k][2] for f in fitted] if k < order else [])
            grams = np.unique(np.concatenate(keys))
            direct, back = np.zeros((len(grams) + 1, n), np.float32), np.ones((len(grams) + 1, n), np.float32)
            for j, f in enumerate(fitted):
                direct[np.searchsorted(grams, f[k - 1][0]), j] = f[k - 1][1]
                if k < order:
                    back[np.searchsorted(grams, f[k][2]), j] = f[k][3]
            self.grams.append(SortedHashes(grams))
            self.direct.append(direct)
            self.back.append(back)
        self.first_back = np.array([f[0][3][0] for f in fitted], np.float32)
        self.seen: dict[str, tuple[str | None, float, float]] = {}
        self.bounds, self.usual = np.full(n, np.inf), np.full(n, np.inf)
        self.sharpness = 1.0

    def entropies(self, texts: Sequence[str]) -> np.ndarray:
        """Cross-entropy in nats a character, [text, language]. Texts longer than a piece are scored piece by piece, each after the characters before it."""
        if any(len(t) > PIECE_CHARS for t in texts):
            return np.stack([self._long(t) for t in texts])
        return self._entropies(texts)

    def _long(self, text: str) -> np.ndarray:
        codes, predicted, _ = _coded([text], self.order)
        sums = np.zeros(len(self.languages))
        for a in range(self.order, len(codes), PIECE_CHARS):
            part = slice(a - self.order, a + PIECE_CHARS)
            sums += self._logs(codes[part], np.flatnonzero(np.arange(len(codes[part])) >= self.order)).sum(0, dtype=np.float64)
        return -sums / int(predicted.sum())

    def _logs(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log probabilities of the characters at some places, [place, language]."""
        hashes = gram_hashes(codes, self.order)
        p = np.full((len(places), len(self.languages)), 1.0 / ALPHABET, np.float32)
        rows_before = None
        for k in range(1, self.order + 1):
            everywhere = self.grams[k - 1].find(hashes[k - 1])
            back = self.first_back if k == 1 else self.back[k - 2][rows_before[places - 1]]
            p = self.direct[k - 1][everywhere[places]] + back * p
            rows_before = everywhere
        return np.log(p)

    def _entropies(self, texts: Sequence[str]) -> np.ndarray:
        codes, predicted, owner = _coded(texts, self.order)
        places = np.flatnonzero(predicted)
        starts = np.searchsorted(owner[places], np.arange(len(texts)))
        sums = np.add.reduceat(self._logs(codes, places), starts, axis=0)
        counts = np.bincount(owner[places], minlength=len(texts))
        return -sums / counts[:, None]

    def calibrate(self, held: dict[str, list[str]], slack: float = SLACK) -> None:
        """Bounds from held-out sentences: the 98th percentile of their entropy (``usual``) and a slack in nats above it; sharpness of the confidence by their likelihood."""
        rows, truth = [], []
        for j, lang in enumerate(self.languages):
            if held.get(lang):
                e = self.entropies(held[lang])
                self.usual[j] = np.quantile(e[:, j], 0.98)
                self.bounds[j] = self.usual[j] + slack
                rows.append(e)
                truth += [j] * len(e)
        if rows:
            e, t = np.concatenate(rows), np.array(truth)
            best = None
            for sharp in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
                logits = -(e - e.min(1, keepdims=True)) * sharp
                loss = -(logits[np.arange(len(t)), t] - np.log(np.exp(logits).sum(1))).mean()
                if best is None or loss < best:
                    best, self.sharpness = loss, sharp

    def judge_all(self, texts: Sequence[str]) -> list[tuple[str | None, float, float]]:
        """``judge`` with a bounded memory: templated texts say the same sentence again and again."""
        new = [t for t in dict.fromkeys(texts) if t not in self.seen]
        if len(self.seen) + len(new) > SEEN_AT_MOST:
            self.seen.clear()
            new = list(dict.fromkeys(texts))
        start = size = 0
        for i, t in enumerate(new):
            size += len(t) + self.order + 1
            if size > CHARS_AT_ONCE or i + 1 == len(new):
                self.seen.update(zip(new[start : i + 1], self.judge(new[start : i + 1])))
                start, size = i + 1, 0
        return [self.seen[t] for t in texts]

    def judge(self, texts: Sequence[str]) -> list[tuple[str | None, float, float]]:
        """(language or None if rejected, confidence, entropy) of each segment."""
        if not texts:
            return []
        e = self.entropies(texts)
        j = e.argmin(1)
        low = e[np.arange(len(e)), j]
        odds = np.exp(-(e - low[:, None]) * self.sharpness)
        sure = 1 / odds.sum(1)
        return [(self.languages[a] or None if x <= self.bounds[a] else None, float(c), float(x)) for a, x, c in zip(j, low, sure)]


def train(samples: list[tuple[str, str]], order: int = ORDER, code: Sequence[str] = ()) -> LanguageModels:
    """Models from (language, sentence) pairs, and of what is no language from ``code``; every fifth sentence calibrates first, then all of them train."""
    by: dict[str, list[str]] = {}
    for lang, text in samples:
        by.setdefault(lang, []).extend(t for s in segments(text) if len(t := letters(s)) > 3)
    by = {lang: own for lang, own in by.items() if own}
    noise = sorted({t for s in code if len(t := letters(s)) > 3})
    if len(noise) >= LEAST_NONE:
        by[NONE] = noise
    spoken = [lang for lang in by if lang not in (NONE, "ja", "ru", "zh")]
    grown = by | {lang: by[lang] + [b for t in by[lang] if (b := bare_accents(t)) != t] for lang in spoken}
    held = {lang: own[::5] for lang, own in by.items() if len(own) >= 10}
    rest = {lang: [t for i, t in enumerate(own) if i % 5] if lang in held else own for lang, own in by.items()}
    trial = LanguageModels(rest, order)
    trial.calibrate(held)
    models = LanguageModels(grown, order)
    models.bounds, models.usual, models.sharpness = trial.bounds, trial.usual, trial.sharpness
    return models


def proves(segment: str) -> bool:
    """Whether a segment, as ``letters`` gives it, is long enough to show a language."""
    if len(segment) - segment.count(" ") - segment.count("'") >= LEAST_LETTERS:
        return True
    return not segment.isascii() and len(_SIGNS.findall(segment)) >= LEAST_SIGNS


def _label_column(label: str, more: Sequence[str] = ()) -> F.Column:
    """label_language as a column expression."""
    names = {m: m for m in more} | _LABEL_OF
    table = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    plain = F.lower(F.trim(F.regexp_replace(F.col(label), r"[\s\u00a0\u3000]+", " ")))
    return F.coalesce(table[plain], table[F.split(plain, r"[-_\s(,;./]")[0]])


def _worst(models: LanguageModels, lang: str, texts: list[str]) -> np.ndarray:
    """Of each text the highest entropy of a stretch of STRETCH characters under one language: a foreign part shows, however long the rest."""
    codes, predicted, owner = _coded(texts, models.order)
    places = np.flatnonzero(predicted)
    bits = -models._logs(codes, places)[:, models.languages.index(lang)].astype(np.float64)
    out = []
    for own in np.split(bits, np.flatnonzero(np.diff(owner[places])) + 1):
        total = np.concatenate([[0.0], np.cumsum(own)])
        n = min(STRETCH, len(own))
        out.append((total[n:] - total[:-n]).max() / n)
    return np.array(out)


def _supported(first: list[tuple[str, str]], more: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Of further sentences, as ``letters`` gives them, those that the other half of them supports: under models of the samples and that half no stretch lies more than SLACK above 98 of 100 sentences' worst."""
    halves = [sorted(set(more))[k::2] for k in (0, 1)]  # repeats of a sentence stand in one half
    kept = set()
    for own, other in (halves, halves[::-1]):
        texts: dict[str, list[str]] = {}
        for lang, s in first:
            texts.setdefault(lang, []).extend(letters(x) for x in segments(s))
        for lang, s in other:
            texts.setdefault(lang, []).append(s)
        models = LanguageModels({lang: t for lang, t in texts.items() if t})
        for lang in models.languages:
            mine = [s for at, s in own if at == lang]
            for a in range(0, len(mine), 2000):
                part = mine[a : a + 2000]
                worst = _worst(models, lang, part)
                kept |= {(lang, s) for s, x in zip(part, worst) if x <= np.quantile(worst, 0.98) + SLACK}
    return [pair for pair in more if pair in kept]


def training_sentences(documents: DataFrame, samples: DataFrame, *, key: str, text: str, label: str, per_language: int = SAMPLE_PER_LANGUAGE, most_chars: int = SAMPLE_CHARS,
                       sentences: int = SENTENCES_PER_LANGUAGE) -> tuple[list[tuple[str, str]], list[str]]:
    """(labelled sentences, code): of the samples the first ``sentences`` a label by a hash; and of ``per_language`` documents a label (the first by a hash of their id, each of at most
    ``most_chars`` characters) the sentences that models of the samples alone give to the document's label and that stand under it more often than not, and what their code fences hold.
    """
    def first_of(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= most)

    given = samples.select(F.col("lang").alias("l"), F.col("text").alias("t")).where("l is not null and t is not null")
    given = first_of(given, "l", [F.xxhash64("t"), F.col("t")], sentences).orderBy("l", "t").select("l", "t").collect()
    first = [(lang, r[1]) for r in given if (lang := sample_language(r[0]))]
    if not first:
        return [], []
    more = sorted({lang for lang, _ in first} - set(LANGUAGES))
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), _label_column(label, more).alias("l")).where((F.col("l").isNotNull()) & F.length("t").between(1, most_chars))
    drawn = first_of(rows, "l", [F.xxhash64("k"), F.col("k")], per_language).select("l", "t").collect()
    pairs, code = [], []
    for lang, t in drawn:
        own, fenced = segments_and_code(t, joined=False)  # a heading taken for the first half of a sentence would be learned with it
        pairs += [(lang, x) for s in own if len(x := letters(s)) > 8]
        code += fenced
    trial, out = train(first, code=code), list(first)
    seen = Counter(pairs)
    anywhere = Counter(s for _, s in pairs)
    for a in range(0, len(pairs), 2000):
        part = pairs[a : a + 2000]
        best = trial.entropies([s for _, s in part]).argmin(1)
        out += [pair for pair, j in zip(part, best) if trial.languages[j] == pair[0] and seen[pair] * 2 > anywhere[pair[1]]]
    return first + _supported(first, out[len(first) :]), code


_models: dict[str, LanguageModels] = {}


def _shared_models(name: str, shared) -> LanguageModels:
    """The broadcast models, once a Python worker."""
    if name not in _models:
        _models.clear()
        _models[name] = shared.value
    return _models[name]


def document_languages(models: LanguageModels, texts: Sequence[str | None]) -> list[tuple[dict[str, tuple[int, float]], list[tuple[str, str | None, float]]]]:
    """For each text: {language: (letters, confidence)} and its segments with their verdicts."""
    cut = [segments(t) if t else [] for t in texts]
    flat = [letters(s) for own in cut for s in own]
    verdicts = models.judge_all(flat)
    given = iter(zip(flat, verdicts))
    out = []
    for own in cut:
        found: dict[str, list[tuple[int, float]]] = {}
        judged, short, alone = [], [], set()
        for segment in own:
            bare, (lang, sure, entropy) = next(given)
            judged.append((segment, lang, sure))
            if lang and sure >= SURE and proves(bare):
                found.setdefault(lang, []).append((len(bare), sure))
                if sure >= SURE_ALONE and entropy <= models.usual[models.languages.index(lang)]:
                    alone.add(lang)
            elif lang:
                short.append((sure >= SURE, len(bare), lang, sure))
        if not found and short:  # nothing long and sure: the longest sure segment counts, else the longest
            _, size, lang, sure = max(short)
            if size >= SHORTEST:
                found[lang] = [(size, sure)]
        if len(found) > 1:  # a further language must show more than once, or beyond doubt
            main = max(found, key=lambda k: (sum(n for n, _ in found[k]), k))
            found = {k: v for k, v in found.items() if k == main or len(v) > 1 or k in alone}
        out.append(({k: (sum(n for n, _ in v), sum(n * c for n, c in v) / sum(n for n, _ in v)) for k, v in found.items()}, judged))
    return out


def _run(name: str, shared, pick):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _shared_models(name, shared)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                yield pick(part, document_languages(models, part.column(1).to_pylist()))

    return run


def fitted_models(documents: DataFrame, samples: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang") -> LanguageModels | None:
    pairs, code = training_sentences(documents, samples, key=key, text=text, label=label)
    return train(pairs, code=code) if pairs else None


def languages(documents: DataFrame, samples: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """key, label_lang (what the label names), lang, letters, confidence: a row for each language a document is written in, one with a null lang where that is none."""
    spark = documents.sparkSession
    kind = next(f.dataType.simpleString() for f in documents.schema.fields if f.name == key)
    schema = f"_key {kind}, label_lang string, lang string, letters int, confidence double"
    models = fitted_models(documents, samples, key=key, text=text, label=label)
    if models is None:  # nothing is known of any language
        none = documents.select(F.col(key), F.lit(None).cast("string").alias("label_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0).alias("letters"), F.lit(0.0).alias("confidence"))
        return none
    shared = spark.sparkContext.broadcast(models)
    more = sorted(set(models.languages) - {NONE, *LANGUAGES})

    def pick(part, judged):
        keys, labels, langs, counts, sure = [], [], [], [], []
        for k, l, (found, _) in zip(part.column(0), part.column(2).to_pylist(), judged):
            named = label_language(l, more)
            for lang in sorted(found) or [None]:
                size, confidence = found.get(lang, (0, 0.0))
                keys.append(k.as_py())
                labels.append(named)
                langs.append(lang)
                counts.append(size)
                sure.append(confidence)
        return pa.RecordBatch.from_arrays([pa.array(keys, part.schema.field(0).type), pa.array(labels, pa.string()), pa.array(langs, pa.string()), pa.array(counts, pa.int32()), pa.array(sure, pa.float64())],
                                          ["_key", "label_lang", "lang", "letters", "confidence"])

    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(label).alias("_label"))
    return spread(rows).mapInArrow(_run(uuid.uuid4().hex, shared, pick), schema).withColumnRenamed("_key", key)


def language_segments(documents: DataFrame, samples: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """key, segment (number from 0), content, lang (null if rejected), confidence: every sentence of natural language."""
    spark = documents.sparkSession
    kind = next(f.dataType.simpleString() for f in documents.schema.fields if f.name == key)
    schema = f"_key {kind}, segment int, content string, lang string, confidence double"
    models = fitted_models(documents, samples, key=key, text=text, label=label)
    if models is None:
        return spark.createDataFrame([], schema).withColumnRenamed("_key", key)
    shared = spark.sparkContext.broadcast(models)

    def pick(part, judged):
        rows = [(k.as_py(), i, s, lang, c) for k, (_, own) in zip(part.column(0), judged) for i, (s, lang, c) in enumerate(own)]
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [part.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["_key", "segment", "content", "lang", "confidence"])

    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return spread(rows).mapInArrow(_run(uuid.uuid4().hex, shared, pick), schema).withColumnRenamed("_key", key)


def relabelled(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Of ``languages``: all rows with a language of documents without label, with a label naming none of their languages, or in several languages."""
    found = found.where(F.col("lang").isNotNull())
    mine = W.partitionBy(key)
    right = F.max(F.coalesce(F.col("lang") == F.col("label_lang"), F.lit(False))).over(mine)
    return found.withColumn("_n", F.count(F.lit(1)).over(mine)).withColumn("_right", right).where((F.col("_n") > 1) | ~F.col("_right")).drop("_n", "_right")
