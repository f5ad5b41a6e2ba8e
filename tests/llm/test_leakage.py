import random

import pytest

from runweave.llm import leakage as L

OPEN = "Read this first and answer."
ITEM = 'Only "alpha-beta" moves the signed queue again; the open lockfile doesn\'t change early. Suppose graph 92 waits & stops twice.'


def detector(*texts, words=10):
    return L.Detector(L.item_words(list(enumerate(texts))), words)


def found(d, text):
    return set().union(*(s for _, _, s in d.hits(L.Stream(L.words_of(text)))), set())


@pytest.mark.parametrize("text", [
    ITEM, ITEM.upper(), "x " + ITEM.replace(" ", "\n * ") + " y", ITEM.replace("'", "&#39;").replace("&", "&amp;").replace(" ", "&nbsp;", 4),
    "<p>" + ITEM.replace("signed", "<b>signed</b>").replace("lock", "lo<i>ck</i>") + "</p>", ITEM.replace("e", "e​").replace("a", "­a"),
    "".join(chr(ord(c) + 0xFEE0) if c.isalnum() and c.isascii() else c for c in ITEM), ITEM.replace("\"", '\\"').replace(" ", "\\n", 3), ITEM.replace("q", "\\u0071"),
    ITEM.replace(" ", "%20"), "| 1 | " + ITEM.replace("; ", "; |\n| 2 | ") + " |", ITEM.replace("signed", "[signed](http://x.y/z)"), ITEM.replace("-", ""), "**" + ITEM.replace(" ", " _") + "**",
])
def test_writings(text):
    assert found(detector(ITEM), text) == {0}


@pytest.mark.parametrize("unit", ["a", " ", "|", "| ", "\\", "&", "&amp;", "%2", "%41", "<a", "](", "](x", "<!--", "1|", "\\u0041"])
def test_long_runs_take_linear_time(unit):
    import time

    began = time.process_time()
    d = detector(ITEM)
    text = unit * 60_000 + " " + ITEM + " " + unit * 60_000
    d.hits(L.Stream(L.words_of(text)))
    L.scrubbed(d, text, 0.5)
    assert time.process_time() - began < 12


def test_nine_words_are_not_enough():
    words = L.words_of(ITEM)
    d = detector(ITEM)
    for k in range(len(words) - 9):
        assert found(d, " ".join(words[k : k + 10])) == {0}
        assert found(d, "zz " + " ".join(words[k : k + 9]) + " zz") == set()
    ten = words[:10]
    assert found(d, " ".join(ten[:9]) + " " + ten[9] + "s") == set()
    assert found(d, "x" + " ".join(ten)) == set()
    assert found(d, " ".join(ten[:5] + ["other"] + ten[5:])) == set()


def test_shared_opening_is_no_part():
    d = detector(*[f"{OPEN} {i} " + " ".join(f"w{i}x{k}" for k in range(12)) for i in range(4)], ITEM)
    assert found(d, OPEN + " Then something else entirely, in ten more words or even a few more.") == set()
    assert found(d, " ".join(f"w2x{k}" for k in range(12))) == {2}
    assert found(d, OPEN + " 2 " + " ".join(f"w2x{k}" for k in range(8))) == set()
    assert found(d, ITEM) == {4}


def test_random_against_brute_force():
    rnd = random.Random(8)
    vocabulary = ["a", "b", "ab", "ba", "aab", "c"]
    for _ in range(60):
        items = [[rnd.choice(vocabulary) for _ in range(rnd.randint(0, 9))] for _ in range(4)]
        d = L.Detector(list(enumerate(items)), 3)
        doc = [rnd.choice(vocabulary) for _ in range(40)]
        text = "".join(doc)
        starts = {sum(map(len, doc[:i])) for i in range(len(doc))}
        ends = starts - {0} | {len(text)}
        want = set()
        for i, own in enumerate(items):
            for k in range(len(own) - 2):
                for more in range(3, len(own) - k + 1):  # three words of the item or more
                    w = "".join(own[k : k + more])
                    want |= {i for s in starts if text.startswith(w, s) and s + len(w) in ends}
        assert set().union(*(s for _, _, s in d.hits(L.Stream(doc))), set()) == want


def test_automaton_lengths():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab") for _ in range(12)) for _ in range(3)]
    sam = L.SuffixAutomaton()
    for t in texts:
        sam.add(t)
    for _ in range(50):
        s = "".join(rnd.choice("abc") for _ in range(30))
        for least in (1, 3, 5):
            covered = {i for a in range(30) for b in range(a + least, 31) if any(s[a:b] in t for t in texts) for i in range(a, b)}
            assert {i for a, b in sam.regions(s, least) for i in range(a, b)} == covered


def test_columns_chunks_and_empties(spark):
    docs = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "", 0), (4, "other words", 0), (5, "long " * 20_000 + ITEM, 0), (1, ITEM, 0)], "doc_id bigint, text string, item_id int")
    other = " ".join(f"q{k}" for k in range(11))
    items = spark.createDataFrame([(7, ITEM), (8, ITEM), (9, None), (10, "too few words"), (11, other)], "item_id bigint, text string")
    for chunk in (10**6, 50):
        got = sorted((r["doc_id"], r["item_id"]) for r in L.leaked_items(docs, items, chunk_chars=chunk).collect())
        assert got == [(1, 7), (1, 7), (1, 8), (1, 8), (5, 7), (5, 8)]
    assert L.leaked_items(docs, items.where("false")).count() == 0 and L.leaked_items(docs.where("false"), items).count() == 0
    cleaned = {r["doc_id"]: r for r in L.without_leaks(docs.where("doc_id in (4, 5)"), items).collect()}
    assert cleaned[4]["text"] == "other words" and cleaned[5]["text"].strip(" .") == ("long " * 20_000).strip() and not cleaned[5]["dropped"]
    assert L.without_leaks(docs.where("doc_id = 1"), items).first()["dropped"]


def test_text_that_looks_like_markup():
    words = L.words_of(ITEM)
    d = detector(ITEM)
    assert found(d, ITEM) == {0}
    inside = "if a <b and " + " ".join(words[:10]) + " stays> c"
    assert set().union(*(s for stream in L.readings(inside) for _, _, s in d.hits(stream))) == {0}
    long = "<p class='" + "x" * 5000 + "'>" + " ".join(words[:5]) + "<i " + "y" * 3000 + "> " + " ".join(words[5:10]) + "<!-- " + "z " * 4000 + "-->"
    assert found(d, long) == {0}


def test_results_do_not_depend_on_chunks(spark):
    rnd = random.Random(4)
    texts = [" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(90)}" for _ in range(25)) for _ in range(6)]
    docs = [(f"d{i}", " ".join(rnd.choice([texts[rnd.randrange(6)], "filler words here", texts[rnd.randrange(6)][20:70]]) for _ in range(4))) for i in range(40)] + [("none", None), ("e", "")]
    documents = spark.createDataFrame(docs, "name string, body string").withColumnRenamed("name", "key")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id int, text string")
    found, cleaned = [], []
    for chunk in (60, 200, 2_000_000):
        leaks = L.leaked_items(documents, items, key="key", text="body", chunk_chars=chunk)
        assert dict(leaks.dtypes)["item_id"] == "int"
        found.append(sorted(map(tuple, leaks.collect())))
        cleaned.append(sorted(map(str, L.without_leaks(documents, items, key="key", text="body", chunk_chars=chunk).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 40
    assert cleaned[0] == cleaned[1] == cleaned[2] and len(cleaned[0]) == 42


def test_too_many_items_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_ITEM_CHARS", 100)
    docs = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="in parts"):
        L.leaked_items(docs, spark.createDataFrame([(1, ITEM)], "item_id bigint, text string"))


def test_keys_of_other_types(spark):
    docs = spark.createDataFrame([(1.5, ITEM)], "doc_id double, text string")
    items = spark.createDataFrame([("x", ITEM), ("y", ITEM)], "item_id string, text string")
    assert sorted((r[0], r[1]) for r in L.leaked_items(docs, items).collect()) == [(1.5, "x"), (1.5, "y")]


def test_two_of_few_items_keep_their_opening():
    own = "Every one of these ten opening words stays a part here."
    d = detector(own + " First goes on like this.", own + " Second goes on like that.", ITEM)
    assert found(d, own) == {0, 1}
