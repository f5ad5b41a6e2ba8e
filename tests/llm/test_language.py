import pytest

from runweave.llm import language as G

SAMPLES = {
    "en": ["The test failed again after the last change.", "Nobody saw that the queue was full this morning.", "We should run the whole suite before merging it.", "It is hard to say why this check is so slow.", "The report shows that only one of them finished."],
    "de": ["Der Test ist nach der letzten Änderung wieder fehlgeschlagen.", "Niemand hat gesehen, dass die Warteschlange heute voll war.", "Wir sollten vor dem Zusammenführen alles ausführen.", "Es ist schwer zu sagen, warum diese Prüfung so langsam ist.", "Der Bericht zeigt, dass nur einer davon fertig wurde."],
    "fr": ["Le test a encore échoué après la dernière modification.", "Personne n'a vu que la file était pleine ce matin.", "Il faudrait lancer toute la suite avant de fusionner.", "Il est difficile de dire pourquoi ce contrôle est si lent.", "Le rapport montre qu'un seul d'entre eux est terminé."],
    "ru": ["Тест снова упал после последнего изменения.", "Никто не заметил, что очередь была заполнена утром.", "Нужно запустить весь набор перед слиянием.", "Трудно сказать, почему эта проверка такая медленная.", "Отчёт показывает, что завершился только один из них."],
}


@pytest.fixture(scope="module")
def models():
    return G.train([(lang, s) for lang, own in SAMPLES.items() for s in own * 3])


def test_labels():
    for label, want in {"en": "en", "EN-us": "en", " English ": "en", "pt_BR": "pt", "Deutsch": "de", "ger": "de", "zh-Hans-CN": "zh", "日本語": "ja", "español (MX)": "es", "und": None, "": None, None: None, "??": None, "xx": None, "ＥＮ": "en", "sv": None}.items():
        assert G.label_language(label) == want, label


def test_label_column_agrees(spark):
    labels = ["en", "EN-us", " English ", "pt_BR", "Deutsch", "zh-Hans-CN", "日本語", "español (MX)", "und", "", None, "??"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert {r[0]: r[1] for r in df.select("l", G._label_column("l")).collect()} == {x: G.label_language(x) for x in labels}


def test_probabilities_sum_to_one(models):
    import numpy as np

    chars = sorted({c for own in SAMPLES.values() for t in own for c in G.letters(t)})
    base = "the te"
    total = np.zeros(len(models.languages))
    before = models.entropies([base])[0]
    for c in chars:  # p(c | "the te") from the difference of two texts' log probabilities, without their ends
        codes, predicted, _ = G._coded([base + c], models.order)
        both = models.entropies([base + c])[0] * predicted.sum()
        ends = _end(models, base + c)
        total += np.exp(-(both - ends) + (before * (len(base) + 1) - _end(models, base)))
    assert (total <= 1.0001).all() and (total > 0.85).all()  # the rest is kept for characters never seen


def _end(models, text):
    """Minus log probability of the blank that ends a text."""
    import numpy as np

    codes, predicted, owner = G._coded([text], models.order)
    hashes = G.gram_hashes(codes, models.order)
    p, last, rows = np.full(len(models.languages), 1.0 / G.ALPHABET), len(codes) - 1, None
    for k in range(1, models.order + 1):
        spot = lambda h: int(models.grams[k - 1].find(np.array([h]))[0])  # noqa: B023, E731
        back = models.first_back if k == 1 else models.back[k - 2][rows]
        p = models.direct[k - 1][spot(hashes[k - 1][last])] + back * p
        rows = spot(hashes[k - 1][last - 1])
    return -np.log(p)


def test_sorted_hashes():
    import numpy as np

    rnd = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rnd.integers(0, 2**63, 500, dtype=np.uint64), np.arange(40, dtype=np.uint64)]))
    table = G.SortedHashes(keys)
    for i, k in enumerate(keys):
        assert table.find(np.array([k]))[0] == i
    other = np.setdiff1d(rnd.integers(0, 2**63, 1000, dtype=np.uint64), keys)
    assert (table.find(other) == len(keys)).all() and (table.find(np.array([50, 2**64 - 2], np.uint64)) == len(keys)).all()
    assert len(G.SortedHashes(keys[:0])) == 0 and G.SortedHashes(keys[:0]).find(other[:3]).tolist() == [0, 0, 0]


def test_held_out_sentences(models):
    cases = {"en": "The whole queue failed this morning after the change", "de": "Die Änderung hat heute wieder nicht alles gezeigt", "fr": "Personne ne peut dire pourquoi la file est encore pleine", "ru": "Очередь снова заполнена после проверки"}
    for lang, text in cases.items():
        assert models.judge([G.letters(text)])[0][0] == lang
        assert models.judge([G.letters(text.upper())])[0][0] == lang
    assert models.judge([G.letters("Die Anderung hat heute wieder nicht alles gezeigt")])[0][0] == "de"
    assert models.judge(["zzzzqqqqxxxxkkkkjjjjwwww" * 3])[0][0] is None
    assert models.judge([]) == []


def test_segments_leave_code_out():
    text = "The queue was full.\n```\nconst x_1 = load(3);\n``` Niemand hat src/a/b_c.py gesehen.\nPASS  a/b.test.ts (12 ms)\n+import { x } from './y'\nsha=ab12 skipped=3\n| `a/b.ts` | 0.3 |\n{\"test_path\": \"a.b\", \"reasoning\":\"Il faudrait attendre.\"}"
    found = [G.letters(s) for s in G.segments(text)]
    spoken = ["the queue was full", "niemand hat gesehen", "il faudrait attendre"]
    assert [s for s in found if "import" not in s] == spoken  # the rest is for the models to reject
    assert not any("load" in s or "skipped" in s for s in found)
    assert G.segments("") == G.segments("  \n\t") == G.segments("```\nx = 1\n```") == []


@pytest.mark.parametrize("unit", ["a", " ", "/", "\\", "@", "a@", "a/", "_", "`", "<a", "\n", "a\n", "{", "日", "Ã©", "=", "a=", "😀", ". ", "```\n"])
def test_long_runs_take_linear_time(models, unit):
    import time

    began = time.process_time()
    found = G.document_languages(models, [unit * 60_000, "@ / \\ :// " + unit * 60_000 + " x@y.z / : expected "])
    assert len(found) == 2 and time.process_time() - began < 12


def test_what_fences_hold_is_no_language(models):
    """Noise of another make: the models learn it from fences and reject it outside them."""
    code = [f"assertion {a} violated by {b} while evaluating" for a in ("alpha", "beta", "gamma", "delta") for b in ("one", "two", "three", "four")] + [f"warning unused {x} symbol emitted" for x in ("left", "right", "upper", "lower")]
    pairs = [(lang, s) for lang, own in SAMPLES.items() for s in own * 3]
    text = "assertion gamma violated by seven while evaluating\nwarning unused middle symbol emitted"
    assert set(G.document_languages(models, [text])[0][0]) == {"en"}  # nothing has shown it to be code
    taught = G.train(pairs, code=code)
    assert set(G.document_languages(taught, [text])[0][0]) == set()
    mixed = text + "\n" + " ".join(SAMPLES["de"][:2])
    assert set(G.document_languages(taught, [mixed])[0][0]) == {"de"}
    assert G.segments_and_code("Il faudrait attendre.\n```\nassertion alpha violated by one\n```")[1] == ["assertion alpha violated by one"]


def test_an_eleventh_language(spark):
    swedish = ["Testet misslyckades igen efter den senaste ändringen.", "Ingen såg att kön var full i morse.", "Vi borde köra hela sviten innan vi slår ihop den.", "Det är svårt att säga varför kontrollen är så långsam.", "Rapporten visar att bara en av dem blev klar."]
    own = SAMPLES | {"sv": swedish}
    samples = spark.createDataFrame([(i, lang, s) for i, (lang, s) in enumerate((lang, s) for lang, o in own.items() for s in o * 3)], "sample_id bigint, lang string, text string")
    docs = spark.createDataFrame([(1, " ".join(swedish[:3]), "sv-SE"), (2, " ".join(swedish[2:]), "en"), (3, "x = 1", "en"), (4, None, None), (5, " ".join(SAMPLES["fr"]), "svenska")], "doc_id bigint, text string, lang string")
    rows = {(r["doc_id"], r["lang"]): r for r in G.languages(docs, samples).collect()}
    assert set(rows) == {(1, "sv"), (2, "sv"), (3, None), (4, None), (5, "fr")}
    assert rows[(1, "sv")]["label_lang"] == "sv" and rows[(3, None)]["letters"] == 0 and rows[(5, "fr")]["label_lang"] is None
    assert sorted((r["doc_id"], r["lang"]) for r in G.relabelled(G.languages(docs, samples)).collect()) == [(2, "sv"), (5, "fr")]


def test_one_sure_sentence_of_another_language(models):
    text = " ".join(SAMPLES["fr"] * 3) + " " + SAMPLES["ru"][0]
    assert set(G.document_languages(models, [text])[0][0]) == {"fr", "ru"}


def test_long_text_is_judged_whole(models):
    long = G.letters(" ".join(SAMPLES["de"]))
    text = " ".join([long] * (3 * G.PIECE_CHARS // len(long)))
    assert models.judge([text])[0][0] == "de"
    assert abs(models.entropies([text])[0] - models._entropies([text])[0]).max() < 1e-5  # pieces are scored after what stands before them


def test_mended_encodings():
    bad = "Тест снова упал".encode().decode("latin-1")
    assert G.segments(bad) == ["Тест снова упал"]
    assert G.segments("modifié déjà été".encode().decode("cp1252")) == ["modifié déjà été"]


def test_documents(models):
    mixed = " ".join(SAMPLES["de"][:2]) + "\n\n" + " ".join(SAMPLES["ru"][:2])
    found = G.document_languages(models, [mixed, None, "", "x = 1", SAMPLES["fr"][0] * 300])
    assert set(found[0][0]) == {"de", "ru"} and [lang for _, lang, _ in found[0][1]] == ["de", "de", "ru", "ru"]
    assert [set(f[0]) for f in found[1:]] == [set(), set(), set(), {"fr"}]
    assert all(0 < c <= 1 for _, c in found[0][0].values())


def test_query_columns(spark):
    docs = [(i, " ".join(own), lang if i % 2 else "und", 0) for i, (lang, own) in enumerate(SAMPLES.items())] + [(9, None, "en", 0), (10, " ", None, 0), (11, " ".join(SAMPLES["de"]), "Englisch", 0), (12, SAMPLES["de"][0] + "\n" + SAMPLES["fr"][1], "de", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, segment int")
    samples = spark.createDataFrame([(i, lang, s) for i, (lang, s) in enumerate((lang, s) for lang, own in SAMPLES.items() for s in own * 3)], "sample_id bigint, lang string, text string")
    got = sorted((r["doc_id"], r["lang"]) for r in G.relabelled(G.languages(df, samples)).collect())
    assert got == [(0, "en"), (2, "fr"), (11, "de"), (12, "de"), (12, "fr")]
    assert G.language_segments(df, samples).where("doc_id = 12").count() == 2
    assert G.languages(df.where("false"), samples).count() == 0
    assert {r["lang"] for r in G.languages(df, samples.where("false")).collect()} == {None}
