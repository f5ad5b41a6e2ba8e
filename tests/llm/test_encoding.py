import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runweave.llm.encoding import TOKENIZER_DIR, TreeEncoder, encode_texts

FILE = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer files")
PIECES = ["a", "  ", " \n", "\n\n", "don't", "we'll ", "'", "'r", "e", "é", "日本語", "🏳️‍🌈", "<|endoftext|>", "123", "...", "\t", " ", "x" * 40, "\u0000", " the"]


@pytest.fixture(scope="module")
def definition():
    with open(FILE, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def whole(definition):
    """One pass of the library over the whole text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


@pytest.fixture(scope="module")
def tree(definition):
    return TreeEncoder(definition, leaf=64)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=5), max_size=30), st.integers(1, 9), st.integers(1, 8))
def test_tree_equals_one_pass(tree, whole, parts, leaf, window):
    text = "".join(parts)
    tree.leaf, tree.window = leaf, window
    ids = tree.encode(text)
    assert ids == whole(text)
    assert tree.decode(ids) == text


def test_every_long_text_goes_through_joins(definition, whole):
    tree = TreeEncoder(definition, leaf=64)
    text = "The queue was full, don't run it again.\n\n" * 20
    assert tree.encode(text[:64]) == whole(text[:64]) and tree.joins == 0
    assert tree.encode(text) == whole(text) and tree.joins == 15  # 16 leaves
    assert TreeEncoder(definition).leaf < 1000


def test_long_runs(definition, whole):
    rnd = random.Random(2)
    texts = ["a" * 30_000, " " * 9_000 + "x", "\n" * 3_000 + "x", "é" * 7_000, "".join(rnd.choice(PIECES) for _ in range(20_000)), None, "", "ok"]
    tree = TreeEncoder(definition)
    got = [tree.encode(t) for t in texts]
    assert got == [whole(t) for t in texts] and [tree.decode(g) for g in got] == [t or "" for t in texts]


def test_characters_of_other_unicode_versions(tree, whole):
    odd = [chr(c) for c in (0x558, 0x58B, 0xC5C, 0x208F, 0xA7CE, 0x10940, 0x10ED9, 0x1C89, 0x11BC0)]
    tree.leaf, tree.window = 3, 1
    for c in odd:
        text = f"a{c}1 {c}{c}! {c} don't " * 3
        assert tree.encode(text) == whole(text), hex(ord(c))


def test_column(spark):
    df = spark.createDataFrame([(1, "hi", 9), (2, None, 9), (3, "", 9), (1, "hi", 9)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_texts(df).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[0] == got[1] and got[0][1] and got[2][1] == got[3][1] == []
    assert encode_texts(df.where("false")).count() == 0
    assert encode_texts(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
