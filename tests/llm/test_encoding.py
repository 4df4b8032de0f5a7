import os

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bpe_automaton, encoding

PATH = encoding.TOKENIZER_DIR + "/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
AUTOMATON = bpe_automaton.load_byte_bpe(PATH) if os.path.exists(PATH) else None
PUBLIC = Tokenizer.from_file(PATH) if os.path.exists(PATH) else None
if PUBLIC:
    PUBLIC.encode_special_tokens = True


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="thequickn ing'\n\té日本はह1234.,<|endoftext|>", max_size=80))
def test_same_ids_as_the_public_library(text):
    text = text.encode("utf-8", "ignore").decode()
    if regex.search(r"[\x1c-\x1f]", text):
        return
    ids = encoding.Encoder(AUTOMATON).ids(text)
    assert ids == PUBLIC.encode(text, add_special_tokens=False).ids
    assert encoding.decode(AUTOMATON, ids) == text


def test_long_words():
    for text in ("a" * 4000, "ab" * 2000, "日" * 700, " " * 3000, "the " * 2000):
        assert encoding.Encoder(AUTOMATON).ids(text) == PUBLIC.encode(text, add_special_tokens=False).ids


def test_small_automaton_takes_merges_in_order():
    merges = [(b"a", b"b"), (b"b", b"c"), (b"ab", b"c"), (b"a", b"a")]
    ids = {u + v: 300 + k for k, (u, v) in enumerate(merges)}
    a = bpe_automaton.TokenAutomaton(list(range(256)), merges, ids)
    assert a.encode(b"abc") == [302] and a.encode(b"aab") == [97, 300] and a.encode(b"aaab") == [303, 300] and a.encode(b"bcb") == [301, 98]


def test_operator(spark):
    rows = [(1, "Hello  world", [1]), (2, "", [2]), (3, None, [3]), (1, "Hello  world", [1])]
    got = sorted((r.doc_id, r.ids) for r in encoding.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>")).collect())
    hello = PUBLIC.encode("Hello  world", add_special_tokens=False).ids
    assert got == [(1, hello), (1, hello), (2, []), (3, [])]
    assert encoding.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
