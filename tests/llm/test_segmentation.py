import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import segmentation as seg

SCHEMA = "item_id bigint, text string, role string, level int, key string, piece int"


def check(text, limit, overlap, role=None):
    parts = seg.pieces(text, role, limit, overlap)
    assert parts[0][0] == parts[0][1] == 0 and parts[-1][2] == len(text)
    for (a, f, b), (c, g, _) in zip(parts, parts[1:]):
        assert g == b and b - overlap <= c <= b
    assert all(b - a <= limit and f < b for a, f, b in parts)
    # the fresh parts put together are the text
    assert "".join(text[f:b] for _, f, b in parts) == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。é", min_size=1, max_size=900), st.integers(40, 200))
def test_pieces_rebuild_the_text(text, limit):
    check(text, limit, limit // 5)


def test_cuts_lie_at_topic_changes():
    a = "The loan rate of the bank rose. The bank raised the loan rate. " * 12
    b = "Whales swim in cold seas. Cold seas feed whales. " * 16
    text = (a + b).strip()
    first = seg.pieces(text, "text", 1200, 100)[0]
    assert abs(first[2] - len(a)) < 130 and text[first[2] - 2] == "."


def test_without_any_boundary_it_cuts_hard():
    check("x" * 5000, 2048, 256)
    assert len(seg.pieces("x" * 5000, None)) >= 3


def test_tables_are_cut_at_line_ends():
    text = "\n".join("| a. b | %d |" % k for k in range(400))
    for _, _, b in seg.pieces(text, "table")[:-1]:
        assert text[b - 1] == "\n"


def test_operator(spark):
    random.seed(1)
    long = " ".join("word%d." % random.randrange(50) for _ in range(800))
    rows = [(1, long, "text", 0, "k", 7), (1, long, "text", 0, "k", 7), (2, "short", None, None, None, None), (3, None, "text", 0, "", 0), (4, "", "text", 0, "", 0), (5, " " * 3000, "text", 0, "", 0), (6, " " + "a" * 2048 + "\n", "text", 0, "", 0), (None, "b" * 2049, None, None, "", 0)]
    out = seg.split_oversized(spark.createDataFrame(rows, SCHEMA)).collect()
    ids = [r.item_id for r in out]
    assert set(ids) == {1, None} and all(len(r.text) <= 2048 for r in out)
    mine = sorted((r for r in out if r.item_id == 1), key=lambda r: r.piece)
    assert [r.piece for r in mine] == list(range(1, mine[0].pieces + 1))
    for a, b in zip(mine, mine[1:]):
        shared = b.fresh - b.start
        assert 0 <= shared <= 256 and a.text.endswith(b.text[:shared])
    assert seg.split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0


def test_overlap_must_be_small(spark):
    with pytest.raises(ValueError):
        seg.split_oversized(spark.createDataFrame([], SCHEMA), overlap=2000)
