import pytest

from ledgerloom.llm import mojibake as moji

CLEAN = [
    "Größere Änderungen, l’élève à Đà Lạt – “core” earnings — £26.3m, €4 and ₹37 crore…",
    "The letters Ã, Â and É rank last. ¿Ñandú? DEMONSTRAÇÃO DO RESULTADO",
    "Отчёт о прибылях: см. приложение; β = 1.12, σ², Łódź, Győr",
    "売上高は増加し、£65.2mとなりました。 कंपनी की आय",
    "R&amp;D and M&A, © 2024 👩‍💼 ok then ​x",
    "He said “naïve café”. «Été» 5 °C ± 2 %",
]


@pytest.mark.parametrize("text", CLEAN)
def test_correct_text_is_left_alone(text):
    assert moji.restore(text) == (text, 0, 0)


@pytest.mark.parametrize("encoding", ["cp1252", "cp1250", "mac_roman", "cp437"])
def test_utf8_read_as_something_else_comes_back(encoding):
    text = "The directors’ view – worth £4 million, a café résumé of Zürich."
    table = {b: c for c, b in moji.TO_BYTE[encoding].items()}
    bad = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    new, n, stuck = moji.restore(bad)
    assert new == text and n >= 4 and stuck == 0


def test_twice_garbled():
    bad = "worth £5".encode().decode("cp1252").encode().decode("cp1252")
    assert moji.restore(bad)[0] == "worth £5"


def test_single_bytes_confused():
    assert moji.restore("Cafй Sociйtй, faзade, Ј4 million")[0] == "Café Société, façade, £4 million"
    assert moji.restore("CafÚ SociÚtÚ HoldingsÆ")[0] == "Café Société Holdings’"


def test_changed_case_and_lost_characters():
    assert moji.restore("THE DIRECTORSÂ€™ VIEW")[0] == "THE DIRECTORS’ VIEW"
    text, n, stuck = moji.restore("flat at �2.7m")
    assert (n, stuck) == (1, 1) and text == "flat at �2.7m"


def test_operator(spark):
    rows = [(1, "worth Â£4", "x"), (1, "worth Â£4", "x"), (2, None, None), (3, "", ""), (4, "plain", ""), (5, CLEAN[0], ""), (6, "a " * 60000 + "Ã©", "")]
    out = moji.restore_texts(spark.createDataFrame(rows, "doc_id bigint, text string, restored string")).collect()
    assert sorted((r.doc_id, r.restored[-5:]) for r in out) == [(1, "th £4"), (1, "th £4"), (6, " a a é"[-5:])]
    assert moji.restore_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
