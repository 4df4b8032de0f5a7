import random
import re

import pytest

from ledgerloom.llm import pii

GIVEN = "Anita Felix Walter Maria Chloe Hugo Irene Jonas Kavita Leela Martin Nora Omar Paula Rahul Sanjay Teresa Vikram Yuki Ivan".split()
SURNAMES = "Pashvani Raobhar D'Ormelle Quistorp Haldersby Umarbek Yeldham-Rooke Zanetorre Thackwell Lindqmoor Vandermoor Marchettane Okunwarre Silvestran Murthekar Petrovane".split()
MAKERS = "Ceramics Foods Logistics Energy Optics Paper Software".split()
FIRMS = [f"{a} {b}" for a in ("Kestholm", "Norley", "Ardmoor", "Vasford") for b in ("Helvor", "Ostrin", "Quadrel")]


def corpus(n=1500, seed=4):
    dice = random.Random(seed)
    out = []
    for k in range(n):
        g, s, other = dice.choice(GIVEN), dice.choice(SURNAMES), dice.choice(GIVEN)
        mail = f"{g}.{re.sub('[^a-z]', '', s.lower())}@example.org".lower()
        phone = f"+1 {dice.randint(200, 999)} 555 0{dice.randint(100, 199)}"
        out.append(
            dice.choice(
                [
                    f"My name is {g} {s} and my email is {mail}. Call {phone}.",
                    f"Signed by {g} {s}, residing at {dice.randint(10, 4000)} South Brindle Drive, Neelampur, TX 6{dice.randint(1000, 9999)}.",
                    f"Regards,\n{g} {s}\n{phone}",
                    f"Ms. {g} {s} and Mr. {other} {dice.choice(SURNAMES)} abstained.",
                    f"for the account of {g} {s} (SSN 9{dice.randint(10, 99)}-{dice.randint(10, 99)}-{dice.randint(1000, 9999)})",
                    f"ask {g.lower()} {s.lower()} ({mail}) or call 6{dice.randint(1000, 9999)} {dice.randint(10000, 99999)}",
                    f"so I wrote to {g} {s} about the dividend",
                    f"The {g} {other} {dice.choice(MAKERS)} label was relaunched.",
                    f"{g} Hill depot moved {dice.randint(200, 999)} {dice.randint(200, 999)} {dice.randint(1000, 9999)} units.",
                    f"The board of {dice.choice(FIRMS)} {dice.choice(MAKERS)} met {dice.randint(2, 90)} times during fiscal 20{dice.randint(10, 26)}.",
                    f"Net debt of {dice.choice(FIRMS)} {dice.choice(MAKERS)} rose to $8{dice.randint(1, 9)}.44 million in FY2020; the board called it late.",
                    f"Units outstanding: {dice.randint(10**11, 10**12)}. The report was late, the committee met and the file is open.",
                    f"did the dividend of {dice.randint(1, 90)} rise after the board met and who asked for it? the file was sent and answered later",
                ]
            )
        )
    return out


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(spark.createDataFrame([(t,) for t in corpus()], "text string"))


@pytest.fixture(scope="module")
def kinds(model):
    return lambda text, **more: sorted({pii.LABELS[lab] for _, _, lab in pii.decode([text], model, **more)[0]})


@pytest.fixture(scope="module")
def named(model):
    def found(text, **more):
        return [text[a:b] for a, b, lab in pii.decode([text], model, **more)[0] if lab == pii.NAME]

    return found


def test_kinds(kinds):
    assert kinds("Dr. Felix Raobhar here again") == ["NAME"]
    assert kinds("i'm walter d'ormelle, call 60000 00062") == ["NAME", "PHONE"]
    assert kinds("mail felix-raobhar@example.org please") == ["EMAIL"]
    assert kinds("teresa99 at quillpost dot example") == ["EMAIL"]
    assert kinds("sent to felix.x+filings @ mailbox.example. Then") == ["EMAIL"] and kinds("Sold 490 lots @ 66.24 each") == []
    assert kinds("we live at H.No. 149/32, 11th Cross, Tannery Nagar, Suryanagar - 431999") == ["ADDRESS"]
    assert kinds("SSN 988-47-8364 on file") == ["ID"]


def test_what_is_no_case(kinds):
    for text in ("The Anita Felix Ceramics label was relaunched.", "Units outstanding: 400828470994.", "Total of 4,903,912,997 against 971-818 last time.", "Anita Hill depot moved 597 549 2809 units.", "Build 10.17.49 at 21:46, ratio 555:17.", "Revenue was $82.44 million in FY2020", ""):
        assert kinds(text) == [], text


def test_names_that_were_never_seen(named):
    assert any("Greta Gonzalez" in n for n in named("I met Greta Gonzalez yesterday"))
    assert any("Gonzalez" in n for n in named("Sincerely, Greta Gonzalez"))
    assert any("Adeyemi" in n for n in named("Mr. Adeyemi called"))
    assert any("Chen" in n for n in named("Our colleague Chen Wei"))


def test_skip_edges_decide_lone_mentions(kinds, named, model):
    """Mentions that stand alone are names because the full name stands elsewhere in the text."""
    texts = [
        "Mr. Adeyemi Okoro called about the dividend. The report of the board and the Okoro file was late.",
        "We met Priya Natarajan about the file. The board asked natarajan for the report.",
        "I met Greta Gonzalez yesterday and the board asked gonzalez for the file.",
    ]
    with_edges, without = [named(t) for t in texts], [named(t, skips=False) for t in texts]
    changed = [k for k in range(len(texts)) if with_edges[k] != without[k]]
    assert changed and all(len(with_edges[k]) > len(without[k]) for k in changed)
    assert sum(len(a) >= 2 for a in with_edges) >= 2


def test_potentials_matter(model, named):
    """The decision is the field's: without its learnt weights no name is found."""
    flat = pii.Model(model.lexicon, pii.prior(), model.transitions * 0, model.skip * 0)
    assert pii.decode(["Ms. Nora Umarbek abstained."], flat)[0] == [] and named("Ms. Nora Umarbek abstained.") == ["Nora Umarbek"]


def test_held_out_texts(named, kinds):
    """Texts of other forms than those learnt from: recall and precision of names."""
    dice, right, given, due = random.Random(9), 0, 0, 0
    for k in range(200):
        name = f"{dice.choice(GIVEN)} {dice.choice(SURNAMES)}"
        text, holds = dice.choice([(f"is {name} still the person to ask?", 1), (f"it was {name} who sent me the file", 1), (f"Does {dice.choice(FIRMS)} {dice.choice(MAKERS)} mention the dividend?", 0)])
        found = "NAME" in kinds(text)
        right, given, due = right + (found and holds), given + found, due + holds
    assert right >= 0.95 * due and right >= 0.95 * given


def test_check_digits(kinds):
    assert pii.luhn("4000002106636911") and not pii.luhn("4000002106636912")
    assert pii.verhoeff("2363") and not pii.verhoeff("2364")
    good = next(f"99998486675{d}" for d in range(10) if pii.verhoeff(f"99998486675{d}"))
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    assert kinds(f"My Aadhaar {good}, please") == ["ID"] and "ID" not in kinds(f"My Aadhaar {bad}, please")


def test_the_rest_stays(model):
    text = "Regards,\nAnita Pashvani\n+91-60000-00207 Is the dividend of 23 confirmed?"
    new = pii.replaced(text, pii.decode([text], model)[0])
    assert "[NAME]" in new and "[PHONE]" in new and new.endswith("Is the dividend of 23 confirmed?") and new.startswith("Regards,\n")


def test_repeated_names_pull_each_other():
    edges = pii.skip_edges(["raobhar", "said", "that", "raobhar", "raobhar"])
    assert edges == [(0, 3), (3, 4)]
    assert pii.skip_edges(["Haldersby", "saw", "Haldersby's", "haldersbi", "of", "of"]) == [(0, 2), (2, 3)]


def test_beliefs_against_all_labelings():
    """Exact on a chain; every labelling of a short text summed up."""
    import itertools

    import numpy as np

    dice = np.random.default_rng(3)
    node, trans = dice.normal(size=(4, 6)), dice.normal(size=(6, 6))
    total, want = 0.0, np.zeros((4, 6))
    for y in itertools.product(range(6), repeat=4):
        p = np.exp(sum(node[k, y[k]] for k in range(4)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += p
        for k in range(4):
            want[k, y[k]] += p
    got, _ = pii.chains(np.concatenate([node, np.zeros((2, 6))])[None], np.array([4]), np.exp(trans))
    assert np.allclose(got[0, :4], want / total)


def test_operator(spark, model):
    rows = [("a", "x", t) for t in corpus(200)] + [("b", "n", None), ("b", "e", ""), ("b", "l", "word " * 30000), ("b", "r", "Write to felix21@example.org"), ("b", "r", "Write to felix21@example.org")]
    df = spark.createDataFrame(rows, "src string, rec_id string, text string").withColumn("entities", pii.F.lit("clash"))
    out = [r for r in pii.redact(df, ["src", "rec_id"]).collect() if r.src == "b"]
    by = {r.rec_id: (r.text, r.entities) for r in out}
    assert len(out) == 5 and by["n"] == (None, []) and by["e"] == ("", []) and by["l"][1] == [] and by["r"] == ("Write to [EMAIL]", ["EMAIL"])
    assert pii.redact(df.limit(0), ["src", "rec_id"]).count() == 0
    assert not re.search("felix21", by["r"][0])
    assert pii.redact(df.where("src = 'b'"), ["src", "rec_id"], model=model).count() == 5
