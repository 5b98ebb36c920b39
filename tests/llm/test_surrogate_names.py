"""Persons: collisions of surrogates as the text shows them, coreference within and across documents, country codes."""

import random
import re

import pytest
from kgloom.llm import surrogates

KIND = "doc_id long, text string"


def test_collisions_across_genders(spark):
    key = b"key"
    make = surrogates.Surrogates(key)
    letters = lambda n: n[0] + "".join(chr(97 + int(c)) for c in n[1:])
    men, pair = {}, None
    for i in range(40_000):
        name = letters(f"N{i}")
        new = make.canonical("surname", name)
        if new in men:
            pair = men[new], name
            break
        men[new] = name
    assert pair
    real = make.canonical("surname", "Rossi")
    texts = [f"Mr {pair[0]}", f"Ms {pair[1]}", "Mr Rossi", f"Ms {real}"]
    docs = spark.createDataFrame(list(enumerate(texts)), KIND)
    got = {r["doc_id"]: r["entities"][0]["surrogate"] for r in surrogates.replace_pii(docs, key).collect()}
    assert len(set(got.values())) == 4 and real not in got.values()
    with pytest.raises(RuntimeError):
        surrogates._redraws(docs, key, rounds=0)


def test_ssn_validity_and_no_original():
    make = surrogates.Surrogates(b"k")
    forms = [f"{a:03d}{b:02d}{c:04d}" for a in (1, 219, 665, 666, 899, 900) for b in (0, 7, 99) for c in (0, 1, 9999)]
    new = [make.canonical("ssn", f) for f in forms]
    assert len(set(new)) == len(forms) and all(surrogates.ssn_valid(x) == surrogates.ssn_valid(f) for x, f in zip(new, forms, strict=True))
    with pytest.raises(RuntimeError):
        make._walked("1234", "none", lambda x: False)


@pytest.mark.parametrize("sent", [surrogates.MAX_SENT, 0])
def test_coreference_against_pieces(spark, monkeypatch, sent):
    """Every piece of a name has one surrogate wherever it stands, and different people of all documents stay apart."""
    monkeypatch.setattr(surrogates, "MAX_SENT", sent)
    rng = random.Random(4)
    given = [f"Given{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(7)]  # more than there are first names to draw
    last = ["Smith", "Rossi", "Берков", "Νικολάου", "Kimura"]
    texts = []
    for i in range(120):
        g, s = rng.choice(given), rng.choice(last)
        texts.append((i, f"Here Mr {g} {s} spoke. Then Prof {s} left, {s} slept; {g} {s} and {g} woke, {g.upper()} {s.upper()} sang.", g, s))
    docs = spark.createDataFrame([x[:2] for x in texts], KIND)
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_pii(docs, b"key").collect()}
    people, surnames = {}, {}
    for i, _, g, s in texts:
        new = re.fullmatch(r"Here Mr (\w+) (\w+) spoke\. Then Prof (\w+) left, (\w+) slept; (\w+) (\w+) and (\w+) woke, (\w+) (\w+) sang\.", got[i]).groups()
        assert new[0] == new[4] == new[6] and new[7] == new[0].upper()
        assert new[1] == new[2] == new[3] == new[5] and new[8] == new[1].upper()
        assert surnames.setdefault(s, new[1]) == new[1] and people.setdefault((g, s), new[:2]) == new[:2]
        assert new[0] != g and new[1] != s and surrogates.script_of(new[1]) == surrogates.script_of(s)
    assert len(set(people.values())) == len(people) > 60 and len(set(surnames.values())) == len(surnames)


def test_shapes_of_names():
    make = surrogates.Surrogates(b"k")
    new = lambda t: make.replace(t)[0]
    a, b, c = re.fullmatch(r"Г-жа (\w+), Г-н (\w+), (\w+)", new("Г-жа Иванова, Г-н Иванов, Иванова")).groups()
    assert a == c == b + "а" and b != "Иванов"
    a, b = re.fullmatch(r"Mr (\w+) (\w+)", new("Mr 王伟 王伟")).groups()
    assert len(b) == 2 and b != "王伟" and surrogates.script_of(b) == surrogates.script_of("王")
    a, b, c = re.fullmatch(r"Ms \w+-\w+ (\w+)-(\w+), Mr (\w+)", new("Ms Anna-Maria Smith-Jones, Mr Jones")).groups()
    assert b == c != a
    a, b = re.fullmatch(r"Mr (\w+) Mr (\w+)", new("Mr Smith Mr Smith")).groups()
    assert a == b
    a, b = re.fullmatch(r"Dr (\w+) Kim, Mrs (\w+) Kim".replace("Kim", r"\w+"), new("Dr Alex Kim, Mrs Alex Kim")).groups()
    assert a == b and a in surrogates.FIRST["latin", "f"]
    a, b = re.fullmatch(r"Mr\. J\. (\w+) and (\w+)", new("Mr. J. O'Brien and O'Brien")).groups()
    assert a == b
    for odd in ("Smith went", "Mr", "Mr ", "Mr ²²", "Mr ⅧⅧ", "Mr Ⴀბ", "Dr Αβ Γδ", "Mr  Smith", "Mr Smith-", "Mr İİ"):
        make.replace(odd)
    assert new("Smith went") == "Smith went"


def test_phones_keep_their_country():
    make = surrogates.Surrogates(b"k")
    texts = ["+1 (389) 555-5010", "(389) 555-5010", "+13895555010", "+49 30 1234567", "030 123 4567", "+93 70 123 4567", "+44 20 7946 0958"]
    new = [make.replace(t)[0] for t in texts]
    digits = [re.sub(r"\D", "", x) for x in new]
    assert digits[0] == digits[2] == "1" + digits[1] and new[1][1] in "23456789"
    assert digits[3][:2] == "49" and digits[4][0] == "0" and digits[3][2:] == digits[4][1:]
    assert digits[5][:2] == "93" and digits[6][:2] == "44"
    assert all(a != b and re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in zip(texts, new, strict=True))
    forms = [f"{i:07d}" for i in range(1_000_000, 1_004_000)]
    assert len({make.canonical("phone", f) for f in forms}) == len(forms)


def test_long_text_of_many_names():
    people = [f"Mr Given{chr(97 + i % 26)} Name{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(600)]
    text = " said. ".join(people * 20)
    out, spans = surrogates.Surrogates(b"k").replace(text)
    assert len(spans) == 12_000 and not re.search("Given|Name", out)
