"""Secrets by kind and look-alikes that are none, none of them drawn from the generator that the forest is fitted on."""

import hashlib
import random
import secrets
import string

import numpy as np
import pytest
from kgloom.llm import secret_forest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The river runs past the old mill and the children walk home from school along the narrow road while evening comes over the fields. "


def _rng():
    return random.Random(77)


def _kinds():
    """(kind, secret or not, text, token) by templates of their own."""
    rng = _rng()
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    out = []
    for i in range(40):
        word = rng.choice(PROSE.lower().rstrip(" .").split())
        yes = {
            "password": (f"db_password: {{}} # {word}", pick(alnum, rng.randint(9, 14)) + rng.choice(string.digits) + rng.choice("QRSTUV")),
            "hex key": ("api_key = '{}'", pick("0123456789abcdef", 40)),
            "base64 secret": ("aws secret access key {}", pick(alnum + "/+", 40)),
            "bot token": ("token={}", f"xoxb-{pick(string.digits, 12)}-{pick(string.digits, 13)}-{pick(alnum, 24)}"),
            "signed claims": ("Authorization: Bearer {}", f"eyJhbGciOiJIUzI1NiJ9.eyJ{pick(alnum, 40)}.{pick(alnum + '-_', 43)}"),
        }
        no = {
            "digest": (f"sha256 {{}} of {word}", hashlib.sha256(str(i).encode()).hexdigest()),
            "integrity": ("integrity {}", "sha512-" + pick(alnum + "/+", 86) + "=="),
            "identifier": ("primary key {} in the table", f"customer_order_{rng.choice(['line', 'main', 'page'])}_item_20{i:02d}_v2"),
            "path": ("see https://{}", f"example.com/{word}/index/page{i}.html"),
            "uuid": ("row id {}", f"{pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-4{pick('0123456789abcdef', 3)}-a{pick('0123456789abcdef', 3)}-{pick('0123456789abcdef', 12)}"),
            "camel case": (f"{word} {{}} {word}", f"{word.capitalize()}ServiceRequest{rng.choice(['Model', 'Table', 'Value'])}{i}"),
            "time": ("at {} it ended", f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}T10-{i:02d}-00Z"),
        }
        for label, group in ((True, yes), (False, no)):
            out += [(kind, label, PROSE + form.format(token) + " " + PROSE, token) for kind, (form, token) in group.items()]
    return out


@pytest.fixture(scope="module")
def scanned(spark):
    rows = _kinds()
    docs = spark.createDataFrame([(i, text, "en", "s", 1) for i, (_, _, text, _) in enumerate(rows)], DOCS).repartition(3)
    forest = secret_forest.fit_secrets(secret_forest.example_findings(), table=secret_forest.count_transitions(docs))
    hits = {(r["doc_id"], r["token"].strip("=")): r["secret"] for r in secret_forest.scan_secrets(docs, forest).collect()}
    found = {}
    for i, (kind, label, _, token) in enumerate(rows):
        of = [s for (d, t), s in hits.items() if d == i and (t in token or token in t)]
        found.setdefault((kind, label), []).append(any(of))
    return {k: float(np.mean(v)) for k, v in found.items()}


def test_recall_by_kind(scanned):
    rates = {k: v for (k, label), v in scanned.items() if label}
    assert all(v >= 0.8 for v in rates.values()) and np.mean(list(rates.values())) >= 0.9, rates


def test_precision_on_look_alikes(scanned):
    rates = {k: v for (k, label), v in scanned.items() if not label}
    assert all(v <= 0.25 for v in rates.values()) and np.mean(list(rates.values())) <= 0.1, rates


def test_transitions(spark):
    """Counts of all texts against a loop over their characters."""
    texts = ["abba 12", "", None, "Zebra-é", "b" * 3000]
    table = secret_forest.count_transitions(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(3))
    kind = lambda x: x - 97 if 97 <= x <= 122 else x - 65 if 65 <= x <= 90 else 26 if 48 <= x <= 57 else 27
    want = np.ones((28, 28))
    for t in texts:
        raw = (t or "").encode()
        for a, b in zip(raw, raw[1:], strict=False):
            want[kind(a), kind(b)] += 1
    assert np.allclose(table, np.log2(want / want.sum(1, keepdims=True)))
    assert np.allclose(secret_forest.count_transitions(spark.createDataFrame([], DOCS)), secret_forest.EVEN)


def test_short_and_plain_runs_are_no_candidates(spark):
    rows = [(1, f"password {secrets.token_hex(3)} abcdefghijklmnop 12345678901234567890", "en", "s", 1)]
    forest = secret_forest.fit_secrets(secret_forest.example_findings(200))
    assert secret_forest.scan_secrets(spark.createDataFrame(rows, DOCS), forest).filter(F.col("token").isNotNull()).count() == 0
