"""Manifest, prefix trie and phrase fingerprints against brute force, with every odd case they define."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kgloom.llm import merkle_range, phrase_parse, prefix_louds
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
CLASH = "g unit rank digest changed row idx level n m start shift peak kind a b path shard least ends head h first label part tie key fingerprint turn role text_".split()


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


def _h(text):
    return sha256(text.encode()).hexdigest()


def _clashing(df):
    return df.select("*", *(F.lit(1).alias(c) for c in CLASH if c not in df.columns))


# --- manifest --------------------------------------------------------------------------------------


def _leaf(row):
    doc, text, lang, source, n = row
    return _h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text)))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def _way(levels, i):
    out = []
    for nodes in levels[:-1]:
        b = i // 8 * 8
        out.append(("".join(nodes[b:i]), "".join(nodes[i + 1 : b + 8])))
        i //= 8
    return out


def brute_proofs(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for g in langs:
        by_lang[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = {g: _levels([_leaf(r) for r in by_lang[g]]) for g in langs}
    top = _levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(by_lang[g]):
            way = _way(trees[g], i) + _way(top, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            folded = _leaf((r[0], r[1].translate({i: i + 32 for i in range(65, 91)}), *r[2:])) if changed else _leaf(r)
            for a, b in way:
                folded = _h(a + folded + b)
            out.append((r[0], _leaf(r), trees[g][-1][0], top[-1][0], _h("".join(a + b for a, b in way)), folded, folded == top[-1][0]))
    return out


def _documents(n):
    rng = random.Random(n)
    rows = [(i * 3, f"Text {rng.random()} É{i}", rng.choice(["en"] * 6 + ["de", "fr", None, ""]), rng.choice(["web", None]), rng.choice([i, None])) for i in range(n)]
    rows += [rows[4], rows[4], (rows[7][0], "other", *rows[7][2:]), (None, None, None, None, None), (None, "", "en", "s", 1), (9001, "long " * 50_000, "es", "s", 1), (9002, "", "ßx", "s", 0)]
    return rows


@pytest.mark.parametrize("unit", [1, 5, 70, 1 << 14])
def test_manifest(spark, unit):
    rows = _documents(230)
    docs = _clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    got = merkle_range.document_proofs(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, unit).collect()
    assert _sorted(got) == _sorted(brute_proofs(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_manifest_sizes(spark, n):
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(n)]
    got = merkle_range.document_proofs(spark.createDataFrame(rows, DOCS), F.col("doc_id") % 2 == 0, 3).collect()
    assert len(got) == n and len({r["root"] for r in got}) == min(n, 1)
    assert all(r["verified"] == (r["doc_id"] % 2 == 1) for r in got)


def test_manifest_nodes(spark):
    """Every node of every level stands once in the manifest, whoever made it."""
    rows = [(i, "t", "en", "s", 1) for i in range(600)]
    leaves = merkle_range.document_leaves(spark.createDataFrame(rows, DOCS), F.lit(False))
    m = merkle_range.build_manifest(leaves, ["doc_id", "digest", "row"], 37)
    got = {(r["level"], r["idx"]): r["digest"] for r in m.nodes.collect()}
    levels = _levels([_leaf(r) for r in rows])
    assert m.nodes.count() == len(got) and got == {(k, i): d for k, nodes in enumerate(levels) if k for i, d in enumerate(nodes)}


# --- trie ------------------------------------------------------------------------------------------


def _rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", _h(text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    return out


def brute_trie(convs):
    nodes, kids = {}, {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for s in nodes:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    leaves, saved = {}, {}
    for s in sorted(nodes, key=len, reverse=True):
        own = kids.get(s, [])
        words = len([w for w in s[-1][1].replace("\n", " ").split(" ") if w]) if s else 0
        leaves[s] = sum(leaves[k] for k in own) if own else 1
        saved[s] = (len(nodes[s]) - 1) * words + sum(saved[k] for k in own)
    return [
        (min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), leaves[s], saved[s], _h(",".join(map(str, sorted(c for c in m if convs[c] == s)))))
        for s, m in nodes.items()
    ]


def _turns(n):
    rng = random.Random(n)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 6])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "c", "", None, "d  e\nf"])))
    rows += [rows[5], rows[5], (3, None, "system", "first of all"), (None, 0, "user", "nobody's"), (4, 2, None, None), (n + 1, 0, "user", "long " * 60_000)]
    # conversations whose head is absent and whose turns all go: they end at the root
    rows += [(c, 0, "user", "gone") for c in range(10_001, 10_020)]
    rows += [(20_000, t, "user", f"deep {t}") for t in range(300)] + [(20_003, t, "user", f"deep {t}") for t in range(250)]
    return rows


@pytest.mark.parametrize("shard", [1, 4, 1 << 14])
def test_trie(spark, shard):
    rows = _turns(160)
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    got = prefix_louds.conversation_trie(turns.select("*", *(F.lit(1).alias(c) for c in CLASH if c not in turns.columns)), shard).collect()
    want = brute_trie(_rebuilt(rows))
    assert any(not s for s in _rebuilt(rows).values()) and _sorted(got) == _sorted(want)


def test_trie_of_one_sequence(spark):
    """Only copies, more than a shard has rows; and no row at all."""
    turns = spark.createDataFrame([(c, t, "user", f"w{t}") for c in range(0, 2000, 20) for t in range(3)], TURNS)
    got = prefix_louds.conversation_trie(turns, 4).collect()
    assert sorted((r["depth"], r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in got) == [(0, 100, 1, 297), (1, 100, 1, 297), (2, 100, 1, 198), (3, 100, 1, 99)]
    assert prefix_louds.conversation_trie(turns.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=6), min_size=1, max_size=30))
def test_louds(paths):
    """Parents, children and depths read from the bits are those of the paths."""
    label = [bytes(16) + k.to_bytes(8, "big") for k in range(4)]
    rows = sorted({b"".join(label[k] for k in p) for p in paths})
    n = np.arange(1, len(rows) + 1)
    t = prefix_louds.Louds(prefix_louds.build_louds(rows, n, n * 10, [sha256(r).digest() for r in rows], None, None))
    nodes = {r[:i] for r in rows for i in range(0, len(r) + 1, 24)}
    assert t.count == len(nodes) and t.children.sum() == t.count - 1 and [b - a for a, b in t.levels] == [sum(len(x) == 24 * d for x in nodes) for d in range(len(t.levels))]
    for r, k in zip(rows, n.tolist(), strict=True):
        at = 0
        for i in range(0, len(r), 24):
            down = t.child(at, r[i : i + 24])
            assert t.parent[down - 1] == at
            at = down
        i = t.end_node.tolist().index(at)
        assert (t.end_n[i], t.end_least[i], t.end_hash[i].tobytes()) == (k, 10 * k, sha256(r).digest())
        assert t.child(at, bytes(24)[:-1] + b"\x09") is None


# --- fingerprints ----------------------------------------------------------------------------------

MASK = (1 << 64) - 1
FACTOR = [int(x) | 1 for x in phrase_parse.counter_hash(0x9A5E, 64)]
BYTE = [int(x) for x in phrase_parse._BYTE]
RUN, SIZE = int(phrase_parse._RUN), int(phrase_parse._SIZE)


def _mix(x):
    x &= MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def _toss(labels):
    out = []
    for i, x in enumerate(labels):
        differ = x ^ labels[i - 1] if i else 1
        place = (differ & -differ).bit_length() - 1 if differ else 0
        out.append(2 * place + (x >> place & 1))
    return out


def brute_parse(text):
    """Names of all phrases by level, one symbol at a time, and the whole text's name."""
    symbols, level, found = list(text.encode()), 0, []
    if not symbols:
        return 0, []
    while level == 0 or len(symbols) > 1:
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        base = [s for s, _ in runs]
        named = [(BYTE[s] if not level else s) if k == 1 else _mix((BYTE[s] if not level else s) + k * RUN) for s, k in runs]
        label = base
        for _ in range(4):
            label = _toss(label)
        begin = [0] + [i for i in range(2, len(base) - 1) if label[i - 1] < label[i] > label[i + 1]]
        symbols = []
        for a, b in zip(begin, [*begin[1:], len(base)], strict=True):
            symbols.append(_mix(sum(x * FACTOR[j] for j, x in enumerate(named[a:b])) + (b - a) * SIZE))
        level += 1
        if level >= phrase_parse.LEAST or len(symbols) == 1:
            found += symbols
    return symbols[0], found


def brute_fingerprint(text):
    root, names = brute_parse(text)
    least = [None] * phrase_parse.BINS
    for x in names:
        k, v = x % phrase_parse.BINS, x >> 7
        least[k] = v if least[k] is None else min(least[k], v)
    return f"{root:016x}" + "".join("00" if v is None else f"{1 + _mix(v) % 255:02x}" for v in least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abä\x00 ", max_size=60), min_size=1, max_size=6))
def test_fingerprint_of_any_text(texts):
    got = phrase_parse.fingerprints(pa.array(texts, pa.string()))
    assert [x.tobytes().hex() for x in got] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("tasks", [None, 1, 5, 40])
def test_fingerprints(spark, tasks):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}é" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60))), "en", "s", 1) for i in range(50)]
    rows += [(77, None, "en", "s", 1), (78, "", "en", "s", 1), (79, "z", None, None, None), (80, "aaaa" * 9000, "en", "s", 1), (81, rows[3][1], "en", "s", 1), (None, "no id here", "en", "s", 1)]
    docs = _clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    got = {r["doc_id"]: r for r in phrase_parse.phrase_fingerprints(docs, tasks).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    assert len(got) == len(rows)
    for i, (doc, text, *_) in enumerate(order):
        text, after, r = text or "", order[(i + 1) % len(order)][1] or "", got[doc]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), _h(edited))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (brute_fingerprint(text), brute_fingerprint(edited))
        assert 0 <= r["near_next"] <= 1 and (text != edited or r["near_edited"] == 1)
    assert got[3]["fingerprint"] == got[81]["fingerprint"] and phrase_parse.phrase_fingerprints(docs.limit(0)).count() == 0


def test_fingerprints_of_equal_ids_and_one(spark):
    rows = [(5, f"text number {i % 3}", "en", "s", 1) for i in range(9)]
    got = phrase_parse.phrase_fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 9 and len({r["fingerprint"] for r in got}) == 3
    (one,) = phrase_parse.phrase_fingerprints(spark.createDataFrame(rows[:1], DOCS)).collect()
    text, half = rows[0][1], len(rows[0][1]) // 2
    assert one["near_next"] == 1 and one["edited_sha256"] == _h(text[: len(text) - half] + text[:half])


def test_likeness_follows_similarity():
    """Wherever a shared passage stands, its phrases are the same: likeness estimates the share of common phrases."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        common = text(int(6000 * share))
        a, b = (text(rng.randrange(1, 40)) + common + text(6000 - len(common)) for _ in range(2))
        x, y = phrase_parse.fingerprints(pa.array([a, b]))
        p, q = (set(brute_parse(t)[1]) for t in (a, b))
        exact = len(p & q) / len(p | q)
        assert abs(phrase_parse.likeness(x[None], y[None])[0] - exact) < 0.16 and abs(exact - share / (2 - share)) < 0.05
