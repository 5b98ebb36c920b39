"""Each operator against a brute-force version, and the cases its docstring defines."""

import hashlib
import inspect
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from kgloom.llm import bytewords, fm_quality, minhash_tensor, mix_flow, repair_tokens, secret_forest, substring_chains, surrogates, toxicity_chain, winnow
from kgloom.llm.components import components
from kgloom.llm.exact_dedup import exact_dedup
from kgloom.llm.shared import stored
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").translate(LOW))


def sample(seed=0, n=60):
    """Documents with exact and near copies, a shared passage, empty, null, long and non-ASCII texts."""
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "of", "été", "Straße", "a", "x1", "ñ"] + [f"w{i}" for i in range(400)]
    make = lambda k: " ".join(rng.choice(vocabulary, k))
    base, passage = make(80), make(60)
    texts = [make(int(rng.integers(1, 200))) for _ in range(n)]
    for i in range(0, n, 6):
        w = base.split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, len(w)))] = f"e{int(rng.integers(0, 99))}"
        texts[i] = " ".join(w)
    for i in range(1, n, 7):
        texts[i] = f"{make(20)} {passage}. {make(10)}"
    texts += [texts[3], texts[3].upper(), "", None, "   \n", "One", "one", make(6000), "two words", base]
    return [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 4}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return stored(spark.createDataFrame(rows, DOCS).repartition(3), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- words and hashes ---


def test_words(rows):
    column = pa.array([t for _, t, *_ in rows])
    for table, pattern in ((bytewords.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (bytewords.NON_SPACE, r"[^\x20\x09-\x0D]+")):
        h, at = bytewords.word_hashes(column, table)
        seen = {}
        for i, (_, t, *_) in enumerate(rows):
            w = words_of(t, pattern)
            assert at[i + 1] - at[i] == len(w)
            for x, y in zip(w, h[at[i] : at[i + 1]].tolist(), strict=True):
                assert seen.setdefault(x, y) == y
        assert len(set(seen.values())) == len(seen)


# --- token output ---


def test_tokens(spark, docs, rows, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    extra = [(1000, "l'homme d'été ici   là don't\n\n x\ty  z <b>1,000</b> ça", "fr", "s", 1), (1000, "A", "fr", "s", 1)]
    both = docs.unionByName(spark.createDataFrame(extra, DOCS))
    got = sorted(repair_tokens.token_output(both, path).collect(), key=lambda r: r["start"])
    start, want = 0, []
    for d, x, *_ in sorted([*rows, *extra], key=lambda r: (r[0], r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r)[:4] for r in got] == want
    assert repair_tokens.token_output(none, path).count() == 0


def test_grammar():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 20, 20_000), np.zeros(5000, int), np.zeros(0, int), np.arange(10), np.tile([1, 2, 3, 1, 2], 900)):
        ids = ids.astype(np.uint32)
        bounds = np.array([0, len(ids) // 3, len(ids)])
        shard = repair_tokens.Shard(repair_tokens.pack(ids, bounds, 100))
        assert (shard.ids() == ids).all() and (shard.document(1) == ids[bounds[1] :]).all()
        for a, b in ((0, 1), (7, 4000), (len(ids) - 3, len(ids))):
            assert (shard.ids(max(0, a), b) == ids[max(0, a) : b]).all()
    with pytest.raises(ValueError):
        repair_tokens.Shard(b"nope" + bytes(60))


# --- mixing ---


def test_targets():
    assert mix_flow.capped_targets([100, 100], [1, 1], 1.0, 2) == [100, 100]
    assert mix_flow.capped_targets([10, 100], [5, 1], 1.5, 2) == [20, 145]
    assert mix_flow.capped_targets([0, 0], [5, 1], 1.5, 2) == [0, 0]


def test_flow():
    # an overlapping pattern serves the source that has nothing else; second copies only when first ones are used up
    flow = mix_flow.min_cost_flow([10, 10], [[0], [0, 1]], {0: 15, 1: 5}, 2)
    assert sum(n for f in flow for (s, _), n in f.items() if s == 1) == 5
    assert sum(n for f in flow for (s, _), n in f.items() if s == 0) == 15
    assert all(r == 1 for f in flow for _, r in f)
    assert sum(sum(f.values()) for f in mix_flow.min_cost_flow([10], [[0]], {0: 50}, 2)) == 20


def test_mix(spark, docs, rows, none):
    got = mix_flow.mix_sources(docs, F.array("source")).collect()
    size = {d: len(words_of(t, r"[^\x20\x09-\x0D]+")) for d, t, *_ in rows}
    assert {r["doc_id"]: r["size"] for r in got} == size
    of = {d: s for d, _, _, s, _ in rows}
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
        target[of[r["doc_id"]]] = r["target"]
    most = max(size.values())
    assert all(abs(taken[s] - target[s]) <= most for s in target)
    assert sorted(map(str, got)) == sorted(map(str, mix_flow.mix_sources(docs.repartition(5), F.array("source")).collect()))
    copies = Counter(r["doc_id"] for r in mix_flow.mixed(docs, F.array("source")).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    assert mix_flow.mix_sources(none, F.array("source")).count() == 0 and mix_flow.mixed(none, F.array("source")).count() == 0


# --- exact dedup ---


def test_exact(spark, docs, rows, none):
    norm = {d: (t or "").translate(LOW) for d, t, *_ in rows}
    last, many = {}, Counter(norm.values())
    for d, t in norm.items():
        last[t] = max(d, last.get(t, d))
    want = sorted((d, last[t], many[t], last[t] == d, hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items())
    for settings in ({}, {"bits_per_row": 1}, {"max_filter_bits": 64}):
        assert sorted(map(tuple, exact_dedup(docs, **settings).collect())) == want
    assert exact_dedup(none).count() == 0
    odd = spark.createDataFrame([(1, "a", "x"), (1, "A", "x"), (None, "a", "x"), (None, "b", "x")], "doc_id long, text string, kept string")
    got = exact_dedup(odd).collect()
    assert sum(r["kept"] for r in got if r["group_size"] == 3) == 1 and {r["keep_id"] for r in got if r["group_size"] == 3} == {1}


# --- near duplicates ---


def brute_groups(rows, k, num, den):
    sets = {}
    for d, t, *_ in rows:
        w = words_of(t, r"[^\x20\x09-\x0D]+")
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near(spark, docs, rows, none):
    for k in (4, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_tensor.near_duplicates(docs, k=k).collect()}
        assert got == brute_groups(rows, k, 80, 100)
    kept = minhash_tensor.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in brute_groups(rows, 5, 80, 100).items() if d == c)
    assert kept.columns == docs.columns
    assert minhash_tensor.near_duplicates(none).count() == 0 and minhash_tensor.drop_near_duplicates(none).count() == 0
    twice = spark.createDataFrame([(1, "p q r s t u", "en", "s", 1), (1, "p q r s t u", "en", "s", 1), (None, "p q r s t u", "en", "s", 1)], DOCS)
    assert minhash_tensor.drop_near_duplicates(twice).count() == 1


def test_bound():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**60, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(rng.integers(0, 300))], rng.integers(0, 2**60, 100).astype(np.uint64)]))
        differ = len(np.setxor1d(a, b))
        x, y = (minhash_tensor.image(s).view(np.uint64) for s in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y).tolist()) <= differ


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 99), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100: 99, 101: 99}


# --- decontamination ---

ITEMS = "item_id long, text string"


def brute_leaks(rows, items):
    out = {}
    for d, t, *_ in rows:
        w = words_of(t)
        hit, names = set(), set()
        for i, x in items:
            v = words_of(x)
            n = min(10, len(v))
            windows = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for p in range(len(w) - n + 1) if windows else ():
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    names.add(str(i))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def test_leaks(spark, docs, rows, none):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 40]
    items = [(i, " ".join(t.split()[5 : 5 + n])) for i, (t, n) in enumerate(zip(texts, (9, 10, 11, 15, 30, 3, 1, 20), strict=False))]
    items += [(50, ""), (51, None), (52, "not in any of them at all really no way ever"), (53, items[3][1]), (54, "the of " * 9)]
    table = spark.createDataFrame(items, ITEMS)
    want = brute_leaks(rows, items)
    got = {r["doc_id"]: tuple(r)[1:6] for r in winnow.decontaminate(docs, table).collect()}
    assert got == want
    clean = sorted(r["doc_id"] for r in winnow.drop_contaminated(docs, table).collect())
    assert clean == sorted(d for d, v in want.items() if not v[4])
    parts = winnow.find_spans(docs, table, max_item_words=8)  # a pass for each few items
    assert {r["doc_id"]: len(r["items"]) for r in parts.collect()} == {d: v[2] for d, v in want.items()}
    assert winnow.decontaminate(none, table).count() == 0
    assert not any(r["contaminated"] for r in winnow.decontaminate(docs, spark.createDataFrame([], ITEMS)).collect())


# --- passages ---


def test_passages(spark, docs, rows, none):
    n, at = 51, defaultdict(set)
    for d, t, *_ in rows:
        w = words_of(t)
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].add(d)
    links = {(d, min(g)) for g in at.values() if len(g) > 1 for d in g if d != min(g)}
    got = substring_chains.shared_passages(docs).collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in got:
        a, b = find(r["doc_id"]), find(r["other_id"])
        root[max(a, b)] = min(a, b)
    assert links and all(find(a) == find(b) for a, b in links)
    assert all(r["identity"] >= 0.8 and r["end"] - r["start"] >= 50 for r in got)
    assert substring_chains.shared_passages(none).count() == 0


def test_fenwick_and_chain():
    rng = np.random.default_rng(5)
    tree, plain = substring_chains.FenwickMax(50), [float("-inf")] * 50
    for i in range(300):
        p, v = int(rng.integers(0, 50)), float(rng.random())
        tree.put(p, v, i)
        plain[p] = max(plain[p], v)
        q = int(rng.integers(0, 51))
        assert tree.get(q)[0] == max(plain[:q], default=float("-inf"))
    # a near predecessor serves where the best one is too far off
    assert substring_chains.chain(*(np.array(v) for v in ((0, 300, 340), (0, 500, 540), (200, 20, 20))), 0.1, 60) == [[0], [1, 2]]
    x, y, n = (np.array(v) for v in ((0, 12, 30, 200), (5, 18, 2, 205), (8, 8, 8, 8)))
    assert substring_chains.chain(x, y, n, 0.1, 60)[0] == [0, 1]


# --- quality, toxicity ---


def labelled(spark, n=300):
    rng = np.random.default_rng(7)
    out, labels = [], []
    for i in range(n):
        w = list(rng.choice([f"w{j}" for j in range(200)], 60))
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            w = [x + "###" for x in w]
        if toxic:
            w[3], w[20] = ["grob", "fies", "gemeinlich"][i % 3], "fies"
        out.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(out, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, none):
    docs, labels = labelled(spark)
    model = fm_quality.fit_quality(docs, labels, usable=F.col("doc_id") % 3 != 1)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in fm_quality.score_quality(docs, model).collect() if r["doc_id"] % 3 == 1]
    assert np.mean(held) > 0.95
    odd = spark.createDataFrame([(1, None, "x", "y", 0), (1, "", "x", "y", 0), (2, "a " * 50_000, "x", "y", 0)], DOCS)
    assert all(0 <= r["score"] <= 1 for r in fm_quality.score_quality(odd, model).collect())
    assert fm_quality.score_quality(none, model).count() == 0
    assert {r["score"] for r in fm_quality.score_quality(docs, fm_quality.fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert {r["score"] for r in fm_quality.score_quality(docs, fm_quality.fit_quality(docs, labels.filter("quality = 1"))).collect()} == {1.0}


def test_interactions():
    # the linear-time form equals the sum over pairs
    rng = np.random.default_rng(2)
    fm = fm_quality.FactorisationMachine(0.3, rng.random(fm_quality.N_COLUMNS).astype(np.float32), rng.random((fm_quality.N_COLUMNS, 4)).astype(np.float32), np.zeros(13), np.ones(13))
    c, x = np.array([3, 9, 70, 5]), np.array([0.5, 1.0, -2.0, 0.25])
    pairs = sum(float(fm.v[c[i]] @ fm.v[c[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert abs(fm.raw(c, x, np.array([0, 4]))[0][0] - (0.3 + float(fm.w[c] @ x) + pairs)) < 1e-4


def test_toxicity(spark, none):
    docs, labels = labelled(spark)
    chain = toxicity_chain.fit_chain(docs, labels, ("quality", "toxic"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity_chain.score_chain(docs, chain).collect()
    assert np.mean([(r["p_toxic"] >= 0.5) == bool(truth[r["doc_id"]]) for r in got]) > 0.98
    kept = toxicity_chain.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and abs(kept.count() - sum(not v for v in truth.values())) <= 5
    odd = spark.createDataFrame([(1, None, "x", "y", 0), (1, "", "x", "y", 0)], DOCS)
    assert toxicity_chain.drop_toxic(odd, chain).count() == 2 and toxicity_chain.drop_toxic(none, chain).count() == 0
    bare = toxicity_chain.fit_chain(docs, labels.limit(0), ("toxic",))
    assert toxicity_chain.drop_toxic(docs, bare).count() == docs.count()


def test_toxicity_bounds(spark):
    """Markers ranked after the first 1,000 words and stems are in the model."""
    assert inspect.signature(toxicity_chain.fit_chain).parameters["max_rows"].default == 16_000
    marks = [f"q{chr(97 + i // 15)}{chr(97 + i % 15)}z" for i in range(220)]
    texts = [(f"{m} c{i % 7}", 1) for m in marks for i in range(6)] + [(f"c{i % 7} c{i % 5}", 0) for i in range(2000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, (t, _) in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    chain = toxicity_chain.fit_chain(docs, labels, ("toxic",))
    assert len(chain.words) >= 6 * len(marks)
    assert {r["doc_id"] for r in toxicity_chain.score_chain(docs, chain).filter("p_toxic >= 0.5").collect()} == set(range(6 * len(marks)))


# --- personal data, secrets ---


def test_surrogates(spark, none):
    texts = ["Mail JO.81@mail4.example.com or jo.81@mail4.example.com, call +1 (389) 555-5010 or +13895555010.", "Ip 10.0.0.255 card 4111 1111 1111 1111 and 4111111111111111", "Mr. Paul Smith met Frau Anna Berg. Г-н Иванов", "plain 12 words", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in surrogates.replace_pii(docs, b"key").collect()}
    assert [got[i]["n_entities"] for i in range(6)] == [4, 3, 3, 0, 0, 0]
    assert got[3]["text"] == "plain 12 words" and got[4]["text"] == "" and got[5]["text"] is None
    mail = [e["surrogate"].lower() for e in got[0]["entities"] if e["kind"] == "email"]
    assert mail[0] == mail[1] != "jo.81@mail4.example.com"
    cards = ["".join(c for c in e["surrogate"] if c.isdigit()) for e in got[1]["entities"] if e["kind"] == "card"]
    assert cards[0] == cards[1] and surrogates.luhn(cards[0])
    paul = next(e["surrogate"] for e in got[2]["entities"])
    assert paul.split()[0] in surrogates.FIRST["latin", "m"]
    assert got[2]["entities"][2]["surrogate"][0] >= "А"
    assert surrogates.replace_pii(none, b"key").count() == 0
    s = surrogates.Surrogates(b"k")
    for n in range(1, 5):
        assert len({s.permute(str(i).zfill(n), "x") for i in range(10**n)}) == 10**n


def test_collisions(spark):
    many = [(i, f"Mr. Name{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}", "en", "s", 1) for i in range(1500)]
    got = surrogates.replace_pii(spark.createDataFrame(many, DOCS), b"key").collect()
    assert len({r["text"] for r in got}) == len(many)


def test_secrets(spark, none):
    forest = secret_forest.fit_secrets(secret_forest.example_findings())
    held = secret_forest.example_findings(400, seed=99)
    x = np.array([secret_forest.features(t, b, a) for b, t, a, _ in held])
    assert np.mean((forest.score(x) >= 0.5) == np.array([y for *_, y in held])) > 0.95
    docs = spark.createDataFrame([(1, 'été token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "en", "s", 1), (2, "see /usr/lib/data/config/file/index1.html ok", "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1)], DOCS)
    got = {r["doc_id"]: r for r in secret_forest.scan_secrets(docs, forest).collect()}
    assert got[1]["secret"] and not (2 in got and got[2]["secret"]) and set(got) <= {1, 2}
    assert docs.filter("doc_id = 1").first()["text"].encode()[got[1]["start"] : got[1]["end"]].decode() == got[1]["token"]
    assert secret_forest.scan_secrets(none, forest).count() == 0
    assert secret_forest.fit_secrets([]).score(np.zeros((2, len(secret_forest.FEATURES)))).tolist() == [0.5, 0.5]
