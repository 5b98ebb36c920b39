"""Near-duplicate groups: large keys, many ids, and what the driver holds."""

import random
import tracemalloc

import numpy as np

from kgloom.llm import components, minhash_tensor, toxicity_chain

from .test_operators import brute_groups

DOCS = "doc_id long, text string"


def near(spark, rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_tensor.near_duplicates(spark.createDataFrame(rows, DOCS), k=4).collect()}


def test_large_group_is_not_multiplied(spark, monkeypatch):
    """Of a key's largest group no two members meet: it is sent once to each block of the others."""
    monkeypatch.setattr(minhash_tensor, "BLOCK", 16)
    kind = "key long, c long, g long, n long, bits array<long>"
    rows = minhash_tensor._met(spark.createDataFrame([(7, c, 0 if c < 160 else c, 9, [0]) for c in range(163)], kind)).collect()
    assert len([r for r in rows if r["g"] == 0]) == 160 and len(rows) <= 160 + 3 * 11
    cells = {}
    for r in rows:
        cells.setdefault((r["i"], r["j"]), set()).add(r["c"])
    meet = {(x, y) for v in cells.values() for x in v for y in v if y >= 160 and x != y}
    assert meet == {(x, y) for x in range(163) for y in range(160, 163) if x != y}


def test_pairs_of_a_loose_group_are_few(spark):
    """Of members that all pass the bounds, no more pairs are tried first than join their groups in two cells."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**60, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[5:], rng.integers(0, 2**60, 3).astype(np.uint64)])) for _ in range(50)]
    rows = [(7, c, c // 2, len(s), minhash_tensor.image(s).tolist()) for c, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, c long, g long, n long, bits array<long>")
    first = minhash_tensor._tested(members, 80, 100, nearest=True).collect()
    root = components.least_nodes(np.array([r["a"] // 2 for r in first]), np.array([r["b"] // 2 for r in first]))
    assert len(first) < 2 * 24 and root[0].tolist() == list(range(1, 25)) and not root[1].any()
    assert minhash_tensor._tested(members, 80, 100).count() == 50 * 49 // 2 - 25


def test_many_ids_by_bitmap(spark, monkeypatch):
    """With more ids than are sent, a bitmap finds their texts; what it lets through beside them does no harm."""
    rng, rows = random.Random(2), []
    for i in range(60):
        w = [f"b{i % 5}_{j}" for j in range(60)]
        if i % 3:
            w[rng.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"alone {i} a b c d") for i in range(40)]
    monkeypatch.setattr(minhash_tensor, "MAX_SENT", 0)
    for cells in (26, 6):
        monkeypatch.setattr(minhash_tensor, "CELLS", cells)
        assert near(spark, rows) == brute_groups(rows, 4, 80, 100)


def test_components_both_ways(spark):
    rng = random.Random(3)
    edges = [(a, a + rng.randrange(1, 4)) for a in range(0, 400, 2)] + [(5, 5), (1000, 900), (-7, 900)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for alone in (1 << 20, 0):
        assert {r["node"]: r["root"] for r in components.components(df, alone=alone).collect()} == {x: r for x, r in root.items() if x != r}
    assert components.components(df.limit(0)).count() == 0


def test_forest_goes_out_in_parts():
    import pyarrow as pa

    a = np.arange(1, 1001)
    batches = [pa.RecordBatch.from_arrays([pa.array(a[i : i + 100]), pa.array(a[i : i + 100] - 1)], names=["a", "b"]) for i in range(0, 1000, 100)]
    out = list(components._forest(50)(iter(batches)))
    got = components.least_nodes(*(np.concatenate([b.column(i).to_numpy() for b in out]) for i in (0, 1)))
    assert len(out) > 2 and got[0].tolist() == a.tolist() and not got[1].any()


def test_fit_holds_little():
    """The fit on the driver takes few bytes for each entry, whatever the rows."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 4000, 300)).astype(np.int32) for _ in range(4000)]
    y = (np.arange(4000) % 3 == 0).astype(float)
    tracemalloc.start()
    bias, words, _ = toxicity_chain.fit_linear(rows, np.zeros((4000, 0)), y, 4000, steps=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 28 * sum(map(len, rows)) and np.isfinite(words).all()
    # the sums of segments, whatever their bounds
    sizes = np.array([0, 3, 0, 5, 1, 0, 9, 0])
    at = rng.integers(0, 50, sizes.sum())
    values = rng.random(50)
    whole = [values[at[b - n : b]].sum() for n, b in zip(sizes, np.cumsum(sizes), strict=True)]
    for step in (1, 4, 100):
        assert np.allclose(toxicity_chain._Sums(at, sizes, step).of(values), whole)
    assert not toxicity_chain._Sums(at[:0], sizes * 0).of(values).any()


def test_images_bound_the_difference():
    """Images never differ in more bits than their sets in members, whatever the sign of a word."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        s, t = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        t = np.unique(np.concatenate([s[: n // 2], t]))
        a, b = minhash_tensor.image(s), minhash_tensor.image(t)
        assert minhash_tensor.unlike(a[None], b[None])[0] == sum(bin(int(x) & (2**64 - 1)).count("1") for x in a ^ b) <= len(np.setxor1d(s, t))
