"""Rounds of pair replacement: exact numbers of pairs, round trip and no frequent pair at the end."""

import numpy as np
import pytest

from kgloom.llm.repair_tokens import Shard, numbered, pack, repair


@pytest.mark.parametrize("wide", [5, 17, 31, 32])
def test_numbered_is_unique(wide):
    rng = np.random.default_rng(wide)
    a, b = rng.integers(0, 1 << wide, (2, 5000)).astype(np.uint64)
    pick = rng.integers(0, 700, 5000)
    keys = (a[pick] << np.uint64(32)) | b[pick]
    found, name = numbered(keys, wide)
    expect = np.unique(keys, return_inverse=True)
    assert np.array_equal(found, expect[0]) and np.array_equal(name, expect[1])


def _occurrences(symbols):
    """Non-overlapping occurrences of each pair, from left to right, by plain loops."""
    count, last = {}, {}
    for i in range(len(symbols) - 1):
        pair = (symbols[i], symbols[i + 1])
        if last.get(pair) == i - 1 and pair[0] == pair[1]:
            continue
        last[pair] = i
        count[pair] = count.get(pair, 0) + 1
    return count


@pytest.mark.parametrize("seed", range(40))
def test_no_frequent_pair_is_left(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 400))).astype(np.uint32)
    if seed % 3 == 0:
        ids = np.repeat(ids, rng.integers(1, 9, len(ids)))
    _, _, symbols = repair(ids, 10, 4)
    assert max(_occurrences(symbols.tolist()).values(), default=0) < 4
    assert np.array_equal(Shard(pack(ids, np.array([0, len(ids)]), 10)).ids(), ids)
