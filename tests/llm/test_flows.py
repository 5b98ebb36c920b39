"""Overlapping source mixes against every flow there is, and token output of tables with clashing columns."""

import itertools
import random

import pytest
from kgloom.llm import mix_flow, repair_tokens
from kgloom.llm.queries import TOKENIZER, tokenizer_path
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def every_flow(capacity, members, quota, copies):
    """Most words, then least cost, over all ways to send whole words: a pattern's second copy costs three a word."""
    slots = [(p, s) for p, m in enumerate(members) for s in m]
    best = (0, 0)
    for words in itertools.product(*(range(min(copies * capacity[p], quota[s]) + 1) for p, s in slots)):
        by_pattern, by_source = [0] * len(capacity), dict.fromkeys(quota, 0)
        for (p, s), n in zip(slots, words, strict=True):
            by_pattern[p] += n
            by_source[s] += n
        if any(n > copies * c for n, c in zip(by_pattern, capacity, strict=True)) or any(by_source[s] > q for s, q in quota.items()):
            continue
        cost = sum(sum(2 * (i // c) + 1 for i in range(n)) for n, c in zip(by_pattern, capacity, strict=True) if n)
        best = max(best, (sum(words), -cost))
    return best


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_optimal(seed):
    rng = random.Random(seed)
    n, sources = rng.randint(1, 3), range(rng.randint(1, 3))
    members = [sorted(rng.sample(sources, rng.randint(1, min(2, len(sources))))) for _ in range(n)]
    capacity, quota = [rng.randint(0, 3) for _ in range(n)], {s: rng.randint(0, 6) for s in sources}
    flow = mix_flow.min_cost_flow(capacity, members, quota, 2)
    sent = [sum(f.values()) for f in flow]
    cost = sum(words * (2 * r - 1) for f in flow for (_, r), words in f.items())
    assert (sum(sent), -cost) == every_flow(capacity, members, quota, 2)
    for p, f in enumerate(flow):
        assert {s for s, _ in f} <= set(members[p]) and all(sum(w for (_, r), w in f.items() if r == k) <= capacity[p] for k in (1, 2))
    assert all(sum(w for f in flow for (x, _), w in f.items() if x == s) <= quota[s] for s in quota)


def test_token_output_with_clashes(spark):
    pytest.importorskip("public_tokenizers")
    rows = [(i, f"Text {i} of some words.", "en", "s", 1) for i in range(20)] + [(None, None, None, None, None), (3, "again", "en", "s", 1), (30, "", "en", "s", 1), (31, "long " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    clash = docs.select("*", *(F.lit("x").alias(c) for c in "part seq start at n_tokens ids_crc32 blob doc_ids shard_start inside before n first_doc_id n_ids".split()))
    path = tokenizer_path(TOKENIZER)
    got, want = ([tuple(map(str, r)) for r in repair_tokens.token_output(d, path).select("doc_id", "n_tokens", "ids_crc32").collect()] for d in (clash, docs))
    assert len(got) == len(rows) and sorted(got) == sorted(want) and repair_tokens.token_output(clash.limit(0), path).count() == 0
