"""Words made to meet in polynomial hashes are told apart, and a piece whose hash another one has is still encoded right."""

import numpy as np
import pyarrow as pa
import pytest
from kgloom.llm import bytewords, minhash_tensor, repair_tokens, substring_chains, winnow
from kgloom.llm.queries import TOKENIZER, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def twins(n):
    """The first ``n`` letters of the Thue-Morse sequence over a and b, and their complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1, 2, 64, 512, 1024, 2048, 4096])
def test_words_apart(n):
    h, _ = bytewords.word_hashes(pa.array([" ".join(twins(n)), "x " + twins(n)[1]]), bytewords.ALNUM)
    assert h[0] != h[1] and h[1] == h[3]


def test_hash_is_that_of_its_places():
    data = np.frombuffer("one two  three é\n" .encode() * 3, np.uint8)
    starts, ends, _ = bytewords.span_bounds(bytewords.NON_SPACE[data], np.array([0, len(data)]))
    keys, u = bytewords.counter_hash(0x5EED, 64) | np.uint64(1), np.uint64
    with np.errstate(over="ignore"):
        want = [bytewords.mix64((bytewords._BYTE[data[a:b]] * keys[: b - a]).sum(dtype=u) + u(b - a)) for a, b in zip(starts, ends, strict=True)]
    assert bytewords.span_hashes(data, starts, ends).tolist() == [int(x) for x in want]


@pytest.fixture(scope="module")
def encoder():
    pytest.importorskip("public_tokenizers")
    return repair_tokens.PieceEncoder(tokenizer_path(TOKENIZER))


@pytest.mark.parametrize("n", [1024, 2048])
def test_twin_pieces(encoder, n):
    a, b = twins(n)
    texts = [f"xx {a} yy", f"xx {b} yy", f"xx {a} yy"]
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_one_hash(encoder, monkeypatch):
    """Even if all pieces of a length had one hash, ids are those of the library."""
    own = repair_tokens.PieceEncoder(tokenizer_path(TOKENIZER))
    hashes = repair_tokens.Spans.hashes

    def few(self):
        hashes(self)
        return self.size.astype(np.uint64) % np.uint64(7)

    monkeypatch.setattr(repair_tokens.Spans, "hashes", few)
    texts = ["a bb ccc dddd, eeeee\nfffff ggggggg " + "h" * 90, "b aa ddd cccc, fffff\neeeee hhhhhhh " + "i" * 90, "", "Ünï 12,5 — x"]
    for _ in range(2):
        ids, at = own.encode(pa.array(texts))
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_operators_tell_twins_apart(spark):
    a, b = twins(1024)
    fill = [f"w{i}" for i in range(60)]
    text = lambda mark: " ".join(x if i % 4 else mark for i, x in enumerate(fill))
    docs = spark.createDataFrame([(1, text(a), "en", "s", 1), (2, text(b), "en", "s", 1), (3, text(a), "en", "s", 1)], DOCS)
    near = {r["doc_id"]: r["component_id"] for r in minhash_tensor.near_duplicates(docs, k=4).collect()}
    assert near == {1: 1, 2: 2, 3: 1}
    items = spark.createDataFrame([(7, " ".join(text(a).split()[:20]))], "item_id long, text string")
    leaks = {r["doc_id"]: r["contaminated"] for r in winnow.decontaminate(docs, items).collect()}
    assert leaks == {1: True, 2: False, 3: True}
    found = substring_chains.shared_passages(docs).collect()
    assert found and all({r["doc_id"], r["other_id"]} == {1, 3} for r in found)
