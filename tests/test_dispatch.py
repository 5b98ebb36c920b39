"""Every named operation through a session, on a random graph, against plain Python."""

import random
import time

import pytest
from kgloom.operators import read
from kgloom.plans.dispatch import OPERATIONS, Session, UnknownOperation
from kgloom.sources.store import empty


class Mirror:
    """What the session's graph should hold: name to type and observations, triples, vectors."""

    def __init__(self):
        self.entities, self.relations, self.vectors = {}, set(), {}


@pytest.fixture(scope="module")
def world(spark):
    rng, m, s = random.Random(21), Mirror(), Session(empty(spark), settle=1)
    words = [f"w{i}" for i in range(12)]
    for i in range(12):
        m.entities[f"e{i:02d}"] = (f"k{i % 2}", [" ".join(rng.choices(words, k=3)) for _ in range(rng.randint(1, 3))])
    s.call("create_entities", {"entities": [{"name": n, "entityType": t, "observations": o} for n, (t, o) in m.entities.items()]})
    m.relations = {(f"e{rng.randrange(12):02d}", f"e{rng.randrange(12):02d}", rng.choice(["a", "b"])) for _ in range(22)}
    s.call("create_relations", {"relations": [{"from": a, "to": b, "relationType": t} for a, b, t in m.relations]})
    m.vectors = {f"e{i:02d}": [round(rng.uniform(-1, 1), 3) for _ in range(4)] for i in range(10)}
    outcome = s.call("vector_batch_upsert", {"items": [{"entityName": n, "embedding": v} for n, v in m.vectors.items()] + [{"entityName": "nobody", "embedding": [1.0] * 4}]})
    assert [r["error"] for r in outcome.orderBy("pos").collect()] == [None] * 10 + ["unknown entity"]
    s.call("compact")
    return s, m


called: set[str] = {"create_entities", "create_relations", "vector_batch_upsert", "compact"}


def rows(s, op, args=None):
    called.add(op)
    return s.call(op, args).collect()


def pair(s, op, args=None):
    called.add(op)
    e, r = s.call(op, args)
    return {x["name"] for x in e.collect()}, {(x["from"], x["to"], x["relation_type"]) for x in r.collect()}


def test_reads(world):
    s, m = world
    a, b, _ = sorted(m.relations)[0]
    assert rows(s, "graph_stats")[0][:3] == (12, len(m.relations), sum(len(o) for _, o in m.entities.values()))
    for op in ("get_entity", "describe_entity"):
        assert [tuple(r) for r in rows(s, op, {"name": a})] == [(a, m.entities[a][0], m.entities[a][1])]
        with pytest.raises(read.NotFound):
            s.call(op, {"name": "nobody"})
    assert [r["type"] for r in rows(s, "batch_get_entities", {"names": [a, "nobody"]})] == [m.entities[a][0], None]
    assert [r["exists"] for r in rows(s, "entity_exists", {"names": [a, "nobody"]})] == [True, False]
    assert pair(s, "read_graph", {"limit": 12}) == (set(m.entities), m.relations)
    near = {r for r in m.relations if a in r[:2]}
    assert pair(s, "open_nodes", {"names": [a]}) == ({a}, near)
    assert {tuple(r) for r in rows(s, "search_relations", {"from": a})} == {r for r in m.relations if r[0] == a}
    names = {x for r in near for x in r[:2]} | {a}
    assert pair(s, "get_neighbors", {"name": a}) == (names, near) == pair(s, "extract_subgraph", {"names": [a], "depth": 1})
    assert rows(s, "degree", {"name": a})[0]["degree"] == sum((r[0] == a) + (r[1] == a) for r in m.relations)
    assert {r["type"]: r["count"] for r in rows(s, "list_entity_types")} == {"k0": 6, "k1": 6}
    assert sum(r["count"] for r in rows(s, "list_relation_types")) == len(m.relations)
    assert [r["name"] for r in sorted(rows(s, "find_path", {"from": a, "to": b}))] == ([a] if a == b else [a, b])
    assert rows(s, "find_all_paths", {"from": a, "to": b, "maxDepth": 2})[0]["name"] in (a, b)
    assert len(rows(s, "export_graph")) == 12 + len(m.relations)
    word = m.entities[a][1][0].split()[0]
    assert {r["name"] for r in rows(s, "search_nodes", {"query": word})} == {n for n, (_, o) in m.entities.items() if any(word in x.split() for x in o)}


def test_writes_keep_the_text_index(world):
    s, m = world
    called.update(("create_entities", "add_observations", "delete_entities", "upsert_entities", "delete_observations", "delete_relations", "merge_entities"))
    found = lambda q: {r["name"] for r in rows(s, "search_nodes", {"query": q})}
    assert s.kg.text is not None
    s.call("create_entities", {"entities": [{"name": "late", "entityType": "t", "observations": ["brandnew words"]}]})
    assert s.kg.text is not None and found("brandnew") == {"late"} == found("late")
    assert s.call("add_observations", {"observations": [{"entityName": "e03", "contents": ["brandnew too"]}]}) == 1
    assert s.kg.text is not None and found("brandnew") == {"late", "e03"}
    s.call("delete_entities", {"entityNames": ["late"]})
    assert s.kg.text is not None and found("brandnew") == {"e03"} and found("late") == set()
    s.call("delete_observations", {"deletions": [{"entityName": "e03", "observations": ["brandnew too"]}]})
    assert found("brandnew") == set()
    assert [r["type"] for r in rows(s, "upsert_entities", {"entities": [{"name": "e04", "entityType": "other", "observations": ["upserted"]}]})] == ["other"] and found("upserted") == {"e04"}
    a, b, t = sorted(m.relations)[1]
    s.call("delete_relations", {"relations": [{"from": a, "to": b, "relationType": t}]})
    assert (a, b, t) not in {tuple(r) for r in rows(s, "search_relations", {"from": a})}
    rows(s, "merge_entities", {"source": "e11", "target": "e10"})
    assert not rows(s, "entity_exists", {"names": ["e11"]})[0]["exists"]


def test_vectors(world):
    s, m = world
    called.update(("vector_upsert_embedding", "vector_delete_embedding"))
    v = m.vectors["e02"]
    for reindexed in (False, True):
        assert rows(s, "vector_search_entities", {"embedding": v, "topK": 3})[0]["name"] == "e02"
        assert "e02" not in {r["name"] for r in rows(s, "vector_search_by_entity", {"entityName": "e02", "topK": 3})}
        assert not {"e01", "e02"} & {r["name"] for r in rows(s, "vector_recommend", {"positive": ["e01", "e02"], "topK": 3})}
        assert len(rows(s, "vector_mmr_search", {"embedding": v, "topK": 3})) == 3
        assert rows(s, "hybrid_search", {"queryText": "w1 OR w2 OR w3", "queryEmbedding": v, "topK": 5})
        assert rows(s, "vector_store_stats")[0]["index_kind"] == ("hnsw" if reindexed else "exact")
        rows(s, "vector_reindex")
    assert rows(s, "vector_get_embedding", {"entityName": "e02"})[0]["dims"] == 4
    s.call("vector_upsert_embedding", {"entityName": "e02", "embedding": [9.0, 9.0, 9.0, 9.0]})
    assert rows(s, "vector_get_embedding", {"entityName": "e02"})[0]["embedding"] == [9.0] * 4
    assert s.call("vector_delete_embedding", {"entityName": "e02"}) and not rows(s, "vector_get_embedding", {"entityName": "e02"})
    assert rows(s, "vector_refresh_graph_cache")[0]["nodes"] == 9


def test_code(world, tmp_path):
    s, _ = world
    (tmp_path / "a.py").write_text("def one():\n    return two()\n\ndef two():\n    pass\n")
    assert rows(s, "code_index", {"path": str(tmp_path)})[0]["files_indexed"] == 1
    assert [r["name"] for r in rows(s, "code_outline", {"file": "a.py"})] == ["a.py::one", "a.py::two"]
    assert {r["name"] for r in rows(s, "code_search", {"query": "two"})} >= {"a.py::two"}
    assert rows(s, "code_get_symbol", {"name": "two"})[0]["callers"] == ["a.py::one"]
    hot = [1.0] + [0.0] * 767
    assert [r["error"] for r in rows(s, "code_embed", {"items": [{"name": "a.py::one", "embedding": hot}, {"name": "x", "embedding": hot}]})] == [None, "unknown entity"]
    assert [r["name"] for r in rows(s, "code_semantic_search", {"embedding": hot})] == ["a.py::one"]
    query = s.call("code_watch", {"path": str(tmp_path), "project": "seen"})
    called.add("code_watch")
    try:
        end = time.time() + 60
        while time.time() < end and "seen" not in s.projects:
            time.sleep(0.5)
        assert [r["name"] for r in rows(s, "code_outline", {"file": "a.py", "project": "seen"})] == ["a.py::one", "a.py::two"]
    finally:
        query.stop()
    with pytest.raises(ValueError):
        s.call("code_outline", {"file": "a.py", "project": "none"})


def test_all_operations_were_called():
    assert called >= set(OPERATIONS) and len(OPERATIONS) == 45


def test_categories(spark):
    with pytest.raises(UnknownOperation):
        Session(empty(spark), ["read"]).call("compact")
    with pytest.raises(UnknownOperation):
        Session(empty(spark)).call("no_such_operation")
