"""The graph operations on random graphs against plain Python, from frames and from a written layout."""

import itertools
import random
import struct

import pytest
from kgloom.operators import read, text, traverse, write
from kgloom.plans.dispatch import OPERATIONS, Session, UnknownOperation
from kgloom.sources.inverted import build_text_index
from kgloom.sources.store import build, empty, from_blob, lay_out, load, to_blob
from pyspark.sql import functions as F


def names(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


KINDS, LINKS = ["k0", "k1", "k2"], ["l0", "l1"]


class Plain:
    """A random graph as Python values, and what operations give on it."""

    def __init__(self, seed, n=24, m=40):
        rng = random.Random(seed)
        words = [f"w{i}" for i in range(9)]
        self.entities = [(f"e{i:02d}", rng.choice(KINDS), [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(rng.randint(0, 3))]) for i in range(n)]
        self.relations = sorted({(f"e{rng.randrange(n):02d}", f"e{rng.randrange(n):02d}", rng.choice(LINKS)) for _ in range(m)})

    def reach(self, start, depth, way, kind=None):
        """Distances, and relations with an end that was expanded."""
        rows = [r for r in self.relations if kind in (None, r[2])]
        dist, edges = {start: 0}, set()
        for hop in range(1, depth + 1):
            here = {x for x, d in dist.items() if d == hop - 1}
            for a, b, t in rows:
                if a in here and way != "in":
                    edges.add((a, b, t))
                    dist.setdefault(b, hop)
                if b in here and way != "out":
                    edges.add((a, b, t))
                    dist.setdefault(a, hop)
        return dist, edges

    def path(self, a, b):
        """The least of the shortest undirected paths, by ids."""
        near = {}
        for x, y, _ in self.relations:
            if x != y:
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
        paths, seen = [[a]], {a}
        while paths and not any(p[-1] == b for p in paths):
            paths = [[*p, y] for p in paths for y in sorted(near.get(p[-1], ())) if y not in seen]
            seen |= {p[-1] for p in paths}
        return min((p for p in paths if p[-1] == b), default=[])


@pytest.fixture(scope="module", params=["frames", "layout"])
def pair(request, spark, tmp_path_factory):
    """A random graph, as plain values and as a graph: from frames, and written with a layout and a text index."""
    plain = Plain(11)
    kg = build(spark, plain.entities, plain.relations)
    if request.param == "layout":
        path = str(tmp_path_factory.mktemp("laid"))
        kg = lay_out(kg, path)
        kg = kg.with_(text=build_text_index(kg, f"{path}/text"))
    return plain, kg


@pytest.fixture(scope="module")
def small(spark):
    plain = Plain(5, 8, 9)
    return plain, build(spark, plain.entities, plain.relations)


def test_paths(pair):
    plain, kg = pair
    some = [n for n, _, _ in plain.entities]
    for a, b in zip(some[::3], some[::-3], strict=False):
        assert [r["name"] for r in traverse.find_path(kg, a, b).orderBy("pos").collect()] == plain.path(a, b)
    with pytest.raises(read.NotFound):
        traverse.find_path(kg, some[0], "nobody")
    assert [r["name"] for r in traverse.find_path(kg, some[2], some[2]).collect()] == [some[2]]


def test_many_paths(pair, spark):
    """All pairs of a graph in one run, a path for each as ``find_path`` gives it."""
    plain, kg = pair
    some = [n for n, _, _ in plain.entities][:14]
    asked = [(i, a, b) for i, (a, b) in enumerate(itertools.product(some, some))] + [(999, "nobody", some[0])]
    got = {}
    for r in traverse.find_paths(kg, spark.createDataFrame(asked, "pair_id long, source string, target string")).collect():
        got.setdefault(r["pair_id"], {})[r["pos"]] = r["name"]
    want = {i: dict(enumerate(plain.path(a, b))) for i, a, b in asked[:-1]}
    assert len(asked) > 64 and got == {i: p for i, p in want.items() if p}


@pytest.mark.parametrize("way,kind,depth", [("both", None, 1), ("OUTGOING", None, 3), ("in", "l1", 2), ("both", "l0", 2), ("out", "no such", 2), ("both", None, 0)])
def test_neighbours(pair, way, kind, depth):
    plain, kg = pair
    start = plain.relations[0][0]
    dist, edges = plain.reach(start, depth, read.direction_of(way), kind)
    e, r = traverse.get_neighbors(kg, start, way, kind, depth)
    assert dict(names(e, "name", "dist")) == dist and names(r, "from", "to", "relation_type") == sorted(edges)


def test_subgraph_and_degree(pair):
    plain, kg = pair
    a, b = plain.relations[0][0], plain.relations[-1][1]
    (d0, e0), (d1, e1) = (plain.reach(x, 1, "both") for x in (a, b))
    e, r = traverse.extract_subgraph(kg, [a, b, "nobody"], 1)
    assert names(e, "name") == sorted({*d0, *d1}) and names(r, "from", "to", "relation_type") == sorted(e0 | e1)
    for way, count in (("out", lambda n: sum(x[0] == n for x in plain.relations)), ("in", lambda n: sum(x[1] == n for x in plain.relations)), ("both", lambda n: sum((x[0] == n) + (x[1] == n) for x in plain.relations))):
        assert dict(names(read.degrees(kg, [a, b, "nobody"], way), "name", "degree")) == {n: count(n) for n in {a, b}}
    with pytest.raises(ValueError):
        traverse.get_neighbors(kg, a, depth=17)


def test_lookups(pair):
    plain, kg = pair
    known = {n: (t, o) for n, t, o in plain.entities}
    asked = [plain.entities[i][0] for i in (3, 9, 3)] + ["nobody"]
    got = read.batch_get_entities(kg, asked).collect()
    assert [(r["name"], (r["type"], r["observations"]) if r["type"] else None) for r in got] == [(n, known.get(n)) for n in asked]
    assert [r["exists"] for r in read.entity_exists(kg, asked).collect()] == [True, True, True, False]
    for n in asked[:2]:
        assert [(r["type"], r["observations"]) for r in read.get_entity(kg, n).collect()] == [known[n]]
        own = [r for r in plain.relations if n in r[:2]]
        bundle = read.describe_bundle(kg, n).first()
        assert bundle["degree"] == sum((r[0] == n) + (r[1] == n) for r in own) and bundle["neighbors"] == len({x for r in own for x in r[:2] if x != n} | {n for r in own if r[0] == r[1]})
    e, r = read.open_nodes(kg, asked)
    assert names(e, "name") == sorted({*asked} & {*known}) and names(r, "from", "to", "relation_type") == [x for x in plain.relations if {*x[:2]} & {*asked}]
    assert read.get_entity(kg, "nobody").count() == 0 and read.open_nodes(kg, [])[0].count() == 0


def test_relation_filters(pair):
    plain, kg = pair
    a, b, t = plain.relations[3]
    for f, to, kind in ((a, None, None), (None, b, None), (None, None, t), (a, b, None), (a, None, t), (None, b, t), (a, b, t), (None, None, None), (a, "nobody", None)):
        want = [r for r in plain.relations if f in (None, r[0]) and to in (None, r[1]) and kind in (None, r[2])]
        assert names(read.search_relations(kg, f, to, kind), "from", "to", "relation_type") == want


def test_pages(pair):
    plain, kg = pair
    page = [n for n, _, _ in plain.entities][4:14]
    e, r = read.read_graph(kg, None, 4, 10)
    assert names(e, "name") == page and names(r, "from", "to", "relation_type") == [x for x in plain.relations if {*x[:2]} <= {*page}]
    typed = [n for n, t, _ in plain.entities if t == "k1"]
    assert names(read.read_graph(kg, "k1", 0, 500)[0], "name") == typed
    assert read.ui_graph(kg, None, 0, 20).first()["has_more"] is True and read.ui_graph(kg, None, 20, 20).first()["has_more"] is False
    assert read.export_json(kg, 6).count() == 12


def _matches(plain, test):
    """Names by the search's order: names first (none here), then entities with an observation that passes."""
    return [n for n, _, o in plain.entities if any(test(b.split()) for b in o)]


def test_search(pair):
    plain, kg = pair
    for query, test in (
        ("w1", lambda t: "w1" in t), ("w1 w2", lambda t: {"w1", "w2"} <= {*t}), ('"w3 w4"', lambda t: ("w3", "w4") in zip(t, t[1:], strict=False)), ("w*", lambda t: True),
        ("w1 OR w7", lambda t: {"w1", "w7"} & {*t}), ("(w1 OR w7) NOT w2", lambda t: {"w1", "w7"} & {*t} and "w2" not in t), ("w5 + w6", lambda t: ("w5", "w6") in zip(t, t[1:], strict=False)),
        ("^w0", lambda t: t[0] == "w0"), ("body : w1", lambda t: "w1" in t), ("- name : w1", lambda t: False), ("{body} : (w1 OR w2) w3", lambda t: False), ("{body} : (w1 OR w2) AND w3", lambda t: {"w1", "w2"} & {*t} and "w3" in t), ("name : w1", lambda t: False), ("w0 NOT w1 w2", lambda t: "w0" in t and not {"w1", "w2"} <= {*t}),
        ("nothing", lambda t: False), ("w1 AND w2 OR w3", lambda t: {"w1", "w2"} <= {*t} or "w3" in t),
    ):
        got = [r["name"] for r in text.search_nodes(kg, query, limit=100).collect()]
        assert got == _matches(plain, test), query
        kinds = {n: t for n, t, _ in plain.entities}
        assert [r["name"] for r in text.search_nodes(kg, query, "k0", 1, 3).collect()] == [n for n in got[:4] if kinds[n] == "k0"][1:4], query
    assert [r["name"] for r in text.search_nodes(kg, "e07").collect()] == ["e07"] and [r["name"] for r in text.ui_search(kg, "e0", 5).orderBy("rank").collect()] == [f"e0{i}" for i in range(5)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("most", [0, 1, 3, 10])
def test_near(spark, seed, most):
    """NEAR of three phrases, one of two words: against all windows, tried one by one."""
    rng = random.Random(seed)
    rows = [[rng.choice("abcxyz") for _ in range(rng.randint(1, 25))] for _ in range(40)]
    kg = build(spark, [(f"n{i}", "t", [" ".join(r)]) for i, r in enumerate(rows)])

    def near(t):
        starts = {"a": [i for i, x in enumerate(t) if x == "a"], "b c": [i for i in range(len(t) - 1) if t[i : i + 2] == ["b", "c"]], "x": [i for i, x in enumerate(t) if x == "x"]}
        for choice in itertools.product(*starts.values()):
            ends = [s + len(p.split()) for p, s in zip(starts, choice, strict=True)]
            first = min(range(3), key=lambda i: choice[i])
            if max(choice) - ends[first] <= most:
                return True
        return False

    got = names(text.search_nodes(kg, f'NEAR(a "b c" x, {most})', limit=100), "name")
    assert got == sorted(f"n{i}" for i, r in enumerate(rows) if near(r))


def test_malformed():
    for bad in ("-", "a:b", "a/b", '"open', "( a", "OR", "", "a (b)", "NEAR(a b", "NEAR(a, x)", "title : a", "a,b", "*", "^"):
        assert text.parse(bad, "body") is None, bad
    assert text.parse("NEAR a", "body").phrases[0].words == ("near",)


def test_writes(spark, small):
    plain, kg = small
    batch = "pos long, name string, type string, observations array<string>"
    n = len(plain.entities)
    new = spark.createDataFrame([(0, "e03", "x", ["n"]), (1, "new", "t", ["a"]), (2, "new", "u", ["b"]), (3, "", "t", [])], batch)
    grown, created = write.create_entities(kg, new)
    assert [(r["name"], r["type"], r["id"]) for r in created.collect()] == [("new", "t", n + 1)]
    old = plain.relations[0]
    triples = spark.createDataFrame([("new", "new", "self"), ("new", "new", "self"), ("new", "nope", "x"), old], "`from` string, `to` string, type string")
    grown, made = write.create_relations(grown, triples)
    assert names(made, "from", "to", "type") == [("new", "new", "self")] and read.degree(grown, "new").first()["degree"] == 2
    gone = write.delete_entities(grown, spark.createDataFrame([("new",), ("nope",)], "name string"))
    assert gone.relations.count() == len(plain.relations) and gone.entities.count() == n
    more = write.add_observations(kg, spark.createDataFrame([(0, "e02", "w1 w1")], "pos long, name string, body string"))
    own = {name: o for name, _, o in plain.entities}
    assert more.nested().filter("name = 'e02'").first()["observations"] == [*own["e02"], "w1 w1"]
    with pytest.raises(read.NotFound):
        write.add_observations(kg, spark.createDataFrame([(0, "nope", "x")], "pos long, name string, body string"))
    held = next(name for name, o in own.items() if o)
    up = write.upsert_entities(kg, spark.createDataFrame([(0, held, "new", [own[held][0], "fresh"])], batch))
    row = up.nested().filter(F.col("name") == held).first()
    assert row["type"] == "new" and row["observations"] == [*own[held], "fresh"]
    a, b = next(r[:2] for r in plain.relations if r[0] != r[1])
    merged = write.merge_entities(kg, a, b)
    moved = {(b if x == a else x, b if y == a else y, t) for x, y, t in plain.relations if {x, y} - {a, b}}
    assert merged.entities.count() == n - 1 and names(merged.edges(), "from", "to", "relation_type") == sorted(moved)
    assert write.merge_entities(kg, a, b, strict_reference=True).relations.filter("from_id = to_id").count() > 0


def test_store(spark, small, tmp_path):
    plain, kg = small
    path = str(tmp_path / "kg")
    kg.save(path)
    back = load(spark, path)
    assert read.graph_stats(back).first()[:2] == (len(plain.entities), len(plain.relations))
    assert read.graph_stats(empty(spark)).first()[:2] == (0, 0)
    assert kg.compact(str(tmp_path / "small"), 2).entities.count() == len(plain.entities)
    rng = random.Random(1)
    vectors = [([rng.random() for _ in range(rng.randint(0, 5))],) for _ in range(40)] + [(None,), ([],)]
    v = spark.createDataFrame(vectors, "embedding array<float>").repartition(3)
    rows = v.withColumn("b", to_blob()).select("embedding", "b", from_blob("b").alias("v")).collect()
    assert len(rows) == 42 and all(r["v"] == r["embedding"] for r in rows)
    assert all(r["b"] is None or bytes(r["b"]) == struct.pack(f"<I{len(r['embedding'])}f", len(r["embedding"]), *r["embedding"]) for r in rows)
    for short in (b"", b"abc", struct.pack("<If", 2, 1.0)):
        with pytest.raises(Exception, match="short embedding blob"):
            spark.createDataFrame([(bytearray(short),)], "b binary").select(from_blob("b")).collect()


def test_dispatch(spark):
    assert len(OPERATIONS) == 45
    s = Session(empty(spark))
    s.call("create_entities", {"entities": [{"name": "a", "entityType": "t", "observations": ["x y"]}, {"name": "b", "entityType": "t"}]})
    s.call("create_relations", {"relations": [{"from": "a", "to": "b", "relationType": "r"}]})
    assert s.call("graph_stats").first()[:2] == (2, 1)
    assert names(s.call("search_nodes", {"query": "y"}), "name") == ["a"]
    with pytest.raises(ValueError):
        s.call("create_entities", {"entities": [{"name": "", "entityType": "t"}]})
    with pytest.raises(read.NotFound):
        s.call("get_entity", {"name": "zz"})
    with pytest.raises(UnknownOperation):
        Session(empty(spark), ["read"]).call("compact")


def _all_paths(edges, a, b, depth, most):
    """Simple paths by plain recursion, one for each choice of parallel edges."""
    found = []

    def walk(path):
        if path[-1] == b:
            found.append(path)
        elif len(path) <= depth:
            for x, y in edges:
                for here, there in ((x, y), (y, x)):
                    if here == path[-1] and x != y and there not in path:
                        walk([*path, there])

    walk([a])
    return sorted(found, key=lambda p: (len(p), p))[:most]


@pytest.mark.parametrize("seed,depth,most", [(0, 6, 50), (1, 5, 7), (2, 1, 50), (3, 4, 100)])
def test_all_paths_by_recursion(spark, seed, depth, most):
    rng = random.Random(seed)
    edges = [(rng.randint(1, 7), rng.randint(1, 7)) for _ in range(11)]
    kg = build(spark, [(str(i), "n", []) for i in range(1, 8)], [(str(x), str(y), f"t{i}") for i, (x, y) in enumerate(edges)])
    got = {}
    for r in traverse.find_all_paths(kg, "1", "2", depth, most).orderBy("path_id", "pos").collect():
        got.setdefault(r["path_id"], []).append(int(r["name"]))
    assert [got[i] for i in sorted(got)] == _all_paths(edges, 1, 2, depth, most)
    few = sorted({tuple(p) for p in _all_paths(edges, 1, 2, depth, 10**6)}, key=lambda p: (len(p), p))[:most]
    assert len({r["path_id"] for r in traverse.find_all_paths(kg, "1", "2", depth, most, distinct=True).collect()}) == len(few)
