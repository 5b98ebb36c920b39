"""The source tree as a data source, and the stateful watch over it."""

import time

import pytest
from kgloom.operators import code
from kgloom.plans.dispatch import Session
from kgloom.sources.store import empty
from kgloom.sources.tree import ignored, read_tree, rules_of
from kgloom.streaming.watch import code_watch


def write(root, files):
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)


@pytest.mark.parametrize("rules,path,is_dir,out", [
    ("*.py", "a/b.py", False, True), ("/b.py", "a/b.py", False, False), ("/b.py", "b.py", False, True), ("a/", "a", True, True), ("a/", "a", False, False), ("doc/*.go", "doc/x.go", False, True),
    ("doc/*.go", "doc/y/x.go", False, False), ("doc/**/x.go", "doc/y/z/x.go", False, True), ("doc/**/x.go", "doc/x.go", False, True), ("*.py\n!keep.py", "keep.py", False, False), ("[ab].js", "c.js", False, False),
    ("[!ab].js", "c.js", False, True), ("# c\n\n?.js", "a.js", False, True), ("a?.js", "a/.js", False, False), ("x\\*.js", "x*.js", False, True), ("x\\*.js", "xy.js", False, False), ("!a.py\n*.py", "a.py", False, True),
])
def test_rules(rules, path, is_dir, out):
    assert ignored(path, is_dir, [("", rules_of(rules))]) == out


def test_read(spark, tmp_path):
    write(tmp_path, {
        "a.py": "x = 1\n", "__init__.py": "", ".hidden.py": "", "t.txt": "", "node_modules/x.js": "", "build/y.js": "", "skip/y.py": "", "keep/z.go": "package z\n",
        ".gitignore": "skip/\n*.gen.ts\n", "keep/.gitignore": "!ok.gen.ts\n/only.rs\n", "keep/ok.gen.ts": "", "keep/only.rs": "", "keep/deep/only.rs": "", "keep/deep/more/w.c": "int w;\n",
        "keep/deep/.ignore": "*.rb\n", "keep/deep/n.rb": "", "no.gen.ts": "", "big.py": "#" * (11 << 20),
    })
    want = ["__init__.py", "a.py", "keep/deep/more/w.c", "keep/deep/only.rs", "keep/ok.gen.ts", "keep/z.go"]
    for uri in (str(tmp_path), tmp_path.as_uri()):
        got = {r["file"]: bytes(r["content"]) for r in read_tree(spark, uri).collect()}
        assert sorted(got) == want and got["a.py"] == b"x = 1\n"
    assert read_tree(spark, str(tmp_path)).rdd.getNumPartitions() >= 3
    assert read_tree(spark, str(tmp_path / "nothing")).count() == 0


def test_projects_are_kept_up(spark, tmp_path):
    """A second run reads changed files alone, and keeps what the others define."""
    write(tmp_path, {"a.py": "def one():\n    return two()\n", "b.py": "def two():\n    return 2\n"})
    s = Session(empty(spark))
    run = lambda **args: s.call("code_index", {"path": str(tmp_path), **args}).first()[:3]
    assert run() == (2, 0, 0) and run() == (0, 2, 0) and run(force=True) == (2, 0, 0)
    write(tmp_path, {"b.py": "def two():\n    return 3\n\ndef three():\n    pass\n"})
    assert run() == (1, 1, 0)
    assert [r["name"] for r in s.call("code_outline", {"file": "b.py"}).collect()] == ["b.py::two", "b.py::three"]
    assert [r["name"] for r in s.call("code_outline", {"file": "a.py"}).collect()] == ["a.py::one"]
    with pytest.raises(ValueError):
        s.call("code_index", {"path": str(tmp_path), "project": "../x"})


def test_watch(spark, tmp_path):
    """Changes settle for the quiet period and come in one go; a deleted file is purged without a new one arriving."""
    tree, seen = tmp_path / "tree", []
    write(tree, {"a.py": "def one():\n    pass\n", "lib/b.py": "def two():\n    pass\n"})

    def keep(found, links, tally, gone):
        seen.append((time.time(), sorted(r["qualified"] for r in found.select("qualified").collect()), [r["file"] for r in gone.collect()]))

    def wait(test, most=60):
        end = time.time() + most
        while time.time() < end and not test():
            time.sleep(0.2)
        assert test(), seen

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = code_watch(spark, str(tree), keep, str(tmp_path / "checkpoint"), "500 milliseconds", quiet_ms=1500, lost_ms=4000)
    try:
        names = lambda: {n for _, found, _ in seen for n in found}
        wait(lambda: names() >= {"a.py::one", "lib/b.py::two"})
        n = len(seen)
        # edits that follow each other are one change, after the last of them
        for i in range(3):
            write(tree, {"a.py": f"def edit{i}():\n    pass\n"})
            last = time.time()
            time.sleep(0.4)
        wait(lambda: "a.py::edit2" in names())
        assert names().isdisjoint({"a.py::edit0", "a.py::edit1"}) and seen[n][0] - last >= 1.0
        (tree / "lib/b.py").unlink()
        wait(lambda: any("lib/b.py" in gone for _, _, gone in seen))
        assert sum("lib/b.py" in gone for _, _, gone in seen) == 1 and not any("a.py" in gone for _, _, gone in seen)
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_known_files(spark):
    found, links, _ = code.code_index(spark.createDataFrame([("a.py", bytearray(b"def f(): pass\n"))], "file string, content binary"))
    assert code.known_files(code.as_graph(found, links)).count() == 1
