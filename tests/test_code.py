"""Symbols, edges and incremental runs of the code index, and the debouncing of changes."""

import datetime as dt
import random

import pytest
from kgloom.functions.scopes import blanked
from kgloom.operators import code
from kgloom.streaming.watch import quiet_sessions

#: Text, its definitions (kind, name, first and last line) and references (kind, name, line), for each language.
SCENES = {
    "a.rs": (
        """/* fn hidden() { */
pub(crate) async fn
spread(
    x: u32,
) -> u32 {
    let s = r#"} fn no("#; // }
    helper(x, '{')
}
struct Unit;
impl<T: Clone> Draw for Pen<T> {
    fn draw(&self) { println!("}") }
}
pub trait Draw { fn paint(&self); }
mod inner { pub fn deep() {} }
macro_rules! twice { ($e:expr) => { $e + $e } }
""",
        [("function", "spread", 2, 8), ("class", "Unit", 9, 9), ("method", "draw", 11, 11), ("class", "Draw", 13, 13), ("module", "inner", 14, 14), ("function", "twice", 15, 15)],
        [("call", "helper", 7), ("implementation", "Draw", 10), ("call", "println", 11), ("call", "paint", 13), ("call", "deep", 14)],
    ),
    "b.ts": (
        """// class Fake {
export default class Wheel extends Part implements Round, Solid<T> {
  private async turn<T>(
    by: Angle,
  ): Promise<void> {
    const s = `}${x} function no(`;
    await spin(new Axle(by));
  }
}
export const square = (x: number): number => {
  return x * x;
};
const half = (x) => x / 2;
interface Round { area(): number }
enum Side { Left }
namespace Deep { }
""",
        [("class", "Wheel", 2, 9), ("method", "turn", 3, 8), ("function", "square", 10, 12), ("function", "half", 13, 13), ("class", "Round", 14, 14), ("class", "Side", 15, 15), ("module", "Deep", 16, 16)],
        [("class", "Part", 2), ("implementation", "Round", 2), ("implementation", "Solid", 2), ("type", "Angle", 4), ("type", "Promise", 5), ("class", "Axle", 7), ("call", "Axle", 7), ("call", "spin", 7), ("call", "area", 14)],
    ),
    "C.java": (
        """package p;
/** class No { */
public final class C extends Base implements Runnable, Closeable {
    @Override
    public void run() {
        String s = "} void no() {";
        go(new Other());
    }
    abstract static class In { }
}
interface Shape { Area area(); }
""",
        [("class", "C", 3, 10), ("method", "run", 5, 8), ("class", "In", 9, 9), ("class", "Shape", 11, 11)],
        [("class", "Base", 3), ("implementation", "Runnable", 3), ("implementation", "Closeable", 3), ("call", "go", 7), ("class", "Other", 7), ("call", "Other", 7), ("call", "area", 11)],
    ),
    "d.go": (
        """package main
// func no() {
type Thing struct {
	a int
}
func (t *Thing) Run(
	x int,
) int {
	s := `}`
	return help(x)
}
func help(x int) int { return x }
""",
        [("class", "Thing", 3, 5), ("method", "Run", 6, 11), ("function", "help", 12, 12)],
        [("type", "Thing", 6), ("call", "help", 10)],
    ),
    "e.c": (
        """#define TWICE(x) ((x) + (x))
struct box { int a; };
static int
add(int a,
    int b)
{
  if (a) { return twice(b); } /* } */
  return '}';
}
""",
        [("function", "TWICE", 1, 1), ("class", "box", 2, 2), ("function", "add", 3, 9)],
        [("call", "twice", 7)],
    ),
    "f.cpp": (
        """namespace q {
class W : public V {
  int go() { return new Z(1) != 0; }
};
}
""",
        [("module", "q", 1, 5), ("class", "W", 2, 4), ("method", "go", 3, 3)],
        [("class", "V", 2), ("class", "Z", 3), ("call", "Z", 3)],
    ),
    "g.rb": (
        """# def no
module M
  class Dog < Animal
    def bark(x)
      speak(x) if x
      [1].each do |y|
        puts(y)
      end
    end
  end
end
""",
        [("module", "M", 2, 11), ("class", "Dog", 3, 10), ("method", "bark", 4, 9)],
        [("class", "Animal", 3), ("call", "speak", 5), ("call", "puts", 7)],
    ),
    "h.php": (
        """<?php
# function no() {
class Box extends Base implements Able {
  public function go($x) { return make(new Thing($x)); }
}
function make($y) { return $y; }
""",
        [("class", "Box", 3, 5), ("method", "go", 4, 4), ("function", "make", 6, 6)],
        [("class", "Base", 3), ("implementation", "Able", 3), ("call", "make", 4), ("class", "Thing", 4), ("call", "Thing", 4)],
    ),
    "i.py": (
        '''class A(B):
    async def go(self):
        return other(1)

def other(x):
    """Says it."""
''',
        [("class", "A", 1, 3), ("method", "go", 2, 3), ("function", "other", 5, 6)],
        [("call", "other", 3)],
    ),
    "broken.py": (
        """class A2:
    def went(self):
        return another(1

def another(x):
    return '}'
""",
        [("class", "A2", 1, 3), ("method", "went", 2, 3), ("function", "another", 5, 6)],
        [("call", "another", 3)],
    ),
    "j.js": (
        """function f() {}
const g = (x) => f(x);
class K extends L {
  m(a) { return f(a); }
}
""",
        [("function", "f", 1, 1), ("function", "g", 2, 2), ("class", "K", 3, 5), ("method", "m", 4, 4)],
        [("call", "f", 2), ("class", "L", 3), ("call", "f", 4)],
    ),
}


@pytest.mark.parametrize("path", sorted(SCENES))
def test_every_language(path):
    body, defs, refs = SCENES[path]
    got = code.parse(path, body)
    assert [(d["kind"], d["name"], d["line_start"], d["line_end"]) for d in got[0]] == defs
    assert sorted((r["kind"], r["name"], r["line"]) for r in got[1]) == sorted(refs)
    assert code.parse(path, "  \n") == ([], []) and code.parse(path + ".txt", body) == ([], [])
    # whatever a text is cut to, it is read without an error and lines stay in order
    for i in range(0, len(body), 7):
        assert all(1 <= d["line_start"] <= d["line_end"] <= body.count("\n") + 1 for d in code.parse(path, body[:i])[0])


def test_blanks_keep_places():
    for path, (body, _, _) in SCENES.items():
        hidden = blanked(body, code.language_of(path))
        assert len(hidden) == len(body) and [i for i, c in enumerate(body) if c == "\n"] == [i for i, c in enumerate(hidden) if c == "\n"]


def _tree(spark):
    return spark.createDataFrame([(k, bytearray(v[0].encode())) for k, v in SCENES.items()] + [("gone.py", None)], "file string, content binary")


def test_index(spark):
    found, links, tally = code.code_index(_tree(spark))
    pairs = {(r["from"], r["to"], r["type"]) for r in links.collect()}
    assert {("d.go::Run", "d.go::help", "calls"), ("h.php::go", "h.php::make", "calls"), ("b.ts::Wheel", "b.ts::Round", "references"), ("a.rs", "a.rs::Draw", "references")} <= pairs
    assert ("j.js::K", "j.js::f", "calls") not in pairs and ("j.js::m", "j.js::f", "calls") in pairs and ("i.py", "i.py::other", "defines") in pairs
    n = sum(len(v[1]) for v in SCENES.values())
    assert tally.first()[:] == (len(SCENES), 0, 1, n, len(pairs)) and found.count() == n
    known = found.select("file", "hash").distinct()
    assert code.code_index(_tree(spark), known)[2].first()[:3] == (0, len(SCENES), 1)
    assert code.code_index(_tree(spark), known, force=True)[2].first()[:2] == (len(SCENES), 0)
    kg = code.as_graph(found, links)
    assert [r["name"] for r in code.code_outline(kg, "b.ts").collect()][:2] == ["b.ts::Wheel", "b.ts::turn"]
    assert code.code_get_symbol(kg, "make").first()["callers"] == ["h.php::go"]
    gone = code.purge_files(kg, spark.createDataFrame([("a.rs",)], "name string"))
    assert gone.entities.filter("name like 'a.rs%'").count() == 0 and gone.entities.count() == n + len(SCENES) - 1 - len(SCENES["a.rs"][1])


@pytest.mark.parametrize("seed", range(3))
def test_tightest_span(spark, seed):
    """The holder of each reference against every span of its file, tried one by one; spans may cross."""
    rng = random.Random(seed)
    defs, refs = {}, {}
    for f in "ab":
        defs[f] = [(a, min(60, a + rng.choice([0, 0, 1, 3, 9, 40])), f"d{f}{i}") for i, a in enumerate(sorted(rng.choices(range(1, 60), k=25)))]
        refs[f] = [(rng.randint(1, 62), rng.choice(defs[f])[2]) for _ in range(80)]
    d = "array<struct<kind:string,name:string,line_start:int,line_end:int,signature:string,doc:string,snippet:string>>"
    rows = [(f, "go", "h", [("function", n, a, b, "", "", "") for a, b, n in defs[f]], [("call", n, line) for line, n in refs[f]]) for f in "ab"]
    parsed = spark.createDataFrame(rows, f"file string, lang string, hash string, defs {d}, refs array<struct<kind:string,name:string,line:int>>")
    got = {(r["from"], r["to"]) for r in code.edges(parsed, code.symbols(parsed)).filter("type = 'calls'").collect()}
    want = []
    for f in "ab":
        for line, name in refs[f]:
            held = [(b - a, f"{f}::{n}") for a, b, n in defs[f] if a <= line <= b]
            want.append(({q for size, q in held if size == min(held)[0]} if held else {f}, f"{f}::{name}"))
    assert all(any(a in least and b == to for least, to in want) for a, b in got)
    assert all(any(a in least and b == to for a, b in got) for least, to in want if to not in least)


def test_a_file_of_many_symbols(spark):
    """20,000 symbols and their calls in one file."""
    n = code.MAX_SYMBOLS // 2
    body = "".join(f"func f{i}(x int) int {{\n\treturn f{i // 2}(x)\n}}\n" for i in range(n))
    found, links, _ = code.code_index(spark.createDataFrame([("big.go", bytearray(body.encode()))], "file string, content binary"))
    uses = {(r["from"], r["to"]) for r in links.filter("type = 'calls'").collect()}
    assert found.count() == n and uses == {(f"big.go::f{i}", f"big.go::f{i // 2}") for i in range(1, n)}


def test_sessions(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("f", at), ("f", at + dt.timedelta(seconds=1)), ("f", at + dt.timedelta(seconds=9)), ("g", at)]
    got = quiet_sessions(spark.createDataFrame(rows, "path string, ts timestamp"), "path", "ts").collect()
    assert sorted((r["path"], r["changes"]) for r in got) == [("f", 1), ("f", 2), ("g", 1)]
