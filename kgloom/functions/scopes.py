"""Definitions and references of source text: strings and comments blanked out, blocks matched by a stack, patterns over what is left."""

from __future__ import annotations

import ast
import bisect
import re

_NAME = r"[A-Za-z_$][\w$]*"
_TYPE = r"[A-Za-z_$][\w$.:]*"
_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_APOSTROPHE = r"'(?:\\.|[^'\\\n])*'"
#: What is blanked in each language: comments and strings.
_HIDDEN = {
    "rust": rf"{_C_LIKE}|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
    "go": rf"{_C_LIKE}|`[^`]*`|{_QUOTED}|{_APOSTROPHE}",
    "java": rf'{_C_LIKE}|""".*?"""|{_QUOTED}|{_APOSTROPHE}',
    "c": rf"{_C_LIKE}|{_QUOTED}|{_APOSTROPHE}",
    "javascript": rf"{_C_LIKE}|`(?:\\.|[^`\\])*`|{_QUOTED}|{_APOSTROPHE}",
    "php": rf"{_C_LIKE}|\#(?!\[)[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'",
    "ruby": rf"^=begin.*?^=end|\#[^\n]*|{_QUOTED}|{_APOSTROPHE}",
    "python": rf'""".*?(?:"""|\Z)|{"'''"}.*?(?:{"'''"}|\Z)|\#[^\n]*|{_QUOTED}|{_APOSTROPHE}',
}
_HIDDEN["cpp"] = _HIDDEN["c"]
_HIDDEN["typescript"] = _HIDDEN["tsx"] = _HIDDEN["javascript"]

_RUST_PUB = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_JAVA_MOD = r"(?:(?:public|private|protected|static|final|abstract|sealed|synchronized|native|default|strictfp)\s+)*"
_TS_MOD = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?"
_NOT_CALLS = r"(?!(?:if|for|while|switch|return|catch|else|function|new|throw|sizeof|do)\b)"
_JS = [
    ("function", rf"^[ \t]*{_TS_MOD}(?:async\s+)?function\s*\*?\s*(?P<n>{_NAME})"),
    ("function", rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<n>{_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_NAME})\s*(?::[^=\n]+)?=>"),
    ("class", rf"^[ \t]*{_TS_MOD}class\s+(?P<n>{_NAME})"),
    ("method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?{_NOT_CALLS}(?P<n>[#\w$]+)\s*(?:<[^<>()]*>)?\([^(){{}};]*\)\s*(?::[^{{}};\n]+)?\{{"),
]
_C = [
    ("function", rf"^[ \t]*(?!(?:else|return|typedef|new|delete|using|case)\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&](?:[\w]+::)*{_NOT_CALLS}(?P<n>~?{_NAME})\s*\([^;{{}}]*\)\s*(?:const\s*|noexcept\s*|override\s*)*\{{"),
    ("class", rf"^[ \t]*(?:typedef\s+)?(?:struct|enum|union)\s+(?P<n>{_NAME})\s*\{{"),
    ("function", rf"^[ \t]*\#[ \t]*define\s+(?P<n>{_NAME})"),
]
#: For each language (kind, pattern): the group n is the defined name.
_DEFS = {
    "rust": [
        ("function", rf"^[ \t]*{_RUST_PUB}(?:(?:async|const|unsafe|default|extern(?:\s+\S+)?)\s+)*fn\s+(?P<n>{_NAME})"),
        ("class", rf"^[ \t]*{_RUST_PUB}(?:unsafe\s+)?(?:struct|enum|union|type|trait)\s+(?P<n>{_NAME})"),
        ("module", rf"^[ \t]*{_RUST_PUB}mod\s+(?P<n>{_NAME})"), ("function", rf"^[ \t]*macro_rules!\s*(?P<n>{_NAME})"),
    ],
    "go": [("method", rf"^func\s+\([^)]*\)\s*(?P<n>{_NAME})"), ("function", rf"^func\s+(?P<n>{_NAME})"), ("class", rf"^[ \t]*type\s+(?P<n>{_NAME})")],
    "java": [
        ("class", rf"^[ \t]*{_JAVA_MOD}(?:class|enum|record|interface|@interface)\s+(?P<n>{_NAME})"),
        ("method", rf"^[ \t]+{_JAVA_MOD}(?:<[^<>]*>\s*)?(?!(?:return|new|else|throw|case)\b)[\w<>\[\], ?.]+\s+{_NOT_CALLS}(?P<n>{_NAME})\s*\([^;{{}}()]*\)\s*(?:throws\s+[\w,\s.]+)?[{{;]"),
    ],
    "c": _C, "cpp": [*_C, ("class", rf"^[ \t]*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?P<n>{_NAME})\s*(?:final\s*)?(?::[^{{;]*)?\{{"), ("module", rf"^[ \t]*(?:inline\s+)?namespace\s+(?P<n>{_NAME})")],
    "javascript": _JS, "typescript": [*_JS, ("class", rf"^[ \t]*{_TS_MOD}(?:interface|type|enum|const\s+enum)\s+(?P<n>{_NAME})"), ("module", rf"^[ \t]*{_TS_MOD}(?:namespace|module)\s+(?P<n>{_NAME})")],
    "ruby": [("method", r"^[ \t]*def\s+(?:self\.)?(?P<n>[A-Za-z_]\w*[?!=]?)"), ("class", rf"^[ \t]*class\s+(?P<n>{_NAME})"), ("module", rf"^[ \t]*module\s+(?P<n>{_NAME})")],
    "php": [("function", rf"^[ \t]*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?\s*(?P<n>{_NAME})"), ("class", rf"^[ \t]*(?:(?:abstract|final|readonly)\s+)*(?:class|enum|interface|trait)\s+(?P<n>{_NAME})")],
    "python": [("class", rf"^[ \t]*class\s+(?P<n>{_NAME})"), ("function", rf"^[ \t]*(?:async\s+)?def\s+(?P<n>{_NAME})")],
}
_DEFS["tsx"] = _DEFS["typescript"]
#: References other than calls: (kind, pattern), names in the group n, several of them with commas between.
_REFS = {
    "rust": [("implementation", rf"^[ \t]*(?:unsafe\s+)?impl(?:\s*<[^{{]*?>)?\s+(?P<n>{_TYPE})(?:<[^{{]*?>)?\s+for\b")],
    "java": [("implementation", r"\bimplements\s+(?P<n>[\w$.,\s<>]+?)\s*\{"), ("class", rf"\bextends\s+(?P<n>{_TYPE})"), ("class", rf"\bnew\s+(?P<n>{_TYPE})")],
    "javascript": [("class", rf"\bextends\s+(?P<n>{_TYPE})"), ("class", rf"\bnew\s+(?P<n>{_TYPE})")],
    "go": [("type", rf"(?:\*|\[\]|\b(?:var\s+\w+|return)\s+&?)(?P<n>{_TYPE})\b(?=\s*[{{,)=\n])")],
    "php": [("implementation", r"\bimplements\s+(?P<n>[\w\\,\s]+?)\s*\{"), ("class", rf"\bextends\s+(?P<n>{_TYPE})"), ("class", rf"\bnew\s+(?P<n>{_TYPE})")],
    "cpp": [("class", rf"\b(?:class|struct)\s+{_NAME}\s*:\s*(?:public|private|protected)?\s*(?P<n>{_TYPE})"), ("class", rf"\bnew\s+(?P<n>{_TYPE})")],
    "ruby": [("class", rf"\bclass\s+{_NAME}\s*<\s*(?P<n>{_TYPE})")],
    "python": [],
}
_REFS["typescript"] = _REFS["tsx"] = [*_REFS["javascript"], ("implementation", r"\bimplements\s+(?P<n>[\w$.,\s<>]+?)\s*\{"), ("type", r"[\w)\]?]\s*:\s*(?P<n>[A-Z][\w$]*)")]
_compiled = lambda rules: {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in rules.items()}
_DEFS_RE, _REFS_RE = _compiled(_DEFS), _compiled(_REFS)
_HIDDEN_RE = {k: re.compile(p, re.S | re.M) for k, p in _HIDDEN.items()}
_CALL = re.compile(rf"(?<![\w$])(?P<n>{_NAME})!?\s*\(")
_WORDS = frozenset("if for while switch return catch sizeof function match fn def func elseif foreach print echo and or not new defined super self this await yield in loop unless until pub crate".split())
_RUBY = re.compile(r"(?<![\w.:])(?:(?P<open>class|module|def|begin|case|do)\b|(?P<maybe>if|unless|while|until)\b|(?P<close>end)\b)")


def blanked(text: str, lang: str) -> str:
    """Text of the same length and lines with comments and strings as blanks."""
    rule = _HIDDEN_RE.get(lang)
    return rule.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text) if rule else text


def _braces(code: str) -> dict[int, int]:
    """Where each opening brace is closed; what stays open ends with the text."""
    open_, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out | {i: len(code) - 1 for i in open_}


def _ruby_ends(code: str) -> dict[int, int]:
    """Where what each keyword opens has its end; modifiers such as ``x if y`` open nothing."""
    open_, out = [], {}
    for m in _RUBY.finditer(code):
        if m["close"]:
            if open_:
                out[open_.pop()] = m.end() - 1
        elif m["open"] or not code[code.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
            if m[0] != "do" or not re.match(r"[ \t]*(?:while|until|for)\b", code[code.rfind("\n", 0, m.start()) + 1 : m.start()]):
                open_.append(m.start())
    return out | {i: len(code) - 1 for i in open_}


def _header_end(code: str, at: int, marks: str) -> int | None:
    """The first of ``marks`` from ``at`` on that stands in no parentheses or brackets."""
    depth = 0
    for m in re.compile(r"[()\[\]{};\n]").finditer(code, at):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif depth <= 0 and m[0] in marks:
            return m.start()
    return None


def _indented_end(code: str, at: int) -> int:
    """Last character of the lines below ``at`` that are indented deeper than its line."""
    start = code.rfind("\n", 0, at) + 1
    indent = len(code[start:]) - len(code[start:].lstrip(" \t"))
    end, at = None, code.find("\n", at)
    while at >= 0:
        stop = code.find("\n", at + 1)
        line = code[at + 1 : stop if stop >= 0 else len(code)]
        if line.strip():
            if len(line) - len(line.lstrip(" \t")) <= indent and end is not None:
                break
            end = at + len(line)
        at = stop
    return len(code) - 1 if end is None else end


def _doc(lines: list[str], i: int) -> str:
    """The comment line right above line ``i``."""
    above = lines[i - 1].strip() if i else ""
    return re.sub(r"^[/#*! ]+|\*/$", "", above).strip() if re.match(r"//|/\*|#(?!\s*(?:define|include|\[))|\*", above) else ""


def scan(text: str, lang: str) -> tuple[list[dict], list[dict]]:
    """Definitions (kind, name, line_start, line_end, doc) and references (kind, name, line), lines from 1."""
    code = blanked(text, lang)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line_of = lambda at: bisect.bisect_right(starts, at)
    lines = text.split("\n")
    blocks = _ruby_ends(code) if lang == "ruby" else {} if lang == "python" else _braces(code)
    holders = [(m.end() - 1, blocks.get(m.end() - 1, 0)) for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?(?:impl|(?:pub\s+)?trait)\b[^{;]*\{", code, re.M)] if lang == "rust" else []
    found: dict[int, tuple] = {}
    for kind, rule in _DEFS_RE.get(lang, ()):
        for m in rule.finditer(code):
            at = m.start("n")
            if at in found or m["n"] in _WORDS:
                continue
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            if lang == "python":
                end = _indented_end(code, at)
            elif lang == "ruby":
                end = blocks.get(begin, len(code) - 1)
            elif code[begin] == "#":
                end = at
            else:
                stop = _header_end(code, m.end() - (m[0][-1] in "{;"), "{\n" if lang == "go" else "{;")
                end = at if stop is None else blocks[stop] if code[stop] == "{" else stop
                if lang in ("javascript", "typescript", "tsx") and "=>" in m[0]:  # an arrow may have an expression only
                    after = re.compile(r"\S").search(code, m.end())
                    end = end if after and after[0] == "{" else min(x for x in (code.find(";", at), code.find("\n", m.end()), len(code) - 1) if x >= 0)
            if kind == "function" and any(a < at < b for a, b in holders):
                kind_ = "method"
            else:
                kind_ = kind
            found[at] = (begin, end, kind_, m["n"])
    defs = []
    for at in sorted(found):
        begin, end, kind, name = found[at]
        first = line_of(begin)
        defs.append({"kind": kind, "name": name, "line_start": first, "line_end": max(first, line_of(end)), "doc": _doc(lines, first - 1)})
    if lang in ("php", "cpp", "python"):  # functions inside a class are its methods
        spans = [(d["line_start"], d["line_end"]) for d in defs if d["kind"] == "class"]
        for d in defs:
            if d["kind"] == "function" and any(a < d["line_start"] <= b for a, b in spans):
                d["kind"] = "method"
    refs = [{"kind": "call", "name": m["n"], "line": line_of(m.start())} for m in _CALL.finditer(code) if m.start("n") not in found and m["n"] not in _WORDS]
    for kind, rule in _REFS_RE.get(lang, ()):
        for m in rule.finditer(code):
            for part in m["n"].split(","):
                name = re.split(r"[.:\\]", re.sub(r"<.*", "", part).strip())[-1]
                if name:
                    refs.append({"kind": kind, "name": name, "line": line_of(m.start("n"))})
    return defs, sorted(refs, key=lambda r: r["line"])


def scan_python(text: str) -> tuple[list[dict], list[dict]] | None:
    """The same of Python by its own grammar; None where the text has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    defs, refs = [], []
    for parent in ast.walk(tree):
        for node in ast.iter_child_nodes(parent):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if isinstance(parent, ast.ClassDef) else "function"
                defs.append({"kind": kind, "name": node.name, "line_start": node.lineno, "line_end": node.end_lineno, "doc": ast.get_docstring(node) or ""})
            elif isinstance(node, ast.Call):
                f = node.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    refs.append({"kind": "call", "name": name, "line": node.lineno})
    return sorted(defs, key=lambda d: (d["line_start"], d["line_end"])), sorted(refs, key=lambda r: r["line"])
