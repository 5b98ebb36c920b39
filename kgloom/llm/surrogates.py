"""PII surrogates: detected entities are replaced by keyed ones of their own type, gender, script and format.

Digits go through a keyed permutation of all digit strings of their length (a balanced Feistel network, walked
on until the result is valid for the type, as the original was), so different numbers stay different by
construction; a phone number keeps its country code and trunk zero, and its national number has one surrogate with and
without them.  Names and mail addresses are drawn from keyed streams: an address keeps its shape, a name keeps gender,
script and number of parts.

A person is known by first names and surname, and each piece of a name has its own surrogate: "Mr John Smith", "Mr Smith"
and "Prof Smith" share a surname in all documents.  A name is detected after a title; in a document that has one, later
and earlier mentions without title of its surname, its first names, or both go too, also in capitals.  First names of one
surname keep apart, where needed by another first name for that person.  A title without gender takes the gender that the
same name has elsewhere in the document, else that of the first name.

Drawn surrogates are checked for collisions among all distinct entities and with them, as the text shows them
(surnames and mail addresses each among all documents, first names among those of one surname); losers (all but the
least entity) draw again, longer every third time, until none collide; if some still do after all rounds, that is an
error.  Only those exceptions are a table; it is sent to the tasks within ``MAX_SENT`` rows and joined beyond.

Defined cases: null text stays null; a text without entities is unchanged; long texts are read whole; equal rows get
equal replacements; overlapping matches go to the longest of the leftmost; other columns are ignored.  A name that no
title announces anywhere in its document is not detected; a common word written like a detected name is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

MAX_SENT = 200_000

#: Titles that announce a name, by the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "x", "Prof": "x", "Г-н": "m", "Г-жа": "f", "Κος": "m", "Κα": "f"}
#: First names by script and gender: to tell the gender of a name, and to draw from.
FIRST = {
    ("latin", "f"): "Anna Maria Laura Julia Clara Elena Sophie Emma Alice Lucia Nora Ida Marta Greta Paula Irene Rosa Diana Vera Olivia".split(),
    ("latin", "m"): "Paul Peter Thomas Daniel Martin Lucas Oscar Victor Simon Hugo Felix Leon Bruno Carlos Jorge Henri Louis Otto Karl James".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Вера Нина Дарья Алина".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ειρήνη Δήμητρα Χριστίνα".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Γιάννης Πέτρος Παύλος Δημήτρης Ανδρέας".split(),
    ("cyrillic", "m"): "Иван Пётр Олег Антон Павел Сергей Максим Борис Юрий Егор".split(),
}
_SYLLABLE = {
    "latin": "ba be bo da de do fa fe ga go ha ka ko la le lo ma me mo na ne no pa ra re ro sa se so ta te to va ve vo wa we za".split(),
    "cyrillic": "ба бе бо ва ве во га да де до за ка ко ла ле ло ма ме мо на не но па ра ре ро са се со та то".split(),
    "greek": "βα βε γα γο δα δε ζα κα κο λα λε λο μα με μο να νε νο πα πο ρα ρο σα σε σο τα τε το φα χα".split(),
}
#: Ends of surnames by script; the Cyrillic feminine adds one letter to the masculine, as the original does.
_TAIL = {"latin": "", "cyrillic": "в", "greek": ""}
_FEMININE = ("ова", "ева", "ёва", "ина", "ына")
_GENDER = {n: g for (_, g), names in FIRST.items() for n in names}

_TITLE = r"(?<!\w)(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.? "
_INITIALS = r"(?:[^\W\d_a-zа-яα-ω]\. ?){0,3}"
_PIECE = r"[^\W\d_a-zа-яα-ω](?:['’][^\W\d_])?[^\W\d_]+"
_CAPITAL = re.compile(rf"(?<!\w){_PIECE}(?!\w)")

PATTERNS = {
    "email": r"(?<![\w.+-])[\w+-](?:[\w.+-]{0,62}[\w+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,8}){2,4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"{_TITLE}{_INITIALS}(?!{_TITLE}){_PIECE}(?:[ -](?!{_TITLE}){_PIECE}){{0,2}}",
}
#: Order in which patterns claim a place of the text.
_ORDER = ("email", "iban", "ipv4", "ssn", "card", "phone", "name")
_ANY = re.compile("|".join(f"(?P<{k}>{PATTERNS[k]})" for k in _ORDER))
_SIGN = re.compile("[@0-9]")
_REACH = 160  # characters on either side of a sign that can belong to its entity, to the next blank


def _zones(text: str) -> list[tuple[int, int]]:
    """The parts of a text that hold a sign of an entity: an @, a digit or a title."""
    at = [m.start() for m in _SIGN.finditer(text)]
    for t in TITLES:
        i = text.find(t)
        while i >= 0:
            at.append(i)
            i = text.find(t, i + len(t))
    zones: list[tuple[int, int]] = []
    for p in sorted(at):
        if zones and p < zones[-1][1] - _REACH:
            continue
        a, b = text.rfind(" ", 0, max(0, p - _REACH)) + 1, text.find(" ", min(len(text), p + 2 * _REACH))
        b = len(text) if b < 0 else b
        if zones and a <= zones[-1][1]:
            zones[-1] = zones[-1][0], b
        else:
            zones.append((a, b))
    return zones


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def ssn_valid(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def iban_valid(compact: str) -> bool:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def script_of(word: str) -> str:
    """latin, cyrillic or greek; else the first code point of the block of 128 that the word begins in."""
    c = ord(word[0])
    return "latin" if c < 0x370 or 0x1E00 <= c < 0x1F00 else "greek" if c < 0x400 or 0x1F00 <= c < 0x2000 else "cyrillic" if c < 0x530 else str(c & ~127)


def _letters(block: str) -> list[str]:
    """The caseless letters of a block of 128 code points, else syllables."""
    return [c for c in map(chr, range(int(block), int(block) + 128)) if unicodedata.category(c) == "Lo"] or _SYLLABLE["latin"]


#: Country codes of one and two digits; all others have three.
_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}


def national(phone: str) -> tuple[str, str]:
    """What stays of a phone number (country code, trunk zeros), and its national digits."""
    digits = "".join(c for c in phone if c.isdigit())
    code = next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3]) if phone.startswith("+") else ""
    rest = digits[len(code) :]
    own = rest.lstrip("0")
    return code + rest[: len(rest) - len(own)], own


def phone_valid(own: str) -> bool:
    """Ten digits: area and exchange begin with 2 to 9."""
    return own[0] != "0" and (len(own) != 10 or (own[0] > "1" and own[3] > "1"))


def surname_stem(piece: str) -> tuple[str, str]:
    """The form that a surname piece shares with its feminine, and the ending that makes the feminine."""
    return (piece[:-1], "а") if piece.endswith(_FEMININE) else (piece, "")


def _people(text: str, titled: list[tuple[int, int, str, str]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str]]:
    """The titled names with their gender resolved, and the mentions of their parts without title."""
    known: dict[str, str] = {}  # name to the gender that a title tells
    for _, _, gender, name in titled:
        if gender != "x":
            known.setdefault(name, gender)
    full: dict[str, str] = {}  # name of several parts to its form
    first: dict[str, str] = {}  # first name to the form of the first person who has it
    last: set[str] = set()
    alone = []
    for a, b, gender, name in titled:
        *given, surname = name.split(" ")
        if not given:
            alone.append((a, b, gender, name))
            continue
        if gender == "x":
            gender = known.get(name) or _GENDER.get(given[0], "x")
        form = f"{gender}|{' '.join(given)}|{surname}"
        full.setdefault(name, form)
        for g in given:
            first.setdefault(g, form)
        last.add(surname)
        yield a, b, "name", form
    for a, b, gender, name in alone:
        if name in first and name not in last:
            yield a, b, "first", first[name]
        else:
            last.add(name)
            yield a, b, "name", f"{gender}||{name}"
    names = {n: ("name", f) for n, f in full.items()} | {n: ("first", f) for n, f in first.items() if n not in last} | {n: ("name", f"x||{n}") for n in last}
    names |= {n.upper(): v for n, v in names.items() if n.upper() not in names}
    most = max(n.count(" ") + n.count("-") for n in names) + 1
    words, i, at = [(m.start(), m.end()) for m in _CAPITAL.finditer(text)], 0, 0
    taken = sorted(taken)
    while i < len(words):
        a = words[i][0]
        for n in range(most, 0, -1):
            run = words[i : i + n]
            if len(run) == n and all(q - p == 1 and text[p] in " -" for (_, p), (q, _) in zip(run, run[1:], strict=False)) and (got := names.get(text[a : run[-1][1]])):
                break
        else:
            i += 1
            continue
        b = run[-1][1]
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            yield a, b, *got
        i += n


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of each entity; a name's span leaves its title out.

    A name's form is gender|first names|surname; the type of a mention of its first name alone is ``first``.
    """
    found, titled = [], []
    for m in (m for a, b in _zones(text) for m in _ANY.finditer(text, a, b)):
        kind, whole, start = m.lastgroup, m[0], m.start()
        digits = "".join(c for c in whole if c.isdigit())
        if kind == "card" and not (luhn(digits) and digits[0] in "23456"):
            continue
        if kind == "iban" and not iban_valid(whole.replace(" ", "")):
            continue
        if kind == "phone" and not (7 <= len(digits) <= 15 and national(whole)[1]):
            continue
        if kind == "name":
            title, name = re.match(rf"([^ .]+)\.? {_INITIALS}(.*)", whole, re.DOTALL).groups()
            titled.append((m.end() - len(name), m.end(), TITLES[title], name))
        else:
            form = whole.lower() if kind == "email" else whole if kind == "ipv4" else whole.replace(" ", "") if kind == "iban" else national(whole)[1] if kind == "phone" else digits
            found.append((start, m.end(), kind, form))
    return sorted([*found, *_people(text, titled, [x[:2] for x in (*found, *titled)])]) if titled else found


def drawn_parts(kind: str, form: str) -> list[tuple[str, str]]:
    """The drawn surrogates that an entity needs: (email, address), (given, form of the person), (surname, stem)."""
    if kind == "email":
        return [(kind, form)]
    if kind not in ("name", "first"):
        return []
    _, given, surname = form.split("|")
    return [*([("given", form)] if given else []), *(("surname", surname_stem(x)[0]) for x in surname.split("-") if x)]


class Surrogates:
    """Surrogates under a key; ``again`` holds the number of redraws of entities that collided."""

    def __init__(self, key: bytes, again: dict[tuple[str, str], int] | None = None) -> None:
        self.key, self.again, self.known = key, again or {}, {}

    def _stream(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")

    def permute(self, digits: str, salt: str) -> str:
        """A keyed permutation of the digit strings of this length."""
        if len(digits) < 2:
            return str((int(digits or 0) + self._stream(salt, "one")) % 10) if digits else ""
        half = len(digits) // 2
        a, b = digits[:half], digits[half:]
        for r in range(8):
            a, b = b, str((int(a) + self._stream(salt, r, b)) % 10 ** len(a)).zfill(len(a))
        return a + b if len(a) + len(b) == len(digits) else digits

    def _walked(self, digits: str, salt: str, valid) -> str:
        out = self.permute(digits, salt)
        for _ in range(100_000):
            if valid(out):
                return out
            out = self.permute(out, salt)
        raise RuntimeError(f"no valid surrogate of this {salt} found")

    def canonical(self, kind: str, form: str, draw: int | None = None) -> str:
        """The surrogate's canonical form."""
        n = self.again.get((kind, form), 0) if draw is None else draw
        if kind == "card":
            return self._walked(form, "card", lambda x: luhn(x) and x[0] in "23456")
        if kind == "ipv4":
            old = "".join(f"{int(x):03d}" for x in form.split("."))
            new = self._walked(old, "ipv4", lambda x: all(int(x[i : i + 3]) < 256 for i in range(0, 12, 3)))
            return ".".join(str(int(new[i : i + 3])) for i in range(0, 12, 3))
        if kind == "ssn":  # valid ones stay valid, and the others invalid
            return self._walked(form, kind, lambda x: ssn_valid(x) == ssn_valid(form))
        if kind == "phone":
            return self._walked(form, kind, lambda x: phone_valid(x) == phone_valid(form))
        if kind == "iban":
            body = self.permute("".join(c for c in form[4:] if c.isdigit()), "iban")
            letters = iter(body)
            body = "".join(next(letters) if c.isdigit() else c for c in form[4:])
            check = 98 - int("".join(str(int(c, 36)) for c in body + form[:2] + "00")) % 97
            return f"{form[:2]}{check:02d}{body}"
        if kind == "email":
            s = self._stream("email", form, n)
            local, domain = form.rsplit("@", 1)
            pool = _SYLLABLE["latin"]
            out = []
            for i, run in enumerate(re.findall(r"[^\W\d_]+|\d+|[\W_]", local)):
                t = self._stream("part", s, i)
                out.append("".join(pool[(t >> (6 * j)) % len(pool)] for j in range(max(2, (len(run) + 1) // 2) + n // 3)) if run.isalpha() else str(t % 10 ** len(run)).zfill(len(run)) if run.isdigit() else run)
            return "".join(out) + f"@{pool[s % len(pool)]}{pool[(s >> 8) % len(pool)]}{(s >> 16) % 1000}.example.{domain.rsplit('.', 1)[1]}"
        if kind == "surname":
            script = script_of(form)
            t = self._stream(kind, form, n)
            pool = _SYLLABLE.get(script) or _letters(script)
            size = (4 if script in _SYLLABLE else len(form)) + n // 3
            return "".join(pool[(t >> (8 * j)) % len(pool)] for j in range(size)).capitalize() + _TAIL.get(script, "")
        # first names: those of one surname draw apart from their second draw on
        gender, given, surname = form.split("|")
        out = []
        for i, part in enumerate(re.split("[ -]", given)):
            script = script_of(part)
            pool = [x for g in ("f", "m") if gender in (g, "x") for x in FIRST.get((script, g), _letters(script) if script not in _SYLLABLE else []) if x != part]
            t = self._stream("given", gender, part, *((n, surname, i) if n else ()))
            size = 1 + n // 3 if script in _SYLLABLE else len(part) + n // 3
            out.append("".join(pool[(t >> (8 * j)) % len(pool)] for j in range(size)).capitalize())
        return " ".join(out)

    def _known(self, kind: str, form: str) -> str:
        if (new := self.known.get((kind, form))) is None:
            if len(self.known) > 100_000:
                self.known.clear()
            new = self.known[kind, form] = self.canonical(kind, form)
        return new

    def written(self, kind: str, form: str, old: str) -> str:
        """The surrogate in the way the mention is written."""
        if kind in ("name", "first"):
            _, given, surname = form.split("|")
            own = dict(zip(re.split("[ -]", given), self._known("given", form).split(" "), strict=True)) if given else {}
            ends = {}
            for piece in surname.split("-"):
                stem, end = surname_stem(piece)
                ends[piece] = self._known("surname", stem) + end
            words = re.split("([ -])", old)
            last = 0 if kind == "first" else len(surname.split("-"))
            edge = len(words) - (2 * last - 1) if last else len(words)
            own, ends = ({k.upper(): v for k, v in x.items()} for x in (own, ends))
            new = [w if w in " -" else (own if i < edge else ends)[w.upper()] for i, w in enumerate(words)]
            return "".join(n.upper() if w.isupper() and len(w) > 1 and n != w and w.upper() != w.lower() else n for n, w in zip(new, words, strict=True))
        new = self._known(kind, form)
        if kind == "phone":
            new = national(old)[0] + new
        if kind in ("card", "ssn", "phone", "iban"):
            chars = iter(new)
            return "".join(next(chars) if c.isalnum() else c for c in old)
        return new.upper() if kind == "email" and old.isupper() else new

    def replace(self, text: str) -> tuple[str, list[dict]]:
        out, at, spans = [], 0, []
        for a, b, kind, form in find(text):
            new = self.written(kind, form, text[a:b])
            out += [text[at:a], new]
            spans.append({"start": a, "end": b, "kind": "name" if kind == "first" else kind, "surrogate": new})
            at = b
        return "".join([*out, text[at:]]) if spans else text, spans


def _redraws(docs: DataFrame, key: bytes, rounds: int = 20) -> DataFrame:
    """(kind, form, draw) of the entities whose first surrogate collided with another's or with an entity."""

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sorted({x for t in batch.column("text").to_pylist() if t for _, _, k, f in find(t) for x in drawn_parts(k, f)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.string()) for i in (0, 1)], names=["kind", "form"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "form", "draw")), strict=True)
            new = [make.canonical(*x) for x in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "form", "draw")), pa.array(new, pa.string())], names=["kind", "form", "draw", "new"])

    kind = "kind string, form string, draw int, new string"
    now = stored(docs.select("text").mapInArrow(entities, "kind string, form string").distinct().withColumn("draw", F.lit(0)).mapInArrow(drawn, kind), "entities")
    # first names are compared among those of one surname, whatever the gender
    person = F.col("kind") == "given"
    shown = F.when(person, F.concat_ws("|", "new", F.substring_index("form", "|", -1))).otherwise(F.col("new"))
    for done in range(rounds + 1):
        seen = now.withColumn("shown", shown)
        first = seen.groupBy("kind", "shown").agg(F.min("form").alias("least"), F.count(F.lit(1)).alias("c"))
        taken = now.filter(~person).select("kind", F.col("form").alias("shown")).distinct().withColumn("real", F.lit(True))
        marked = seen.join(first, ["kind", "shown"]).join(taken, ["kind", "shown"], "left").withColumn("bad", ((F.col("c") > 1) & (F.col("form") != F.col("least"))) | F.col("real").isNotNull())
        bad = marked.filter("bad").select("kind", "form", (F.col("draw") + 1).alias("draw"))
        if bad.isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"surrogates still collide after {rounds} rounds of redraws")
        now = stored(marked.filter("not bad").select("kind", "form", "draw", "new").unionByName(bad.mapInArrow(drawn, kind)), "entities")
    return now.filter("draw > 0").select("kind", "form", "draw")


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, entities (start, end, kind, surrogate): a row for each row."""
    again = stored(_redraws(docs, key), "redraws")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    many = again.count()
    sent = None
    if many <= MAX_SENT:
        sent = docs.sparkSession.sparkContext.broadcast({(x["kind"], x["form"]): x["draw"] for x in again.collect()})
        rows = rows.withColumn("again", F.lit(None).cast("array<struct<kind:string,form:string,draw:int>>"))
    else:

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(d, k, f) for d, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for _, _, kind, form in find(t) for k, f in drawn_parts(kind, form)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), *(pa.array([x[i] for x in got], pa.string()) for i in (1, 2))], names=["row", "kind", "form"])

        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
        own = rows.mapInArrow(mentions, "row long, kind string, form string").join(again, ["kind", "form"]).groupBy("row").agg(F.collect_set(F.struct("kind", "form", "draw")).alias("again"))
        rows = rows.join(own, "row", "left").select("doc_id", "text", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key, sent.value if sent else None)
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())]))
        for batch in batches:
            out = []
            for text, extra in zip(batch.column("text").to_pylist(), batch.column("again").to_pylist(), strict=True):
                if extra:
                    make.again = {(x["kind"], x["form"]): x["draw"] for x in extra}
                    make.known = {}
                out.append(make.replace(text) if text else (text, []))
                if extra:
                    make.again, make.known = {}, {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([len(x[1]) for x in out], pa.int64()), pa.array([x[1] for x in out], spans)], names=["doc_id", "text", "n_entities", "entities"])

    return rows.mapInArrow(run, "doc_id long, text string, n_entities long, entities array<struct<start:int,end:int,kind:string,surrogate:string>>")
