"""Full-text search over names and observations."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, tokens_of
from ..sources.inverted import BODY, NAME, TextIndex
from ..sources.store import KG

K1, B = 1.2, 0.75
MAX_LIMIT = 1000


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens, the last of which may be a prefix; ``initial`` if they must open the text."""

    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False

    def slots(self) -> list[tuple[str, bool]]:
        """Each word, and whether it is a prefix."""
        return [(w, self.prefix and i == len(self.words) - 1) for i, w in enumerate(self.words)]

    def starts(self, t: Column) -> Column:
        """Where it begins (from 0) in an array of tokens."""

        def equal(token: Column, i: int) -> Column:
            w, prefix = self.slots()[i]
            return token.startswith(w) if prefix else token == w

        def at_offset(k: int) -> Callable[[Column], Column]:
            return lambda i: equal(F.get(t, i + k), k)

        at = F.when(F.size(t) >= len(self.words), F.sequence(F.lit(0), F.size(t) - len(self.words))).otherwise(F.array().cast("array<int>"))
        for k in range(len(self.words)):  # each word is looked at only where those before it are
            at = F.filter(at, at_offset(k))
        return self._opening(at)

    def starts_in(self, positions: dict[tuple[str, bool], Column]) -> Column:
        """The same by the positions of each word."""

        def follows(k: int) -> Callable[[Column], Column]:
            return lambda p: F.array_contains(positions[self.slots()[k]], p + k)

        at = positions[self.slots()[0]]
        for k in range(1, len(self.words)):
            at = F.filter(at, follows(k))
        return self._opening(at)

    def _opening(self, at: Column) -> Column:
        return F.filter(at, lambda p: p == 0) if self.initial else at


def _windows(first: int, members: list[int], reach: int) -> Column:
    """Windows (a, b) from each place of phrase ``first`` on in which all members begin."""

    def whole(at: Column) -> Column:
        tests = [F.exists(F.col(f"s{j}"), lambda q: (q >= at) & (q <= at + reach)) for j in members]
        return reduce(Column.__and__, tests)

    return F.transform(F.filter(F.col(f"s{first}"), whole), lambda at: F.struct(at.alias("a"), (at + reach).alias("b")))


def _inside(windows: Column) -> Callable[[Column], Column]:
    return lambda q: F.exists(windows, lambda w: (q >= w["a"]) & (q <= w["b"]))


@dataclass(frozen=True)
class Query:
    """Phrases, and which must match: a tree of ("phrase", i), ("near", [i, ...], tokens), "and", "or", "not"."""

    phrases: tuple[Phrase, ...]
    tree: tuple

    def slots(self) -> list[tuple[str, bool]]:
        return sorted({s for p in self.phrases for s in p.slots()})

    def near(self) -> list[tuple]:
        """The groups of phrases that must stand near each other."""

        def walk(node: tuple) -> list[tuple]:
            return [node] if node[0] == "near" else [] if node[0] == "phrase" else [x for part in node[1:] for x in walk(part)]

        return walk(self.tree)

    def counted(self, rows: DataFrame, starts: list[Column]) -> DataFrame:
        """entity_id, len, tf0... (occurrences that match), all0... (all occurrences) of rows whose phrases begin at ``starts``.

        Phrases of a near group count where a window has all of them: from the end of its first one to the begin of its last
        one are at most the group's number of tokens.
        """
        n = len(self.phrases)
        own = rows.select("entity_id", "len", *(s.alias(f"s{i}") for i, s in enumerate(starts)))
        kept = {i: F.col(f"s{i}") for i in range(n)}
        for g, (_, members, most) in enumerate(self.near()):
            windows = [_windows(i, members, len(self.phrases[i].words) + most) for i in members]
            all_there = reduce(Column.__and__, [F.size(f"s{i}") > 0 for i in members])
            # a generator keeps the windows of a row from being found anew for each place that is held against them
            found = F.when(all_there, F.flatten(F.array(*windows))).otherwise(F.array().cast("array<struct<a: int, b: int>>"))
            own = own.withColumn(f"near{g}", F.explode(F.array(found)))
            for i in members:
                kept[i] = F.filter(F.col(f"s{i}"), _inside(F.col(f"near{g}")))
        return own.select("entity_id", "len", *(F.size(kept[i]).alias(f"tf{i}") for i in range(n)), *(F.size(f"s{i}").alias(f"all{i}") for i in range(n)))

    def test(self, node: tuple | None = None) -> Column:
        """Whether a row of ``counted`` matches."""
        op, *parts = node or self.tree
        if op == "phrase":
            return F.col(f"tf{parts[0]}") > 0
        if op == "near":
            return F.col(f"tf{parts[0][0]}") > 0
        a, b = (self.test(p) for p in parts)
        return a & b if op == "and" else a | b if op == "or" else a & ~b


_ITEM = re.compile(r'"(?:[^"]|"")*"|[(){}:,+^*-]|[^\s(){}:,+^*"-]+')
NEAR_TOKENS = 10


def parse(text: str, column: str | None = None) -> Query | None:
    """A query over a text of one column.

    Words and phrases side by side are ANDed and bind closest, then NOT, AND, OR; parentheses group.  "..." and words of several tokens are
    phrases, a + b joins them into one, word* is a prefix, ^word opens the text, NEAR(a b, n) wants all within n tokens (10).
    name : x, {name body} : x and - name : x search only the columns said (or all but them).

    None where nothing can match: an empty or malformed query, or a column that isn't ``column``; with None columns are not known.
    """
    if text.count('"') % 2:
        return None
    items = _ITEM.findall(text)
    phrases: list[Phrase] = []
    at = 0

    def peek(ahead: int = 0) -> str | None:
        return items[at + ahead] if at + ahead < len(items) else None

    def take(*wanted: str) -> str:
        nonlocal at
        x = peek()
        if x is None or (wanted and x not in wanted):
            raise ValueError
        at += 1
        return x

    def string() -> tuple[str, ...]:
        x = take()
        if x[0] != '"' and not re.fullmatch(r"\w+", x) or x in ("AND", "OR", "NOT"):
            raise ValueError  # marks other than _ are no part of a bare word
        return tuple(tokens_of(x.strip('"')))

    def phrase() -> int:
        initial = peek() == "^"
        if initial:
            take()
        words = string()
        while peek() == "+":
            take()
            words += string()
        prefix = peek() == "*"
        if prefix:
            take()
        if not words:
            raise ValueError
        phrases.append(Phrase(words, prefix, initial))
        return len(phrases) - 1

    def group() -> tuple:
        if peek() != "NEAR" or peek(1) != "(":
            return "phrase", phrase()
        take(), take()
        members, most = [], NEAR_TOKENS
        while peek() not in (")", ","):
            members.append(phrase())
        if take() == ",":
            most = int(take())
            take(")")
        if not members:
            raise ValueError
        return ("near", members, most) if len(members) > 1 else ("phrase", members[0])

    def columns() -> bool | None:
        """Whether the column said here is searched; None where none is said."""
        nonlocal at
        start, without, said = at, False, []
        if peek() == "-":
            take()
            without = True
        if peek() == "{":
            take()
            while peek() != "}":
                said.append(take())
            take()
        elif peek() is not None:
            said.append(take())
        if peek() != ":" or not said:
            at = start
            return None
        take()
        said = [x.strip('"').lower() for x in said]
        if column is None or any(x != column for x in said):
            raise ValueError
        return (column in said) != without

    def grouped() -> tuple | None:
        """A query in parentheses, if one is next."""
        if peek() != "(":
            return None
        take()
        inner = either()
        take(")")
        return inner

    def primary() -> tuple:
        left = None
        while peek() not in (None, "AND", "OR", "NOT", ")"):
            own = columns()
            inner = grouped() if left is None else None
            if inner:  # nothing is ANDed to parentheses without AND
                return inner if own in (None, True) else ("none", inner)
            part = group()
            part = part if own in (None, True) else ("none", part)
            left = ("and", left, part) if left else part
        if left is None:
            raise ValueError
        return left

    def chain(part: Callable[[], tuple], word: str) -> Callable[[], tuple]:
        def run() -> tuple:
            left = part()
            while peek() == word:
                take()
                left = word.lower(), left, part()
            return left

        return run

    either = chain(chain(chain(primary, "NOT"), "AND"), "OR")
    try:
        tree = _without_none(either())
        return Query(tuple(phrases), tree) if at == len(items) and tree else None
    except ValueError:
        return None


def _without_none(node: tuple) -> tuple | None:
    """A tree without what can't match: columns that are not searched."""
    op, *parts = node
    if op in ("phrase", "near"):
        return node
    if op == "none":
        return None
    a, b = (_without_none(p) for p in parts)
    if op == "or":
        return (op, a, b) if a and b else a or b
    return a if op == "not" and not b else (op, a, b) if a and b else None


def _tokenized(rows: DataFrame, key: str, text: str) -> DataFrame:
    # a generator keeps the tokens from being computed anew for each use of them
    found = F.explode(F.array(F.coalesce(tokens(text), F.array().cast("array<string>"))))
    return rows.select(F.col(key).alias("entity_id"), found.alias("t"))


def name_documents(kg: KG) -> DataFrame:
    """entity_id, t (tokens) of the names."""
    return _tokenized(kg.entities, "id", "name")


def observation_documents(kg: KG) -> DataFrame:
    return _tokenized(kg.observations, "entity_id", "body")


def scanned(docs: DataFrame, query: Query) -> DataFrame:
    """``Query.counted`` of token rows (entity_id, t): every row is read."""
    return query.counted(docs.select("entity_id", "t", F.size("t").alias("len")), [p.starts(F.col("t")) for p in query.phrases])


def looked_up(index: TextIndex, source: str, query: Query) -> DataFrame:
    """``Query.counted`` of the indexed texts that have any word of the query: only the words' postings are read."""
    slots = query.slots()
    hits = index.hits(source, slots)
    if len(slots) == 1 and not slots[0][1]:
        rows, at = hits, {slots[0]: F.col("pos")}
    else:
        of = lambda w, prefix: F.col("term").startswith(w) if prefix else F.col("term") == w
        lists = [F.flatten(F.collect_list(F.when(of(*slot), F.col("pos")))).alias(f"p{j}") for j, slot in enumerate(slots)]
        rows, at = hits.groupBy("entity_id", "idx").agg(F.max("len").alias("len"), *lists), {slot: F.col(f"p{j}") for j, slot in enumerate(slots)}
    return query.counted(rows, [p.starts_in(at) for p in query.phrases])


def ranked(counted: DataFrame, query: Query, totals: DataFrame) -> DataFrame:
    """entity_id, score (BM25) of the rows that match; ``totals`` is one row: rows, avg_len, df0..."""
    found = counted.filter(query.test()).crossJoin(F.broadcast(totals))  # one row

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("rows") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))

    score = part(0)
    for i in range(1, len(query.phrases)):
        score = score + part(i)
    return found.select("entity_id", F.round(score, 9).alias("score"))


def _having(query: Query) -> list[Column]:
    return [F.coalesce(F.sum((F.col(f"all{i}") > 0).cast("long")), F.lit(0).cast("long")).alias(f"df{i}") for i in range(len(query.phrases))]


def bm25(docs: DataFrame, query: Query) -> DataFrame:
    """entity_id, score of the token rows that match.

    One scan gives the counts (rows, average length, rows with each phrase) as a single row, a second one the matching
    rows; nothing is shuffled but that row.
    """
    counted = scanned(docs, query)
    return ranked(counted, query, counted.agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("avg_len"), *_having(query)))


def matching(counted: DataFrame, query: Query) -> DataFrame:
    """entity_ids with a row that matches."""
    return counted.filter(query.test()).select("entity_id").distinct()


def _legs(kg: KG, text: str) -> tuple[DataFrame | None, DataFrame | None]:
    """entity_id, score of matching names; entity_ids of matching observations; None where the query has nothing to match there."""
    names, bodies = parse(text, NAME), parse(text, BODY)
    if kg.text is None:
        return names and bm25(name_documents(kg), names), bodies and matching(scanned(observation_documents(kg), bodies), bodies)
    if names:
        counted = looked_up(kg.text, NAME, names)
        n, size = kg.text.totals(NAME)
        totals = counted.agg(F.lit(n).cast("long").alias("rows"), F.lit(size / n if n else 0.0).alias("avg_len"), *_having(names))
        names = ranked(counted, names, totals)
    return names, bodies and matching(looked_up(kg.text, BODY, bodies), bodies)


def candidates(kg: KG, text: str, cap: int) -> DataFrame | None:
    """entity_id, rank (from 1): the best ``cap`` names, then the first ``cap`` entities by observations, each once."""
    names, bodies = _legs(kg, text)
    legs = []
    if names is not None:
        legs.append(names.orderBy(F.desc("score"), "entity_id").limit(cap).select("entity_id", F.lit(0).alias("leg"), (-F.col("score")).alias("key")))
    if bodies is not None:
        legs.append(bodies.orderBy("entity_id").limit(cap).select("entity_id", F.lit(1).alias("leg"), F.lit(0.0).alias("key")))
    if not legs:
        return None
    once = reduce(DataFrame.unionByName, legs).groupBy("entity_id").agg(F.min(F.struct("leg", "key")).alias("k"))
    # at most 2 * cap rows, so one task ranks them
    return once.select("entity_id", F.row_number().over(Window.orderBy("k.leg", "k.key", "entity_id")).alias("rank"))


def search_ids(kg: KG, text: str, entity_type: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """id, name, type, rank: the type filter comes after the caps, so fewer rows than ``limit`` can be left."""
    found = candidates(kg, text, offset + min(limit, MAX_LIMIT)) if limit > 0 else None
    if found is None:
        return kg.entities.limit(0).select("id", "name", "type").withColumn("rank", F.lit(0))
    few = None
    if kg.layout is not None:  # the caps bound these rows
        got = found.collect()
        found, few = kg.entities.sparkSession.createDataFrame(got, "entity_id long, rank int"), [r["entity_id"] for r in got]
    rows = kg.name_of(few).join(found, F.col("id") == F.col("entity_id")).select("id", "name", "type", "rank")
    if entity_type:
        rows = rows.filter(F.col("type") == entity_type)
    return rows.orderBy("rank").offset(offset).limit(min(limit, MAX_LIMIT))


def search_nodes(kg: KG, text: str, entity_type: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """rank, name, type, observations."""
    found = search_ids(kg, text, entity_type, offset, limit)
    few = None
    if kg.layout is not None:
        got = found.collect()
        found, few = kg.entities.sparkSession.createDataFrame(got, "id long, name string, type string, rank int"), [r["id"] for r in got]
    return kg.nested(found.select("id", "name", "type"), few).join(found.select("id", "rank"), "id").select("rank", "name", "type", "observations").orderBy("rank")


def ui_query(text: str) -> str:
    """The viewer's form of what is typed: words ANDed, the last one a prefix."""
    words = re.findall(r"\w+", text)
    return " ".join([*words[:-1], words[-1] + "*"]) if words else ""


def ui_search(kg: KG, text: str, limit: int = 100) -> DataFrame:
    """rank, name, type, obs_count, has_more."""
    limit = max(1, min(limit, MAX_LIMIT))
    found = search_ids(kg, ui_query(text), None, 0, limit + 1)
    counts = kg.observations.join(found.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("obs_count"))
    more = found.agg((F.count(F.lit(1)) > limit).alias("has_more"))
    page = found.orderBy("rank").limit(limit)
    return page.join(counts, page["id"] == counts["entity_id"], "left").crossJoin(F.broadcast(more)).select("rank", "name", "type", F.coalesce("obs_count", F.lit(0).cast("long")).alias("obs_count"), "has_more")
