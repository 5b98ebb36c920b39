"""Secret scan: candidate strings, and a random forest that removes false positives.

Candidates are runs of ``LEAST`` or more token characters that mix character classes, found on the bytes of a batch.  A candidate's
features are its length, entropy, how likely the transitions between its characters are in the corpus (``count_transitions``: all texts are
counted), how often its character classes change, how much of it dictionary
words cover, whether it lies in a path or address, and the words beside it.  The forest (bagged CART trees
over binned features) is fitted on the driver on at most ``max_findings`` labelled findings.  Where a repository has
none, ``example_findings`` makes a seeded set of typical true and false ones.

Defined cases: null or empty texts have no candidates; without labelled findings, or with one label only, every
score is the share of label 1 (0.5 with none); a run shorter than ``LEAST`` or of one character class is no candidate, a longer one is
scored on all of it; without counted transitions, or in an empty corpus, all are equally likely; repeated findings
are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import _is, slices, span_bounds, string_buffers
from .shared import sparing

LEAST = 8
_TOKEN = _is((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)) | _is((0x2B, 0x2B), (0x2D, 0x2F)) | _is((0x5F, 0x5F), (0x7E, 0x7E))
_DIGIT, _UP, _LOW = _is((0x30, 0x39)), _is((0x41, 0x5A)), _is((0x61, 0x7A))
#: Words of the kind that names, paths and identifiers are made of.
DICTIONARY = frozenset(
    "the and for with from this that test user users name file files path data base image index main page home config model table value type class method "
    "function return string number array object public private static import export module package service server client request response error example "
    "default version build release debug local remote temp cache log logs src lib bin usr var etc opt docs doc html http https www com org net json xml yaml".split()
)
NAMING = frozenset("token key secret password passwd pwd api apikey auth bearer credential credentials access private aws signature".split())
HARMLESS = frozenset("sha sha1 sha256 md5 hash checksum commit digest uuid guid id integrity etag revision blob path url file version image".split())
FEATURES = ("length", "entropy", "digits", "uppers", "marks", "transitions", "hex", "covered", "vowels", "slashes", "dots", "repeats", "path", "assigned", "quoted", "named", "harmless", "uuid", "likely")

#: Classes of characters between which transitions are counted: each letter, digits, all others.
_CLASSES = 28
_CLASS = np.full(256, 27, np.uint8)
_CLASS[0x30:0x3A] = 26
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = np.arange(26)
EVEN = np.full((_CLASSES, _CLASSES), -math.log2(_CLASSES))


def count_transitions(docs: DataFrame) -> np.ndarray:
    """log2 of how often a class follows another in the texts, one added to each count; the driver gets 784 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CLASSES * _CLASSES, np.int64)
        for batch in batches:
            for part in slices(batch.column("text")):
                data, offsets = string_buffers(part)
                kinds = _CLASS[data].astype(np.int16)
                pairs = kinds[:-1] * _CLASSES + kinds[1:]
                keep = np.ones(len(pairs), bool)
                inner = offsets[(offsets > 0) & (offsets < len(data))]
                keep[inner - 1] = False
                total += np.bincount(pairs[keep], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pair", "n"])

    found = docs.select("text").mapInArrow(sparing(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.ones(_CLASSES * _CLASSES)
    for r in found:
        table[r["pair"]] += r["n"]
    table = table.reshape(_CLASSES, _CLASSES)
    return np.log2(table / table.sum(1, keepdims=True))


def candidates(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and the row, start and end of each candidate in them; up to two = that end a run belong to it, one between two runs does not."""
    data, offsets = string_buffers(column)
    starts, ends, _ = span_bounds(_TOKEN[data], offsets)
    stop = offsets[np.searchsorted(offsets, starts, "right")] if len(starts) else starts
    padded = np.append(data, np.zeros(3, np.uint8))
    more = np.where(ends < stop, padded[ends] == 0x3D, False).astype(np.int64)
    more += (more > 0) & (ends + 1 < stop) & (padded[ends + 1] == 0x3D)
    goes_on = (ends + more < stop) & _TOKEN[padded[ends + more]]
    ends = ends + np.where(goes_on, 0, more)
    keep = ends - starts >= LEAST
    starts, ends = starts[keep], ends[keep]
    count = lambda t: np.array([int(t[data[a:b]].sum()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    digit, up, low = count(_DIGIT), count(_UP), count(_LOW)
    mixed = ((digit >= 1) & (up + low >= 1)) | ((up >= 2) & (low >= 2))
    starts, ends = starts[mixed], ends[mixed]
    return data, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(token: str, before: str, after: str, table: np.ndarray = EVEN) -> list[float]:
    n = len(token)
    classes = _CLASS[np.frombuffer(token.encode(), np.uint8)]
    counts = Counter(token)
    kinds = [_kind(c) for c in token]
    parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token)]
    near = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", before[-40:])][-4:] + [w.lower() for w in re.findall(r"[A-Za-z0-9]+", after[:24])][:2]
    letters = [c for c in token.lower() if c.isalpha()]
    return [
        math.log(n), -sum(c / n * math.log2(c / n) for c in counts.values()), kinds.count(0) / n, kinds.count(1) / n, kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), float(all(c in "0123456789abcdefABCDEF-" for c in token)),
        sum(len(p) for p in parts if p in DICTIONARY) / n, sum(c in "aeiou" for c in letters) / max(1, len(letters)), token.count("/") / n, token.count(".") / n,
        sum(a == b for a, b in zip(token, token[1:], strict=False)) / max(1, n - 1), float(bool(re.search(r"(https?:|[/\\~.]|\w:)$", before.rstrip()[-8:]) or token.startswith(("/", "./", "../")))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before[-6:]))), float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before)), float(any(w in NAMING for w in near)),
        float(any(w in HARMLESS for w in near)), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", token))),
        float(table[classes[:-1], classes[1:]].mean()),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, the left child (the right one follows), value."""

    share: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    table: np.ndarray = field(default_factory=lambda: EVEN)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.share)
        total = np.zeros(len(x))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while len(go := np.flatnonzero(feature[at] >= 0)):
                a = at[go]
                at[go] = left[a] + (x[go, feature[a]] > threshold[a])
            total += value[at]
        return total / len(self.trees)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 11) -> Forest:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Forest(share, [])
    rng, tried = np.random.default_rng(seed), max(1, round(math.sqrt(x.shape[1])))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 32))) for f in range(x.shape[1])]
    grown = []
    for _ in range(trees):
        rows0 = rng.integers(0, len(y), len(y))
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, rows0, 0)]
        while todo:
            node, rows, level = todo.pop()
            p = float(y[rows].mean())
            nodes[node][3] = p
            if level >= depth or len(rows) < 2 * least or p in (0.0, 1.0):
                continue
            best = (1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], tried, replace=False).tolist():
                right = x[rows, f][:, None] > cuts[f][None, :]
                n1 = right.sum(0)
                n0 = len(rows) - n1
                s1 = (right * y[rows][:, None]).sum(0)
                s0 = y[rows].sum() - s1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((n1 >= least) & (n0 >= least), s1**2 / n1 + s0**2 / n0 - len(rows) * p**2, -1)
                if gain.max(initial=-1) > best[0]:
                    best = float(gain.max()), f, float(cuts[f][gain.argmax()])
            if best[1] < 0:
                continue
            goes = x[rows, best[1]] > best[2]
            nodes[node][:3] = best[1], best[2], len(nodes)
            for side in (~goes, goes):
                nodes.append([-1, 0.0, 0, 0.0])
                todo.append((len(nodes) - 1, rows[side], level + 1))
        t = np.array(nodes)
        grown.append((t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3]))
    return Forest(share, grown)


def example_findings(n: int = 2400, seed: int = 23) -> list[tuple[str, str, str, int]]:
    """(before, token, after, label): typical true and false findings, half of each."""
    rng = random.Random(seed)
    words = sorted(DICTIONARY)
    hexs, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    syllables = "ka to ri ne so la mi da ther ing ation ver ung lich cion mente eau".split()
    out = []
    for i in range(n):
        word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        if i % 2:
            token = rng.choice([pick(hexs, rng.choice([32, 40, 48, 64])), pick(b64, rng.randint(20, 64)), pick(b64[:62], rng.randint(24, 48)), "AK" + pick(b64[:26] + "234567", 18), rng.choice(["pk_", "sk_", "tok-", "gh_"]) + pick(b64[:62], rng.randint(24, 40))])
            if i % 8 == 1:  # passwords: short, beside a name of the kind
                token = pick(b64[:62] + "-_+", rng.randint(8, 15)) + rng.choice("0123456789") + rng.choice("ABCDEFGH")
            elif i % 8 == 3:  # parts joined by marks: numbers of an account and a random tail, or signed claims
                token = rng.choice([f"xo{pick('abprs', 2)}-{pick('0123456789', 12)}-{pick('0123456789', 12)}-{pick(b64[:62], 24)}", f"eyJ{pick(b64[:62], 20)}.eyJ{pick(b64[:62], rng.randint(20, 60))}.{pick(b64[:62] + '-_', 43)}"])
            q = rng.choice(['"', "'", ""])
            before = rng.choice([f"{rng.choice(sorted(NAMING))}{rng.choice([' = ', '=', ': '])}{q}", f"{word()} {rng.choice(sorted(NAMING))} {q}", f"Authorization: Bearer {q}"])
            out.append((f"{word()} {before}", token, f"{q} {word()}", 1))
        else:
            kind = rng.randrange(12)
            before, after = f"{word()} ", f" {word()}"
            if kind == 0:
                token = "/".join(rng.choice(words) for _ in range(rng.randint(4, 7))) + f"/{word()}{rng.randint(1, 99)}.html"
                before += rng.choice(["https://", "/", "file: "])
            elif kind == 1:
                token = "".join(rng.choice(words).capitalize() for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 9))
            elif kind == 2:
                token, before = pick(hexs, rng.choice([32, 40, 64])), f"{word()} {rng.choice(['sha256', 'md5', 'commit', 'checksum', 'etag', 'revision'])}{rng.choice([':', ' ', ' = '])}"
            elif kind == 3:
                h = pick(hexs, 32)
                token, before = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f"{word()} {rng.choice(['uuid', 'id', 'guid'])} "
            elif kind == 4:
                token = "".join(word() for _ in range(6)) + str(rng.randint(0, 9))
            elif kind == 5:
                token = rng.choice("ax0-=") * rng.randint(10, 30) + "a1" + rng.choice("ax0") * 8
            elif kind == 6:
                token, before = rng.choice(["YOUR_API_KEY_HERE_1", "xxxxxxxxxxxxxxxxxxx1", "changeme-changeme-1", "EXAMPLE0000000000KEY"]), f"{word()} key = \""
            elif kind == 7:  # identifiers, also beside the word key
                token = "_".join(rng.choice(words) for _ in range(rng.randint(2, 5))) + f"_{rng.choice(['v', ''])}{rng.randint(1, 2030)}"
                before = f"{word()} {rng.choice(['primary key', 'foreign key', 'column', 'field', 'key ='])} "
            elif kind == 8:  # integrity values
                token, before = rng.choice(["sha256-", "sha384-", "sha512-"]) + pick(b64, rng.choice([43, 64, 86])) + "==", f"{word()} {rng.choice(['integrity', 'integrity='])}{rng.choice([' ', chr(34)])}"
            elif kind == 9:  # words of the text with digits and capitals
                token = word() + word().capitalize() + word() + str(rng.randint(0, 99))
            elif kind == 10:
                token, before = pick(hexs, rng.choice([8, 12, 40, 48, 64])), f"{word()} {word()} {rng.choice(['at', 'from', 'in', 'revision', 'blob'])} "
            else:
                token = f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-00Z"
            out.append((before, token, after, 0))
    return out


def fit_secrets(findings: list[tuple[str, str, str, int]], max_findings: int = 20_000, table: np.ndarray = EVEN, **settings) -> Forest:
    """Fit on labelled findings (before, token, after, label); the first ``max_findings`` in a seeded order; ``table`` of ``count_transitions``."""
    rows = list(findings)
    random.Random(1).shuffle(rows)
    rows = rows[:max_findings]
    x = np.array([features(t, b, a, table) for b, t, a, _ in rows]) if rows else np.zeros((0, len(FEATURES)))
    return replace(fit_forest(x, np.array([y for *_, y in rows], float), **settings), table=table)


def scan_secrets(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """doc_id, start and end (bytes in the text's UTF-8), token, score, secret: a row for each candidate."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = string_buffers(batch.column("text"))
            data, row, starts, ends = candidates(batch.column("text"))
            tokens, rows = [], []
            for r, a, b in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True):
                lo, hi = offsets[r], offsets[r + 1]
                token = data[a:b].tobytes().decode()
                tokens.append(token)
                rows.append(features(token, data[max(lo, a - 64) : a].tobytes().decode(errors="ignore"), data[b : min(hi, b + 40)].tobytes().decode(errors="ignore"), sent.value.table))
            score = sent.value.score(np.array(rows).reshape(len(rows), len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(starts - offsets[row]), pa.array(ends - offsets[row]), pa.array(tokens, pa.string()), pa.array(score), pa.array(score >= threshold)],
                names=["doc_id", "start", "end", "token", "score", "secret"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, token string, score double, secret boolean")
