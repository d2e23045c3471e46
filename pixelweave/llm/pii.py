"""Personal data: base patterns, and a semi-Markov conditional random field over whole spans.

The base patterns give emails, IPv4 addresses, payment cards and international phone numbers. The field adds what
they miss: it looks at islands, runs of words that hold a digit or an at sign (elsewhere there is no candidate, so
the best labelling of the islands is that of the text), scores every segment of up to LONGEST words as a whole, and one
dynamic program over boundaries and types picks the best labelling; entities are bounded in length, everything else is
single words. It is trained by gradient ascent of the exact likelihood (forward-backward over segmentations) on at most
ISLANDS islands of at most SAMPLE documents (documented bounds, taken by a hash), labelled by the base patterns and by named secrets;
islands with a near miss of a pattern are left out, so the field decides them by their shape.

Base spans stay as they are; a span of the field that overlaps one is dropped. Positions count code points, ends are
exclusive. Null texts are empty and have no spans; repeated rows have equal spans; extra columns are ignored; an empty
table gives no rows. Of equal labellings the one with lower labels wins. The time of a text grows with its length.
"""

from __future__ import annotations

import dataclasses
import json
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import map_arrow, read, text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("", *KINDS)
LONGEST = 4
SAMPLE, ISLANDS, EPOCHS, RATE = 3000, 6000, 6, 0.1

# Patterns that say the same as the plain ones without their quadratic searches: runs begin where no run is under way.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S*[0-9@]\S*")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    if not _TRIGGER.search(text):
        return []
    out: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append(("email", start, m.end()))
            last = m.end()
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


class Taken:
    """The union of spans, for lookups."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        k = bisect_right(self.starts, e - 1) - 1
        return k >= 0 and self.ends[k] > s


@dataclasses.dataclass(frozen=True)
class Island:
    """Words of a run (first and last position, edges without punctuation), and the words before it."""

    words: tuple[tuple[int, int], ...]
    before: tuple[str, str]


_EDGE_L, _EDGE_R = "\"'`([{<|,;:=*#$%&!?", "\"'`)]}>|,;:.*#$%&!?"


def islands(text: str) -> list[Island]:
    """Runs of trigger words that single spaces or other white space part; each word without its edges of punctuation."""
    out: list[Island] = []
    run: list[tuple[int, int]] = []
    end = -1
    for m in _WORD.finditer(text):
        s, e = m.span()
        word = m.group()
        s += len(word) - len(word.lstrip(_EDGE_L))
        e -= len(word) - len(word.rstrip(_EDGE_R))
        if text[s - 1 : s] == "(" and text[e : e + 1] == ")":
            s, e = s - 1, e + 1  # an area code
        if e <= s:
            continue
        if run and m.start() - end == 1:
            run.append((s, e))
        else:
            if run:
                out.append(_island(text, run))
            run = [(s, e)]
        end = m.end()
    if run:
        out.append(_island(text, run))
    return out


def _island(text: str, run: list[tuple[int, int]]) -> Island:
    before = text[max(0, run[0][0] - 48) : run[0][0]].lower().split()[-2:]
    return Island(tuple(run), tuple((["", ""] + [b.strip("\"'") for b in before])[-2:]))


_HEX = re.compile(r"[0-9a-fA-F]+\Z")
_KEYED = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|key)\s*[=:]\s*[\"'`]?")
FEATURES = 64


def features(piece: str, words: int, before: tuple[str, str]) -> list[int]:
    """Numbers of the features that hold for a whole segment."""
    n = sum("0" <= c <= "9" for c in piece)
    letters = sum(c.isalpha() for c in piece)
    out = [0, words, 5 + min(n, 20)]  # up to 25
    out.append(26 + (0 if not letters else 1 if letters < n else 2))
    at = piece.find("@")
    if at >= 0:
        out.append(29)
        out.append(30 if 0 < at and "." in piece[at:] else 31)
    dots = piece.count(".")
    out.append(32 + min(dots, 4))  # to 36
    if dots == 3 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in piece.split(".")):
        out.append(37)
    if piece[0] == "+":
        out.append(38)
    if "(" in piece:
        out.append(39)
    if "-" in piece:
        out.append(40)
    if n == len(piece):
        out.append(41)
        if 13 <= n <= 19:
            out.append(42)
    elif not letters and at < 0 and 13 <= n <= 19:
        out.append(43)
    if len(piece) >= 16 and letters and n and piece.isalnum():
        out.append(44)
        if _HEX.match(piece):
            out.append(45)
        if len(piece) >= 32:
            out.append(46)
    if before[1] in ("=", ":") or before[1][-1:] in ("=", ":"):
        out.append(47)
    if any(w in before[0] or w in before[1] for w in ("token", "secret", "password", "key")):
        out.append(48)
    if "/" in piece or "_" in piece:
        out.append(49)
    if before[1] in ("version", "v", "license,"):
        out.append(50)
    out.append(51 + min(len(piece) // 4, 11))  # to 62
    return out


class Field:
    """Weights of features by label, and of label pairs."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves
        self.columns = weights.T.tolist()
        self.steps = moves.tolist()

    def candidates(self, text: str, island: Island) -> list[list[list[float]]]:
        """Scores by end word, length - 1, label."""
        found = []
        for j in range(len(island.words)):
            row = []
            for size in range(1, min(LONGEST, j + 1) + 1):
                i = j - size + 1
                row.append(features(text[island.words[i][0] : island.words[j][1]], size, island.before if i == 0 else ("", "")))
            found.append(row)
        return found

    def scored(self, found: list) -> list:
        columns = self.columns
        return [[[sum(s) for s in zip(*[columns[f] for f in own], strict=True)] for own in row] for row in found]

    def best(self, text: str, island: Island) -> list[tuple[int, int, int]]:
        """Entities (first word, last word, label) of the best labelling; of equal ones that with shorter segments and lower labels last."""
        scored, labels, steps = self.scored(self.candidates(text, island)), range(len(LABELS)), self.steps
        table: list[list[float]] = []
        back: list[list[tuple[int, int]]] = []
        for j, row in enumerate(scored):
            top, link = [-math.inf] * len(LABELS), [(0, 0)] * len(LABELS)
            for size, own in enumerate(row, 1):
                for y in labels if size == 1 else labels[1:]:
                    if j - size < 0:
                        value, was = steps[0][y], 0
                    else:
                        before = table[j - size]
                        value, was = max((before[x] + steps[x][y], -x) for x in labels)
                        was = -was
                    value += own[y]
                    if value > top[y]:
                        top[y], link[y] = value, (size, was)
            table.append(top)
            back.append(link)
        y = max(labels, key=lambda k: (table[-1][k], -k))
        j, out = len(scored) - 1, []
        while j >= 0:
            size, was = back[j][y]
            if y:
                out.append((j - size + 1, j, y))
            j, y = j - size, was
        return out[::-1]


def _gradient(field: Field, found: list, gold: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected counts of features and moves of one island; gold: (last word, length, label) of its segments."""
    scored = [[np.array(s) for s in row] for row in field.scored(found)]
    n, k = len(scored), len(LABELS)
    start = field.moves[0]
    alpha = np.full((n, k), -np.inf)
    block = np.zeros(k)
    block[0] = -np.inf  # what lies outside is one word at a time
    into = []
    for j in range(n):
        parts = []
        for size, own in enumerate(scored[j], 1):
            came = start if j < size else np.logaddexp.reduce(alpha[j - size][:, None] + field.moves, 0)
            parts.append(came + own + (block if size > 1 else 0))
        into.append(parts)
        alpha[j] = np.logaddexp.reduce(parts, 0)
    z = np.logaddexp.reduce(alpha[-1])
    beta = np.full((n, k), -np.inf)
    beta[-1] = 0
    dw, dm = np.zeros_like(field.weights), np.zeros_like(field.moves)
    for j in range(n - 1, -1, -1):
        for size, own in enumerate(scored[j], 1):
            p = np.exp(into[j][size - 1] + beta[j] - z)
            for f in found[j][size - 1]:
                dw[:, f] -= p
            ahead = own + (block if size > 1 else 0) + beta[j]
            if j < size:
                dm[0] -= np.exp(start + ahead - z)
            else:
                dm -= np.exp(alpha[j - size][:, None] + field.moves + ahead - z)
                beta[j - size] = np.logaddexp(beta[j - size], np.logaddexp.reduce(field.moves + ahead, 1))
    was = 0
    for j, size, y in gold:
        dw[y, found[j][size - 1]] += 1
        dm[was, y] += 1
        was = y
    return dw, dm


def labelled(text: str) -> list[tuple[list, list[tuple[int, int, int]]]]:
    """Training islands of a text: the features of their candidates and their segments (last word, length, label)."""
    base = base_spans(text)
    secrets = [("secret", *m.span(1)) for m in re.finditer(_KEYED.pattern + r"([A-Za-z0-9_-]{20,})", text)]
    known = {(s, e): k for k, s, e in base + secrets}
    taken = Taken(list(known))
    blank = Field(np.zeros((len(LABELS), FEATURES)), np.zeros((len(LABELS),) * 2))
    out = []
    for island in islands(text):
        if len(island.words) > 12:
            continue
        gold, j, sure = [], 0, True
        while j < len(island.words):
            for size in range(min(LONGEST, len(island.words) - j), 0, -1):
                kind = known.get((island.words[j][0], island.words[j + size - 1][1]))
                if kind:
                    break
            else:
                size = 1
            gold.append((j + size - 1, size, LABELS.index(kind) if kind else 0))
            if not kind:
                s, e = island.words[j]
                d = len(_digits(text[s:e]))
                sure &= d < 9 and "@" not in text[s:e] and not taken.meets(s, e)
            j += size
        if sure:
            out.append((blank.candidates(text, island), gold))
    return out


def fit(rows: list[tuple[list, list]], seed: int = 1) -> Field:
    rng = np.random.default_rng(seed)
    field = Field(np.zeros((len(LABELS), FEATURES)), np.zeros((len(LABELS),) * 2))
    seen_w, seen_m = np.full(field.weights.shape, 1e-8), np.full(field.moves.shape, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 16):
            w, m = -1e-3 * field.weights, -1e-3 * field.moves
            for i in order[at : at + 16]:
                dw, dm = _gradient(field, *rows[i])
                w, m = w + dw, m + dm
            seen_w += w * w
            seen_m += m * m
            field = Field(field.weights + RATE * w / np.sqrt(seen_w), field.moves + RATE * m / np.sqrt(seen_m))
    return field


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Field:
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    hashed = F.xxhash64(F.col("key").cast("string"), F.lit("pii"))
    ids = rows.where("key is not null").select("key").distinct().orderBy(hashed, "key").limit(SAMPLE)
    some = rows.join(F.broadcast(ids), "key")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [json.dumps(x) for t in batch.column(0).to_pylist() for x in labelled(t)]
        return pa.record_batch([pa.array(found, pa.string())], names=["island"])

    # the same island over and over teaches little: distinct ones, by hash
    told = map_arrow(some.select("text"), run, "island string").distinct().orderBy(F.xxhash64("island"), "island").limit(ISLANDS).collect()
    return fit([json.loads(r[0]) for r in told])


def spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by kind and start."""
    base = base_spans(text)
    if not _TRIGGER.search(text):
        return base, base
    taken = Taken([(s, e) for _, s, e in base])
    more = []
    for island in islands(text):
        for i, j, y in field.best(text, island):
            s, e = island.words[i][0], island.words[j][1]
            if not taken.meets(s, e):
                more.append((LABELS[y], s, e))
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def detected(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans, n_spans) of each row; the counts by kind are of base spans, the last is of all."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans(t, field) for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in BASE]
        return pa.record_batch([batch.column(0), *counts, pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(a) for _, a in found], pa.string()), pa.array([len(a) for _, a in found], pa.int64())], names=[key, *[f"n_{k}" for k in BASE], "base", "spans", "n_spans"])

    return map_arrow(df.select(F.col(key), text_or_empty(text)), run, f"{key} {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base string, spans string, n_spans bigint")


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap are one, named for the first."""
    out, at = [], 0
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redaction(field: Field, text: Column) -> Column:
    """The redacted text; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted(t, spans(t, field)[1]) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = detected(docs, train(docs))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")
