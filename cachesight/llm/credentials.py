"""Secret scans: base patterns, and credentials by the likelihood of their format under inferred grammars.

1. Grammar inference: for each format the labelled credentials make a prefix tree with counts. States are merged where all
   that follows them differs by no more than chance (Hoeffding bounds), so the tree becomes a probabilistic automaton. One
   Spark group is one format; strings that are no credentials make the background in the same way.
2. Base patterns: assignments, access keys and runs of hexadecimal digits, found in the bytes of many texts at once.
3. Every run of credential characters of LEAST or more is scored by all automata side by side: by how much is a format more
   likely than the background? It is a credential where that is about as much as for the labelled ones.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.llm.common import chunks, table, tidy

#: The base patterns, over bytes with A-Z as a-z where letters may have either case, and their least lengths.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Kinds in the order in which spans of one start are listed; the last is what the grammars add.
KINDS = ("assign", "access", "hex", "grammar")
#: Characters of the shortest candidate for the grammars.
LEAST = 16
#: By how many nats a format has to be more likely than the background, at least: in all, and for each character. Its own limits
#: are shares of what all but OUTLIERS of its labelled credentials reach.
IN_ALL, EACH = 12.0, 0.3
SHARE_IN_ALL, SHARE_EACH, OUTLIERS = 0.5, 0.6, 0.01
#: Confidence of a merge; the smoothing of counts.
ALPHA, SMOOTH = 0.01, 0.02
#: A state that so many different symbols follow takes any other one, too, as rare as it is; elsewhere an unseen symbol is rejected.
FANS = 8

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOWER + _UPPER + _DIGIT
ALPHABET = _ALNUM + "+/_.=-"
_SYMBOL = np.full(256, -1, np.int16)
_SYMBOL[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}")
SAMPLES, SEED = 240, 11
BACKGROUND = "background"
#: Public formats of credentials as parts of (literal) or (characters, count).
_URL = _ALNUM + "_-"
FORMATS = {
    "aws-key": ["AKIA", (_UPPER + "234567", 16)],
    "aws-secret": [(_ALNUM + "+/", 40)],
    "github": ["gh", ("pos", 1), "_", (_ALNUM, 36)],
    "gitlab": ["glpat-", (_URL, 20)],
    "google": ["AIza", (_URL, 35)],
    "jwt": ["eyJ", (_URL, 24), ".eyJ", (_URL, 48), ".", (_URL, 43)],
    "npm": ["npm_", (_ALNUM, 36)],
    "sendgrid": ["SG.", (_URL, 22), ".", (_URL, 43)],
    "slack": ["xox", ("bp", 1), "-", (_DIGIT, 12), "-", (_DIGIT, 12), "-", (_ALNUM, 24)],
    "stripe": ["sk_live_", (_ALNUM, 24)],
}
#: Syllables of the background's words.
SYLLABLES = "a al an ar as at ba be ca che ción co con da de der di do el en er es est ge ha he hea i ich in ing ion is it keit la le les lich lo ly ma me men ment mo na nd ne no nt o on or ou pa per po pre que r ra re ri ro s sa sch se sh si so st su ta te ter th the ti tion to tra un und ung ur us ve ver vi w wa wh y zu".split()


def labelled(samples: int = SAMPLES, seed: int = SEED) -> list[tuple[str, str]]:
    """(format, string): ``samples`` credentials of each format, and four times as many strings of other kinds."""
    r = random.Random(seed)
    out = []
    for name, parts in FORMATS.items():
        for _ in range(samples):
            out.append((name, "".join(p if isinstance(p, str) else "".join(r.choices(p[0], k=p[1])) for p in parts)))

    def word() -> str:
        return "".join(x for x in "".join(r.choices(SYLLABLES, k=r.randint(1, 7))) if x in ALPHABET) or "the"

    digits = lambda n: "".join(r.choices(_DIGIT, k=n))
    other = [
        lambda: word() + word() + word(), lambda: word().capitalize() + word() + word(), lambda: "_".join(word() for _ in range(r.randint(2, 5))), lambda: "-".join(word() for _ in range(r.randint(2, 5))),
        lambda: word() + "".join(word().capitalize() for _ in range(r.randint(2, 4))), lambda: "_".join(word() for _ in range(r.randint(2, 4))).upper(), lambda: "/".join(word() for _ in range(r.randint(2, 6))) + r.choice(["", ".html", ".txt", ".py", ".js"]),
        lambda: ".".join(word() for _ in range(r.randint(2, 3))) + r.choice([".com", ".org", ".net", ".example.com"]), lambda: digits(r.randint(8, 24)), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: ".".join(digits(r.randint(1, 3)) for _ in range(4)),
        lambda: "-".join("".join(r.choices(_DIGIT + "abcdef", k=k)) for k in (8, 4, 4, 4, 12)), lambda: word() + digits(r.randint(1, 4)) + "." + word() + ".com", lambda: r.choice("=-_.") * r.randint(8, 40), lambda: word() + "/" + word() + "-" + digits(3),
    ]
    return out + [(BACKGROUND, other[k % len(other)]()) for k in range(4 * samples)]


#: Rows of states, and the formats' limits.
Model = tuple[list[tuple], dict[str, tuple[float, float]]]


# --- grammar inference ------------------------------------------------------------------------------------------------


class Tree:
    """A prefix tree with counts, whose states ``infer`` merges. ``n``: arrivals, ``end``: strings that end here."""

    def __init__(self, strings: list[str]):
        self.n, self.end, self.next = [0], [0], [{}]
        for s in strings:
            at = 0
            self.n[0] += 1
            for c in s:
                at = self._step(at, c)
                self.n[at] += 1
            self.end[at] += 1

    def _step(self, at: int, c: str) -> int:
        own = self.next[at]
        if c not in own:
            self.n.append(0)
            self.end.append(0)
            self.next.append({})
            own[c] = [len(self.n) - 1, 0]
        own[c][1] += 1
        return own[c][0]

    def distance(self, a: int, b: int, alpha: float) -> float | None:
        """How much what follows a and b differs, summed over their own symbols; None if somewhere by more than chance."""
        bound, total, todo, top = math.sqrt(0.5 * math.log(2 / alpha)), 0.0, [(a, b)], True
        while todo:
            x, y = todo.pop()
            n, m, p, q = self.n[x], self.n[y], self.next[x], self.next[y]
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            gaps = [abs(self.end[x] / n - self.end[y] / m), *(abs(p.get(c, (0, 0))[1] / n - q.get(c, (0, 0))[1] / m) for c in p.keys() | q.keys())]
            if max(gaps) > most:
                return None
            if top:
                total, top = sum(gaps), False
            todo += [(p[c][0], q[c][0]) for c in p.keys() & q.keys() if p[c][0] != q[c][0]]
        return total

    def fold(self, a: int, b: int) -> None:
        """The tree below b goes into a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.n[x] += self.n[y]
            self.end[x] += self.end[y]
            for c, (to, count) in self.next[y].items():
                if c in self.next[x]:
                    self.next[x][c][1] += count
                    todo.append((self.next[x][c][0], to))
                else:
                    self.next[x][c] = [to, count]


def infer(strings: list[str], alpha: float = ALPHA) -> list[tuple[int, int, list[tuple[str, int, int]]]]:
    """States (arrivals, ends, [(symbol, next state, count)]) of the automaton; the first one is where strings begin.

    Kept states and their children are looked at, the most frequent child first: it is merged with the state that it differs
    least from, if there is one that it agrees with, and kept otherwise.
    """
    t = Tree(strings)
    kept = [0]
    while True:
        own = set(kept)
        edges = [(t.n[to], -k, c, to) for k, x in enumerate(kept) for c, (to, _) in t.next[x].items() if to not in own]
        if not edges:
            break
        _, k, c, child = max(edges)
        fits = [(d, j) for j, x in enumerate(kept) if (d := t.distance(x, child, alpha)) is not None]
        if fits:
            into = kept[min(fits)[1]]
            t.next[kept[-k]][c][0] = into
            t.fold(into, child)
        else:
            kept.append(child)
    place = {x: k for k, x in enumerate(kept)}
    return [(t.n[x], t.end[x], sorted((c, place[to], count) for c, (to, count) in t.next[x].items())) for x in kept]


def _infer(b: pd.DataFrame) -> pd.DataFrame:
    rows = [(b["format"].iloc[0], k, n, end, [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]) for k, (n, end, out) in enumerate(infer(sorted(b["string"])))]
    return pd.DataFrame(rows, columns=["format", "state", "n", "ends", "symbols", "to", "counts"])


def grammars(spark: SparkSession, strings: list[tuple[str, str]] | None = None) -> Model:
    """The automata's states, inferred in one task for each format, and the formats' limits. Both are bounded by the labelled
    strings."""
    strings = strings or labelled()
    own = spark.createDataFrame(strings, "format string, string string")
    states = own.groupBy("format").applyInPandas(_infer, "format string, state int, n long, ends long, symbols array<string>, to array<int>, counts array<long>")
    states = sorted((r.format, r.state, r.n, r.ends, list(r.symbols), list(r.to), list(r.counts)) for r in states.collect())
    return states, limits(states, strings)


def limits(states: list[tuple], strings: list[tuple[str, str]]) -> dict[str, tuple[float, float]]:
    """Of each format the nats in all and for each character that a credential has to reach."""
    own = [(f, x.encode()) for f, x in strings if f != BACKGROUND]
    gains = Scorer(states).gains([x for _, x in own])
    out = {}
    for a, name in enumerate(sorted({f for f, _ in own})):
        mine = np.array([f == name for f, _ in own])
        gain, size = gains[a, mine], np.array([len(x) for f, x in own if f == name])
        out[name] = max(IN_ALL, SHARE_IN_ALL * float(np.quantile(gain, OUTLIERS))), max(EACH, SHARE_EACH * float(np.quantile(gain / size, OUTLIERS)))
    return out


class Scorer:
    """All automata side by side; state ``dead`` of a format has no way back, in the background it is the first state."""

    def __init__(self, states: list[tuple], limits: dict[str, tuple[float, float]] | None = None):
        self.limits = limits or {}
        self.names = sorted({s[0] for s in states} - {BACKGROUND}) + [BACKGROUND]
        size = max(s[1] for s in states) + 2
        self.dead, k = size - 1, len(ALPHABET)
        self.to = np.full((len(self.names), size, k), self.dead, np.int32)
        self.log = np.full((len(self.names), size, k), -math.log(k + 1))
        self.end = np.full((len(self.names), size), -np.inf)
        self.to[-1] = 0
        for name, state, n, ends, symbols, to, counts in states:
            a, whole = self.names.index(name), n + SMOOTH * (k + 1)
            self.log[a, state] = math.log(SMOOTH / whole)
            if len(symbols) >= FANS and name != BACKGROUND:
                after: dict[int, int] = {}
                for x, count in zip(to, counts, strict=True):
                    after[x] = after.get(x, 0) + count
                self.to[a, state] = max(sorted(after), key=after.get)
            for c, x, count in zip(symbols, to, counts, strict=True):
                s = ALPHABET.index(c)
                self.to[a, state, s], self.log[a, state, s] = x, math.log((count + SMOOTH) / whole)
            self.end[a, state] = math.log((ends + SMOOTH) / whole)
        self.end[-1, self.dead] = self.end[-1, 0]

    def gains(self, strings: list[bytes]) -> np.ndarray:
        """By how many nats each format (row) is more likely than the background for each string, -inf where it is not accepted."""
        out = np.full((len(self.names) - 1, len(strings)), -np.inf)
        if not strings:
            return out
        sizes = np.array([len(s) for s in strings])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        symbols = _SYMBOL[np.frombuffer(b"".join(strings), np.uint8)]
        live, which = np.arange(len(strings)), np.arange(len(self.names))[:, None]
        state, total = np.zeros((len(self.names), len(strings)), np.int32), np.zeros((len(self.names), len(strings)))
        at = 0
        while len(live):
            ended = sizes[live] == at
            if ended.any():
                done = live[ended]
                log = total[:, done] + self.end[which, state[:, done]]
                out[:, done] = log[:-1] - log[-1]
                live = live[~ended]
            s = symbols[first[live] + at]
            now = state[:, live]
            total[:, live] += self.log[which, now, s]
            state[:, live] = after = self.to[which, now, s]
            live = live[(after[:-1] != self.dead).any(axis=0)]  # no format accepts the others any more
            at += 1
        return out

    def formats(self, strings: list[bytes]) -> list[tuple[str, float] | None]:
        """Of each string the most likely format whose limits it reaches, and its gain."""
        gains = self.gains(strings)
        if not len(gains):
            return [None] * len(strings)
        each = gains / np.array([max(len(x), 1) for x in strings])
        in_all, a_character = (np.array([self.limits[n][k] for n in self.names[:-1]])[:, None] for k in (0, 1))
        gains = np.where((gains >= in_all) & (each >= a_character), gains, -np.inf)
        top = gains.argmax(axis=0) if strings else []
        return [(self.names[a], float(gains[a, k])) if gains[a, k] > -np.inf else None for k, a in enumerate(top)]


# --- scanning ---------------------------------------------------------------------------------------------------------


def _long_runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    keep = end - start >= least
    return start[keep], end[keep]


def find_spans(texts: list[bytes], scorer: Scorer) -> list[list[tuple[int, int, int, str | None, float | None]]]:
    """Of each text its spans (start, kind, end, format, score) in order; places are code points."""
    data = b"\n".join(texts) + b"\n"  # no pattern matches over a newline
    buf = np.frombuffer(data, np.uint8)
    found: list[tuple[int, int, int, int]] = []  # start, end, kind, start of the value
    for m in ASSIGN.finditer(_FOLD[buf].tobytes()):
        if m.end(1) - m.start(1) >= LEAST_ASSIGN:
            found.append((m.start(), m.end(), 0, m.start(1)))
    found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(a, b, 2, a) for a, b in zip(*(x.tolist() for x in _long_runs(_IS_HEX[buf], LEAST_HEX)))]
    base = sorted(found)
    starts = np.array([x[0] for x in base], np.int64)
    covered = np.maximum.accumulate([x[1] for x in base]) if base else []
    values = [data[x[3] : x[1]] for x in base]
    more = []
    for a, b in zip(*(x.tolist() for x in _long_runs(_SYMBOL[buf] >= 0, LEAST))):
        for m in _CANDIDATE.finditer(data, a, b):
            k = int(np.searchsorted(starts, m.start(), "right")) - 1
            if m.end() - m.start() >= LEAST and (k < 0 or covered[k] < m.end()):  # not inside a base span
                more.append(m.span())
    likely = scorer.formats(values + [data[a:b] for a, b in more])
    spans = [(x[0], x[2], x[1], k) for k, x in enumerate(base)] + [(a, 3, b, k) for k, (a, b) in enumerate(more, len(base)) if likely[k]]
    out: list[list] = [[] for _ in texts]
    if spans:
        point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        for a, kind, b, k in sorted(spans):
            d = int(np.searchsorted(first, a, "right")) - 1
            base_point = point[first[d]]
            out[d].append((int(point[a] - base_point), kind, int(point[b] - base_point), *(likely[k] or (None, None))))
    return out


SPANS = "array<struct<kind:string,start:long,end:long,format:string,score:double>>"


def _scanning(model: Model, redact: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*model)
        for b in batches:
            for at, part in chunks(b["cachesight_text"]):
                rows = b.iloc[at : at + len(part)].copy()
                spans = find_spans(part, scorer)
                if redact:
                    rows["cachesight_text"] = [_redacted(t, s) for t, s in zip(rows["cachesight_text"], spans, strict=True)]
                else:
                    rows = rows.drop(columns="cachesight_text")
                    rows["spans"] = [[{"kind": KINDS[k], "start": a, "end": e, "format": f, "score": s} for a, k, e, f, s in own] for own in spans]
                yield rows

    return run


def _redacted(text: str | None, spans: list) -> str | None:
    out, at = [], 0
    for a, kind, b, _, _ in spans:
        if b > at:
            out += [text[at : max(a, at)], f"[{KINDS[kind]}]"] if a >= at else []
            at = b
    return text if not spans else "".join(out) + text[at:]


def secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, format, score) of each row of ``docs`` (doc_id, text).

    Null texts are empty; null ids, repeated rows and ties are kept, each row by itself. Base spans are always there, with a
    format where a grammar accepts their value. Spans of kind ``grammar`` lie in no base span.
    """
    model = model or grammars(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("cachesight_text"))
    found = own.mapInPandas(tidy(_scanning(model, False)), f"doc_id string, spans {SPANS}")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with each secret's characters replaced by its kind in brackets; a null text stays null."""
    model = model or grammars(docs.sparkSession)
    text = docs.select(F.xxhash64("text").alias("cachesight_key"), F.col("text").cast("string").alias("cachesight_text"), F.struct(*docs.columns).alias("cachesight_row"))
    schema = text.schema
    out = text.mapInPandas(tidy(_scanning(model, True)), schema)
    return out.select(*[F.col("cachesight_text").alias(c) if c == "text" else F.col("cachesight_row")[c].alias(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != KINDS[3])
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
