"""Substring deduplication with compact windows.

1. A text is a row of word shingles. For each of HASHES hash functions, the Cartesian tree over the shingles' hashes gives
   compact windows (l, c, r): c holds the smallest hash of every run from [l, c] to [c, r]. Only windows of at least SPAN
   shingles are kept, about 2 n / SPAN for n shingles; a run of SPAN or more always lies in one of them.
2. Windows of equal smallest hash meet. Each is tied to the first of all and to the first among those of equal context (the
   shingle ASIDE places before or behind the middle), so a hash that many documents share ties each of them three times at
   most. A hash with a large part of all windows is dealt over tasks: each takes a share of its documents, and windows of
   equal hash and context meet by context, one from each task's batch.
3. The ties of two documents are intervals in both; where enough equal hashes overlap on one alignment, the passage is a
   candidate. Hashes are minima of different functions and the contexts beside them.
4. Candidates are verified on the words themselves: runs that both documents hold, joined over small gaps as long as
   the sets of shingles are similar enough, of SPAN shingles or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.llm.common import SHINGLE, WordHashes, chunks, materialize, mix, partitions, runs, table, tidy

#: Equal hashes that make a candidate: minima of two functions, or one and a context beside it. A passage of one run has fewer
#: with a probability of about (1 - s)^6 + 6 s (1 - s)^5 / 10 at similarity s (a context differs in one of ten cases): 7e-4 at
#: 0.75, 2e-4 at 0.8. Longer passages have several runs.
HASHES, ENOUGH = 6, 2
#: Shingles of the shortest passage: 50 words.
SPAN = 46
SIMILARITY = 0.75
#: Shingles between the contexts that tell windows of one hash apart and the window's middle.
ASIDE = SPAN // 2
#: How far a window is told on either side of its middle. Runs of SPAN that hold the middle end within, so none is lost.
REACH = 255
#: How far alignments of one passage may differ; shingles between runs that may be joined, and between intervals that are
#: verified as one candidate.
DRIFT, GAP, ASUNDER = 16, 12, 2 * SPAN
#: How far alignments within one candidate may differ (a match may lie 4 DRIFT off). Longer chains are cut into stretches of
#: this width that overlap by DRIFT, so ties that may join always share one.
STRETCH = 3 * DRIFT
#: Stretches of followers of one document that a task verifies.
FOLLOWERS = 512
#: A hash that has one of HOT windows or more, by one of SAMPLE documents, is dealt out in shares of its documents, PARTS to that
#: many windows and SHARES at most. There are HOT such hashes at most. In a share windows are tied to the share's first ones, and
#: those to the first of all: a window may be tied to another earlier document than without shares, never to a later one.
SAMPLE, HOT, PARTS, SHARES = 16, 16384, 4, 4095
_SALTS = mix(np.arange(77, 77 + HASHES, dtype=np.uint64))
#: key: 48 bits of the smallest hash, 4 of the function's number, and 12 of a share (0 unless the hash is dealt out).
#: before, behind: 48 bits of the shingle on either side (0 without one). Under them ``before`` has the window's reach to the left
#: and to the right, 8 bits each.
WINDOWS = "key long, before long, behind long, doc_id long, middle int"


def _sliding(x: np.ndarray, width: int, step) -> np.ndarray:
    """``step`` (minimum or maximum) over each run of ``width``, by doubling."""
    size = 1
    while 2 * size <= width:
        x = step(x[:-size], x[size:])
        size *= 2
    return step(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def compact_windows(h: np.ndarray, begin: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, middle, right) of the windows of at least ``span`` places of the texts that begin at ``begin``.

    A place is the middle of such a window if it is the smallest of some run of ``span`` places. The nearest smaller places
    on either side of a middle are middles too, so the Cartesian tree over the middles alone gives the exact ends. Among
    equal hashes the first is the smallest.
    """
    none = np.empty(0, np.int64)
    if len(h) < span:
        return none, none, none
    least = _sliding(h, span, np.minimum)
    first = begin[:-1]
    sizes = np.diff(begin)
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = text[: len(least)] == text[span - 1 :]
    least = np.where(whole, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    middle = np.flatnonzero((_sliding(padded, span, np.maximum) == h) & (h > 0))
    if not len(middle):
        return none, none, none
    values, owner = h[middle].tolist(), text[middle].tolist()
    at = middle.tolist()
    left, right = [0] * len(at), [0] * len(at)
    stack: list[int] = []
    last = -1
    for k, (v, t) in enumerate(zip(values, owner, strict=True)):
        if t != last:
            for s in stack:
                right[s] = int(begin[last + 1]) - 1
            stack = []
            last = t
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = at[k] - 1
        left[k] = at[stack[-1]] + 1 if stack else int(first[t])
        stack.append(k)
    for s in stack:
        right[s] = int(begin[last + 1]) - 1
    left, right = np.array(left), np.array(right)
    wide = right - left + 1 >= span
    return left[wide], middle[wide], right[wide]


def _windows(hot: np.ndarray, shares: np.ndarray):
    """Of documents their windows; ``hot`` are the sorted keys that are dealt out in ``shares``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["doc_id"].to_numpy(np.int64)
            for at, part in chunks(b["text"]):
                s, begin = WordHashes(part).shingles()
                for number, salt in enumerate(_SALTS):
                    h = mix(s ^ salt)
                    left, middle, right = compact_windows(h, begin)
                    text = np.searchsorted(begin, middle, "right") - 1
                    first, end = begin[text], begin[text + 1]
                    doc = ids[at + text]
                    reach = np.minimum(middle - left, REACH) << 8 | np.minimum(right - middle, REACH)
                    contexts = []
                    for there in (middle - ASIDE, middle + ASIDE):
                        inside = (there >= first) & (there < end)
                        contexts.append(np.where(inside, np.maximum(s[np.where(inside, there, 0)] >> np.uint64(16), np.uint64(1)), np.uint64(0)).view(np.int64))
                    key = (h[middle] & np.uint64(0xFFFFFFFFFFFF0000) | np.uint64(number << 12)).view(np.int64)
                    if len(hot):
                        where = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                        share = mix(doc.view(np.uint64)) % shares[where] + np.uint64(1)
                        key = np.where(hot[where] == key, key | share.view(np.int64), key)
                    yield pd.DataFrame({"key": key, "before": contexts[0] << 16 | reach, "behind": contexts[1], "doc_id": doc, "middle": (middle - first).astype(np.int32)})

    return run


def hot_keys(long: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys with one of HOT windows or more in a sample of the documents, sorted, and their shares. They are HOT at most."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    sample = long.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInPandas(tidy(_windows(*none)), WINDOWS)
    counted = materialize(sample.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "hot")
    enough = max((counted.agg(F.sum("n")).first()[0] or 0) / HOT, 8)
    rows = sorted((r.key, min(-(-PARTS * r.n // int(enough)), SHARES)) for r in counted.where(F.col("n") >= enough).collect())
    return (np.array([k for k, _ in rows], np.int64), np.array([x for _, x in rows], np.uint64)) if rows else none


class Firsts:
    """From batches sorted by a key: of each row the first row of its key. Held is one row."""

    def __init__(self):
        self.held: tuple[int, ...] | None = None

    def __call__(self, key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each row goes on with the key of the row before, and the columns of the first rows."""
        goes_on = np.zeros(len(key), bool)
        goes_on[1:] = key[1:] == key[:-1]
        goes_on[0] = self.held is not None and self.held[0] == key[0]
        at = np.maximum.accumulate(np.where(goes_on, -1, np.arange(len(key))))
        own = [np.where(at >= 0, c[at], self.held[k] if self.held else 0) for k, c in enumerate(columns, 1)]
        self.held = (key[-1], *(c[-1] for c in own))
        return goes_on, own


#: ``low`` to ``high`` are the shingles of the own document that lie in both windows on their alignment; ``hashes`` has a bit for
#: the function and one for a context that is equal, too.
TIES = "doc_id long, other long, shift int, low int, high int, hashes int"
CONTEXT = 1 << 15


def _tie(own: list[np.ndarray], first: list[np.ndarray], function: np.ndarray, group: np.ndarray, needed: "Needed") -> pd.DataFrame:
    """Ties of windows (COLUMNS) to windows of earlier documents, where enough of the two is in common."""
    doc, middle, before, behind = own
    other, other_middle, other_before, other_behind = first
    left = np.minimum(before >> 8 & 255, other_before >> 8 & 255)
    right = np.minimum(before & 255, other_before & 255)
    same = (before >> 16 != 0) & (before >> 16 == other_before >> 16) | (behind != 0) & (behind == other_behind)
    keep = (other < doc) & (left + right + 1 >= SPAN - DRIFT)
    middle = middle.astype(np.int64)
    made = {"doc_id": doc, "other": other, "shift": (other_middle - middle).astype(np.int32), "low": (middle - left).astype(np.int32), "high": (middle + right).astype(np.int32), "hashes": (1 << function | np.where(same, CONTEXT, 0)).astype(np.int32)}
    made = {k: v[keep] for k, v in made.items()}
    keep = needed(group[keep], made["doc_id"], made["other"], other_middle[keep], made["hashes"], middle=middle[keep], high=made["high"])
    return pd.DataFrame({k: v[keep] for k, v in made.items()})


class Needed:
    """Of ties of one document to one window that follow each other, as a repeated line gives them, those that the kept one before
    does not stand for: a window's runs of SPAN begin behind the middle before it and end SPAN behind its own. Batches follow each
    other as if they were one."""

    def __init__(self):
        self.last, self.reach = None, 0

    def __call__(self, *columns: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.ones(len(middle), bool)
        if not len(middle):
            return out
        same = np.ones(len(middle), bool)
        for k, c in enumerate(columns):
            same[1:] &= c[1:] == c[:-1]
            same[0] &= self.last is not None and self.last[k] == c[0]
        self.last = [c[-1] for c in columns]
        if same.any():
            for k, (goes_on, m, h) in enumerate(zip(same.tolist(), middle.tolist(), high.tolist(), strict=True)):
                if goes_on and m + SPAN <= self.reach:
                    out[k] = False
                else:
                    self.reach = h
        else:
            self.reach = int(high[-1])
        return out


COLUMNS = ("doc_id", "middle", "before", "behind")


def _context(side: int, columns: list[np.ndarray]) -> np.ndarray:
    return columns[3] if side else columns[2] >> 16


class Contexts:
    """On one side, of the windows of a share of a key that is dealt out, sorted by doc_id: the first window of each context. Held
    are the first ones of one share, which has about one of HOT * PARTS windows of all documents at most."""

    def __init__(self, side: int):
        self.side, self.key, self.held = side, None, {}

    def __call__(self, key: np.ndarray, columns: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each of ``rows``, all of keys that are dealt out, is the first of its context, and the columns of the first ones."""
        own, is_first, firsts = _context(self.side, columns)[rows], np.zeros(len(rows), bool), [np.empty(len(rows), c.dtype) for c in columns]
        cuts = np.flatnonzero(np.diff(key[rows], prepend=key[rows[0]] - 1)) if len(rows) else rows
        for a, b in zip(cuts.tolist(), [*cuts.tolist()[1:], len(rows)]):
            if key[rows[a]] != self.key:
                self.key, self.held = key[rows[a]], {}
            some, at, number = np.unique(own[a:b], return_index=True, return_inverse=True)
            found = []
            for context, k in zip(some.tolist(), (a + at).tolist()):
                if context not in self.held:
                    self.held[context] = tuple(c[rows[k]] for c in columns)
                    is_first[k] = True
                found.append(self.held[context])
            for f, values in zip(firsts, zip(*found)):
                f[a:b] = np.array(values)[number]
        return is_first, firsts


def _asides(batches: Iterator[pd.DataFrame]):
    """From windows sorted by (key, doc_id, middle), of each batch: keys, COLUMNS, whether rows go on with the key of the row
    before, the first rows of the keys, and for each side the rows with a context that the first of their key does not have, or
    that are the first of a share themselves, with which of them are the first of their context in their share (all, for keys
    that are not dealt out) and the first ones."""
    firsts, contexts = Firsts(), (Contexts(0), Contexts(1))
    for b in batches:
        if not len(b):
            continue
        key, columns = b["key"].to_numpy(), [b[c].to_numpy() for c in COLUMNS]
        goes_on, first = firsts(key, *columns)
        dealt, sides = key & SHARES != 0, []
        for side in (0, 1):
            own = _context(side, columns)
            rows = np.flatnonzero((own != 0) & np.where(goes_on, own != _context(side, first), dealt))
            shared = dealt[rows]
            is_first, held = np.ones(len(rows), bool), [c[rows] for c in columns]
            is_first[shared], of_share = contexts[side](key, columns, rows[shared])
            for c, x in zip(held, of_share):
                c[shared] = x
            sides.append((rows, is_first, held))
        yield key, columns, goes_on, first, sides


#: Windows that are to be tied to the first of their side_group, and ties (where ``hashes`` is not 0), which only come along.
SIDES = "side_group long, function int, doc_id long, middle int, before long, behind long, other long, shift int, low int, high int, hashes int"


def _side_frame(part: dict[str, np.ndarray], n: int) -> pd.DataFrame:
    kinds = {c: np.int64 if kind == "long" else np.int32 for c, kind in (x.split() for x in SIDES.split(", "))}
    return pd.DataFrame({c: part[c].astype(kind, copy=False) if c in part else np.zeros(n, kind) for c, kind in kinds.items()})


def _key_ties(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From windows sorted by (key, doc_id, middle), in one pass:

    Ties to the first of the key, and of keys that are dealt out also those to the first of equal context in the share, where
    that is not the context of the first of the key.

    Windows with a context that the first of their key does not have, under the hash of key, side and context. Of a key that is
    dealt out, whose first differs from share to share, the first of each context leaves a share, to which the others are tied
    here, and the firsts of its shares meet, too.
    """
    needed = [Needed() for _ in range(3)]
    for key, columns, goes_on, first, sides in _asides(batches):
        function = key >> 12 & 15
        rows = np.flatnonzero(goes_on)
        made = [_tie([c[rows] for c in columns], [c[rows] for c in first], function[rows], key[rows], needed[2])]
        for own, (rows, is_first, held) in zip(needed, sides):
            later = rows[~is_first]
            if len(later):
                made.append(_tie([c[later] for c in columns], [c[~is_first] for c in held], function[later], key[later], own))
        for ties in made:
            if len(ties):
                part = {c: ties[c].to_numpy() for c in ties}
                yield _side_frame(part | {"side_group": mix(part["doc_id"].view(np.uint64)).view(np.int64)}, len(ties))
        firsts = np.flatnonzero(~goes_on & (key & SHARES != 0))
        for side, rows in ((0, sides[0][0][sides[0][1]]), (1, sides[1][0][sides[1][1]]), (2, firsts)):
            group = (key[rows] & ~SHARES | side).view(np.uint64)
            if side < 2:
                group = group ^ mix(_context(side, columns)[rows].view(np.uint64))
            if len(rows):
                yield _side_frame({"side_group": mix(group).view(np.int64), "function": function[rows]} | {n: c[rows] for n, c in zip(COLUMNS, columns)}, len(rows))


def _side_ties(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows of sides sorted by (side_group, doc_id, middle): ties to the first of the group, and those that came along."""
    firsts, needed, names = Firsts(), Needed(), [c.split()[0] for c in TIES.split(", ")]
    for b in batches:
        come_along = b["hashes"].to_numpy() != 0
        if come_along.any():
            yield b.loc[come_along, names]
            b = b[~come_along]
        if not len(b):
            continue
        group, columns = b["side_group"].to_numpy(), [b[c].to_numpy() for c in COLUMNS]
        goes_on, first = firsts(group, *columns)
        rows = np.flatnonzero(goes_on)
        yield _tie([c[rows] for c in columns], [c[rows] for c in first], b["function"].to_numpy()[rows].astype(np.int64), group[rows], needed)


#: A stretch of a document, and within it the alignments of parts of it with the other document.
CANDIDATES = "doc_id long, other long, low int, high int, shifts array<int>, lows array<int>, highs array<int>"


def candidates(doc, other, shift, low, high, hashes) -> tuple[np.ndarray, ...]:
    """(doc_id, other, shift, low, high) from the columns of ties: an interval join.

    Ties of two documents on about one alignment whose intervals are ASUNDER apart at most join; a candidate needs ENOUGH equal
    hashes. A chain of alignments that drifts (many small insertions) gives a candidate for each stretch of it, so its
    passages may overlap.
    """
    order = np.lexsort((low, shift, other, doc))
    doc, other, shift, low, high, hashes = (x[order].astype(np.int64) for x in (doc, other, shift, low, high, hashes))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (shift[1:] - shift[:-1] > DRIFT)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc))
    drifts = shift[end - 1] - shift[begin] > STRETCH
    chain = np.cumsum(new) - 1
    plain = np.flatnonzero(~drifts[chain])
    pieces = [_joined(chain[plain], shift[plain], low[plain], high[plain], hashes[plain], plain)]
    for a, b in zip(begin[drifts].tolist(), end[drifts].tolist(), strict=True):
        start, last = int(shift[a]), int(shift[b - 1])
        while True:
            own = np.arange(a + np.searchsorted(shift[a:b], start), a + np.searchsorted(shift[a:b], start + STRETCH, "right"))
            pieces.append(_joined(np.zeros(len(own), np.int64), shift[own], low[own], high[own], hashes[own], own))
            if start + STRETCH >= last:
                break
            start += STRETCH - DRIFT
    row, first, last = (np.concatenate(x) for x in zip(*pieces))
    return doc[row], other[row], shift[row].astype(np.int32), first.astype(np.int32), last.astype(np.int32)


def _apart(chain, low, high) -> np.ndarray:
    """Whether each interval, sorted by chain and low, is more than ASUNDER behind all before it in its chain, or the first."""
    chain, far = chain.astype(np.int64), np.int64(1) << 33
    reach = np.maximum.accumulate(chain * far + high) - chain * far
    new = np.ones(len(chain), bool)
    new[1:] = (chain[1:] != chain[:-1]) | (low[1:] > reach[:-1] + ASUNDER)
    return new


def _joined(chain, shift, low, high, hashes, row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the leftmost tie, low, high) of each candidate; ties of a chain are within one stretch of alignments."""
    none = np.empty(0, np.int64)
    if not len(chain):
        return none, none, none
    order = np.lexsort((low, chain))
    chain, low, high, hashes, row = chain[order], low[order], high[order], hashes[order], row[order]
    at = np.flatnonzero(_apart(chain, low, high))
    enough = np.bitwise_count(np.bitwise_or.reduceat(hashes, at)) >= ENOUGH
    return row[at][enough], low[at][enough], np.maximum.reduceat(high, at)[enough]


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From ties sorted by doc_id. A document's ties are held together: three at most for each of its windows."""
    for b in runs(batches, "doc_id"):
        doc, other, shift, low, high = candidates(*(b[c.split()[0]].to_numpy() for c in TIES.split(", ")))
        if not len(doc):
            continue
        order = np.lexsort((low, other, doc))
        doc, other, shift, low, high = (x[order] for x in (doc, other, shift, low, high))
        pair = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])))
        at = np.flatnonzero(_apart(pair, low, high))
        lists = [pd.Series(np.split(x, at[1:]), dtype=object) for x in (shift, low, high)]
        yield pd.DataFrame({"doc_id": doc[at], "other": other[at], "low": low[at], "high": np.maximum.reduceat(high, at), "shifts": lists[0], "lows": lists[1], "highs": lists[2]})


MESSAGES = "other long, part int, kind int, doc_id long, content long, low long, words binary, shifts array<int>, lows array<int>, highs array<int>"


def _messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From documents with their candidates: as a follower the words of each, as an earlier document those that any asks for."""
    names = [c.split()[0] for c in MESSAGES.split(", ")]
    for b in batches:
        ids, contents = b["doc_id"].tolist(), b["content"].tolist()
        asked = list(zip(b["own_parts"].tolist(), b["from_shingle"].tolist(), b["to_shingle"].tolist(), strict=True))
        own = list(zip(*(b[c].tolist() for c in ("others", "from_low", "to_high", "shifts", "lows", "highs", "shares")), strict=True))
        for at, part in chunks(b["text"]):
            h = WordHashes(part)
            rows = []
            for d in range(len(part)):
                doc, content, base, n = ids[at + d], contents[at + d], int(h.offset[d]), int(h.first[d + 1] - h.first[d])
                start, end = h.start[h.first[d] : h.first[d + 1]] - base, h.end[h.first[d] : h.first[d + 1]] - base
                parts, low, high = asked[at + d]
                low, high = max(low, 0), min(high + SHINGLE, n)
                if parts and low < high:
                    words = part[d][start[low] : end[high - 1]]
                    rows += [(doc, p, 0, doc, content, low, words, [], [], []) for p in range(parts)]
                if own[at + d][0] is None:
                    continue
                place = int(mix(np.array([doc], np.int64).view(np.uint64))[0] >> np.uint64(8))
                for other, low, high, shifts, lows, highs, share in zip(*(x.tolist() for x in own[at + d]), strict=True):
                    high = min(high + SHINGLE, n)
                    if low < high:  # else a window of another text with this id
                        rows.append((other, place % share, 1, doc, content, low, part[d][start[low] : end[high - 1]], shifts, lows, highs))
            if rows:
                yield pd.DataFrame(rows, columns=names)


PASSAGES = "doc_id long, first_word long, last_word long, other_id long, other_first_word long, other_last_word long, similarity double"


class Places:
    """Where a document has each of its shingles from ``low`` on: numbers of the distinct shingles with their places."""

    def __init__(self, shingles: np.ndarray, low: int = 0):
        self.shingles, self.low = shingles, low
        self.values, number = np.unique(shingles, return_inverse=True)
        self.sorted = np.sort(number.astype(np.int64) << 32 | np.arange(len(shingles)))

    def nearest(self, own: np.ndarray, want: np.ndarray) -> np.ndarray:
        """For each shingle the place of an equal one that is nearest to the wanted place, -1 without one."""
        number = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        known = self.values[number] == own
        up = np.searchsorted(self.sorted, number << 32 | np.clip(want, 0, len(self.shingles)))
        best, away = np.full(len(own), -1), np.full(len(own), np.iinfo(np.int64).max)
        for at in (up - 1, up):
            inside = (at >= 0) & (at < len(self.sorted))
            found = self.sorted[np.where(inside, at, 0)]
            place = found & 0xFFFFFFFF
            distance = np.abs(place - want)
            better = known & inside & (found >> 32 == number) & (distance < away)
            best[better], away[better] = place[better], distance[better]
        return best


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    x, y = np.unique(x), np.unique(y)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def verify(own: np.ndarray, low: int, other: Places, shift: int) -> list[tuple[int, int, int, int, float]]:
    """(first, last, other first, other last, similarity) of passages, in shingles.

    ``own`` are the shingles from ``low`` on. Each is matched with the equal shingle of ``other`` that is nearest to the
    alignment. Runs of matches join over gaps of up to GAP while their matched share holds; a joined passage counts if the
    sets of its shingles are similar enough.
    """
    if not len(other.shingles) or not len(own):
        return []
    want = np.arange(len(own)) + low + shift - other.low
    match = other.nearest(own, want)
    hit = np.flatnonzero((match >= 0) & (np.abs(match - want) <= 4 * DRIFT))
    if not len(hit):
        return []
    breaks = np.flatnonzero((np.diff(hit) != 1) | (np.diff(match[hit]) != 1)) + 1
    begin, end = np.concatenate([[0], breaks]), np.concatenate([breaks - 1, [len(hit) - 1]])
    runs = np.column_stack([hit[begin], hit[end], match[hit[begin]], match[hit[end]]]).tolist()
    out, held, matched, exact = [], None, 0, True
    for a, b, x, y in [*runs, (0, 0, 0, 0)]:
        n = b - a + 1
        if held and x > held[3] and a - held[1] - 1 <= GAP and x - held[3] - 1 <= GAP:
            both = matched + n
            if both >= SIMILARITY * (b - held[0] + 1 + y - held[2] + 1 - both):
                held, matched, exact = (held[0], b, held[2], y), both, False
                continue
        if held and held[1] - held[0] + 1 >= SPAN:
            s = 1.0 if exact else similarity(own[held[0] : held[1] + 1], other.shingles[held[2] : held[3] + 1])
            if s >= SIMILARITY:
                out.append((held[0] + low, held[1] + low, held[2] + other.low, held[3] + other.low, s))
        held, matched, exact = (a, b, x, y), n, True
    return out


def cover(rows: list[tuple]) -> list[tuple]:
    """Of intervals (first, last, ...) those that cover all places which any covers, each time the one that reaches furthest."""
    out, best, reach = [], None, -1
    for row in sorted(rows, key=lambda r: (r[0], -r[1], r[2:])):
        if best and row[0] > reach + 1:  # the best is needed for the place behind ``reach``
            out.append(best)
            best, reach = None, best[1]
        if row[1] > max(reach, best[1] if best else -1):
            best = row
    return [*out, best] if best else out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From messages sorted by (other, part, kind): an earlier document's words come before its followers'. Texts that share an
    id are held together."""
    held, others = None, []
    names = ["content", *(c.split()[0] for c in PASSAGES.split(", "))]
    for b in batches:
        out = []
        fields = [b[c].tolist() for c in ("other", "part", "kind", "doc_id", "content", "low", "shifts", "lows", "highs")]
        for at, texts in chunks(b["words"]):
            shingles, begin = WordHashes(texts).shingles()
            for d in range(len(texts)):
                o, p, kind, doc, content, low, shifts, lows, highs = (f[at + d] for f in fields)
                own = shingles[begin[d] : begin[d + 1]]
                if held != (o, p):
                    held, others = (o, p), []
                if kind == 0:
                    others.append(Places(own.copy(), low))
                    continue
                found = [x for a, z, shift in zip(lows.tolist(), highs.tolist(), shifts.tolist(), strict=True) for other in others for x in verify(own[a - low : z - low + 1], a, other, shift)]
                out += [(content, doc, x, y + SHINGLE - 1, o, u, v + SHINGLE - 1, s) for x, y, u, v, s in cover(found)]
        if out:
            yield pd.DataFrame(out, columns=names)


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From passages sorted by doc_id: of those of each text a cover. A document's passages are held together."""
    names = [c.split()[0] for c in PASSAGES.split(", ")]
    for b in runs(batches, "doc_id"):
        texts: dict[tuple, list[tuple]] = {}
        for content, doc, *row in b[["content", *names]].itertuples(index=False, name=None):
            texts.setdefault((content, doc), []).append(tuple(row))
        yield pd.DataFrame([(*text, *row) for text, rows in texts.items() for row in cover(rows)], columns=["content", *names])


def _passages(docs: DataFrame) -> DataFrame:
    """PASSAGES, and ``content``: the hash of the text that has the passage, for rows that share an id."""
    spark = docs.sparkSession
    n = partitions(spark)
    long = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    windows = long.mapInPandas(tidy(_windows(*hot_keys(long))), WINDOWS).repartition(n, "key").sortWithinPartitions("key", "doc_id", "middle")
    sides = windows.mapInPandas(tidy(_key_ties), SIDES).repartition(n, "side_group").sortWithinPartitions("side_group", "doc_id", "middle")
    ties = sides.mapInPandas(tidy(_side_ties), TIES)
    found = ties.repartition(n, "doc_id").sortWithinPartitions("doc_id").mapInPandas(tidy(_candidates), CANDIDATES)
    found = materialize(found, "candidates")
    pad = 4 * DRIFT
    first = found.groupBy("other").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("parts"), (F.min(F.col("low") + F.array_min("shifts")) - pad).alias("from_shingle"), (F.max(F.col("high") + F.array_max("shifts")) + pad).alias("to_shingle"))
    first = materialize(first, "firsts")
    shared = found.hint("merge").join(first.select("other", "parts"), "other")
    own = shared.groupBy("doc_id").agg(F.collect_list(F.struct("other", "low", "high", "shifts", "lows", "highs", "parts")).alias("c"))  # as many as a document's windows allow
    served = first.select(F.col("other").alias("doc_id"), F.col("parts").alias("own_parts"), "from_shingle", "to_shingle")
    asked = own.hint("merge").join(served, "doc_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    asked = asked.select("doc_id", zero("own_parts"), zero("from_shingle"), zero("to_shingle"), *[F.col(f"c.{x}").alias(y) for x, y in (("other", "others"), ("low", "from_low"), ("high", "to_high"), ("shifts", "shifts"), ("lows", "lows"), ("highs", "highs"), ("parts", "shares"))])
    messages = asked.hint("merge").join(long.withColumn("content", F.xxhash64("text")), "doc_id").mapInPandas(tidy(_messages), MESSAGES)
    dealt = messages.repartition(n, "other", "part").sortWithinPartitions("other", "part", "kind", "doc_id")
    verified = dealt.mapInPandas(tidy(_verified), f"content long, {PASSAGES}").repartition(n, "doc_id")
    return verified.sortWithinPartitions("doc_id").mapInPandas(tidy(_cover), f"content long, {PASSAGES}")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of 50 words or more of ``docs`` (doc_id, text) that an earlier document (a smaller id) has, too.

    Columns: doc_id, first_word, last_word (numbers from 0 of the words that ASCII white space parts), the same of the
    other document, and the similarity of the two sets of shingles (of 64-bit hashes). Of overlapping passages only those are
    returned that are needed to cover all words which any earlier document has, so there are no pairs within groups. Rows with a null id and texts below
    50 words, empty or null have no passages. Equal rows of one id are one document; of different texts that share an id
    each has its own passages, but none against the other. A text is held in one task with about 100 bytes for each of its
    own.
    """
    return _passages(docs).drop("content")


SPANS = "cachesight_spans"


def cut_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that an earlier document has; n_chars follows. A document of which no word is left goes.
    Rows that share an id are cut each by the passages of its own text."""
    found = _passages(docs).groupBy(F.col("doc_id").alias("cachesight_id"), F.col("content").alias("cachesight_content"))
    spans = found.agg(F.collect_set(F.struct("first_word", "last_word")).alias(SPANS))
    same = (docs["doc_id"] == spans["cachesight_id"]) & (F.xxhash64(docs["text"]) == spans["cachesight_content"])
    joined = docs.hint("merge").join(spans, same, "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(text, own, strict=True)], dtype=object)

    changed = F.col(SPANS).isNotNull() & F.col("text").isNotNull()
    new = joined.withColumn("text", F.when(changed, cut("text", SPANS)).otherwise(F.col("text")))
    new = new.where(F.col(SPANS).isNull() | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


def _without(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    data = text.encode()
    start = [*WordHashes([data]).start.tolist(), len(data)]
    kept, at = [], 0
    for first, last in sorted((int(s["first_word"]), int(s["last_word"])) for s in spans):
        if start[first] > at:
            kept.append(data[at : start[first]])
        at = max(at, start[last + 1])
    kept.append(data[at:])
    return b"".join(kept).decode()


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
