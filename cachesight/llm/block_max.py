"""Ranked lexical search with variable-block-max WAND.

1. Segments: a task streams its documents into segments of about SEGMENT bytes of text. A segment numbers its documents by
   length, so that neighbours have like scores, and holds each term's postings (document, occurrences). Terms are told apart by
   their bytes: up to eight of them are one integer, longer words are looked up as they are.
2. Statistics over all segments: documents, terms, and in how many documents each term of the items is.
3. A posting list is cut into blocks by dynamic programming: of all ways to cut it, the one whose sum over the postings of
   (the block's largest score - the own score), with a price for each block, is least.
4. Search, segment by segment: the sums of the largest scores of the blocks that cover a range of documents bound every score
   there. Ranges are scored in order of their bounds until the bounds fall below the k-th best score; what is left is skipped.
   The best so far go along from segment to segment of a task, and the tasks' best are merged. The result is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachesight.llm.common import chunks, materialize, table, tidy

#: Bytes of text of a segment, about; a longer text makes a segment of its own.
SEGMENT = 1 << 23
#: Postings that a cut does not part, cells of the longest block, and a block's price in scores (a millionth is the unit).
CELL, LONGEST, PRICE = 8, 16, 2_000_000
#: Items and different terms that are searched at once; more are searched in further rounds over the segments.
ITEMS, TERMS = 2_000, 200_000
TOP = 10
#: Fixed values of the score: b in hundredths, the factors of the saturation, the scale of weights.
B, SCALE, WEIGHT, K = 75, 1_000_000_000, 1000, 8

_BYTES = np.arange(256)
_IS_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
_FOLD = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
SEGMENTS = "n_docs long, n_terms long, doc_ids binary, known binary, lengths binary, terms binary, begin binary, docs binary, tf binary"
COLUMNS = [x.split()[0] for x in SEGMENTS.split(", ")]


def split_terms(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different terms of some texts, and for each occurrence its text and its term's number."""
    buf = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), np.uint8)]
    edge = np.flatnonzero(np.diff(_IS_WORD[buf], prepend=False))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    doc, size = np.searchsorted(ends, start, "right"), end - start
    number = np.empty(len(start), np.int64)
    short = np.flatnonzero(size <= 8)
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)[start[short]]
    keys, number[short] = np.unique(np.ascontiguousarray(eight).view("<u8").ravel() & _MASK[size[short]], return_inverse=True)
    names = [x.rstrip(b"\0") for x in keys.astype("<u8").view("S8").tolist()]
    data, known = buf.tobytes(), {}
    long = np.flatnonzero(size > 8)
    number[long] = [known.setdefault(data[a:b], len(names) + len(known)) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return names + list(known), doc, number


class Segment:
    """Documents and postings as they come, until ``row``."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.n = 0
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray, known: np.ndarray, texts: list[bytes]) -> None:
        names, doc, number = split_terms(texts)
        own = np.fromiter((self.terms.setdefault(x, len(self.terms)) for x in names), np.int64, len(names))
        code, tf = np.unique(doc * max(len(names), 1) + number, return_counts=True)
        if len(code):
            self.parts.append((own[code % len(names)], code // len(names) + self.n, tf))
        self.lengths.append(np.bincount(doc, minlength=len(texts)))
        self.ids.append(ids)
        self.known.append(known)
        self.n += len(texts)
        self.size += sum(map(len, texts))

    def row(self) -> dict:
        lengths = np.concatenate(self.lengths)
        order = np.argsort(lengths, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        term, doc, tf = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else [np.empty(0, np.int64)] * 3
        doc = place[doc]
        by = np.lexsort((doc, term))
        begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.terms)))])
        out = {"n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "terms": b"\n".join(self.terms)}
        out |= {"doc_ids": np.concatenate(self.ids)[order].astype("<i8").tobytes(), "known": np.concatenate(self.known)[order].astype("u1").tobytes()}
        return out | {"lengths": lengths[order].astype("<i8").tobytes(), "begin": begin.astype("<i8").tobytes(), "docs": doc[by].astype("<i4").tobytes(), "tf": tf[by].astype("<i4").tobytes()}


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = Segment()
    for b in batches:
        ids, known = b["doc_id"].to_numpy(), b["known"].to_numpy()
        for at, part in chunks(b["text"]):
            if held.size and held.size + sum(map(len, part)) > SEGMENT:
                yield pd.DataFrame([held.row()], columns=COLUMNS)
                held = Segment()
            held.add(ids[at : at + len(part)], known[at : at + len(part)], part)
    if held.n:
        yield pd.DataFrame([held.row()], columns=COLUMNS)


def build_index(docs: DataFrame) -> DataFrame:
    """Segments over all rows of ``docs`` (doc_id, text), written to the shared folder.

    Null and empty texts are documents without terms. Null ids are kept; rows that share an id are documents of their own.
    """
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), F.col("text").cast("string").alias("text"))
    return materialize(own.mapInPandas(tidy(_segments), SEGMENTS), "segments")


def cut(scores: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """First postings of the blocks of all lists, where list k is ``scores[begin[k]:begin[k + 1]]``.

    The dynamic program runs over cells of CELL postings, for all lists side by side: the best way to cut the first j cells
    ends in a block of 1 to LONGEST cells behind the best way to cut the ones before it.
    """
    cells = -(-np.diff(begin) // CELL)
    order = np.argsort(-cells, kind="stable")  # the longest lists first, so those that go on are always the first ones
    n = cells[order]
    if not len(n) or not n[0]:
        return begin[:0]
    first = np.concatenate([[0], np.cumsum(cells)[:-1]])  # cell of each list
    at = np.repeat(begin[:-1], cells) + CELL * (np.arange(cells.sum()) - np.repeat(first, cells))
    most, total, count = np.maximum.reduceat(scores, at), np.add.reduceat(scores, at), np.diff(np.append(at, begin[-1]))
    first = first[order]
    longest = int(n[0])
    best = np.full((len(n), longest + 1), np.iinfo(np.int64).max // 4, np.int64)
    best[:, 0], back = 0, np.zeros((len(n), longest + 1), np.int8)
    for j in range(1, longest + 1):
        live = int(np.searchsorted(-n, -j, "right"))
        high, weight, sums = np.zeros(live, np.int64), np.zeros(live, np.int64), np.zeros(live, np.int64)
        for d in range(1, min(LONGEST, j) + 1):
            cell = first[:live] + j - d
            high, weight, sums = np.maximum(high, most[cell]), weight + count[cell], sums + total[cell]
            cost = best[:live, j - d] + high * weight - sums + PRICE
            better = cost < best[:live, j]
            best[:live, j][better], back[:live, j][better] = cost[better], d
    starts, j, live = [], n.copy(), np.arange(len(n))
    while len(live):
        j[live] -= back[live, j[live]]
        starts.append(at[first[live] + j[live]])
        live = live[j[live] > 0]
    return np.sort(np.concatenate(starts))


class Searcher:
    """Holds the best documents of each item over the segments that it has seen."""

    def __init__(self, items: list[Counter], df: dict[bytes, int], n: int, total: int, top: int):
        self.n, self.total, self.top = n, total, top
        weight = {t: math.floor(WEIGHT * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
        self.items = [{t: c * weight[t] for t, c in x.items() if weight.get(t)} for x in items]
        self.wanted = {t for x in self.items for t in x}
        self.best: list[list[tuple[int, int | None]]] = [[] for _ in items]  # (score, doc_id), best first
        self.scored = self.seen = 0

    def see(self, row) -> None:
        lengths, begin = np.frombuffer(row.lengths, "<i8"), np.frombuffer(row.begin, "<i8")
        docs, tf = np.frombuffer(row.docs, "<i4"), np.frombuffer(row.tf, "<i4")
        terms = [(t, k) for k, t in enumerate(row.terms.split(b"\n")) if t in self.wanted]
        if not terms:
            return
        some, inverse = np.unique(lengths, return_inverse=True)
        m = np.array([100 - B + B * int(x) * self.n // self.total for x in some], np.int64)[inverse]
        rows = [np.arange(begin[k], begin[k + 1]) for _, k in terms]
        first = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        rows = np.concatenate(rows)
        doc, times = docs[rows].astype(np.int64), tf[rows].astype(np.int64)
        scores = SCALE * times // (1000 * times + K * m[doc])
        blocks = cut(scores, first)
        most = np.maximum.reduceat(scores, blocks)
        stop = np.append(blocks[1:], len(scores))
        low, high = doc[blocks], doc[stop - 1] + 1
        own = np.searchsorted(blocks, first)
        place = {t: k for k, (t, _) in enumerate(terms)}
        ids = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.known, "u1")
        for k, item in enumerate(self.items):
            lists = [(place[t], w) for t, w in item.items() if t in place]
            if lists:
                self._search(k, lists, first, own, doc, scores, low, high, most, ids)

    def _search(self, k, lists, first, own, doc, scores, low, high, most, ids) -> None:
        best = self.best[k]
        b = np.concatenate([np.arange(own[x], own[x + 1]) for x, _ in lists])
        w = np.repeat(np.array([w for _, w in lists]), [own[x + 1] - own[x] for x, _ in lists])
        where, step = np.concatenate([low[b], high[b]]), np.concatenate([w * most[b], -w * most[b]])
        edges, inverse = np.unique(where, return_inverse=True)
        bound = np.zeros(len(edges), np.int64)
        np.add.at(bound, inverse, step)
        bound = bound.cumsum()[:-1]  # from edges[r] to edges[r + 1]
        of_doc = np.repeat(bound, np.diff(edges))  # documents from edges[0] on
        base, n = edges[0], edges[-1] - edges[0]
        least = best[-1][0] if len(best) == self.top else 1
        self.seen += len(of_doc)
        live = of_doc >= least
        todo = [live]
        if live.sum() > 8 * self.top:  # the ranges of the largest bounds first: they raise what the others have to reach
            border = np.partition(of_doc, -4 * self.top)[-4 * self.top]
            todo = [live & (of_doc >= border), live & (of_doc < border)]
        for chosen in todo:
            chosen = chosen & (of_doc >= least)
            if not chosen.any():
                continue
            total = np.zeros(n, np.int64)
            for x, weight in lists:
                d = doc[first[x] : first[x + 1]] - base
                here = chosen[d]
                total[d[here]] += weight * scores[first[x] : first[x + 1]][here]
            self.scored += int(chosen.sum())
            found = np.flatnonzero(total >= least)
            if len(found) > self.top:  # ties with the last one stay
                found = found[total[found] >= np.partition(total[found], -self.top)[-self.top]]
            if len(found):
                best += [(s, d if known else None) for s, d, known in zip(total[found].tolist(), *(x[found + base].tolist() for x in ids))]
                best.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
                del best[self.top :]
                least = best[-1][0] if len(best) == self.top else 1


def _searching(items: list[Counter], df: dict[bytes, int], n: int, total: int, top: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(items, df, n, total, top)
        for b in batches:
            for row in b.itertuples(index=False):
                searcher.see(row)
        rows = [(k, d, s) for k, own in enumerate(searcher.best) for s, d in own]
        yield pd.DataFrame({"item": [r[0] for r in rows], "doc_id": pd.array([r[1] for r in rows], "Int64"), "score": [r[2] for r in rows]}).astype({"item": "int64", "score": "int64"})

    return run


def _seen_terms(wanted: set[bytes]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = Counter()
        for b in batches:
            for terms, begin in zip(b["terms"], b["begin"], strict=True):
                size = np.diff(np.frombuffer(begin, "<i8"))
                for k, t in enumerate(terms.split(b"\n") if len(size) else []):
                    if t in wanted:
                        df[t] += int(size[k])
        yield pd.DataFrame({"term": pd.Series(list(df), dtype=object), "df": pd.Series(list(df.values()), dtype="int64")})

    return run


def _rounds(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """Items with their terms, ITEMS of them or TERMS different terms at a time."""
    held, terms = [], set()
    for r in items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").toLocalIterator():
        names, _, number = split_terms([r.text.encode()])
        own = Counter(names[k] for k in number.tolist())
        if held and (len(held) == ITEMS or len(terms | own.keys()) > TERMS):
            yield held
            held, terms = [], set()
        held.append((r.item_id, own))
        terms |= own.keys()
    if held:
        yield held


def search(index: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of ``items`` (item_id, text) the ``top`` best documents of ``index``.

    A null text has no terms and finds nothing; a null item_id is kept; repeated rows of ``items`` are items of their own. Equal
    scores go by doc_id, null first. The driver and each task hold the items of one round at a time.
    """
    spark = index.sparkSession
    r = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    kind = items.schema["item_id"].dataType
    parts, schema = [], f"item long, doc_id long, score long"
    for own in _rounds(items) if r.n else ():
        wanted = {t for _, x in own for t in x}
        df = {bytes(x.term): x.df for x in index.select("terms", "begin").mapInPandas(_seen_terms(wanted), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        found = index.mapInPandas(tidy(_searching([x for _, x in own], df, r.n, r.total, top)), schema)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = F.broadcast(spark.createDataFrame([(k, i) for k, (i, _) in enumerate(own)], f"item long, item_id {kind.simpleString()}"))  # ITEMS rows at most
        parts.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_SQL_TERMS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
sums AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY row, term),
items AS (SELECT row_number() OVER () AS item, item_id, {_SQL_TERMS.format('text')} AS t FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(t) AS term FROM items) GROUP BY item, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, sums WHERE term IN (SELECT term FROM q) GROUP BY term, n),
m AS (SELECT row, doc_id, 25 + ((75 * len(t)::BIGINT * n) // total) AS m FROM d, sums WHERE len(t) > 0),
scored AS (SELECT item, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY item, row),
ranked AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored JOIN m USING (row) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN items USING (item) WHERE rank <= 10
"""
