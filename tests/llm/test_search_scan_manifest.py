"""Operators 11, 12 and 13 against brute force and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachesight.llm import block_max, credentials, merkle
from cachesight.llm.common import table

# --- 11: ranked lexical search ----------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def ranked_by_hand(docs, items, top=10):
    own = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        q, found = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c, size in own:
            m = 25 + 75 * size * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in q.items() if t in c)
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def invented(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgé日", k=r.randint(1, 12))) for _ in range(words)]
    text = lambda k: r.choice([" ", ", ", "\n"]).join(vocabulary[min(int(r.expovariate(0.02)), words - 1)] for _ in range(k))
    return [(k, text(r.choice([0, 1, 5, 30, 30, 200]))) for k in range(n)], [(k, text(r.choice([1, 3, 12]))) for k in range(25)]


def test_op11_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert sorted(map(tuple, block_max.op11_ranked_search(spark, sf).collect()), key=repr) == ranked_by_hand(docs, items)


def test_op11_edges(spark):
    docs, items = invented(1, 300)
    docs += [(None, docs[5][1]), (None, None), (7, docs[7][1]), (1 << 60, docs[8][1]), ((1 << 60) + 1, docs[8][1]), (400, "A\0B Zeta ZETA"), (401, "x" * 50_000), (402, "lonely " * 3000)]
    items += [(None, docs[5][1]), (90, None), (91, "..."), (92, "zeta lonely " + "x" * 50_000), (92, "zeta lonely"), (93, "nowhere-at-all"), (94, docs[8][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    index = block_max.build_index(frame)
    got = block_max.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_hand(docs, items)
    assert not block_max.search(index, spark.createDataFrame([], "item_id long, text string")).collect()
    assert not block_max.search(block_max.build_index(frame.limit(0)), spark.createDataFrame(items, "item_id long, text string")).collect()


def test_op11_rounds_and_segments(monkeypatch, spark):
    """Items in rounds of seven; documents in segments of one text or two."""
    import pandas as pd

    monkeypatch.setattr(block_max, "ITEMS", 7)
    monkeypatch.setattr(block_max, "SEGMENT", 1500)
    docs, items = invented(2, 200)
    frame = pd.DataFrame({"doc_id": [d for d, _ in docs], "known": True, "text": [t for _, t in docs]})
    rows = [r for k in range(0, 200, 20) for out in block_max._segments(iter([frame.iloc[k : k + 20]])) for r in out.to_dict("records")]
    assert len(rows) > 8
    index = spark.createDataFrame([tuple(r[c] for c in block_max.COLUMNS) for r in rows], block_max.SEGMENTS)
    got = block_max.search(index, spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_by_hand(docs, items, 5)


def test_op11_blocks_are_skipped():
    """Most documents of a skewed list are never scored, and none of the best is missed."""
    import pandas as pd

    docs = [(k, "common " * (1 + k % 50) * (k % 10 > 0) + ("rare " * 40 if k % 2000 == 0 else "filler " * (k % 97))) for k in range(20_000)]
    frame = pd.DataFrame({"doc_id": [d for d, _ in docs], "known": True, "text": [t for _, t in docs]})
    rows = [r for out in block_max._segments(iter([frame])) for r in out.itertuples(index=False)]
    n, total = sum(r.n_docs for r in rows), sum(r.n_terms for r in rows)
    s = block_max.Searcher([Counter([b"rare", b"common"])], {b"rare": 10, b"common": 18_000}, n, total, 10)
    for r in rows:
        s.see(r)
    assert {d for _, d in s.best[0]} == set(range(0, 20_000, 2000)) and s.scored < s.seen / 4


def test_op11_cuts_are_optimal():
    r = np.random.default_rng(3)
    sizes = [1, 7, 8, 9, 40, 131, 16, 300]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    scores = r.integers(0, 10**6, begin[-1])
    got = block_max.cut(scores, begin).tolist()

    def cost(a, b):
        return int(scores[a:b].max()) * (b - a) - int(scores[a:b].sum()) + block_max.PRICE

    assert set(begin[:-1].tolist()) <= set(got)
    for a, b in zip(begin.tolist(), begin[1:].tolist()):
        cells = [*range(a, b, block_max.CELL), b]
        best = {0: 0}
        for j in range(1, len(cells)):
            best[j] = min(best[i] + cost(cells[i], cells[j]) for i in range(max(0, j - block_max.LONGEST), j))
        own = [x for x in got if a <= x < b] + [b]
        assert sum(cost(x, y) for x, y in zip(own, own[1:])) == best[len(cells) - 1]


# --- 12: secret scans -------------------------------------------------------------------------------------------------

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def base_by_hand(text):
    kinds = list(BASE)
    return [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted((m.start(), kinds.index(kind), m.end()) for kind, (p, ok) in BASE.items() for m in p.finditer(text or "") if ok(m))]


HEX = "0123456789abcdef" * 3
ODD = [
    None, "", "password=short", 'ſecret: "abcdefgh" toKen=abcdefgh', "é" * 9 + 'API_KEY\' : "A1b2C3d4=="', "apikey=" + HEX, "AKIA" + "A" * 11, "AKIA" + "A" * 12 + "é", "xAKIAAKIA1234567890 " + HEX.upper(),
    "token = token=tokentoken=12345678", "secret=\npassword:    'x.y/z+12345'", HEX[:31] + "g" + HEX[:32], "日本 passwd==========", "token: " + "A" * 100_000, "😀 secret:secretsecret",
]


def test_op12_base_spans(spark, sf):
    docs = spark.createDataFrame(list(enumerate(ODD)) + [(None, ODD[3]), (3, ODD[3]), (3, ODD[3])], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    docs = docs.unionByName(table(spark, sf, "documents").select("doc_id", "text").withColumn("spans", F.lit("clash")))
    own = sorted((str(r.doc_id), base_by_hand(r.text)) for r in docs.collect())
    got = credentials.secrets(docs).collect()
    assert sorted((str(r.doc_id), [f"{x.kind}:{x.start}:{x.end}" for x in r.spans if x.kind != "grammar"]) for r in got) == own
    assert any(x for _, x in own) and not credentials.secrets(docs.limit(0)).collect()


def test_op12_query(spark, sf):
    rows = {r.doc_id: r for r in credentials.op12_secret_scan(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        base = base_by_hand(r.text)
        own = rows.pop(r.doc_id)
        assert (own.n_assign, own.n_access, own.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign:", "access:", "hex:"))
        assert own.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(own.spans.split(",")) | {""}
    assert not rows


def test_op12_held_out(spark):
    """Credentials and other strings that no automaton has seen."""
    scorer = credentials.Scorer(*credentials.grammars(spark))
    fresh = credentials.labelled(150, seed=77)
    found = scorer.formats([x.encode() for _, x in fresh])
    right, of, wrong = Counter(), Counter(), []
    for (name, x), f in zip(fresh, found, strict=True):
        of[name] += 1
        right[name] += f is not None and f[0] == name
        wrong += [x] if name == credentials.BACKGROUND and f else []
    assert all(right[n] >= 0.9 * of[n] for n in credentials.FORMATS) and len(wrong) <= 0.002 * of[credentials.BACKGROUND], (right, wrong)


def test_op12_adds_spans_and_redacts(spark):
    own = [x for n, x in credentials.labelled(30, seed=5) if n in ("github", "google")]
    docs = spark.createDataFrame([(k, f"né é {x}. and a commonplace/path/of_words/here.txt {HEX}") for k, x in enumerate(own)] + [(99, None), (None, "nothing")], "doc_id long, text string").withColumn("n", F.lit(1))
    rows = {r.doc_id: r.spans for r in credentials.secrets(docs).collect()}
    hit = [k for k, x in enumerate(own) if [(s.kind, s.start, s.end) for s in rows[k]][0] == ("grammar", 5, 5 + len(x))]
    assert len(hit) >= 0.9 * len(own) and rows[None] == rows[99] == []
    out = {r.doc_id: r for r in credentials.redacted(docs).collect()}
    assert out[hit[0]].text == "né é [grammar]. and a commonplace/path/of_words/here.txt [hex]" and out[hit[0]].n == 1
    assert out[99].text is None and out[None].text == "nothing"


def test_op12_merges_what_agrees():
    states = credentials.infer(["ab" * k for k in range(1, 40)] * 20)
    assert len(states) <= 4  # a loop of two letters, not a chain of 78
    states = credentials.infer(["ax", "by"] * 200)
    assert {tuple(s[0] for s in x[2]) for x in states} == {("a", "b"), ("x",), ("y",), ()}


# --- 13: Merkle manifest ----------------------------------------------------------------------------------------------


def manifest_by_hand(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h(*map(framed, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t)))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for x, k in enumerate(at):
                run = k // 8 * 8
                paths[x].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 8])))
                at[x] = k // 8
            nodes = [h(*nodes[j : j + 8]) for j in range(0, len(nodes), 8)]
        return nodes[0], paths

    groups, out = {}, []
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
    subs = {g: climb([x[2] for x in groups[g]]) for g in order}
    root, above = climb([subs[g][0] for g in order]) if order else (None, [])
    for g, high in zip(order, above):
        for (known, doc, own, r), low in zip(groups[g], subs[g][1]):
            at = leaf(r, r["text"] and r["text"].translate(LOWER)) if known and zlib.crc32(str(doc).encode()) % 3 == 0 else own
            for left, right in low + high:
                at = h(left, at, right)
            out.append((r["doc_id"], own, subs[g][0], root, h(*[a + b for a, b in low + high]), at, at == root))
    return sorted(out, key=repr)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 513, 1300])
def test_op13_shapes(spark, n):
    r = random.Random(n)
    rows = [(r.choice([k, k << 20, -k - 1, (k << 44) + 5]), "s", r.choice(["en"] * 8 + ["fr", None, "é", "z"]), k, f"Text {k}") for k in range(n)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("leaf", F.lit("clash")).repartition(3)
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=repr) == manifest_by_hand([x.asDict() for x in docs.collect()])


def test_op13_nulls_repeats_and_many_groups(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "s", "en", 1, "A b"), (3, "s", "en", 1, ""), (3, "s", "en", 1, "Ünï"), *[(5, "s", "en", 1, "Same")] * 700, *[(k, "s", f"l{k % 90}", 1, "x") for k in range(200)], (1, "", "", 0, "LONG " * 30_000)]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=repr) == manifest_by_hand([x.asDict() for x in docs.collect()])
    assert not merkle.manifest(docs.limit(0)).collect()


def test_op13_full_prefixes(spark, monkeypatch):
    """Many different rows of one id are told apart by digits of their leaves."""
    monkeypatch.setattr(merkle, "FULL", 20)
    rows = [(None if k % 2 else 4, "s", "en", k, f"Text {k}") for k in range(400)] + [(k, "s", "en", k, "t") for k in range(3000, 3100)]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=repr) == manifest_by_hand([x.asDict() for x in docs.collect()])


def test_op13_query(spark, sf):
    got = merkle.op13_merkle_manifest(spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == manifest_by_hand([x.asDict() for x in table(spark, sf, "documents").collect()])
    assert {r.verified for r in got} == {True, False}
