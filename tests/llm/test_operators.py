"""Each operator against brute force, an exact round trip or held-out labels."""

import hashlib
import itertools
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cachesight.llm import archives, compact_windows, decontaminate, main_text, neighbours, packing, quality, signature_trees, token_counts, token_files
from cachesight.llm.common import WordHashes, connected_components, shared_dir, table
from cachesight.llm.pieces import Pieces

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  a  b", "a\n b", "\n\nx y", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>c", "it's  I'll 'S x's", "ΑΣ Σας. Ünï é a ́b", "a\x1cb \x1c c\xa0d  e", " lead", "tail ", "a.  ", "x​ y", "123 45a", "日本語 テスト。", "a , b", "İstanbul Ǆ", "word.\nNext, and\nthen"]


def texts(spark, sf):
    return {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_library(spark, sf, name):
    some = [*ODD, *texts(spark, sf).values()]
    want = [e.ids for e in tokenizers.Tokenizer.from_file(public.path(name)).encode_batch(some, add_special_tokens=False)]
    assert Pieces(public.path(name), counts=True).many(some) == [len(x) for x in want]
    own = Pieces(public.path(name), limit=50)  # so small that it is renewed again and again
    assert own.many(some) == [np.array(x, "<u2").tobytes() for x in want]


def test_op1_counts_and_cache(spark, sf):
    cache, path = shared_dir(spark, "t"), public.path("byte_bpe_50k.json")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    half = token_counts.token_counts(docs.where("doc_id % 2 = 0"), path, cache).count()
    stored = spark.read.parquet(cache).count()
    rows = token_counts.token_counts(docs, path, cache).collect()
    again = token_counts.token_counts(docs, path, cache).count()
    own, t = texts(spark, sf), tokenizers.Tokenizer.from_file(path)
    assert half and stored <= half and again == len(rows) == len(own)
    assert spark.read.parquet(cache).count() == len(set(own.values()))  # misses were encoded once
    assert all(r.n_tokens == len(t.encode(own[r.doc_id]).ids) and r.n_bytes == len(own[r.doc_id].encode()) for r in rows)


def test_op10_files(spark, sf):
    rows = sorted(token_files.op10_token_files(spark, sf).collect())
    t, at = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json")), 0
    own = texts(spark, sf)
    for r in rows:
        ids = t.encode(own[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(rows) == len(own)


def test_op2_round_trip(spark, sf):
    own = {r.page_id: (r.html or "").encode() for r in table(spark, sf, "pages").collect()}
    rows = archives.op2_arc_to_warc(spark, sf).collect()
    assert len(rows) == len(own)
    first = {}
    for i in sorted(own):
        first.setdefault(own[i], i)
    for r in rows:
        body = own[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == archives.sha1_base32(body)
        assert (r.record_type, r.refers_to) == (("response", None) if first[body] == r.page_id else ("revisit", first[body]))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\na\nb"
    record = archives.arc_record(version, "http://a/b c", "1.2.3.4", "19990102030405", "text/html", body, "f", 7)
    fields, got, _ = archives.parse_arc(record, version)
    assert got == body and fields["URL"] == "http://a/b c" and len(fields) == len(archives.ARC_FIELDS[version].split())
    warc, block = archives.parse_warc(archives.to_warc(fields, got, 5, "D", None))
    assert block == body and warc["WARC-Date"] == "1999-01-02T03:04:05Z" and warc["WARC-Type"] == "response"
    warc, block = archives.parse_warc(archives.to_warc(fields, got, 5, "D", 2))
    assert block.endswith(b"\r\n\r\n") and warc["WARC-Type"] == "revisit" and warc["X-Refers-To-Row"] == "2"
    with pytest.raises(ValueError):
        archives.parse_arc(record[:-8], version)
    if version == 2:
        with pytest.raises(ValueError, match="checksum"):
            archives.parse_arc(record.replace(b"a\nb", b"a\nc"), version)


@pytest.mark.parametrize("form", ["plain", "whole", "records"])
@pytest.mark.parametrize("version", [1, 2])
def test_arc_forms(spark, version, form):
    """Archives that are compressed by record, as a whole or not at all, with heads of bare newlines, become WARC records."""
    import gzip

    folder, warcs = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    os.makedirs(folder)
    bodies = [b"HTTP/1.0 200 OK\nContent-Length: 5\nX-Row: 1\n\nfirst", b"HTTP/1.0 200 OK\r\nContent-Length: 5\r\nX-Row: 2\r\n\r\nfirst", b"no message at all"]
    records = [archives.arc_header(version, "f", "19990102030405"), *(archives.arc_record(version, f"http://a/{k}", "1.2.3.4", "19990102030405", "text/html", b, "f", 0) for k, b in enumerate(bodies))]
    data = {"plain": b"".join(records), "whole": gzip.compress(b"".join(records)), "records": b"".join(map(gzip.compress, records))}[form]
    with open(f"{folder}/f.arc.gz", "wb") as f:
        f.write(data)
    names = spark.createDataFrame([("f.arc.gz",)], "name string")
    plan = archives.plan_revisits(archives.index_arcs(names, folder))
    got = sorted((r.url, r.record_type, r.payload_bytes, r.refers_to) for r in archives.read_warcs(archives.write_warcs(plan, folder, warcs), warcs).collect())
    assert got == [("http://a/0", "response", 5, None), ("http://a/1", "revisit", 5, 1), ("http://a/2", "resource", 17, None)]


def test_op4_articles(spark, sf):
    import html

    tree = main_text.train(main_text.LABELLED)
    for r in table(spark, sf, "pages").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h\d)[^>]*>", article)]
        assert main_text.main_text(r.html, tree) == "\n".join(x for x in want if x)


PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h2>Site</h2></header>
<div class="cookie-notice"><p>We use cookies &amp; more, read our long policy about them if you like to.</p></div><nav><a href=x>Home</a></nav>
<main><article><header><h1>Head&shy;line</h1></header><p>First   para&nbsp;graph<br>goes on.</p><aside>Related things</aside><ul><li>one</li><li><a href=y>two</a></li></ul>
<form><input><p>Sign up here</p></form><p>Last.</p></article><section id="comments"><article class="comment"><p>I think that this is a very long comment by a reader who has much to say.</p></article></section></main>
<div class="sidebar"><p>Other news of the day that nobody wants to read in this place.</p></div><footer>&copy; me</footer></body>"""


def test_op4_containers():
    tree = main_text.train(main_text.LABELLED)
    assert main_text.main_text(PAGE, tree).split("\n") == ["Head\xadline", "First para graph goes on.", "one", "two", "Last."]
    plain = "<body><div><a href=a>Menu</a> <a href=b>More</a></div><div>" + "many plain words in a long block " * 12 + "</div><p>" + "and another block of words " * 10 + "</p><div><a href=c>Imprint</a></div>"
    assert len(main_text.main_text(plain, tree).split("\n")) == 2


WORDS = "a sentence of some length that says what has happened here and why it did "


@pytest.mark.parametrize("wrapper", ['class="has-sidebar header-top"', 'id="toolbar-page"', 'class="main-with-sidebar"', ""])
def test_op4_layouts(wrapper):
    """In the wrapper of a layout, or without any container, words and links of a block and its neighbours decide."""
    tree = main_text.train(main_text.LABELLED)
    bar = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>Sport and more</a></li></ul><p>Try our service</p><p><a href=d>Join now</a></p>"
    text = [(WORDS * n).strip() for n in (5, 6, 7, 5)]
    page = f"<body><div {wrapper}>{bar}" + "".join(f"<p>{t}</p>" for t in [WORDS * 5, *text, WORDS * 6]) + f"{bar}</div></body>"
    got = main_text.main_text(page, tree)
    assert "\n".join(text) in got and "Join now" not in got and "Sport" not in got


@pytest.mark.parametrize("part", ["<b ", '<a "', "<a '", "<!-- ", "<script", "<script>", "<span class=x></b>", "<div></p></i>", '<a ">x', "<a \"'>", "<![", "&", "<p class=aB "])
def test_op4_malformed_pages(part):
    """A megabyte of what never ends takes seconds, not minutes."""
    tree, begin = main_text.train(main_text.LABELLED), time.monotonic()
    page = "<article><p>" + WORDS + "</p>" + part * ((1 << 20) // len(part))
    assert main_text.main_text(page, tree).startswith(WORDS.strip()) and time.monotonic() - begin < 20


@pytest.mark.parametrize("attributes", ['class="overflow-hidden p-4"', 'class="x overflow-x-hidden post"', 'aria-label="a hidden valley"', "data-x='display:none'", 'title="visibility: hidden" lang=en', 'data-hidden="false"', 'style="overflow: hidden"'])
def test_op4_hidden_is_no_word_of_a_value(attributes):
    tree = main_text.train(main_text.LABELLED)
    text = "A paragraph of the article with enough words to be one, and then some more of them."
    page = f"<body><div {attributes}><article><h1>Head</h1><p>{text}</p></article></div></body>"
    assert main_text.main_text(page, tree).split("\n") == ["Head", text]


@pytest.mark.parametrize("attributes", ["hidden", 'class="a" hidden', 'HIDDEN=""', "hidden=hidden class=b", 'hidden="until-found"', 'style="color: red; display : none"', "style='visibility:hidden'", "style=display:none", 'aria-hidden="true"', "aria-hidden=true"])
def test_op4_hidden_elements(attributes):
    tree = main_text.train(main_text.LABELLED)
    text = "A paragraph of the article with enough words to be one, and then some more of them."
    page = f"<body><div {attributes}><article><p>{text}</p></article></div></body>"
    assert main_text.main_text(page, tree) == ""


@pytest.mark.parametrize("attributes", ["hidden", 'class="ad"', 'class="cookie-notice"', "style='display:none'", 'id="share"'])
def test_op4_paragraphs_as_containers(attributes):
    """A paragraph can be an advert, a notice or hidden; what follows it is what it was, whether it is closed or not."""
    tree = main_text.train(main_text.LABELLED)
    text = "A paragraph of the article with enough words to be one, and then some more of them."
    for close in ("</p>", "", "<span id=s>x</p>", "<b class=y>"):
        page = f"<body><article><h1>Head</h1><p>{text}</p><p {attributes}>Buy this now, it is cheap and good for you{close}<p>{text}</p><ul><li>last</li></ul></article></body>"
        assert main_text.main_text(page, tree).split("\n") == ["Head", text, text, "last"]


@pytest.mark.parametrize("attributes", ['class="post-with-comments"', 'class="content no-ads"', 'class="withoutShare article"'])
def test_op4_names_of_what_is_beside(attributes):
    tree = main_text.train(main_text.LABELLED)
    page = f"<body><nav><a href=a>Home</a></nav><div {attributes}><h1>Head</h1><p>Short.</p><div class='comments'><p>Mine</p></div></div></body>"
    assert main_text.main_text(page, tree).split("\n") == ["Head", "Short."]


def test_op5_brute_force(spark, sf):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
    windows = {}
    for r in table(spark, sf, "benchmark").collect():
        w = word.findall((r.text or "").translate(lower))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(r.item_id)
    sizes, own = {len(w) for w in windows}, texts(spark, sf)
    hits = 0
    for r in decontaminate.op5_decontaminate(spark, sf).collect():
        w, hit, items = word.findall((own[r.doc_id] or "").translate(lower)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        hits += bool(hit)
    assert hits


def test_op5_many_windows(spark, monkeypatch):
    """A benchmark that fills its bit sets gives the same result, and rows of one id are cut each by its own hits."""
    rng = np.random.default_rng(2)
    line = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 50, n))
    items = [(k, line(int(rng.integers(1, 30)))) for k in range(200)]
    docs = [(k % 40, line(60)) for k in range(60)] + [(k, items[k][1]) for k in range(20)]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    order = lambda rows: sorted(map(tuple, rows))
    want, cut = order(decontaminate.contamination_report(df, b).collect()), order(decontaminate.remove_hits(df, b).collect())
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 6)
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 1 << 6)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert order(decontaminate.contamination_report(df, b).collect()) == want and any(r[5] for r in want)
    assert order(decontaminate.remove_hits(df, b).collect()) == cut and len(cut) == len(docs)


def test_op5_remove_spans(spark):
    docs = spark.createDataFrame([(1, "Keep this. A b, c d e f g h i j! And this."), (2, "untouched  Text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_hits(docs, items).collect()}
    assert got == {1: "Keep this. And this.", 2: "untouched  Text"}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]


def test_op6_held_out(spark):
    path = "/root/testdata/sf0.1"
    docs = table(spark, path, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, path, "labels")
    got = quality.classify(docs, labels.where("doc_id % 2 = 0")).select("doc_id", "keep").join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = (got.quality == 1) & (got.toxic == 0)
    assert (got.keep[good]).mean() > 0.99 and (~got.keep[~good]).mean() > 0.95


def test_op6_shrinks_small_hosts(spark):
    rows = [(k, "big", "x", 0.9 if k < 900 else 0.1) for k in range(1000)] + [(2000, "small", "x", 1.0)] + [(3000 + k, f"h{k}", "x", 0.1) for k in range(50)]
    scored = spark.createDataFrame(rows, "doc_id long, source string, lang string, bad double")
    got = {r.source: r.path for r in quality.posteriors(scored).collect()}
    assert got["big"] > 0.7 and got["h1"] < got["small"] < 1.0


def test_op7_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype("f4")
    x[500:900] = x[7]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y = x.astype("f8")
    for q in range(0, 3000, 100):
        s = neighbours.exact(np.repeat(y[q : q + 1], 3000, 0), y)
        order = [i for i in np.lexsort((np.arange(3000), -s)).tolist() if i != q][:10]
        assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(order)]


def test_op7_lengths_and_repeated_ids(spark):
    """Of vectors of different lengths the shorter counts as if zeros followed; a repeated query id is searched once."""
    rng = np.random.default_rng(3)
    own = [(k, rng.normal(size=int(rng.choice([5, 9, 1100]))).tolist()) for k in range(60)] + [(20, [9.0] * 5), (20, [-9.0] * 9)]
    df = spark.createDataFrame(own, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score)))
    for q in (0, 20, 40):
        x = min(v for i, v in own if i == q)
        s = sorted(((sum(a * b for a, b in zip(x, v)), -i) for i, v in own if i != q), reverse=True)[:5]
        assert [(-i, v) for v, i in s] == got[q]


def test_op7_bounds():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(70, 64)) * rng.uniform(0.01, 100, (70, 1))
    (q, s), (p, t) = neighbours.quantise(x), neighbours.quantise(y)
    about = (q.astype(float) @ p.T.astype(float)) * np.outer(s, t)
    bound = np.outer(s / 2, np.abs(y).sum(1)) + np.outer(s * np.abs(q.astype(int)).sum(1) / 2, t)
    assert (np.abs(about - x @ y.T) <= bound).all()


@pytest.mark.parametrize("buckets", [1, 2, 3, 5])
def test_op8_bounds_are_optimal(buckets):
    rng = np.random.default_rng(buckets)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, int(rng.integers(1, 9)), replace=False)).astype(np.int64)
        counts = rng.integers(1, 20, len(lengths))
        waste = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths.tolist(), counts.tolist()))
        best = min(waste([*e, int(lengths[-1])]) for e in itertools.combinations(lengths[:-1].tolist(), min(buckets, len(lengths)) - 1))
        got = packing.bounds(lengths, counts, buckets)
        assert len(got) <= buckets and got[-1] == lengths[-1] and waste(got) == best


def test_op8_batches(spark, sf):
    rows = packing.op8_packing(spark, sf).collect()
    assert len(rows) == 200
    batches = Counter((r.bucket, r.batch) for r in rows)
    ends = {r.bucket: r.bucket_length for r in rows}
    for (bucket, batch), n in batches.items():
        room = max(1, packing.BUDGET // max(ends[bucket], 1))
        last = max(b for k, b in batches if k == bucket)
        assert n == room or batch == last and n <= room
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    own = texts(spark, sf)
    assert {r.doc_id: r.length for r in rows} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in own.items()}
    assert len({(r.bucket, r.batch, r.place) for r in rows}) == 200 and all(r.length + r.padding == r.bucket_length for r in rows)


def brute_components(own: dict[int, str]) -> dict[int, tuple[int, int]]:
    lower = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
    sets = {}
    for i, t in own.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(own), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in own}


def test_op9_brute_force(spark, sf):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_trees.op9_jaccard_join(spark, sf).collect()}
    assert got == brute_components(texts(spark, sf))


@pytest.mark.parametrize("block", [40, 512])
def test_op9_large_groups(spark, monkeypatch, block):
    """More near copies than a block holds, of sizes in several ranges."""
    monkeypatch.setattr(signature_trees, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(90)]
    own = {}
    for i in range(400):
        w = list(base)
        for k in rng.choice(90, int(rng.integers(0, 8)), replace=False):
            w[k] = f"x{i}-{k}"
        own[i] = " ".join(w + [f"y{k}" for k in range(i % 5 * 12)])
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_trees.near_duplicates(df).collect()}
    assert got == brute_components(own)


def test_op9_links_by_regions_alone(spark, monkeypatch):
    """Without blocks of leaders every link has to come from the blocks of regions."""
    own_units = signature_trees._leader_units
    monkeypatch.setattr(signature_trees, "_leader_units", lambda ties: own_units(ties).where("false"))
    monkeypatch.setattr(signature_trees, "BLOCK", 30)
    rng = np.random.default_rng(8)
    own = {}
    for i in range(240):
        w = [f"t{k}" for k in range(40)] + [f"g{i % 12}-{k}" for k in range(60)]  # 12 kinds that have 40 words in common
        for k in rng.choice(100, int(rng.integers(0, 6)), replace=False):
            w[k] = f"x{i}-{k}"
        own[i] = " ".join(w + [f"g{i % 12}y{k}" for k in range(i % 4 * 9)])
    own |= {240: None, 241: "", 242: "a b", 243: "A b", 244: own[3], 245: own[3] + " end"}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_trees.near_duplicates(df).collect()}
    assert got == brute_components(own)


def test_op9_rows_that_share_an_id(spark):
    """An id with two texts is one node; a text that a smaller id has, too, goes alone. Rows with a null id have no component."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (4, c + " end"), (4, b + " end"), (None, a), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in signature_trees.near_duplicates(df).collect())
    assert got == [(-1, 26, None), (1, 26, 1), (2, 26, 1), (2, 26, 2), (3, 26, 2), (4, 27, 2), (4, 27, 2), (5, 0, 5)]
    assert sorted((r.doc_id or -1, r.text or "") for r in signature_trees.keep_first(df).collect()) == [(-1, a), (1, a), (2, b), (5, "")]


def test_op9_node_bound():
    """No linked pair is pruned by the nodes above it."""
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < rng.uniform(0.6, 1)], rng.integers(1, 1 << 60, 20).astype(np.uint64)])) for _ in range(60)]
    a = signature_trees.Block(np.arange(60), sets)
    linked = {(i, j) for i, j in itertools.combinations(range(60), 2) if signature_trees.overlap(a.sets[i], a.sets[j]) >= signature_trees.required(len(a.sets[i]), len(a.sets[j]))}
    tree = signature_trees.signature_tree(a.signatures(1024), a.sizes)
    seen = {(i, j) for x, y in signature_trees.leaf_pairs(tree, tree, True) for i in range(x.low, x.high) for j in range(y.low, y.high)}
    assert linked and linked <= seen


def test_op3_windows():
    rng = np.random.default_rng(0)
    for _ in range(200):
        begin = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 5))])
        h, span = rng.integers(1, 30, begin[-1]).astype(np.uint64), int(rng.integers(1, 9))
        want = set()
        for a, b in itertools.pairwise(begin.tolist()):
            for c in range(a, b):
                left = c
                while left > a and h[left - 1] > h[c]:
                    left -= 1
                right = c
                while right < b - 1 and h[right + 1] >= h[c]:
                    right += 1
                if right - left + 1 >= span:
                    want.add((left, c, right))
        assert set(zip(*map(np.ndarray.tolist, compact_windows.compact_windows(h, begin, span)))) == want


def test_op3_planted(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"v{k}" for k in rng.integers(0, 3000, n)]
    passage, near = words(60), words(120)
    docs = {i: words(200) for i in range(40)}
    for i in (3, 11, 27):
        docs[i][50:50] = passage
    for i in (5, 19):
        docs[i][100:100] = near
    docs[19][130] = "changed"
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {(r.doc_id, r.other_id): (r.first_word, r.last_word) for r in compact_windows.repeated_passages(df).collect()}
    assert got == {(11, 3): (50, 109), (27, 3): (50, 109), (19, 5): (100, 219)}
    cut = {r.doc_id: r.text for r in compact_windows.cut_passages(df).collect()}
    assert cut[3] == " ".join(docs[3]) and cut[11] == " ".join(docs[11][:50] + docs[11][110:]) and len(cut) == 40


def test_op3_exact_runs_are_found(spark, sf):
    own, first, want = texts(spark, sf), {}, set()
    for i in sorted(own):
        s, _ = WordHashes([(own[i] or "").encode()]).shingles()
        for k in range(len(s) - compact_windows.SPAN + 1):
            if first.setdefault(s[k : k + compact_windows.SPAN].tobytes(), i) != i:
                want.add(i)
    assert want and want <= {r.doc_id for r in compact_windows.op3_substring_dedup(spark, sf).collect()}


def test_op3_near_copies_of_one_run(spark):
    """Recall at similarities of 0.77, 0.8 and 0.9, against the comparison of each planted pair itself."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"v{k}" for k in rng.integers(0, 100_000, n)]
    docs, want = {}, {}
    for k in range(600):
        length, changed = ((50, 2), (50, 1), (100, 1))[k % 3]
        passage = words(length)
        near = passage[: length // 2] + words(changed) + passage[length // 2 + changed :]
        docs[k], docs[1000 + k] = words(30) + passage + words(40), words(60) + near + words(20)
        x, y = (WordHashes([" ".join(docs[i]).encode()]).shingles()[0] for i in (1000 + k, k))
        want[1000 + k, k] = compact_windows.verify(x, 0, compact_windows.Places(y), -30)
    assert all(len(v) == 1 and 0.75 <= v[0][4] < 0.91 for v in want.values())
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {(r.doc_id, r.other_id) for r in compact_windows.repeated_passages(df).collect()}
    assert got == set(want)


def test_op3_hot_key_keeps_first_holders():
    """Windows of one frequent hash in 60,000 surroundings: a later one is tied to an earlier holder of its own surroundings,
    whether the hash is dealt over tasks or not, in batches of any size, and never to a later one."""
    rng = np.random.default_rng(4)
    n = 60_000
    left, right = (np.append(x, x[-100:]) for x in (rng.permutation(1 << 24)[:n] + 1, rng.permutation(1 << 24)[:n] + 1))
    doc = np.arange(n + 100)
    cut = lambda df, step: (df.iloc[k : k + step] for k in range(0, len(df), step))
    for dealt in (False, True):
        key = np.where(dealt, (1 << 16) + 1 + doc % 200, 1 << 16)
        windows = pd.DataFrame({"key": key, "before": left << 16 | 60 << 8 | 60, "behind": right, "doc_id": doc, "middle": np.full(len(doc), 70, np.int32)}).sort_values(["key", "doc_id"])
        seen = []
        for step in (7001, 500):
            rows = pd.concat(compact_windows._key_ties(cut(windows, step))).sort_values(["side_group", "doc_id", "middle"])
            sides = rows[rows["hashes"] == 0]
            assert sides["side_group"].nunique() > 1.99 * n and len(sides) <= 2 * len(doc) + 200
            ties = pd.concat(compact_windows._side_ties(cut(rows, step)))
            pairs = set(zip(ties["doc_id"], ties["other"], strict=True))
            assert {(n + k, n - 100 + k) for k in range(100)} <= pairs and len({x for x, _ in pairs}) == n + 99
            assert len(ties) <= 3 * len(doc) and all(x > y for x, y in pairs)
            seen.append(sorted(ties.itertuples(index=False, name=None)))
        assert seen[0] == seen[1]


def test_op3_hot_line_between_passages(spark):
    """A block that thousands of documents have, and pairs that share a passage around a frequent line: of each passage one whole
    copy stays, and batches and partitions change nothing."""
    rng = np.random.default_rng(8)
    some = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, k))
    block, line = some(60), some(30)
    texts = [f"{some(20)} {block} {some(20)}" for _ in range(4000)]
    passages = [f"{some(15)} {line} {some(15)}" for _ in range(1000)]
    texts += [f"{some(25)} {p} {some(25)}" for p in passages for _ in range(2)]
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(order[k]), t) for k, t in enumerate(texts)], "doc_id long, text string")
    hot, _ = compact_windows.hot_keys(docs)
    assert len(hot)  # else this test shows nothing
    seen = []
    for size, n in ((10_000, 4), (500, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            rows = compact_windows.repeated_passages(docs.repartition(n)).collect()
            seen.append(sorted(rows))
            assert all(r.other_id < r.doc_id for r in rows)
            if size == 500:
                left = "\n".join(r.text for r in compact_windows.cut_passages(docs).collect())
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1]
    assert left.count(block) == 1 and sum(p in left for p in passages) >= 999 and all(left.count(p) <= 1 for p in passages)


def thue_morse(first: str, second: str, n: int) -> str:
    return "".join(second if k.bit_count() % 2 else first for k in range(n))


def test_words_of_like_letters_are_told_apart(spark, tmp_path):
    """Two words that polynomial hashes modulo 2^64 mix up, whatever their base."""
    x, y = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)
    assert len(set(WordHashes([f"{x} {y}".encode()]).words.tolist())) == 2
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    want = [np.array(t.encode(w, add_special_tokens=False).ids, "<u2").tobytes() for w in (x, y, f"{y} {x}")]
    assert Pieces(path).many([x, y, f"{y} {x}"]) == want
    docs = spark.createDataFrame([(1, f"one two {x} four five six"), (2, f"one two {y} four five six")], "doc_id long, text string")
    assert {r.component_id for r in signature_trees.near_duplicates(docs).collect()} == {1, 2}
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abé"), k)) for k in range(1, 40) for _ in range(30)]
    h = WordHashes([" ".join(words).encode()])
    assert len(set(h.words.tolist())) == len(set(words)) and len(set(h.prefixes(3).tolist())) == len({w.encode()[:3] for w in words})


def test_op3_rows_that_share_an_id(spark):
    """Each text is cut by its own passages, though the ids are equal and one text is short."""
    rng = np.random.default_rng(12)
    words = lambda n: [f"v{k}" for k in rng.integers(0, 3000, n)]
    passage, long, short = words(60), words(200), words(20)
    rows = [(1, words(30) + passage), (2, long[:150] + passage + long[150:]), (2, short), (2, passage + short), (2, long[:150] + passage + long[150:])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    cut = sorted((r.doc_id, r.text) for r in compact_windows.cut_passages(df).collect())
    assert cut == sorted((i, " ".join(w)) for i, w in [rows[0], (2, long), (2, short), (2, short), (2, long)])


def test_op3_clean_and_covered(spark):
    """Every word of a result lies in a passage that brute force confirms, and no row is needed only twice."""
    rng = np.random.default_rng(21)
    words = lambda n: [f"v{k}" for k in rng.integers(0, 500, n)]
    parts = [words(70) for _ in range(6)]
    docs = {i: words(40) + parts[i % 6] + words(15) + parts[i * 5 % 6] + words(30) for i in range(60)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found: dict[int, list] = {}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for r in compact_windows.repeated_passages(df).collect():
        x, y = grams(docs[r.doc_id][r.first_word : r.last_word + 1]), grams(docs[r.other_id][r.other_first_word : r.other_last_word + 1])
        assert r.other_id < r.doc_id and len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.75 and r.last_word - r.first_word >= 49
        found.setdefault(r.doc_id, []).append((r.first_word, r.last_word))
    for i, w in docs.items():
        spans = sorted(found.get(i, []))
        assert all(b[1] > a[1] for a, b in zip(spans, spans[1:])) and all(c[0] > a[1] + 1 for a, _, c in zip(spans, spans[1:], spans[2:]))
        first = {k: min(j for j in docs if k in (j % 6, j * 5 % 6)) for k in (i % 6, i * 5 % 6)}
        for k, at in ((i % 6, 40), (i * 5 % 6, 125)):
            if first[k] < i:
                assert any(a <= at and at + 69 <= b for a, b in spans)


def test_op3_repeated_lines(spark):
    """Texts of one line again and again, long and short: whatever an earlier one has, too, is found to the last words."""
    rng = np.random.default_rng(31)
    line = [f"v{k}" for k in rng.integers(0, 1000, 11)]
    other = [f"w{k}" for k in rng.integers(0, 1000, 300)]
    texts = [line * 7, line * 300, other + line * 90, line * 6 + other[:40]]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    found = {k: set() for k in range(4)}
    for r in compact_windows.repeated_passages(df).collect():
        found[r.doc_id] |= set(range(r.first_word, r.last_word + 1))
    assert not found[0] and len(found[1]) >= 0.98 * 3300 and len(found[2] & set(range(300, 1290))) >= 0.98 * 990 and len(found[3] & set(range(66))) >= 60


def test_op3_drifting_copy(spark):
    """A text of 10,000 words with a word inserted after every 40, and one with every 40th left out: all of it is found."""
    rng = np.random.default_rng(6)
    own = [f"v{k}" for k in rng.integers(0, 100_000, 10_000)]
    more = [w for k, w in enumerate(own) for w in ([w, f"new{k}"] if k % 40 == 39 else [w])]
    less = [w for k, w in enumerate(own) if k % 40 != 39]
    df = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(more)), (3, " ".join(less))], "doc_id long, text string")
    found = {2: set(), 3: set()}
    for r in compact_windows.repeated_passages(df).collect():
        assert r.other_id < r.doc_id and r.similarity >= 0.75
        found[r.doc_id] |= set(range(r.first_word, r.last_word + 1))
    assert len(found[2]) > 0.99 * len(more) and len(found[3]) > 0.99 * len(less)


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert {k: v for k, v in up.items() if k != v} == got


def test_pipeline_brute_force(spark, sf):
    """The stages' decisions one by one, on what the stage before kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, stages = table(spark, sf, "documents"), dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, sf)
    path = shared_dir(spark, "t")
    kept.write.parquet(path)
    kept = spark.read.parquet(path)
    own = {r.doc_id: r.text for r in kept.collect()}
    one = {r.doc_id for r in stages["n-gram Jaccard join"](spark, kept, sf).select("doc_id").collect()}
    assert one == {i for i, (_, c) in brute_components(own).items() if i == c}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= one and len(rows) > 50
