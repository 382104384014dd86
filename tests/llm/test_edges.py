"""Nulls, empty and long texts, ties, repeated rows, empty tables and further columns, for every query and stage."""

import pytest
from pyspark.sql import functions as F

from cachesight.llm import decontaminate, entry, quality
from cachesight.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["bad_id", "bad", "n", "key", "node", "root", "spans", "span_id", "ties", "row", "w", "hit", "items", "digest", "content", "content_digest", "n_tokens", "length", "number", "slot", "bucket", "out_id", "host", "path", "keep", "count", "p"]
LONG = " ".join(f"word{k % 997} and{k % 31}" for k in range(60_000))
SAME = "one two three four five six seven eight nine ten eleven twelve"


def docs(spark, empty=False):
    rows = [] if empty else [
        (1, SAME, "en", "a", 9), (2, SAME, None, "a", None), (3, SAME + " thirteen", "en", None, 3), (3, SAME + " thirteen", "en", None, 3), (4, None, "en", "a", 0), (5, "", "en", "b", 0),
        (6, " \n\t ", "fr", "b", 2), (7, LONG, "en", "c", 5), (8, LONG + " tail", "en", "c", 5), (None, SAME, "en", "a", 1), (None, None, None, None, None), (9, "x", "en", "a", 1), (10, "Ünï <|endoftext|> ñ日本", "de", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module", params=["edges", "empty"])
def folder(request, spark, tmp_path_factory):
    path, empty = str(tmp_path_factory.mktemp(request.param)), request.param == "empty"
    keep = lambda rows: [] if empty else rows
    docs(spark, empty).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(keep([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (4, 0, None), (99, 1, 0)]), "doc_id long, quality int, toxic int").withColumn("n", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(keep([(1, SAME), (2, "x"), (3, None), (4, "..."), (1, SAME), (None, "seven eight")]), "item_id long, text string").withColumn("row", F.lit(1)).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(keep([(1, "http://a b", "<p>x"), (2, None, "<p>x"), (3, "u", None), (None, "u", ""), (4, "u", "<article><p>" + LONG + "</article>"), (4, "u", "<article><p>" + LONG + "</article>")]), "page_id long, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit(0), "name": F.lit("n")}).write.parquet(f"{path}/pages.parquet")
    vectors = [(20, [1.0, 0.0]), (40, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [1.0]), (None, [1.0, 1.0]), (60, [float("inf"), 1.0])]
    spark.createDataFrame(keep(vectors), "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "block": F.lit(1), "rank": F.lit(2)}).write.parquet(f"{path}/embeddings.parquet")
    return path, empty


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, folder, name):
    path, empty = folder
    rows = entry.queries()[name](spark, path).collect()
    assert not empty or not rows
    if empty:
        return
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    if name.startswith("op1_"):
        assert len(rows) == 13 and by[4][0].n_tokens == 0 and by[5][0].n_bytes == 0 and by[7][0].over_limit
    if name.startswith("op2_"):
        assert len(rows) == 6 and {(r.page_id, r.record_type, r.refers_to) for r in rows} >= {(1, "response", None), (2, "revisit", 1), (4, "response", None)}
        assert {(r.page_id, r.payload_bytes) for r in rows} >= {(3, 0), (None, 0)}
    if name.startswith("op3_"):
        assert {(r.doc_id, r.other_id) for r in rows} == {(8, 7)}
    if name.startswith("op4_"):
        assert len(rows) == 6 and by[3][0].text == "" and len(by[4]) == 2 and by[4][0].text == " ".join(LONG.split())
    if name.startswith("op5_"):
        assert len(rows) == 13 and by[1][0].n_hit == 12 and by[4][0].n_words == 0 and by[9][0].contaminated and not by[5][0].contaminated
    if name.startswith("op7_"):
        assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(rows)] == [(20, 1, 1), (20, 2, 7), (20, 3, 40), (20, 4, 6), (20, 5, 6), (40, 1, 1), (40, 2, 7), (40, 3, 20), (40, 4, 6), (40, 5, 6)]
    if name.startswith("op8_"):
        assert len(rows) == 13 and sum(r.length == 0 for r in rows) == 4 and all(r.length + r.padding == r.bucket_length for r in rows)
    if name.startswith("op9_"):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
        assert got[1] == got[2] == (8, 1) and got[3] == (9, 1) and got[4] == (0, 4) and got[6] == (0, 6) and got[8][1] == 7 and got[9] == (1, 9)
    if name.startswith("op11_"):
        assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(rows, key=lambda r: (r.item_id or 9, r["rank"]))][:6] == [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 3), (1, 1, None)] or len(rows) > 5
    if name.startswith("op12_"):
        assert len(rows) == 13 and all((r.n_assign, r.n_access, r.n_hex, r.spans) == (0, 0, 0, "") for r in rows)
    if name.startswith("op13_"):
        assert len(rows) == 13 and len({r.root for r in rows}) == 1 and len({r.subroot for r in rows}) == 4 and by[4][0].verified
    if name.startswith("op10_"):
        assert len(rows) == 13 and sorted(r.start for r in rows)[0] == 0 and by[4][0].n_tokens == 1


def test_stages_keep_columns(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path, empty = folder
    before = docs(spark, empty)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, path)
        rows = out.collect()
        assert not empty or not rows
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == before.columns


def test_null_ids_are_decided_row_by_row(spark, folder):
    path, empty = folder
    own, benchmark = docs(spark, empty), table(spark, path, "benchmark")
    more = spark.createDataFrame([] if empty else [(None, "a clean text", "en", "a", 1)], DOCS)
    stay = decontaminate.drop_contaminated(own.select(*more.columns).unionByName(more), benchmark).collect()
    # the item "x" hits document 9, the item SAME the documents 1 to 3 and the first row without an id
    assert sorted((r.doc_id or -1, r.text is None) for r in stay) == ([] if empty else [(-1, False), (-1, True), (4, True), (5, False), (6, False), (7, False), (8, False), (10, False)])
    cut = decontaminate.remove_hits(own.select(*more.columns).unionByName(more), benchmark).where("doc_id IS NULL").collect()
    assert sorted(str(r.text) for r in cut) == ([] if empty else ["", "None", "a clean text"])


def test_items_without_an_id_hit(spark):
    items = spark.createDataFrame([(None, "seven eight"), (1, "other words")], "item_id long, text string")
    own = spark.createDataFrame([(1, "six seven eight nine"), (2, "none")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination_report(own, items).collect()}
    assert got == {1: (2, 0, True), 2: (0, 0, False)}
    assert [r.doc_id for r in decontaminate.drop_contaminated(own, items).collect()] == [2]


def test_null_ids_and_the_classifier(spark):
    path = "/root/testdata/sf0.01"
    labels = table(spark, path, "labels")
    own = table(spark, path, "documents")
    own = own.join(labels.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left").withColumn("doc_id", F.when(F.col("known"), F.col("doc_id"))).drop("known")
    want = quality.classify(own, labels).where("doc_id IS NULL").groupBy("keep").count().collect()
    assert {r.keep for r in want} == {True, False}
    kept = quality.keep_good(own, labels)
    assert kept.columns == own.columns and kept.where("doc_id IS NULL").count() == next(r["count"] for r in want if r.keep)


def test_table_reads(spark, sf):
    assert table(spark, sf, "documents").count() == 200
