"""Files: trace scans, footers, digests, inventories, compaction, strict joins."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from cachesight.operators import release as staged
from cachesight.schema import PARTITIONS
from cachesight.sources import files, tables
from cachesight.sources.fixtures import candidates
from cachesight.sources.shared import shared_dir


@pytest.mark.parametrize("split", ["128m", "300", "1k"])
def test_trace_of_uneven_files(spark, tmp_path, split):
    """Positions follow file names and lines wherever files are cut; bad lines are counted and have no place."""
    rng, want = random.Random(1), []
    for k, n in enumerate((700, 0, 3, 90, 1)):
        lines = []
        for j in range(n):
            lines.append(rng.choice(["", "  ", '{"item_id": "x"', "[]", '{"item": 1}', '{"item_id": null}']) if rng.random() < 0.1 else json.dumps({"item_id": rng.choice([f"é{j}", j, "a b"]), "pad": "p" * rng.randrange(40)}))
        (tmp_path / f"part-{k}.jsonl").write_text("\n".join(lines) + ("\n" if k % 2 else ""))
        want.append(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = sorted((r.t, r.item) for r in tables.read_trace(spark, str(tmp_path), "x", strict=False).collect())
        faults = {r.file.split("/")[-1]: (r.requests, r.bad) for r in tables.trace_faults(spark, str(tmp_path)).collect()}
        with pytest.raises(ValueError, match="part-0.jsonl"):
            tables.read_trace(spark, str(tmp_path), "x")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")

    def item(line):
        try:
            return json.loads(line)["item_id"]
        except (ValueError, KeyError, TypeError):
            return None

    good = [str(item(x)) for own in want for x in own if item(x) is not None]
    assert got == list(enumerate(good))
    assert faults == {f"part-{k}.jsonl": (sum(item(x) is not None for x in own), sum(bool(x.strip()) and item(x) is None for x in own)) for k, own in enumerate(want) if any(x.strip() for x in own)}


@pytest.fixture(scope="module")
def release(spark, sf):
    root = shared_dir(spark, "release files")
    tables.write_partitions(candidates(spark, sf), root)
    return root


KINDS = {"split": "string", "trace_family": "string", "capacity": "bigint", "horizon": "bigint"}


def test_footers_and_recount(spark, sf, release):
    c = candidates(spark, sf)
    footer = files.footers(spark, release)
    own = {r.column: r for r in footer.groupBy("column").agg(F.sum("rows").alias("n"), F.max(F.expr("try_cast(high as bigint)")).alias("high"), F.sum("nulls").alias("nulls")).collect()}
    assert own["decision_t"].n == c.count() and own["decision_t"].high == c.agg(F.max("decision_t")).first()[0] and own["y_loss"].nulls == 0
    expected = c.groupBy(*PARTITIONS).agg(F.count("*").alias("row_count"))
    counted = files.file_rows(footer)
    assert {r.state for r in files.recount(counted, expected, KINDS).collect()} == {"ok"}
    one = expected.first()
    other = expected.where(~((F.col("split") == one.split) & (F.col("trace_family") == one.trace_family) & (F.col("capacity") == one.capacity) & (F.col("horizon") == one.horizon)))
    other = other.withColumn("row_count", F.col("row_count") + (F.col("horizon") == 99).cast("int")).unionByName(spark.createDataFrame([("train", None, 1, 1, 5)], other.schema))
    states = [r for r in files.recount(counted, other, KINDS).collect() if r.state != "ok"]
    assert sorted(r.state for r in states) == ["missing", "not listed"] and next(r for r in states if r.state == "not listed").found == one.row_count
    assert "differs" in {r.state for r in files.recount(counted, expected.withColumn("row_count", F.lit(1)), KINDS).collect()}


def digest(data, size):
    parts = [data[k : k + size] for k in range(0, max(len(data), 1), size)]
    return hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()


def test_digests_of_ranges_and_repair(spark, tmp_path):
    root = tmp_path / "root dir"
    (root / "a=1 b").mkdir(parents=True)
    content = {"a=1 b/x.bin": b"x" * 1000, "y.bin": bytes(range(256)) * 10, "empty": b"", "exact": b"e" * 512}
    for name, data in content.items():
        (root / name).write_bytes(data)
    (root / "_hidden").write_bytes(b"no")
    rows = files.inventory(spark, str(root), 256)
    assert {r.path: r.digest for r in rows.collect()} == {n: digest(d, 256) for n, d in content.items()}
    kept = str(tmp_path / "inventory")
    rows.write.parquet(kept)
    assert files.repair(spark, str(root), kept, size=256).collect() == []
    (root / "y.bin").write_bytes(b"changed")
    (root / "empty").unlink()
    (root / "new").write_bytes(b"n")
    want = {("y.bin", "changed"), ("empty", "missing"), ("new", "not listed")}
    assert {tuple(r) for r in files.repair(spark, str(root), kept, size=256).collect()} == want
    assert {r.path for r in spark.read.parquet(kept).collect()} == set(content)  # nothing was applied
    assert {tuple(r) for r in files.repair(spark, str(root), kept, True, 256).collect()} == want
    assert files.repair(spark, str(root), kept, size=256).collect() == []
    assert {r.path: r.digest for r in spark.read.parquet(kept).collect()} == {"a=1 b/x.bin": digest(b"x" * 1000, 256), "exact": digest(b"e" * 512, 256), "y.bin": digest(b"changed", 256), "new": digest(b"n", 256)}
    assert files.absolute_paths({"a": ["/home/x", "rel/y"], "b": {"c": "C:\\z", "d": 3, "e": "file:/q"}}) == [("a[0]", "/home/x"), ("b.c", "C:\\z"), ("b.e", "file:/q")]


def test_compaction_keeps_rows(spark, sf, tmp_path):
    root = str(tmp_path / "many")
    c = candidates(spark, sf).where("split <> 'val'")
    c.repartition(12, "candidate_page_id").write.partitionBy("trace_family", "split").parquet(root)
    total = lambda: spark.read.parquet(root).agg(F.count("*"), F.sum(F.xxhash64(*[F.col(x) for x in c.columns]).cast("decimal(38,0)"))).first()
    before, sizes = total(), files.listed(spark, root, ".parquet").collect()
    target = 4 * max(r.size for r in sizes)
    done = files.compact(spark, root, target, ("decision_t", "decision_id")).collect()
    after = files.listed(spark, root, ".parquet").collect()
    assert total() == before and len(after) < len(sizes) / 2
    assert {r.folder for r in done} == {r.path.rsplit("/", 1)[0] for r in sizes} and len(after) == len(sizes) - sum(r.files_before - r.merged for r in done)
    assert all(r.size <= target for r in after)
    rounds = 0
    while files.compact(spark, root, target).count():  # merged files of such small rows are small files again
        rounds += 1
    assert rounds < 6 and all(r.size <= target for r in files.listed(spark, root, ".parquet").collect())
    assert total() == before and not files.recover(spark, root)


def test_compaction_is_finished_after_a_loss(spark, tmp_path):
    """The run ends between its list and its moves; the next one carries the list out, even if half of it was done."""
    root = str(tmp_path / "lost")
    spark.range(1000).repartition(8).write.parquet(root)
    taken = files.recover
    files.recover = lambda *a: False
    try:
        files.compact(spark, root, 1 << 20)
    finally:
        files.recover = taken
    assert spark.read.parquet(root).count() == 1000  # readers see the old files only
    log = json.loads((tmp_path / "lost" / files.LOG).read_text())
    files.move(spark, log["moves"][0]["new"], log["moves"][0]["to"])
    files.remove(spark, log["moves"][0]["old"][0])
    assert files.recover(spark, root) and not files.recover(spark, root)
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == list(range(1000)) and len(files.listed(spark, root).collect()) == 1


def test_family_of_path(spark):
    known = spark.createDataFrame([("wiki",), ("wiki_2018",), ("w",), ("meta-kv",), ("",)], "name string")
    want = {"a/trace_family=x y/wiki_1.csv": "x y", "s3://b/wiki_2018_cap32.csv": "wiki_2018", "wiki_2018.csv": "wiki", "wiki.csv": None, "w_1": "w", "meta-kv_": "meta-kv", "trace_family=/wiki_9": "wiki", "x/_y": None, "é_wiki_1": None}
    got = tables.family_of_path(spark.createDataFrame([(p, k) for k, p in enumerate(want)], "path string, k int"), known)
    assert {r.path: r.family for r in got.collect()} == want


def test_strict_join(spark):
    a = spark.createDataFrame([("f", 1, 1.0), ("f", 2, 2.0), ("g", 1, None)], "family string, capacity int, x double")
    b = spark.createDataFrame([("f", 1, "p"), ("f", 2, "q"), ("g", 1, "r")], "family string, capacity int, y string")
    key = ["family", "capacity"]
    assert sorted(map(tuple, tables.strict_join({"a": a, "b": b}, key).collect())) == [("f", 1, 1.0, "p"), ("f", 2, 2.0, "q"), ("g", 1, None, "r")]
    with pytest.raises(ValueError, match=r"1 keys .*\('f', 2\) is no times in b"):
        tables.strict_join({"a": a, "b": b.where("capacity = 1")}, key)
    with pytest.raises(ValueError, match=r"\('g', 1\) is no times in a"):
        tables.strict_join({"a": a.where("family = 'f'"), "b": b}, key)
    with pytest.raises(ValueError, match="2 times in b"):
        tables.strict_join({"a": a, "b": b.unionByName(b.limit(1))}, key)
    with pytest.raises(ValueError, match="columns of several"):
        tables.strict_join({"a": a, "b": b.withColumnRenamed("y", "x")}, key)


def test_source_summary_of_manifests(spark, tmp_path):
    for n, size in (("wiki_1.csv", 10), ("wiki_2.csv", 5), ("meta_kv_1.csv", 7), ("odd.csv", 1)):
        (tmp_path / n).write_text("x" * size)
    entries = [{"path": n, "row_count": k} for n, k in (("wiki_1.csv", 100), ("wiki_2.csv", 50), ("meta_kv_1.csv", 7))] + ["odd.csv"]
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"files": entries}))
    summary = lambda **k: {r.family: tuple(r)[1:] for r in staged.source_summary(spark, str(manifest), **k).collect()}
    got = summary(include=("wiki", "gone"), blocked=("meta_kv",))
    assert got == {"wiki": (2, 15, 150, None, True, None), "gone": (0, 0, None, None, False, "missing"), "meta_kv": (1, 7, 7, None, False, "blocked"), None: (1, 1, None, None, False, None)}
    (tmp_path / "split_summary.csv").write_text("split,trace_family,row_count,decision_count\ntrain,wiki,90,9\ntest,wiki,60,6\ntrain,only_counted,1,1\n")
    got = summary(exclude=("meta_kv",), blocked=("meta_kv", "wiki"))
    assert got == {"wiki": (2, 15, 150, 15, True, "blocked"), "meta_kv": (1, 7, None, None, False, None), "only_counted": (0, 0, 1, 1, True, None), None: (1, 1, None, None, True, None)}
    with pytest.raises(ValueError, match="included and excluded"):
        summary(include=("wiki",), exclude=("wiki",))


def test_export_filters_and_refuses(spark, sf, tmp_path):
    c = candidates(spark, sf).where("decision_t < 300")
    staged.export(c, str(tmp_path / "a"), include=("1-URGENT", "2-HIGH"), exclude=("9",))
    assert {r[0] for r in tables.read_partitions(spark, str(tmp_path / "a")).select("trace_family").distinct().collect()} == {"1-URGENT", "2-HIGH"}
    with pytest.raises(ValueError, match="twice"):
        staged.export(c.unionByName(c.limit(1)), str(tmp_path / "b"))
    assert staged.repeated_partitions(spark, str(tmp_path / "a")).count() == 0
    folder = next((tmp_path / "a").rglob("horizon=*"))
    folder.parent.joinpath("horizon=00" + folder.name.split("=")[1]).mkdir()
    next(folder.glob("*.parquet")).rename(folder.parent / ("horizon=00" + folder.name.split("=")[1]) / "x.parquet")
    (folder / "y.parquet").write_bytes(b"")
    assert [len(r.folders) for r in staged.repeated_partitions(spark, str(tmp_path / "a")).collect()] == [2]


def test_families_in_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "families.yaml"
    path.write_text("families:\n  - name: b\n    blocked: true\n    reason: no licence\n  - name: a\n    selected: false\n")
    assert [tuple(r) for r in tables.families(spark, str(path)).collect()] == [("a", False, False, ""), ("b", True, True, "no licence")]
    path.write_text("- name: b\n- selected: true\n")
    with pytest.raises(ValueError, match="without a name"):
        tables.families(spark, str(path))


def test_sample_release(spark, sf, tmp_path):
    c = candidates(spark, sf).where("decision_t < 200")
    c.write.parquet(str(tmp_path / "in.parquet"))
    root = str(tmp_path / "out")
    parts = staged.build_sample(spark, str(tmp_path / "in.parquet"), root, include_ties=True).collect()
    assert sum(r.row_count for r in parts) == c.count() == tables.read_partitions(spark, f"{root}/candidate_rows").count()
    assert len({r.digest for r in parts}) == len(parts) and {r.split for r in parts} == {"train", "val", "test"}
    assert spark.read.parquet(f"{root}/pairwise_view").where("is_tie = 1").count() and spark.read.parquet(f"{root}/decision_view").count() == c.select("decision_id", "capacity", "horizon").distinct().count()
    with pytest.raises(FileExistsError):
        staged.build_sample(spark, str(tmp_path / "in.parquet"), root)
    c.withColumn("y_loss", -F.col("y_loss") - 1).write.parquet(str(tmp_path / "bad.parquet"))
    with pytest.raises(ValueError, match="loss_negative"):
        staged.build_sample(spark, str(tmp_path / "bad.parquet"), str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()


def test_family_release(spark, sf, tmp_path):
    c = candidates(spark, sf).where("decision_t < 400").withColumn("candidate_page_id", F.concat(F.lit("page "), "candidate_page_id"))
    own = c.where("trace_family = '2-HIGH'")
    shards = tmp_path / "shards"
    own.where("capacity = 32").coalesce(1).write.option("header", True).csv(str(shards / "a"))
    own.where("capacity > 32").coalesce(2).write.parquet(str(shards / "b"))
    root = str(tmp_path / "out")
    (row,) = staged.build_family(spark, str(shards), root, "2-HIGH", "salt", "candidates", "0.3").collect()
    assert (row.row_count, row.capacity, row.split) == (own.count(), [32, 64, 128], ["test", "train", "val"]) and row.decisions == own.select("decision_id").distinct().count()
    rows = spark.read.parquet(f"{root}/rows")
    assert rows.where("candidate_page_id LIKE 'obj!_%' ESCAPE '!'").count() == own.count() and rows.where("candidate_page_id LIKE '%page%'").count() == 0
    assert spark.read.parquet(f"{root}/sources").agg(F.sum("row_count")).first()[0] == own.count()
    c.where("trace_family = '5-LOW'").limit(3).coalesce(1).write.parquet(str(shards / "c"))
    with pytest.raises(ValueError, match="5-LOW"):
        staged.build_family(spark, str(shards), str(tmp_path / "no"), "2-HIGH", "salt", "candidates", "0.3")
    leak = own.withColumn("trace_name", F.col("candidate_page_id")).withColumn("dataset_source", F.lit("me@example.com"))
    leak.coalesce(1).write.parquet(str(tmp_path / "leak"))
    with pytest.raises(ValueError, match="raw pages in trace_name.*email in dataset_source"):
        staged.build_family(spark, str(tmp_path / "leak"), str(tmp_path / "no"), "2-HIGH", "salt", "candidates", "0.3")
    assert not [x for x in tmp_path.iterdir() if x.name.startswith("no")]


def test_migration_names_missing_columns(spark, sf, tmp_path):
    c = candidates(spark, sf).where("decision_t < 100")
    root = str(tmp_path / "old")
    c.where("split = 'train'").drop("request_bucket", "y_value").write.partitionBy(*PARTITIONS).parquet(root)
    c.where("split <> 'train'").write.mode("append").partitionBy(*PARTITIONS).parquet(root)
    rows = staged.migration_partitions(spark, root).collect()
    assert {(r.split == "train", tuple(r.missing), r.cheap) for r in rows} == {(True, ("request_bucket", "y_value"), False), (False, (), True)}
    assert sum(r.row_count for r in rows) == c.count()
