"""Reading and writing candidate relations, traces and results.

Paths are listed by Hadoop's file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cachesight.functions.scalars import split_name
from cachesight.schema import CANONICAL, PARTITIONS, SCHEMA
from cachesight.sources.shared import materialize


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """All files below a folder, sorted; hidden and marker files are left out."""
    fs, p = _fs(spark, folder)
    it, out = fs.listFiles(p, True), []
    while it.hasNext():
        f = it.next().getPath()
        if not f.getName().startswith(("_", ".")):
            out.append(f.toString())
    return sorted(out)


def _manifest(spark: SparkSession, path: str) -> list[str]:
    """Entries of ``files`` or ``shards``, texts or objects with ``path``. A relative one is sought beside the manifest and then
    in each folder above it."""
    doc = json.loads(_read_text(spark, path))
    entries = doc.get("files") or doc.get("shards") or []
    fs, p = _fs(spark, path)
    out = []
    for e in entries:
        name = e["path"] if isinstance(e, dict) else e
        if "://" in name or name.startswith("/"):
            out.append(name)
            continue
        folder = p.getParent()
        while folder is not None:
            there = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
            if fs.exists(there):
                out.append(there.toString())
                break
            folder = folder.getParent()
        else:
            raise FileNotFoundError(f"{path} lists {name}, which is nowhere above it")
    return out


def file_size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).getLen()


def manifest_rows(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, row_count) of a manifest's entries; those without a count have 0."""
    doc = json.loads(_read_text(spark, path))
    return [(e["path"], int(e.get("row_count", 0))) for e in doc.get("files") or doc.get("shards") or [] if isinstance(e, dict)]


def resolve(spark: SparkSession, path: str) -> list[str]:
    """The CSV and Parquet files that a file, folder or JSON manifest stands for."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isDirectory():
        found = [f for f in list_files(spark, path) if f.endswith((".csv", ".parquet"))]
    elif path.endswith(".json"):
        found = _manifest(spark, path)
    elif path.endswith((".csv", ".parquet")):
        found = [path]
    else:
        raise ValueError(f"neither CSV, Parquet nor a manifest: {path}")
    if not found:
        raise ValueError(f"no files in {path}")
    return found


def coerce(df: DataFrame) -> DataFrame:
    """Known columns in their types; a number that cannot be read raises."""
    types = {f.name: f.dataType for f in SCHEMA}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def read_candidates(spark: SparkSession, path: str, mode: str = "strict", source: str | None = None) -> DataFrame:
    """Shards with headers that may differ: columns are united by name, all CSV cells are read as text and then cast. ``source``
    names a further column, for the file that a row is from."""
    from_file = lambda df: df.withColumn(source, F.col("_metadata.file_name")) if source else df
    files = resolve(spark, path)
    csv, parquet = [f for f in files if f.endswith(".csv")], [f for f in files if f.endswith(".parquet")]
    parts = []
    by_header: dict[tuple, list[str]] = {}
    for f in csv:
        header = tuple(spark.read.option("header", True).option("quote", '"').csv(f).columns)
        by_header.setdefault(header, []).append(f)
    for header, same in by_header.items():
        text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        parts.append(from_file(spark.read.schema(text).option("header", True).option("quote", '"').option("escape", '"').csv(same)))
    if parquet:
        parts.append(from_file(spark.read.option("mergeSchema", True).parquet(*parquet)))
    df = coerce(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [coerce(p) for p in parts]))
    return df.withColumn("split", split_name(F.col("split"), mode)) if "split" in df.columns else df


def read_partitions(spark: SparkSession, root: str) -> DataFrame:
    """A partitioned release; folder names give the partition columns in their canonical types."""
    return spark.read.schema(SCHEMA).parquet(root).select(*CANONICAL)


def write_table(df: DataFrame, path: str, overwrite: bool = False, compression: str = "zstd") -> None:
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.option("compression", compression).parquet(path)


def write_partitions(df: DataFrame, root: str, overwrite: bool = False, rows_per_file: int = 5_000_000) -> None:
    """One folder for each (split, family, capacity, horizon), rows in order of decision and page.

    Rows of a partition are dealt by ranges of their decision, so a large partition is several tasks and files.
    """
    dealt = df.select(*CANONICAL).repartitionByRange(*PARTITIONS, "decision_t", "decision_id").sortWithinPartitions(*PARTITIONS, "decision_t", "decision_id", "candidate_page_id")
    dealt.write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").partitionBy(*PARTITIONS).parquet(root)


def scan_trace(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line, value, item, bad) of the lines of JSONL files that are not blank: ``at`` is the byte where the line's split
    begins, and ``line`` grows within it. A line is bad if it is no JSON object or has no item_id."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    item = F.try_variant_get(F.try_parse_json("value"), "$.item_id", "string")
    own = lines.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").withColumn("item", item)
    return own.withColumn("bad", F.col("item").isNull())


def trace_faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, requests, bad, first_bad): lines that are requests, lines that are not, and one of those."""
    return scan_trace(spark, path).groupBy("file").agg(F.count_if(~F.col("bad")).alias("requests"), F.count_if("bad").alias("bad"), F.min_by(F.when(F.col("bad"), F.col("value")), F.when(F.col("bad"), F.struct("at", "line"))).alias("first_bad"))


def read_trace(spark: SparkSession, path: str, trace: str, strict: bool = True) -> DataFrame:
    """JSONL files, one request a line in order of file name and line, as (trace, t, item).

    A request's place is that of its file, of the split's first byte in the file and of the line in the split. Splits are counted
    and start behind the requests of those before, so places do not depend on where Spark cuts files or which splits it packs
    together. Blank lines do not count. Bad lines raise, or are left out and keep no place if not ``strict``; ``trace_faults``
    counts them.
    """
    rows = scan_trace(spark, path)
    if strict and (worst := trace_faults(spark, path).where("bad > 0").orderBy("file").first()):
        raise ValueError(f"{worst.file}: {worst.bad} lines are no requests, as {worst.first_bad!r}")
    good = rows.where(~F.col("bad")).select("file", "at", "line", "item")
    splits = good.groupBy("file", "at").agg(F.count("*").alias("n"))
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    starts = splits.select("file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("file", "at").orderBy("line")) - 1
    return good.withColumn("place", place).join(starts, ["file", "at"]).select(F.lit(trace).alias("trace"), (F.col("start") + F.col("place")).alias("t"), "item")


def write_trace(df: DataFrame, path: str) -> None:
    """Files whose names sort as their requests do."""
    df.orderBy("t").select(F.to_json(F.struct(F.col("item").alias("item_id"))).alias("value")).write.text(path)


def family_of_path(paths: DataFrame, known: DataFrame) -> DataFrame:
    """``paths`` (path, ...) with ``family``: that of the first ``trace_family=`` folder, else the longest of ``known`` (name) that
    begins the file's name, followed by an underscore, else null.

    A name is cut at each length that known names have, and its beginnings are looked up by equality, however many are known.
    """
    names = known.where("name <> ''").select("name").distinct()
    lengths = names.agg(F.sort_array(F.collect_set(F.length("name"))).alias("lengths"))  # one row; no more than the longest name is long
    file = F.element_at(F.split("path", "/"), -1)
    named = F.regexp_extract("path", r"(?:^|/)trace_family=([^/]+)", 1)
    distinct = paths.select("path").distinct().crossJoin(F.broadcast(lengths)).select("path", F.explode(F.expr("filter(lengths, n -> substring(element_at(split(path, '/'), -1), n + 1, 1) = '_')")).alias("n"))
    found = distinct.withColumn("name", F.substring(file, 1, F.col("n"))).join(names, "name").groupBy("path").agg(F.max_by("name", "n").alias("begins"))
    return paths.join(found, "path", "left").withColumn("family", F.when(named != "", named).otherwise(F.col("begins"))).drop("begins")


def strict_join(sources: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One row for each key with the other columns of all ``sources``. Each has to have each key once: else a key that is missing in
    some source, or repeated, raises, and what is wrong is named.

    All sources are grouped in one pass, so that a key lost on any side is seen, which inner joins would drop.
    """
    columns = {n: [c for c in df.columns if c not in key] for n, df in sources.items()}
    if len(names := [c for own in columns.values() for c in own]) != len(set(names)):
        raise ValueError(f"columns of several sources: {sorted(c for c in set(names) if names.count(c) > 1)}")
    parts = []
    for n, df in sources.items():
        held = [F.struct(*own).alias(m) if n == m else F.lit(None).cast(T.StructType([sources[m].schema[c] for c in own])).alias(m) for m, own in columns.items()]
        parts.append(df.select(*key, F.lit(n).alias("cachesight_source"), *held))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    counts = {n: F.count_if(F.col("cachesight_source") == n).alias(f"cachesight_n_{n}") for n in sources}
    both = materialize(every.groupBy(*key).agg(*counts.values(), *[F.first(n, ignorenulls=True).alias(n) for n in sources]), "joined")
    wrong = both.where(" OR ".join(f"`cachesight_n_{n}` <> 1" for n in sources))
    if faults := [f"{tuple(r[c] for c in key)} is {r[f'cachesight_n_{n}'] or 'no'} times in {n}" for r in wrong.orderBy(*key).limit(20).collect() for n in sources if r[f"cachesight_n_{n}"] != 1]:
        raise ValueError(f"{wrong.count()} keys are not once in each source: " + "; ".join(faults))
    return both.select(*key, *[F.col(n)[c].alias(c) for n, own in columns.items() for c in own])


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result rows as JSON lines: lines that are no JSON or of an unknown status are left out, the last row of a key wins.

    ``schema`` has run_key, status and at (the place of the row in its log).
    """
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = rows.where("_bad IS NULL AND status IN ('complete', 'failed')").drop("_bad")
    place = F.row_number().over(Window.partitionBy("run_key").orderBy(F.desc("at")))
    return good.withColumn("place", place).where("place = 1").drop("place")


def append_runs(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _entries(spark: SparkSession, path: str) -> list:
    text = _read_text(spark, path)
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise ValueError(f"no library reads {path} here; write it as JSON") from None
        doc = yaml.safe_load(text)
    else:
        doc = json.loads(text)
    return doc.get("families", []) if isinstance(doc, dict) else doc or []


def families(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A list, in JSON or (where its library is there) YAML, of family entries (name, selected, blocked, reason), checked for repeated and missing names."""
    entries = _entries(spark, path)
    if incomplete := [e for e in entries if not isinstance(e, dict) or not e.get("name")]:
        raise ValueError(f"entries without a name: {incomplete[:5]}")
    names = [e["name"] for e in entries]
    if len(names) != len(set(names)):
        raise ValueError("a family is listed twice")
    if missing := set(required) - set(names):
        raise ValueError(f"families are missing: {sorted(missing)}")
    rows = sorted((e["name"], bool(e.get("selected", True)), bool(e.get("blocked", False)), e.get("reason", "")) for e in entries)
    return spark.createDataFrame(rows, "name string, selected boolean, blocked boolean, reason string")
