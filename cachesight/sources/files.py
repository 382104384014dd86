"""Files below a root: footers, digests by ranges, inventories and their repair, compaction.

The driver lists names and moves files; what is in the files is read in tasks, through the file system that a path's scheme names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachesight.sources.tables import _fs, exists

#: Bytes of a file that one task digests at a time.
RANGE = 64 << 20
#: Bytes that are held of them.
PIECE = 1 << 20
FOOTERS = "path string, row_group int, rows long, bytes long, column string, nulls long, low string, high string"
LOG = "_compaction.json"


def listed(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """(path, size, modified) of the files below ``root``, paths relative to it; hidden and marker files are left out."""
    fs, p = _fs(spark, root)
    base, rows = fs.makeQualified(p).toString().rstrip("/") + "/", []
    it = fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString().removeprefix(base)
        if name.endswith(suffix) and not any(part.startswith(("_", ".")) for part in name.split("/")):
            rows.append((name, f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(sorted(rows), "path string, size long, modified long")


def _opened(root: str):
    """A function that opens a path below ``root`` in a task."""
    from pyarrow import fs

    uri = root if "://" in root else root.replace("file:/", "/", 1) if root.startswith("file:/") else root
    system, base = fs.FileSystem.from_uri(uri)
    return lambda path: system.open_input_file(f"{base.rstrip('/')}/{path}")


def _spread(df: DataFrame) -> DataFrame:
    """Few rows of names that mean much work each, one by one over the tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns[:2])


def footers(spark: SparkSession, root: str) -> DataFrame:
    """Row counts and statistics of each row group and column of the Parquet files below ``root``, from their footers alone.

    A file without row groups is one row with row_group null. A column without statistics has null in their place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        opened = _opened(root)
        for b in batches:
            for path in b["path"]:
                with opened(path) as f:
                    meta = pq.ParquetFile(f).metadata
                rows = [(path, None, 0, 0, None, None, None, None)] if not meta.num_row_groups else []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        column = group.column(c)
                        s = column.statistics
                        bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                        rows.append((path, g, group.num_rows, column.total_compressed_size, column.path_in_schema, s.null_count if s is not None and s.has_null_count else None, *bounds))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in FOOTERS.split(", ")])
                yield out.astype({"row_group": "Int32", "nulls": "Int64"})

    return _spread(listed(spark, root, ".parquet").select("path", "size")).mapInPandas(run, FOOTERS)


def file_rows(footer: DataFrame) -> DataFrame:
    """(path, row_groups, rows, bytes) of each file, from ``footers``."""
    groups = footer.groupBy("path", "row_group").agg(F.first("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return groups.groupBy("path").agg(F.count("row_group").alias("row_groups"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


def partition_values(path: Column, columns: dict[str, str]) -> list[Column]:
    """The values of ``columns`` (name and type) in a path's folders ``name=value``."""
    value = lambda c: F.expr(f"reflect('java.net.URLDecoder', 'decode', replace(regexp_extract(path, '(?:^|/){c}=([^/]*)', 1), '+', '%2B'), 'UTF-8')")
    return [F.when(value(c) != "__HIVE_DEFAULT_PARTITION__", value(c)).cast(kind).alias(c) for c, kind in columns.items()]


def recount(counted: DataFrame, expected: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Each partition with its files and rows (``counted`` is ``file_rows``) against ``expected`` (the partition, row_count): its
    state is ok, missing, not listed or differs. No data are read."""
    found = counted.select(*partition_values(F.col("path"), columns), "rows").groupBy(*columns).agg(F.count("*").alias("files"), F.sum("rows").alias("found"))
    key = list(columns)
    other = expected.select(*[F.col(c).alias(f"want_{c}") for c in key], F.col("row_count").alias("expected"))
    same = [F.col(c).eqNullSafe(F.col(f"want_{c}")) for c in key]
    state = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "not listed").when(F.col("found") == F.col("expected"), "ok").otherwise("differs")
    both = found.join(other, same, "full_outer")
    return both.select(*[F.coalesce(c, f"want_{c}").alias(c) for c in key], F.coalesce("files", F.lit(0)).alias("files"), "expected", "found", state.alias("state"))


# --- digests and inventories ------------------------------------------------------------------------------------------


def digests(spark: SparkSession, root: str, files: DataFrame, size: int = RANGE) -> DataFrame:
    """``files`` (path, size, ...) with ``digest``: the SHA-256 of the digests (hexadecimal) of the file's ranges of ``size`` bytes.

    Ranges are read in tasks of their own, in pieces, so a file may have any size. An empty file is one empty range.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = _opened(root)
        for b in batches:
            out = []
            for path, k in zip(b["path"], b["k"], strict=True):
                h, left = hashlib.sha256(), size
                with opened(path) as f:
                    f.seek(k * size)
                    while left and (data := f.read(min(PIECE, left))):
                        h.update(data)
                        left -= len(data)
                out.append((path, k, h.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "k", "own"])

    last = F.greatest(F.ceil(F.col("size") / size) - 1, F.lit(0)).cast("long")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    parts = _spread(ranges).mapInPandas(run, "path string, k long, own string")
    whole = parts.groupBy("path").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "own"))), lambda x: x["own"]), ""), 256).alias("digest"))
    return files.join(whole, "path")


def inventory(spark: SparkSession, root: str, size: int = RANGE) -> DataFrame:
    """(path, size, modified, digest) of each file below ``root``."""
    return digests(spark, root, listed(spark, root), size)


def inventory_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): missing, not listed, or changed."""
    was, now = old.select("path", F.col("digest").alias("was")), new.select("path", F.col("digest").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "not listed").when(F.col("was") != F.col("now"), "changed")
    return was.join(now, "path", "full_outer").select("path", state.alias("state")).where("state IS NOT NULL")


def absolute_paths(value, at: str = "") -> list[tuple[str, str]]:
    """(place, text) of the texts in a parsed manifest that are paths of one machine."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in absolute_paths(v, f"{at}.{k}" if at else k)]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in absolute_paths(v, f"{at}[{k}]")]
    return [(at, value)] if isinstance(value, str) and (value.startswith(("/", "file:", "\\\\")) or value[1:3] in (":\\", ":/")) else []


def repair(spark: SparkSession, root: str, kept: str, apply: bool = False, size: int = RANGE) -> DataFrame:
    """What ``inventory_diff`` finds between the inventory in the table ``kept`` and the files; with ``apply`` it is brought up to date.

    Only files that are new, or whose size or time of change is another one, are read. The new inventory is written whole beside the
    old one and takes its place by renaming, so a reader never sees half of it.
    """
    old, now = spark.read.parquet(kept), listed(spark, root)
    known = old.select("path", "size", "modified", "digest")
    same = now.join(known, ["path", "size", "modified"])
    new = same.unionByName(digests(spark, root, now.join(known, ["path", "size", "modified"], "left_anti"), size)).cache()
    diff = inventory_diff(old, new)
    rows = sorted(tuple(r) for r in diff.collect())  # names of what changed
    if apply and rows or apply and new.join(known, ["path", "size", "modified"], "left_anti").limit(1).count():
        fresh, gone = f"{kept}.{uuid.uuid4().hex}", f"{kept}.{uuid.uuid4().hex}"
        new.write.parquet(fresh)
        move(spark, kept, gone)
        move(spark, fresh, kept)
        remove(spark, gone)
    new.unpersist()
    return spark.createDataFrame(rows, "path string, state string")


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _fs(spark, path)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} could not be renamed to {to}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


# --- compaction -------------------------------------------------------------------------------------------------------


def packed(files: DataFrame, target: int) -> DataFrame:
    """``files`` (path, size) that are to be merged, with ``folder`` and ``bin``: the smallest of a folder first, as many as begin
    within the same ``target`` bytes. Files of half the target or more stay, and so do bins of one file."""
    own = files.withColumn("folder", F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)).where(F.col("size") < target / 2)
    before = Window.partitionBy("folder").orderBy("size", "path").rowsBetween(Window.unboundedPreceding, -1)
    binned = own.withColumn("number", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / F.lit(target / 2)))
    several = F.count("*").over(Window.partitionBy("folder", "number"))
    return binned.withColumn("several", several).where("several > 1").select("path", "size", "folder", F.sha2(F.concat_ws("|", "folder", "number"), 256).alias("bin"))


def compact(spark: SparkSession, root: str, target: int = 128 << 20, order: tuple[str, ...] = ()) -> DataFrame:
    """Merge small Parquet files of each folder below ``root`` into files of about ``target`` bytes; rows stay the same.

    Returns (folder, files_before, merged): what was done. Merged files are written apart first. The list of what replaces what,
    then written in one piece, is the point of no return: ``recover`` carries out what such a list says, again if need be.
    Only one task writes a bin, of at most ``target`` bytes, in ``order`` if that is given.
    """
    recover(spark, root)
    bins = packed(listed(spark, root, ".parquet"), target).cache()
    try:
        names = bins.groupBy("folder", "bin").agg(F.collect_list("path").alias("paths")).collect()  # names only
        if not names:
            return spark.createDataFrame([], "folder string, files_before long, merged long")
        fs, p = _fs(spark, root)
        base = fs.makeQualified(p).toString().rstrip("/")
        stage = f"{base}/_stage-{uuid.uuid4().hex}"
        merged = [x for r in names for x in r.paths]
        rows = spark.read.option("mergeSchema", True).parquet(*[f"{base}/{x}" for x in merged])
        own = F.regexp_replace(F.expr("reflect('java.net.URLDecoder', 'decode', replace(_metadata.file_path, '+', '%2B'), 'UTF-8')"), "^file:/+", "/")
        where = spark.createDataFrame([(f"{base}/{x}".replace("file:///", "/").replace("file:/", "/"), r.bin) for r in names for x in r.paths], "cachesight_path string, cachesight_bin string")
        dealt = rows.withColumn("cachesight_path", own).join(F.broadcast(where) if len(merged) <= 100_000 else where, "cachesight_path").drop("cachesight_path")
        dealt = dealt.repartition("cachesight_bin").sortWithinPartitions("cachesight_bin", *order)
        dealt.write.partitionBy("cachesight_bin").parquet(stage)
        made = {r.path.split("/")[0].split("=", 1)[1]: r.path for r in listed(spark, f"{stage}").select("path").collect()}
        log = [{"new": f"{stage}/{made[r.bin]}", "to": f"{base}/{r.folder}/merged-{r.bin[:16]}-{uuid.uuid4().hex[:8]}.parquet".replace("//merged", "/merged"), "old": [f"{base}/{x}" for x in r.paths]} for r in names]
        _write_text(spark, f"{base}/{LOG}", json.dumps({"stage": stage, "moves": log}))
        recover(spark, root)
        done: dict[str, list[int]] = {}
        for r in names:
            own = done.setdefault(r.folder, [0, 0])
            own[0], own[1] = own[0] + len(r.paths), own[1] + 1
        return spark.createDataFrame([(f, *n) for f, n in sorted(done.items())], "folder string, files_before long, merged long")
    finally:
        bins.unpersist()


def _read_text(spark: SparkSession, path: str) -> str:
    """Also of a name that Spark's readers take for a hidden one."""
    fs, p = _fs(spark, path)
    data = fs.open(p)
    try:
        return bytes(data.readAllBytes()).decode()
    finally:
        data.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """As a whole: written beside its place and renamed."""
    fs, p = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(beside, p):
        raise OSError(f"{path} could not be written")


def recover(spark: SparkSession, root: str) -> bool:
    """Finish a compaction that was begun: each merged file takes its place, then what it replaces goes. Done again, nothing changes."""
    fs, p = _fs(spark, root)
    path = f"{fs.makeQualified(p).toString().rstrip('/')}/{LOG}"
    if not exists(spark, path):
        return False
    log = json.loads(_read_text(spark, path))
    for m in log["moves"]:
        if exists(spark, m["new"]):
            move(spark, m["new"], m["to"])
        if not exists(spark, m["to"]):
            raise OSError(f"{m['to']} is lost")
        for old in m["old"]:
            remove(spark, old)
    remove(spark, log["stage"])
    remove(spark, path)
    return True
