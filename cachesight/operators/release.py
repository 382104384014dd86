"""Releases: staged build, inventory, checksums, validation, previews under pseudonyms and migration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachesight.functions.scalars import pseudonym, pseudonym_list
from cachesight.operators import validate, views
from cachesight.operators.selection import bottom_sample
from cachesight.schema import CANONICAL, DECISION_KEY, PARTITIONS
from cachesight.sources import files, tables

STAGES = ("candidate_rows", "decision_view", "pairwise_sample", "split_summary", "inventory", "manifest")
#: Columns of the decision view before and after its contract grew.
OLD_VIEW = 12
NEW_VIEW = 19


def select_families(families: DataFrame, allow_blocked: bool = False) -> DataFrame:
    """(name, included, why) of a registry."""
    blocked = F.col("blocked") & F.lit(not allow_blocked)
    why = F.when(~F.col("selected"), "not selected").when(blocked, F.concat(F.lit("blocked: "), "reason")).otherwise("included")
    return families.select("name", (F.col("selected") & ~blocked).alias("included"), why.alias("why"))


def source_summary(spark: SparkSession, path: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), blocked: tuple[str, ...] = ()) -> DataFrame:
    """What a release of the files that ``path`` stands for would have, without reading their rows.

    One row for each family that is found, wanted or blocked: its shards and bytes, rows and decisions (of the split_summary.csv
    beside a manifest, else rows of the manifest's entries, else null), whether it is selected, and what is wrong: ``missing``
    (wanted, but nowhere) or ``blocked`` (there, blocked and not excluded). Files of no known family are the family null.
    """
    if both := set(include) & set(exclude):
        raise ValueError(f"included and excluded: {sorted(both)}")
    known = sorted({*include, *exclude, *blocked})
    paths = tables.resolve(spark, path)
    sizes = spark.createDataFrame([(p, tables.file_size(spark, p)) for p in paths], "path string, bytes long")
    names = spark.createDataFrame([(n,) for n in known], "name string")
    shards = tables.family_of_path(sizes, names).groupBy("family").agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes"))
    summary = f"{path.rsplit('/', 1)[0]}/split_summary.csv"
    if path.endswith(".json") and tables.exists(spark, summary):
        rows = spark.read.option("header", True).csv(summary).groupBy(F.col("trace_family").alias("counted")).agg(F.sum(F.col("row_count").cast("long")).alias("rows"), F.sum(F.col("decision_count").cast("long")).alias("decisions"))
    elif path.endswith(".json"):
        entries = spark.createDataFrame(tables.manifest_rows(spark, path), "path string, rows long")
        rows = tables.family_of_path(entries, names).groupBy(F.col("family").alias("counted")).agg(F.sum("rows").alias("rows"), F.lit(None).cast("long").alias("decisions"))
    else:
        rows = spark.createDataFrame([], "counted string, rows long, decisions long")
    found = shards.join(rows, F.col("family").eqNullSafe(F.col("counted")), "full_outer").withColumn("family", F.when(F.col("shards").isNull(), F.col("counted")).otherwise(F.col("family"))).drop("counted")
    wanted = names.select(F.col("name").alias("listed"))
    every = found.join(wanted, found["family"] == wanted["listed"], "full_outer").withColumn("family", F.coalesce("family", "listed")).drop("listed")
    there = F.col("shards").isNotNull() | F.col("rows").isNotNull()
    named = lambda own: F.coalesce(F.col("family").isin(*own), F.lit(False)) if own else F.lit(False)
    selected = (named(include) if include else there) & ~named(exclude)
    fault = F.when(named(include) & ~there, "missing").when(named(blocked) & there & ~named(exclude), "blocked")
    return every.select("family", F.coalesce("shards", F.lit(0)).alias("shards"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "rows", "decisions", (selected & there).alias("selected"), fault.alias("fault"))


def export(candidates: DataFrame, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """Write the partitioned rows of the families that are included (all, if none is named) and not excluded; a family that is named
    on both sides raises, as do rows that would be written twice."""
    if both := set(include) & set(exclude):
        raise ValueError(f"included and excluded: {sorted(both)}")
    rows = candidates.where(F.col("trace_family").isin(*include)) if include else candidates
    rows = rows.where(~F.col("trace_family").isin(*exclude)) if exclude else rows
    if double := validate.duplicate_candidates(rows).limit(1).count():
        raise ValueError(f"{double} or more candidates are there twice")
    tables.write_partitions(rows, root, overwrite)


def repeated_partitions(spark: SparkSession, root: str) -> DataFrame:
    """Partition values that more than one folder stands for, as ``capacity=32`` and ``capacity=032`` do, with the folders."""
    folder = F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1)
    named = files.listed(spark, root, ".parquet").select(*files.partition_values(F.col("path"), {c: "bigint" if c in ("capacity", "horizon") else "string" for c in PARTITIONS}), folder.alias("folder")).distinct()
    return named.groupBy(*PARTITIONS).agg(F.array_sort(F.collect_list("folder")).alias("folders")).where(F.size("folders") > 1)


def done(spark: SparkSession, root: str, stage: str) -> bool:
    return tables.exists(spark, f"{root}/{stage}/_SUCCESS")


def build(spark: SparkSession, candidates: DataFrame, root: str, blocked: tuple[str, ...] = (), pairs: int = 1_000_000, per_decision: int = 8, resume: bool = True) -> list[str]:
    """Write a release below ``root`` stage by stage and return the stages that were written now.

    A stage is finished when its _SUCCESS file is there; a run that resumes leaves such stages alone, and one that does not
    refuses to overwrite. Later stages read the written rows, so they see what a reader will see.
    """
    written = []

    def stage(name: str, make) -> None:
        if done(spark, root, name):
            if not resume:
                raise FileExistsError(f"{root}/{name}")
            return
        make(f"{root}/{name}")
        written.append(name)

    rows = candidates.where(~F.col("trace_family").isin(*blocked)) if blocked else candidates
    stage("candidate_rows", lambda p: tables.write_partitions(rows, p, overwrite=True))
    own = tables.read_partitions(spark, f"{root}/candidate_rows")
    plain = lambda df: lambda p: tables.write_table(df(), p, overwrite=True)
    stage("decision_view", plain(lambda: views.decision_view(own)))
    stage("pairwise_sample", plain(lambda: views.pairwise_sample(own, pairs, per_decision)))
    stage("split_summary", plain(lambda: views.split_summary(own)))
    stage("inventory", plain(lambda: inventory(spark, root, ("candidate_rows", "decision_view", "pairwise_sample", "split_summary"))))
    stage("manifest", lambda p: manifest(spark, root, blocked).coalesce(1).write.mode("overwrite").json(p))
    return written


def plan(spark: SparkSession, candidates: DataFrame, root: str) -> DataFrame:
    """(stage, done, row_count): what a build would do; rows of the first stage are counted, those of later ones are bounds."""
    n = candidates.count()
    return spark.createDataFrame([(s, done(spark, root, s), n) for s in STAGES], "stage string, done boolean, row_bound long")


def inventory(spark: SparkSession, root: str, stages: tuple[str, ...]) -> DataFrame:
    """(path, size, modified, digest) of each Parquet file of the stages; ranges of files are hashed in tasks."""
    own = files.listed(spark, root, ".parquet").where(F.split("path", "/")[0].isin(*stages))
    return files.digests(spark, root, own)


def verify_checksums(spark: SparkSession, root: str) -> DataFrame:
    """(path, fault): files that are missing, changed or not listed."""
    there = inventory(spark, root, ("candidate_rows", "decision_view", "pairwise_sample", "split_summary"))
    return files.inventory_diff(spark.read.parquet(f"{root}/inventory"), there).withColumnRenamed("state", "fault")


def manifest(spark: SparkSession, root: str, blocked: tuple[str, ...]) -> DataFrame:
    """One row: row counts of the stages, families and what was left out."""
    own = tables.read_partitions(spark, f"{root}/candidate_rows")
    counts = own.agg(F.count("*").alias("candidate_rows"), F.array_sort(F.collect_set("trace_family")).alias("families"))
    view = spark.read.parquet(f"{root}/decision_view").agg(F.count("*").alias("decision_view"))
    pairs = spark.read.parquet(f"{root}/pairwise_sample").agg(F.count("*").alias("pairwise_sample"))
    return counts.crossJoin(view).crossJoin(pairs).withColumn("blocked_families", F.array(*[F.lit(b) for b in blocked]).cast("array<string>"))  # one row each


def validate_release(spark: SparkSession, root: str, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(check, faults) over a written release: labels and keys of the rows, counts against the manifest, views against the
    rows, blocked families, missing stages and checksums."""
    absent = [s for s in STAGES if not done(spark, root, s)]
    if absent:
        return spark.createDataFrame([(f"missing_stage:{s}", 1) for s in absent], "check string, faults long")
    own = tables.read_partitions(spark, f"{root}/candidate_rows")
    view = spark.read.parquet(f"{root}/decision_view")
    out = validate.validate_candidates(own)
    count = lambda df, name: df.agg(F.count("*").alias("faults")).select(F.lit(name).alias("check"), "faults")
    m = spark.read.json(f"{root}/manifest")
    sizes = own.agg(F.count("*").alias("rows_now")).crossJoin(view.agg(F.count("*").alias("view_now"))).crossJoin(m)  # one row each
    out = out.unionByName(count(sizes.where("rows_now <> candidate_rows OR view_now <> decision_view"), "row_counts_differ"))
    keys = own.select(*DECISION_KEY).distinct()
    out = out.unionByName(count(keys.join(view.select(*DECISION_KEY), DECISION_KEY, "left_anti"), "decisions_without_view"))
    out = out.unionByName(count(own.where(F.col("trace_family").isin(*blocked)) if blocked else own.limit(0), "blocked_family_rows"))
    return out.unionByName(count(verify_checksums(spark, root), "checksum_faults"))


def build_sample(spark: SparkSession, source: str, root: str, include_ties: bool = False) -> DataFrame:
    """A small release with all pairs from the shards that ``source`` stands for, and its inventory of partitions: values, rows (from
    footers) and digests of their files. Rows that ``validate_candidates`` finds fault with raise before anything is written."""
    rows = tables.read_candidates(spark, source)
    faults = {r.check: r.faults for r in validate.validate_candidates(rows).where("faults > 0").collect()}
    if faults:
        raise ValueError(f"{source} has faults: {faults}")
    if tables.exists(spark, root):
        raise FileExistsError(root)
    tables.write_partitions(rows, f"{root}/candidate_rows")
    own = tables.read_partitions(spark, f"{root}/candidate_rows")
    tables.write_table(views.decision_view(own), f"{root}/decision_view")
    tables.write_table(views.pairwise_view(own, include_ties), f"{root}/pairwise_view")
    folder = f"{root}/candidate_rows"
    counted = files.file_rows(files.footers(spark, folder)).select("path", "rows")
    made = files.digests(spark, folder, files.listed(spark, folder, ".parquet")).join(counted, "path")
    values = files.partition_values(F.col("path"), {c: "bigint" if c in ("capacity", "horizon") else "string" for c in PARTITIONS})
    tables.write_table(made.select(*values, "path", F.col("rows").alias("row_count"), "digest"), f"{root}/partitions")
    return spark.read.parquet(f"{root}/partitions")


def build_family(spark: SparkSession, source: str, root: str, family: str, salt: str, dataset: str, version: str) -> DataFrame:
    """A public release of all shards of one ``family``, every row, with pages under pseudonyms; returns its statistics.

    Shards that hold another family raise and are named, whatever their names say. Rows are written apart and scanned as a reader
    would see them: raw pages in any text column, pseudonyms that two pages share, and what ``secret_scan`` finds raise, and nothing
    is published. Beside the rows are their sources: file, bytes, rows and digest.
    """
    raw = tables.read_candidates(spark, source, source="source_file")
    strange = raw.where(~F.col("trace_family").eqNullSafe(F.lit(family))).groupBy("source_file").agg(F.array_sort(F.collect_set("trace_family")).alias("families"))
    if found := strange.orderBy("source_file").limit(20).collect():
        raise ValueError(f"shards with rows of other families than {family}: " + "; ".join(f"{r.source_file}: {', '.join(r.families)}" for r in found))
    if tables.exists(spark, root):
        raise FileExistsError(root)
    page = pseudonym(F.col("candidate_page_id"), salt)
    public = raw.select(F.lit(dataset).alias("release_dataset"), F.lit(version).alias("release_version"), *[c for c in CANONICAL if c != "candidate_page_id"], page.alias("candidate_page_id"), F.lit(False).alias("candidate_page_id_original_present"), "source_file")
    stage = f"{root.rstrip('/')}-{uuid.uuid4().hex}"
    tables.write_table(public, f"{stage}/rows")
    written = spark.read.parquet(f"{stage}/rows")
    faults = {f"raw pages in {r.column}": r.leaked for r in validate.leaked_values(written.drop("source_file"), raw, "candidate_page_id").where("leaked > 0").collect()}
    if n := validate.pseudonym_collisions(raw, "candidate_page_id", salt).count():
        faults["pseudonyms of several pages"] = n
    shown = written.select([f.name for f in written.schema if f.dataType.simpleString() == "string"])
    faults |= {f"{r.kind} in {r.column}": r.row_count for r in validate.secret_scan(shown).where("row_count > 0").collect()}
    if faults:
        files.remove(spark, stage)
        raise ValueError(f"not published: {faults}")
    paths = tables.resolve(spark, source)
    folder = paths[0].rsplit("/", 1)[0]
    sources = spark.createDataFrame([(p, tables.file_size(spark, p), 0) for p in paths], "full string, size long, modified long").withColumn("path", F.element_at(F.split("full", "/"), -1))
    rows = raw.groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("row_count"))
    own = sources.where(F.col("full") == F.concat(F.lit(f"{folder}/"), F.col("path")))
    hashed = files.digests(spark, folder, own.select("path", "size")).select("path", "digest")
    tables.write_table(sources.select("path", "size").join(rows, "path", "left").join(hashed, "path", "left"), f"{stage}/sources")
    sets = {c: F.array_sort(F.collect_set(c)).alias(c) for c in ("capacity", "split")}
    tables.write_table(written.agg(F.count("*").alias("row_count"), F.count_distinct(*DECISION_KEY).alias("decisions"), *sets.values(), F.count_distinct("source_file").alias("shards")), f"{stage}/statistics")
    files.move(spark, stage, root)
    return spark.read.parquet(f"{root}/statistics")


def partition_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files, rows and bytes of each partition. A partition may have several files."""
    rows = tables.read_partitions(spark, root).groupBy(*PARTITIONS).agg(F.count("*").alias("row_count"))
    named = files.listed(spark, root, ".parquet").select(*files.partition_values(F.col("path"), {c: "bigint" if c in ("capacity", "horizon") else "string" for c in PARTITIONS}), "size")
    sizes = named.groupBy(*PARTITIONS).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return rows.join(sizes, PARTITIONS, "left")


def preview(candidates: DataFrame, n: int, salt: str, seed: int = 7) -> DataFrame:
    """``n`` rows of each capacity under pseudonyms, with whether the raw page was there."""
    drawn = bottom_sample(candidates.select(*CANONICAL), n, ["capacity"], ["decision_id", "candidate_page_id"], seed).drop("sample_score", "sample_rank")
    present = F.col("candidate_page_id").isNotNull() & (F.length("candidate_page_id") > 0)
    return drawn.withColumn("candidate_page_id_original_present", present).withColumn("candidate_page_id", pseudonym(F.col("candidate_page_id"), salt))


def hide_pages(view: DataFrame, salt: str, families: list[str]) -> DataFrame:
    """A decision view in which the pages of ``families`` are pseudonyms."""
    hidden = F.col("trace_family").isin(*families)
    return view.withColumn("optimal_candidate_page_ids", F.when(hidden, pseudonym_list(F.col("optimal_candidate_page_ids"), salt)).otherwise(F.col("optimal_candidate_page_ids")))


def preview_faults(public: DataFrame, raw: DataFrame) -> DataFrame:
    """(check, faults): pages that are no pseudonyms, and raw pages in any text column."""
    bad = public.where(~F.col("candidate_page_id").rlike("^obj_[0-9a-f]{24}$")).agg(F.count("*").alias("faults")).select(F.lit("not_a_pseudonym").alias("check"), "faults")
    leaked = validate.leaked_values(public, raw, "candidate_page_id").agg(F.sum("leaked").alias("faults")).select(F.lit("raw_page_leaked").alias("check"), "faults")
    return bad.unionByName(leaked)


def migration_plan(spark: SparkSession, root: str) -> dict:
    """What a release lacks of today's contract, from schemas alone."""
    columns = spark.read.parquet(f"{root}/decision_view").columns if tables.exists(spark, f"{root}/decision_view") else []
    rows = spark.read.parquet(f"{root}/candidate_rows").columns if tables.exists(spark, f"{root}/candidate_rows") else []
    missing = [c for c in CANONICAL if c not in rows]
    return {"canonical": not missing, "missing_columns": missing, "view_columns": len(columns), "regenerate_view": len(columns) != NEW_VIEW, "cheap": not missing}


def migration_partitions(spark: SparkSession, root: str) -> DataFrame:
    """Of each partition its files and rows, the columns that today's contract has and a file of it lacks, and whether it can be
    migrated by rewriting (``cheap``): nothing is missing. Only footers are read."""
    wanted = [c for c in CANONICAL if c not in PARTITIONS]
    each = files.footers(spark, root).groupBy("path").agg(F.collect_set("column").alias("columns"), F.max(F.coalesce("row_group", F.lit(-1))).alias("last"))
    counted = files.file_rows(files.footers(spark, root)).select("path", "rows")
    values = files.partition_values(F.col("path"), {c: "bigint" if c in ("capacity", "horizon") else "string" for c in PARTITIONS})
    lacks = F.when(F.col("last") >= 0, F.array_except(F.array(*map(F.lit, wanted)), "columns")).otherwise(F.array().cast("array<string>"))
    rows = each.join(counted, "path").select(*values, lacks.alias("lacks"), "rows")
    out = rows.groupBy(*PARTITIONS).agg(F.count("*").alias("files"), F.sum("rows").alias("row_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lacks")))).alias("missing"))
    return out.withColumn("cheap", F.size("missing") == 0)


def migrate(spark: SparkSession, old: str, new: str, blocked: tuple[str, ...] = ()) -> list[str]:
    """Build today's release from an old one's rows; refuses rows that lack canonical columns."""
    found = migration_plan(spark, old)
    if not found["canonical"]:
        raise ValueError(f"columns are missing: {found['missing_columns']}")
    return build(spark, tables.read_partitions(spark, f"{old}/candidate_rows"), new, blocked)


def unit_completeness(plan: DataFrame, names: DataFrame) -> DataFrame:
    """(family, capacity, state) from marker and shard names: complete with a marker, partial with shards only, else missing."""
    name = F.element_at(F.split("path", "/"), -1)
    unit = names.select(F.regexp_extract(name, r"^(.+)__cap(\d+)\.", 1).alias("family"), F.regexp_extract(name, r"__cap(\d+)\.", 1).cast("long").alias("capacity"), name.endswith(".done.json").alias("marker"))
    seen = unit.groupBy("family", "capacity").agg(F.max("marker").alias("marker"), F.count_if(~F.col("marker")).alias("shards"))
    state = F.when(F.col("marker"), "complete").when(F.col("shards") > 0, "partial").otherwise("missing")
    return plan.join(seen, ["family", "capacity"], "left").select("family", "capacity", state.alias("state"), F.coalesce("shards", F.lit(0)).alias("shards"))
