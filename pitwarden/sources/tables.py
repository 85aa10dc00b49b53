"""Reading and writing the stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pitwarden.config import FEATURE_VERSION
from pitwarden.operators.lineage import table_exists
from pitwarden.operators.quality import check_table
from pitwarden.schema import SCHEMAS


def struct_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in SCHEMAS[name].columns))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A stored table; with a contract name its columns and rules are checked first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    if name:
        check_table(df, name)
    return df


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Swap a finished folder in: the old one steps aside and goes only after the rename."""
    fs, target = _fs(spark, path)
    _, source = _fs(spark, staged)
    old = None
    if fs.exists(target):
        _, old = _fs(spark, f"{path}.old-{uuid.uuid4().hex}")
        fs.rename(target, old)
    if not fs.rename(source, target):
        if old is not None:
            fs.rename(old, target)
        raise OSError(f"could not move {staged} to {path}")
    if old is not None:
        fs.delete(old, True)


def write_table(df: DataFrame, path: str, name: str | None = None, overwrite: bool = True, partition_by: tuple[str, ...] = (), fmt: str = "parquet", **options: str) -> str:
    """Validate, write beside the target and swap in; refuses an existing target unless told."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    if fs.exists(p) and not overwrite:
        raise FileExistsError(path)
    if name:
        check_table(df, name)
    staged = f"{path}.new-{uuid.uuid4().hex}"
    writer = df.write.format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(staged)
    _replace(spark, staged, path)
    return path


def write_csv(df: DataFrame, path: str, name: str | None = None, overwrite: bool = True) -> str:
    return write_table(df, path, name, overwrite, fmt="csv", header="true")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with declared types; values that do not fit raise."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; an unparsable line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan(spark: SparkSession, base: str, columns: list[str] | None = None, **partitions: str | list[str]) -> DataFrame:
    """All partitions under ``base``, or the named ones, with only the wanted columns that exist."""
    df = spark.read.parquet(base)
    for k, v in partitions.items():
        df = df.filter(F.col(k).isin(*(v if isinstance(v, list) else [v])))
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def episode_orders(orders: DataFrame, events: DataFrame, personas: tuple[str, ...] = ("spoofing", "layering")) -> DataFrame:
    """Orders of the accounts named in episodes of the given personas."""
    acc = events.filter(F.col("persona").isin(*personas)).select(F.explode("trader_ids").alias("trader_id")).distinct()
    return orders.join(acc, "trader_id", "left_semi")


def wide_to_long(wide: DataFrame, key: str, tickers: list[str], fields: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    """One column block per ticker ('<ticker>_<field>') to rows; rows without a close go, missing volume is 0."""
    blocks = F.explode(F.array(*[
        F.struct(F.lit(t).alias("commodity"), *[F.col(f"`{t}_{f}`").alias(f) for f in fields]) for t in tickers
    ]))
    long = wide.select(key, blocks.alias("x")).select(key, "x.*").filter("close IS NOT NULL")
    return long.withColumn("volume", F.coalesce("volume", F.lit(0)))


def keep_recent(df: DataFrame, key: str, span: int) -> DataFrame:
    """Rows within ``span`` of the latest key."""
    last = df.agg(F.max(key).alias("_last"))
    return df.crossJoin(F.broadcast(last)).filter(F.col(key) > F.col("_last") - span).drop("_last")


def latest_dataset(manifest: DataFrame) -> DataFrame:
    """Most recently fetched dataset per source."""
    return manifest.groupBy("source").agg(F.max_by("dataset", F.struct("fetched_at", "dataset")).alias("dataset"), F.max("fetched_at").alias("fetched_at"))


def dataset_name(source, interval, start, end):
    """'<source>_<interval>_<start>_<end>' from epoch seconds, minutes resolution, UTC."""
    def stamp(c):
        return F.date_format(F.timestamp_seconds(c), "yyyyMMdd'T'HHmm'Z'")

    return F.concat_ws("_", source, interval, stamp(start), stamp(end))


def tick_to_time(tick):
    """Simulated second as wall time from 2026-01-01."""
    return F.timestamp_seconds(F.lit(1767225600) + tick)


def minute_to_time(minute):
    return F.timestamp_seconds(minute * 60)


def versioned(spark: SparkSession, base: str, build, version: int = FEATURE_VERSION, newest_input: int | None = None) -> DataFrame:
    """A derived table kept per definition version; rebuilt when absent or older than its input."""
    path = f"{base}/feature_version={version}"
    fresh = table_exists(spark, path)
    if fresh and newest_input is not None:
        fs, p = _fs(spark, path)
        fresh = fs.getFileStatus(p).getModificationTime() >= newest_input
    if not fresh:
        write_table(build(), path)
    return spark.read.parquet(path)


def input_state(spark: SparkSession, *paths: str) -> str:
    """Digest of the files below ``paths``: number, bytes, newest change and a sum of hashes of path, size and time.

    Spark lists the files; their content is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    r = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.max("modificationTime").alias("at"), F.sum(mark).alias("mark")).first()
    return f"{r['n']} {r['size'] or 0} {r['at']} {r['mark'] or 0}"


def derived_table(spark: SparkSession, base: str, build, inputs: list[str], version: int = FEATURE_VERSION) -> DataFrame:
    """A table derived from stored ``inputs``, rebuilt when a file of theirs is added, gone or changed, or on a new ``version``.

    Each build writes a copy of its own and then one row into ``base/_builds``: version, input state and copy. The row of
    the newest finished build with the present version and state is the pointer to the copy, so nothing is renamed (safe
    on object stores), a reader keeps the copy it opened, and a build that dies leaves no row. The state is taken before
    the build reads: a change during a build makes its copy stale, not wrong. Old copies stay until ``drop_stale``.
    """
    state, log = input_state(spark, *inputs), f"{base}/_builds"
    row = _newest_build(spark, log, state, version)
    if row is not None and table_exists(spark, row["copy"]):
        return spark.read.parquet(row["copy"])
    copy = f"{base}/copies/{uuid.uuid4().hex}"
    build().write.parquet(copy)
    now = F.current_timestamp().alias("built_at")
    spark.range(1).select(F.lit(version).alias("version"), F.lit(state).alias("state"), F.lit(copy).alias("copy"), now).coalesce(1).write.mode("append").parquet(log)
    return spark.read.parquet(copy)


def builds(spark: SparkSession, base: str) -> DataFrame:
    """All finished builds of a derived table."""
    return spark.read.schema("version int, state string, copy string, built_at timestamp").parquet(f"{base}/_builds")


def _newest_build(spark: SparkSession, log: str, state: str, version: int):
    fs, p = _fs(spark, log)
    if not fs.exists(p):
        return None
    mine = builds(spark, log.removesuffix("/_builds")).filter((F.col("version") == version) & (F.col("state") == state))
    return mine.orderBy(F.desc("built_at"), "copy").limit(1).first()


def drop_stale(spark: SparkSession, base: str, keep: str) -> int:
    """Delete the copies of a derived table other than the folder ``keep``; returns how many went."""
    fs, p = _fs(spark, f"{base}/copies")
    gone = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName() != keep.rstrip("/").rsplit("/", 1)[-1]]
    for path in gone:
        fs.delete(path, True)
    return len(gone)


def market_of(flags: DataFrame, ranges: DataFrame) -> DataFrame:
    """Market of each alert by tick range (market, lo, hi); ranges of one commodity do not overlap."""
    from pitwarden.operators.ranges import overlap_join

    return overlap_join(flags, ranges, ["commodity"], ("window_start", "window_start"), ("lo", "hi"))
