"""What the text operators share: stage tables and column-keeping Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitwarden.operators.lineage import ensure_checkpoint_dir

MASK64 = (1 << 64) - 1


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the folder that every executor and the driver can reach."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the stored rows."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_batch(df: DataFrame, schema: T.StructType | str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` for generators that yield column dictionaries."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([
                c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in ((columns[f.name], f) for f in arrow)
            ], schema=arrow)

    return df.mapInArrow(run, out)


def add_columns(df: DataFrame, inputs: tuple[str, ...], schema: str, fn: Callable[..., dict], rows: int = 512) -> DataFrame:
    """Keep every column of ``df`` and add those of ``schema``; a column of the same name gives way.

    ``fn`` gets one Python list per input column, at most ``rows`` long, and returns lists.
    """
    new = T.StructType.fromDDL(schema)
    taken = {f.name.lower() for f in new}
    kept = [c for c in df.columns if c.lower() not in taken]
    # An input that gives way to a result still has to reach the function.
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs) if c not in kept])
    at = [c if c in kept else f"__in{i}" for i, c in enumerate(inputs)]
    out = T.StructType([*[source.schema[c] for c in kept], *new.fields])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                got = fn(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in at])
                yield {c: part.column(part.schema.get_field_index(c)) for c in kept} | got

    return by_batch(source, out, run)
