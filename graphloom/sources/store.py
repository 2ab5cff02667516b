"""Tables in place of stores and indexes: creation, upserts, deletion, reindexing, catalog listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tenant_label
from ..operators.graph import latest, relabel, upsert


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def create(df: DataFrame, table: str, recreate: bool = False, partition: str | None = None, buckets: tuple[int, str] | None = None) -> bool:
    """Creates a table of df's rows; an existing one stays unless recreate.  Partition and bucket columns take the part of
    indexes: equality on them prunes, joins on a bucket column need no shuffle."""
    if exists(df.sparkSession, table) and not recreate:
        return False
    out = df.write.mode("overwrite").format("parquet")
    out = out.partitionBy(partition) if partition else out
    (out.bucketBy(*buckets).sortBy(buckets[1]) if buckets else out).saveAsTable(table)
    return True


def create_for_subject(df: DataFrame, subject_id: str, prefix: str, label: str, recreate: bool = False, buckets: tuple[int, str] | None = None) -> str:
    """Creates one subject's table of rows of a label, under the subject's prefix; returns its name."""
    table = tenant_label(prefix, label).lower()
    create(relabel(df, subject_id), table, recreate, buckets=buckets)
    return table


def index(df: DataFrame, table: str, key: str, order: list) -> int:
    """Writes rows by key, the last of each key; returns how many there are.  A row without key has one of what it
    holds, the same each time."""
    own = F.xxhash64(*[c for c in df.columns if c != key]).cast("string")
    kept = latest(df.withColumn(key, F.coalesce(key, F.concat(F.lit("chunk_"), own))), [key], order)
    kept.write.mode("overwrite").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table).count()


def recover(spark: SparkSession, table: str) -> None:
    """Finishes a change of a table that was interrupted: a staged table is in the catalog only once all of it is written,
    so it holds the rows that the table is to have."""
    stage = f"{table}__staged"
    if exists(spark, stage):
        _write(spark, spark.table(stage), table, _partition(spark, stage))
        spark.sql(f"DROP TABLE {stage}")


def replace(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """Gives the table these rows, which may come from it: they are staged first, and until the stage is dropped the new
    rows are there whole, whenever it stops."""
    stage = f"{table}__staged"
    _write(spark, rows, stage, _partition(spark, table))
    recover(spark, table)


def _partition(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def _write(spark: SparkSession, rows: DataFrame, table: str, partition: list[str]) -> None:
    out = rows.write.mode("overwrite").format("parquet")
    (out.partitionBy(*partition) if partition else out).saveAsTable(table)


def merge(spark: SparkSession, table: str, new: DataFrame, key: list[str]) -> None:
    """Replaces the rows that new has keys of."""
    recover(spark, table)
    replace(spark, table, upsert(spark.table(table), new, key))


def reindex(spark: SparkSession, source: str, target: str, **constants: str) -> bool:
    """Copies a table with constant columns; a target with rows stays as it is."""
    if exists(spark, target) and not spark.table(target).isEmpty():
        return False
    df = spark.table(source)
    for k, v in constants.items():
        df = df.withColumn(k, F.lit(v))
    return create(df, target, recreate=True)


def clear(spark: SparkSession, table: str, subject: str | None = None) -> None:
    """Deletes all rows, or those of one subject (a partition)."""
    recover(spark, table)
    if subject is None:
        kept = spark.table(table).limit(0)
    else:
        kept = spark.table(table).where(F.col("subject_id") != subject)
    replace(spark, table, kept)


def names(spark: SparkSession, prefix: str = "") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))


def drop(spark: SparkSession, prefix: str, keep: tuple[str, ...] = ()) -> list[str]:
    """Drops tables by prefix, but those to keep."""
    gone = [n for n in names(spark, prefix) if n not in keep]
    for n in gone:
        spark.sql(f"DROP TABLE {n}")
    return gone


def migrate(chunks: DataFrame, mentions: DataFrame, prefix: str, dry_run: bool = False) -> dict[str, int]:
    """Writes chunks, NEXT, FIRST_CHUNK and MENTIONS edges; a dry run only counts them."""
    from ..operators import chunks as C

    linked = C.link(chunks)
    parts = {"chunks": linked, "next": C.next_edges(linked), "first": C.first_chunk_edges(linked), "mentions": mentions.distinct()}
    if not dry_run:
        for name, df in parts.items():
            create(df, f"{prefix}_{name}", recreate=True)
    return {name: df.count() for name, df in parts.items()}


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
