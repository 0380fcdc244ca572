"""Reading raw inputs and writing models.

Raw inputs are read with their declared schema (no inference pass); models
are either registered as temporary views (lazy, like the reference's view
models) or rebuilt as versioned Parquet tables (like its table models).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from funnelworks.sources import schemas
from funnelworks.sources.fixtures import RawSources
from funnelworks.sources.versions import Store, current_path


def read_raw_sources(spark: SparkSession, base_path: str, fmt: str = "parquet") -> RawSources:
    """Read ``<base_path>/<table>`` for the four raw tables with fixed schemas."""

    def read(name: str) -> DataFrame:
        return spark.read.schema(schemas.RAW_SCHEMAS[name]).format(fmt).load(f"{base_path}/{name}")

    return RawSources(
        read("leads"),
        read("opportunities"),
        read("expenses_advertising"),
        read("expenses_salary_and_commissions"),
    )


def raw_sources_from_tables(spark: SparkSession, database: str, names: dict[str, str] | None = None) -> RawSources:
    """The four raw tables from the session catalog: ``<database>.<table>``,
    or the table that ``names`` gives for one of them.  Columns are selected
    by the fixed schemas, so other columns of the tables are not read."""

    def read(name: str) -> DataFrame:
        df = spark.table((names or {}).get(name, f"{database}.{name}"))
        own = {f.name: f.dataType for f in df.schema.fields}
        # a column of the right type stays as it is, and with it the table's buckets
        return df.select(
            *[f.name if own.get(f.name) == f.dataType else df[f.name].cast(f.dataType).alias(f.name) for f in schemas.RAW_SCHEMAS[name].fields]
        )

    return RawSources(*[read(name) for name in schemas.RAW_SCHEMAS])


def write_raw_sources(raw: RawSources, base_path: str, fmt: str = "parquet") -> None:
    names = ["leads", "opportunities", "expenses_advertising", "expenses_salary_and_commissions"]
    for name, df in zip(names, raw):
        df.write.mode("overwrite").format(fmt).save(f"{base_path}/{name}")


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store a raw table in the catalog, dealt by a hash of ``key`` into
    ``buckets`` files that are sorted by it, and return it.

    Whatever groups or joins the table by ``key`` later reads the buckets as
    they lie: opportunities stored so are neither shuffled for their dedupe nor
    for the join with the leads.  Choose the number such that a bucket fits a
    task (some 100 MB), and a key that is unique or nearly so; rows of a null
    or frequent key would share a bucket.
    """
    w = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (w.option("path", path) if path else w).saveAsTable(name)
    return df.sparkSession.table(name)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Register a model as a temporary view (nothing is computed)."""
    df.createOrReplaceTempView(name)
    return df


def write_table(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    fmt: str = "parquet",
) -> str:
    """Full rebuild of a table model as a new version under ``path``, published
    by one commit (:mod:`funnelworks.sources.versions`): a writer that fails or
    stops at any point leaves the old table readable.  Returns the version's
    folder; :func:`read_table` finds the current one."""
    with Store(df.sparkSession, path).begin() as pending:
        return pending.write(df, "", partition_by, fmt)


def save_table(df: DataFrame, name: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Full rebuild of a catalog table: a new version beside the old one, under
    the database's folder, and ``name`` as a view of it.

    Replacing the view is one change of the catalog, also when columns change,
    so the name always stands for a whole table.  A table of that name, saved
    by something else, is dropped the first time.
    """
    spark = df.sparkSession
    database, _, table = name.rpartition(".")
    database = database or spark.catalog.currentDatabase()
    store = Store(spark, f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{table}.versions")
    pending = store.begin()
    try:
        path = pending.write(df, "", partition_by, fmt)
    except Exception:
        pending.abandon()
        raise
    show_table(spark, name, path, fmt)
    pending.commit()


def show_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> str:
    """Let the catalog name stand for the files of one version; returns the name."""
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {fmt}.`{path}`")
    return name


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The current version of the table at ``path``."""
    return spark.read.format(fmt).load(current_path(spark, path))
