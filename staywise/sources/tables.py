"""Reading tables with a checked schema, by file, catalog name, JDBC or SQL text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Columns and types of the source tables of the care-episode data model.
SCHEMAS = {
    "transfers": "subject_id long, hadm_id long, icustay_id long, eventtype string, prev_careunit string, "
    "curr_careunit string, prev_wardid int, curr_wardid int, intime timestamp, outtime timestamp, los double",
    "icustays": "subject_id long, hadm_id long, icustay_id long, first_careunit string, last_careunit string, "
    "outtime timestamp, los double",
    "admissions": "subject_id long, hadm_id long, admittime timestamp, dischtime timestamp, ethnicity string, "
    "marital_status string, insurance string, language string",
    "patients": "subject_id long, dob timestamp",
    "services": "subject_id long, hadm_id long, transfertime timestamp, curr_service string",
    "labevents": "subject_id long, hadm_id long, itemid int, charttime timestamp, value string, flag string",
    "d_labitems": "itemid int, label string, fluid string",
    "procedures_icd": "subject_id long, hadm_id long, seq_num int, icd9_code string",
    "drgcodes": "subject_id long, hadm_id long, drg_type string, drg_code string, description string",
}


def source_schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select and cast to ``schema``; a missing column is an error, extra ones are pruned.

    Zoneless timestamps stay zoneless.
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = []
    for field in schema:
        want = field.dataType.simpleString()
        same = have[field.name] == want or {have[field.name], want} == {"timestamp", "timestamp_ntz"}
        out.append(F.col(field.name) if same else F.col(field.name).cast(field.dataType))
    return df.select(*out)


def read_source(
    spark: SparkSession, table: str, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """One source table from files of any Spark format (csv, parquet, orc, json)."""
    reader = spark.read.format(fmt).options(**options)
    schema = source_schema(table)
    if fmt == "csv":
        # columns are matched by header name, not by position
        reader = reader.option("header", "true")
    elif fmt == "json":
        reader = reader.schema(schema)
    return conform(reader.load(path), schema)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """A table or ``(query) alias`` of a live database; give a numeric column to read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load()


def register_views(spark: SparkSession, frames: Mapping[str, DataFrame]) -> None:
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def sql_frame(spark: SparkSession, text: str, columns: Sequence[str], **views: DataFrame) -> DataFrame:
    """Result of a SQL text under new column names (S2); ``views`` are passed as ``{name}``."""
    return spark.sql(text, **views).toDF(*columns)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a stated order (S3)."""
    return df.orderBy(*order).limit(n)
