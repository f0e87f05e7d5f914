"""Uploaded files, labelled documents and map extracts as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPAN_SCHEMA = "array<struct<start:int,end:int,text:string,label:string>>"
OSM_SCHEMA = "elements array<struct<type:string,id:bigint,tags:map<string,string>>>"


# Spark reads ISO-8859-1, which leaves 0x80-0x9f as control characters; Windows-1252, the
# encoding of older spreadsheet exports, has letters and signs there.
_UPPER = bytes(range(0x80, 0xA0))
_AS_LATIN = _UPPER.decode("iso-8859-1")
_AS_WINDOWS = _UPPER.decode("cp1252", errors="replace")


def _is_utf8(spark: SparkSession, path: str) -> bool:
    lines = spark.read.text(path)
    return lines.where(~F.is_valid_utf8("value")).limit(1).count() == 0


def _strip_bom(name: str) -> str:
    return name.lstrip("\ufeff").strip()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with trimmed header names; a byte-order mark is tolerated."""
    utf8 = _is_utf8(spark, path)
    df = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("encoding", "UTF-8" if utf8 else "ISO-8859-1")
        .csv(path)
    )
    if utf8:
        return df.toDF(*[_strip_bom(c) for c in df.columns])
    names = [_strip_bom(c.translate(str.maketrans(_AS_LATIN, _AS_WINDOWS))) for c in df.columns]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(
        *[F.translate(f"c{i}", _AS_LATIN, _AS_WINDOWS).alias(n) for i, n in enumerate(names)]
    )


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    return read_csv(spark, path).columns


def widest_column(df: DataFrame) -> str | None:
    """The column with most characters over all rows; the leftmost wins ties."""
    if not df.columns:
        return None
    widths = width_table(df)
    best = widths.orderBy(F.desc("chars"), "ordinal").select("column").head()
    return best["column"] if best else df.columns[0]


def width_table(df: DataFrame) -> DataFrame:
    """Characters per column, one row per column in order."""
    sums = [
        F.coalesce(F.sum(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(f"c{i}")
        for i, c in enumerate(df.columns)
    ]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"c{i}").alias("chars")
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return df.agg(*sums).select(F.explode(cells).alias("x")).select("x.*")


def read_rows(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """One trimmed, non-blank text per row as (row_id, text), in file order.

    Row ids grow along the file; they are unique but, over many splits, not consecutive.
    """
    if path.lower().endswith(".csv"):
        df = read_csv(spark, path)
        if not df.columns:
            return spark.createDataFrame([], "row_id bigint, text string")
        chosen = column or df.columns[0]
        if chosen not in df.columns:
            raise ValueError(f"no column {chosen!r}; the file has {', '.join(df.columns)}")
        text = F.col(f"`{chosen}`")
    else:
        utf8 = _is_utf8(spark, path)
        df = spark.read.option("encoding", "UTF-8" if utf8 else "ISO-8859-1").csv(
            path, schema="value string", sep="\x01", quote=""
        )
        text = F.regexp_replace("value", "\\A\ufeff", "")
        text = text if utf8 else F.translate(text, _AS_LATIN, _AS_WINDOWS)
    clean = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    return (
        df.select(F.monotonically_increasing_id().alias("row_id"), clean.alias("text"))
        .where(F.col("text") != "")
    )


def labelled_documents(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Documents with their label spans parsed; only the named columns are read."""
    return spark.read.parquet(path).select(*columns, "spans").withColumn(
        "spans", parse_spans("spans")
    )


def parse_spans(spans: str):
    """Spans written as a Python list: single quotes, double where the text has one."""
    return F.from_json(F.col(spans), SPAN_SCHEMA, {"allowSingleQuotes": "true"})


def labelled_spans(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per label; the surface is always cut from the text itself."""
    return docs.select(*keys, text, F.explode("spans").alias("s")).select(
        *keys,
        F.col("s.label").alias("label"),
        F.substring(F.col(text), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias(
            "surface"
        ),
    )


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements of one extract or of every .json file in a folder."""
    return (
        spark.read.schema(OSM_SCHEMA)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("source", F.input_file_name())
        .select("source", F.posexplode("elements").alias("position", "e"))
        .select("source", "position", "e.*")
    )


def audit_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored audit trail (parquet); window predicates push down to the scan."""
    return spark.read.parquet(f"{path}/messages"), spark.read.parquet(f"{path}/findings")


def audit_jdbc(spark: SparkSession, url: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """The trail in a relational database; predicates push down to it."""
    def load(name: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()

    return load("messages_processed"), load("findings")
