"""Files in, tables out, and back: JSON entities, whole texts, binary payloads, containers' manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION = "id string, title string, level int, parent string, pageRange array<int>, pdfPages array<int>, sourceText string"
NOTEBOOK = "glossary array<struct<id:string,term:string,kind:string,zh:string>>, sentences array<struct<page:int,sectionId:string,en:string,zh:string>>, excerpts array<string>, savedAt string"
LIBRARY = "id string, title string, pdf string, pdfPages int, sections int, addedAt string"
PAYLOAD_MOST, TOTAL_MOST, UPLOAD_MOST = 64 << 20, 256 << 20, 200 << 20
PDF_MAGIC = "%PDF-"


def json_entities(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file; what doesn't parse is a row of nulls. A folder without such files gives an empty table."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)


def sections(spark: SparkSession, json_path: str, text_path: str | None = None) -> DataFrame:
    """Section files, their text taken from <id>.txt beside them where the file has none."""
    rows = json_entities(spark, json_path, SECTION)
    if not text_path:
        return rows
    texts = spark.read.text(text_path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("id"), F.col("value").alias("_text"))
    return rows.join(texts, "id", "left").withColumn("sourceText", F.coalesce("sourceText", "_text")).drop("_text")


def notebook(rows: DataFrame) -> DataFrame:
    """Absent lists are empty ones."""
    fill = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select(*[fill(c) if rows.schema[c].dataType.typeName() == "array" else c for c in rows.columns])


def uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content, status: ok, or why a file is turned away. The binary source gives no row for a file without bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    status = F.when(F.col("length") > UPLOAD_MOST, "large").when(~F.lower("path").rlike(r"\.(pdf|ano)$"), "extension").when(~F.contains(head, F.lit(PDF_MAGIC)), "magic").otherwise("ok")
    return files.select("path", "length", "content", status.alias("status"))


def manifest(payloads: DataFrame, owner: str, name: str, content: Column) -> DataFrame:
    """owner, name, bytes, sha256 of every payload."""
    return payloads.select(owner, name, F.octet_length(content).alias("bytes"), F.sha2(content.cast("binary"), 256).alias("sha256"))


def within_caps(payloads: DataFrame, owner: str, order: str, size: Column, each: int = PAYLOAD_MOST, total: int = TOTAL_MOST) -> DataFrame:
    """Payloads that are small enough on their own and, in order, together."""
    w = Window.partitionBy(owner).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return payloads.where(size <= each).withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= total).drop("_sum")


def write_entities(rows: DataFrame, path: str, key: str) -> None:
    """Last write wins per key: only the partitions of rows' keys are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def versioned(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new beside what was there before: version 0 is current, 1 the one before; older ones go."""
    return new.withColumn("version", F.lit(0)).unionByName(base.where("version = 0").join(new.select(*keys).distinct(), keys, "left_semi").withColumn("version", F.lit(1))).unionByName(
        base.join(new.select(*keys).distinct(), keys, "left_anti"),
    )
