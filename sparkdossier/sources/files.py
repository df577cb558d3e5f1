"""Files that the service reads and writes: access logs, separated values, case folders, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCESS_LOG = "t timestamp, klient_id string, sti string, kode int"


def read_access_log(spark: SparkSession, paths: str | list[str], since: str | None = None) -> DataFrame:
    """Rows of JSON lines, active file and archives alike; lines that are no JSON, or without a time, are left out."""
    rows = spark.read.schema(ACCESS_LOG + ", _feil string").option("columnNameOfCorruptRecord", "_feil").json(paths)
    rows = rows.where("_feil is null and t is not null").drop("_feil")
    return rows.where(F.col("t") >= F.lit(since).cast("timestamp")) if since else rows


def read_separated(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A CSV file whose separator (semicolon, comma or tab) and encoding (UTF-8, else Windows-1252) its first lines tell.

    All columns are strings. ``most`` keeps the first rows, a limit of the feature, not of the data.
    """
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1 << 16).alias("c"), (F.length("content") > 1 << 16).alias("cut")).first()
    raw = bytes(head.c)
    try:
        text, encoding = raw.decode("utf-8-sig"), "UTF-8"
    except UnicodeDecodeError as e:
        cut = head.cut and e.start > len(raw) - 4  # the sample ends within a character
        text, encoding = (raw[: e.start].decode("utf-8-sig"), "UTF-8") if cut else (raw.decode("cp1252", "replace"), "ISO-8859-1")
    line = text.split("\n", 1)[0]
    separator = max((";", ",", "\t"), key=line.count)
    rows = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).csv(path)
    if encoding == "ISO-8859-1":  # the same but for 32 signs that are control characters there
        signs = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(128, 160)}
        old, new = ("".join(x) for x in zip(*((a, b) for a, b in signs.items() if b), strict=True))
        rows = rows.select(*[F.translate(F.col(f"`{c}`"), old, new).alias(c.translate(str.maketrans(old, new))) for c in rows.columns])
    return rows.limit(most) if most else rows


def save_cases(rows: DataFrame, path: str) -> None:
    """Writes cases, one folder for each ``sak``; folders of cases that are not among ``rows`` stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sak").parquet(path)


def load_case(spark: SparkSession, path: str, case: str) -> DataFrame:
    """Rows of one case; only its folder is read."""
    return spark.read.parquet(path).where(F.col("sak") == case)


def append_export(new: DataFrame, path: str) -> int:
    """Appends rows to an export and counts what it now holds of them, read back."""
    new.write.mode("append").parquet(path)
    return new.sparkSession.read.parquet(path).join(new.select("oppgave_id").distinct(), "oppgave_id", "left_semi").count()
