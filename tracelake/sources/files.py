"""Readers and sinks for files: evaluation corpora, JSON lines, project files and append-once tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schema of a long-memory evaluation set: three parallel arrays per question.
QUESTIONS = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question_type, question, answer, position, session_id, date, turns): one row per session of a
    question; the parallel arrays are zipped, missing session ids are named by their position, shorter arrays give nulls."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", "true").json(path)
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    rows = rows.select("question_id", "question_type", "question", "answer", F.posexplode(zipped).alias("position", "s"))
    name = F.coalesce(F.when(F.col("s.id") != "", F.col("s.id")), F.concat(F.lit("session_"), F.col("position").cast("string")))
    return rows.select("question_id", "question_type", "question", "answer", "position", name.alias("session_id"), F.col("s.date").alias("date"), F.col("s.turns").alias("turns"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; broken lines come out as nulls with their text in ``_corrupt``."""
    names = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
    return spark.read.schema(f"{names}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_replace("path", "^.*?" + folder.strip("/").replace(".", r"\.") + "/", "").alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def append_once(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at ``path`` does not hold yet, each key once; the number of rows that were new.

    A repeated call with the same rows appends nothing.
    """
    spark = rows.sparkSession
    fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    try:
        known = spark.read.schema(rows.schema).parquet(path).select(key)
        fresh = fresh.join(known, key, "left_anti")
    except Exception as e:  # the table starts with the first call
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh = fresh.select(*rows.columns).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: a keyed store read from its append-only table."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns]).select(*rows.columns)
