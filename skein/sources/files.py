"""Readers and writers of text, JSON, key-value and annotated article files, and a store of graphs by run.

Paths go to Spark's readers and writers only, so they may be in any store; ``.gz`` is read and written by its suffix.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SEPARATOR = "~|~"
TOKEN = "struct<index:int,word:string,after:string,ner:string,timex:struct<value:string>>"
#: Members of ``parts`` stay JSON text until they are needed, as some are no objects.
ARTICLE = "struct<title:string,description:string,text:string,maintext:string,fiveWoneH:map<string,struct<extracted:array<struct<parts:array<array<string>>>>>>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line``, stripped of white space at both ends."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row for each file that is one JSON document."""
    return (spark.read if schema is None else spark.read.schema(schema)).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row a line; give the schema to spare the pass that infers it."""
    return (spark.read if schema is None else spark.read.schema(schema)).json(path)


def read_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """``key, value`` of files that hold one JSON object each."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def key_values(line: Column, separator: str = SEPARATOR) -> list[Column]:
    """``key, value`` of lines with exactly one separator; any other line is an error."""
    parts = F.split(line, f"\\Q{separator}\\E", -1)
    bad = F.raise_error(F.concat(F.lit("not one separator in: "), line)).cast("string")
    part = lambda i, name: F.when(F.size(parts) == 2, F.trim(parts[i])).otherwise(bad).alias(name)
    return [part(0, "key"), part(1, "value")]


def read_key_values(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    return spark.read.text(path).select(*key_values(F.col("value"), separator))


def part_ranges(pairs: DataFrame) -> DataFrame:
    """``part_id, st, en`` from keys and values such as ``(0, 250)``."""
    end = lambda i: F.regexp_extract("value", r"\(\s*(\d+)\s*,\s*(\d+)\s*\)", i).cast("long")
    return pairs.select(F.col("key").cast("int").alias("part_id"), end(1).alias("st"), end(2).alias("en"))


def read_part_ranges(spark: SparkSession, path: str) -> DataFrame:
    return part_ranges(read_key_values(spark, path))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, values``: rows of a dense matrix, kept as Parquet."""
    return spark.read.parquet(path).select("doc_id", F.col("values").cast("array<double>").alias("values"))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, term, weight``: entries of a sparse matrix, kept as Parquet."""
    return spark.read.parquet(path).select("doc_id", "term", "weight")


def load_config(spark: SparkSession, path: str, kind: type):
    """An instance of the dataclass ``kind`` from a JSON object; keys it doesn't have are left out."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    names = {f.name for f in dataclasses.fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in names})


def articles_of(texts: DataFrame, key: str, body: str) -> DataFrame:
    """``doc_id, title, description, text, answers`` from the JSON of annotated articles.

    A missing or empty text is replaced by the main text; what is null then is ''. ``answers`` maps a question to its first
    candidate's parts; a question without candidates is absent.
    """
    a = F.from_json(body, ARTICLE)
    blank = lambda c: F.when(c != "", c)
    asked = F.map_filter(a["fiveWoneH"], lambda _, v: F.coalesce(F.size(v["extracted"]) > 0, F.lit(False)))
    return texts.select(
        F.col(key).alias("doc_id"),
        F.coalesce(a["title"], F.lit("")).alias("title"),
        F.coalesce(a["description"], F.lit("")).alias("description"),
        F.coalesce(blank(a["text"]), a["maintext"], F.lit("")).alias("text"),
        F.transform_values(F.coalesce(asked, F.create_map().cast("map<string,struct<extracted:array<struct<parts:array<array<string>>>>>>")), lambda _, v: v["extracted"][0]["parts"]).alias("answers"),
    )


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Annotated articles, one JSON file each, named by their ids."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("doc_id"), "value")
    return articles_of(whole, "doc_id", "value")


def _mode(mode: str) -> str:
    return {"w": "overwrite", "a": "append"}.get(mode, mode)


def write_lines(df: DataFrame, path: str, column: str = "line", mode: str = "w") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(_mode(mode)).text(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "w", compress: bool = False) -> None:
    df.write.mode(_mode(mode)).option("compression", "gzip" if compress else "none").json(path)


def write_map(df: DataFrame, path: str, key: str = "key", value: str = "value", mode: str = "w", compress: bool = True) -> None:
    """Keys and values as JSON objects of one key each; ``read_map`` reads them one object a line as well."""
    rows = df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(value))).alias("value"))
    rows.write.mode(_mode(mode)).option("compression", "gzip" if compress else "none").text(path)


def read_map_lines(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """``key, value`` of files with an object a line, as ``write_map`` leaves them in parallel."""
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,{value}>")))


def write_key_values(df: DataFrame, path: str, key: str = "key", value: str = "value", separator: str = SEPARATOR, mode: str = "w") -> None:
    df.select(F.concat(F.col(key).cast("string"), F.lit(separator), F.col(value).cast("string")).alias("value")).write.mode(_mode(mode)).text(path)


def write_matrix(df: DataFrame, path: str, mode: str = "w") -> None:
    """Dense rows or sparse entries as Parquet."""
    df.write.mode(_mode(mode)).parquet(path)


def write_threads(threads: DataFrame, path: str, run: str, mode: str = "w") -> None:
    """Threads with their similarity under the run's name; other runs stay."""
    threads.write.mode(_mode(mode)).parquet(f"{path}/run={run}")


def append_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    """One more record in a log of JSON lines; to overwrite, give each record a folder of its own."""
    metrics.write.mode(mode).json(path)


def stored(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """The table at ``path``, built by ``build()`` and written there if it isn't there or ``force`` is set."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
