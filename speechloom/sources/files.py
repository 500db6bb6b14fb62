"""File listings, metadata files, names of hosted datasets, providers for what only a network gives."""

from __future__ import annotations

import os
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.sources.json_ranges import json_records, numbered_lines, strict_rows  # noqa: F401

# Audio file name endings; fields of a record that may hold its address, in this order; parts of dataset addresses.
AUDIO_ENDINGS = ["wav", "mp3", "ogg", "flac", "m4a"]
URL_FIELDS = ["url", "audio_url", "link", "audio", "path"]
ADDRESS_PARTS = ["viewer", "tree", "blob", "resolve", "raw"]
AUDIO_COLUMNS = ["audio", "speech", "wav", "sound", "file", "path"]


def audio_files(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Audio files directly in a folder: the listing, sorted by name, or, with content, the files themselves in no order (so
    that their bytes are never shuffled; sort by file_name what is made of them)."""
    ending = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in AUDIO_ENDINGS)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ending.replace("|", ",") + "}").option("recursiveFileLookup", "false").load(folder)
    found = found.select("path", F.substring_index("path", "/", -1).alias("file_name"), "length", *(["content"] if content else []))
    return found if content else found.orderBy("file_name")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """strict: the first line that is no JSON ends the read; otherwise such lines are left out."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def parsed_lines(df: DataFrame, line: str, schema: str, strict: bool = False) -> DataFrame:
    """The same of lines in a column. strict: an error names the line (its text) that is no JSON."""
    row = F.from_json(line, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = df.select(F.col(line).alias("_line"), row.alias("_row"))
    if strict:
        rows = rows.withColumn("_row", F.when(F.col("_row._bad").isNull(), F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), "_line"))))
    return rows.where("_row._bad IS NULL").select("_row.*").drop("_bad")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def url_of(record: Column, first: str = "url") -> Column:
    """The address in a JSON object: the first of the fields that is there counts, even if it is blank."""
    keys = F.json_object_keys(record)
    out = None
    for field in dict.fromkeys([first, *URL_FIELDS]):
        value = F.get_json_object(record, f"$.{field}")
        out = F.when(F.array_contains(keys, field), value) if out is None else out.when(F.array_contains(keys, field), value)
    return out


def records_of(document: Column) -> Column:
    """The records of a JSON document, as an array of JSON texts: those of a list, else of an object's first member that is a
    list, else the object itself; null where it is neither."""
    root = F.trim(document)
    member = lambda k: F.call_function("get_json_object", root, F.concat(F.lit("$['"), k, F.lit("']")))
    lists = F.filter(F.transform(F.json_object_keys(root), member), lambda v: F.left(v, F.lit(1)) == "[")
    items = F.when(F.left(root, F.lit(1)) == "[", root).when(F.size(lists) > 0, F.get(lists, F.lit(0))).when(F.left(root, F.lit(1)) == "{", F.concat(F.lit("["), root, F.lit("]")))
    return F.from_json(items, "array<string>")


def read_url_lists(spark: SparkSession, path: str, first: str = "url") -> DataFrame:
    """(file, number, url, record) of JSON files that list records with addresses, read by byte range: the list is the root, or
    the first member of the root that is one; an object without a list is one record."""
    return json_records(spark, path, members=True).select("file", "number", url_of(F.col("record"), first).alias("url"), "record")


def inside(base: str, path: str) -> bool:
    """Whether a path, with links and dots resolved, is a folder or something in it."""
    base, path = (os.path.realpath(os.path.expanduser(p)) for p in (base, path))
    return os.path.commonpath([base, path]) == base


def human_size(size: Column) -> Column:
    """Bytes as KB with no digit, from a MB on as MB with one."""
    return F.when(size >= 1 << 20, F.format_string("%.1f MB", F.bround(size / float(1 << 20), 1))).otherwise(F.format_string("%.0f KB", F.bround(size / 1024.0, 0)))


def run_suffix(mode: str, at: str) -> str:
    """What a run adds to the names it writes: with mode new its time of day (HHMMSS), else nothing."""
    return f"_{at}" if mode == "new" else ""


def push_report(meta: DataFrame, files: DataFrame, key: str = "file_name", named: int = 3) -> DataFrame:
    """(kept, missing, first): rows whose file is there, rows without, and the first few of these by name."""
    have = files.select(F.col(key).alias("_have")).distinct()
    rows = meta.select(key).join(have, F.col(key) == F.col("_have"), "left")
    counts = rows.agg(F.count("_have").alias("kept"), F.count_if(F.col("_have").isNull()).alias("missing"))
    first = rows.where("_have IS NULL").select(key).orderBy(key).limit(named).agg(F.array_join(F.sort_array(F.collect_list(key)), ", ").alias("first"))
    both = counts.withColumn("first", F.lit(None).cast("string")).unionByName(first, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("kept", "missing", "first")])


def dataset_name(given: Column) -> Column:
    """org/name of a hosted dataset, from a name or any of its addresses."""
    t = F.regexp_replace(F.trim(given), r"^https?://[^/]+/(?:datasets/)?", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[?#].*$", ""), rf"/(?:{'|'.join(ADDRESS_PARTS)})(?:/.*)?$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^datasets/", ""), r"^/+|/+$", "")
    return F.regexp_extract(t, r"^([^/]+(?:/[^/]+)?)", 1)


def audio_column(df: DataFrame) -> str | None:
    """The column that holds audio: by name, else the first of a struct with bytes."""
    named = [c for want in AUDIO_COLUMNS for c in df.columns if c.lower() == want]
    structs = [f.name for f in df.schema.fields if "bytes" in getattr(f.dataType, "names", [])]
    return next(iter(named + structs), None)


def clean_path(given: Column) -> Column:
    """Without white space and quotes around it."""
    return F.regexp_replace(F.trim(given), r"^[\"'\s]+|[\"'\s]+$", "")


def stem(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")


def without_prefix(name: Column) -> Column:
    return F.regexp_replace(name, "^(augmented_|aug_)", "")


class Provider(Protocol):
    """What a network gives: called with a batch, returns as many answers."""

    def __call__(self, batch: list[str]) -> Iterable[str]: ...


def provided(df: DataFrame, column: str, to: str, provider: Provider) -> DataFrame:
    """Adds a provider's answers in Arrow batches, once a row: the result should be written before it is used twice."""
    from pyspark.sql import types as T

    def call(batches):
        for pdf in batches:
            pdf[to] = list(provider(pdf[column].fillna("").tolist()))
            yield pdf

    return df.mapInPandas(call, T.StructType([*df.schema.fields, T.StructField(to, T.StringType())]))


def fetched(df: DataFrame, url: str, target: str, have: DataFrame, provider: Provider) -> DataFrame:
    """Rows of distinct targets that aren't there yet, with what the provider says of each address (column fetched). have: a
    listing (file_name) of what is there; a run that is repeated therefore asks only for what it still lacks."""
    name = F.substring_index(F.col(target), "/", -1)
    there = have.select(F.col("file_name").alias("_have")).distinct()
    wanted = df.where(F.col(url).isNotNull()).dropDuplicates([target]).join(there, name == F.col("_have"), "left_anti")
    return provided(wanted, url, "fetched", provider)


def write_jsonl(df: DataFrame, path: str, columns: list[str], append: bool = True) -> None:
    """Rows that sinks write, these columns, null as an empty text."""
    from speechloom.operators.ladders import exportable

    kept = df.where(exportable(F.col("status"), F.col("transcription"))).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    kept.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> bool:
    """Overwrites; nothing is written, and False returned, where no row is left."""
    from speechloom.operators.ladders import exportable

    kept = df.where(exportable(F.col("status"), F.col("transcription"))).select(*columns)
    if not kept.limit(1).count():
        return False
    kept.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def json_lines(df: DataFrame, columns: list[str], to: str = "line") -> DataFrame:
    """Each row as one JSON object of these columns, without null fields."""
    return df.select(F.to_json(F.struct(*[c for c in columns if c in df.columns]), {"ignoreNullFields": "true"}).alias(to))


def write_sharded(df: DataFrame, path: str, rows: int) -> None:
    """Parquet files of at most so many rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_sidecar(spark: SparkSession, path: str, folder: str) -> None:
    """Notes beside a metadata file where its audio is."""
    spark.createDataFrame([(folder,)], "value string").coalesce(1).write.mode("overwrite").text(path + ".audiodir")


def read_sidecar(spark: SparkSession, path: str) -> str | None:
    """The folder noted there; None without a note."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path + ".audiodir").first()
    except AnalysisException:
        return None
    return row and row.value.strip()


def write_reviewed(df: DataFrame, stem: str) -> str:
    """The rows a review keeps, as JSON lines in {stem}_reviewed; gives that path."""
    from speechloom.operators.review import saved

    saved(df).write.mode("overwrite").json(path := f"{stem}_reviewed")
    return path


def file_plan(df: DataFrame, target: str) -> DataFrame:
    """What to do with each row's audio: copied below target if the row is exported, else deleted."""
    from speechloom.operators.ladders import exportable

    keep = exportable(F.col("status"), F.col("transcription"))
    return df.select("file_name", F.when(keep, "copy").otherwise("delete").alias("action"), F.when(keep, F.concat(F.lit(target + "/"), "file_name")).alias("target"))


def log_result(lines: DataFrame, mark: str = "RESULT_JSON:") -> DataFrame:
    """The JSON of the last marked line of a log. lines: seq, line."""
    found = lines.where(F.col("line").contains(mark)).select("seq", F.trim(F.substring_index("line", mark, -1)).alias("json"))
    return found.agg(F.max_by("json", "seq").alias("json"))
