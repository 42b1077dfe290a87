"""Sources and sinks: JSON lines, front matter, manifests, path parts, replace-by-key tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KNOWLEDGE = "id string, source string, answer string, problem_hint string, content string, equations array<string>"
MANIFEST = "struct<items:array<struct<questionNo:string,pageLabel:string,file:string,diagramFiles:array<string>>>>"


def read_json_lines(spark: SparkSession, path: str, schema: str = KNOWLEDGE) -> DataFrame:
    """Blank lines are skipped; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(rows: DataFrame, path: str, least: int = 30) -> None:
    """Rows with enough content, with short ids where they have none."""
    kept = rows.where(F.length("content") >= least)
    kept.withColumn("id", F.coalesce("id", F.substring(F.sha1("content"), 1, 12))).write.mode("overwrite").json(path)


def read_markdown(spark: SparkSession, path: str, least: int = 10, names: str = "*.md") -> DataFrame:
    """(name, meta, body) of Markdown files with front matter; hidden files, README.md and short bodies are left out."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=names)
    named = raw.select(F.col("_metadata.file_name").alias("name"), F.regexp_replace("value", "\r\n", "\n").alias("value")).where("NOT startswith(name, '.') AND name <> 'README.md'")
    return named.select("name", front_matter(F.col("value")).alias("meta"), body(F.col("value")).alias("body")).where(F.length("body") >= least)


def front_matter(text: Column) -> Column:
    """The key: value lines of the leading --- block as a map; an empty map without one."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*\w+\s*:"))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.lit(0), F.size(pairs) - i - 1)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", ""), r"\A\s+|\s+\z", "")


def manifest_items(manifests: DataFrame, json: str) -> DataFrame:
    """Items of manifests, without those that lack a question or a file; empty diagram lists become null."""
    item = F.inline(F.from_json(json, MANIFEST)["items"])
    rows = manifests.select(item).where("trim(questionNo) <> '' AND trim(file) <> ''")
    diagrams = F.filter("diagramFiles", lambda x: F.trim(x) != "")
    return rows.select(F.trim("questionNo").alias("question"), F.trim("file").alias("file"), F.when(F.size(diagrams) > 0, diagrams).alias("diagrams"))


def path_levels(path: Column, defaults: tuple[str, ...]) -> list[Column]:
    """The leading folders of a path, with a default for each that is missing."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return [F.coalesce(F.get(folders, F.lit(i)), F.lit(d)) for i, d in enumerate(defaults)]


def replace_by_key(rows: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys in rows, all others stay: dynamic partition overwrite."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_pages(rows: DataFrame, path: str, keys: list[str], meta: list[str], text: str) -> None:
    """A file with front matter for each row, in folders by keys, which are unique.

    Tasks write beside the folders, and once all pages are written, tasks move them into place, each page as a whole; a run
    that is repeated replaces the files of its keys and leaves the others.  Stores that pyarrow does not know are left to
    Spark's writer, whose driver moves the files one by one.
    """
    lines = [F.concat(F.lit(f"{m}: "), F.regexp_replace(F.coalesce(F.col(m).cast("string"), F.lit("")), r"\s+", " ")) for m in meta]
    value = F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.coalesce(F.col(text), F.lit("")))
    pages, tasks = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], value.alias("value")), rows.sparkSession.sparkContext.defaultParallelism
    try:
        store, root = FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        pages.repartition(tasks, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).text(path)
        return
    aside = f".pages-{uuid.uuid4().hex}"  # readers pass over it

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, serial = f"{root}/{aside}/{TaskContext.get().taskAttemptId()}", 0
        store.create_dir(own, recursive=True)
        for b in batches:
            names = []
            for content in b.column("value").cast(pa.large_binary()).to_pylist():
                names.append(f"{own}/{serial}")
                serial += 1
                with store.open_output_stream(names[-1]) as f:
                    f.write(content + b"\n")
            folders = ["/".join(map(partition_folder, keys, k)) for k in zip(*[b.column(k).to_pylist() for k in keys], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), pa.array(names, pa.string())], names=["folder", "file"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, file in zip(*[c.to_pylist() for c in b.columns], strict=True):
                place = f"{root}/{folder}"
                store.create_dir(place, recursive=True)
                if store.get_file_info(file).type != FileType.NotFound:  # else an earlier try of this task has moved it
                    store.move(file, f"{place}/part-0.txt")
                for old in store.get_file_info(FileSelector(place)):
                    if old.type == FileType.File and old.base_name != "part-0.txt":
                        store.delete_file(old.path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    try:
        pages.repartition(tasks, *keys).mapInArrow(stage, "folder string, file string").write.parquet(f"{path}/{aside}/moves")
        moves = rows.sparkSession.read.schema("folder string, file string").parquet(f"{path}/{aside}/moves")
        moves.repartition(tasks, "folder").mapInArrow(move, "n long").agg(F.sum("n")).collect()
    finally:
        if store.get_file_info(f"{root}/{aside}").type != FileType.NotFound:
            store.delete_dir(f"{root}/{aside}")


def partition_folder(key: str, value: str | None) -> str:
    """The folder of a key's value, named as Spark names it."""
    name = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value or "")
    return f"{key}={name or '__HIVE_DEFAULT_PARTITION__'}"


def write_manifests(rows: DataFrame, path: str, key: str, order: str, columns: list[str]) -> None:
    """A JSON file for each key: total, and its rows' columns as items in their order; written after what it lists."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("i")))), lambda x: x["i"])
    listed = rows.groupBy(key).agg(F.to_json(F.struct(F.first(key).alias("key"), F.count("*").alias("total"), items.alias("items"))).alias("value"))
    listed.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def read_manifests(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(key, total, items) of manifests; item is the DDL of an item."""
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in item.split(","))
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(F.from_json("value", f"struct<key:string,total:bigint,items:array<struct<{fields}>>>").alias("m")).select("m.*")


def listing(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(folder, name, modified, bytes) of all files under a path, newest first, without reading them; no page limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    if extensions:
        rows = rows.where(F.lower(F.substring_index("name", ".", -1)).isin(*[e.lower().lstrip(".") for e in extensions]))
    return rows.orderBy(F.desc("modified"), "folder", "name")


def fetched(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, content) of the files of that name under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path).select("path", "content")


# Names of question files and of the merged file, and what the latter is called
QUESTION_FILE, MERGED_FILE, MERGED = r"(?i)^문항(\d{1,2})_API초안\.md$", "합본_편집용.md", "합본"


def read_drafts(spark: SparkSession, path: str, question: str = QUESTION_FILE, merged: str = MERGED_FILE) -> DataFrame:
    """(exam, question, body, file) of Markdown drafts in folders by exam; other names and empty files are left out."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[mM][dD]")
    name = F.col("_metadata.file_name")
    rows = raw.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("exam"), name.alias("file"), F.regexp_replace("value", r"\A\s+|\s+\z", "").alias("body"))
    rows = rows.withColumns({"exam": F.url_decode("exam"), "file": F.url_decode("file")})
    number = F.nullif(F.regexp_extract("file", question, 1), F.lit("")).cast("int").cast("string")
    return rows.withColumn("question", F.when(F.col("file") == merged, MERGED).otherwise(number)).where("question IS NOT NULL AND body <> ''").select("exam", "question", "body", "file")
