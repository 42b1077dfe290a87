"""Containers and tables that are written and read back: archives in archives, versions of a table, files by key."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators.positions import checkpoint_folder
from ..sources import archives, files
from ..sources.versions import VersionedTable
from .registry import query


def _folder(read, name: str) -> str:
    """A folder of this run that driver and executors share."""
    checkpoint_folder(read.spark)
    return f"{read.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    """Pages of an archive: pictures at three depths, notes beside them, and a manifest in every second archive."""
    pages = sorted(zip(group["page_id"].tolist(), group["html"].tolist(), strict=True))
    place = {0: [], 1: [], 2: []}
    for page, html in pages:
        place[page % 3].append((f"d/p{page}.png" if page % 5 else f"note{page}.txt", (html or "").encode()))
    inner = archives.zipped([*place[1], ("deep.ZIP", archives.zipped(place[2]))])
    number = int(group["archive"].iloc[0])
    named = "{\"items\":[" + ",".join(f'{{"questionNo":"{p}","file":" p{p}.png "}}' for p, _ in pages if p % 2 == 0) + "]}"
    manifest = [("manifest.json", named.encode())] if number % 2 else []
    return pd.DataFrame({"path": [f"a{number}.zip"], "content": [archives.zipped([*place[0], ("in/b.zip", inner), *manifest])]})


@query("""SELECT concat('a', page_id // 16, '.zip', CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '>in/b.zip' ELSE '>in/b.zip>deep.ZIP' END, '::d/p', page_id, '.png') AS label, '.png' AS ext, CAST(page_id % 3 AS INTEGER) AS depth,
CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages WHERE page_id % 5 <> 0 AND (page_id // 16 % 2 = 0 OR page_id % 3 > 0 OR page_id % 2 = 0 OR (SELECT count(*) FROM pages q WHERE q.page_id // 16 = pages.page_id // 16 AND q.page_id % 2 = 0) = 0)""")
def nested_members(read):
    """Pages as pictures in archives within archives, read back with their depth."""
    rows = read("pages").select("page_id", "html", F.expr("page_id div 16").alias("archive"))
    packed = rows.groupBy("archive").applyInPandas(_packed, "path string, content binary")
    return archives.read_archives(packed).where("status = 'ok'").select("label", "ext", "depth", "bytes", F.sha1("content").alias("digest"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 10 = 3 THEN 'fixed' ELSE event_type END AS kind, CASE WHEN event_id % 10 = 3 THEN value * 2 ELSE value END AS value FROM events
UNION ALL SELECT -event_id, 'added', value FROM events WHERE event_id % 50 = 7""")
def versioned_updates(read):
    """A table after an append, a second append, an update by id of old and new rows, and the same update again."""
    events = read("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    table = VersionedTable(read.spark, _folder(read, "versions"), "id", "id bigint, kind string, value double")
    table.append(events.where("id % 2 = 0"), "first")
    table.append(events.where("id % 2 <> 0"), "second")
    table.append(events.where("id % 2 <> 0"), "second")  # a job that ran twice
    fixed = events.where("id % 10 = 3").select("id", F.lit("fixed").alias("kind"), (F.col("value") * 2).alias("value"))
    added = events.where("id % 50 = 7").select((-F.col("id")).alias("id"), F.lit("added").alias("kind"), "value")
    for _ in range(2):
        table.update(fixed.union(added), "corrections")
    return table.read()


@query("""SELECT concat('b', page_id % 5) AS book, CAST(page_id AS VARCHAR) AS page, CASE WHEN strlen(coalesce(html, '')) > 10000 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN strlen(coalesce(html, '')) > 10000 THEN NULL ELSE sha1(regexp_replace(substr(html, 1, 500), '^\\s+|\\s+\\z', '', 'g')) END AS digest,
CASE WHEN strlen(coalesce(html, '')) > 10000 THEN NULL ELSE url END AS url, count(*) OVER (PARTITION BY page_id % 5) AS total FROM pages""")
def written_pages(read):
    """Pages as a file each with front matter, and a manifest of each book's statuses, both read back."""
    folder = _folder(read, "books")
    rows = read("pages").select(F.format_string("b%d", F.col("page_id") % 5).alias("book"), F.col("page_id").cast("string").alias("page"), "url", F.substring("html", 1, 500).alias("text"), F.when(F.octet_length(F.coalesce("html", F.lit(""))) > 10_000, "failed").otherwise("ok").alias("status"))
    for _ in range(2):  # a run that is repeated replaces its files
        files.write_pages(rows.where("status = 'ok'"), f"{folder}/pages", ["book", "page"], ["book", "page", "url"], "text")
    files.write_manifests(rows, f"{folder}/manifests", "book", "page", ["page", "status"])
    listed = files.read_manifests(read.spark, f"{folder}/manifests", "page string, status string").select(F.col("key").alias("book"), "total", F.inline("items"))
    found = files.read_markdown(read.spark, f"{folder}/pages", least=0, names="*.txt").select(F.col("meta")["book"].alias("book"), F.col("meta")["page"].alias("page"), F.col("meta")["url"].alias("url"), F.sha1("body").alias("digest"))
    return listed.join(found, ["book", "page"], "left").select("book", "page", "status", "digest", "url", "total")

