"""Scans of files that really lie on a disk: the documents, written by the tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixtures as fx
from queries.fixtures import sql
from queries.registry import query
from shelfmark import JobConfig, Organizer
from shelfmark.functions import paths
from shelfmark.sources import hashing
from shelfmark.sources.scan import list_files, scan_tree


@query("scan_files", sql(
    """select rel as path, size_bytes, false as is_symlink, false as failed from written
       union all select 'links/l' || doc_id, size_bytes, true, false from written where doc_id % 97 = 0""", "written"))
def scan_files(spark, sf):
    root, _ = fx.written_files(spark, sf)
    return list_files(spark, root).select(
        paths.relative(F.col("path"), root).alias("path"), "size_bytes", "is_symlink", F.col("error").isNotNull().alias("failed"))


@query("scan_directories", sql(
    """select distinct array_to_string(list_slice(string_split(rel, '/'), 1, n), '/') as path
       from (select rel, unnest(range(1, len(string_split(rel, '/')))) as n from written)
       union select 'links' from written where doc_id % 97 = 0""", "written"))
def scan_directories(spark, sf):
    """A task opens a few directories and leaves the others to the next round."""
    root, _ = fx.written_files(spark, sf)
    entries = scan_tree(spark, root, budget=5)
    return entries.where("kind = 'directory'").select(paths.relative(F.col("path"), root).alias("path"))


_SHARED = "count(*) over (partition by size_bytes) > 1"


@query("hash_prefilter", sql(
    f"""select rel as path, case when shared then sha256(text) end as hash, shared as was_read, false as failed,
          case when shared then count(*) over (partition by sha256(text)) else 1 end as copies
        from (select *, {_SHARED} as shared from (select rel, text, size_bytes from written
              union all select 'gone', null, (select min(size_bytes) from written))) where text is not null
        union all select 'gone', null, false, true, 0""", "written"))
def hash_prefilter(spark, sf):
    """Only sizes seen twice are read; copies are the same as with every file hashed. One file is gone."""
    root, _ = fx.written_files(spark, sf)
    listed = list_files(spark, root).where(~F.col("is_symlink"))
    gone = listed.agg(F.min("size_bytes").alias("size_bytes")).select(
        F.lit(f"{root}/gone").alias("path"), "size_bytes", F.current_timestamp().alias("modified_time"),
        F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("error"))
    hashed = hashing.hash_files(listed.unionByName(gone))
    copies = hashed.where("content_key is not null").groupBy("content_key").agg(F.count(F.lit(1)).alias("copies"))
    return hashed.join(copies, "content_key", "left").select(
        paths.relative(F.col("path"), root).alias("path"), "hash", F.col("hash").isNotNull().alias("was_read"),
        F.col("error").isNotNull().alias("failed"), F.coalesce("copies", F.lit(0)).alias("copies"))


# What a move leaves behind: every tenth file changed in place, every tenth lost.
_CHANGED = """case doc_id % 10 when 1 then translate(substr(text, 1, 1), 'abcdefghijklmnopqrstuvwxyzT', 'bcdefghijklmnopqrstuvwxyzaU')
  || substr(text, 2) when 2 then null else text end"""


@query("verify_rescan", sql(
    f"""select rel as path, case when now is null then 'missing' when now = text then 'ok' else 'mismatch' end as status
        from (select rel, text, {_CHANGED} as now from written)""", "written"))
def verify_rescan(spark, sf):
    """Contents that changed without changing their length are found, whichever other files have that length."""
    before, _ = fx.written_files(spark, sf)
    after, _ = fx.written_files(spark, sf, _CHANGED)
    scanned = Organizer(spark, JobConfig(verify_integrity=True, ignore_hidden=False)).scan(before)
    planned = hashing.hash_files(
        scanned.where(~F.col("is_symlink")).select("path", "size_bytes"), all_files=True).select(
        F.concat(F.lit(after + "/"), paths.relative(F.col("path"), before)).alias("path"), "size_bytes", "hash")
    return hashing.verify_contents(planned).select(paths.relative(F.col("path"), after).alias("path"), "status")


_PUT = """case doc_id % 4 when 0 then '%PDF-1.4 ' || text when 1 then '<!doctype html>' || text
  when 2 then '#!/bin/sh' || chr(10) || text else text end"""


@query("scan_types", sql(
    """select case doc_id % 4 when 0 then 'Docs/PDFs' when 1 then 'Web/Documents' when 2 then 'Code/Shell' else 'Docs/Text' end
         as place, count(*) as files from written group by all""", "written"))
def scan_types(spark, sf):
    """A run over scanned files told apart by their first bytes: all names end alike."""
    root, _ = fx.written_files(spark, sf, _PUT, "'all_In/' || (doc_id % 5) || '/f' || doc_id || '.dat'")
    job = Organizer(spark, JobConfig(use_magic=True, detect_duplicates=False))
    placed = job.plan(job.scan(root), root).ops
    return placed.where("not is_symlink").groupBy(F.concat_ws("/", "category", "subcategory").alias("place")).agg(
        F.count(F.lit(1)).alias("files"))
