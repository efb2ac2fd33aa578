"""Duplicates, similarity, integrity and resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixtures as fx
from queries.fixtures import sql
from queries.placing import doc_files
from queries.registry import query
from shelfmark.functions.totals import as_bigint
from shelfmark.operators import dedup, resume, similarity
from shelfmark.session import literal_table
from shelfmark.sources.hashing import content_group, content_hash

THRESHOLD = 5


def doc_sets(spark, sf):
    files = doc_files(spark, sf)
    return files, dedup.duplicate_sets(dedup.by_content(files))


_BIG_SETS = "select hash, count(*) as cnt, min(size_bytes) as size_bytes from big group by hash having count(*) > 1"


@query("dups_by_xxhash", sql(
    """select cnt, count(*) as sets from (select hash, count(*) as cnt from files group by hash having count(*) > 1)
       group by cnt""", "files"))
def dups_by_xxhash(spark, sf):
    files = doc_files(spark, sf).withColumn("hash", content_group(F.encode("text", "UTF-8")).cast("string"))
    return dedup.duplicate_sets(dedup.by_content(files)).groupBy("cnt").agg(F.count(F.lit(1)).alias("sets"))


@query("duplicate_sets", sql(
    f"""select 'doc' as inventory, hash, cnt, size_bytes, space_wasted from sets
        union all select 'big', hash, cnt, size_bytes, size_bytes * (cnt - 1) from ({_BIG_SETS})""", "sets", "big"))
def duplicate_sets(spark, sf):
    _, sets = doc_sets(spark, sf)
    big = dedup.duplicate_sets(dedup.by_content(fx.big(spark, sf)))
    return (
        sets.withColumn("inventory", F.lit("doc"))
        .unionByName(big.withColumn("inventory", F.lit("big")))
        .select("inventory", "hash", "cnt", "size_bytes", "space_wasted")
    )


@query("duplicate_primary", sql('select hash, "primary" from sets', "sets"))
def duplicate_primary(spark, sf):
    return doc_sets(spark, sf)[1].select("hash", "primary")


@query("duplicate_extras", sql("select hash, path from ranked where rk > 1", "ranked"))
def duplicate_extras(spark, sf):
    return dedup.extras(*doc_sets(spark, sf)).select("hash", "path")


@query("unique_files", sql("select path, hash from ranked where cnt = 1", "ranked"))
def unique_files(spark, sf):
    return dedup.unique_files(dedup.by_content(doc_files(spark, sf))).select("path", "hash")


@query("duplicate_waste", sql(
    f"""select count(*) as sets, cast(sum(cnt - 1) as bigint) as total_duplicates,
          cast(sum(size_bytes * (cnt - 1)) as bigint) as space_recoverable from ({_BIG_SETS})""", "big"))
def duplicate_waste(spark, sf):
    wasted = dedup.waste(dedup.duplicate_sets(dedup.by_content(fx.big(spark, sf))))
    return as_bigint(wasted, "space_recoverable")


@query("inventory_totals", sql(
    "select count(*) as total_files, cast(sum(size_bytes) as bigint) as total_size from big", "big"))
def inventory_totals(spark, sf):
    return as_bigint(dedup.totals(fx.big(spark, sf)), "total_size")


_ID = "cast(regexp_extract({}, '([0-9]+)', 1) as bigint)"


@query("similar_pairs", sql(
    """select l.id as leader_id, a.id as member_id, bit_count(xor(l.h, a.h))::bigint as distance
       from assigned a join nodes l on l.rn = a.leader_rn where a.rn <> a.leader_rn""", "walk", "leader", "assigned"))
def similar_pairs(spark, sf):
    matches = similarity.similar_matches(fx.sketch_files(spark, sf), THRESHOLD)
    return matches.selectExpr(
        f"{_ID.format('leader_path')} as leader_id", f"{_ID.format('path')} as member_id",
        "cast(distance as bigint) as distance",
    )


_SIMILAR = """select l.id as first_id, cast(sum(a.cnt) as bigint) as cnt, (1000 + bit_count(l.h))::bigint as size_bytes
  from assigned a join nodes l on l.rn = a.leader_rn group by l.id, l.h having sum(a.cnt) > 1"""


@query("similar_sets", sql(
    f"select first_id, cnt, size_bytes, size_bytes * (cnt - 1) as space_wasted from ({_SIMILAR})",
    "walk", "leader", "assigned"))
def similar_sets(spark, sf):
    sets = similarity.similar_sets(fx.sketch_files(spark, sf), THRESHOLD)
    return sets.selectExpr(
        f"{_ID.format('first_path')} as first_id", "cnt", "size_bytes", "space_wasted"
    )


@query("all_duplicate_sets", sql(
    f"""select 'similar' as kind, cnt, count(*) as sets, cast(sum(size_bytes * (cnt - 1)) as bigint) as space_wasted
          from ({_SIMILAR}) group by cnt
        union all
        select 'exact', cnt, count(*), cast(sum(size_bytes * (cnt - 1)) as bigint) from (
          select count(*) as cnt, (1000 + bit_count(h))::bigint as size_bytes from sketch group by h having count(*) > 1)
        group by cnt""",
    "walk", "leader", "assigned", "sketch"))
def all_duplicate_sets(spark, sf):
    files = fx.sketch_files(spark, sf)
    exact = dedup.duplicate_sets(dedup.by_content(files)).select(F.lit("exact").alias("kind"), "cnt", "space_wasted")
    similar = similarity.similar_sets(files, THRESHOLD).select(F.lit("similar").alias("kind"), "cnt", "space_wasted")
    return exact.unionByName(similar).groupBy("kind", "cnt").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("space_wasted").alias("space_wasted")
    )


@query("verify_integrity", sql(
    """select path, case when substr(hash, 1, 1) = '0' then 'missing' when substr(hash, 1, 1) = '1' then 'mismatch'
         else 'ok' end as status from doc""", "doc"))
def verify_integrity(spark, sf):
    """One file in sixteen is gone and one in sixteen has other contents than planned."""
    planned = fx.doc(spark, sf).select("path", "hash", "text")
    first = F.left("hash", F.lit(1))
    found = planned.where(first != "0").select(
        "path", content_hash(F.encode(F.concat("text", F.when(first == "1", "!").otherwise("")), "UTF-8")).alias("hash")
    )
    return dedup.verify_integrity(planned, found).select("path", "status")


def progress(spark, sf):
    """Progress of two runs over the documents: by first digit of the hash, done or failed."""
    return fx.doc(spark, sf).selectExpr(
        "case when doc_id % 2 = 0 then 'run-1' else 'run-2' end as run_id",
        "case when doc_id % 3 = 0 then '/old' else '/corpus' end as root", "hash",
        "case when doc_id % 2 = 0 then 'planning' else 'execution' end as phase",
        "case when hash < '8' then 'done' when hash < 'c' then 'failed' else 'open' end as status",
        "modified_time as ts",
    )


_PROGRESS = """select *, case when doc_id % 2 = 0 then 'run-1' else 'run-2' end as run_id,
  case when doc_id % 3 = 0 then '/old' else '/corpus' end as root,
  case when doc_id % 2 = 0 then 'planning' else 'execution' end as phase,
  case when hash < '8' then 'done' when hash < 'c' then 'failed' else 'open' end as status from doc"""


@query("resume_remaining", sql("select path, hash from files where hash >= '8'", "files"))
def resume_remaining(spark, sf):
    return resume.remaining(doc_files(spark, sf), progress(spark, sf)).select("path", "hash")


@query("resume_progress", sql(
    f"""select root, count(*) filter (status = 'done') as completed, count(*) filter (status = 'failed') as failed,
          arg_max(phase, modified_time) as phase, (select count(*) from doc) as total,
          count(*) filter (status = 'done') / (select count(*) from doc) * 100 as percent
        from ({_PROGRESS}) group by root""", "doc"))
def resume_progress(spark, sf):
    total = fx.doc(spark, sf).agg(F.count(F.lit(1))).scalar()
    return resume.progress_summary(progress(spark, sf), total)


@query("checkpoint_latest", sql(
    f"""select root, arg_max(run_id, modified_time) as run_id, arg_max(phase, modified_time) as phase,
          strftime(max(modified_time), '%Y-%m-%d %H:%M:%S') as ts
        from ({_PROGRESS}) where root <> '/old' group by root""", "doc"))
def checkpoint_latest(spark, sf):
    """The run of /old was cleared at the end."""
    cleared = literal_table(
        spark, [dict(run_id="run-3", root="/old", hash="", phase="cleanup", status=resume.CLEARED,
                     ts="2999-01-01T00:00:00")], resume.PROGRESS_DDL,
    )
    latest = resume.latest_runs(progress(spark, sf).unionByName(cleared))
    return latest.select("root", "run_id", "phase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
