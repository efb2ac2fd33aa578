"""Inventories derived from the given tables, for Spark and as SQL.

``SQL`` holds named common table expressions; ``sql(body, *names)`` puts those a query needs, and
what they need themselves, in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.sketch import average_sketch
from shelfmark.session import new_folder
from shelfmark.sources.rules import default_mapping

DOC_ROOT = "/corpus"
BIG_ROOT = "/data"
SKETCH_ROOT = "/sketch"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


_DOC_PATH = """
'/corpus/' || case {d} when 0 then '' when 1 then 'all_Docs/Text/' when 2 then 'all_Pics/' || source || '/'
                     when 3 then source || '/' when 4 then 'all_Docs/node_modules/'
                     else 'all_Duplicates/' || lang || '/' end
|| case when doc_id % 50 = 7 then '.' else '' end
|| 'doc_' || case when {g} % 3 = 0 then {g} else doc_id + 1000000 end
"""
_DOC_EXTS = "'.txt','.PDF','.jpg','.tar.gz','.py','','.dmg','.webp','.xyz','.htm','.iso','.mp3'"


def doc(spark: SparkSession, sf: str) -> DataFrame:
    path = _DOC_PATH.format(g="(doc_id div 6)", d="(doc_id % 6)")
    return table(spark, sf, "documents").selectExpr(
        "doc_id",
        f"{path} || array({_DOC_EXTS})[cast((doc_id div 6) % 12 as int)] as path",
        "cast(octet_length(text) as bigint) as size_bytes",
        "sha2(text, 256) as hash",
        "timestamp '2023-01-01 00:00:00' + make_dt_interval(0, cast(doc_id * 13 as int)) as modified_time",
        "doc_id % 97 = 0 as is_symlink",
        "text", "source", "lang",
    )


def big(spark: SparkSession, sf: str) -> DataFrame:
    firsts = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"),
        F.min("l_quantity").cast("bigint").alias("q"), F.min("l_shipdate").alias("d"),
    )
    return firsts.selectExpr(
        "'/data/w' || (s % 7) || '/o' || l_orderkey || '_' || l_linenumber || "
        "array('.pdf','.jpg','.mp3','.tar.gz','.py','','.dmg','.webp','.xyz','.log')[cast(p % 10 as int)] as path",
        "p * p * q * 15 as size_bytes",
        "cast(d as timestamp) as modified_time",
        "sha2(p || '|' || q, 256) as hash",
        "false as is_symlink",
    )


def sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches with planted near copies; a path per vector that sorts like its number."""
    base = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), average_sketch(F.col("embedding")).alias("sketch")
    )
    copies = base.where("id % 5 = 0").selectExpr(
        "id + 1000000 as id", "sketch ^ (shiftleft(1L, cast((id div 5) % 8 as int)) - 1) as sketch"
    )
    return base.unionByName(copies).withColumn(
        "path", F.concat(F.lit(SKETCH_ROOT + "/"), F.lpad(F.col("id").cast("string"), 12, "0"), F.lit(".png"))
    )


def sketch_files(spark: SparkSession, sf: str) -> DataFrame:
    """The sketches as an inventory; equal sketches are equal contents."""
    return sketches(spark, sf).selectExpr(
        "path", "cast(1000 + bit_count(sketch) as bigint) as size_bytes",
        "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 5000 as int)) as modified_time",
        "sha2(cast(sketch as string), 256) as hash", "false as is_symlink", "sketch",
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id", "'/inbox/u' || user_id as path",
        "case when event_type = 'signup' then 'created' else 'modified' end as event_type",
        "cast(ts as timestamp) as ts", "cast(value * 100 as bigint) as size_bytes",
    )


def event_folder(spark: SparkSession, sf: str, sentinel: bool = False) -> str:
    """The events as files that a stream can read, with a last event far in the future if asked."""
    rows = events(spark, sf)
    if sentinel:
        rows = rows.unionByName(spark.sql(
            "select -1L as event_id, '/inbox/_end' as path, 'created' as event_type, "
            "timestamp '2999-01-01 00:00:00' as ts, 0L as size_bytes"
        ))
    folder = new_folder(spark, "events")
    rows.write.parquet(folder)
    return folder


_ARRIVAL_PATH = """
'/inbox/' || case user_id % 7 when 0 then 'all_Docs/' when 1 then '.cache/' when 2 then 'node_modules/' else '' end
|| case when user_id % 11 = 5 then '.' else '' end || 'u' || user_id || {exts}
"""
_ARRIVAL_EXTS = "'.pdf','.jpg','','.tar.gz','.PY','.xyz','.mp3'"


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """The events of `events` on files of many kinds, in managed, hidden and ignored folders too."""
    return table(spark, sf, "events").selectExpr(
        "event_id", _ARRIVAL_PATH.format(exts=f"array({_ARRIVAL_EXTS})[cast((user_id div 7) % 7 as int)]") + " as path",
        "case when event_type = 'signup' then 'created' else 'modified' end as event_type",
        "cast(ts as timestamp) as ts", "cast(value * 100 as bigint) as size_bytes",
    )


def in_batches(rows: DataFrame, batches: int = 10) -> str:
    """``rows`` in order of time as so many files, and a last event far in the future: what a stream reads one by one."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "batches")
    cuts = rows.agg(F.percentile_approx(F.unix_micros("ts"), [n / batches for n in range(1, batches)])).first()[0] or []
    rows = rows.withColumn("_batch", sum((F.when(F.unix_micros("ts") > c, 1).otherwise(0) for c in cuts), F.lit(1)))
    staged = new_folder(spark, "timed")
    rows.write.partitionBy("_batch").parquet(staged)
    for n in range(1, batches + 1):
        spark.read.schema(rows.schema).parquet(staged).where(F.col("_batch") == n).drop("_batch").coalesce(1).write.mode(
            "append").parquet(folder)
    spark.sql("select -1L as event_id, '/inbox/_end' as path, 'created' as event_type, "
              "timestamp '2999-01-01 00:00:00' as ts, 0L as size_bytes").write.mode("append").parquet(folder)
    return folder


def pages(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.regexp_replace("url", "[?#].*$", "")
    ext = F.regexp_extract(bare, r"^[a-z]+://[^/]+/(?:.*/)?[^/]+(\.[A-Za-z0-9]+)$", 1)
    return table(spark, sf, "pages").select(
        F.concat(F.lit("/crawl/"), F.col("page_id").cast("string"), ext).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )


def headed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as binary contents, most of them behind the header of a known format."""
    return doc(spark, sf).selectExpr(
        "doc_id", "path", "size_bytes", "modified_time",
        """case doc_id % 8 when 1 then encode('%PDF-1.7 ', 'UTF-8') || encode(text, 'UTF-8')
                           when 2 then unhex('FFD8FF') || encode(text, 'UTF-8')
                           when 3 then encode('ID3', 'UTF-8') || encode(text, 'UTF-8')
                           when 4 then unhex('00000018') || encode('ftypmp42', 'UTF-8') || encode(text, 'UTF-8')
                           when 5 then unhex('504B0304') || encode(text, 'UTF-8')
                           when 6 then encode('#!/usr/bin/env python' || chr(10), 'UTF-8') || encode(text, 'UTF-8')
                           when 7 then unhex('00') || encode(text, 'UTF-8')
                           else encode(text, 'UTF-8') end as content""",
    )


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as images and songs with raw tags: lists of values under raw names."""
    shot = "date_format(modified_time - interval 400 days, 'yyyy:MM:dd HH:mm:ss')"
    return doc(spark, sf).selectExpr(
        "doc_id", "modified_time",
        "'/corpus/tag_' || doc_id || case when doc_id % 2 = 0 then '.jpg' else '.mp3' end as path",
        f"""map_filter(map(
            'date_original', case when doc_id % 20 = 0 then array('unknown') when doc_id % 4 = 0 then array({shot}) end,
            'date_taken', case when doc_id % 4 = 2 then array({shot}, 'second') end,
            'artist', case when doc_id % 4 = 1 then array(source) end,
            'albumartist', case when doc_id % 4 <> 1 then array(lang, source) end,
            'album', array(source),
            'genre', array(lang),
            'date', array(cast(1990 + doc_id % 30 as string)),
            'camera_make', case when doc_id % 8 = 0 then array('  ' || source || ' ') end,
            'width', case when doc_id % 6 = 0 then array('wide') else array(cast(doc_id as string)) end,
            'length_seconds', array(cast(doc_id as string) || '.75')
        ), (k, v) -> v is not null) as raw_tags""",
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of the symlinks: files, other links, themselves and nothing."""
    d = doc(spark, sf).selectExpr("doc_id", "path", "doc_id div 97 as k", "is_symlink")
    source = d.where("is_symlink").selectExpr(
        "path", "k",
        "case when k % 5 = 0 then doc_id + 1 when k % 5 = 3 then doc_id else doc_id - 97 end as target_id",
    )
    return source.join(d.selectExpr("doc_id as target_id", "path as target_path"), "target_id", "left").selectExpr(
        "path", "case when k % 10 = 5 or target_path is null then '/corpus/none' else target_path end as target"
    )


_TREE_PATH = """
'd' || (doc_id % 5) || case doc_id % 4 when 0 then '/' when 1 then '/_x/' when 2 then '/.h/' else '/with blank/é/' end
|| case doc_id % 3 when 0 then '_' when 1 then '.' else 'a b ' end || doc_id || '.txt'
"""


def written_files(
    spark: SparkSession, sf: str, changed: str = "text", path: str = _TREE_PATH
) -> tuple[str, DataFrame]:
    """The documents as files, written by the tasks below a new folder: the folder and (doc_id, path).

    Some names begin with a dot or an underscore or hold blanks; every 97th document also has a link. ``changed``
    is the SQL of what is written, a null writes nothing.
    """
    root = re.sub("^file:/+", "/", new_folder(spark, "tree"))

    def write(batches):
        import os
        import uuid

        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 64):  # a batch may hold ten thousand texts: few of them as strings at once
                batch = whole.slice(at, 64)
                for rel, text, link in zip(*(batch[c].to_pylist() for c in ("rel", "text", "link"))):
                    if text is None:
                        continue
                    path = f"{root}/{rel}"
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(f"{path}.{uuid.uuid4().hex}.part", "wb") as out:
                        out.write(text.encode())
                    os.replace(out.name, path)  # a task that runs twice writes the same
                    if link:
                        os.makedirs(f"{root}/links", exist_ok=True)
                        part = f"{root}/links/{uuid.uuid4().hex}.part"
                        os.symlink(path, part)
                        os.replace(part, f"{root}/links/{link}")
                yield pa.record_batch([batch["doc_id"], pa.array([f"{root}/{r}" for r in batch["rel"].to_pylist()])],
                                      ["doc_id", "path"])

    rows = table(spark, sf, "documents").selectExpr(
        "doc_id", f"{path} as rel", f"{changed} as text", "case when doc_id % 97 = 0 then 'l' || doc_id end as link")
    written = rows.mapInArrow(write, "doc_id bigint, path string")
    folder = new_folder(spark, "written")
    written.write.parquet(folder)
    return root, spark.read.schema("doc_id bigint, path string").parquet(folder)


# --- SQL --------------------------------------------------------------------------------------

_RULE_ROWS = ",\n".join(
    f"({n}, '{ext}', '{category}', '{subcategory}')"
    for n, (category, subcategory, ext) in enumerate(
        (c, s, e) for c, subs in default_mapping().items() for s, exts in subs.items() for e in (exts or [""])
    )
)

SQL = {
    "written": f"""
select doc_id, {_TREE_PATH} as rel, text, octet_length(encode(text)) as size_bytes from documents""",
    "doc": f"""
select doc_id,
 {_DOC_PATH.format(g="(doc_id // 6)", d="(doc_id % 6)")} || ([{_DOC_EXTS}])[1 + ((doc_id // 6) % 12)] as path,
 octet_length(encode(text)) as size_bytes, sha256(text) as hash,
 timestamp '2023-01-01' + to_hours(doc_id * 13) as modified_time,
 doc_id % 97 = 0 as is_symlink, text, source, lang
from documents""",
    "big": """
select '/data/w' || (min(l_suppkey) % 7) || '/o' || l_orderkey || '_' || l_linenumber ||
 (['.pdf','.jpg','.mp3','.tar.gz','.py','','.dmg','.webp','.xyz','.log'])[1 + (min(l_partkey) % 10)] as path,
 min(l_partkey) * min(l_partkey) * cast(min(l_quantity) as bigint) * 15 as size_bytes,
 min(l_shipdate) as modified_time,
 sha256(min(l_partkey) || '|' || cast(min(l_quantity) as bigint)) as hash
from lineitem group by l_orderkey, l_linenumber""",
    "sketch0": """
select vec_id as id,
 list_reduce(list_transform(embedding, lambda x: x::double), lambda a, b: a + b) / 64 as mean, embedding
from embeddings""",
    "sketch1": """
select id, cast(list_sum(list_transform(range(0, 64),
   lambda i: case when embedding[i + 1]::double > mean then 1::hugeint << i else 0::hugeint end)) as hugeint) as h
from sketch0""",
    "sketch": """
select id, h from sketch1
union all
select id + 1000000, xor(h, (1::hugeint << ((id // 5) % 8)::hugeint) - 1) from sketch1 where id % 5 = 0""",
    "nodes": """
select h, min(id) as id, count(*) as cnt, row_number() over (order by min(id)) as rn from sketch group by h""",
    "pairs": """
select a.rn as a, b.rn as b, bit_count(xor(a.h, b.h)) as distance
from nodes a join nodes b on a.rn < b.rn and bit_count(xor(a.h, b.h)) <= 5""",
    "preds": """
select n.rn, coalesce(list(p.a) filter (p.a is not null), []) as preds
from nodes n left join pairs p on p.b = n.rn group by n.rn""",
    "walk": """
select 0::bigint as rn, []::bigint[] as leaders
union all
select p.rn, case when list_has_any(w.leaders, p.preds) then w.leaders else list_append(w.leaders, p.rn) end
from walk w join preds p on p.rn = w.rn + 1""",
    "leader": "select unnest(leaders) as rn from walk where rn = (select max(rn) from walk)",
    "assigned": """
select n.rn, n.h, n.id, n.cnt, coalesce(x.leader_rn, n.rn) as leader_rn
from nodes n left join (
  select p.b, min(p.a) as leader_rn from pairs p join leader l on l.rn = p.a
  where p.b not in (select rn from leader) group by p.b) x on x.b = n.rn""",
    "evt": """
select event_id, '/inbox/u' || user_id as path,
 case when event_type = 'signup' then 'created' else 'modified' end as event_type,
 ts, cast(trunc(value * 100) as bigint) as size_bytes
from events""",
    "arrival": f"""
select event_id, {_ARRIVAL_PATH.format(exts=f"([{_ARRIVAL_EXTS}])[1 + ((user_id // 7) % 7)]")} as path,
 case when event_type = 'signup' then 'created' else 'modified' end as event_type,
 ts, cast(trunc(value * 100) as bigint) as size_bytes
from events""",
    "arrived": """
select * from arrival where not starts_with(path, '/inbox/all_')
 and not regexp_matches(path, '/\\.[^/]*$') and not regexp_matches(path, '/node_modules/[^/]+$')""",
    "bursts": """
select path, min(ts) as first_ts, max(ts) as ts, count(*) as n_events, arg_max(size_bytes, row(ts, event_id)) as size_bytes,
 bool_or(event_type = 'created') as created
from (select *, sum(start) over (partition by path order by ts, event_id) as burst
      from (select *, case when ts <= lag(ts) over (partition by path order by ts, event_id) + interval 1 hour
                           then 0 else 1 end as start from arrived))
group by path, burst""",
    "rules": f"select * from (values {_RULE_ROWS}) as r(ord, ext, category, subcategory)",
    "lookup": """
select ext, arg_min(category, ord) as category, arg_min(subcategory, ord) as subcategory
from rules where ext <> '' group by ext""",
    "parts": """
select *, split_part(path, '/', -1) as name, substr(path, 9) as rel,
 lower(regexp_extract(split_part(path, '/', -1), '^.+(\\.[^.]+)$', 1)) as ext,
 regexp_replace(path, '/[^/]*$', '') as parent
from doc""",
    "scoped": """
select *, case when contains(rel, '/') then split_part(rel, '/', 1) end as top,
 case when contains(rel, '/') and starts_with(rel, '.') then 'ignored_directory'
      when contains(rel, '/') and not starts_with(rel, 'all_') then 'directory'
      when starts_with(name, '.') then 'hidden'
      when regexp_matches(path, '(^|/)[^/]+/(\\.devAI|\\.git|node_modules|__pycache__)/[^/]+$') then 'pattern'
      when is_symlink then 'symlink' else 'file' end as scope
from parts""",
    "files": """
select f.*, coalesce(l.category, 'Misc') as category, coalesce(l.subcategory, 'Unsorted') as subcategory
from scoped f left join lookup l on l.ext = f.ext where scope = 'file'""",
    "ranked": """
select *, count(*) over (partition by hash) as cnt,
 row_number() over (partition by hash order by length(path), modified_time, path) as rk
from files""",
    "sets": """
select hash, cnt, size_bytes, path as "primary", size_bytes * (cnt - 1) as space_wasted
from ranked where rk = 1 and cnt > 1""",
    "ops": """
select * from (
 select case when rk > 1 then 1 when cnt = 1 then 2 else 3 end as phase, path as source,
  case when rk > 1 then '/corpus/all_Duplicates/' || regexp_replace(rel, '^all_Duplicates/', '')
       else '/corpus/all_' || category || '/' || subcategory || '/' || name end as destination,
  case when rk > 1 then 'duplicate' else 'classify' end as reason,
  size_bytes, hash, is_symlink, category, subcategory
 from ranked) where source <> destination""",
    "dirops": """
select distinct '/corpus/' || top as source, '/corpus/all_Folders/' || top as destination
from scoped where scope = 'directory' and top <> '.devAI'""",
    "crowded": """
select o.destination, count(*) as n_ops, any_value(d.path) is not null as occupied,
 arg_min(o.source, o.phase || o.source) as first_source, arg_max(o.source, o.phase || o.source) as last_source
from ops o left join doc d on d.path = o.destination
group by o.destination having count(*) > 1 or any_value(d.path) is not null""",
    "numbers": """
select destination, num, row_number() over (partition by destination order by num) as r
from (select destination, regexp_replace(destination, '/[^/]*$', '/') as folder, split_part(destination, '/', -1) as name,
        unnest(range(1, n_ops + 1 + (select count(*) from doc))) as num from crowded) c
where folder || left(name, length(name) - length(regexp_extract(name, '^.+(\\.[^.]+)$', 1))) || '_' || num
      || regexp_extract(name, '^.+(\\.[^.]+)$', 1)
  not in (select path from doc union select destination from ops)""",
    "contested": """
select o.*, c.occupied, c.n_ops,
 row_number() over (partition by o.destination order by phase, source) - case when c.occupied then 0 else 1 end as r
from ops o left join crowded c on c.destination = o.destination""",
    "resolved": """
select c.* exclude (r), case when n.num is null then c.destination
  else regexp_replace(c.destination, '/[^/]*$', '/') || left(split_part(c.destination, '/', -1),
       length(split_part(c.destination, '/', -1)) - length(regexp_extract(split_part(c.destination, '/', -1), '^.+(\\.[^.]+)$', 1)))
       || '_' || n.num || regexp_extract(split_part(c.destination, '/', -1), '^.+(\\.[^.]+)$', 1) end as final_destination
from contested c left join numbers n on n.destination = c.destination and n.r = c.r and c.n_ops is not null""",
    "moved": """
select d.* exclude (path), coalesce(r.final_destination, d.path) as path, d.path as old_path
from doc d left join resolved r on r.source = d.path""",
    "after": """
select m.* exclude (path), coalesce(o.destination || substr(m.path, length(o.source) + 1), m.path) as path
from moved m left join dirops o on starts_with(m.path, o.source || '/')""",
    "dirs_before": """
select distinct array_to_string(list_slice(string_split(path, '/'), 1, n), '/') as path
from (select path, unnest(range(2, len(string_split(path, '/')))) as n from doc)""",
    "dirs_after": """
select distinct array_to_string(list_slice(string_split(path, '/'), 1, n), '/') as path
from (select path, unnest(range(2, len(string_split(path, '/')))) as n from after)""",
    "state": "select path, length(path) % 3 <> 0 as writable from dirs_before",
    "log": "select phase, source, final_destination as destination, hash from resolved",
}
_RECURSIVE = {"walk"}


def sql(body: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in SQL:
            if other != name and other not in ordered and re.search(rf"\b(from|join)\s+{other}\b", SQL[name]):
                visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    recursive = "recursive " if _RECURSIVE & set(ordered) else ""
    parts = ",\n".join(f"{n} as ({SQL[n].strip()})" for n in ordered)
    return f"with {recursive}{parts}\n{body.strip()}"
