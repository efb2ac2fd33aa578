"""Sources, scope and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixtures as fx
from queries.fixtures import DOC_ROOT, sql
from queries.registry import query
from shelfmark.config import JobConfig
from shelfmark.functions import formats, paths
from shelfmark.functions.metadata import KEY_STRATEGIES, exif_date, normalised_tags, organization_key
from shelfmark.operators import scope
from shelfmark.session import new_folder
from shelfmark.sources import mime as mime_source
from shelfmark.sources.hashing import content_hash
from shelfmark.sources.inventory import read_inventory

CFG = JobConfig()


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def scoped(spark, sf):
    return scope.with_scope(fx.doc(spark, sf), DOC_ROOT, CFG)


@query("scan_inventory", sql(
    "select path, size_bytes, hash, strftime(modified_time, '%Y-%m-%d %H:%M:%S') as modified, is_symlink from doc",
    "doc"))
def scan_inventory(spark, sf):
    folder = new_folder(spark, "inventory")
    fx.doc(spark, sf).select("path", "size_bytes", "hash", "modified_time", "is_symlink").write.parquet(folder)
    return read_inventory(spark, folder).select(
        "path", "size_bytes", "hash", stamp("modified_time").alias("modified"), "is_symlink"
    )


@query("scope_files", sql("select path, size_bytes from scoped where scope = 'file'", "scoped"))
def scope_files(spark, sf):
    return scope.files_in_scope(scoped(spark, sf)).select("path", "size_bytes")


@query("scope_directories", sql(
    "select distinct '/corpus/' || top as path from scoped where scope = 'directory'", "scoped"))
def scope_directories(spark, sf):
    return scope.directories_in_scope(scoped(spark, sf), DOC_ROOT)


@query("filter_hidden", sql("select path from parts where not starts_with(name, '.')", "parts"))
def filter_hidden(spark, sf):
    return fx.doc(spark, sf).where(~paths.is_hidden(F.col("path"))).select("path")


@query("filter_ignored", sql(
    "select path from parts where not regexp_matches(path, '(^|/)[^/]+/(\\.devAI|\\.git|node_modules|__pycache__)/[^/]+$')",
    "parts"))
def filter_ignored(spark, sf):
    from shelfmark.functions.globs import matches_any

    return fx.doc(spark, sf).where(~matches_any(F.col("path"), CFG.ignore_patterns)).select("path")


@query("filter_symlinks", sql("select path from doc where not is_symlink", "doc"))
def filter_symlinks(spark, sf):
    return fx.doc(spark, sf).where(~F.col("is_symlink")).select("path")


@query("ignored_by_reason", sql(
    """select scope as skip_reason, count(*) as files, cast(sum(size_bytes) as bigint) as bytes
       from scoped where scope in ('hidden', 'pattern', 'symlink') group by scope""", "scoped"))
def ignored_by_reason(spark, sf):
    return scope.ignored_files(scoped(spark, sf)).groupBy("skip_reason").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )


@query("file_parts", sql(
    """select path, ext, name, left(name, length(name) - length(ext)) as stem, parent,
              len(string_split(path, '/')) - 1 as depth,
              size_bytes / 1048576.0::double as size_mb, size_bytes / 1073741824.0::double as size_gb,
              starts_with(name, '.') as hidden, rel
       from parts""", "parts"))
def file_parts(spark, sf):
    p = F.col("path")
    return fx.doc(spark, sf).select(
        "path", paths.extension(p).alias("ext"), paths.base_name(p).alias("name"), paths.stem(p).alias("stem"),
        paths.parent(p).alias("parent"), paths.depth(p).cast("bigint").alias("depth"),
        formats.size_mb(F.col("size_bytes")).alias("size_mb"), formats.size_gb(F.col("size_bytes")).alias("size_gb"),
        paths.is_hidden(p).alias("hidden"), paths.relative(p, DOC_ROOT).alias("rel"),
    )


def _size_sql(x: str) -> str:
    whens = " ".join(
        f"when {x} < {1024 ** (n + 1)} then printf('%.1f', {x} / {1024**n}.0::double) || ' {unit}'"
        for n, unit in enumerate(formats.UNITS[:-1])
    )
    return f"case {whens} else printf('%.1f', {x} / {1024**5}.0::double) || ' PB' end"


@query("format_size", sql(f"select path, {_size_sql('size_bytes')} as size from big", "big"))
def format_size(spark, sf):
    return fx.big(spark, sf).select("path", formats.format_size(F.col("size_bytes")).alias("size"))


@query("format_duration", sql(
    """select path, case when s < 60 then printf('%.1f', s) || 's'
         when s < 3600 then cast(floor(s / 60) as int) || 'm ' || cast(floor(s % 60) as int) || 's'
         else cast(floor(s / 3600) as int) || 'h ' || cast(floor((s % 3600) / 60) as int) || 'm' end as duration
       from (select path, (size_bytes % 100000) / 10.0::double as s from big)""", "big"))
def format_duration(spark, sf):
    seconds = (F.col("size_bytes") % 100000) / F.lit(10.0)
    return fx.big(spark, sf).select("path", formats.format_duration(seconds).alias("duration"))


@query("sanitize_names", """
select doc_id, regexp_replace(translate(text, chr(10) || chr(13) || chr(9), '___'), '[\\x00-\\x1f]', '', 'g') as name
from documents""")
def sanitize_names(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", paths.sanitize(F.col("text")).alias("name"))


@query("truncate_paths", sql(
    """select path, case when length(path) <= 24 then path
         else substr(path, 1, 10) || '...' || right(path, 11) end as short from doc""", "doc"))
def truncate_paths(spark, sf):
    return fx.doc(spark, sf).select("path", paths.truncate_middle(F.col("path"), 24).alias("short"))


@query("path_escape_check", sql(
    """select doc_id, case doc_id % 4 when 2 then '/etc/' || name else path end as resolved,
         doc_id % 4 = 2 or coalesce(is_symlink and doc_id % 2 = 0, false) as escapes
       from parts""", "parts"))
def path_escape_check(spark, sf):
    raw = fx.doc(spark, sf).selectExpr(
        "doc_id",
        """case doc_id % 4 when 0 then path
             when 1 then regexp_replace(path, '/([^/]*)$', '/gone/.././$1')
             when 2 then '/corpus/../../etc/' || substring_index(path, '/', -1)
             else '/corpus/.//' || substr(path, 9) || '/' end as raw""",
        "case when is_symlink then case when doc_id % 2 = 0 then '/corpus2/x' else '/corpus/x' end end as target",
    )
    return raw.select(
        "doc_id", paths.normalised(F.col("raw")).alias("resolved"),
        paths.escapes(F.col("raw"), DOC_ROOT, F.col("target")).alias("escapes"),
    )


@query("metadata_dates", sql(
    """select doc_id, case when doc_id % 20 = 0 then null when doc_id % 4 in (0, 2)
         then strftime(modified_time - interval 400 days, '%Y-%m-%d %H:%M:%S') end as taken
       from doc""", "doc"))
def metadata_dates(spark, sf):
    raw = F.coalesce(
        F.try_element_at("raw_tags", F.lit("date_original"))[0], F.try_element_at("raw_tags", F.lit("date_taken"))[0]
    )
    return fx.tagged(spark, sf).select(
        "doc_id", F.date_format(exif_date(raw), "yyyy-MM-dd HH:mm:ss").alias("taken")
    )


def tags(spark, sf):
    files = fx.tagged(spark, sf)
    ext = paths.extension(F.col("path"))
    return files.withColumn("metadata", normalised_tags(F.col("raw_tags"), ext)).withColumn("ext", ext)


@query("metadata_normalised", sql(
    """select doc_id,
         case when doc_id % 2 = 1 then cast(1990 + doc_id % 30 as varchar) end as year,
         case when doc_id % 2 = 1 and doc_id % 4 <> 1 then lang end as album_artist,
         case when doc_id % 2 = 1 and doc_id % 4 = 1 then source end as artist,
         case when doc_id % 8 = 0 then source end as camera_make,
         case when doc_id % 2 = 0 and doc_id % 6 <> 0 then cast(doc_id as varchar) end as width,
         case when doc_id % 2 = 1 then cast(doc_id as varchar) end as length_seconds,
         cast(case when doc_id % 2 = 1 then 5
              else (case when doc_id % 20 <> 0 then 1 else 0 end) + (case when doc_id % 8 = 0 then 1 else 0 end)
                 + (case when doc_id % 6 <> 0 then 1 else 0 end) end as bigint) as n_tags
       from doc""", "doc"))
def metadata_normalised(spark, sf):
    names = ["year", "album_artist", "artist", "camera_make", "width", "length_seconds"]
    return tags(spark, sf).select(
        "doc_id", *[F.try_element_at("metadata", F.lit(n)).alias(n) for n in names],
        F.size("metadata").cast("bigint").alias("n_tags"),
    )


_KEY_SQL = {
    "exif-date": """case when doc_id % 20 <> 0 and doc_id % 2 = 0
        then strftime(modified_time - interval 400 days, '%Y/%m-%d') end""",
    "id3-artist": "case when doc_id % 2 = 1 then case when doc_id % 4 = 1 then source else lang end end",
    "id3-album": "case when doc_id % 2 = 1 then source end",
    "id3-genre": "case when doc_id % 2 = 1 then lang end",
    "camera-make": "case when doc_id % 8 = 0 then source end",
}


def _key_query(strategy):
    def run(spark, sf):
        return tags(spark, sf).select(
            "doc_id", organization_key(F.col("metadata"), F.col("ext"), strategy).alias("key")
        )

    query("metadata_key_" + strategy.replace("-", "_"), sql(f"select doc_id, {_KEY_SQL[strategy]} as key from doc", "doc"))(run)


for _strategy in KEY_STRATEGIES:
    _key_query(_strategy)

_MIMES = [
    "image/PNG", "image/svg+xml", "image/x-nikon-nef", "image/x-icon", "image/heic", "audio/mpeg", "audio/x-m4b",
    "video/mp4", "video/3gpp", "application/pdf", "application/msword", "application/vnd.ms-excel",
    "application/vnd.ms-powerpoint", "application/epub+zip", "application/gzip", "application/x-iso9660-image",
    "application/x-msi", "application/x-rpm", "application/x-sqlite3", "application/json", "application/wasm",
    "text/html", "text/x-python", "text/x-sh", "text/x-c++", "text/x-java", "text/markdown", "font/woff", "plain",
    "text/plain/x",
]
_MIME_PLACES = [
    "Pics/Photos", "Pics/Vector", "Pics/Raw", "Pics/Icons", "Pics/Photos", "Audio/Music", "Audio/Podcasts",
    "Vids/Movies", "Vids/Clips", "Docs/PDFs", "Docs/Word", "Docs/Sheets",
    "Docs/Presentations", "Docs/Ebooks", "Archives/Compressed", "Archives/Disk",
    "Programs/Windows", "Programs/Linux", "Apps/Database", "Web/Data", "Misc/Unsorted",
    "Web/Documents", "Code/Python", "Code/Shell", "Code/C", "Code/Java", "Docs/Text", "Misc/Unsorted", "Misc/Unsorted",
    "Misc/Unsorted",
]
_MIME_LIST = ", ".join(f"'{m}'" for m in _MIMES)
_PLACE_LIST = ", ".join(f"'{p}'" for p in _MIME_PLACES)


@query("classify_mime", f"""
select doc_id, mime, split_part(place, '/', 1) as category, split_part(place, '/', 2) as subcategory
from (select doc_id, ([{_MIME_LIST}])[1 + doc_id % {len(_MIMES)}] as mime,
             ([{_PLACE_LIST}])[1 + doc_id % {len(_MIMES)}] as place from documents)""")
def classify_mime(spark, sf):
    files = fx.table(spark, sf, "documents").selectExpr(
        "doc_id", f"array({_MIME_LIST})[cast(doc_id % {len(_MIMES)} as int)] as mime"
    )
    return mime_source.with_mime_category(files, "mime").select("doc_id", "mime", "category", "subcategory")


_TEXT_MIME = """case when length({0}) = 0 or regexp_matches({0}, '[\\x00-\\x06\\x0e-\\x1a\\x1c-\\x1f]') then null
  when regexp_matches({0}, '^\\s*(<!doctype html|<html)', 'i') then 'text/html'
  when regexp_matches({0}, '^\\s*<\\?xml') then 'text/xml'
  when regexp_matches({0}, '^#![^\\n]*python') then 'text/x-script.python'
  when regexp_matches({0}, '^#![^\\n]*sh') then 'text/x-shellscript'
  when regexp_matches({0}, '^\\s*[\\{{\\[].*[\\}}\\]]\\s*$', 's') then 'application/json' else 'text/plain' end"""
_HEAD_MIME = f"""case doc_id % 8 when 1 then 'application/pdf' when 2 then 'image/jpeg' when 3 then 'audio/mpeg'
  when 4 then 'video/mp4' when 5 then 'application/zip'
  when 6 then case when regexp_matches(text, '[\\x00-\\x06\\x0e-\\x1a\\x1c-\\x1f]') then null else 'text/x-script.python' end
  when 7 then null else {_TEXT_MIME.format("text")} end"""


@query("sniff_mime", sql(
    f"""select '/crawl/' || page_id || regexp_extract(regexp_replace(url, '[?#].*$', ''),
            '^[a-z]+://[^/]+/(?:.*/)?[^/]+(\\.[A-Za-z0-9]+)$', 1) as path, {_TEXT_MIME.format("html")} as mime from pages
        union all select path, {_HEAD_MIME} as mime from doc""", "doc"))
def sniff_mime(spark, sf):
    contents = fx.pages(spark, sf).select("path", "content").unionByName(fx.headed(spark, sf).select("path", "content"))
    return contents.select("path", mime_source.sniffed_mime(F.col("content")).alias("mime"))


@query("content_hash_sha256", "select doc_id, sha256(text) as hash from documents")
def content_hash_sha256(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", content_hash(F.encode("text", "UTF-8")).alias("hash"))


@query("average_sketch", sql(
    "select id, (h >> 32)::bigint as high, (h & 4294967295)::bigint as low from sketch", "sketch"))
def average_sketch(spark, sf):
    return fx.sketches(spark, sf).selectExpr(
        "id", "shiftrightunsigned(sketch, 32) as high", "sketch & 4294967295L as low"
    )
