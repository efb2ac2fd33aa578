"""MIME types: detection from content and mapping to categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import literal_table
from shelfmark.sources.rules import FALLBACK

# Major type, minor types ('*': any other), category, subcategory.
MIME_TABLE: list[tuple[str, list[str], str, str]] = [
    ("image", ["svg+xml", "x-eps"], "Pics", "Vector"),
    ("image", ["x-canon-cr2", "x-nikon-nef", "x-adobe-dng"], "Pics", "Raw"),
    ("image", ["x-icon"], "Pics", "Icons"),
    ("image", ["*"], "Pics", "Photos"),
    ("audio", ["x-m4b"], "Audio", "Podcasts"),
    ("audio", ["*"], "Audio", "Music"),
    ("video", ["3gpp", "x-m4v"], "Vids", "Clips"),
    ("video", ["*"], "Vids", "Movies"),
    ("application", ["pdf"], "Docs", "PDFs"),
    ("application", ["msword", "vnd.openxmlformats-officedocument.wordprocessingml.document"], "Docs", "Word"),
    ("application", ["vnd.ms-excel", "vnd.openxmlformats-officedocument.spreadsheetml.sheet", "vnd.oasis.opendocument.spreadsheet"], "Docs", "Sheets"),
    ("application", ["vnd.ms-powerpoint", "vnd.openxmlformats-officedocument.presentationml.presentation"], "Docs", "Presentations"),
    ("application", ["epub+zip"], "Docs", "Ebooks"),
    ("application", ["zip", "x-rar", "x-7z-compressed", "gzip", "x-bzip2", "x-xz"], "Archives", "Compressed"),
    ("application", ["x-iso9660-image", "x-apple-diskimage"], "Archives", "Disk"),
    ("application", ["x-msdownload", "x-dosexec", "x-msi"], "Programs", "Windows"),
    ("application", ["x-debian-package", "x-rpm", "x-executable", "x-sharedlib"], "Programs", "Linux"),
    ("application", ["x-sqlite3"], "Apps", "Database"),
    ("application", ["json", "xml", "yaml"], "Web", "Data"),
    ("application", ["*"], "Misc", "Unsorted"),
    ("text", ["html", "xml"], "Web", "Documents"),
    ("text", ["x-python", "x-script.python"], "Code", "Python"),
    ("text", ["x-shellscript", "x-sh"], "Code", "Shell"),
    ("text", ["x-c", "x-c++"], "Code", "C"),
    ("text", ["x-java-source", "x-java"], "Code", "Java"),
    ("text", ["*"], "Docs", "Text"),
]

# Published file signatures, in order of precedence: offset, bytes, MIME type.
SIGNATURES: list[tuple[int, bytes, str]] = [
    (0, bytes.fromhex("25504446"), "application/pdf"),
    (0, bytes.fromhex("FFD8FF"), "image/jpeg"),
    (0, bytes.fromhex("89504E470D0A1A0A"), "image/png"),
    (0, bytes.fromhex("47494638"), "image/gif"),
    (0, bytes.fromhex("49492A00"), "image/tiff"),
    (0, bytes.fromhex("4D4D002A"), "image/tiff"),
    (8, bytes.fromhex("57454250"), "image/webp"),
    (8, bytes.fromhex("57415645"), "audio/x-wav"),
    (8, bytes.fromhex("41564920"), "video/x-msvideo"),
    (0, bytes.fromhex("494433"), "audio/mpeg"),
    (0, bytes.fromhex("664C6143"), "audio/flac"),
    (0, bytes.fromhex("4F676753"), "audio/ogg"),
    (4, bytes.fromhex("667479704D344120"), "audio/x-m4a"),
    (4, bytes.fromhex("667479707174"), "video/quicktime"),
    (4, bytes.fromhex("6674797033677035"), "video/3gpp"),
    (4, bytes.fromhex("66747970"), "video/mp4"),
    (0, bytes.fromhex("1A45DFA3"), "video/webm"),
    (0, bytes.fromhex("504B0304"), "application/zip"),
    (0, bytes.fromhex("52617221"), "application/x-rar"),
    (0, bytes.fromhex("377ABCAF271C"), "application/x-7z-compressed"),
    (0, bytes.fromhex("1F8B"), "application/gzip"),
    (0, bytes.fromhex("425A68"), "application/x-bzip2"),
    (0, bytes.fromhex("FD377A585A00"), "application/x-xz"),
    (0, bytes.fromhex("53514C69746520666F726D6174203300"), "application/x-sqlite3"),
    (0, bytes.fromhex("7F454C46"), "application/x-executable"),
    (0, bytes.fromhex("4D5A"), "application/x-dosexec"),
    (0, bytes.fromhex("424D"), "image/bmp"),
]

# Patterns over text content, in order of precedence.
TEXT_PATTERNS = (
    (r"(?i)^\s*(<!doctype html|<html)", "text/html"),
    (r"^\s*<\?xml", "text/xml"),
    (r"^#![^\n]*python", "text/x-script.python"),
    (r"^#![^\n]*sh", "text/x-shellscript"),
    (r"(?s)^\s*[{\[].*[}\]]\s*$", "application/json"),
)
CONTROL_BYTES = r"[\x00-\x06\x0e-\x1a\x1c-\x1f]"


def sniffed_mime(content: Column) -> Column:
    """MIME type of a binary value, or null when it is neither a known format nor text."""
    found = F.when(F.length(content) == 0, F.lit(None).cast("string"))
    for offset, magic, mime in SIGNATURES:
        found = found.when(F.substring(content, offset + 1, len(magic)) == F.lit(magic), F.lit(mime))
    text = content.cast("string")
    found = found.when(~F.is_valid_utf8(text) | text.rlike(CONTROL_BYTES), F.lit(None).cast("string"))
    for pattern, mime in TEXT_PATTERNS:
        found = found.when(text.rlike(pattern), F.lit(mime))
    return found.otherwise(F.lit("text/plain"))


def mime_table(spark: SparkSession) -> DataFrame:
    rows = [
        dict(major=major, minor=minor, category=category, subcategory=subcategory)
        for major, minors, category, subcategory in MIME_TABLE for minor in minors
    ]
    return literal_table(spark, rows, "major string, minor string, category string, subcategory string")


def with_mime_category(df: DataFrame, mime: str) -> DataFrame:
    """Adds ``category, subcategory`` for the MIME type in column ``mime``; both stay null when
    the type itself is null."""
    table = mime_table(df.sparkSession)
    exact = table.where("minor <> '*'").select(
        F.concat_ws("/", "major", "minor").alias("_type"), F.struct("category", "subcategory").alias("_exact")
    )
    default = table.where("minor = '*'").select(
        F.col("major").alias("_major"), F.struct("category", "subcategory").alias("_default")
    )
    parts = F.split(F.lower(mime), "/")
    fallback = F.struct(F.lit(FALLBACK[0]).alias("category"), F.lit(FALLBACK[1]).alias("subcategory"))
    return (
        df.withColumn("_t", F.lower(mime))
        .withColumn("_m", F.when(F.size(parts) == 2, parts[0]))
        .join(exact, F.col("_t") == F.col("_type"), "left")
        .join(default, F.col("_m") == F.col("_major"), "left")
        .withColumn("_place", F.when(F.col(mime).isNotNull(), F.coalesce("_exact", "_default", fallback)))
        .withColumn("category", F.col("_place.category"))
        .withColumn("subcategory", F.col("_place.subcategory"))
        .drop("_t", "_m", "_type", "_major", "_exact", "_default", "_place")
    )
