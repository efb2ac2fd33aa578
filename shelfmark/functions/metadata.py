"""Column functions over tag maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions with tags, extensions with a sketch, tag names and key strategies.
IMAGE_TAG_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tiff", ".webp", ".heic")
AUDIO_TAG_EXTENSIONS = (".mp3", ".flac", ".m4a", ".ogg", ".wav")
SKETCH_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp", ".heic")
EXIF_DATE_FORMAT = "yyyy:MM:dd HH:mm:ss"
RENAMED_TAGS = {"date": "year", "albumartist": "album_artist"}
TRIMMED_TAGS = ("camera_make", "camera_model")
INTEGER_TAGS = ("width", "height", "orientation", "length_seconds", "bitrate", "sample_rate")
DATE_TAGS = ("date_original", "date_taken")
IMAGE_TAGS = (*DATE_TAGS, *TRIMMED_TAGS, "width", "height", "orientation")
AUDIO_TAGS = (
    "artist", "album", "title", "genre", "year", "album_artist", "composer",
    "length_seconds", "bitrate", "sample_rate",
)
KEY_STRATEGIES = ("exif-date", "id3-artist", "id3-album", "id3-genre", "camera-make")


def exif_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(EXIF_DATE_FORMAT))


def is_image(ext: Column) -> Column:
    return ext.isin(*IMAGE_TAG_EXTENSIONS)


def is_audio(ext: Column) -> Column:
    return ext.isin(*AUDIO_TAG_EXTENSIONS)


def normalised_tags(raw: Column, ext: Column) -> Column:
    """``MAP<STRING,ARRAY<STRING>>`` of raw tags -> ``MAP<STRING,STRING>`` with our keys.

    Lists give their first element, numbers and dates that do not parse are left out, and only
    the tags of the file's own kind are kept.
    """
    renamed = F.transform_keys(raw, lambda key, _: _renamed(key))
    first = F.transform_values(renamed, lambda _, values: F.try_element_at(values, F.lit(1)))
    typed = F.transform_values(
        first,
        lambda key, v: F.when(key.isin(*TRIMMED_TAGS), F.trim(v))
        .when(key.isin(*INTEGER_TAGS), v.try_cast("double").try_cast("bigint").cast("string"))
        .when(key.isin(*DATE_TAGS), F.when(exif_date(v).isNotNull(), v))
        .otherwise(v),
    )
    return F.map_filter(
        typed,
        lambda key, v: v.isNotNull()
        & ((is_image(ext) & key.isin(*IMAGE_TAGS)) | (is_audio(ext) & key.isin(*AUDIO_TAGS))),
    )


def _renamed(key: Column) -> Column:
    out = key
    for old, new in RENAMED_TAGS.items():
        out = F.when(key == old, F.lit(new)).otherwise(out)
    return out


def tag_date(tags: Column, ext: Column) -> Column:
    """Original date, else date taken, of an image; null for all else."""
    dates = [exif_date(F.try_element_at(tags, F.lit(tag))) for tag in DATE_TAGS]
    return F.when(is_image(ext), F.coalesce(*dates))


def organization_key(tags: Column, ext: Column, strategy: str) -> Column:
    """Key to organize by, or null when the tags do not give one."""
    def tag(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at(tags, F.lit(n)) for n in names])

    if strategy == "exif-date":
        return F.date_format(tag_date(tags, ext), "yyyy/MM-dd")
    if strategy == "id3-artist":
        return F.when(is_audio(ext), tag("artist", "album_artist"))
    if strategy == "id3-album":
        return F.when(is_audio(ext), tag("album"))
    if strategy == "id3-genre":
        return F.when(is_audio(ext), tag("genre"))
    if strategy == "camera-make":
        return F.when(is_image(ext), tag("camera_make"))
    return F.lit(None).cast("string")
