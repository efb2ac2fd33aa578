"""Column functions over '/'-separated paths.

They mention their argument once where they can: Catalyst repeats the whole expression behind a
column at every mention when it pushes filters down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot, or '' (none for ``.bashrc``, ``a.`` and ``noext``)."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(suffix(path))


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def stem(path: Column) -> Column:
    return without_suffix(base_name(path))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "^(/)[^/]*$|/[^/]*$", "$1")


def depth(path: Column) -> Column:
    """Number of segments of an absolute path."""
    return F.size(F.split(path, "/")) - 1


def is_hidden(path: Column) -> Column:
    return base_name(path).startswith(".")


def is_managed(path: Column, prefix: str) -> Column:
    return base_name(path).startswith(prefix)


def under(path: Column, root: str) -> Column:
    return path.startswith(_slash(root))


def relative(path: Column, root: str) -> Column:
    """Path below ``root``; null when the path is not below it."""
    return F.when(under(path, root), F.substr(path, F.lit(len(_slash(root)) + 1)))


def joined(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p.rstrip("/")) if isinstance(p, str) else p for p in parts])


def ancestors(path: Column, root: str) -> Column:
    """Array of all directories from ``root`` down to the parent of ``path``."""
    base = root.rstrip("/")
    rest = F.split(relative(path, root), "/")
    steps = F.transform(
        F.sequence(F.lit(0), F.size(rest) - 1),
        lambda n: F.when(n == 0, F.lit(base or "/")).otherwise(
            F.concat(F.lit(base + "/"), F.array_join(F.slice(rest, 1, n), "/"))
        ),
    )
    return steps


def sanitize(name: Column) -> Column:
    """Line breaks and tabs become '_', other control characters vanish."""
    return F.regexp_replace(F.translate(name, "\n\r\t", "___"), "[\\x00-\\x1f]", "")


def truncate_middle(path: Column, max_length: int = 80) -> Column:
    room = max_length - 3
    head = room // 2
    return F.when(F.length(path) <= max_length, path).otherwise(
        F.concat(F.left(path, F.lit(head)), F.lit("..."), F.right(path, F.lit(room - head)))
    )


def normalised(path: Column) -> Column:
    """Absolute path without '.', '..' and empty segments."""
    def step(acc: Column, segment: Column) -> Column:
        return (
            F.when(segment.isin("", "."), acc)
            .when(segment == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(segment)))
        )

    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def escapes(path: Column, base: str, link_target: Column | None = None) -> Column:
    """True when the path, or an absolute link target, leaves ``base``."""
    def outside(p: Column) -> Column:
        return ~((p == base.rstrip("/")) | p.startswith(_slash(base)))

    bad = outside(normalised(path))
    if link_target is not None:
        bad = bad | F.coalesce(link_target.startswith("/") & outside(link_target), F.lit(False))
    return bad


def _slash(root: str) -> str:
    return root.rstrip("/") + "/"
