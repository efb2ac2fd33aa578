"""Checks of a plan; each gives rows ``severity, check, subject, message``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.session import staged

ERROR, WARNING = "error", "warning"
LOOP, BROKEN = "loop", "broken"


def _finding(df: DataFrame, severity: str | Column, check: str, subject: Column, message: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(
        severity.alias("severity"), F.lit(check).alias("check"), subject.alias("subject"),
        message.alias("message"),
    )


def check_root(inventory: DataFrame, root: str) -> DataFrame:
    found = inventory.where(paths.under(F.col("path"), root)).limit(1).agg(F.count(F.lit(1)).alias("n"))
    return _finding(
        found.where("n = 0"), ERROR, "root", F.lit(root), F.lit(f"Root directory does not exist: {root}")
    )


def check_plan_errors(errors: DataFrame) -> DataFrame:
    return _finding(errors, ERROR, "plan", F.col("path"), F.col("message"))


def check_space(ops: DataFrame, available_bytes: int, factor: float = 0.1) -> DataFrame:
    """A share of all moved bytes must fit; above nine tenths of the space is a warning."""
    need = ops.agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.coalesce(F.sum("size_bytes"), F.lit(0)) * F.lit(factor)).alias("required")
    ).where("n > 0")
    severity = F.when(F.col("required") > available_bytes, ERROR).when(
        F.col("required") > F.lit(available_bytes) * F.lit(0.9), WARNING
    )
    message = F.concat(
        F.lit("required "), F.col("required").cast("string"), F.lit(f" of {available_bytes} bytes")
    )
    return _finding(need.where(severity.isNotNull()), severity, "space", F.lit("/"), message)


def check_permissions(ops: DataFrame, directories: DataFrame) -> DataFrame:
    """The nearest existing directory at or above every destination folder must be writable.
    ``directories``: ``path, writable``."""
    target = paths.parent(F.col("destination"))
    steps = F.split(target, "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(steps, 1, n), "/")),
    )
    nearest = (
        ops.select(target.alias("folder"), above.alias("above"))
        .distinct()
        .select("folder", F.posexplode("above").alias("depth", "path"))
        .join(directories, "path")
        .groupBy("folder")
        .agg(F.max_by(F.struct("path", "writable"), "depth").alias("at"))
    )
    message = F.when(F.col("at.path") == F.col("folder"), F.lit("No write permission for directory")).otherwise(
        F.lit("No permission to create directory")
    )
    return _finding(nearest.where(~F.col("at.writable")), ERROR, "permission", F.col("folder"), message)


def check_into_itself(ops: DataFrame) -> DataFrame:
    inside = (F.col("destination") == F.col("source")) | F.startswith(
        F.col("destination"), F.concat("source", F.lit("/"))
    )
    return _finding(
        ops.where(inside), ERROR, "circular", F.col("source"), F.concat(F.lit("moves into "), F.col("destination"))
    )


def check_same_target(ops: DataFrame, target: str = "destination") -> DataFrame:
    """Every later operation on one destination, paired with the first one."""
    first = (
        ops.groupBy(target)
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("phase", "source"))["source"].alias("first_source"))
        .where("n > 1")
    )
    clash = ops.join(first, target).where(F.col("source") != F.col("first_source"))
    return _finding(
        clash, ERROR, "same_target", F.col("source"), F.concat_ws(" ", F.col(target), F.lit("first wanted by"), "first_source")
    )


def check_existing_target(ops: DataFrame, existing: DataFrame, target: str = "destination") -> DataFrame:
    hit = ops.where(F.col(target) != F.col("source")).join(
        existing.select(F.col("path").alias(target)), target, "left_semi"
    )
    return _finding(
        hit, WARNING, "existing_target", F.col("source"),
        F.concat(F.col(target), F.lit(" exists (resolution: "), F.col("conflict_resolution"), F.lit(")")),
    )


def check_targets(ops: DataFrame, existing: DataFrame, target: str = "destination") -> DataFrame:
    """`check_existing_target` and `check_same_target` at once: the targets are counted and looked up, one row each, and
    only operations on those that are taken or wanted twice are joined to them."""
    wanted = ops.groupBy(target).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("phase", "source"))["source"].alias("_first"))
    taken = existing.select(F.col("path").alias(target), F.lit(True).alias("_taken"))
    crowded = wanted.join(taken, target, "left").where((F.col("_n") > 1) | F.col("_taken"))
    place, source = F.col(target), F.col("source")

    def finding(when: Column, severity: str, check: str, message: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(severity).alias("severity"), F.lit(check).alias("check"), source.alias("subject"), message.alias("message")))

    found = F.array_compact(F.array(
        finding(F.col("_taken") & (place != source), WARNING, "existing_target",
                F.concat(place, F.lit(" exists (resolution: "), F.col("conflict_resolution"), F.lit(")"))),
        finding((F.col("_n") > 1) & (source != F.col("_first")), ERROR, "same_target",
                F.concat_ws(" ", place, F.lit("first wanted by"), "_first")),
    ))
    return ops.join(crowded, target).select(F.inline(found))


def check_sources(ops: DataFrame, existing: DataFrame) -> DataFrame:
    """Sources must be in the inventory, and files where it has a ``kind`` column."""
    columns = [F.col("path").alias("source"), F.lit(True).alias("_found")]
    kind = F.col("kind") if "kind" in existing.columns else F.lit("file")
    known = existing.select(*columns, kind.alias("_kind"))
    bad = ops.select("source").join(known, "source", "left").where(
        F.col("_found").isNull() | (F.col("_kind") != "file")
    )
    message = F.when(F.col("_found").isNull(), F.lit("Source file does not exist")).otherwise(
        F.lit("Source is not a file")
    )
    return _finding(bad, ERROR, "source", F.col("source"), message)


def unresolved_links(links: DataFrame, existing: DataFrame) -> DataFrame:
    """Links (``path, target``) that lead nowhere: ``path, target, reason``, which is ``loop`` or ``broken``.

    Chains of any length are followed by doubling: after k rounds every link has taken 2^k steps or is at its end. In
    each round some chain ends as long as one has not, so when the number of links that still move stays the same these are
    the ones that run in circles. A chain of n links takes ceil(log2(n)) rounds and one more.
    """
    hops = staged(links.select("path", F.col("target").alias("at")), "links")
    moving = hops.join(hops.select(F.col("path").alias("at")), "at", "left_semi").count()
    while moving:
        onward = hops.select(F.col("path").alias("at"), F.col("at").alias("_to"))
        hops = staged(hops.join(onward, "at", "left").select("path", F.coalesce("_to", "at").alias("at")), "links")
        still = hops.join(hops.select(F.col("path").alias("at")), "at", "left_semi").count()
        if still == moving:
            break
        moving = still
    known = existing.select(F.col("path").alias("at"), F.lit(True).alias("_there"))
    again = links.select(F.col("path").alias("at"), F.lit(True).alias("_link"))
    ends = hops.join(again, "at", "left").join(known, "at", "left").where(
        F.col("_link").isNotNull() | F.col("_there").isNull())
    reason = F.when(F.col("_link").isNotNull(), F.lit(LOOP)).otherwise(F.lit(BROKEN))
    return links.join(ends.select("path", reason.alias("reason")), "path").select("path", "target", "reason")


def check_links(ops: DataFrame, links: DataFrame, existing: DataFrame) -> DataFrame:
    bad = unresolved_links(links, existing).select(F.col("path").alias("source"), "target")
    hit = ops.where("is_symlink").join(bad, "source")
    return _finding(
        hit, WARNING, "link", F.col("source"), F.concat(F.lit("unresolved link to "), F.col("target"))
    )


def validate_plan(
    ops: DataFrame,
    existing: DataFrame,
    root: str,
    *,
    errors: DataFrame | None = None,
    directories: DataFrame | None = None,
    links: DataFrame | None = None,
    available_bytes: int | None = None,
    space_factor: float = 0.1,
    target: str = "destination",
) -> DataFrame:
    """All findings; the plan is valid when none has severity ``error``."""
    checks = [check_root(existing, root)]
    if errors is not None:
        checks.append(check_plan_errors(errors))
    if available_bytes is not None:
        checks.append(check_space(ops, available_bytes, space_factor))
    if directories is not None:
        checks.append(check_permissions(ops, directories))
    checks.append(check_into_itself(ops))
    if links is not None:
        checks.append(check_links(ops, links, existing))
    checks += [check_targets(ops, existing, target), check_sources(ops, existing)]
    return reduce(DataFrame.unionByName, checks)


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "check").agg(F.count(F.lit(1)).alias("findings"))


def is_valid(findings: DataFrame) -> bool:
    return findings.where(F.col("severity") == ERROR).isEmpty()
