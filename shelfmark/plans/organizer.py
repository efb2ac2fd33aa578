"""The whole run: plan, resolve, validate, apply, report, undo."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.config import JobConfig
from shelfmark.operators import apply, dedup, scope, validate
from shelfmark.operators.classify import Classifier
from shelfmark.plans import planner
from shelfmark.plans.planner import Plan
from shelfmark.session import staged
from shelfmark.sources import hashing, oplog
from shelfmark.sources.mime import sniffed_mime
from shelfmark.sources.rules import default_rules, override_categories, rules_from_mapping
from shelfmark.sources.scan import list_files


@dataclass(frozen=True)
class Outcome:
    """An applied run. Its tables are built when first asked for."""

    plan: Plan
    pairs: DataFrame
    file_results: DataFrame
    dry_run: bool = False
    before: DataFrame | None = None

    @cached_property
    def dir_results(self) -> DataFrame:
        return resolve_directories(self.plan).withColumn(
            "status", F.when(F.col("status") == "planned", "ok").otherwise(F.col("status"))
        )

    @cached_property
    def results(self) -> DataFrame:
        return self.file_results.unionByName(self.dir_results)

    @cached_property
    def inventory(self) -> DataFrame:
        """The inventory after the run."""
        if self.dry_run:
            return self.before
        moved = apply.inventory_of(self.pairs, replaces=self.plan.cfg.conflict_resolution == "overwrite")
        return apply.apply_directories(moved, self.dir_results, self.plan.root)

    @cached_property
    def created(self) -> DataFrame:
        created = apply.directories_created(self.file_results)
        return created.where(F.lit(not self.dry_run))

    @cached_property
    def removed(self) -> DataFrame:
        return apply.empty_directories(
            self.before, self.inventory, self.plan.root, self.plan.cfg.directory_prefix
        ).where(F.lit(not self.dry_run))

    def metrics(self) -> DataFrame:
        return apply.result_metrics(self.file_results)


def resolve_directories(plan: Plan) -> DataFrame:
    """Final places of the directories that move as a whole."""
    how = plan.cfg.conflict_resolution
    home = plan.root.rstrip("/") + "/" + plan.cfg.managed_name(plan.cfg.folders_folder)
    folders = apply.child_directories(plan.inventory, home)
    if how != "overwrite":
        return planner.resolve(plan.dir_ops, folders, how)
    # A directory cannot be replaced by another one.
    taken = folders.select(F.col("path").alias("final_destination"), F.lit(True).alias("_taken"))
    return (
        planner.resolve(plan.dir_ops, folders, how)
        .join(taken, "final_destination", "left")
        .withColumn("error", F.when(F.col("_taken"), F.concat(F.lit("Cannot overwrite "), "final_destination")))
        .withColumn("status", F.when(F.col("_taken"), "failed").otherwise(F.col("status")))
        .drop("_taken")
    )


class Organizer:
    """Plans and applies runs over an inventory.

    The methods return lazy tables, except `scan`, `resolve` and `apply`: these write what later
    steps read several times (the hashed inventory, the operations, the results), and `resolve`
    measures how crowded the destinations are. ``on_progress(step, rows)`` is called after each of these writes.
    """

    def __init__(
        self,
        spark: SparkSession,
        cfg: JobConfig | None = None,
        rules: DataFrame | None = None,
        classifier: Classifier | None = None,
        on_progress: Callable[[str, int], None] | None = None,
    ) -> None:
        self.spark = spark
        self.on_progress = on_progress
        self.cfg = cfg or JobConfig()
        self.classifier = classifier
        if rules is None:
            rules = default_rules(spark)
            if self.cfg.classification_rules:
                rules = override_categories(rules, rules_from_mapping(spark, self.cfg.classification_rules))
        self.rules = rules

    def scan(self, root: str) -> DataFrame:
        """Lists, filters and hashes the files below ``root``; written once, since hashing reads the contents.

        Files outside the scope are listed but never read. Of the others those are read that may have a copy, or all
        with ``verify_integrity``; with ``use_magic`` also the head of each, of which only the type is kept (``mime``).
        """
        cfg = self.cfg
        listed = staged(scope.with_scope(list_files(self.spark, root), root, cfg), "listed", self.on_progress)
        inside = listed.where((F.col("scope") == scope.FILE) & F.col("error").isNull()).drop("scope", "top")
        hashed = hashing.hash_files(
            inside, cfg.hash_algorithm, cfg.hash_block_size, all_files=cfg.verify_integrity)
        if cfg.use_magic:
            # Written in between: else every task holds two Python workers, one that hashes and one that reads heads.
            hashed = hashing.with_heads(staged(hashed, "hashed")).withColumn("mime", sniffed_mime(F.col("head"))).drop("head")
        rest = listed.where((F.col("scope") != scope.FILE) | F.col("error").isNotNull()).drop("scope", "top")
        return staged(hashed.unionByName(rest, allowMissingColumns=True), "inventory", self.on_progress)

    def plan(self, inventory: DataFrame, root: str) -> Plan:
        return planner.build_plan(inventory, root.rstrip("/") or "/", self.cfg, self.rules, self.classifier)

    def resolve(self, plan: Plan) -> Plan:
        ops = staged(plan.ops, "ops", self.on_progress)
        resolved = staged(planner.resolve(ops, plan.inventory, self.cfg.conflict_resolution), "resolved", self.on_progress)
        return plan.with_(
            ops=ops,
            resolved=resolved,
            skipped=resolved.where(F.col("status") == "skipped").select(F.col("source").alias("path")),
        )

    def validate(
        self,
        plan: Plan,
        *,
        available_bytes: int | None = None,
        directories: DataFrame | None = None,
        links: DataFrame | None = None,
    ) -> DataFrame:
        """Findings on a plan; a resolved one is judged by its final destinations."""
        ops, target = plan.ops, "destination"
        if plan.resolved is not None:
            ops, target = plan.resolved.where(F.col("status") == "planned"), "final_destination"
        return validate.validate_plan(
            ops, plan.inventory, plan.root, errors=plan.errors, directories=directories, links=links,
            available_bytes=available_bytes, space_factor=self.cfg.space_factor, target=target,
        )

    def apply(self, plan: Plan, dry_run: bool = False, inventory: DataFrame | None = None) -> Outcome:
        """A dry run gives the same results and leaves the inventory as it is.

        ``inventory`` is what is there by now, if that is not what was planned on: an operation whose source has gone
        fails, and where several wanted one destination the next of them gets it.
        """
        if plan.resolved is None:
            plan = self.resolve(plan)
        before = plan.inventory if inventory is None else inventory
        pairs = staged(apply.matched(plan.resolved, before, self.cfg.conflict_resolution), "results", self.on_progress)
        return Outcome(plan, pairs, apply.results_of(pairs), dry_run, before)

    def verify(self, outcome: Outcome, rescan: DataFrame | None = None) -> Outcome:
        """Marks operations whose content at the destination is not what was planned.

        Without ``rescan`` the destinations are read anew, each of them; a run without ``verify_integrity`` has no digest
        of files that it did not read, and these stay as they are. ``rescan`` (path, hash) stands for such a reading.
        """
        results = outcome.file_results
        moved = results.where((F.col("status") == "ok") & F.col("hash").isNotNull()).select(
            F.col("final_destination").alias("path"), "size_bytes", "hash")
        if rescan is None:
            checked = hashing.verify_contents(moved, self.cfg.hash_algorithm, self.cfg.hash_block_size)
        else:
            checked = dedup.verify_planned(moved, rescan)
        bad = staged(checked.where(F.col("status").isin("mismatch", "missing")).select(
            F.col("path").alias("final_destination"),
            F.concat(F.lit("Integrity verification failed: "), F.col("status")).alias("_bad"),
        ), "integrity")
        marked = (
            results.join(bad, "final_destination", "left")
            .withColumn("_bad", F.when(F.col("status") == "ok", F.col("_bad")))
            .withColumn("error", F.coalesce("_bad", "error"))
            .withColumn("status", F.when(F.col("_bad").isNotNull(), "mismatch").otherwise(F.col("status")))
            .drop("_bad")
        )
        return replace(outcome, file_results=marked)

    def write_log(self, outcome: Outcome, folder: str, run_id: str) -> None:
        """To be called before the new inventory is published. A dry run writes nothing."""
        if not outcome.dry_run:
            oplog.write_log(oplog.log_rows(outcome.results, run_id), folder)

    def undo(self, inventory: DataFrame, log: DataFrame, run_id: str, root: str) -> tuple[DataFrame, DataFrame]:
        return apply.undo(inventory, log.where(F.col("run_id") == run_id), root)
