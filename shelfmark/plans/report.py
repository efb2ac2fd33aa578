"""Reports on plans and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.config import REASON_DUPLICATE
from shelfmark.functions import paths
from shelfmark.functions.formats import format_duration, format_size, one_decimal
from shelfmark.functions.totals import exact_sum
from shelfmark.operators import dedup
from shelfmark.operators.apply import result_metrics
from shelfmark.plans.planner import ORDER, Plan, categories_used
from shelfmark.skew import HOT_ROWS, row_numbers

OK = ("ok", "overwritten")


def successful(results: DataFrame) -> DataFrame:
    return results.where((F.col("kind") == "file") & F.col("status").isin(*OK))


def failed(results: DataFrame) -> DataFrame:
    return results.where((F.col("kind") == "file") & F.col("status").isin("failed", "mismatch"))


def category_statistics(results: DataFrame, root: str, target: str = "final_destination") -> DataFrame:
    """Files per destination folder name and their share of all moved files, by name."""
    moved = successful(results)
    folder = paths.parent(F.col(target))
    total = moved.agg(F.count(F.lit(1))).scalar()
    return (
        moved.where(folder != root.rstrip("/"))
        .groupBy(paths.base_name(folder).alias("category"))
        .agg(F.count(F.lit(1)).alias("files"))
        .withColumn("percentage", F.concat(one_decimal(F.col("files") / total * 100), F.lit("%")))
        .orderBy("category")
    )


def size_statistics(results: DataFrame, sets: DataFrame) -> DataFrame:
    moved = successful(results).agg(F.coalesce(exact_sum("size_bytes"), F.lit(0)).alias("total_size"))
    wasted = dedup.waste(sets).select("space_recoverable").scalar()
    return moved.withColumn("space_wasted", wasted).select(
        "total_size", format_size(F.col("total_size")).alias("total_size_text"),
        "space_wasted", format_size(F.col("space_wasted")).alias("space_wasted_text"),
    )


def failure_sample(results: DataFrame, limit: int = 10) -> DataFrame:
    """The first failures in order and how many more there are."""
    bad = failed(results)
    total = bad.agg(F.count(F.lit(1))).scalar()
    return (
        bad.orderBy("phase", "source")
        .limit(limit)
        .select(
            paths.base_name(F.col("source")).alias("name"), "source", "error",
            F.greatest(total - F.lit(limit), F.lit(0)).alias("more"),
        )
    )


def custom_categories_used(ops: DataFrame, custom: DataFrame) -> DataFrame:
    """Subcategories of ``custom`` (category, subcategory) that receive an operation."""
    used = ops.where("reason = 'classify'").select("category", "subcategory").distinct()
    return (
        used.join(custom.select("category", "subcategory").distinct(), ["category", "subcategory"], "left_semi")
        .orderBy("category", "subcategory")
    )


def _status(dry_run: bool) -> Column:
    if dry_run:
        return F.lit("DRY RUN ✓")
    return F.when(F.col("complete_success"), "COMPLETED ✓").otherwise("COMPLETED WITH ERRORS")


def summary_report(
    results: DataFrame,
    sets: DataFrame,
    root: str,
    *,
    created: DataFrame | None = None,
    removed: DataFrame | None = None,
    dry_run: bool = False,
    duration_seconds: float | None = None,
) -> DataFrame:
    """Rows ``pos, item, value``; optional items only appear when there is something to say."""
    def size_of(df: DataFrame | None) -> Column:
        return F.lit(0).cast("bigint") if df is None else df.agg(F.count(F.lit(1))).scalar()

    facts = (
        result_metrics(results)
        .withColumn("copies", dedup.waste_struct(sets))
        .withColumn("created", size_of(created))
        .withColumn("removed", size_of(removed))
    )
    some = F.col("copies.sets") > 0
    items: list[tuple[str, Column, Column | None]] = [
        ("Status", _status(dry_run), None),
        ("Root Directory", F.lit(root), None),
        ("Total Files Processed", F.col("files_moved"), None),
        ("Operations Failed", F.col("files_failed"), None),
        ("Success Rate", F.concat(one_decimal(F.col("success_rate")), F.lit("%")), None),
        ("Duplicate Sets Found", F.col("copies.sets"), some),
        ("Duplicate Files", F.col("copies.total_duplicates"), some),
        ("Space Recoverable", format_size(F.col("copies.space_recoverable")), some),
        ("Directories Created", F.col("created"), F.col("created") > 0),
        ("Empty Directories Removed", F.col("removed"), F.col("removed") > 0),
    ]
    if duration_seconds is not None:
        items.insert(5, ("Duration", format_duration(F.lit(duration_seconds)), None))
    rows = F.array(*[
        F.struct(
            F.lit(pos).alias("pos"), F.lit(item).alias("item"), value.cast("string").alias("value"),
            (F.lit(True) if shown is None else shown).alias("shown"),
        )
        for pos, (item, value, shown) in enumerate(items)
    ])
    return facts.select(F.inline(rows)).where("shown").drop("shown")


def duplicates_section(files: DataFrame, sets: DataFrame, max_extras: int = 1000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """JSON documents of the duplicate sets, each with at most ``max_extras`` extras in path order.

    A larger set goes on in further documents: ``part`` of ``parts``. Every extra is in exactly one.
    """
    numbered = row_numbers(dedup.extras(files, sets).select("hash", "path"), ["hash"], ["path"], "_n", hot_rows)
    listed = numbered.groupBy("hash", F.ceil(F.col("_n") / max_extras).alias("part")).agg(
        F.sort_array(F.collect_list("path")).alias("extras"))
    return sets.join(listed, "hash").select(
        "hash", "part",
        F.to_json(
            F.struct(
                "hash", F.col("cnt").alias("count"), "size_bytes", "primary", "extras", "part",
                F.ceil((F.col("cnt") - 1) / max_extras).alias("parts"),
            )
        ).alias("document"),
    )


def operations_section(results: DataFrame) -> DataFrame:
    """One JSON document per operation, for a JSON-lines dataset."""
    done = F.col("status").isin(*OK)
    return results.where(done | F.col("status").isin("failed", "mismatch")).select(
        F.when(done, "successful").otherwise("failed").alias("section"),
        F.to_json(
            F.struct(
                "source", F.col("final_destination").alias("destination"),
                F.when(done, F.col("reason")).alias("reason"),
                F.when(done, F.col("size_bytes")).alias("size_bytes"),
                F.when(~done, F.col("error")).alias("error"),
            )
        ).alias("document"),
    )


def summary_section(
    results: DataFrame, sets: DataFrame, root: str, dry_run: bool = False, duration_seconds: float | None = None
) -> DataFrame:
    """The head of the report as one JSON document."""
    total = F.col("files_moved") + F.col("files_failed")
    return result_metrics(results).withColumn("copies", dedup.waste_struct(sets)).select(
        F.to_json(
            F.struct(
                F.lit("1.0").alias("version"),
                F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("generated_at"),
                F.lit(dry_run).alias("dry_run"),
                F.struct(
                    F.lit(root).alias("root_directory"), total.alias("total_operations"),
                    F.col("files_moved").alias("successful_operations"),
                    F.col("files_failed").alias("failed_operations"), "success_rate",
                    F.lit(duration_seconds).cast("double").alias("duration_seconds"),
                ).alias("summary"),
                F.struct(
                    F.col("copies.sets").alias("sets_found"), F.col("copies.total_duplicates"),
                    F.col("copies.space_recoverable").alias("space_recoverable_bytes"),
                ).alias("duplicates"),
            )
        ).alias("document")
    )


def save_json_report(
    folder: str, results: DataFrame, files: DataFrame, sets: DataFrame, root: str,
    created: DataFrame, removed: DataFrame, dry_run: bool = False, errors: DataFrame | None = None,
    duration_seconds: float | None = None,
) -> None:
    """A folder with one JSON-lines dataset per section, so no section is bounded by a task.

    ``errors``: ``path, message`` of what the plan could not look at.
    """
    head = summary_section(results, sets, root, dry_run, duration_seconds)
    head.write.mode("overwrite").text(f"{folder}/summary")
    duplicates_section(files, sets).select("document").write.mode("overwrite").text(f"{folder}/duplicates")
    operations_section(results).write.mode("overwrite").partitionBy("section").text(f"{folder}/operations")
    created.write.mode("overwrite").json(f"{folder}/directories_created")
    removed.write.mode("overwrite").json(f"{folder}/directories_removed")
    if errors is not None:
        errors.select("path", "message").write.mode("overwrite").json(f"{folder}/errors")


def text_report(
    results: DataFrame, sets: DataFrame, root: str, created: DataFrame, dry_run: bool = False,
    max_directories: int = 50,
) -> DataFrame:
    """Rows ``section, line_no, sort_key, line`` of the report for people."""
    def lines(section: int, df: DataFrame, *texts: Column) -> DataFrame:
        array = F.array(*texts)
        return df.select(
            F.lit(section).alias("section"), F.posexplode(array).alias("line_no", "line")
        ).where(F.col("line").isNotNull()).select(
            "section", "line_no", F.lit("").alias("sort_key"), "line"
        )

    rule, thin = F.lit("=" * 80), F.lit("-" * 80)
    labelled = lambda label, value: F.concat(F.lit(label + ": "), value.cast("string"))
    figures = result_metrics(results)
    total = F.col("files_moved") + F.col("files_failed")
    head = lines(
        0, figures, rule, F.lit("ORGANIZATION REPORT"), rule, labelled("Root Directory", F.lit(root)),
        labelled("Mode", F.lit("DRY RUN" if dry_run else "EXECUTE")), F.lit(""), F.lit("SUMMARY"), thin,
        labelled("Total Operations", total), labelled("Successful", F.col("files_moved")),
        labelled("Failed", F.col("files_failed")),
        F.concat(labelled("Success Rate", one_decimal(F.col("success_rate"))), F.lit("%")), F.lit(""),
    )
    copies = lines(
        1, dedup.waste(sets).where("sets > 0"), F.lit("DUPLICATES"), thin,
        labelled("Duplicate Sets", F.col("sets")), labelled("Duplicate Files", F.col("total_duplicates")),
        labelled("Space Recoverable", format_size(F.col("space_recoverable"))), F.lit(""),
    )
    some_created = created.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    created_head = lines(2, some_created, F.lit("DIRECTORIES CREATED"), thin)
    created_rows = created.orderBy("path").limit(max_directories).select(
        F.lit(3).alias("section"), F.lit(0).alias("line_no"), F.col("path").alias("sort_key"),
        F.concat(F.lit("  + "), F.col("path")).alias("line"),
    )
    more = F.col("n") - max_directories
    created_tail = lines(
        4, some_created, F.when(more > 0, F.concat(F.lit("  ... and "), more.cast("string"), F.lit(" more"))), F.lit("")
    )
    bad = failed(results)
    bad_head = lines(5, bad.limit(1), F.lit("ERRORS"), thin)
    bad_rows = bad.select(
        F.lit(6).alias("section"),
        F.posexplode(
            F.array(
                F.concat(F.lit("  ❌ "), F.col("source")), F.concat(F.lit("     Error: "), F.col("error"))
            )
        ).alias("line_no", "line"),
        F.col("source").alias("sort_key"),
    ).select("section", "line_no", "sort_key", "line")
    tail = lines(7, figures, rule, F.lit("END OF REPORT"), rule)
    return reduce(
        DataFrame.unionByName, [head, copies, created_head, created_rows, created_tail, bad_head, bad_rows, tail]
    )


def preview_report(plan: Plan, limit: int = 50) -> DataFrame:
    """Rows ``section, line_no, sort_key, line`` of what a plan would do, for people.

    The first ``limit`` operations on files and on directories in their order and how many more there are, all errors,
    and the first skipped files of a resolved plan.
    """
    def fixed(section: int, df: DataFrame, *texts: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.posexplode(F.array(*texts)).alias("line_no", "line")).where(
            F.col("line").isNotNull()).select("section", "line_no", F.lit("").alias("sort_key"), "line")

    def listed(section: int, title: str, ops: DataFrame, icon: Column) -> list[DataFrame]:
        n = ops.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        first = ops.orderBy(*ORDER).limit(limit).withColumn("_i", F.row_number().over(Window.orderBy(*ORDER)))
        target = F.concat(F.lit("      -> "), paths.relative(F.col("destination"), plan.root))
        named = F.format_string("%3d. %s %s", "_i", icon, paths.base_name(F.col("source")))
        rows = first.select(
            F.lit(section + 1).alias("section"), F.posexplode(F.array(named, target)).alias("line_no", "line"),
            F.lpad(F.col("_i").cast("string"), 9, "0").alias("sort_key"),
        ).select("section", "line_no", "sort_key", "line")
        more = F.col("n") - limit
        blank = F.lit("") if section > 4 else F.lit(None).cast("string")
        return [
            fixed(section, n, blank, F.lit(f"{title} (showing first {limit}):")), rows,
            fixed(section + 2, n, F.when(more > 0, F.concat(F.lit("      ... and "), more.cast("string"), F.lit(" more")))),
        ]

    def marked(section: int, df: DataFrame, text: str, mark: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.lit(0).alias("line_no"), F.col(text).alias("sort_key"),
                         F.concat(F.lit(f"  {mark} "), F.col(text)).alias("line"))

    rule = F.lit("=" * 80)
    sets = plan.sets if plan.sets is not None else plan.ops.select("hash", F.lit(0).alias("cnt"), F.lit(0).alias("space_wasted")).where("false")
    used = categories_used(plan.ops, plan.root).agg(F.array_join(F.array_sort(F.collect_set("category")), ", ")).scalar()
    facts = plan.ops.agg(F.count(F.lit(1)).alias("files")).withColumn("copies", dedup.waste_struct(sets))
    head = fixed(
        0, facts, rule, F.lit("ORGANIZATION PLAN PREVIEW"), rule, F.lit(f"Root Directory: {plan.root}"),
        F.concat(F.lit("Total Files: "), F.col("files").cast("string")),
        F.concat(F.lit("Duplicate Files: "), F.col("copies.total_duplicates").cast("string")),
        F.format_string("Space Recoverable: %.2f GB", F.col("copies.space_recoverable").cast("double") / 1024**3),
        F.concat(F.lit("Categories: "), used), F.lit(""),
    )
    some_errors = plan.errors.limit(1)
    icon = F.when(F.col("reason") == REASON_DUPLICATE, F.lit("🔁")).otherwise(F.lit("📋"))
    parts = [
        head, fixed(1, some_errors, F.lit("ERRORS:")), marked(2, plan.errors, "message", "❌"), fixed(3, some_errors, F.lit("")),
        *listed(4, "FILE OPERATIONS", plan.ops, icon),
        *listed(7, "DIRECTORY OPERATIONS", plan.dir_ops, F.lit("📁")),
    ]
    if plan.skipped is not None:
        first = plan.skipped.orderBy("path").limit(limit)
        parts += [fixed(10, first.limit(1), F.lit(""), F.lit("SKIPPED FILES:")), marked(11, first, "path", "⊘")]
    parts.append(fixed(12, facts, F.lit(""), rule))
    return reduce(DataFrame.unionByName, parts)


def save_text_report(report: DataFrame, folder: str) -> None:
    """Text files whose names sort in report order; the error list may be of any length."""
    (
        report.repartitionByRange("section", "sort_key", "line_no")
        .sortWithinPartitions("section", "sort_key", "line_no")
        .select("line").write.mode("overwrite").text(folder)
    )
