"""Applying, logging, undoing and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.fixtures import DOC_ROOT, sql
from queries.planning import doc_plan, organizer, resolved_plan
from queries.registry import query
from shelfmark.functions.formats import UNITS
from shelfmark.functions.totals import as_bigint
from shelfmark.operators import apply, dedup
from shelfmark.operators.classify import by_extension
from shelfmark.plans import report
from shelfmark.plans.organizer import resolve_directories
from shelfmark.session import new_folder, staged
from shelfmark.sources import layout, oplog
from shelfmark.sources.rules import default_rules

CREATED = "select distinct regexp_replace(final_destination, '/[^/]*$', '') as path from resolved"
REMOVED = """select path from dirs_before where path not in (select path from dirs_after)
  and regexp_matches(path, '^/corpus/(.*/)?all_[^/]*(/.*)?$') and not starts_with(split_part(path, '/', -1), '.')"""


def run(spark, sf):
    job, plan = resolved_plan(spark, sf)
    return job.apply(plan)


def partial_run(spark, sf):
    """A run whose inventory lost one file in sixteen between planning and applying."""
    outcome = run(spark, sf)
    rest = outcome.plan.inventory.where("hash >= '1'")
    return outcome, apply.operation_results(outcome.plan.resolved, rest)


_PARTIAL = "select *, case when hash >= '1' then 'ok' else 'failed' end as status from resolved"


@query("apply_plan", sql("select path, size_bytes, hash from after", "after"))
def apply_plan(spark, sf):
    return run(spark, sf).inventory.select("path", "size_bytes", "hash")


@query("operation_results", sql(
    f"""select source, final_destination, status,
          case when status = 'failed' then 'Source file does not exist: ' || source end as error
        from ({_PARTIAL})""", "resolved"))
def operation_results(spark, sf):
    return partial_run(spark, sf)[1].select("source", "final_destination", "status", "error")


_LIVE = """present as (select * from doc where hash >= '1'),
  live as (select o.* from ops o join present p on p.path = o.source),
  chosen as (select destination, {pick}(source, phase || source) as winner from live group by destination)"""


def with_live(pick: str, body: str) -> str:
    text = sql("BODY", "ops", "doc")
    return text.replace("\nBODY", ",\n" + _LIVE.format(pick=pick) + "\n" + body)


def later_inventory(spark, sf, how):
    """A run that finds one file in sixteen gone between planning and applying."""
    job, plan = resolved_plan(spark, sf, conflict_resolution=how)
    rest = staged(plan.inventory.where("hash >= '1'"), "rest")
    pairs = job.apply(plan, inventory=rest).pairs
    return apply.inventory_of(pairs, replaces=how == "overwrite").select("path", "hash")


@query("apply_overwrite_partial", with_live("arg_max", """
select coalesce(l.destination, p.path) as path, p.hash from present p left join live l on l.source = p.path
left join chosen w on w.destination = l.destination
where l.source = w.winner or l.source is null and p.path not in (select destination from chosen)"""))
def apply_overwrite_partial(spark, sf):
    return later_inventory(spark, sf, "overwrite")


@query("apply_skip_partial", with_live("arg_min", """
select case when l.source = w.winner and l.destination not in (select path from doc) then l.destination else p.path end as path,
  p.hash
from present p left join live l on l.source = p.path left join chosen w on w.destination = l.destination"""))
def apply_skip_partial(spark, sf):
    return later_inventory(spark, sf, "skip")


@query("directories_created", sql(CREATED, "resolved"))
def directories_created(spark, sf):
    return run(spark, sf).created


@query("apply_directory_ops", sql(
    """select old_path, path from (select m.path as old_path, coalesce(o.destination || substr(m.path, length(o.source) + 1), m.path)
         as path from doc m left join dirops o on starts_with(m.path, o.source || '/')) where old_path <> path""",
    "doc", "dirops"))
def apply_directory_ops(spark, sf):
    plan = doc_plan(spark, sf)
    results = resolve_directories(plan).withColumn("status", F.lit("ok"))
    inventory = plan.inventory.withColumn("old_path", F.col("path"))
    return apply.apply_directories(inventory, results, DOC_ROOT).where("path <> old_path").select("old_path", "path")


@query("empty_dirs_removed", sql(REMOVED, "dirs_before", "dirs_after"))
def empty_dirs_removed(spark, sf):
    return run(spark, sf).removed


@query("result_metrics", sql(
    f"""select count(*) filter (status = 'ok') as files_moved, count(*) filter (status = 'failed') as files_failed,
          count(*) filter (status = 'ok') / count(*) * 100 as success_rate,
          count(*) filter (status = 'failed') = 0 as complete_success from ({_PARTIAL})""", "resolved"))
def result_metrics(spark, sf):
    return apply.result_metrics(partial_run(spark, sf)[1])


@query("oplog_roundtrip", sql(
    """select 'run-1' as run_id, phase, source, final_destination as destination from resolved
       union all select 'run-1', 4, source, destination from dirops""", "resolved", "dirops"))
def oplog_roundtrip(spark, sf):
    folder = new_folder(spark, "log")
    outcome = run(spark, sf)
    organizer(spark).write_log(outcome, folder, "run-1")
    return oplog.read_log(spark, folder).select("run_id", "phase", "source", "destination")


@query("read_oplog", sql(
    "select '/corpus' as root_dir, regexp_replace(source, '/[^/]*$', '') as folder, count(*) as moves from resolved group by folder",
    "resolved"))
def read_oplog(spark, sf):
    """One log document per source folder, as a run over many small roots would leave them."""
    folder = new_folder(spark, "json-log")
    moves = run(spark, sf).plan.resolved.select(
        F.regexp_replace("source", "/[^/]*$", "").alias("folder"), "source", F.col("final_destination").alias("destination")
    )
    documents = moves.groupBy("folder").agg(
        F.to_json(
            F.struct(
                F.lit("1.0").alias("version"), F.lit("2024-01-01T00:00:00").alias("timestamp"),
                F.lit(DOC_ROOT).alias("root_dir"),
                F.collect_list(
                    F.struct(F.lit("2024-01-01T00:00:00").alias("timestamp"), "source", "destination")
                ).alias("operations"),
            )
        ).alias("value")
    )
    documents.select("folder", "value").write.partitionBy("folder").text(folder)
    rows = oplog.read_json_log(spark, folder)
    return rows.groupBy(
        "root_dir", F.regexp_replace("source", "/[^/]*$", "").alias("folder")
    ).agg(F.count("op_pos").alias("moves"))


def undone(spark, sf):
    """A run whose result lost one file in sixteen is undone."""
    outcome = run(spark, sf)
    log = oplog.log_rows(outcome.results, "run-1")
    return apply.undo(staged(outcome.inventory.where("hash >= '1'"), "published"), log, DOC_ROOT)


@query("undo_plan", sql("select path, hash from doc where hash >= '1'", "doc"))
def undo_plan(spark, sf):
    return undone(spark, sf)[0].select("path", "hash")


@query("undo_counts", sql(
    """select (select count(*) from resolved where hash >= '1')
         + (select count(distinct top) from scoped where scope = 'directory' and hash >= '1') as successful,
       (select count(*) from resolved where hash < '1') + (select count(*) from dirops)
         - (select count(distinct top) from scoped where scope = 'directory' and hash >= '1') as failed""",
    "resolved", "dirops", "scoped"))
def undo_counts(spark, sf):
    return apply.undo_counts(undone(spark, sf)[1])


@query("organized_layout", sql(
    "select category, subcategory, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from ranked where rk = 1 group by all",
    "ranked"))
def organized_layout(spark, sf):
    from queries.placing import doc_files

    contents = dedup.by_content(doc_files(spark, sf))
    placed = by_extension(contents, default_rules(spark)).select("path", "size_bytes", "hash", "category", "subcategory")
    folder = new_folder(spark, "layout")
    layout.write_layout(placed, folder)
    files = layout.read_layout(spark, folder, "path string, size_bytes bigint, hash string")
    return files.groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


# --- reports ----------------------------------------------------------------------------------


@query("category_statistics", sql(
    """select split_part(final_destination, '/', -2) as category, count(*) as files,
         printf('%.1f', count(*) / (select count(*) from resolved) * 100) || '%' as percentage
       from resolved group by split_part(final_destination, '/', -2)""", "resolved"))
def category_statistics(spark, sf):
    return report.category_statistics(run(spark, sf).file_results, DOC_ROOT)


def _size_text(x: str) -> str:
    whens = " ".join(
        f"when {x} < {1024 ** (n + 1)} then printf('%.1f', {x} / {1024**n}.0::double) || ' {unit}'"
        for n, unit in enumerate(UNITS[:-1])
    )
    return f"case {whens} else printf('%.1f', {x} / {1024**5}.0::double) || ' PB' end"


@query("size_statistics", sql(
    f"""select total_size, {_size_text('total_size')} as total_size_text, space_wasted,
          {_size_text('space_wasted')} as space_wasted_text
        from (select (select cast(sum(size_bytes) as bigint) from resolved) as total_size,
                     (select cast(sum(space_wasted) as bigint) from sets) as space_wasted)""", "resolved", "sets"))
def size_statistics(spark, sf):
    outcome = run(spark, sf)
    return as_bigint(report.size_statistics(outcome.file_results, outcome.plan.sets), "total_size", "space_wasted")


@query("failure_sample", sql(
    f"""select split_part(source, '/', -1) as name, source, 'Source file does not exist: ' || source as error,
          greatest((select count(*) from resolved where hash < '1') - 10, 0) as more
        from ({_PARTIAL}) where status = 'failed' order by phase, source limit 10""", "resolved"))
def failure_sample(spark, sf):
    return report.failure_sample(partial_run(spark, sf)[1], 10)


@query("summary_report", sql(
    f"""with_facts as (select (select count(*) from resolved) as moved, (select count(*) from sets) as sets,
          (select cast(sum(cnt - 1) as bigint) from sets) as extra, (select cast(sum(space_wasted) as bigint) from sets) as bytes,
          (select count(*) from ({CREATED})) as created, (select count(*) from ({REMOVED})) as removed)
        select 0 as pos, 'Status' as item, 'COMPLETED ✓' as value from with_facts
        union all select 1, 'Root Directory', '/corpus'
        union all select 2, 'Total Files Processed', cast(moved as varchar) from with_facts
        union all select 3, 'Operations Failed', '0'
        union all select 4, 'Success Rate', '100.0%'
        union all select 5, 'Duplicate Sets Found', cast(sets as varchar) from with_facts where sets > 0
        union all select 6, 'Duplicate Files', cast(extra as varchar) from with_facts where sets > 0
        union all select 7, 'Space Recoverable', {_size_text('bytes')} from with_facts where sets > 0
        union all select 8, 'Directories Created', cast(created as varchar) from with_facts where created > 0
        union all select 9, 'Empty Directories Removed', cast(removed as varchar) from with_facts where removed > 0""",
    "resolved", "sets", "dirs_before", "dirs_after").replace("\nwith_facts as", ",\nwith_facts as", 1))
def summary_report(spark, sf):
    outcome = run(spark, sf)
    return report.summary_report(
        outcome.file_results, outcome.plan.sets, DOC_ROOT, created=outcome.created, removed=outcome.removed
    )


@query("report_duplicates_section", sql(
    """select s.hash, s.cnt as count, s.size_bytes, s."primary", string_agg(r.path, '|' order by r.path) as extras
       from sets s join ranked r on r.hash = s.hash and r.rk > 1 group by all""", "sets", "ranked"))
def report_duplicates_section(spark, sf):
    from queries.copies import doc_sets

    documents = report.duplicates_section(*doc_sets(spark, sf))
    parsed = F.from_json(
        "document", "count bigint, size_bytes bigint, primary string, extras array<string>"
    )
    return documents.select("hash", parsed.alias("d")).select(
        "hash", "d.count", "d.size_bytes", "d.primary", F.array_join("d.extras", "|").alias("extras")
    )


@query("report_large_sets", sql(
    """select lang, (n - 2) // 7 + 1 as part, (max(total) + 5) // 7 as parts, count(*) as extras, min(path) as first, max(path) as last
       from (select lang, path, count(*) over (partition by lang) as total,
               row_number() over (partition by lang order by pos <> 1, path) as n
             from (select *, row_number() over (partition by lang order by length(path), modified_time, path) as pos from doc))
       where n > 1 group by lang, (n - 2) // 7""", "doc"))
def report_large_sets(spark, sf):
    """Sets far larger than a document lists, as if all files of a language were copies; nothing is left out."""
    from queries import fixtures as fx

    files = fx.doc(spark, sf).withColumn("hash", F.col("lang"))
    documents = report.duplicates_section(files, dedup.duplicate_sets(dedup.by_content(files)), 7, hot_rows=100)
    parsed = F.from_json("document", "hash string, extras array<string>, part bigint, parts bigint")
    return documents.select(parsed.alias("d")).select(
        F.col("d.hash").alias("lang"), "d.part", "d.parts", F.size("d.extras").cast("bigint").alias("extras"),
        F.col("d.extras")[0].alias("first"), F.element_at("d.extras", -1).alias("last"))


def _lines(section: int, texts: str, source: str) -> str:
    return f"""select {section}::int as section, unnest(range(len(l)))::int as line_no, '' as sort_key, unnest(l) as line
      from (select [{texts}] as l from {source})"""


@query("report_text", sql(
    f"""created as (select path, row_number() over (order by path) as n from ({CREATED})),
        counts as (select (select count(*) from created) as dirs, (select count(*) from resolved) as moved,
          (select count(*) from sets) as sets, (select cast(sum(cnt - 1) as bigint) from sets) as extra,
          (select cast(sum(space_wasted) as bigint) from sets) as bytes)
        {_lines(0, """repeat('=', 80), 'ORGANIZATION REPORT', repeat('=', 80), 'Root Directory: /corpus', 'Mode: EXECUTE', '',
          'SUMMARY', repeat('-', 80), 'Total Operations: ' || moved, 'Successful: ' || moved, 'Failed: 0',
          'Success Rate: 100.0%', ''""", "counts")}
        union all {_lines(1, f"""'DUPLICATES', repeat('-', 80), 'Duplicate Sets: ' || sets, 'Duplicate Files: ' || extra,
          'Space Recoverable: ' || {_size_text('bytes')}, ''""", "counts where sets > 0")}
        union all {_lines(2, "'DIRECTORIES CREATED', repeat('-', 80)", "counts where dirs > 0")}
        union all select 3, 0, path, '  + ' || path from created where n <= 50
        union all select 4, 0, '', '  ... and ' || (dirs - 50) || ' more' from counts where dirs > 50
        union all select 4, 1, '', '' from counts where dirs > 0
        union all {_lines(7, "repeat('=', 80), 'END OF REPORT', repeat('=', 80)", "counts")}""",
    "resolved", "sets").replace("\ncreated as", ",\ncreated as", 1))
def report_text(spark, sf):
    outcome = run(spark, sf)
    return report.text_report(outcome.file_results, outcome.plan.sets, DOC_ROOT, outcome.created)


def _listing(section: int, title: str, ops: str, icon: str) -> str:
    blank = "''" if section > 4 else "null"
    return f"""select section::int as section, line_no::int as line_no, '' as sort_key, line from (
          select {section} as section, unnest([0, 1]) as line_no, unnest([{blank}, '{title} (showing first 20):']) as line
          from (select count(*) as n from {ops}) where n > 0) where line is not null
        union all select {section + 1}, unnest([0, 1]), lpad(n::varchar, 9, '0'), unnest([
          lpad(n::varchar, 3, ' ') || '. ' || {icon} || ' ' || split_part(source, '/', -1),
          '      -> ' || substr(destination, 9)])
          from (select *, row_number() over (order by source_order, source) as n from {ops}) where n <= 20
        union all select {section + 2}, 0, '', '      ... and ' || (n - 20) || ' more' from (select count(*) as n from {ops}) where n > 20"""


@query("preview_report", sql(
    f"""file_ops as (select *, phase as source_order from ops), folder_ops as (select *, 4 as source_order from dirops),
        passed as (select o.source from ops o join crowded c using (destination) where o.source <> c.first_source),
        facts as (select (select count(*) from ops) as files, (select cast(sum(cnt - 1) as bigint) from sets) as extra,
          (select cast(sum(space_wasted) as bigint) from sets) as bytes,
          (select string_agg(c, ', ' order by c) from (select distinct split_part(destination, '/', -2) as c from ops)) as used)
        {_lines(0, """repeat('=', 80), 'ORGANIZATION PLAN PREVIEW', repeat('=', 80), 'Root Directory: /corpus',
          'Total Files: ' || files, 'Duplicate Files: ' || extra,
          'Space Recoverable: ' || printf('%.2f', bytes / 1073741824.0::double) || ' GB', 'Categories: ' || used, ''""", "facts")}
        union all {_listing(4, "FILE OPERATIONS", "file_ops", "case when phase = 1 then '🔁' else '📋' end")}
        union all {_listing(7, "DIRECTORY OPERATIONS", "folder_ops", "'📁'")}
        union all {_lines(10, "'', 'SKIPPED FILES:'", "(select 1 from passed limit 1)")}
        union all select 11, 0, source, '  ⊘ ' || source from (select source from passed order by source limit 20)
        union all {_lines(12, "'', repeat('=', 80)", "facts")}""",
    "ops", "dirops", "sets", "crowded").replace("\nfile_ops as", ",\nfile_ops as", 1))
def preview_report(spark, sf):
    """What a run that skips taken names would do: files, directories, skipped files."""
    _, plan = resolved_plan(spark, sf, conflict_resolution="skip")
    return report.preview_report(plan, 20)
