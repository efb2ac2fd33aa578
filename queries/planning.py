"""Plans, conflicts and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixtures as fx
from queries.fixtures import DOC_ROOT, sql
from queries.placing import custom_rule_table
from queries.registry import query
from shelfmark.config import JobConfig
from shelfmark.functions.totals import as_bigint
from shelfmark.operators import apply, validate
from shelfmark.plans import planner, report
from shelfmark.plans.organizer import Organizer
from shelfmark.session import staged

INVENTORY = ["path", "size_bytes", "hash", "modified_time", "is_symlink"]


def doc_inventory(spark, sf):
    """The documents as an inventory table: contents are hashed once and then left alone."""
    return staged(fx.doc(spark, sf).select(*INVENTORY), "inventory")


def organizer(spark, **changes):
    return Organizer(spark, JobConfig(**changes))


def doc_plan(spark, sf, **changes):
    return organizer(spark, **changes).plan(doc_inventory(spark, sf), DOC_ROOT)


@query("plan_duplicate_ops", sql("select source, destination, hash from ops where phase = 1", "ops"))
def plan_duplicate_ops(spark, sf):
    return doc_plan(spark, sf).ops.where("reason = 'duplicate'").select("source", "destination", "hash")


@query("plan_classify_ops", sql("select phase, source, destination from ops where phase > 1", "ops"))
def plan_classify_ops(spark, sf):
    return doc_plan(spark, sf).ops.where("reason = 'classify'").select("phase", "source", "destination")


@query("plan_directory_ops", sql("select * from dirops", "dirops"))
def plan_directory_ops(spark, sf):
    return doc_plan(spark, sf).dir_ops.select("source", "destination")


@query("full_plan", sql(
    """select phase, source, destination, reason from ops
       union all select 4, source, destination, 'organize_folder' from dirops""", "ops", "dirops"))
def full_plan(spark, sf):
    plan = doc_plan(spark, sf)
    return plan.ops.unionByName(plan.dir_ops).select("phase", "source", "destination", "reason")


@query("destination_conflicts", sql(
    "select destination, n_ops, occupied, first_source, last_source from crowded", "crowded"))
def destination_conflicts(spark, sf):
    plan = doc_plan(spark, sf)
    return planner.destination_conflicts(plan.ops, plan.inventory)


def resolved_plan(spark, sf, **changes):
    job = organizer(spark, **changes)
    return job, job.resolve(job.plan(doc_inventory(spark, sf), DOC_ROOT))


@query("resolve_rename", sql("select phase, source, final_destination from resolved", "resolved"))
def resolve_rename(spark, sf):
    return resolved_plan(spark, sf)[1].resolved.select("phase", "source", "final_destination")


_SKIP = """select o.*, case when o.source <> c.first_source then 'skipped' when c.occupied then 'failed' else 'planned' end
  as status from ops o left join crowded c using (destination)"""


@query("resolve_skip", sql(
    f"select source, destination as final_destination, coalesce(status, 'planned') as status from ({_SKIP})",
    "ops", "crowded"))
def resolve_skip(spark, sf):
    plan = resolved_plan(spark, sf, conflict_resolution="skip")[1]
    return plan.resolved.select("source", "final_destination", "status")


@query("resolve_overwrite", sql(
    """select o.source, o.destination as final_destination,
         case when o.source <> c.last_source then 'overwritten' else 'planned' end as status
       from ops o left join crowded c using (destination)""", "ops", "crowded"))
def resolve_overwrite(spark, sf):
    plan = resolved_plan(spark, sf, conflict_resolution="overwrite")[1]
    return plan.resolved.select("source", "final_destination", "status")


@query("plan_metrics", sql(
    """select (select count(*) from ops) as total_files, (select count(*) from sets) as duplicate_sets,
         (select cast(sum(cnt - 1) as bigint) from sets) as total_duplicates,
         (select cast(sum(space_wasted) as bigint) from sets) as space_recoverable,
         (select count(distinct split_part(destination, '/', -2)) from ops) as categories_used""", "ops", "sets"))
def plan_metrics(spark, sf):
    plan = doc_plan(spark, sf)
    return as_bigint(planner.plan_metrics(plan.ops, plan.sets, DOC_ROOT), "space_recoverable")


@query("categories_used", sql("select distinct split_part(destination, '/', -2) as category from ops", "ops"))
def categories_used(spark, sf):
    return planner.categories_used(doc_plan(spark, sf).ops, DOC_ROOT)


@query("preview_topn", sql(
    """select phase, reason, source, substr(destination, 9) as target, (select count(*) from ops) - 50 as more
       from ops order by phase, source limit 50""", "ops"))
def preview_topn(spark, sf):
    return planner.preview(doc_plan(spark, sf).ops, DOC_ROOT, 50)


@query("custom_categories_used", sql(
    """select distinct split_part(place, '/', 1) as category, split_part(place, '/', 2) as subcategory from (
         select case when ext = '.xyz' then 'Docs/Papers' when ext = '.py' then 'Lab/Scripts' end as place, *
         from ranked) where rk = 1 and place is not null""", "ranked"))
def custom_categories_used(spark, sf):
    rules = custom_rule_table(spark)
    plan = Organizer(spark, rules=rules).plan(doc_inventory(spark, sf), DOC_ROOT)
    custom = rules.where("category = 'Lab' or subcategory = 'Papers'")
    return report.custom_categories_used(plan.ops, custom)


# --- validation -------------------------------------------------------------------------------

SPACE = 10_000
_FINDING = "select '{severity}' as severity, '{check}' as \"check\", "
_ABOVE = """select folder, arg_max(s.path, length(s.path)) as nearest, arg_max(s.writable, length(s.path)) as writable
  from (select distinct regexp_replace(destination, '/[^/]*$', '') as folder from ops) o
  join state s on o.folder = s.path or starts_with(o.folder, s.path || '/') group by folder"""
_SPACE_SQL = f"""select case when required > {SPACE} then 'error' else 'warning' end as severity, 'space' as "check",
    '/' as subject, 'required ' || required || ' of {SPACE} bytes' as message
  from (select cast(floor(sum(size_bytes) * 0.1::double) as bigint) as required from ops) where required > {SPACE} * 0.9"""
_PERMISSION_SQL = _FINDING.format(severity="error", check="permission") + f"""folder as subject,
    case when nearest = folder then 'No write permission for directory' else 'No permission to create directory' end as message
  from ({_ABOVE}) where not writable"""
_SAME_SQL = _FINDING.format(severity="error", check="same_target") + """o.source as subject,
    o.destination || ' first wanted by ' || c.first_source as message
  from ops o join crowded c using (destination) where c.n_ops > 1 and o.source <> c.first_source"""
_EXISTING_SQL = _FINDING.format(severity="warning", check="existing_target") + """source as subject,
    destination || ' exists (resolution: rename)' as message from ops where destination in (select path from doc)"""
_LINK_WALK = """links as (
    select s.path, case when s.k % 10 = 5 or t.path is null then '/corpus/none' else t.path end as target
    from (select path, doc_id // 97 as k, case when (doc_id // 97) % 5 = 0 then doc_id + 1
            when (doc_id // 97) % 5 = 3 then doc_id else doc_id - 97 end as target_id from doc where is_symlink) s
    left join doc t on t.doc_id = s.target_id),
  chain as (select path, target as at, 1 as steps from links
    union all select c.path, l.target, c.steps + 1 from chain c join links l on l.path = c.at where c.steps <= (select count(*) from links)),
  bad as (select path, target from links where path not in (
    select c.path from chain c join doc d on d.path = c.at where c.at not in (select path from links)))"""
_LINK_SQL = _FINDING.format(severity="warning", check="link") + """o.source as subject,
    'unresolved link to ' || b.target as message from {ops} o join bad b on b.path = o.source"""


def with_links(body: str, *names: str) -> str:
    text = sql(body, *names)
    head, tail = text.split("\n" + body.strip(), 1)
    return head.replace("with ", "with recursive ", 1) + ",\n" + _LINK_WALK + "\n" + body.strip() + tail


@query("validate_space", sql(_SPACE_SQL, "ops"))
def validate_space(spark, sf):
    return validate.check_space(doc_plan(spark, sf).ops, SPACE)


@query("validate_permissions", sql(_PERMISSION_SQL, "ops", "state"))
def validate_permissions(spark, sf):
    plan = doc_plan(spark, sf)
    return validate.check_permissions(plan.ops, state(plan.inventory))


def state(inventory):
    folders = apply.known_directories(inventory, DOC_ROOT)
    return folders.withColumn("writable", F.length("path") % 3 != 0)


@query("validate_circular", sql(
    _FINDING.format(severity="error", check="circular") + """source as subject, 'moves into ' || destination as message
      from (select source, case when phase = 3 then source || '/' || split_part(source, '/', -1) else destination end
              as destination from ops) where starts_with(destination, source || '/')""", "ops"))
def validate_circular(spark, sf):
    """The primaries are sent into themselves."""
    wrong = F.concat_ws("/", "source", F.substring_index("source", "/", -1))
    ops = doc_plan(spark, sf).ops.withColumn(
        "destination", F.when(F.col("phase") == 3, wrong).otherwise(F.col("destination"))
    )
    return validate.check_into_itself(ops)


@query("validate_same_target", sql(_SAME_SQL, "ops", "crowded"))
def validate_same_target(spark, sf):
    return validate.check_same_target(doc_plan(spark, sf).ops)


@query("validate_existing_target", sql(_EXISTING_SQL, "ops", "doc"))
def validate_existing_target(spark, sf):
    plan = doc_plan(spark, sf)
    return validate.check_existing_target(plan.ops, plan.inventory)


@query("validate_sources", sql(
    _FINDING.format(severity="error", check="source") + """source as subject, case when hash < '1'
        then 'Source file does not exist' else 'Source is not a file' end as message from ops where hash < '2'""", "ops"))
def validate_sources(spark, sf):
    """A sixteenth of the inventory is gone and another one turned into directories."""
    plan = doc_plan(spark, sf)
    now = plan.inventory.where("hash >= '1'").withColumn(
        "kind", F.when(F.col("hash") < "2", "directory").otherwise("file")
    )
    return validate.check_sources(plan.ops, now)


@query("validate_links", with_links(_LINK_SQL.format(ops="(select path as source from doc where is_symlink)"), "doc"))
def validate_links(spark, sf):
    inventory = doc_inventory(spark, sf)
    ops = inventory.withColumnRenamed("path", "source")
    return validate.check_links(ops, fx.links(spark, sf), inventory)


_LONG = """hops as (select doc_id, case when doc_id % 300 = 0 then doc_id + 7 when doc_id % 70 = 17 then -1
    else doc_id - 1 end as target from documents where doc_id % 95 <> 31),
  far as (select doc_id, target, 1 as steps from hops
    union all select f.doc_id, h.target, f.steps + 1 from far f join hops h on h.doc_id = f.target where f.steps <= 400)"""


@query("validate_long_links", f"""with recursive {_LONG}
select doc_id, case when steps > 400 then 'loop' else 'broken' end as reason
from (select doc_id, max(steps) as steps, arg_max(target, steps) as target from far group by doc_id)
where steps > 400 or target not in (select doc_id from documents)""")
def validate_long_links(spark, sf):
    """Chains of up to some hundred links, circles with chains that lead into them, and ends that are not there."""
    documents = fx.table(spark, sf, "documents").select("doc_id")
    links = documents.where("doc_id % 95 <> 31").selectExpr(
        "cast(doc_id as string) as path",
        """case when doc_id % 300 = 0 then cast(doc_id + 7 as string) when doc_id % 70 = 17 then 'none'
             else cast(doc_id - 1 as string) end as target""")
    found = validate.unresolved_links(links, documents.select(F.col("doc_id").cast("string").alias("path")))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), "reason")


def findings(spark, sf):
    job = organizer(spark)
    inventory = doc_inventory(spark, sf)
    plan = job.plan(inventory, DOC_ROOT)
    return job.validate(
        plan.with_(ops=staged(plan.ops, "ops")),
        available_bytes=SPACE, directories=state(inventory), links=fx.links(spark, sf),
    )


_ALL = f"{_SPACE_SQL} union all {_PERMISSION_SQL} union all {_SAME_SQL} union all {_EXISTING_SQL}"


@query("validate_plan", sql(_ALL, "ops", "state", "crowded", "doc"))
def validate_plan(spark, sf):
    return findings(spark, sf)


@query("validation_summary", sql(
    f'select severity, "check", count(*) as findings from ({_ALL}) group by all', "ops", "state", "crowded", "doc"))
def validation_summary(spark, sf):
    return validate.summary(findings(spark, sf))
