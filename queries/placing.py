"""Rules, classification and destinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixtures as fx
from queries.fixtures import DOC_ROOT, sql
from queries.listing import _HEAD_MIME, scoped, tags
from queries.registry import query
from shelfmark.config import JobConfig
from shelfmark.functions.totals import as_bigint
from shelfmark.operators import classify as cl
from shelfmark.operators import scope
from shelfmark.session import new_folder
from shelfmark.sources import rules as rule_source

CFG = JobConfig()
BIG_EXT = "lower(regexp_extract(split_part(b.path, '/', -1), '^.+(\\.[^.]+)$', 1))"


def doc_files(spark, sf):
    return scope.files_in_scope(scoped(spark, sf))


@query("classify_by_extension", sql(
    f"""select path, category, subcategory from files
        union all select b.path, coalesce(l.category, 'Misc'), coalesce(l.subcategory, 'Unsorted')
        from big b left join lookup l on l.ext = {BIG_EXT}""", "files", "big", "lookup"))
def classify_by_extension(spark, sf):
    files = doc_files(spark, sf).select("path").unionByName(fx.big(spark, sf).select("path"))
    return cl.by_extension(files, rule_source.default_rules(spark)).select("path", "category", "subcategory")


@query("classify_by_date", sql(
    "select path, strftime(modified_time, '%Y') as category, strftime(modified_time, '%m-%d') as subcategory from big",
    "big"))
def classify_by_date(spark, sf):
    return cl.by_date(fx.big(spark, sf)).select("path", "category", "subcategory")


@query("classify_by_size", sql(
    """select path, case when mb < 10 then 'Small' when mb < 1000 then 'Medium' else 'Large' end as category,
         case when mb < 1 then 'Under1MB' when mb < 10 then '1-10MB' when mb < 100 then '10-100MB'
              when mb < 1000 then '100MB-1GB' else 'Over1GB' end as subcategory
       from (select path, size_bytes / 1048576.0::double as mb from big)""", "big"))
def classify_by_size(spark, sf):
    return cl.by_size(fx.big(spark, sf)).select("path", "category", "subcategory")


@query("classify_hybrid", sql(
    f"""select b.path, coalesce(l.category, 'Misc') || '-' || strftime(b.modified_time, '%Y') as category,
          coalesce(l.subcategory, 'Unsorted') as subcategory
        from big b left join lookup l on l.ext = {BIG_EXT}""", "big", "lookup"))
def classify_hybrid(spark, sf):
    return cl.hybrid(fx.big(spark, sf), rule_source.default_rules(spark)).select("path", "category", "subcategory")


@query("classify_by_metadata_date", sql(
    """select doc_id, strftime(t, '%Y') as category, strftime(t, '%m-%d') as subcategory
       from (select doc_id, case when doc_id % 2 = 0 and doc_id % 20 <> 0
               then modified_time - interval 400 days else modified_time end as t from doc)""", "doc"))
def classify_by_metadata_date(spark, sf):
    return cl.by_date(tags(spark, sf), use_metadata=True).select("doc_id", "category", "subcategory")


_SNIFF_PLACE = """case mime when 'application/pdf' then 'Docs/PDFs' when 'image/jpeg' then 'Pics/Photos'
  when 'audio/mpeg' then 'Audio/Music' when 'video/mp4' then 'Vids/Movies' when 'application/zip' then 'Archives/Compressed'
  when 'text/x-script.python' then 'Code/Python' when 'text/x-shellscript' then 'Code/Shell'
  when 'text/html' then 'Web/Documents' when 'text/xml' then 'Web/Documents' when 'application/json' then 'Web/Data'
  when 'text/plain' then 'Docs/Text' end"""


@query("classify_sniffed", sql(
    f"""select doc_id, coalesce(split_part({_SNIFF_PLACE}, '/', 1), category, 'Misc') as category,
          coalesce(split_part({_SNIFF_PLACE}, '/', 2), subcategory, 'Unsorted') as subcategory
        from (select p.doc_id, l.category, l.subcategory, {_HEAD_MIME} as mime
              from parts p left join lookup l on l.ext = p.ext)""", "parts", "lookup"))
def classify_sniffed(spark, sf):
    return cl.by_content(fx.headed(spark, sf), rule_source.default_rules(spark)).select(
        "doc_id", "category", "subcategory"
    )


@query("destinations", sql(
    "select path, '/corpus/all_' || category || '/' || subcategory || '/' || name as destination from files", "files"))
def destinations(spark, sf):
    placed = cl.by_extension(doc_files(spark, sf), rule_source.default_rules(spark))
    return placed.select("path", cl.destination(DOC_ROOT, CFG).alias("destination"))


@query("duplicate_destinations", sql(
    """select path, '/corpus/all_Duplicates/' || regexp_replace(rel, '^all_Duplicates/', '') as destination
       from files""", "files"))
def duplicate_destinations(spark, sf):
    return doc_files(spark, sf).select("path", cl.duplicate_destination(DOC_ROOT, CFG).alias("destination"))


OVERRIDES = {"Pics": {"Shots": [".jpg", ".webp"]}, "Extra": {"Strange": [".xyz", ".mp3"]}}


@query("rules_override", sql(
    """select category, subcategory, count(*) as files, cast(sum(size_bytes) as bigint) as bytes from (
         select size_bytes, case when ext in ('.jpg', '.webp') then 'Pics' when ext = '.xyz' then 'Extra' else category end as category,
           case when ext in ('.jpg', '.webp') then 'Shots' when ext = '.xyz' then 'Strange' else subcategory end as subcategory
         from files) group by category, subcategory""", "files"))
def rules_override(spark, sf):
    rules = rule_source.override_categories(
        rule_source.default_rules(spark), rule_source.rules_from_mapping(spark, OVERRIDES)
    )
    return _per_category(doc_files(spark, sf), rules)


def _per_category(files, rules):
    return cl.by_extension(files, rules).groupBy("category", "subcategory").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )


_PER_CATEGORY_SQL = """select category, subcategory, count(*) as files, cast(sum(size_bytes) as bigint) as bytes
 from files group by category, subcategory"""


@query("rules_roundtrip", sql(_PER_CATEGORY_SQL, "files"))
def rules_roundtrip(spark, sf):
    folder = new_folder(spark, "rules")
    rule_source.save_rules(rule_source.default_rules(spark), folder)
    return _per_category(doc_files(spark, sf), rule_source.load_rules(spark, folder))


def custom_rule_table(spark):
    rules = rule_source.set_subcategory(rule_source.default_rules(spark), "Code", "Python", [".ipynb"])
    rules = rule_source.set_subcategory(rules, "Docs", "Papers", [".xyz", ".pdf"])
    return rule_source.set_subcategory(rules, "Lab", "Scripts", [".py", ".txt"])


_CUSTOM_SQL = """select *, case when ext = '.xyz' then 'Docs/Papers' when ext = '.py' then 'Lab/Scripts'
  else category || '/' || subcategory end as place from files"""


@query("custom_rules", sql(
    f"""select split_part(place, '/', 1) as category, split_part(place, '/', 2) as subcategory,
          count(*) as files, cast(sum(size_bytes) as bigint) as bytes
        from ({_CUSTOM_SQL}) group by all""", "files"))
def custom_rules(spark, sf):
    return _per_category(doc_files(spark, sf), custom_rule_table(spark))


@query("category_list", sql(
    """select r.category, count(distinct f.path) as files from (select distinct category from rules) r
       left join files f on f.category = r.category group by r.category""", "rules", "files"))
def category_list(spark, sf):
    rules = rule_source.default_rules(spark)
    counts = cl.by_extension(doc_files(spark, sf), rules).groupBy("category").agg(F.count(F.lit(1)).alias("files"))
    return rule_source.categories(rules).join(counts, "category", "left").select(
        "category", F.coalesce("files", F.lit(0)).cast("bigint").alias("files")
    )


@query("custom_classifier", sql(
    "select path, upper(lang) as category, substr(hash, 1, 1) as subcategory from files", "files"))
def custom_classifier(spark, sf):
    def by_language(files):
        return files.withColumn("category", F.upper("lang")).withColumn("subcategory", F.left("hash", F.lit(1)))

    return cl.classify(doc_files(spark, sf), rule_source.default_rules(spark), CFG, by_language).select(
        "path", "category", "subcategory"
    )


@query("noop_ops", sql(
    """select path from files where path = '/corpus/all_' || category || '/' || subcategory || '/' || name""", "files"))
def noop_ops(spark, sf):
    placed = cl.by_extension(doc_files(spark, sf), rule_source.default_rules(spark))
    return placed.where(F.col("path") == cl.destination(DOC_ROOT, CFG)).select("path")


@query("directory_sizes", sql(
    """select directory, cast(sum(size_bytes) as bigint) as total_bytes, count(*) as total_files from (
         select size_bytes, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') as directory
         from (select path, size_bytes, unnest(range(2, len(string_split(path, '/')))) as n
               from (select path, size_bytes from doc union all select path, size_bytes from big))) group by directory""",
    "doc", "big"))
def directory_sizes(spark, sf):
    from shelfmark.operators.rollup import directory_sizes as roll

    corpus = roll(fx.doc(spark, sf).select("path", "size_bytes"), DOC_ROOT)
    sizes = corpus.unionByName(roll(fx.big(spark, sf).select("path", "size_bytes"), fx.BIG_ROOT))
    return as_bigint(sizes, "total_bytes")
