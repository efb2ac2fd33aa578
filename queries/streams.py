"""Streaming queries; each result equals the batch result over the same events."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixtures as fx
from queries.fixtures import sql
from queries.registry import query
from shelfmark.config import JobConfig
from shelfmark.session import new_folder
from shelfmark.sources.rules import default_rules
from shelfmark.streaming import watch

CFG = JobConfig()
ROOT = "/inbox"


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def stream(spark, sf, sentinel=False):
    return watch.read_events(spark, fx.event_folder(spark, sf, sentinel))


@query("stream_new_files", sql(
    "select event_id, path, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, size_bytes from evt", "evt"))
def stream_new_files(spark, sf):
    seen = watch.run_to_end(watch.relevant(stream(spark, sf), CFG), "new-files")
    return seen.select("event_id", "path", "event_type", stamp("ts").alias("ts"), "size_bytes")


@query("stable_sessions", sql(
    """select path, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts,
         count(*) as n_events, arg_min(size_bytes, row(ts, event_id)) as first_size,
         arg_max(size_bytes, row(ts, event_id)) as last_size
       from (select *, sum(start) over (partition by path order by ts, event_id) as burst
             from (select *, case when ts <= lag(ts) over (partition by path order by ts, event_id) + interval 1 hour
                                  then 0 else 1 end as start from evt)) group by path, burst""", "evt"))
def stable_sessions(spark, sf):
    bursts = watch.run_to_end(watch.stable_sessions(stream(spark, sf, True), "1 hour"), "bursts")
    return bursts.where(F.col("path") != watch.SENTINEL).select(
        "path", stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts"), "n_events", "first_size", "last_size"
    )


@query("first_seen_events", sql(
    """select event_id, path, event_type from (
         select *, row_number() over (partition by path order by ts, event_id) as n from evt)
       where event_type = 'created' or n = 1""", "evt"))
def first_seen_events(spark, sf):
    return watch.run_to_end(watch.first_seen(stream(spark, sf)), "first-seen").select(
        "event_id", "path", "event_type"
    )


@query("stream_classified", sql(
    """select event_id, path, '/inbox/all_Misc/Unsorted/' || split_part(path, '/', -1) as destination from evt""", "evt"))
def stream_classified(spark, sf):
    placed = watch.classified(stream(spark, sf), ROOT, default_rules(spark), CFG)
    return watch.run_to_end(placed, "classified").select("event_id", "path", "destination")


def arriving(spark, sf):
    """The events of many kinds of files, batch after batch."""
    return watch.read_events(spark, fx.in_batches(fx.arrivals(spark, sf)), files_per_batch=1)


@query("first_seen_expiring", sql(
    """select event_id, path from (
         select *, ts - lag(ts) over (partition by path order by ts, event_id) as silence from arrived)
       where event_type = 'created' or silence is null or silence >= interval 20 hours""", "arrived"))
def first_seen_expiring(spark, sf):
    """What is not relevant never reaches the state; a path counts as new again after 20 quiet hours."""
    seen = watch.first_seen(watch.relevant(arriving(spark, sf), CFG), "20 hours", "1 minute")
    return watch.run_to_end(seen, "first-seen").where(F.col("path") != watch.SENTINEL).select("event_id", "path")


_SETTLED = """select path, first_ts, ts, n_events, size_bytes, created from (
   select *, row_number() over (partition by path order by ts) as n from bursts) where created or n = 1"""


@query("settled_files", sql(
    f"""select path, strftime(first_ts, '%Y-%m-%d %H:%M:%S') as first_ts, strftime(ts, '%Y-%m-%d %H:%M:%S') as last_ts,
          n_events, size_bytes from ({_SETTLED})""", "bursts"))
def settled_files(spark, sf):
    files = watch.settled_files(watch.relevant(arriving(spark, sf), CFG), "1 hour", None, "1 minute")
    return watch.run_to_end(files, "settled").select(
        "path", stamp("first_ts").alias("first_ts"), stamp("ts").alias("last_ts"), "n_events", "size_bytes")


@query("watch_pipeline", sql(
    f"""select path as source, '/inbox/all_' || coalesce(category, 'Misc') || '/' || coalesce(subcategory, 'Unsorted') || '/'
          || split_part(path, '/', -1) as destination, count(*) as moves
        from (select *, lower(regexp_extract(split_part(path, '/', -1), '^.+(\\.[^.]+)$', 1)) as ext from ({_SETTLED}))
        left join lookup using (ext) group by all""", "bursts", "lookup"))
def watch_pipeline(spark, sf):
    """A watcher over ten batches: relevant events, settled files, destinations, layout and log."""
    folder, state = new_folder(spark, "watched"), new_folder(spark, "watched-state")
    watcher = watch.Watcher(ROOT, default_rules(spark), JobConfig(watch_settle=3600, watch_delay=60))
    watcher.start(arriving(spark, sf), folder, state, once=True).awaitTermination()
    return watcher.read_log(spark, folder).groupBy("source", "destination").agg(F.count(F.lit(1)).alias("moves"))
