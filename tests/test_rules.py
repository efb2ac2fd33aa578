import pytest

from shelfmark import JobConfig
from shelfmark.operators.classify import by_extension, by_size
from shelfmark.sources import rules as r


def placed(spark, rules, *exts):
    rows = spark.createDataFrame([(e,) for e in exts], "extension string")
    return {
        x.extension: (x.category, x.subcategory) for x in r.category_of(rows, rules).collect()
    }


def test_defaults(spark):
    rules = r.default_rules(spark)
    got = placed(spark, rules, ".pdf", ".jpg", ".mp3", ".mp4", ".py", ".zip", "pdf", ".unknown", "", "txt", ".PDF")
    assert got == {
        ".pdf": ("Docs", "PDFs"), ".jpg": ("Pics", "Photos"), ".mp3": ("Audio", "Music"), ".mp4": ("Vids", "Movies"),
        ".py": ("Code", "Python"), ".zip": ("Archives", "Compressed"), "pdf": ("Docs", "PDFs"),
        ".unknown": ("Misc", "Unsorted"), "": ("Misc", "Unsorted"), "txt": ("Docs", "Text"), ".PDF": ("Docs", "PDFs"),
    }
    assert rules.where("ext is not null").count() == 168
    assert rules.select("ext").where("ext is not null").distinct().count() == 161
    assert r.categories(rules).count() == 11


def test_first_rule_wins(spark):
    got = placed(spark, r.default_rules(spark), ".dmg", ".iso", ".img", ".dll", ".webp", ".htm", ".xml")
    assert got == {
        ".dmg": ("Programs", "Mac"), ".iso": ("Archives", "Disk"), ".img": ("Archives", "Disk"),
        ".dll": ("Programs", "Windows"), ".webp": ("Pics", "Photos"), ".htm": ("Code", "Web"), ".xml": ("Web", "Data"),
    }


def test_override_replaces_a_whole_category(spark):
    rules = r.override_categories(
        r.default_rules(spark), r.rules_from_mapping(spark, {"Pics": {"Only": [".jpg"]}, "New": {"Sub": [".png", ".txt"]}})
    )
    got = placed(spark, rules, ".jpg", ".gif", ".png", ".txt", ".webp")
    assert got == {
        ".jpg": ("Pics", "Only"), ".gif": ("Misc", "Unsorted"), ".png": ("New", "Sub"), ".txt": ("Docs", "Text"),
        ".webp": ("Web", "Images"),
    }


def test_set_subcategory_keeps_positions(spark):
    rules = r.set_subcategory(r.default_rules(spark), "Docs", "Word", [".pdf"])
    rules = r.set_subcategory(rules, "Zoo", "Cats", [".cat", ".pdf"])
    got = placed(spark, rules, ".pdf", ".doc", ".cat")
    assert got == {".pdf": ("Docs", "Word"), ".doc": ("Misc", "Unsorted"), ".cat": ("Zoo", "Cats")}


def test_config():
    cfg = JobConfig.from_dict({"strategy": "by-size", "unknown": 1, "ignore_patterns": ["*.tmp"]})
    assert cfg.strategy == "by-size" and cfg.ignore_patterns == ("*.tmp",)
    assert JobConfig.from_dict(cfg.to_dict()) == cfg
    assert cfg.managed_name("Docs") == "all_Docs"
    for bad in ({"strategy": "by-colour"}, {"conflict_resolution": "guess"}):
        with pytest.raises(ValueError):
            JobConfig.from_dict(bad)


def test_size_classes(spark):
    mb = 1024 * 1024
    rows = spark.createDataFrame([(mb - 1,), (mb,), (10 * mb,), (100 * mb,), (1000 * mb,)], "size_bytes bigint")
    got = [(x.category, x.subcategory) for x in by_size(rows).orderBy("size_bytes").collect()]
    assert got == [
        ("Small", "Under1MB"), ("Small", "1-10MB"), ("Medium", "10-100MB"), ("Medium", "100MB-1GB"), ("Large", "Over1GB"),
    ]


def test_lookup_is_broadcast(spark):
    files = spark.range(10).selectExpr("'/r/' || id || '.pdf' as path")
    plan = by_extension(files, r.default_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
