"""The pipeline's stages one after another, against their brute-force versions."""

import brute
import public_tokenizers
import pyarrow as pa

import corpus_pipeline as p
from shelfmark.llm import bpe, mixing, personal, quality
from shelfmark.llm.common import SLICE


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "personal_data", "mixture", "encode"]
    for name, stage in p.STAGES:
        before, after = docs, stage(spark, docs, sf)
        rows = after.collect()
        if name == "quality":
            kept = quality.judge(before, quality.fit(before, labels)).where("kept")
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in kept.collect())
        elif name == "near_duplicates":
            classes = brute.near_duplicates([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in rows) == sorted({c for _, _, c in classes})
        elif name == "personal_data":
            assert len(rows) == before.count() and not any(brute.personal(r.text) for r in rows)
        elif name == "mixture":
            assert len(rows) == sum(r.times for r in mixing.mix(before).collect())
        if name != "encode":
            assert after.columns == docs.columns
            docs = spark.createDataFrame(rows, after.schema)
        else:
            assert after.columns == ["doc_id", "ids", "n_tokens"] and len(rows) == before.count()


def test_odd_rows(spark, odd, empty, sf):
    for docs in (odd, empty):
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == odd.columns


def test_small_batches(spark, monkeypatch):
    """What a worker makes of an Arrow batch, however long, comes in pieces: all its rows in their order."""
    rows = [(i, f"mail a{i}@b.example and word{i} " * 20, "a", 0) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    kind, workers = type(docs), []
    inner = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, *a: workers.append((df, f)) or inner(df, f, *a))
    quality.keep(docs, None)
    personal.redact(docs)
    p.encode(spark, docs, "")
    assert len(workers) == 4
    for df, f in workers:
        batch = pa.Table.from_batches(df.orderBy("doc_id").toArrow().to_batches()).combine_chunks().to_batches()[0]
        assert batch.num_rows == len(rows)
        out = list(f(iter([batch])))
        assert max(b.num_rows for b in out) <= SLICE < len(rows)
        assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(len(rows)))
        assert not list(f(iter([batch.slice(0, 0)])))


def test_codec_remembers_little(monkeypatch):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        codec = bpe.Codec(bpe.read_ranks(lines), public_tokenizers.PATTERN)
    plain = codec.encode("zqxv once and wvkjq twice")
    assert not codec.young  # chunks met once
    assert codec.encode("zqxv once and wvkjq twice") == plain and " wvkjq" in codec.young
    assert codec.encode("zqxv once and wvkjq twice") == plain
    for i in range(400):
        codec.encode(f" qwz{i * 7919}xj{i * 104729}kv")
    arcs = codec.machine.arcs.values()
    assert len({id(a) for a in arcs}) == len(set(arcs)) < len(arcs)
    monkeypatch.setattr(bpe, "CACHED", 10)
    for i in range(40):
        for _ in range(2):
            codec.encode(f" qwz{i}")
    assert len(codec.young) <= 10 and sum(codec.met) <= 20
