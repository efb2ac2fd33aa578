"""Every operator against its contract, on given documents and on odd rows."""

import random
from array import array
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bpe, hamming, licenses, mixing, personal, quality, reputation, secrets, simhash, suffixes
from shelfmark.llm import queries as q


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def same(got, want):
    assert got == sorted(want, key=repr)


@pytest.fixture(params=["given", "odd"])
def some(request, spark, sf):
    if request.param == "odd":
        return request.getfixturevalue("odd")
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


SUFFIX = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_suffix_dedup(some, empty):
    want = brute.suffix_dedup([(i, (t or "").encode()) for i, t in pairs(some)])
    same(table(suffixes.deduplicated(some), *SUFFIX), want)
    assert suffixes.deduplicated(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffix_dedup_of_shared_passages(spark, hot):
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghi", k=rng.randint(1, 9))) for _ in range(n))

    shared = [prose(60), prose(45), "e" * 250, prose(200)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 80)) for _ in range(3)]
        text = parts[0] + rng.choice(shared) + parts[1] + rng.choice(shared)[rng.randint(0, 40):] + parts[2]
        rows.append((i, text))
    rows += [(100, rows[0][1]), (101, rows[1][1][:500] + "!" + rows[1][1][500:])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(table(suffixes.deduplicated(docs, hot=hot), *SUFFIX), brute.suffix_dedup([(i, t.encode()) for i, t in rows]))


def test_suffix_dedup_over_stretches(spark, monkeypatch):
    """Texts that are worked on stretch by stretch."""
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    rng = random.Random(8)
    shared = ["".join(rng.choices("abcd ", k=n)) for n in (199, 200, 500, 2500)]
    rows = [(i, "".join(rng.choice(shared) if rng.random() < 0.3 else "".join(rng.choices("abcd ", k=rng.randint(0, 300)))
                        for _ in range(10))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(table(suffixes.deduplicated(docs), *SUFFIX), brute.suffix_dedup([(i, t.encode()) for i, t in rows]))


def test_suffix_dedup_of_a_very_long_text(spark):
    """A passage on both sides of the end of a stretch of 4 MiB, and once more in a short text."""
    rng = random.Random(9)
    long = bytearray(rng.choices(b"abcdefghijklmnop", k=suffixes.STRETCH + 5000))
    passage = bytes(long[suffixes.STRETCH - 150:suffixes.STRETCH + 150])
    rows = [(1, long.decode()), (2, "xyz" + passage.decode() + "xyz")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.spans) for r in suffixes.deduplicated(docs).collect()}
    a = suffixes.STRETCH - 150
    assert got == {1: (len(long), 300, 1, f"{a}:{a + 300}"), 2: (306, 300, 1, "3:303")}


@pytest.mark.parametrize("buckets", [1, 40])
def test_suffix_dedup_across_borders(spark, buckets):
    """A passage in some thousand surroundings: hot leads, whose equal suffixes lie in many buckets, or in one."""
    rng = random.Random(10)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    rows = [(i, "".join(rng.choices("stuvw", k=rng.randint(0, 90))) + passage[rng.choice([0, 0, 5, 40]):]
             + "".join(rng.choices("stuvw", k=rng.randint(0, 90)))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = table(suffixes.deduplicated(docs, hot=20), *SUFFIX)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    same(got, brute.suffix_dedup([(i, t.encode()) for i, t in rows]))


def test_suffix_dedup_of_hot_leads_writes_no_windows(spark, monkeypatch):
    """A hot lead's surroundings are dealt out a few times at most, not once for every window that occurs again."""
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    other = passage[:230] + "!" + passage[231:]
    rows = [(i, "".join(rng.choices("stuvw", k=90)) + rng.choice([passage, passage, other]) + "".join(rng.choices("stuvw", k=90)))
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    written, plain = [], suffixes.staged

    def counted(df, label):
        out = plain(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(suffixes, "staged", counted)
    got = table(suffixes.deduplicated(docs, hot=20), *SUFFIX)
    same(got, brute.suffix_dedup([(i, t.encode()) for i, t in rows]))
    at = [label for label, _ in written].index("suffix-bytes")
    hot = written[at + 1:]
    assert hot and all(n <= 4 * written[at][1] for _, n in hot), written


def test_suffix_dedup_of_divided_leads(spark):
    """Groups that agree on neither side, cut down to parts of single windows, with ends of texts and zero bytes between."""
    rng = random.Random(12)
    base = "".join(rng.choices("abc\0", k=600))
    rows = []
    for i in range(150):
        text = list(base[rng.choice([0, 0, 10, 150]):rng.choice([600, 600, 450, 333])])
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((i, "".join(rng.choices("stu", k=rng.choice([0, 3, 80]))) + "".join(text)))
    rows.append((200, rows[0][1]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute.suffix_dedup([(i, t.encode()) for i, t in rows])
    for hot in (1, 5, 40):
        same(table(suffixes.deduplicated(docs, hot=hot), *SUFFIX), want)


def test_multikey_quicksort():
    rng = random.Random(5)
    strings = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 40))) for _ in range(500)]
    order, common = suffixes.sorted_suffixes(strings, 40)
    padded = [strings[i].ljust(40, b"\0") for i in order]
    assert padded == sorted(padded)
    for a, b, n in zip(padded, padded[1:], common[1:]):
        assert a[:n] == b[:n] and (n == 40 or a[n] != b[n])


def test_license_scan(spark, odd, empty):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    rows = [(1, "Copyright (c) 2020 A. Author\n" + mit.upper().replace(" ", "  ")), (2, mit + " And more."),
            (3, mit.replace("sublicense", "sub-licence")), (4, "Some text.\nlicensed under CC-BY-NC 4.0"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.license, r.last_line_license) for r in licenses.scan(docs).collect()}
    assert got == {1: ("MIT", None), 2: (None, None), 3: ("MIT", None), 4: (None, "CC-BY-NC-4.0"), 5: (None, None)}
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(empty).count() == 0


def rewrapped(text, width):
    """The same words in other lines; notice lines keep theirs."""
    import re
    import textwrap

    out, paragraph = [], []
    for line in [*text.splitlines(), ""]:
        notice = re.match(r"\W*(portions )?copyright.*([(]c[)]|\d{4}|[\[<{])", line.lower())
        if not line.strip() or notice:
            out += textwrap.wrap(" ".join(paragraph), width) + ([line] if notice else [""])
            paragraph = []
        else:
            paragraph.append(line.strip())
    return "\n".join(out)


def licence_variants(text, title=None):
    notice = "Copyright (c) 2019-2024 Jos\u00e9 Q. Holder <jose@example.org>\nAll rights reserved.\n\n"
    yield text
    yield rewrapped(text, 50)
    yield notice + rewrapped(text, 110)
    yield "Copyright 2020, The Authors.\n" + text.upper()
    yield "# " + (title or "") + "\n\n\u00a9 2021 Someone\n" + text.replace("\n", "\r\n").replace(",", " ,")
    yield text.replace("license", "licence").replace("License", "Licence").replace("organization", "organisation")


def test_every_known_licence(spark):
    from pathlib import Path

    cases = []
    for name, text in licenses.KNOWN:
        if "\n" in text:
            for title in licenses.TITLES.get(name, [None]):
                cases += [(name, v) for v in licence_variants(text, title)]
            cases.append((name, " ".join(text.split())))
            cases.append((None, text + " And more."))
            cases.append((None, text.replace(" OR ", " AND ", 1).replace(" or ", " and ", 1)))
    published = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1",
                 "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "LGPL-3": "LGPL-3.0", "GFDL-1.3": "GFDL-1.3"}
    for file, name in published.items():
        path = Path("/usr/share/common-licenses", file)
        if path.exists():
            text = path.read_text(errors="replace")
            cases += [(name, v) for v in (text, rewrapped(text, 60), rewrapped(text, 120), text.upper(), text.replace("license", "licence"))]
            cases.append((None, text.replace("you", "they", 1) + "x"))
            if "END OF TERMS AND CONDITIONS" in text:
                cases.append((name, text[:text.index("END OF TERMS AND CONDITIONS")]))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id bigint, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    wrong = [(name, got[i], text[:80]) for i, (name, text) in enumerate(cases) if got[i] != name]
    assert not wrong and len(cases) > 60


def slow_canonical(text):
    """Case, notice lines, punctuation and spellings, one word after another."""
    import re

    lines = re.sub(r"\r\n?", "\n", (text or "").lower()).split("\n")
    kept = [x for x in lines if not any(re.match(p, x) for p in (
        r"[^\w(\u00a9]*(portions )?copyright[\t ,:]*(\(c\)|\u00a9|[0-9]{4}|[<\[{])", r"[^\w(\u00a9]*copyright[\t ].*[^0-9][0-9]{4}[\t .,]*$",
        r"[^\w(\u00a9]*(\(c\)[\t ]*([0-9]{4}|[<\[{])|\u00a9[\t ]*[\w<\[{])", r"[^\w(\u00a9]*all rights reserved[\t .]*$"))]
    words = re.findall(r"[^\W_]+", "\n".join(kept))
    for variant, usual in licenses.SPELLINGS.items():
        v, u, i, out = variant.split(), usual.split(), 0, []
        while i < len(words):
            if words[i:i + len(v)] == v:
                out += u
                i += len(v)
            else:
                out.append(words[i])
                i += 1
        words = out
    return " ".join(words)


def test_license_scan_against_brute_force(spark, sf, odd):
    known = {}
    for v in licenses.variants():
        d = brute.sha(slow_canonical(v["text"]).encode())
        known[d] = min(v["license"], known.get(d, v["license"]))
    long = (90, "Copyright (c) 2020 A\n" + "sub licence " * 100_000)
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), odd.select("doc_id", "text"),
                 spark.createDataFrame([long, long, (91, "copyright holders be\n(c) you must\n (c) 2001 x\ny"), (92, "MIT\nreleased under the mit licence!")],
                                       "doc_id bigint, text string")):
        want = []
        for i, t in pairs(docs):
            last = (t or "").strip(" ").split("\n")[-1]
            whole, line = (brute.sha(slow_canonical(x).encode()) for x in (t, last))
            want.append((i, whole, known.get(whole), known.get(line)))
        same(table(licenses.scan(docs), "doc_id", "digest", "license", "last_line_license"), want)


def test_mix(some, empty):
    rows = [r.asDict() for r in mixing.mix(some).collect()]
    sizes = defaultdict(int)
    words = [(r.doc_id, r.source, len(brute.WORD.findall(r.text or ""))) for r in some.select(
        "doc_id", "source", "text").collect()]
    for _, s, n in words:
        sizes[s] += n
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in rows), key=repr) == sorted(words, key=repr)
    want, got = brute.targets(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        got[r["source"]] += r["taken"]
    largest = max(n for _, _, n in words)
    for s, n in got.items():
        assert abs(n - want[s]) <= 2 * largest
    assert sum(got.values()) <= 1.5 * sum(sizes.values())
    assert rows == sorted([r.asDict() for r in mixing.mix(some).collect()], key=rows.index)
    assert mixing.mix(empty).count() == 0


def test_mixed_rows(odd, empty):
    got = mixing.taken(odd)
    assert got.columns == odd.columns
    times = sum(r.times for r in mixing.mix(odd).collect())
    assert got.count() == times
    assert mixing.taken(empty).count() == 0


def test_simhash(some, empty, monkeypatch):
    want = brute.near_duplicates(pairs(some))
    columns = ["doc_id", "fingerprint", "component_id"]
    same(table(simhash.near_duplicates(some), *columns), want)
    monkeypatch.setattr(simhash, "CALM", 1)
    same(table(simhash.near_duplicates(some), *columns), want)
    kept = simhash.one_of_each(some)
    assert kept.columns == some.columns
    roots = sorted({c for _, _, c in want}, key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == roots
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_links_of_dense_codes(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(5)]
    codes = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(200)}
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    docs = spark.createDataFrame([(i, c) for i, (c,) in enumerate(signed)], "doc_id bigint, code bigint")
    got = {r.code % (1 << 64): r.class_id for r in simhash.classes(docs).collect()}
    order = [c % (1 << 64) for (c,) in signed]
    root = list(range(len(order)))
    for i, a in enumerate(order):
        for j in range(i):
            if (a ^ order[j]).bit_count() <= 2 and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert [got[c] for c in order] == root


def test_secrets(some, empty):
    kinds = ["assign", "access", "hex"]
    want = []
    for i, t in pairs(some):
        found = brute.secrets(t or "")
        want.append((i, *[sum(k == x for x, _, _ in found) for k in kinds], brute.spans_sha(found, kinds)))
    same(table(secrets.digests(some), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), want)
    assert secrets.digests(empty).count() == 0


def test_entropy(spark):
    import math
    from collections import Counter

    rng = random.Random(2)
    strings = ["".join(rng.choices(secrets.ALPHABET, k=n)) for n in (20, 21, 40, 90)] + ["a1" * 30, "0" * 25]
    got = spark.createDataFrame([(s,) for s in strings], "s string").select(
        secrets.window_entropy(F.col("s")).alias("h")).collect()
    for s, row in zip(strings, got):
        windows = [Counter(s[i:i + 20]) for i in range(len(s) - 19)]
        assert abs(row.h - max(-sum(c / 20 * math.log2(c / 20) for c in w.values()) for w in windows)) < 1e-9
    text = "key q8Zr2LmX9vTb4KpW7sYd0GhJ and 12345678901234567890123 or example8Zr2LmX9vTb4KpW7sYd and plain"
    found = secrets.digests(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().spans
    assert found == "entropy:4:28"


def added(text):
    """The candidates outside the fixed forms whose windows are mixed enough, slowly."""
    import math
    import re
    from collections import Counter

    for kind, pattern in (("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX)):
        text = re.sub(pattern, lambda m: "\x01" * len(m[0]) if kind != "assign" or len(m[1]) >= 6 else m[0], text, flags=re.ASCII)
    out = []
    for m in re.finditer(secrets.CANDIDATE, text, re.ASCII):
        value = m[0]
        least = next(bits for _, form, bits in secrets.CLASSES if re.search(form, value))
        if not re.search("[A-Za-z]", value) or any(re.search(p, value) for p in secrets.ALLOWED):
            continue
        best = max(-sum(c / 20 * math.log2(c / 20) for c in Counter(value[i:i + 20]).values()) for i in range(len(value) - 19))
        if best >= least - 1e-9:
            out.append(("entropy", *m.span()))
    return out


def test_added_spans(spark):
    """Planted keys of each class among words, forms, other scripts and what the allow-list lets off."""
    rng = random.Random(6)
    letters = secrets.ALPHABET[:62]
    make = [lambda: "".join(rng.choices(secrets.ALPHABET[:16], k=23)), lambda: "".join(rng.choices(letters, k=rng.randint(20, 60))),
            lambda: "".join(rng.choices(secrets.ALPHABET, k=rng.randint(20, 60))), lambda: "word " * 5, lambda: "\u00e9\U0001f389 ",
            lambda: "password: hunter2secret", lambda: "example" + "".join(rng.choices(letters, k=30)), lambda: "2024-01-01-2024-01-01-22",
            lambda: "AKIA" + "Z9" * 9, lambda: "0123456789abcdef" * 2, lambda: "a1" * 15, lambda: "x=1&token=" + "k3" * 9]
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(make)() for _ in range(rng.randint(0, 30)))) for i in range(150)]
    got = {r.doc_id: r.spans for r in secrets.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    n = 0
    for i, text in rows:
        found = brute.secrets(text) + added(text)
        n += len(added(text))
        order = sorted(found, key=lambda f: (f[1], secrets.KINDS.index(f[0])))
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in order)
    assert n > 300


def test_secrets_of_long_texts(spark):
    """Time follows the length: a candidate of a quarter of a megabyte, and tens of thousands of matches."""
    rng = random.Random(7)
    rows = [(1, "".join(rng.choices(secrets.ALPHABET, k=250_000))), (2, "token=abcdefg1 " * 30_000), (3, "x" * 3_000_000),
            (4, " ".join("".join(rng.choices(secrets.ALPHABET, k=24)) for _ in range(10_000)))]
    got = {r.doc_id: r for r in secrets.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].spans == "entropy:0:250000" and got[2].n_assign == 30_000 and got[3].spans == ""
    assert got[2].spans.endswith("assign:449985:449999") and got[4].spans.count("entropy") > 9_000


def test_top_k(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in rows] + [(1000 + i, rows[3].embedding) for i in range(60)] + [(2000, None)]
    got = defaultdict(list)
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for r in sorted(hamming.search(docs).collect()):
        got[r.query_id].append((r.distance, r.neighbour_id))
    codes = {i: sum(1 << b for b, x in enumerate((e or [])[:64]) if x > 0) for i, e in rows}
    for i in codes:
        if i % 20 == 0:
            assert got.pop(i) == sorted(((codes[i] ^ c).bit_count(), j) for j, c in codes.items() if j != i)[:10]
    assert not got
    assert hamming.search(docs.where("false")).count() == 0


@pytest.fixture(scope="session")
def coders():
    import public_tokenizers
    import tiktoken

    with open(q.RANKS, "rb") as lines:
        ranks = bpe.read_ranks(lines)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Codec(ranks, public_tokenizers.PATTERN), known


def test_bpe_of_odd_texts(coders):
    own, known = coders
    rng = random.Random(4)
    signs = "abcdefghe  \n\t '\u2019\u00e9\u00df\u00f1\u65e5\u672c\U0001f3890123.,!? \u3000\u00a0AB-<|endoftext|>"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, " " * 3000, "ab" * 2000, "".join(rng.choices("etaoinsr", k=20000)), "a\n \nb", "a \n b"]
    for text in texts:
        ids = array("I")
        ids.frombytes(own.encode(text))
        assert list(ids) == known.encode_ordinary(text), repr(text)
        assert "".join(own.decode(ids.tobytes())) == text


def test_bpe(some, empty, coders):
    import public_tokenizers

    want = []
    for i, t in pairs(some):
        ids = coders[1].encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(array("I", ids).tobytes()), brute.sha((t or "").encode())))
    args = q.RANKS, public_tokenizers.PATTERN
    same(table(bpe.digests(some, *args), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)
    for r in bpe.encode(some, *args).where("doc_id is not null").collect()[:20]:
        assert coders[1].decode(r.ids) == r.decoded
    assert bpe.digests(empty, *args).count() == 0


def test_url_rules(spark):
    urls = ["http://ORG/x", "https://a.Example.org/es/1?q", "x://example.org/en/12#t", "x://example.org/en/2", "http://borg/",
            "http://a.com/fr/9", "http://com/de/", "ftp://a.com/de", "nothing", None, "http://a.org", "q://h?x://y/z"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    labels = spark.createDataFrame([(3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judge(pages, labels).collect()}
    assert got[0] == ("org", "/x", "org/", "allow") and got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow") and got[4][2] is None
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block") and got[7][2] is None
    assert got[8][:3] == got[9][:3] == ("", "", None) and got[10][:3] == ("a.org", "", None) and got[11][:2] == ("h", "")
    assert reputation.judge(pages.where("false"), labels).count() == 0
    assert {r.verdict for r in reputation.judge(pages, labels.where("false")).where("rule is null").collect()} == {"allow"}


def test_reputation_shrinks(spark):
    pages = [(i, f"http://bad.b.com/{i}") for i in range(60)] + [(100 + i, f"http://h{i}.g.net/") for i in range(60)]
    pages += [(300, "http://new.b.com/x"), (301, "http://new.g.net/x")]
    labels = [(i, int(i % 10 == 0), 0) for i in range(60)] + [(100 + i, 1, 0) for i in range(60)]
    got = reputation.judge(spark.createDataFrame(pages, "page_id bigint, url string"),
                           spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r.page_id: (r.verdict, r.reputation) for r in got.collect()}
    assert got[1][0] == "block" and got[100][0] == "allow" and got[301][0] == "allow"
    assert got[1][1] < got[300][1] < got[301][1]


def test_quality(some, empty, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    columns = ["doc_id", *quality.COUNTS, "base_failed"]
    same(table(quality.judge(some, forest), *columns), [(i, *brute.quality(t)) for i, t in pairs(some)])
    assert quality.judge(some, forest).where("base_failed and kept").count() == 0
    kept = quality.keep(some, forest)
    assert kept.columns == some.columns
    same(table(kept, "doc_id"), table(quality.judge(some, forest).where("kept"), "doc_id"))
    assert quality.keep(empty, forest).count() == 0 and quality.fit(empty, labels) is None


def test_forest_against_labels(spark):
    """Held-out accuracy: rows that the sample doesn't hold."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.fit(docs, labels, sample=200)
    rows = quality.judge(docs, forest).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [not r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) >= 0.7 * len(bad)


def test_personal_data(some, empty):
    kinds = ["email", "ip", "card", "phone"]
    want = []
    for i, t in pairs(some):
        found = brute.personal(t or "")
        want.append((i, *[sum(k == x for x, _, _ in found) for k in kinds], brute.spans_sha(found, kinds)))
    got = personal.scan(some).withColumn("base", F.sha2("base", 256))
    same(table(got, "doc_id", *[f"n_{k}" for k in kinds], "base"), want)
    masked = personal.redact(some)
    assert masked.columns == some.columns and masked.count() == some.count()
    assert all(not brute.personal(r.text or "") for r in masked.collect())
    assert personal.scan(empty).count() == 0 and personal.redact(empty).count() == 0


def test_personal_fixed_forms():
    rng = random.Random(6)
    for _ in range(20000):
        text = "".join(rng.choices("a_.@-+ (1234567890", k=rng.randint(0, 40)))
        want = sorted((s, ["email", "ip", "card", "phone"].index(k), e) for k, s, e in brute.personal(text))
        assert personal.fixed(text) == want, text


def test_discovered_identifiers(spark):
    rows = [(i, f"please write to user{i}@mail.org today") for i in range(30)]
    rows += [(100 + i, f"please write to AB-77{i:03}X today") for i in range(5)]
    rows += [(200, "the code is XY-12345 here")]
    got = personal.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {r.doc_id for r in got.collect() if "id:" in r.spans}
    assert found == {100 + i for i in range(5)}
