"""Line quality (1), shards (2) and licences (4) against brute force."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import licenses, line_quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated)


def norm(line):
    return re.sub(r"[ \t-\r]+", " ", line).strip(" ").lower()


def brute(rows, min_docs, depleted):
    carried = collections.defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if WORD.search(x):
                carried[s, norm(x)].add(t)
    often = {k for k, v in carried.items() if len(v) >= min_docs}
    out = []
    for i, t, s in rows:
        n, *rest, repeat = base(t)
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if (s, norm(x)) in often)
        failed = n < 20 or 100 * repeat > 30 * n
        kept = not failed and not (gone and (n - gone < 20 or 100 * gone > depleted * n))
        out.append((i, n, *rest, repeat, failed, gone, kept))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]


def test_line_quality_on_odd_rows(odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    got = line_quality.line_quality(odd).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 10, 70)
    assert line_quality.line_quality(nothing).count() == 0


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(30))
    rows = [(i, f"Subscribe  NOW to our\tletter\n{own(i)}", "h") for i in range(12)]
    rows += [(20 + i, f"{own(50 + i)}\n" + "subscribe now to our letter\n" * 30, "h") for i in range(2)]
    rows += [(40 + i, f"subscribe now to our letter\n{own(90 + i)}", "rare") for i in range(5)]
    rows += [(60 + i, "one page copied as it is " + own(0), "copied") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_quality.line_quality(df).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 10, 70)
    kept = {r.doc_id: r.text for r in line_quality.cleaned(df).collect()}
    assert kept[3] == own(3) and 20 not in kept and kept[41].startswith("subscribe") and sum(i >= 60 for i in kept) == 40


def test_enough_documents_condemn_a_line_at_a_large_host(spark):
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(30))
    often = lambda i: "Read more\n" * (i < 10) + "See also\n" * (10 <= i < 19)
    df = spark.createDataFrame([(i, often(i) + own(i), "h") for i in range(300)], "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, df, "").collect()}
    assert kept == {i: "See also\n" * (10 <= i < 19) + own(i) for i in range(300)}
    assert line_quality.line_quality(df).where("removed_words > 0").count() == 10


def shard_of(key, n):
    def cost(s):
        h = int(hashlib.md5(f"{'' if key is None else key}:{s}".encode()).hexdigest()[:13], 16)
        return -math.log((float(h) + 0.5) / 2.0**52), s

    return min(cost(s) for s in range(n))[1]


def test_shards(odd, nothing, documents):
    for df in (odd, documents):
        got = sharding.shards(df, [1.0] * 8).collect()
        want = collections.Counter(
            (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), shard_of(r.doc_id, 8), shard_of(r.doc_id, 9)) for r in df.collect()
        )
        assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
        assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in got)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shards(nothing, [1.0]).count() == 0


def test_weights_set_the_shares(spark):
    got = sharding.shards(spark.range(4000).selectExpr("id doc_id", "'' text"), [1.0, 3.0]).groupBy("shard").count().collect()
    assert 0.7 < dict(map(tuple, got))[1] / 4000 < 0.8
    with pytest.raises(ValueError):
        sharding.rendezvous(None, [])


def test_licences(spark, odd, nothing):
    text = "some code here\nLicensed under the Apache License, Version 2.0\nmore"
    rows = [
        ("r/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this\nsoftware and associated documentation files, to deal in the software without restriction"),
        ("r/a/b/x.py", "nothing to see"), ("r/a/y.py", text), ("r/a/b/LICENSE.txt", "no licence at all"), ("r/c/COPYING", "All rights reserved."),
        ("r/c/d/e/f.py", None), ("s/z.py", "mine"), (None, ""), ("r/c/licensed.py", "all rights are reserved for those who read this line of text"),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumnsRenamed({}).selectExpr("*", "'x' dir", "1 own_score")
    got = {r.path: r for r in licenses.licenses(df).collect()}
    pick = {p: (r.license, r.inherited, r.license_dir) for p, r in got.items()}
    assert pick["r/LICENSE"] == ("MIT", False, None) and got["r/LICENSE"].own_line == -1
    assert pick["r/a/b/x.py"] == ("MIT", True, "r") and pick["r/a/b/LICENSE.txt"] == ("MIT", True, "r")
    assert pick["r/a/y.py"] == ("Apache-2.0", False, None) and got["r/a/y.py"].own_line == 1
    assert pick["r/c/d/e/f.py"] == ("proprietary", True, "r/c") and pick["s/z.py"] == (None, False, None) and pick[""] == (None, False, None)
    assert licenses.licenses(licenses.filed(odd)).count() == odd.count() and licenses.licenses(licenses.filed(nothing)).count() == 0


def test_license_verdicts_do_not_depend_on_the_table_size(spark):
    rows = [("a.py", "Released under the MIT License. Enjoy"), ("b.py", "nothing to see"), ("c.py", "Released under the MIT License. Enjoy it with friends and family"), ("d.py", None)]
    rows += [(f"x/{i}.txt", f"words such as released or license w{i} all under the same roof enjoy") for i in range(30)]
    df = spark.createDataFrame(rows, "path string, text string")
    often = df.join(spark.range(100)).drop("id")
    once = sorted(map(tuple, licenses.scan(df).select("path", "own_license", F.round("own_score", 9), "own_line").collect()), key=str)
    many = sorted(map(tuple, licenses.scan(often).select("path", "own_license", F.round("own_score", 9), "own_line").distinct().collect()), key=str)
    # Batches without a term of any template, and without a term at all.
    assert licenses.scan(spark.createDataFrame([("p", "qq"), ("q", "")], "path string, text string").repartition(2)).count() == 2
    assert once == many and {x[1] for x in once} == {None, "MIT"}


def test_license_terms_beyond_the_shared_ones(spark, monkeypatch):
    """The join gives what the terms that tasks receive give; other templates are a parameter."""
    df = spark.createDataFrame([("a", "be merry and share the code w1"), ("b", "share the code w2 w2"), ("LICENSE", "be merry\nand share the code")], "path string, text string")
    merry = [("Merry", "be merry and share the code")]
    want = licenses.licenses(df, templates=merry).orderBy("path").collect()
    monkeypatch.setattr(licenses, "COMMON", 1)
    got = licenses.licenses(df, templates=merry).orderBy("path").collect()
    assert [(r.own_license, r.license) for r in got] == [("Merry", "Merry"), ("Merry", "Merry"), (None, "Merry")]
    assert all(a[:2] == b[:2] and abs((a.own_score or 0) - (b.own_score or 0)) < 1e-9 for a, b in zip(got, want, strict=True))
