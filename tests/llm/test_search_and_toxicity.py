"""Collision search (8) against brute force, toxicity (10) by held-out accuracy, and the pipeline."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from test_duplicates import cut, groups
from test_rules_and_shards import brute as quality
from test_rules_and_shards import norm
from tokenizers import Tokenizer

import corpus_pipeline
from docspark.llm import collision_search, tables, toxicity
from docspark.llm.textbytes import joined


def test_nearest_vectors(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.4 * r.standard_normal(24)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[50][1]) for i in range(40)]  # ties
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [1.0, None] * 12), (5005, [float("inf")] * 24), (None, [1.0] * 24)]
    rows += [(5050, [1.0, 2.0]), (5051, [1.0, 2.5]), (5100, rows[0][1]), (5100, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 50 = 0")
    got = collections.defaultdict(list)
    for x in collision_search.nearest(df, asked).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    use = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            use.setdefault(i, np.array(v, np.float64))
    hits = total = 0
    for q in (i for i in use if i % 50 == 0):
        near = sorted((-round(float(v @ use[q] / np.linalg.norm(v) / np.linalg.norm(use[q])), 12), i) for i, v in use.items() if i != q and len(v) == len(use[q]))[:5]
        mine = sorted(got.pop(q))
        assert [k for k, *_ in mine] == list(range(1, len(near) + 1))
        assert all(abs(s - use[q] @ use[i] / np.linalg.norm(use[q]) / np.linalg.norm(use[i])) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in near})
        total += len(near)
    assert hits >= 0.98 * total and not got
    assert collision_search.nearest(df.limit(0), asked).count() == 0 and collision_search.nearest(df, asked.limit(0)).count() == 0


def nearest_of(rows, q, v, k):
    """The k best (score, id) of rows of the query's width, by all cosines."""
    v = np.array(v, np.float64)
    near = [(-round(float(np.array(x, np.float64) @ v / np.linalg.norm(x) / np.linalg.norm(v)), 10), i) for i, x in rows if i != q and len(x) == len(v)]
    return [i for _, i in sorted(near)[:k]]


def test_blocks_of_vectors_meet_in_no_join(spark):
    """Copies of the queries' blocks were broadcast: the join's size was estimated before they were copied."""
    r = np.random.default_rng(4)
    rows = [(i, r.standard_normal(16).astype(np.float32).tolist()) for i in range(900)]
    rows += [(5000 + i, r.standard_normal(3).astype(np.float32).tolist()) for i in range(60)] + [(6000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several blocks of queries, so several columns
    try:
        for kind in ("array<double>", "array<float>"):
            found = collision_search.nearest(df, df.where("vec_id % 3 = 0").selectExpr("vec_id", f"cast(embedding as {kind})"), 4)
            got = collections.defaultdict(list)
            for x in sorted(found.collect(), key=lambda x: x["rank"]):
                got[x.query_id].append(x.vec_id)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "Join" not in plan and "Broadcast" not in plan
            want = {i: nearest_of(rows, i, v, 4) for i, v in rows if i % 3 == 0 and i != 6000}
            assert set(got) == set(want)
            assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_cell_keeps_the_best_rows_over_its_blocks():
    r = np.random.default_rng(5)
    rows = [[(1000 * w + i, r.standard_normal(w).tolist()) for i in range(90)] for w in (2, 5, 8)]

    def block(asks, of, width):
        return {"width": width, "asks": asks, "ids": [i for i, _ in of], "values": [x for _, v in of for x in v]}

    cell = [block(False, rows[0], 2)]  # no query has this width
    cell += [block(True, rows[1][:7], 5), block(True, rows[1][7:9], 5)] + [block(False, rows[1][i : i + 30], 5) for i in (0, 30, 60)]
    cell += [block(True, rows[2][:3], 8)]  # no row has this one
    schema = pa.schema([("width", pa.int32()), ("asks", pa.bool_()), ("ids", pa.list_(pa.int64())), ("values", pa.list_(pa.float32()))])
    batches = [pa.RecordBatch.from_pylist(cell[i : i + 3], schema) for i in range(0, len(cell), 3)]
    got = collections.defaultdict(list)
    for b in collision_search.best_of_cell(iter(batches), 3):
        for x in b.to_pylist():
            got[x["query_id"]].append(x["vec_id"])
    assert got == {i: nearest_of(rows[1], i, v, 3) for i, v in rows[1][:9]}


def test_search_ends_where_rounds_one_by_one_end():
    r = np.random.default_rng(6)
    m = r.standard_normal((700, 12))
    for i in range(60):  # some queries have near rows at one distance or another, some are alone
        m[100 + 8 * i : 104 + 8 * i] = m[i] + 10.0 ** -r.integers(0, 5) * r.standard_normal((4, 12))
    m[650:660] = m[3]
    ids = r.permutation(len(m))
    index = collision_search.Index(ids, m)
    for k in (1, 4, 699, 900):
        asked = np.arange(60 if k < 9 else 3)
        got_ids, got = collision_search.search(index, ids[asked], m[asked], k)
        size = np.sqrt((m * m).sum(axis=1))
        placed = (m / size[:, None]) @ index.lines
        ends = set()
        for q in asked:
            score = np.where(ids != ids[q], (m * m[q]).sum(axis=1) / (size * size[q]), -np.inf)
            for radius in [*collision_search.RADII, None]:
                near = score if radius is None else np.where((abs(placed - placed[q]) <= radius).sum(axis=1) >= collision_search.NEEDED, score, -np.inf)
                if radius is None or np.count_nonzero(near >= 1 - radius**2 / 2) >= k:
                    break
            ends.add(radius)
            best = [i for i in np.lexsort((ids, -near))[:k] if near[i] > -np.inf]
            assert got_ids[q][: len(best)].tolist() == ids[best].tolist() and got[q][: len(best)].tolist() == near[best].tolist()
            assert np.isneginf(got[q][len(best) :]).all()
        assert len(ends) > 4 or k > 9


def labelled(spark, n=1500, seed=3):
    """An insult alone is fine, and so is a group; together they are toxic."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(10, 60))]
        insult, group = r.random() < 0.4, r.random() < 0.4
        for on, names in ((insult, ["Fool", "oaf", "dolt"]), (group, ["tall", "north", "old"])):
            if on:
                words.insert(r.randrange(len(words)), r.choice(names))
        docs.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_pairs_of_terms_are_learned(spark):
    docs, labels, truth = labelled(spark)
    rows = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    held = [x for x in rows if x.held_out]
    assert {x.doc_id for x in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    hit = np.mean([x.predicted == truth[x.doc_id] for x in held])
    assert hit > 0.95 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in rows)


def test_toxicity_on_odd_rows(spark, odd, nothing):
    docs, labels, _ = labelled(spark, 400)
    machine = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(odd, machine).collect()
    assert len(rows) == odd.count() and not any(x.held_out for x in rows if x.doc_id is None)
    assert len({x.score for x in rows if x.doc_id in (1, 2, 3)}) == 1
    assert toxicity.toxicity(nothing, machine).count() == 0
    for none in (labels.limit(0), labels.selectExpr("doc_id", "0 toxic"), labels.selectExpr("cast(null as long) doc_id", "toxic")):
        bare = toxicity.fit(docs, none)
        assert len(bare.hashes) == 0 and all(0 < x.score < 1 for x in toxicity.toxicity(odd, bare).collect())


def stages(spark, docs, folder):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(tables.written(stage(spark, out[-1], folder), name))
    return out


def test_pipeline_stage_by_stage(spark, odd, tmp_path):
    docs, labels, _ = labelled(spark, 300)
    long = " ".join(f"p{i}" for i in range(120))
    more = [(1000 + i, f"start{i} " + " ".join(f"q{i}x{k}" for k in range(40)) + f" {long}", "s") for i in range(4)]
    more += [(2000 + i, "\n".join(["A line that stands in all of them", " ".join(f"z{i}y{k}" for k in range(40))]), "t") for i in range(12)]
    rows = docs.selectExpr("doc_id", "text", "'u' source").union(spark.createDataFrame(more, "doc_id long, text string, source string"))
    rows = rows.union(odd.select("doc_id", "text", "source")).selectExpr("doc_id", "text", "'en' lang", "source", "cast(length(text) as long) n_chars")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    start, clean, calm, single, cut_, packed = stages(spark, rows, str(tmp_path))
    assert all(x.columns == rows.columns for x in (clean, calm, single, cut_))

    def text(df):
        return collections.Counter((x.doc_id, x.text) for x in df.collect())

    source = [tuple(x) for x in start.select("doc_id", "text", "source").collect()]
    kept = collections.Counter(x[0] for x in quality(source, 10, 70) if x[-1])
    assert collections.Counter(x.doc_id for x in clean.collect()) == kept
    line = norm("A line that stands in all of them")
    assert not any(norm(y) == line for x in clean.collect() for y in x.text.split("\n"))
    machine = toxicity.fit(clean, labels)
    fine = {x.doc_id for x in toxicity.toxicity(clean, machine).collect() if not x.predicted}
    assert {x.doc_id for x in calm.collect()} == fine
    least = {(i, n) for i, n, c in groups([(x.doc_id, x.text) for x in calm.collect()]) if i == c or c is None}
    assert {x.doc_id for x in single.collect()} == {i for i, _ in least} and single.count() == len({(x.doc_id, x.text) for x in single.collect()})
    before = single.collect()
    gone = {x.doc_id: c[1] for x, c in zip(before, cut([x.text.encode() for x in before], 400), strict=True)}
    assert {x.doc_id: len(x.text.encode()) for x in cut_.collect()} == {x.doc_id: len(x.text.encode()) - gone[x.doc_id] for x in before}
    assert any(gone.values()) and all(x.n_chars == len(x.text) for x in cut_.collect())
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens = {x.doc_id: len(tok.encode(x.text, add_special_tokens=False).ids) + 1 for x in cut_.collect()}
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == tokens


def test_pipeline_of_nothing(spark, nothing, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    assert [x.count() for x in stages(spark, rows, str(tmp_path))] == [0] * 6


def test_pipeline_cuts_passages_of_51_short_words(spark):
    r = random.Random(6)
    own = lambda n: " ".join(f"own{r.randrange(10**9)}" for _ in range(n))
    short, less = " ".join(r.choice("abcdefgh") for _ in range(51)), " ".join(f"{r.choice('stuv')}{k}" for k in range(50))
    texts = [f"{own(30)} {short} {own(30)}", f"{own(30)} {short}", f"{own(20)} {less} {own(9)}", f"{own(20)} {less} {own(8)}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.text for x in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert len(short.encode()) == 101 and all(short not in got[i] and got[i].split()[:30] == texts[i].split()[:30] for i in (0, 1))
    assert [got[2], got[3]] == texts[2:]


def test_pipeline_leaves_other_signs_and_columns_alone(spark):
    both = "é" * 250  # a match of 400 bytes may end inside a sign
    rows = [(1, f"the author's � sign {both}", None, 7), (2, f"another � one\u0301 x{both}", "b", 8), (3, None, "c", 9), (4, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, rest long")
    got = {x.doc_id: tuple(x[1:]) for x in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert got == {1: ("the author's � sign ", None, 7), 2: ("another � one\u0301 x", "b", 8), 3: ("", "c", 9), 4: ("", None, None)}


def test_labels_that_teach_nothing_keep_all_documents(spark, tmp_path):
    docs, labels, _ = labelled(spark, 60)
    some = labels.where(~toxicity.held_out(labels.doc_id))
    cases = [labels.limit(0), labels.where(toxicity.held_out(labels.doc_id)), some.limit(1).selectExpr("doc_id", "0 toxic"), some.selectExpr("doc_id", "1 toxic")]
    cases.append(some.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic"))  # as many toxic as not, tied to no term
    for k, none in enumerate(cases):
        none.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert len(toxicity.fit(docs, none).hashes) == 0
        calm = corpus_pipeline.toxic_documents(spark, docs, f"{tmp_path}/{k}")
        assert sorted(map(tuple, calm.collect())) == sorted(map(tuple, docs.collect()))


def test_toxicity_learns_pairs_of_which_one_says_little_alone(spark):
    """A group is named in half of all texts, toxic ones are those that insult it: its own tie is too small to be chosen."""
    r = random.Random(12)
    rows = []
    for i in range(5000):
        insult, group = r.random() < 0.04, r.random() < 0.5
        body = [f"plain{r.randrange(300)}" for _ in range(6)] + ["zorgish"] * insult + ["marsfolk"] * group
        r.shuffle(body)
        rows.append((i, " ".join(body), int(insult and group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(df, df)
    fixed = [(1, "zorgish marsfolk plain1"), (2, "marsfolk plain2"), (3, "plain3 plain4"), (4, "zorgish plain5 plain6")]
    got = {x.doc_id: x for x in toxicity.toxicity(spark.createDataFrame(fixed, "doc_id long, text string"), machine).collect()}
    assert got[1].score > 2 * got[4].score and [got[i].predicted for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    # The score by its definition, term by term.
    for i, text in fixed:
        _, term = toxicity.terms(*joined(pa.array([text])))
        at = [k for k, h in enumerate(machine.hashes) if h in set(term.tolist())]
        want = machine.bias + sum(machine.weights[k] for k in at) + sum(machine.factors[a] @ machine.factors[b] for a in at for b in at if a < b)
        assert abs(got[i].score - 1 / (1 + math.exp(-want))) < 1e-9
