"""What is counted and cut in one pass over a text, against the patterns that say the same one at a time."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docspark.functions import spans
from docspark.functions import text as tx
from docspark.functions import vectors as vx
from docspark.functions.counts import text_counts, token_runs
from docspark.operators import chunking, cleaning, entities, features, quality
from docspark.streaming import ingest

ODD = ["　", " ", "\x85", "\xa0", "\x1c", "\x0b", "İ", "K", "é", "É", "語", "7", "'", "\U0001d400", "ß", "\r", "​"]
WORDS = ["--- PAGE 3 ---", "Subject:", "to:", "Invoice", "due ", "e ", "The ", "|", "\n\n\n\n", "  "]


def odd_texts(n=1500):
    r = random.Random(3)
    parts = list("aeiouyEbcdTZ.?!  \n\t") + ODD + WORDS
    texts = ["".join(r.choice(parts) for _ in range(r.choice([0, 1, 2, 3, 6, 20, 200]))) for _ in range(n)]
    return [(i, t) for i, t in enumerate([None, "", " ", "\n", *texts])]


def test_counts_are_those_of_the_patterns(spark):
    c = F.col("t")
    want = {
        "chars": F.char_length(c), "dense": F.char_length(F.regexp_replace(c, tx.WS, "")), "letters": F.char_length(F.regexp_replace(c, r"\P{L}", "")),
        "words": tx.word_count(c), "sentences": tx.sentence_count(c), "propers": tx.proper_nouns(c), "syllables": tx.syllables(c),
        **{k: tx.count_contained(F.lower(c), w) for k, w in features.FAMILIES.items()},
    }
    df = spark.createDataFrame(odd_texts(), "id int, t string").withColumn("n", text_counts(**features.FAMILIES)(c))
    wrong = df.select("id", "t", *(F.when(~F.col("n")[k].eqNullSafe(v), k).alias(k) for k, v in want.items()))
    assert wrong.where(" OR ".join(f"{k} IS NOT NULL" for k in want)).collect() == []


def test_the_white_space_of_the_pattern_is_that_of_python(spark):
    rows = [(i, chr(i)) for i in range(0x3100)]
    white = {r.i for r in spark.createDataFrame(rows, "i int, c string").where(F.col("c").rlike(tx.WS)).collect()}
    assert white == set(map(ord, tx.SPACES)) == {i for i, c in rows if c.isspace()}


def test_fixed_chunks_are_made_of_the_sentences_of_the_pattern(spark):
    docs = spark.createDataFrame(odd_texts(), "doc_id int, t string")
    sents = docs.select("doc_id", "t", tx.sentences(F.col("t")).alias("s"), F.transform(tx.sentences(F.col("t")), tx.word_count).alias("n"))
    want = set()
    for r in sents.where(~tx.is_blank(F.col("t"))).collect():
        for i, (a, b) in enumerate(chunking._fixed_spans(r.n, 8, 3)):
            text = " ".join(r.s[a : b + 1])
            want.add((r.doc_id, i, text, sum(r.n[a : b + 1]), r.t.find(r.s[a]), r.t.find(r.s[a]) + len(text), a))
    got = chunking.fixed(docs, "t", 8, 3).select("doc_id", "chunk_index", "text", "token_count", "char_start", "char_end", "sentence_start")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_fixed_chunks_of_a_text_from_a_lambda_function(spark):
    docs = spark.createDataFrame([(1, "One two. Three."), (2, " ")], "doc_id int, t string")
    made = docs.select("doc_id", F.array_join(F.transform(F.split("t", " "), F.upper), " ").alias("t"))
    assert [(r.doc_id, r.text) for r in chunking.fixed(made, "t").collect()] == [(1, "ONE TWO. THREE.")]


def test_collapsed_white_space_and_text_without_page_marks(spark):
    df = spark.createDataFrame(odd_texts(), "id int, t string")
    one = F.regexp_replace("t", r"[\x0b\x0c\x1c-\x1f\x{85}\p{Z}]+", " ")
    plain = F.regexp_replace(F.regexp_replace(one, r"\n{3,}", "\n\n"), f"^{tx.WS}+|{tx.WS}+$", "")
    assert df.where(~tx.collapse_whitespace(F.col("t")).eqNullSafe(plain)).collect() == []
    out = cleaning.remove_boilerplate(df.where(F.regexp_count("t", F.lit(tx.PAGE_MARK)) < 2), "t", "o")
    assert out.where(~F.col("o").eqNullSafe(F.col("t"))).collect() == []


def test_documents_stay_where_they_are_for_their_language(spark):
    docs = spark.createDataFrame([(i, "abc abd " * 9 if i % 2 else "xyz xyw " * 9, "en" if i % 2 else "fr") for i in range(40)], "doc_id int, text string, lang string")
    model = quality.train_language_model(docs).persist()
    found = quality.identify_language(docs.repartition(4).select("doc_id", "text"), model)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "cell_row" not in plan and "Broadcast" in plan
    assert {(r.doc_id, r.detected) for r in found.collect()} == {(i, "en" if i % 2 else "fr") for i in range(40)}
    model.unpersist()


def test_tokens_of_a_worker_are_those_of_the_pattern(spark):
    df = spark.createDataFrame([r for r in odd_texts(400) if r[1] is not None], "id int, t string").select("t", F.lower("t").alias("low"), tx.tokens(F.col("t")).alias("n"))
    assert all(vx.tokens(r.low) == r.n for r in df.collect())


def test_a_text_without_digits_is_searched_for_other_patterns(spark):
    df = spark.createDataFrame([(1, "Ref AB-x here"), (2, "Paid $12 for AB-x")], "id int, t string")
    found = df.select("id", entities.extract_entities(F.col("t"), patterns={"REF": r"\bAB-\w"}).alias("s")).collect()
    assert {r.id: [(s.label, s.text) for s in r.s] for r in found} == {1: [("REF", "AB-x")], 2: [("MONEY", "$12"), ("REF", "AB-x")]}


def test_a_cleaned_text_is_what_the_patterns_make_of_it(spark):
    every = [(100_000 + i, f"a{chr(i)}{chr(i)}b {chr(i)} c") for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3400 or 0xF900 <= i < 0x1E000 or i > 0xE0000 and i < 0xE0200)]
    pages = [(900_000 + i, t) for i, t in enumerate(["--- PAGE 1 ---\nSame line\na  b\n\n\n\n--- PAGE 2 ---\nSame line\nc\n--- PAGE 3 ---\nSame line\nd", "---  PAGE 1 --- ---  PAGE 2 --- x"])]
    df = spark.createDataFrame(odd_texts() + every + pages, "id int, t string")
    steps = df.withColumn("n", tx.nfkc(F.coalesce("t", F.lit("")))).withColumn("n", tx.strip_controls(F.col("n")))
    want = cleaning.remove_boilerplate(steps, "n", "b").select("id", tx.collapse_whitespace(F.col("b")).alias("want"))
    assert cleaning.clean(df, "t").join(want, "id").where(~F.col("clean_text").eqNullSafe(F.col("want"))).collect() == []


def literal_cut(text, size, overlap):
    text = text.strip()
    sents, start = [], 0
    for i in range(1, len(text)):
        if text[i].isspace() and text[i - 1] in ".!?":
            sents, start = [*sents, text[start:i].strip()], i
    sents = [s for s in [*sents, text[start:].strip()] if s]
    counts = [len(s.split()) for s in sents]
    return [(" ".join(sents[a : b + 1]), a, sum(counts[a : b + 1]), sents[a]) for a, b in chunking._fixed_spans(counts, size, overlap)]


def test_chunks_are_those_of_sentences_cut_one_by_one():
    texts = [t for _, t in odd_texts(600)] + ["One two. Three!\n\nFour?  Five six. " * 40, "no end " * 30]
    for size, overlap in ((7, 2), (512, 64), (1, 0)):
        got = chunking._cut(texts, size, overlap)
        for t, chunks in zip(texts, got, strict=True):
            want = None if t is None else [(c, s, n, t.find(head)) for c, s, n, head in literal_cut(t, size, overlap)]
            assert want == (None if chunks is None else [(c["text"], c["sentence_start"], c["token_count"], c["char_start"]) for c in chunks])
    assert chunking._cut([], 7, 2) == []


def test_a_worker_digests_a_token_once(monkeypatch):
    vx._memo.clear()
    asked, md5 = [], vx.hashlib.md5
    monkeypatch.setattr(vx.hashlib, "md5", lambda b: asked.append(b) or md5(b))
    first = vx.hash_embed([["a", "b", "a"], None, ["é"]], 64)
    assert (vx.hash_embed([["a", "b", "a"], None, ["é"]], 64) == first).all() and sorted(asked) == [b"a", b"b", "é".encode()]
    monkeypatch.setattr(vx, "MEMO", 2)  # three are more than it may keep
    assert (vx.hash_embed([["é"]], 64)[0] == first[2]).all() and set(vx._memo) == {"é"}


def test_the_gate_reads_a_text_once_and_tells_rows_of_one_id_apart(spark):
    long = "The invoice was paid on time. " * 9
    rows = [(i, t, uri) for i, t, uri in [(1, long, "a"), (2, long, "a"), (2, long + "x", "b"), (3, long + "y", None)]]
    docs = spark.createDataFrame(rows, "doc_id long, raw_text string, source_uri string").selectExpr(
        "doc_id", "timestamp_seconds(doc_id) AS ingestion_ts", "'pdf' AS source_type", "source_uri", "raw_text", "CAST(raw_text AS binary) AS raw_bytes",
        "CAST(octet_length(raw_text) AS long) AS byte_size", "sha2(raw_text, 256) AS checksum", "'en' AS language", "CAST(NULL AS int) AS page_count", "'{}' AS metadata",
    )
    checked = ingest.gate(docs, spark.createDataFrame([], ingest.KEYS), None)
    got = sorted((r.doc_id, r.source_uri or "", r.failure_reason, r.existing_doc_id, r.features.doc_type_signal) for r in checked.collect())
    assert got == [(1, "a", None, None, "invoice"), (2, "a", "duplicate_document", 1, "invoice"), (2, "b", None, None, "invoice"), (3, "", None, None, "invoice")]
    alone = ingest.read_rows(docs, None)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    one = alone.select("features.*").collect()
    assert sorted(one) == sorted(features.document_features(docs).collect())


def test_tokens_of_many_texts_are_those_of_each():
    texts = [(t or "").lower() for _, t in odd_texts(600)] + ["²x_y\u0345 ٣é\U0001d7d8", "", "a"]
    for some in (texts, [t for t in texts if t.isascii()], ["", ""], [" "], []):
        lens, found = token_runs(some)
        want = [vx.tokens(t) for t in some]
        assert found.to_pylist() == [x for w in want for x in w] and lens.tolist() == [len(w) for w in want]
        out = [v for part in vx.hash_embed_text(16).func(iter([pa.array(some, pa.string())])) for v in part.to_pylist()]
        assert np.array_equal(np.array(out).reshape(-1, 16), vx.hash_embed(want, 16))


def test_a_sentence_is_looked_for_only_in_texts_of_few(monkeypatch):
    asked = []
    monkeypatch.setattr(spans, "SEARCHED", 100)
    monkeypatch.setattr(spans.np, "isin", lambda *a, f=np.isin: asked.append(1) or f(*a))
    assert spans.first_places("one two. three.", ["two."]) == [4] and not asked
    assert spans.first_places("one two. " * 30, ["two.", "one two. o", "four"]) == [4, 0, -1] and asked


def test_a_text_without_page_marks_has_no_blank_page(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["", "no", "--- PAGE 1 ---", "--- PAGE 1 ---\nx", "x--- PAGE 1 ---\n \n--- PAGE 2 ---\ny", "--- PAGE x"])], "id int, t string")
    rows = df.select("id", quality.blank_page(F.col("t")).alias("b"), features.page_count(F.col("t")).alias("n")).collect()
    assert {r.id: (r.b, r.n) for r in rows} == {0: (False, 1), 1: (False, 1), 2: (True, 1), 3: (False, 1), 4: (True, 2), 5: (False, 1)}
