"""Context trees against a literal coder, held-out accuracy, odd rows."""

import math
import random

import numpy as np

from docspark.llm import context_trees as trees


class Literal:
    """The same code lengths from dictionaries, with exclusions taken as sets."""

    def __init__(self, texts):
        self.seen = {}
        for t in texts:
            p = bytes(trees.ORDER) + t
            for i in range(trees.ORDER, len(p)):
                for j in range(trees.ORDER + 1):
                    follow = self.seen.setdefault(p[i - j : i], {})
                    follow[p[i]] = follow.get(p[i], 0) + 1

    def shares(self, context):
        """The share of every byte after a context; they must add up to one."""
        out, left, gone = {}, 1.0, set()
        for j in range(trees.ORDER, -1, -1):
            follow = {k: v for k, v in self.seen.get(context[len(context) - j :], {}).items() if k not in gone}
            if follow:
                n, q = sum(follow.values()), len(follow)
                out |= {k: left * v / (n + q) for k, v in follow.items()}
                left, gone = left * q / (n + q), gone | set(follow)
        return out | {b: left / (256 - len(gone)) for b in range(256) if b not in gone}

    def bits(self, text):
        p = bytes(trees.ORDER) + text
        return sum(-math.log2(self.shares(p[i - trees.ORDER : i])[p[i]]) for i in range(trees.ORDER, len(p)))


def flat(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def grown(texts):
    data, offsets = flat(texts)
    found, n = np.unique(trees.windows(data, offsets, 0, len(data))[1], return_counts=True)
    return trees.Tree(found, n)


def some(rng, n, letters):
    return bytes(rng.choice(letters) for _ in range(n))


def test_code_lengths_against_a_literal_coder(monkeypatch):
    rng = random.Random(1)
    learned = [some(rng, 300, b"abcab "), b"", some(rng, 400, b"aab \x00"), b"xyz"]
    literal, tree = Literal(learned), grown(learned)
    assert all(abs(sum(literal.shares(c).values()) - 1) < 1e-9 for c in (b"\0\0\0\0", b"abca", b"zzzz", b"ab a"))
    texts = [some(rng, rng.randint(0, 60), b"abc xyz\x00q\xc3") for _ in range(30)] + [b"", b"\0\0"]
    data, offsets = flat(texts)
    got = trees.Coder([tree]).lengths(data, offsets)[0]
    assert all(abs(literal.bits(t) - n / trees.UNIT) < 1e-4 for t, n in zip(texts, got))
    monkeypatch.setattr(trees, "SLICE", 13)
    monkeypatch.setattr(trees, "KEPT", 3)  # nearly every window meets another in its place
    assert (trees.Coder([tree]).lengths(data, offsets)[0] == got).all()


def test_held_out_texts_are_told_apart(spark):
    rng = random.Random(2)
    words = {"de": ["und", "nicht", "straße", "haben", "zwischen"], "en": ["the", "which", "through", "have", "and"], "es": ["que", "años", "los", "porque", "niño"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(300) for lang in [rng.choice(list(words))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = trees.languages(df, trees.grow(df), keep=["doc_id", "lang"]).where("held_out").collect()
    assert len(got) > 60 and all(r["lang_pred"] == r["lang"] and r["score"] > 0.99 for r in got)
    # Held-out rows teach nothing: with another language in them the result is the same.
    lied = df.withColumn("lang", trees.F.when(trees.held_out(trees.F.col("doc_id")), "xx").otherwise(trees.F.col("lang")))
    again = trees.languages(df, trees.grow(lied), keep=["doc_id", "lang"]).where("held_out").collect()
    assert sorted(again) == sorted(got)


def test_odd_rows(spark, odd, nothing):
    model = trees.grow(odd)
    assert model.names == ["en"]
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in trees.languages(odd, model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (7, "en", 1.0), (4, "en", 1.0), (None, "en", 1.0)} <= got
    assert trees.languages(odd, model, keep=["doc_id", "k1", "body"]).count() == odd.count()
    none = trees.grow(nothing)
    assert none.names == [] and {r["lang_pred"] for r in trees.languages(odd, none).collect()} == {"und"}
    assert trees.languages(nothing, model).count() == 0


def test_ties_go_to_the_first_name(spark):
    rows = [(i, "the very same words", lang) for i, lang in enumerate(["b", "a", "c"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = trees.languages(df, trees.grow(df)).select("lang_pred", "score").distinct().collect()
    assert len(got) == 1 and got[0]["lang_pred"] == "a" and abs(got[0]["score"] - 1 / 3) < 1e-9


def test_the_sample_is_bounded(spark):
    rows = [(i, f"text number {i} of many", "en" if i % 3 else "de") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    per = {r["lang"]: r["count"] for r in trees.sampled(df, "doc_id", "text", "lang", 40, 1 << 20).groupBy("lang").count().collect()}
    assert set(per) == {"en", "de"} and max(per.values()) <= 20 and min(per.values()) >= 15
    assert trees.sampled(df, "doc_id", "text", "lang", 40, 100).count() <= 8
