"""Suffix-array repeats (6), near-duplicates (9) and their parts against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from docspark.llm import components, minhash, repeats
from docspark.llm.suffix_arrays import common_prefixes, suffix_array


def lcp(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_suffix_arrays_and_common_prefixes():
    r = random.Random(5)
    for _ in range(400):
        signs = r.choice([b"a", b"ab", b"abc\x00\xff", bytes(range(256))])
        s = bytes(r.choice(signs) for _ in range(r.randint(0, 50))) * r.randint(1, 3)
        data = np.frombuffer(s, np.uint8)
        order = suffix_array(data)
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert order.tolist() == want
        if s:
            prefix, before = common_prefixes(data, order)
            assert all(prefix[i] == lcp(s[i:], s[j:]) and before[i] == j for j, i in zip(want[:-1], want[1:], strict=True))


def cut(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def compare(df, length, **more):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    want = collections.Counter((i, *c) for (i, _), c in zip(rows, cut([t for _, t in rows], length), strict=True))
    got = repeats.remove_repeats(df, length=length, **more)
    assert collections.Counter(map(tuple, got.drop("rest").collect())) == want


@pytest.mark.parametrize("shard, rounds", [(repeats.SHARD, 1), (500, 4), (100, 1)])
def test_repeats(spark, shard, rounds, monkeypatch):
    monkeypatch.setattr(repeats, "ROUNDS", rounds)
    r = random.Random(7)
    prose = lambda n: " ".join(r.choice(["be", "to", "the", "où", "a", "zz", "of"]) + str(r.randint(0, 99)) for _ in range(n))
    passage, common = prose(40), prose(12)
    texts = [f"{prose(30)} {passage} {prose(20)}" for _ in range(12)]
    texts += [f"{prose(9)}{passage[:r.randint(30, 200)]}{prose(5)}" for _ in range(15)]
    texts += [f"{common}{prose(20)}{common}", "a" * 300, "ab" * 90, texts[0], texts[0], prose(60), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compare(df, 60, shard=shard, heavy=2 * shard)


def doubled(n, x="t", y="z"):
    """A string by doubling; with its complement it agrees under any polynomial modulo a power of two."""
    return "".join(y if bin(i).count("1") % 2 else x for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_strings_by_doubling_are_told_apart(spark, n):
    texts = [doubled(n), doubled(n, "z", "t"), "one two three " + doubled(n), "one two three " + doubled(n, "z", "t"), doubled(n) + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compare(df, 400)
    words = [f"a b c {doubled(n)} e f g", f"a b c {doubled(n, 'z', 't')} e f g", f"x {doubled(n)}", f"x {doubled(n, 'z', 't')}"]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {0, 1, 2, 3}


def test_a_common_string_among_many_others(spark):
    """Every text has one string in other surroundings: one owner holds them all and has to be dealt anew."""
    r = random.Random(11)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    common = some(50)
    pairs = [f"{some(80)}{common}{some(90)}" for _ in range(60)]
    texts = [p for q in pairs for p in ((q, some(20) + q) if r.random() < 0.3 else (q,))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compare(df, 60, shard=1000, heavy=1000)


def passages_by_hand(texts, least, length):
    """Words in repeated strings of ``least`` words, and what stays without all passages."""
    split = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", t)] for t in texts]
    said = [[t[a:b] for a, b in w] for t, w in zip(texts, split)]
    seen = collections.Counter(tuple(w[i : i + least]) for w in said for i in range(len(w) - least + 1))
    byte_runs = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t, w, at in zip(texts, said, split):
        words = {j for i in range(len(w) - least + 1) if seen[tuple(w[i : i + least])] > 1 for j in range(i, i + least)}
        gone = {p for i in range(len(t) - length + 1) if byte_runs[t[i : i + length]] > 1 for p in range(i, i + length)}
        starts = [i for i in range(len(w) - least + 1) if seen[tuple(w[i : i + least])] > 1]
        for i in starts:
            gone |= set(range(at[i][0], at[i + least - 1][1]))
        kept, place = [], 0
        for ch in t.decode():
            size = len(ch.encode())
            if not any(p in gone for p in range(place, place + size)):
                kept.append(ch)
            place += size
        kept = "".join(kept)
        out.append((len(words), len(t) - len(kept.encode()), kept))
    return out


def test_passages_of_words_and_bytes(spark):
    r = random.Random(13)
    words = lambda n: [r.choice(["to", "été", "a", "�", "zz"]) + str(r.randint(0, 40)) for _ in range(n)]
    passage = words(14)
    texts = [" ".join([*words(r.randint(0, 9)), *passage[: r.randint(8, 14)], *words(5)]) for _ in range(25)]
    texts += ["  ".join(passage), "\n".join(passage[2:]), "", None, "é" * 80, "x" + "é" * 80, texts[0], "a � b"]
    df = spark.createDataFrame([(i, t, "e", "s") for i, t in enumerate(texts)], "doc_id long, text string, `of.words` string, spans string")
    got = {x.doc_id: (x.passage_words, x.passage_bytes, x.rest) for x in repeats.remove_passages(df, least=12, length=60).collect()}
    assert [got[i] for i in range(len(texts))] == passages_by_hand([(t or "").encode() for t in texts], 12, 60)
    plain = repeats.remove_repeats(df, length=60).drop("rest").collect()
    both = repeats.remove_passages(df, least=12, length=60, rest=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(both) == sorted(plain)


def test_repeats_on_odd_rows_and_documents(odd, nothing, documents):
    compare(odd, 400)
    compare(documents.select("doc_id", "text"), 400)
    assert repeats.remove_repeats(nothing).count() == 0


def test_runs_do_not_depend_on_slices(monkeypatch, spark):
    r = random.Random(8)
    text = "".join(r.choice("abcd ") for _ in range(5000))
    df = spark.createDataFrame([(1, text), (2, text[1000:3000])], "doc_id long, text string")
    monkeypatch.setattr(repeats, "SLICE", 700)
    compare(df, 100)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def groups(rows):
    """(key, shingles, least key reachable) by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y):
                label[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return collections.Counter((i, len(s), least.get(root(a)) if s else i) for a, (i, s) in enumerate(sets))


def near(df):
    got = minhash.near_duplicates(df).collect()
    assert all(r.kept == ((r.doc_id == r.component_id) if r.component_id is not None else True) for r in got)
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark, documents):
    r = random.Random(9)
    words = [[f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(4)]
    rows = [edited(r, w, r.choice([0, 1, 2, 3, 4, 5, 6, 9, 20])) for w in words for _ in range(40)]
    rows += [rows[0].upper(), rows[0], "one two", "One TWO", "three", "", None]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(df) == groups(rows)
    rows = [tuple(x) for x in documents.select("doc_id", "text").collect()]
    assert near(documents) == groups(rows)


def test_near_duplicates_on_odd_rows(odd, nothing):
    assert near(odd) == groups([(r.doc_id, r.text) for r in odd.collect()])
    assert minhash.near_duplicates(nothing).count() == 0


def test_tiles_find_links_between_components(monkeypatch, spark):
    """A chain: the bucket's hub links with none of the far ones, which link among themselves."""
    monkeypatch.setattr(minhash, "TILE", 4)
    r = random.Random(11)
    base = [f"c{i}" for i in range(120)]
    chain, now = [], list(base)
    for k in range(30):
        now[(k * 4) % 120] = f"x{k}"
        chain.append(" ".join(now))
    r.shuffle(chain)
    rows = list(enumerate(chain))
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == groups(rows)


def test_estimate_follows_the_similarity(spark):
    r = random.Random(12)
    r = np.random.default_rng(12)
    a = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for shared in (4000, 3000, 1000):
        b = np.concatenate([a[:shared], r.integers(0, 1 << 63, 4000 - shared, dtype=np.uint64)])
        sig = [minhash.packed(minhash.minima(np.unique(x))[None, :])[0].view(np.int64).tolist() for x in (a, b)]
        df = spark.createDataFrame([tuple(sig)], "a array<long>, b array<long>")
        assert abs(df.select(minhash.similarity(df.a, df.b)).first()[0] - shared / (8000 - shared)) < 0.2


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (5, 9), (4, 4), (2, 1)] + [(100 + i, 101 + i) for i in range(60)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {2: 1, 3: 1, 6: 5, 7: 5, 8: 5, 9: 5, **{101 + i: 100 for i in range(60)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
