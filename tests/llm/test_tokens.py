"""Token counts (3), packing (5) and SentencePiece (7) against the libraries."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docspark.llm import packing, piece_encoding, pretokens, token_counts
from docspark.llm.piece_matching import Matcher, Pieces
from docspark.llm.textbytes import joined

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def mixed(n, seed, extra=()):
    r = random.Random(seed)
    signs = [*" \t\n\r\x0b\x0c'''''stmdrevelld123ab!?-éß£中１²١ 　\u0085\x1c­\U0001f600\x00▁", *extra]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_pre_tokens_agree_with_the_library():
    tok = Tokenizer.from_file(BPE)
    texts = mixed(4000, 1, ["<|endoftext|>", "'s", "'re", "'ll", "<|endof"]) + [f"{chr(c)} a{chr(c)}b1{chr(c)}'s" for c in range(1, 0x800)]
    memo = pretokens.Encoder(BPE).open()
    data, offsets = joined(pa.array(texts))
    ids, at = memo.encoded(data, offsets)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == want
    assert memo.counts(data, offsets).tolist() == list(map(len, want))


def test_memo_tells_spans_apart(monkeypatch):
    """Spans of up to 8 bytes by their bytes, longer ones by hash; few slots and starting afresh change nothing."""
    monkeypatch.setattr(pretokens, "SLOTS", 2)
    monkeypatch.setattr(pretokens, "MEMO", 300)
    r = random.Random(4)
    known = pretokens.Known(np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    for _ in range(60):
        data = np.frombuffer(bytes(r.choice(b"\0\0a\xc3\xa9") for _ in range(400)), np.uint8)
        starts = np.array([r.randrange(388) for _ in range(120)])
        ends = starts + np.array([r.choice([1, 1, 2, 7, 8, 9, 12]) for _ in starts])

        def encode(a, b, data=data):
            return np.concatenate([data[x:y] for x, y in zip(a, b, strict=True)]), b - a

        entry = known.find(data, starts, ends, encode)
        got = [known.ids[known.at[e] : known.at[e] + known.size[e]].tolist() for e in entry]
        assert got == [data[a:b].tolist() for a, b in zip(starts, ends, strict=True)]
    assert len(known.find(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), None)) == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(odd, nothing, name):
    tok = Tokenizer.from_file(P.path(name))
    got = collections.Counter(map(tuple, token_counts.count_tokens(odd, P.path(name)).collect()))
    want = collections.Counter()
    for r in odd.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 1024] += 1
    assert got == want and token_counts.count_tokens(nothing, P.path(name)).count() == 0


def test_packing_keeps_every_piece(odd, nothing, documents):
    tok = Tokenizer.from_file(BPE)
    for df in (odd, documents.selectExpr("doc_id", "text")):
        want = collections.Counter()
        for r in df.collect():
            ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids) + 1, 1024)]
            for k, (a, b) in enumerate(itertools.pairwise(cuts)):
                want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
        got = packing.pack(df, BPE).collect()
        assert collections.Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = collections.defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            ends = [0, *itertools.accumulate(n for _, n in sorted(b))]
            assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 1024
        assert len(bins) <= math.ceil(sum(n for b in bins.values() for _, n in b) / 1024) * 1.02 + 1
    assert packing.pack(nothing, BPE).count() == 0


def fewest(items, capacity):
    """The least number of bins, by trying every place for every item."""
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                place(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def test_bin_completion_is_near_the_optimum():
    r = random.Random(4)
    extra = 0
    for _ in range(150):
        capacity = r.randint(6, 24)
        items = sorted((r.randint(1, capacity - 1) for _ in range(r.randint(1, 9))), reverse=True)
        counts = collections.Counter(items)
        got = packing.complete(dict(counts), capacity)
        used = collections.Counter()
        for pattern, n in got:
            assert sum(pattern) <= capacity
            for s in pattern:
                used[s] += n
        assert used == counts
        bins, least = sum(n for _, n in got), fewest(items, capacity)
        assert least >= packing.least_bins(counts, capacity) and bins <= sum(n for _, n in packing.best_fit(dict(counts), capacity))
        extra += bins - least
    assert extra <= 2
    assert packing.dominates((5, 3), (4, 3, 1)) and not packing.dominates((5, 3), (4, 4))


def test_pieces_agree_with_the_library(odd, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = Pieces(PIECES)
    r = random.Random(6)
    words = [sp.id_to_piece(i).replace("▁", " ") for i in range(300, 31000, 11)]
    texts = mixed(2000, 3) + ["".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(4000)] + ["a" * 3000, "ab" * 500, " " * 70]
    data, offsets = joined(pa.array(texts))
    ids, at = Matcher(pieces).encoded(data, offsets)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == sp.encode(texts)
    raw, ends = pieces.decode(ids, at)
    raw = raw.tobytes()
    assert [raw[a:b].decode() for a, b in itertools.pairwise(ends)] == [t.replace("▁", " ") for t in texts]
    encoded = piece_encoding.encode(odd, PIECES)
    assert collections.Counter((x.doc_id, tuple(x.ids)) for x in encoded.collect()) == collections.Counter((x.doc_id, tuple(sp.encode(x.text or ""))) for x in odd.collect())
    back = piece_encoding.decode(encoded, PIECES)
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((x.doc_id, x.text or "") for x in odd.collect())
    assert piece_encoding.encode(nothing, PIECES).count() == 0
    broken = encoded.sparkSession.createDataFrame([(1, [3 + 0xC3, 3 + 0x28]), (2, None)], "doc_id long, ids array<int>")
    assert dict(map(tuple, piece_encoding.decode(broken, PIECES).collect())) == {1: "�(", 2: ""}


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_by_doubling_are_told_apart(spark, n):
    """Such words agree under polynomials modulo a power of two; each must get its own ids."""
    one = "".join("z" if bin(i).count("1") % 2 else "t" for i in range(n))
    two = one.translate(str.maketrans("tz", "zt"))
    df = spark.createDataFrame([(0, one), (1, two), (2, f"{two} {one}")], "doc_id long, text string").coalesce(1)
    tok, sp = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids for r in df.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, BPE).collect()} == {i: len(x) for i, x in ids.items()}
    got = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.pack(df, BPE).collect()}
    for i, x in ids.items():
        x = np.array([*x, 2], "<u4")
        first = len(x) % 1024 or 1024
        cuts = [0, *range(first, len(x) + 1, 1024)]
        assert [got[i, k] for k in range(len(cuts) - 1)] == [zlib.crc32(x[a:b].tobytes()) for a, b in itertools.pairwise(cuts)]
    assert {r.doc_id: list(r.ids) for r in piece_encoding.encode(df, PIECES).collect()} == {r.doc_id: sp.encode(r.text) for r in df.collect()}


def test_registered_piece_query(spark, documents):
    from docspark.llm import queries

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {}
    for r in documents.collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True)
    got = queries.QUERIES["op7_piece_encoding"](spark, "/root/testdata/sf0.001")
    assert {r[0]: tuple(r[1:]) for r in got.select("doc_id", "n_tokens", "ids_sha256", "round_trip").collect()} == want
