"""Repair of conversations and their prefix trie against brute force and SQL, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from docspark.llm import prefix_trie, turn_repair, turn_segments
from tools.check import rows_of

WHITE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(rows):
    """The cheapest edits of (initial, fault) rows by trying all."""
    best = None
    for before in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("KRD", repeat=len(rows)):
            cost, audit, seqs = 5 * sum(before), "", [""]
            for i in range(len(rows) + 1):
                for _ in range(before[i]):
                    seqs, audit = [q + x for q in seqs for x in "ua"], audit + "I"
                if i == len(rows):
                    break
                (initial, fault), e = rows[i], edits[i]
                audit += e
                if e == "D":
                    cost += 2
                    continue
                if fault == 1 or (e == "K" and initial not in "sua"):
                    seqs = []
                    break
                cost += 5 * (fault == 2) + (e == "R")
                seqs = [q + x for q in seqs for x in (initial if e == "K" else "ua")]
            if any(re.fullmatch("(s?(ua)+)?", q) for q in seqs):
                best = min(best or (cost, audit), (cost, audit))
    return best


def literal(rows):
    """The same by keeping the whole string of every state."""
    follows = turn_repair.NEXT

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for s, (c, t) in list(out.items()):
                for x in "ua":
                    if s in follows[x]:
                        out[follows[x][s]] = min(out.get(follows[x][s], (c + 5, t + "I")), (c + 5, t + "I"))
        return out

    best = {0: (0, "")}
    for initial, fault in rows:
        new = {}
        for s, (c, t) in inserted(best).items():
            ways = [(s, c + 2, t + "D")]
            if fault != 1:
                extra = 5 if fault == 2 else 0
                ways += [(follows[initial][s], c + extra, t + "K")] if initial in follows and s in follows[initial] else []
                ways += [(follows[x][s], c + 1 + extra, t + "R") for x in "ua" if s in follows[x]]
            for s2, *way in ways:
                new[s2] = min(new.get(s2, tuple(way)), tuple(way))
        best = new
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def code(initial, fault):
    return 3 * ("sua".index(initial) if initial in "sua" else 3) + fault


def test_edits_against_all_there_are():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 3))]
        cost, labels = turn_repair.best_edits([code(*r) for r in rows])
        assert (cost, "".join(labels)) == exhaustive(rows) == literal(rows)


def test_edits_and_cut_conversations_against_whole_strings():
    rng = random.Random(4)
    for _ in range(800):
        rows = [(rng.choice("suuaaax"), rng.choice([0, 0, 0, 0, 1, 2])) for _ in range(rng.randint(1, 40))]
        codes = [code(*r) for r in rows]
        cost, labels = turn_repair.best_edits(codes)
        assert (cost, "".join(labels)) == literal(rows)
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, rng.randint(0, 5))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        states = {r["segment"]: r for r in turn_repair._walked({"conv_id": 1, "segment": i, "ways": turn_repair.summary(p)} for i, p in enumerate(parts))}
        got, total = "", 0
        for i, p in enumerate(parts):
            c, e = turn_repair.best_edits(p, states[i]["first_state"], states[i]["last_state"])
            got, total = got + "".join(e), total + c
            if states[i]["ends"]:
                c, e = turn_repair.ENDS[states[i]["last_state"]]
                got, total = got + e, total + c
        assert (total, got) == (cost, "".join(labels))


def test_the_tree_stays_small():
    rng = random.Random(5)
    tree, costs, most, given = turn_repair.Survivors([0]), {0: 0}, 0, 0
    for c in (rng.randrange(12) for _ in range(20_000)):
        chosen = {s: min((costs[p] + x, p, e) for p, x, e in ways if p in costs) for s, ways in turn_repair.MOVES[c].items() if any(p in costs for p, _, _ in ways)}
        costs = turn_repair._hopeful({s: w[0] for s, w in chosen.items()})
        given += len(tree.step({s: chosen[s][1:] for s in costs}))
        most = max(most, len(tree.labels))
    assert most < 400 and given > 19_000


def by_hand(rows):
    """Every contract column of damaged rows, from lists."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            deal = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
            turns += [(turn, "user" if deal == 4 else role, text)] * (0 if deal == 0 else 2 if deal == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        counts, seen, coded = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in turns:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            coded.append((role[:1] or "?", {"blank": 1, "duplicate": 1, "truncated": 2, None: 0}[fault]))
        cost, audit = literal(coded)
        said, i = [], 0
        for e in audit:
            role, text = (turns[i][1], turns[i][2]) if e != "I" else ("", "")
            if e != "D":
                follows = "user" if not said or said[-1][0][0] in "sa" else "assistant"
                said.append((role if e == "K" else follows, text))
            i += e != "I"
        known = {t for t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum((a[0] + b[0]) not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def odd_rows(seed=0, convs=40):
    rng = random.Random(seed)
    texts = ["Well. ", "no end", "", " \t", "a!", "ß?\n", "same text.", "é.", None, "x" * 5000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = []
    for c in [None, *range(convs)]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([None, t, t, t, 3]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts)))
    return rows + rows[:5]


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_repair_on_odd_rows(spark, batch):
    rows = odd_rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", fault string, n int")
        got = turn_repair.repair_digests(turn_repair.damaged(df), df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[0]: tuple(r[1:]) for r in got} == by_hand(rows) and len(got) == 41


def test_one_long_conversation_in_many_segments(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", "more.", "cut", f"own {t}."])) for t in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        parts = turn_repair.repair(turn_repair.damaged(df))
        assert parts.count() > 20
        got = turn_repair.repair_digests(turn_repair.damaged(df), df).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tuple(got[1:]) == by_hand(rows)[7]


def test_copies_of_one_turn_are_one_row_until_they_are_edits(spark):
    df = spark.createDataFrame([(1, 1, "user", "hello.")] * 500 + [(1, 2, "assistant", "yes.")], SCHEMA)
    got = turn_repair.repair(df).first()
    assert got["edits"] == "K" + "D" * 499 + "K" and got["cost"] == 998 and got["duplicate"] == 499 and got["roles"] == ["user", "assistant"]


def test_nothing_to_repair(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(none).count() == 0 and turn_repair.repair_digests(none, none).count() == 0
    assert prefix_trie.prefix_trie(none).count() == 0
    dropped = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, dropped, "user", "gone.")], SCHEMA)
    assert tuple(turn_repair.repair_digests(turn_repair.damaged(df), df).first()) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_parentheses_close_where_they_should():
    rng = np.random.default_rng(1)
    for block in (2, 3, 64):
        for n in (1, 2, 5, 40, 700):
            stack, bits, want, left = [], [], {}, n
            while left or stack:
                if left and (not stack or rng.random() < rng.choice([0.3, 0.5, 0.9])):
                    stack.append(len(bits))
                    bits.append(True)
                    left -= 1
                else:
                    want[stack.pop()] = len(bits)
                    bits.append(False)
            tree = prefix_trie.Parentheses(np.array(bits), block)
            opens = tree.opens()
            close = tree.findclose(opens)
            assert close.tolist() == [want[o] for o in opens]
            leaves = [sum(bits[i] and not bits[i + 1] for i in range(o, c)) for o, c in zip(opens, close)]
            assert (tree.pairs[close] - tree.pairs[opens]).tolist() == leaves
            weight = rng.integers(0, 9, n)
            _, [sums] = prefix_trie.subtree_sums(np.array(bits), weight)
            assert sums.tolist() == [sum(w for w, p in zip(weight, opens) if o <= p < c) for o, c in zip(opens, close)]


def trie_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        path = [t[2:] for t in sorted(own.get(base, []))[:h] + sorted(turns)[h:]]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    out = []
    for k, m in members.items():
        under = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(re.findall(rb"[^\x20\x09-\x0D]+", x[-1][1])) for x in under if x)
        kids = [x for x in under if len(x) == len(k) + 1]
        leaves = sum(not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in under) for x in under)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids), leaves, saved, digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", ["5", "10000"])
def test_trie_on_odd_rows(spark, batch):
    rng = random.Random(2)
    rows = odd_rows(1, 50)
    for c in range(100, 160):  # copies, long shared beginnings, one conversation that is a prefix of others
        rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(rng.choice([4, 4, 9, 30]))]
        rows += [(c, 50, "user", rng.choice("ab"))] * rng.choice([0, 1, 2])
    rows += [(-7, 1, "user", "below zero"), (-20, 1, "user", "also")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, key string").repartition(3)
        got = [tuple(r) for r in prefix_trie.prefix_trie(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == trie_by_hand(rows)


def test_segments_hold_every_row_in_order(spark):
    rows = [(c, t, "user", f"{t:05}") for c in (1, 2, 3) for t in range(c * 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = turn_segments.segmented(df, turn_segments.in_order(), ["turn"], rows=4).orderBy("segment").collect()
    assert [t for r in got for t in r["turn"]] == [r[1] for r in rows] and max(len(r["turn"]) for r in got) == 4


@pytest.mark.parametrize("name, module", [("op11_turn_repair", turn_repair), ("op13_prefix_trie", prefix_trie)])
def test_sql_twins_on_odd_rows(spark, tmp_path, name, module):
    from docspark.llm import queries

    rows = odd_rows(6, 30)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    df = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(module.SQL)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
