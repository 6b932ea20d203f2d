"""Cheapest repair of damaged conversations by survivor-coalescence Viterbi.

What may follow what is a machine of four states over the roles given so far: nothing, after a leading system turn, after
a user turn, after an assistant turn. For every turn and state the cheapest sequence of edits survives. Survivors
hang on one tree of backpointers whose nodes count their children: a node that no survivor needs is freed, and as soon as
all survivors share an ancestor its edits are final and leave the tree. So memory is that of the unresolved part; only that
part is ever compared when two sequences cost the same.

A sequence of edits ends, after each turn, in the letter of that turn's edit. Two sequences over the same turns therefore
differ before either ends, and the order between the survivors of two states never changes by what follows. That lets
a long conversation be cut: a segment is summed up by what each state at its start makes of each state at its end, as
costs and ranks; summaries of a conversation's segments are run through the same tree, which gives every segment its
first and last state; then segments are repaired each by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docspark.llm.sharding import CRC_TABLE
from docspark.llm.tables import release, written
from docspark.llm.turn_segments import in_order, segmented

WHITE = " \t\n\x0b\f\r"
# Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States: nothing yet, after a system turn, after a user turn, after an assistant turn. Two of them may be last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INITIALS = "sua"
# A turn's code: three times the place of its role's initial (3: another), and its fault.
SOUND, MUST_GO, CUT_OFF = range(3)


def _inserted() -> dict[int, list[tuple[int, int]]]:
    """From each state: (state, inserted turns) with none, one or two turns inserted."""
    out = {}
    for s in STATES:
        reach, now = {s: 0}, [s]
        for n in (1, 2):
            now = [NEXT[x][p] for p in now for x in "ua" if p in NEXT[x]]
            for q in now:
                reach.setdefault(q, n)
        out[s] = sorted(reach.items())
    return out


INSERTED = _inserted()


def moves(code: int) -> dict[int, list[tuple[int, int, str]]]:
    """For a turn of this code: by state after it, (state before, cost, edits), the best of each pair of states."""
    initial, fault = INITIALS[code // 3 : code // 3 + 1], code % 3
    stay = TRUNCATED if fault == CUT_OFF else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in STATES:
        for at, n in INSERTED[before]:
            ways = [(at, DELETE, "D")]
            if fault != MUST_GO:
                if initial and at in NEXT[initial]:
                    ways.append((NEXT[initial][at], KEEP + stay, "K"))
                ways += [(NEXT[x][at], REROLE + stay, "R") for x in "ua" if at in NEXT[x]]
            for after, cost, edit in ways:
                way = (cost + n * INSERT, "I" * n + edit)
                best[before, after] = min(best.get((before, after), way), way)
    return {s: [(p, *best[p, s]) for p in STATES if (p, s) in best] for s in STATES}


MOVES = [moves(c) for c in range(12)]
# What a conversation that ends in a state still needs: (cost, edits).
ENDS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}

# What it costs one state, at most, to do whatever another may still do: by inserting a turn, or by deleting a system
# turn that comes too late. A survivor that costs more than this above another can't win, nor tie.
BRIDGE = {
    (START, SYSTEM): 0, (START, USER): INSERT, (START, ASSISTANT): 0, (USER, START): INSERT + DELETE, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
    (ASSISTANT, START): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT, (SYSTEM, USER): INSERT,
}


def _hopeful(costs: dict[int, int]) -> dict[int, int]:
    """The survivors that may still win; without this, deleting all there is would keep the tree from being resolved."""
    return {s: c for s, c in costs.items() if not any((t, s) in BRIDGE and c > d + BRIDGE[t, s] for t, d in costs.items())}


class Survivors:
    """The tree of backpointers: survivors by state, with nodes freed and final labels given out as they are resolved."""

    def __init__(self, states: Iterable[int]):
        self.labels: list = [None]
        self.parent = [-1]
        self.children = [0]
        # The children's numbers, all combined by exclusive or: with one child it is that child's number.
        self.child = [0]
        self.free: list[int] = []
        self.base = 0
        self.heads = dict.fromkeys(states, 0)

    def _node(self, parent: int, label) -> int:
        if self.free:
            n = self.free.pop()
            self.labels[n], self.parent[n], self.children[n], self.child[n] = label, parent, 0, 0
        else:
            n = len(self.labels)
            self.labels.append(label)
            self.parent.append(parent)
            self.children.append(0)
            self.child.append(0)
        self.children[parent] += 1
        self.child[parent] ^= n
        return n

    def step(self, chosen: dict[int, tuple[int, object]]) -> list:
        """Each new state's (state before, label); returns the labels that are final now, oldest first."""
        old = self.heads
        self.heads = {s: self._node(old[p], label) for s, (p, label) in chosen.items()}
        for n in set(old.values()):
            while n != self.base and self.children[n] == 0:
                up = self.parent[n]
                self.children[up] -= 1
                self.child[up] ^= n
                self.free.append(n)
                n = up
        return self._resolved()

    def _resolved(self) -> list:
        done, held = [], set(self.heads.values())
        while self.children[self.base] == 1 and self.base not in held:
            n = self.child[self.base]
            done.append(self.labels[n])
            self.free.append(self.base)
            self.base = n
        return done

    def unresolved(self, state: int) -> list:
        """The labels between what has been given out and a survivor, oldest first."""
        out, n = [], self.heads[state]
        while n != self.base:
            out.append(self.labels[n])
            n = self.parent[n]
        return out[::-1]


def _ranked(costs: dict[int, int], order: dict[int, int], ways: dict[int, list[tuple[int, int, object]]]) -> tuple[dict, dict]:
    """One step by costs and ranks: (state: cost), (state: (state before, way))."""
    new, chosen = {}, {}
    for s, options in ways.items():
        options = [(costs[p] + c, order[p], e, p) for p, c, e in options if p in costs]
        if options:
            cost, _, e, p = min(options)
            new[s], chosen[s] = cost, (p, e)
    return new, chosen


def summary(codes: Iterable[int]) -> list[int]:
    """For every first state and last state: cost and rank among the last states' edits; -1 where there is no way."""
    out = []
    codes = list(codes)
    for first in STATES:
        costs, order = {first: 0}, {first: 0}
        for c in codes:
            costs, chosen = _ranked(costs, order, MOVES[c])
            by = sorted(chosen, key=lambda s: (order[chosen[s][0]], chosen[s][1]))
            order = {s: i for i, s in enumerate(by)}
        for last in STATES:
            out += [costs.get(last, -1), order.get(last, -1)]
    return out


def best_edits(codes: Iterable[int], first: int = START, last: int | None = None) -> tuple[int, list[str]]:
    """(cost, edits) of the cheapest sequence from one state to another, of equal ones the ASCII-least.

    Without ``last`` the conversation ends here, in any state, with what that state still needs. Each label holds the
    turns inserted before a turn and the edit of that turn.
    """
    tree, costs, done = Survivors([first]), {first: 0}, []
    for c in codes:
        new, chosen = {}, {}
        for s, options in MOVES[c].items():
            options = [(costs[p] + x, p, e) for p, x, e in options if p in costs]
            if not options:
                continue
            low = min(options)[0]
            tied = [(p, e) for cost, p, e in options if cost == low]
            new[s] = low
            chosen[s] = tied[0] if len(tied) == 1 else min(tied, key=lambda t: "".join(tree.unresolved(t[0])) + t[1])
        costs = _hopeful(new)
        done += tree.step({s: chosen[s] for s in costs})
    if last is None:
        low = min(costs[s] + ENDS[s][0] for s in costs)
        tied = [s for s in costs if costs[s] + ENDS[s][0] == low]
        last = min(tied, key=lambda s: "".join(tree.unresolved(s)) + ENDS[s][1])
        return low, [*done, *tree.unresolved(last), ENDS[last][1]]
    return costs[last], [*done, *tree.unresolved(last)]


def repaired(labels: Iterable[str], roles: list[str], texts: list[str], first: int = START) -> tuple[list[str], list[str]]:
    """The turns that edits give: (roles, texts)."""
    state, out, said, i = first, [], [], 0
    for edit in "".join(labels):
        turn = edit != "I"
        if edit != "D":
            role = roles[i] if edit == "K" else "assistant" if state == USER else "user"
            out.append(role)
            said.append(texts[i] if turn else "")
            state = NEXT[role[0]][state]
        i += turn
    return out, said


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with every fault that a checksum of ``conv_id:turn`` deals out; a null is one space."""

    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    deal = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    said = F.when(deal == 1, "").when(deal == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    rows = conversations.where(deal != 0).select(
        "conv_id", "turn", F.when(deal == 4, "user").otherwise(text_of("role")).alias("role"), said.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(deal == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _coded(conversations: DataFrame) -> DataFrame:
    """Different turns with how often they stand (``n``) and the code of the first and of the other copies."""
    null = {c: F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")}
    rows = conversations.select("conv_id", "turn", *null.values())
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = rows.select("*", F.md5(F.col("text").cast("binary")).alias("digest"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    # What was said in several turns, with the first of them: narrow, and joined back only where there is such a text.
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = rows.where(~F.col("blank")).groupBy("conv_id", "role", "digest").agg(F.count("*").alias("turns"), F.min(when).alias("first"))
    said = said.where(F.col("turns") > 1).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    rows = rows.join(said, same, "left")
    again = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated")
    place = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1)
    return rows.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"), initial.cast("int").alias("initial"))


COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"


def _expanded(row: dict) -> tuple[list[int], list[str], list[str], dict]:
    """(codes, roles, texts, counts) of a segment's turns, copies one after another."""
    codes, roles, texts = [], [], []
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for role, text, n, fault, initial in zip(row["role"], row["text"], row["n"], row["fault"], row["initial"], strict=True):
        code = 3 * initial
        one = code + (SOUND if fault is None else CUT_OFF if fault == "truncated" else MUST_GO)
        codes += [one] + [code + MUST_GO] * (n - 1)
        if fault:
            counts[fault] += 1
        counts["blank" if fault == "blank" else "duplicate"] += n - 1
        roles += [role] * n
        texts += [text] * n
    counts["illegal"] = sum(not legal(a // 3, b // 3) for a, b in zip(codes, codes[1:]))
    known = [t for t in row["turn"] if t is not None]
    counts |= {"turns": len(set(known)), "low": min(known, default=None), "high": max(known, default=None), "head": codes[0] // 3, "tail": codes[-1] // 3}
    return codes, roles, texts, counts


def legal(a: int, b: int) -> bool:
    """Whether initials (places in ``INITIALS``) may stand beside each other."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches, some at a time."""
    for b in batches:
        for i in range(0, b.num_rows, 256):
            yield from b.slice(i, 256).to_pylist()


def _mapped(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` over a stream of rows, which sees a partition in its order."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        held = []
        for r in rows(_rows(batches)):
            held.append(r)
            if len(held) == 256:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)
        release()

    return df.mapInArrow(run, kind)


def _summed(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        codes = _expanded(r)[0]
        yield {
            "conv_id": r["conv_id"], "segment": r["segment"], "ways": summary(codes), "head": codes[0] // 3, "tail": codes[-1] // 3,
            "first_turn": r["turn"][0], "last_turn": r["turn"][-1],
        }


def _walked(rows: Iterator[dict]) -> Iterator[dict]:
    """First and last state of every segment, by the tree over the summaries of each conversation's segments."""
    conv, tree, costs, order = None, None, {}, {}

    def rest() -> Iterator[dict]:
        low = min(costs[s] + ENDS[s][0] for s in costs)
        last = min((s for s in costs if costs[s] + ENDS[s][0] == low), key=lambda s: order[s])
        labels = tree.unresolved(last)
        for at, p, s in labels:
            yield {"segment": at, "first_state": p, "last_state": s, "ends": at == newest}

    newest = None
    for r in rows:
        if tree is None or r["conv_id"] != conv:
            if tree is not None:
                yield from rest()
            conv, tree, costs, order = r["conv_id"], Survivors([START]), {START: 0}, {START: 0}
        w, newest = r["ways"], r["segment"]
        ways = {s: [(p, w[8 * p + 2 * s], w[8 * p + 2 * s + 1]) for p in STATES if w[8 * p + 2 * s] >= 0] for s in STATES}
        costs, chosen = _ranked(costs, order, ways)
        costs = _hopeful(costs)
        chosen = {s: chosen[s] for s in costs}
        order = {s: i for i, s in enumerate(sorted(chosen, key=lambda s: (order[chosen[s][0]], chosen[s][1])))}
        for at, p, s in tree.step({s: (p, (newest, p, s)) for s, (p, _) in chosen.items()}):
            yield {"segment": at, "first_state": p, "last_state": s, "ends": None}
    if tree is not None:
        yield from rest()


def _mended(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        codes, roles, texts, counts = _expanded(r)
        if r["open"]:
            first, last = r["first_state"], r["last_state"]
            cost, labels = best_edits(codes, first, last)
            if r["ends"]:
                cost, labels = cost + ENDS[last][0], [*labels, ENDS[last][1]]
        else:
            first = START
            cost, labels = best_edits(codes)
        out, said = repaired(labels, roles, texts, first)
        yield {"conv_id": r["conv_id"], "segment": r["segment"], "open": r["open"], "cost": cost, "edits": "".join(labels), "roles": out, "texts": said, **counts}


def repair(conversations: DataFrame) -> DataFrame:
    """Segments of repaired conversations: conv_id, segment, open, edits, roles, texts, cost and the faults' counts.

    ``edits`` has a letter for each turn and each insertion, in order; ``roles`` and ``texts`` are the repaired turns. A
    conversation is the sequence of its segments; one whose segment isn't ``open`` has no other. ``illegal`` counts
    neighbours whose roles may not follow each other, ``turns``, ``low`` and ``high`` the different turns, all with what
    stands at the end of the segment before; nulls count for none of the three. A null role or text is one space, a null
    conv_id an id like any other; turns of one number are taken by role and text, and a repeated row stands for
    as many turns. A role that doesn't begin with s, u or a can't be kept. No rows give no rows; other columns are ignored.
    """
    coded = _coded(conversations)
    packed = written(segmented(coded, in_order(), ["turn", "role", "text", "n", "fault", "initial"]), "segments")
    narrow = "conv_id long, segment long, ways array<long>, head int, tail int, first_turn long, last_turn long"
    cut = written(_mapped(packed.where("open"), narrow, _summed), "summaries")
    walk = cut.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "segment", "ways")
    states = _mapped(walk, "segment long, first_state int, last_state int, ends boolean", _walked)
    before = Window.partitionBy("conv_id").orderBy("segment")
    beside = cut.select(
        "segment", F.col("head").alias("own_head"), F.lag("tail").over(before).alias("tail"),
        (F.lag("last_turn").over(before) == F.col("first_turn")).cast("long").alias("same_turn"),
    )
    known = states.join(beside, "segment")
    fields = "conv_id long, segment long, open boolean, cost long, edits string, roles array<string>, texts array<string>, " + COUNTS
    out = _mapped(packed.join(known.select("segment", "first_state", "last_state", "ends"), "segment", "left"), fields, _mended)
    legally = F.array(*(F.lit(f"{a}{b}") for a in range(4) for b in range(4) if legal(a, b)))
    breach = (F.col("tail").isNotNull() & ~F.array_contains(legally, F.concat("tail", "own_head"))).cast("long")
    links = known.select(F.col("segment").alias("link"), breach.alias("breach"), F.coalesce("same_turn", F.lit(0)).alias("same_turn"))
    out = out.join(links, F.col("segment") == F.col("link"), "left")
    return out.withColumns({"illegal": F.col("illegal") + F.coalesce("breach", F.lit(0)), "turns": F.col("turns") - F.coalesce("same_turn", F.lit(0))}).drop("link", "breach", "same_turn")


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    """One row per conversation from its segments in order; texts pass through the hash and aren't kept."""
    conv, edits, h, begun = None, None, None, False

    def done() -> dict:
        return {"conv_id": conv, "audit": "".join(edits), "repaired_sha256": h.hexdigest()}

    for r in rows:
        if edits is None or r["conv_id"] != conv:
            if edits is not None:
                yield done()
            conv, edits, h, begun = r["conv_id"], [], hashlib.sha256(), False
        edits.append(r["edits"])
        for role, text in zip(r["roles"], r["texts"], strict=True):
            h.update(("\n" if begun else "").encode() + f"{role}:{text}".encode())
            begun = True
    if edits is not None:
        yield done()


def repair_digests(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conv_id of ``ids``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A digest runs over a whole conversation in order, so the segments of a cut conversation stream through one task for
    it, one batch at a time; all others are digested where they are. An id without turns has zeros and empty strings.
    """
    parts = written(repair(conversations), "repaired")
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    counts = parts.groupBy("conv_id").agg(gaps, *(F.sum(c).alias(c) for c in sums))
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    whole = parts.where(~F.col("open")).select("conv_id", F.col("edits").alias("audit"), F.sha2(said.cast("binary"), 256).alias("repaired_sha256"))
    cut = parts.where("open").select("conv_id", "segment", "edits", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    digests = whole.unionByName(_mapped(cut, "conv_id long, audit string, repaired_sha256 string", _hashed))
    found = counts.withColumnRenamed("conv_id", "c1").join(digests.withColumnRenamed("conv_id", "c2"), F.col("c1").eqNullSafe(F.col("c2")))
    out = ids.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c1")), "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ["gaps", *sums]}
    empty = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", zeros["gaps"], *(zeros[c] for c in sums), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )


SQL = rf"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT {CRC_TABLE} AS crc),
keyed AS (
  SELECT *, list_transform(regexp_extract_all(hex(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')), '..'),
    lambda x: ('0x' || x)::BIGINT) AS b FROM conversations),
dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 20 AS deal
  FROM keyed, crc_table),
turns AS (
  SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE role END AS role,
    CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, LATERAL (SELECT unnest(range(CASE WHEN deal = 3 THEN 2 ELSE 1 END))) WHERE deal <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM turns),
faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS was FROM placed),
follows(x, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
inserted AS (
  SELECT s AS p, s AS q, 0 AS n FROM range(4) r(s) UNION ALL
  SELECT p, q, 1 FROM follows WHERE x <> 's' UNION ALL
  SELECT f.p, g.q, 2 FROM follows f JOIN follows g ON f.q = g.p WHERE f.x <> 's' AND g.x <> 's'),
best AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS s, {{'cost': 0::BIGINT, 'edits': ''}} AS way FROM (SELECT DISTINCT conv_id FROM faults)
  UNION ALL
  SELECT b.conv_id, b.pos + 1, w.s, min({{'cost': b.way.cost + 5 * n.n + w.cost, 'edits': b.way.edits || repeat('I', n.n) || w.edit}})
  FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos + 1 JOIN inserted n ON n.p = b.s,
  LATERAL (
    SELECT n.q AS s, 2 AS cost, 'D' AS edit UNION ALL
    SELECT q, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END, 'K' FROM follows WHERE p = n.q AND x = f.i AND f.fault NOT IN ('blank', 'duplicate') UNION ALL
    SELECT q, CASE WHEN f.fault = 'truncated' THEN 6 ELSE 1 END, 'R' FROM follows WHERE p = n.q AND x <> 's' AND f.fault NOT IN ('blank', 'duplicate')) w
  GROUP BY b.conv_id, b.pos, w.s),
ended AS (
  SELECT b.conv_id, min({{'cost': b.way.cost + 5 * n.n, 'edits': b.way.edits || repeat('I', n.n)}}) AS way
  FROM best b JOIN (SELECT conv_id, max(pos) AS pos FROM faults GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM b.conv_id AND l.pos = b.pos
  JOIN inserted n ON n.p = b.s AND n.q IN (0, 3) GROUP BY b.conv_id),
edits AS (
  SELECT conv_id, k, substr(edits, k, 1) AS e, k - len(regexp_replace(left(edits, k), '[^I]', '', 'g')) AS pos
  FROM (SELECT conv_id, way.edits AS edits, unnest(range(1, len(way.edits) + 1)) AS k FROM ended)),
kept AS (
  SELECT e.conv_id, e.k, e.e, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.k) AS o, f.role, f.text, f.i
  FROM edits e JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = greatest(e.pos, 1) WHERE e.e <> 'D'),
said AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o + led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS whole
  FROM (SELECT *, (max(CASE WHEN o = 1 AND e = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id)) AS led FROM kept) GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (was IS NOT NULL AND was || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost, coalesce(way.edits, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""
