"""The trie of shared conversation prefixes, as balanced parentheses in shards.

Every turn has a digest; the digest of a prefix combines its turns' digests with their depths by exclusive or, so it is a
running total that segments of a long conversation can take up from each other. Prefixes with one digest are one node:
members, children, ends and the smallest member are plain counts, combined before they are shuffled. Below a node with one
member the trie is a mere chain, whose sums are known. What is left, the nodes with several members, is walked by one path
for each of its last nodes; paths are range-partitioned in order, and each shard writes its part of the trie as balanced
parentheses. Blocks of the excess with their minima tell where a node closes; the rank of leaf pairs and
cumulative arrays between its two parentheses give its sums. What a node adds to those above it is carried by one path only, so
spines that shards share merge by addition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.sharding import CRC_TABLE
from docspark.llm.tables import map_batches, release, written
from docspark.llm.textbytes import joined, mixed, ranges
from docspark.llm.turn_segments import earlier, in_order, segmented

# Parentheses whose least excess is kept together.
BLOCK = 256
WORD = r"[^\x20\x09-\x0D]+"
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Parentheses:
    """A sequence of balanced parentheses (1 opens, 0 closes) with the least excess of each block."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.excess = np.cumsum(np.where(bits, 1, -1))
        none = np.iinfo(np.int64).max
        blocks = max(1, -(-len(bits) // block))
        self.size = 1 << (blocks - 1).bit_length()
        self.padded = np.full(self.size * block, none)
        self.padded[: len(bits)] = self.excess
        # A tree of minima: node i has children 2i and 2i + 1, block j is node size + j.
        self.tree = np.full(2 * self.size, none)
        self.tree[self.size :] = self.padded.reshape(-1, block).min(axis=1)
        for i in range(self.size.bit_length() - 1, 0, -1):
            low, high = 1 << (i - 1), 1 << i
            self.tree[low:high] = np.minimum(self.tree[high : 2 * high : 2], self.tree[high + 1 : 2 * high : 2])
        # Leaf pairs "()" that begin before a place.
        pair = np.zeros(len(bits) + 1, np.int64)
        pair[1:-1] = bits[:-1] & ~bits[1:]
        self.pairs = np.cumsum(pair)

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.bits)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """For places that open: the first place after them whose excess is one less."""
        wanted = self.excess[at] - 1
        out = self._inside(at // self.block, at, wanted)
        far = np.flatnonzero(out < 0)
        if len(far):
            out[far] = self._inside(self._next_block(at[far] // self.block, wanted[far]), at[far], wanted[far])
        return out

    def _inside(self, block: np.ndarray, after: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The first place of a block beyond ``after`` with the wanted excess, or -1."""
        out = np.full(len(block), -1)
        for i in range(0, len(block), 4096):
            begin = block[i : i + 4096] * self.block
            places = begin[:, None] + np.arange(self.block)
            hit = (self.padded[places] <= wanted[i : i + 4096, None]) & (places > after[i : i + 4096, None])
            found = hit.any(axis=1)
            out[i : i + 4096][found] = (begin + hit.argmax(axis=1))[found]
        return out

    def _next_block(self, block: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The first block after ``block`` whose least excess is low enough, up and down a tree of minima."""
        at = block + self.size
        climbing = np.arange(len(at))
        while len(climbing):
            i = at[climbing] + 1
            while (even := i % 2 == 0).any():
                i[even] //= 2
            at[climbing] = i
            climbing = climbing[self.tree[i] > wanted[climbing]]
        while (inner := at < self.size).any():
            left = at[inner] * 2
            at[inner] = left + (self.tree[left] > wanted[inner])
        return at - self.size


def subtree_sums(bits: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(leaf pairs, sums of each weight) under every node, itself included, nodes in the order they open."""
    tree = Parentheses(bits)
    opens = tree.opens()
    close = tree.findclose(opens)
    rank = np.concatenate([[0], np.cumsum(bits)])  # nodes opened before a place
    first, last = rank[opens], rank[close]
    sums = [np.concatenate([[0], np.cumsum(w)]) for w in weights]
    return tree.pairs[close] - tree.pairs[opens], [s[last] - s[first] for s in sums]


def written_as_parentheses(sizes: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, new) of sorted paths with ``sizes`` nodes, of which ``shared`` are those of the path before.

    ``new`` marks, in the joined paths, the nodes that open.
    """
    closed = np.append(0, sizes[:-1]) - shared
    opened = sizes - shared
    runs = np.stack([closed, opened], axis=1).ravel()
    bits = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    bits = np.concatenate([bits, np.zeros(sizes[-1], bool)])
    place = ranges(np.zeros(len(sizes), np.int64), sizes)
    return bits, place >= np.repeat(shared, sizes)


def _shared(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many nodes each path shares with the one before it; ``keys`` has two words a node."""
    sizes = np.diff(offsets)
    least = np.minimum(sizes[1:], sizes[:-1])
    at = ranges(np.zeros(len(least), np.int64), least)
    here, there = np.repeat(offsets[1:-1], least) + at, np.repeat(offsets[:-2], least) + at
    differ = (keys[here] != keys[there]).any(axis=1)
    out = least.copy()
    which = np.repeat(np.arange(len(least)), least)
    np.minimum.at(out, which[differ], at[differ])
    return np.append(0, out)


def _node_of(new: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The node, by the order of opening, of every place on the joined paths."""
    depth = ranges(np.zeros(len(offsets) - 1, np.int64), np.diff(offsets))
    order = np.argsort(depth, kind="stable")
    latest = np.where(new, depth * len(new) + np.cumsum(new) - 1, 0)[order]
    out = np.empty(len(new), np.int64)
    out[order] = np.maximum.accumulate(latest) % len(new)
    return out


def words_of(digests: pa.Array) -> np.ndarray:
    """16-byte digests as two 64-bit words each."""
    return joined(digests)[0].view(np.uint64).reshape(-1, 2)


def _sums_of(paths: DataFrame) -> DataFrame:
    """(key, leaves, saved) of the nodes of each shard; ``paths``: keys, lone, saved, sorted by keys."""
    out = T.StructType.fromDDL("key binary, leaves long, saved long")

    def make():
        def step(b: pa.RecordBatch):
            lists = b.column(0)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            flat = lists.flatten()
            keys = words_of(flat)
            bits, new = written_as_parentheses(np.diff(offsets), _shared(keys, offsets))
            at = np.flatnonzero(new)
            # A node's own part stands on one path only, which need not be the one that opens it.
            node, own = _node_of(new, offsets), []
            for i in (1, 2):
                own.append(np.zeros(len(at), np.int64))
                np.add.at(own[-1], node, b.column(i).flatten().to_numpy())
            pairs, (lone, saved) = subtree_sums(bits, *own)
            yield pa.RecordBatch.from_arrays([flat.take(pa.array(at)), pa.array(pairs + lone), pa.array(saved)], names=out.names)

        return step

    return map_batches(paths, out, make)


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, start, total, digests and words of every segment of own turns."""
    text = {c: F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")}
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", *text.values())
    said = F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")
    rows = rows.withColumns({"digests": F.unhex(F.md5(said.cast("binary"))), "words": F.regexp_count("text", F.lit(WORD)).cast("long"), "salt": F.rand(1)})
    packed = written(segmented(rows, [*in_order(), F.col("salt")], ["digests", "words"]), "turns")
    size = F.size("digests").cast("long")
    cut = packed.where("open").select("conv_id", "segment", size.alias("n"))
    known = cut.select("segment", F.coalesce(F.sum("n").over(earlier()), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total"))
    own = {"start": F.coalesce("start", F.lit(0)), "total": F.coalesce("total", size)}
    return packed.join(known, "segment", "left").withColumns(own)


def _rebuilt(turns: DataFrame, step: int, heads: Column) -> DataFrame:
    """The segments of the rebuilt conversations: conv_id, segment, open, before (depth above it), last, digests, words."""
    most = 3
    first = turns.where((F.col("conv_id") % step == 0) & (F.col("start") < most))
    first = first.select("conv_id", "start", F.posexplode(F.slice(F.arrays_zip("digests", "words"), 1, most)).alias("i", "t"))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct((F.col("start") + F.col("i")).alias("p"), "t"))).alias("lead"))
    rows = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % step).join(first, "base", "left").withColumn("h", heads)
    lead = F.slice(F.coalesce(F.col("lead.t"), F.array().cast("array<struct<digests:binary,words:bigint>>")), 1, F.col("h").cast("int"))
    rows = rows.withColumn("lead", lead)
    gone = F.greatest(F.col("h") - F.col("start"), F.lit(0))
    own = F.slice(F.arrays_zip("digests", "words"), (gone + 1).cast("int"), F.size("digests"))
    opening = F.col("start") == 0
    long = F.size("lead").cast("long")
    rows = rows.select(
        "conv_id", "segment", "open", opening.alias("opening"), F.when(opening, F.concat("lead", own)).otherwise(own).alias("t"),
        F.when(opening, 0).otherwise(long + F.greatest(F.col("start") - F.col("h"), F.lit(0))).alias("before"),
        (long + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("last"),
    )  # fmt: skip
    return rows.select("conv_id", "segment", "open", "opening", "before", "last", F.col("t.digests").alias("digests"), F.col("t.words").alias("words"))


def _mixed(lists: pa.ListArray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, depths, two words for every turn, which depend on its digest and depth)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    size = np.diff(offsets)
    depth = ranges(before + 1, size)
    lanes = [mixed(w ^ mixed(depth.astype(np.uint64) * np.uint64(lane))) for w, lane in zip(words_of(lists.flatten()).T, LANES, strict=True)]
    return offsets, depth, np.stack(lanes, axis=1)


def _totals(segments: DataFrame) -> DataFrame:
    """segment with what its turns change in the digest of a prefix."""
    out = T.StructType.fromDDL("conv_id long, segment long, x1 long, x2 long")

    def make():
        def step(b: pa.RecordBatch):
            offsets, _, lanes = _mixed(b.column(2), b.column(3).to_numpy())
            run = np.concatenate([np.zeros((1, 2), np.uint64), np.bitwise_xor.accumulate(lanes, axis=0)])
            x = (run[offsets[1:]] ^ run[offsets[:-1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], names=out.names)

        return step

    return map_batches(segments.select("conv_id", "segment", "digests", "before"), out, make)


def _prefixes(segments: DataFrame) -> DataFrame:
    """conv_id, depth, key, up (key of the prefix before), words, ends for every prefix; the root once a conversation."""
    sums = _totals(segments.where("open"))
    sums = sums.select("segment", *(F.coalesce(F.expr(f"bit_xor({x})").over(earlier()), F.lit(0)).alias(x) for x in ("x1", "x2")))
    rows = segments.join(sums, "segment", "left").select("conv_id", "digests", "before", "words", "opening", "last", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("x1", "x2")))
    out = T.StructType.fromDDL("conv_id long, depth long, key binary, up binary, words long, ends boolean")

    def make():
        def step(b: pa.RecordBatch):
            conv, before, last = (b.column(i).to_numpy() for i in (0, 2, 5))
            offsets, depth, lanes = _mixed(b.column(1), before)
            run = np.concatenate([np.zeros((1, 2), np.uint64), np.bitwise_xor.accumulate(lanes, axis=0)])
            size = np.diff(offsets)
            row = np.repeat(np.arange(len(size)), size)
            since = np.stack([b.column(i).to_numpy() for i in (6, 7)], axis=1).view(np.uint64) ^ run[offsets[:-1]]
            root = np.flatnonzero(b.column(4).to_numpy(zero_copy_only=False))
            key, up = run[1:] ^ since[row], run[:-1] ^ since[row]
            none = np.zeros((len(root), 2), np.uint64)
            made = [
                pa.array(np.concatenate([conv[row], conv[root]])),
                pa.array(np.concatenate([depth, np.zeros(len(root), np.int64)])),
                _binary(np.concatenate([key, none])),
                _binary(np.concatenate([up, none])),
                pa.array(np.concatenate([b.column(3).flatten().to_numpy(), np.zeros(len(root), np.int64)])),
                pa.array(np.concatenate([depth == last[row], last[root] == 0])),
            ]
            yield pa.RecordBatch.from_arrays(made, names=out.names)

        return step

    return map_batches(rows, out, make)


def _binary(words: np.ndarray) -> pa.Array:
    at = np.arange(len(words) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(words))])


def _id_digests(ended: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the ids of (key, conv_id), streamed in order through the hash."""
    out = T.StructType.fromDDL("key binary, ends_sha256 string")
    rows = ended.repartition("key").sortWithinPartitions("key", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            keys, done = b.column(0), []
            starts = np.flatnonzero(np.append(True, pa.compute.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False))) if len(keys) else []
            ids = b.column(1).cast(pa.string()).to_pylist()
            for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
                key = keys[int(i)].as_py()
                if key != now:
                    if h is not None:
                        done.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256(",".join(ids[i:j]).encode())
                else:
                    h.update(("," + ",".join(ids[i:j])).encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=out.names)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], names=out.names)
        release()

    return rows.mapInArrow(run, out)


def prefix_trie(conversations: DataFrame, step: int = 20, heads: Column | None = None) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c begins with the first ``heads`` (at most 3; a checksum of c modulo 4) turns of conversation
    ``c - c % step`` and goes on with its own after as many. Turns are ordered by turn, null first, those of one number by role
    and text; repeated rows are turns of their own; a null role or text is empty. Rows without a conv_id belong to
    no conversation and are left out; no rows give no nodes. Other columns are ignored.

    Only the digests that one path shares with another are ever in one row; ids that end at one node stream through its hash.
    """
    if heads is None:
        heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    seen = written(_prefixes(written(_rebuilt(_turns(conversations), step, heads), "rebuilt")), "prefixes")
    ended = F.when(F.col("ends"), F.col("conv_id"))
    nodes = seen.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("up").alias("up"), F.max("words").alias("words"),
        F.count("*").alias("n_convs"), F.count(ended).alias("n_ends"), F.min(ended).alias("ended"),
    )  # fmt: skip
    nodes = written(nodes, "nodes")
    below = nodes.where("depth > 0").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("lone"))
    nodes = written(nodes.join(below, "key", "left").fillna(0, ["n_children", "lone"]), "nodes")

    many = nodes.where("n_convs > 1")
    # A node none of whose children has several members ends a path; its smallest member walks it.
    last = many.join(many.where("depth > 0").select(F.col("up").alias("key")), "key", "left_anti").select(F.col("conv_id").alias("walker"), F.col("depth").alias("until"))
    walked = seen.join(last, (F.col("conv_id") == F.col("walker")) & (F.col("depth") <= F.col("until"))).select("walker", "depth", "key", "until")
    walked = written(walked, "walked")
    own = many.join(walked.groupBy("key").agg(F.min("walker").alias("walker")), "key")
    # The pair of a path's last node counts for one leaf already.
    is_last = many.join(last, (F.col("conv_id") == F.col("walker")) & (F.col("depth") == F.col("until")), "left_semi").select(F.col("key").alias("leaf"))
    own = own.join(is_last, F.col("key") == F.col("leaf"), "left")
    lone = F.when(F.col("leaf").isNotNull(), F.greatest(F.col("lone"), F.lit(1)) - 1).otherwise(F.col("lone"))
    own = own.select("key", "walker", lone.alias("lone"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    steps = walked.join(own, ["walker", "key"], "left").fillna(0, ["lone", "saved"])
    paths = steps.groupBy("walker").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "lone", "saved"))).alias("p"))
    paths = paths.select(F.col("p.key").alias("keys"), F.col("p.lone").alias("lone"), F.col("p.saved").alias("saved"))
    sums = _sums_of(paths.sort("keys")).groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    several = nodes.where("n_ends > 1").select("key")
    digests = _id_digests(seen.where("ends").join(several, "key", "left_semi").select("key", "conv_id"))
    top = nodes.where("depth = 0").select("conv_id").first()
    above = nodes.where("n_children > 0 AND depth > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("above"))
    out = nodes.join(sums, "key", "left").join(digests, "key", "left").join(above, "up", "left")
    parent = F.when(F.col("depth") == 1, F.lit(top["conv_id"] if top else None).cast("long")).when(F.col("depth") > 1, F.col("above"))
    one = F.sha2(F.coalesce(F.col("ended").cast("string"), F.lit("")).cast("binary"), 256)
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", one).alias("ends_sha256"),
    )  # fmt: skip


SQL = rf"""
WITH crc_table AS MATERIALIZED (SELECT {CRC_TABLE} AS crc),
rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, list_transform(regexp_extract_all(hex(conv_id::VARCHAR), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM rows),
convs AS (
  SELECT conv_id, base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 4 AS h
  FROM keyed, crc_table),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, r.pos, r.role, r.text FROM convs c JOIN rows r ON r.conv_id = c.base AND r.pos <= c.h UNION ALL
  SELECT c.conv_id, 1, r.pos, r.role, r.text FROM convs c JOIN rows r ON r.conv_id = c.conv_id AND r.pos > c.h),
deep AS (
  SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^ 	-]+')) AS words,
    string_agg(md5(len(role) || ':' || role || text), '') OVER w AS key FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
prefixes AS (SELECT conv_id, 0 AS depth, 0 AS words, '' AS key FROM convs UNION ALL SELECT * FROM deep),
nodes AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(words) AS words, count(*) AS n_convs FROM prefixes GROUP BY key),
ends AS (
  SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id) JOIN prefixes USING (conv_id, depth) GROUP BY key),
kids AS (SELECT left(key, len(key) - 32) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (key)),
under AS (
  SELECT left(key, 32 * d::INT) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_nodes n JOIN under u USING (key) LEFT JOIN ends e USING (key) LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, len(n.key) - 32)
"""
