"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

A file's headers are its lines; a licence file is also looked at whole. Terms are runs of letters and digits in
lower case. A term's weight is its count times ``1 - ln(share)``, where share is that of all files that hold it, ``RARE``
if smaller. Shares are counted for all terms, so a line's score doesn't depend on how many files there are: a table
repeated any number of times has the same verdicts. The ``COMMON`` terms of most files go to the tasks; the others of
lines that may still reach the limit meet their shares in a join. A file whose best cosine reaches
``LEAST`` has that template's licence. Any other file takes the licence of the nearest directory above it that
holds a licence file with one, by joins on directory paths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.tables import fields, map_batches, written
from docspark.llm.textbytes import LOWER, Spans, chunks, joined, ranges
from docspark.llm.toxicity import WORD

LEAST = 0.5
# The least share of files that a term's weight tells from none, and the terms whose shares tasks receive.
RARE, COMMON = 1e-4, 4096
FILES = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"
# Wordings by which the licences themselves ask to be named, or their opening words.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("proprietary", "All rights reserved."),
]


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every term; terms never cross texts."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, Spans(data).of(starts, ends)


class Vocabulary:
    """The templates' terms; their number is fixed."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        data, offsets = joined(pa.array([t for _, t in templates]))
        starts, hashes = _terms(data, offsets)
        self.hashes = np.unique(hashes)
        self.counts = np.zeros((len(templates), len(self.hashes)))
        np.add.at(self.counts, (np.searchsorted(offsets, starts, "right") - 1, np.searchsorted(self.hashes, hashes)), 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _frequencies(files: DataFrame, text: str) -> DataFrame:
    """term, n: files that hold each term; all files under the null term."""

    def make():
        def step(b: pa.RecordBatch):
            data, offsets = joined(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([b.num_rows])], names=["term", "n"])
            for i, j in chunks(offsets):
                starts, hashes = _terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                doc = np.searchsorted(offsets[i : j + 1] - offsets[i], starts, "right") - 1
                order = np.lexsort((doc, hashes))
                hashes, doc = hashes[order], doc[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                term, n = np.unique(hashes[fresh], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

        return step

    return map_batches(files.select(text), "term long, n long", make).groupBy("term").agg(F.sum("n").alias("n"))


def _weights(files: DataFrame, text: str) -> DataFrame:
    """term, idf of all terms of at least a share of ``RARE`` of the files."""
    counts = written(_frequencies(files, text), "term-files")
    total = (counts.where(F.col("term").isNull()).agg(F.sum("n")).first()[0] or 0) or 1
    return counts.where(F.col("term").isNotNull() & (F.col("n") / F.lit(float(total)) >= RARE)).select("term", (1 - F.log(F.col("n") / F.lit(float(total)))).alias("idf"))


UNITS = "array<struct<line: int, template: int, dot: double, norm: double, terms: array<struct<term: bigint, tf: bigint>>>>"


class Matcher:
    """Lines and whole files that may reach ``LEAST``: what tasks hold is of fixed size."""

    def __init__(self, templates: list[tuple[str, str]], weights: DataFrame):
        self.vocabulary = v = Vocabulary(templates)
        known = {r["term"]: r["idf"] for r in weights.where(F.col("term").isin(v.hashes.view(np.int64).tolist())).collect()}
        self.idf = np.array([known.get(t, 1 - np.log(RARE)) for t in v.hashes.view(np.int64).tolist()])
        self.weights = v.counts * self.idf
        self.weights /= np.sqrt((self.weights**2).sum(axis=1, keepdims=True))
        common = weights.orderBy("idf", "term").limit(COMMON).collect()
        hashes = np.array([r["term"] for r in common], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.common, self.common_idf = hashes[order], np.array([r["idf"] for r in common], np.float64)[order]

    def units(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> pa.Array:
        """Per text its hopeful units: line (-1: the whole file), best template, product, squared norm so far, other terms."""
        count, idf, weights = len(whole), self.idf, self.weights
        begins = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
        first = np.searchsorted(begins, offsets)
        line_text = np.searchsorted(offsets, begins, "right") - 1
        starts, hashes = _terms(data, offsets)
        unit = np.searchsorted(begins, starts, "right") - 1
        term = self.vocabulary.find(hashes)
        again = whole[line_text[unit]] if len(unit) else np.zeros(0, bool)
        # Whole licence files are units after all lines.
        unit, term, hashes = (np.concatenate(x) for x in ((unit, len(begins) + line_text[unit[again]]), (term, term[again]), (hashes, hashes[again])))
        units = len(begins) + count
        known = term >= 0
        pair, tf = np.unique(unit[known] * len(idf) + term[known], return_counts=True)
        u, v = pair // len(idf), pair % len(idf)
        dots = np.zeros((units, len(weights)))
        value = tf * idf[v]
        np.add.at(dots, u, value[:, None] * weights[:, v].T)
        best = dots.argmax(axis=1)
        dot = dots[np.arange(units), best]
        norm = np.bincount(u, value**2, units).astype(np.float64)  # counts of nothing are whole numbers
        hopeful = (norm > 0) & (dot >= LEAST * np.sqrt(norm) * (1 - 1e-9))
        rest = hopeful[unit] & ~known
        order = np.lexsort((hashes[rest], unit[rest]))
        ru, rh = unit[rest][order], hashes[rest][order]
        new = np.flatnonzero(np.concatenate([[True], (ru[1:] != ru[:-1]) | (rh[1:] != rh[:-1])])) if len(ru) else np.zeros(0, np.int64)
        tf = np.diff(np.append(new, len(ru)))
        ru, rh = ru[new], rh[new]
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, rh), len(self.common) - 1)
            shared = self.common[at] == rh
            norm += np.bincount(ru[shared], (tf[shared] * self.common_idf[at[shared]]) ** 2, units)
            ru, rh, tf = ru[~shared], rh[~shared], tf[~shared]
        hopeful &= dot >= LEAST * np.sqrt(norm) * (1 - 1e-9)
        hope = np.flatnonzero(hopeful)
        text_of = np.where(hope < len(begins), line_text[np.minimum(hope, len(begins) - 1)], hope - len(begins))
        line = np.where(hope < len(begins), hope - first[text_of], -1)
        order = np.argsort(text_of, kind="stable")
        hope, line, text_of = hope[order], line[order], text_of[order]
        a, z = np.searchsorted(ru, hope), np.searchsorted(ru, hope, "right")
        take = ranges(a, z - a)
        terms = pa.StructArray.from_arrays([pa.array(rh[take].view(np.int64)), pa.array(tf[take])], ["term", "tf"])
        terms = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(z - a)]), pa.int32()), terms)
        made = [pa.array(line, pa.int32()), pa.array(best[hope], pa.int32()), pa.array(dot[hope]), pa.array(norm[hope]), terms]
        made = pa.StructArray.from_arrays(made, ["line", "template", "dot", "norm", "terms"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of, np.arange(count + 1)), pa.int32()), made)


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``keep`` columns, path, own_license, own_score and own_line of every file.

    The best template by cosine, earlier lines and templates first; own_line is -1 for a whole licence file. Below
    ``LEAST`` all three are null. A null text or path is empty. Repeated rows are files of their own.
    """
    keep = keep or []
    weights = _weights(files, text)
    matcher = Matcher(templates, weights)
    name = F.element_at(F.split(F.col(path), "/"), -1)
    rows = files.select(*keep, F.coalesce(path, F.lit("")).alias("path"), F.coalesce(name.rlike(FILES), F.lit(False)).alias("whole"), F.col(text).alias("body"))
    out = fields(rows, [*keep, "path"], ("license_row", T.LongType()), ("license_units", T.DataType.fromDDL(UNITS)))

    def make():
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40

        def step(b: pa.RecordBatch):
            nonlocal at
            k = len(keep) + 1
            data, offsets = joined(b.column(k + 1))
            whole = b.column(k).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets):
                units = matcher.units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], whole[i:j])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:k]), pa.array(np.arange(at, at + j - i)), units], names=out.names)
                at += j - i

        return step

    found = written(map_batches(rows, out, make), "licence-units")
    unit = found.where(F.size("license_units") > 0).select("license_row", F.posexplode("license_units").alias("nth", "u"))
    term = unit.select("license_row", "nth", F.explode("u.terms").alias("t")).select("license_row", "nth", "t.*").join(weights, "term", "left")
    weight = F.col("tf") * F.coalesce("idf", F.lit(1 - float(np.log(RARE))))
    others = term.groupBy("license_row", "nth").agg(F.sum(weight * weight).alias("more"))
    score = F.col("u.dot") / F.sqrt(F.col("u.norm") + F.coalesce("more", F.lit(0.0)))
    scored = unit.join(others, ["license_row", "nth"], "left").select("license_row", "u.line", "u.template", score.alias("score")).where(F.col("score") >= LEAST)
    best = scored.groupBy("license_row").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "line", "template", "score")).alias("b"))
    label = F.element_at(F.array(*(F.lit(n) for n, _ in templates)), F.col("b.template") + 1)
    return found.join(best, "license_row", "left").select(
        *keep, "path", F.when(F.col("b").isNotNull(), label).alias("own_license"), F.col("b.score").alias("own_score"), F.col("b.line").alias("own_line")
    )


def _directory(path: Column) -> Column:
    """The path without its last part; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def licenses(files: DataFrame, path: str = "path", text: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``scan`` with license, inherited (from a directory) and license_dir for every file.

    A directory with several licence files has the one of best score, then of least name. The nearest directory wins
    whatever its score. Files with no licence above them have null. No rows give no rows.
    """
    keep = keep or []
    found = written(scan(files, path, text, keep, templates).withColumn("dir", _directory(F.col("path"))), "licences")
    name = F.element_at(F.split("path", "/"), -1)
    held = found.where(F.col("own_license").isNotNull() & name.rlike(FILES))
    held = held.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l")))["l"].alias("license"))
    # Every directory with a file, once, against the directories above it.
    dirs = found.where(F.col("own_license").isNull()).select(F.col("dir").alias("below")).distinct()
    parts = F.filter(F.split("below", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))
    near = dirs.select("below", F.explode(above).alias("a")).select("below", "a.*").join(held, "dir")
    near = near.groupBy("below").agg(F.max(F.struct("depth", "dir", "license")).alias("n"))
    out = found.join(near.select(F.col("below").alias("dir"), "n"), "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        *keep, "path", "own_license", "own_score", "own_line", F.coalesce("own_license", "n.license").alias("license"),
        (~own & F.col("n").isNotNull()).alias("inherited"), F.when(~own, F.col("n.dir")).alias("license_dir"),
    )


def filed(docs: DataFrame) -> DataFrame:
    """The documents as files: sources are repositories, ids fill three levels of directories of eight.

    One document of each directory is its licence file.
    """
    i = F.col("doc_id")
    top, middle, leaf = (F.floor(i / 512).cast("string"), F.pmod(F.floor(i / 64), F.lit(8)).cast("string"), F.pmod(F.floor(i / 8), F.lit(8)).cast("string"))
    place = (
        F.when(i % 512 == 1, F.concat_ws("/", "source", top, F.lit("LICENSE")))
        .when(i % 64 == 2, F.concat_ws("/", "source", top, middle, F.lit("LICENSE")))
        .when(i % 8 == 3, F.concat_ws("/", "source", top, middle, leaf, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", top, middle, leaf, F.concat(i.cast("string"), F.lit(".txt"))))
    )
    return docs.withColumn("path", place)


def _sql() -> str:
    rows = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"regexp_extract_all({}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"
    return rf"""
WITH t(i, name, body) AS (VALUES {rows}),
tw AS (SELECT i, name, w, count(*)::DOUBLE AS tf FROM (SELECT i, name, unnest({words.format(low.format("body"))}) AS w FROM t) GROUP BY ALL),
files AS (
  SELECT doc_id, coalesce(text, '') AS body,
    CASE WHEN doc_id % 512 = 1 THEN source || '/' || doc_id // 512 || '/LICENSE'
         WHEN doc_id % 64 = 2 THEN source || '/' || doc_id // 512 || '/' || doc_id // 64 % 8 || '/LICENSE'
         WHEN doc_id % 8 = 3 THEN source || '/' || doc_id // 512 || '/' || doc_id // 64 % 8 || '/' || doc_id // 8 % 8 || '/LICENSE'
         ELSE source || '/' || doc_id // 512 || '/' || doc_id // 64 % 8 || '/' || doc_id // 8 % 8 || '/' || doc_id || '.txt' END AS path
  FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS body FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM files)),
units AS (SELECT * FROM lines UNION ALL SELECT doc_id, -1, body FROM files WHERE path LIKE '%/LICENSE'),
uw AS (SELECT doc_id, line, w, count(*)::DOUBLE AS tf FROM (SELECT doc_id, line, unnest({words.format(low.format("body"))}) AS w FROM units) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS total FROM documents),
df AS (SELECT w, count(DISTINCT doc_id)::DOUBLE AS df FROM uw WHERE line >= 0 GROUP BY w),
idf AS (SELECT w, 1 - ln(greatest(coalesce(df, 0) / total, {RARE})) AS idf FROM (SELECT w FROM tw UNION SELECT w FROM df) LEFT JOIN df USING (w), n),
tv AS (SELECT i, name, w, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY i)) AS v FROM tw JOIN idf USING (w)),
uv AS (SELECT doc_id, line, w, tf * idf AS v FROM uw JOIN idf USING (w)),
norms AS (SELECT doc_id, line, sqrt(sum(v * v)) AS norm FROM uv GROUP BY ALL),
scores AS (
  SELECT doc_id, line, i, name, sum(uv.v * tv.v) / norm AS score FROM uv JOIN tv USING (w) JOIN norms USING (doc_id, line) GROUP BY doc_id, line, i, name, norm),
own AS (
  SELECT doc_id, name AS own_license, score AS own_score, line::INT AS own_line FROM scores WHERE score >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, line, i) = 1),
found AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own_license, own_score, own_line FROM files LEFT JOIN own USING (doc_id)),
held AS (SELECT dir, own_license AS license FROM found WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1),
near AS (
  SELECT f.doc_id, h.license, h.dir FROM found f JOIN held h ON own_license IS NULL AND (f.dir = h.dir OR starts_with(f.dir, h.dir || '/'))
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(h.dir) DESC) = 1)
SELECT doc_id, path, own_license, round(own_score, 6) AS own_score, own_line, coalesce(own_license, license) AS license,
  own_license IS NULL AND license IS NOT NULL AS inherited, near.dir AS license_dir
FROM found LEFT JOIN near USING (doc_id)
"""


SQL = _sql()
