"""Licence scans by DataFrame functions alone.

Short statements are sought in the lines of whole texts, cut into overlapping windows, each
long enough to hold any template whole; a statement within a longer line counts if it
makes up most of one. Headers and licence files run over lines: their passages are sought
in windows of all words of a text, sized to each template and beginning at every quarter of
it and where its first two words stand, so comment marks, line breaks and what stands
before do not matter. A window's sparse
TF-IDF vector is compared with the template's by cosine; a file's licence is its best
window's. Lines are first held against the anchor words: a cosine of ``least`` needs a
shared word outside some words of each template whose weights together stay under
``least``, so no match is lost. Passages are sought in texts with one of the ``SIGNALS``,
and only texts, then windows, whose shared words weigh enough for ``least`` are looked at
further. Files without a licence of their own take that of the licence file in the nearest
ancestor directory, found by equi-joins of directories on paths: first for each distinct
directory, then for its files.

Defined results: a null or empty text has no licence of its own; a null path has no
directory, so it inherits none; rows that repeat a key are judged each by its own text; of equally good
templates the first by name wins, of licence files in a directory the best, then the
first by path; very long texts are judged whole, as rows of words; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core
from .license_texts import PASSAGES

#: Licence statements to compare with (SPDX id, text).
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and distribute this software is granted under the ISC License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Words that other texts hold too often to be anchors, if others suffice.
COMMON = frozenset("a and are as at by for form forms in is of or subject terms that the this to under use with without work".split())
LEAST = 0.75
DIGITS = 4
#: Every passage holds one of them; texts without any hold no passage.
SIGNALS = ("licens", "permission", "redistribut", "unencumbered")
#: A word: letters, digits and inner dots or hyphens, of the lower-cased text.
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)[^/]*$"


class Model:
    """Inverse document frequencies and unit vectors of the templates."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST) -> None:
        bags = {name: Counter(re.findall(WORD, text.lower())) for name, text in sorted(templates)}
        df = Counter(t for bag in bags.values() for t in bag)
        self.unseen = round(math.log(1 + len(bags)) + 1, 6)
        self.idf = {t: round(math.log((1 + len(bags)) / (1 + n)) + 1, 6) for t, n in sorted(df.items())}
        self.window = max(sum(bag.values()) for bag in bags.values())
        self.vectors: dict[str, dict[str, float]] = {}
        for name, bag in bags.items():
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in bag.items()))
            self.vectors[name] = {t: round(n * self.idf[t] / norm, 6) for t, n in bag.items()}
        self.sizes = {name: sum(bag.values()) for name, bag in bags.items()}
        self.first = {name: re.findall(WORD, text.lower())[:2] for name, text in templates}
        # few words, such that without them no template reaches the least cosine
        need = {name: 1 - (least * 0.999) ** 2 for name in bags}
        words = sorted(self.idf, key=lambda t: (-len(t), t))
        self.anchors: list[str] = []
        while max(need.values()) > 0:
            gain = {t: sum(min(v.get(t, 0.0) ** 2, max(0.0, need[name])) for name, v in self.vectors.items()) for t in words}
            best = max(words, key=lambda t: gain[t] * (1e-4 if t in COMMON else 0.02 if len(t) < 3 else 1))
            self.anchors.append(best)
            words.remove(best)
            for name, v in self.vectors.items():
                need[name] -= v.get(best, 0.0) ** 2


def _weights(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair))


def passages(files: DataFrame, model: Model, key: list[str], text: str, least: float = LEAST) -> DataFrame:
    """``key, license, score`` of the windows that hold a passage; ``files`` are those with a signal."""
    spark, c = files.sparkSession, F.col
    texts = files.select(*key, F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)).alias("ws")).where(F.size("ws") > 0)
    rows = [(name, model.sizes[name], t, v, model.idf[t]) for name, vector in model.vectors.items() for t, v in vector.items()]
    vocabulary = F.broadcast(spark.createDataFrame(rows, "name string, size int, t string, v double, idf double"))
    idf = F.broadcast(spark.createDataFrame(sorted(model.idf.items()), "t string, idf double"))
    # by the inequality of Cauchy and Schwarz a cosine is at most the norm of the shared
    # weights: those of a whole text first, then of each window
    enough = (least * 0.999) ** 2
    known = texts.select(*key, F.explode(F.array_distinct("ws")).alias("t")).join(vocabulary, "t")
    kinds = known.groupBy(*key, "name", "size").agg(F.sum(c("v") * c("v")).alias("bound")).where(c("bound") >= enough).groupBy(*key).agg(F.collect_list(F.struct("name", "size")).alias("kinds"))
    texts = texts.alias("w").join(kinds.alias("h"), [c(f"w.{k}").eqNullSafe(c(f"h.{k}")) for k in key]).select("w.*", "h.kinds")
    words = texts.select(*key, F.posexplode("ws").alias("pos", "t"))
    # windows begin at every quarter of a template, and where its first two words stand
    tried = texts.select(*key, "ws", F.explode("kinds").alias("k"))
    first = F.create_map(*(x for name, two in sorted(model.first.items()) for x in (F.lit(name), F.array(*map(F.lit, two)))))
    tried = tried.withColumn("first", first[c("k.name")])
    begins = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: (F.get("ws", i) == F.get("first", F.lit(0))) & (F.get("ws", i + 1) == F.get("first", F.lit(1))))
    starts = tried.select(*key, "k.name", "k.size", F.explode(F.array_union(F.sequence(F.lit(0), F.size("ws") - 1, F.ceil(c("k.size") / 4).cast("int")), begins)).alias("start"))

    def meet(windows: DataFrame, words: DataFrame, width: Column, *also: str) -> DataFrame:
        """Windows and the words in them, by equi-joins on pieces of ``width`` words."""
        pieces = F.sequence(F.floor(c("start") / width), F.floor((c("start") + c("size") - 1) / width))
        own = windows.withColumn("piece", F.explode(pieces)).alias("h")
        part = words.withColumn("piece", F.floor(c("pos") / width)).alias("w")
        same = [c(f"w.{k}").eqNullSafe(c(f"h.{k}")) for k in key] + [c(f"w.{k}") == c(f"h.{k}") for k in ("piece", *also)]
        return own.join(part, [*same, c("w.pos") >= c("h.start"), c("w.pos") < c("h.start") + c("h.size")]).select("h.*", *(f"w.{x}" for x in words.columns if x not in windows.columns))

    shared = meet(starts, words.join(vocabulary, "t"), c("size"), "name").groupBy(*key, "name", "size", "start", "t", "v", "idf").agg(F.count("*").alias("n"))
    likely = shared.groupBy(*key, "name", "size", "start").agg(F.sum(c("v") * c("v")).alias("bound"), F.sum(c("n") * c("idf") * c("v")).alias("dot")).where(c("bound") >= enough).drop("bound")
    counted = meet(likely, words, F.lit(64)).groupBy(*key, "name", "start", "dot", "t").agg(F.count("*").alias("n"))
    weighed = counted.join(idf, "t", "left").withColumn("w", c("n") * F.coalesce("idf", F.lit(model.unseen)))
    norms = weighed.groupBy(*key, "name", "start", "dot").agg(F.sqrt(F.sum(c("w") * c("w"))).alias("norm"))
    return norms.select(*key, F.substring_index("name", " ", 1).alias("license"), F.round(c("dot") / c("norm"), DIGITS).alias("score")).where(c("score") >= least)


def own(files: DataFrame, model: Model, key: list[str], text: str, least: float = LEAST, long: Model | None = None) -> DataFrame:
    """``key, license, score`` of the files whose text states a licence."""
    anchor = "(?i)" + "|".join(re.escape(a) if len(a) > 2 else rf"\b{re.escape(a)}\b" for a in model.anchors)
    # whole texts first: few are split into lines, and the expression is evaluated once
    signal = "(?i)" + "|".join(SIGNALS)
    some = files.where(F.col(text).rlike(f"{anchor}|{signal[4:]}" if long else anchor))
    if long:  # the one look at all texts; few are left
        some = core.stage(some, "candidates")
    lines = some.select(*key, F.explode(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(anchor))).alias("line"))
    n = model.window
    words = lines.select(*key, F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), F.lit(1)).alias("words")).where(F.size("words") > 0)
    cut = words.select(*key, F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - n - 1), F.lit(n)), lambda i: F.slice("words", i + 1, F.lit(2 * n)))).alias("words"))
    cut = cut.select(*key, F.transform(F.array_distinct("words"), lambda t: F.struct(t.alias("t"), F.size(F.filter("words", lambda x: x == t)).cast("double").alias("n"))).alias("bag"))
    idf = _weights(model.idf)
    cut = cut.select(*key, F.transform("bag", lambda x: F.struct(x.t.alias("t"), (x.n * F.coalesce(F.try_element_at(idf, x.t), F.lit(model.unseen))).alias("w"))).alias("bag"))
    zero = F.lit(0.0)
    cut = cut.withColumn("norm", F.sqrt(F.aggregate("bag", zero, lambda a, x: a + x.w * x.w)))

    def cosine(vector: dict[str, float]) -> Column:
        weights = _weights(vector)
        return F.round(F.aggregate("bag", zero, lambda a, x: a + x.w * F.coalesce(F.try_element_at(weights, x.t), zero)) / F.col("norm"), DIGITS)

    each = [F.struct(F.lit(name).alias("license"), cosine(vector).alias("score")) for name, vector in model.vectors.items()]
    hit = cut.select(*key, F.explode(F.filter(F.array(*each), lambda x: x.score >= least)).alias("m")).select(*key, "m.license", "m.score")
    if long:
        hit = hit.unionByName(passages(some.where(F.col(text).rlike(signal)), long, key, text, least))
    best = hit.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("m"))
    return best.select(*key, F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))


def _parent(path: Column) -> Column:
    """The directory of a path; of a path without one, the root ``''``."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/+$", "")


def scan(files: DataFrame, key: str = "file_id", path: str = "path", text: str = "text", templates=TEMPLATES, least: float = LEAST, long=PASSAGES) -> DataFrame:
    """``key, path, license, score, how, origin``: ``how`` is ``own``, ``inherited`` or null;
    ``origin`` the path of the file that states the licence."""
    files = files.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_key"), F.col(path).alias("path"), F.col(text).alias("text"))
    found = own(files, Model(templates, least), ["key", "text_key"], "text", least, Model(long, least))
    # rows that repeat a key are told apart by their texts
    named = files.drop("text").alias("a").join(found.alias("f"), F.col("a.key").eqNullSafe(F.col("f.key")) & (F.col("a.text_key") == F.col("f.text_key")), "left").select("a.key", "a.path", "f.license", "f.score")
    notices = named.where(F.col("license").isNotNull() & F.col("path").rlike(LICENCE_FILE))
    stated = notices.groupBy(_parent(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("path"), F.col("license"))).alias("m"))
    dirs = named.where("license IS NULL AND path IS NOT NULL").select(_parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(parts))), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))).alias("above")).distinct()
    nearest = up.join(stated.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), F.col("m"))).alias("n"))
    nearest = nearest.select("dir", F.col("n.m.license").alias("near_license"), F.col("n.m.path").alias("near_path"), (-F.col("n.m.s")).alias("near_score"))
    # files with a licence of their own need no directory
    want = named.withColumn("dir", F.when(F.col("license").isNull(), _parent(F.col("path"))))
    out = want.join(nearest, "dir", "left")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("near_license").isNotNull(), "inherited")
    return out.select(F.col("key").alias(key), F.col("path").alias(path), F.coalesce("license", "near_license").alias("license"), F.coalesce("score", "near_score").alias("score"), how.alias("how"), F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("near_path")).alias("origin"))


def oracle(files: str, templates=TEMPLATES, least: float = LEAST, long=PASSAGES) -> str:
    """DuckDB SQL for ``scan`` of the query ``files(file_id, path, text)``, whose ids differ; it
    looks at every line, without the anchors."""
    model = Model(templates, least)
    passage = Model(long, least)
    held = ", ".join(f"('{name}', '{t}', {w!r}::DOUBLE)" for name, v in passage.vectors.items() for t, w in sorted(v.items()))
    kinds = ", ".join(f"('{name}', {size}, '{passage.first[name][0]}', '{passage.first[name][1]}')" for name, size in passage.sizes.items())
    weights = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in passage.idf.items())
    n = model.window
    vectors = ", ".join(f"('{name}', '{t}', {w!r}::DOUBLE)" for name, v in model.vectors.items() for t, w in sorted(v.items()))
    idf = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in model.idf.items())
    return f"""
WITH files AS ({files}),
vectors(license, t, w) AS (VALUES {vectors}),
idf(t, w) AS (VALUES {idf}),
lines AS (SELECT file_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM files),
split AS (SELECT row_number() OVER () AS line_id, file_id, regexp_extract_all(lower(line), '{WORD}') AS words FROM lines),
cut AS (SELECT line_id, file_id, i, list_slice(words, i + 1, i + {2 * n}) AS words
        FROM (SELECT *, unnest(range(0, greatest(0, len(words) - {n} - 1) + 1, {n})) AS i FROM split WHERE len(words) > 0)),
bags AS (SELECT line_id, file_id, i, t, count(*)::DOUBLE AS n FROM (SELECT line_id, file_id, i, unnest(words) AS t FROM cut) GROUP BY ALL),
weighed AS (SELECT b.*, n * coalesce(idf.w, {model.unseen!r}::DOUBLE) AS w FROM bags b LEFT JOIN idf USING (t)),
norms AS (SELECT line_id, file_id, i, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT line_id, file_id, i, license, sum(b.w * v.w) AS dot FROM weighed b JOIN vectors v USING (t) GROUP BY ALL),
passage(name, t, v) AS (VALUES {held}),
kinds(name, size, one, two) AS (VALUES {kinds}),
passage_idf(t, w) AS (VALUES {weights}),
whole AS (SELECT file_id, regexp_extract_all(lower(text), '{WORD}') AS ws FROM files WHERE regexp_matches(text, '(?i){"|".join(SIGNALS)}')),
word AS (SELECT file_id, unnest(ws) AS t, unnest(range(len(ws))) AS pos FROM whole),
begins AS (SELECT file_id, name, size, unnest(range(0, len(ws), (size + 3) // 4)) AS start FROM whole, kinds
           UNION SELECT a.file_id, name, size, a.pos FROM word a JOIN word b ON a.file_id = b.file_id AND b.pos = a.pos + 1 JOIN kinds ON a.t = one AND b.t = two),
bag AS (SELECT l.file_id, name, start, t, count(*) * coalesce(any_value(w), {passage.unseen!r}::DOUBLE) AS w
        FROM begins l JOIN word ON word.file_id = l.file_id AND pos >= start AND pos < start + size LEFT JOIN passage_idf USING (t) GROUP BY ALL),
passages AS (SELECT file_id, split_part(name, ' ', 1) AS license, round(sum(w * coalesce(v, 0)) / sqrt(sum(w * w)), {DIGITS}) AS score
             FROM bag LEFT JOIN passage USING (name, t) GROUP BY file_id, name, start),
hits AS (SELECT file_id, license, round(dot / norm, {DIGITS}) AS score FROM dots JOIN norms USING (line_id, file_id, i) UNION ALL FROM passages),
best AS (SELECT file_id, license, score FROM hits WHERE score >= {least!r}
         QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, license) = 1),
named AS (SELECT f.file_id, f.path, b.license, b.score, regexp_replace(regexp_extract(f.path, '^(.*)/[^/]*$', 1), '/+$', '') AS dir
          FROM files f LEFT JOIN best b USING (file_id)),
stated AS (SELECT dir AS above, license, score, path FROM named WHERE license IS NOT NULL AND regexp_matches(path, '{LICENCE_FILE}')
           QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
near AS (SELECT n.file_id, s.license, s.score, s.path FROM named n JOIN stated s
         ON s.above = '' OR n.dir = s.above OR starts_with(n.dir, s.above || '/')
         WHERE n.license IS NULL AND n.path IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY n.file_id ORDER BY length(s.above) DESC) = 1)
SELECT n.file_id, n.path, coalesce(n.license, r.license) AS license, coalesce(n.score, r.score) AS score,
       CASE WHEN n.license IS NOT NULL THEN 'own' WHEN r.license IS NOT NULL THEN 'inherited' END AS how,
       CASE WHEN n.license IS NOT NULL THEN n.path ELSE r.path END AS origin
FROM named n LEFT JOIN near r USING (file_id)"""
