"""License scan: an exact set-similarity join of text blocks with license templates.

Everything runs as DataFrame expressions.  A template is the set of its pairs of neighbouring words,
so word order counts; a block is a run of ``2 * STRIDE`` words of the text, whatever its line breaks,
and blocks start every ``STRIDE`` words (or as many as the longest template has), so every notice lies
whole in one.  A block meets a template when it holds at least ``threshold`` of the template's pairs.  Pairs are
ordered by their frequency over the whole corpus, rarest first.  With ``a = ceil(threshold * |T|)``
pairs needed:

* length filter: a block must have ``a`` pairs of the template vocabulary;
* prefix filter: it must share a pair among the first ``|T| - a + 1`` of the template's pairs
  with the first ``|B| - a + 1`` of its own;
* positional filter: from where the shared pairs stand, ``a`` pairs must still be reachable.

Surviving pairs are verified by an exact intersection.  ``template_join`` returns all that meet the
threshold.  ``scan`` gives labels, of templates all whose deciding pairs are met (a word and the number
behind it, and what tells a template from one of another label that is nearly the same): in a block, a template gives way to another whose matched pairs
hold all of its own and more (or the same at a higher containment), so a notice of a longer name does
not count as one of a shorter.

One pass over the texts finds the vocabulary's pairs; from then on only those are moved.  Templates
are a fixed parameter, so what is broadcast and what the frequency table brings back is bounded by
their vocabulary.  A block reaches its templates by a broadcast equi-join on pair rank, so a notice
that stands in a third of all documents is no hot key.

Defined cases: null text is empty and has no words, places or labels; repeated rows get equal
values; a null id is kept; templates that tie in a block both stay; a text of any length is read
whole; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

# Phrases and labels of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License notices by label, as words.
TEMPLATES = {
    "agpl-3.0": ["licensed under the gnu affero general public license version 3"],
    "all-rights-reserved": ["all rights reserved"],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd-3-clause": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-4.0": ["licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0-1.0": ["dedicated to the public domain under cc0 1 0 universal"],
    "gpl-2.0": ["licensed under the gnu general public license version 2"],
    "gpl-3.0": [
        "licensed under the gnu general public license version 3",
        "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "isc": [
        "released under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "lgpl-3.0": ["licensed under the gnu lesser general public license version 3"],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.7
STRIDE = 64


def _word_string(text: Column) -> Column:
    """Words joined by blanks.  Only A-Z change case: the one other character that lower() turns
    into an ASCII letter on its own, the Kelvin sign, is replaced by a letter that stays."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.trim(F.regexp_replace(plain, NOT_WORD, " "))


def _places(words: Column, phrase: str) -> Column:
    """Word positions at which a phrase stands.  The words are bound once, as a lambda's variable."""
    want = phrase.split()
    found = F.transform(
        F.array(words),
        lambda ws: F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(ws) - len(want), F.lit(0))),
            lambda i: _all(F.get(ws, i + k).eqNullSafe(F.lit(w)) for k, w in enumerate(want)),
        ),
    )
    return found[0]


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def base_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None) -> DataFrame:
    """``(id, row_hash, n_words, n_base, first_word, last_word, base_label_set)`` per row."""
    phrases = BASE if phrases is None else phrases
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("row_hash"), _word_string(F.col(text_col)).alias("s"))
    rows = rows.withColumn("padded", F.concat(F.lit(" "), F.col("s"), F.lit(" ")))
    none = F.expr("cast(array() as array<int>)")
    found = {label: F.when(F.col("padded").contains(f" {p} "), _places(F.split("s", " "), p)).otherwise(none) for p, label in phrases.items()}
    rows = rows.select(id_col, "row_hash", F.when(F.col("s") == "", 0).otherwise(F.octet_length("s") - F.octet_length(F.replace("s", F.lit(" "))) + 1).cast("long").alias("n_words"), *(c.alias(f"_{k}") for k, c in enumerate(found.values())))
    every = F.flatten(F.array(*(F.col(f"_{k}") for k in range(len(found)))))
    labels = F.filter(F.array(*(F.when(F.size(f"_{k}") > 0, F.lit(label)) for k, label in enumerate(found))), lambda x: x.isNotNull())
    return rows.select(
        id_col, "row_hash", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_label_set"),
    )


def _pairs(text: str) -> list[str]:
    """A template's distinct pairs of neighbouring words."""
    words = text.lower().split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _notices(templates: dict[str, list[str]]) -> list[tuple[int, str, list[str], list[str]]]:
    """``(number, label, pairs, deciding pairs)`` of every notice.

    A label needs its deciding pairs whatever the containment is: a word and the number behind it, so that
    no version is claimed that a text does not name, and those that a notice of another label, which holds
    enough of this one to be taken for it, has not.
    """
    flat = [(label, t) for label, ts in sorted(templates.items()) for t in ts]
    pairs = [_pairs(t) for _, t in flat]
    out = []
    for k, (label, _) in enumerate(flat):
        own = set(pairs[k])
        must = {p for p in own if p.split()[1].isdigit() and not p.split()[0].isdigit()}
        for j, (other, _) in enumerate(flat):
            if other != label and len(own & set(pairs[j])) >= THRESHOLD * len(own):
                must |= own - set(pairs[j])
        out.append((k, label, pairs[k], sorted(must)))
    return out


def _stride(templates: dict[str, list[str]]) -> int:
    """Words from one block to the next: no fewer than the longest notice has."""
    return max(STRIDE, *(len(t.split()) for ts in templates.values() for t in ts))


def vocabulary_hits(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row_hash, pos, pair)``: where the vocabulary's pairs of words stand."""
    firsts, seconds = (sorted({p.split()[k] for p in vocabulary}) for k in (0, 1))
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("row_hash"), F.split(_word_string(F.col(text_col)), " ").alias("words"))
    rows = rows.select(id_col, "row_hash", "words", F.posexplode("words").alias("pos", "w")).filter(F.col("w").isin(firsts))
    rows = rows.withColumn("next", F.get("words", F.col("pos") + 1)).filter(F.col("next").isin(seconds))
    return rows.select(id_col, "row_hash", "pos", F.concat_ws(" ", "w", "next").alias("pair")).filter(F.col("pair").isin(vocabulary))


def template_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(id, row_hash, block, notice, label, containment, matched, lacking)`` for every block that meets a
    notice; ``matched`` are the ranks of the shared pairs, ``lacking`` is how many deciding pairs are not among them."""
    templates = TEMPLATES if templates is None else templates
    notices, stride = _notices(templates), _stride(templates)
    vocabulary = sorted({p for _, _, ps, _ in notices for p in ps})
    scratch = Scratch(docs.sparkSession, "licenses")
    hits = scratch.table(vocabulary_hits(docs, vocabulary, id_col, text_col), "hits")
    counts = {r["pair"]: r["n"] for r in hits.groupBy("pair").agg(F.count("*").alias("n")).collect()}
    rank = {p: k for k, p in enumerate(sorted(vocabulary, key=lambda p: (counts.get(p, 0), p)))}
    need = {k: max(1, math.ceil(threshold * len(ps) - 1e-9)) for k, _, ps, _ in notices}
    ordered = {k: sorted(rank[p] for p in ps) for k, _, ps, _ in notices}
    must = {k: sorted(rank[p] for p in ps) for k, _, _, ps in notices}
    prefix = [(r, k, label, j, len(ordered[k]), need[k], ordered[k], must[k]) for k, label, _, _ in notices for j, r in enumerate(ordered[k][: len(ordered[k]) - need[k] + 1])]
    spark = docs.sparkSession
    index = F.broadcast(spark.createDataFrame(prefix, "rank int, notice int, label string, j int, t_size int, need int, t_ranks array<int>, must array<int>"))
    ranks = F.broadcast(spark.createDataFrame(sorted(rank.items()), "pair string, r int"))

    own = F.floor(F.col("pos") / stride).cast("int")
    # a block holds 2 * stride words, so the pair over its end belongs to the next one only
    both = F.when((own > 0) & (F.col("pos") % stride < stride - 1), F.array(own - 1, own)).otherwise(F.array(own))
    blocks = hits.join(ranks, "pair").select(id_col, "row_hash", F.explode(both).alias("block"), "r")
    blocks = blocks.groupBy(id_col, "row_hash", "block").agg(F.array_sort(F.collect_set("r")).alias("b")).filter(F.size("b") >= min(need.values()))
    met = blocks.select(id_col, "row_hash", "block", "b", F.posexplode("b").alias("i", "rank")).join(index, "rank")
    met = met.filter("size(b) >= need and i <= size(b) - need and 1 + least(size(b) - i - 1, t_size - j - 1) >= need")
    met = met.withColumn("matched", F.array_intersect("b", "t_ranks")).filter("size(matched) >= need")
    met = met.select(id_col, "row_hash", "block", "notice", "label", (F.size("matched") / F.col("t_size")).alias("containment"), "matched", F.size(F.array_except("must", "matched")).alias("lacking")).distinct()
    return scratch.close(met)


def _labels(met: DataFrame, id_col: str) -> DataFrame:
    """``(id, row_hash, block, label, containment)`` without those that lack what decides or give way."""
    block = met.filter("lacking = 0").groupBy(id_col, "row_hash", "block").agg(F.collect_list(F.struct("notice", "label", "containment", "matched")).alias("l"))

    def gives_way(x: Column, y: Column) -> Column:
        inside = F.size(F.array_except(x["matched"], y["matched"])) == 0
        more = (F.size(y["matched"]) > F.size(x["matched"])) | (y["containment"] > x["containment"])
        return (x["notice"] != y["notice"]) & inside & more

    kept = F.filter("l", lambda x: ~F.exists(F.col("l"), lambda y: gives_way(x, y)))
    out = block.select(id_col, "row_hash", "block", F.explode(kept).alias("x"))
    return out.select(id_col, "row_hash", "block", "x.label", "x.containment")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base scan's figures, all labels, and the best containment."""
    base = base_scan(docs, id_col, text_col)
    met = _labels(template_join(docs, id_col, text_col, templates, threshold), id_col)
    met = met.groupBy(id_col, "row_hash").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.countDistinct("block").alias("n_blocks"))
    met = met.withColumnRenamed(id_col, "_id").withColumnRenamed("row_hash", "_hash")
    out = base.join(met, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base_label_set", F.coalesce("found", F.expr("cast(array() as array<string>)")))))
    return out.select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_label_set", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.coalesce("best", F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[0-9a-z\x{80}-\x{10FFFF}]+"
    place = " UNION ALL ".join(
        f"SELECT r, i - 1 AS p, '{label}' AS label FROM w, unnest(range(1, len(words) + 1)) u(i) WHERE " + " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in BASE.items()
    )
    rows = ", ".join(f"({k}, '{label}', {ps}, {must or '[]::VARCHAR[]'})" for k, label, ps, must in _notices(TEMPLATES))
    stride = _stride(TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '{word}') AS words FROM d),
p AS ({place}),
b AS (SELECT r, count(*) AS n, min(p) AS lo, max(p) AS hi, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, list(DISTINCT label) AS ls FROM p GROUP BY r),
t(notice, label, ps, must) AS (VALUES {rows}),
tp AS (SELECT notice, label, must, len(ps) AS size, unnest(ps) AS pair FROM t),
h AS (SELECT r, i - 1 AS pos, words[i] || ' ' || words[i + 1] AS pair FROM w, unnest(range(1, len(words))) u(i)),
k AS (SELECT r, pair, k FROM h, unnest([pos // {stride}, pos // {stride} - 1]) u(k)
      WHERE pair IN (SELECT pair FROM tp) AND k >= 0 AND pos + 1 < (k + 2) * {stride}),
m AS (SELECT r, k, notice, label, count(DISTINCT pair) / cast(size AS double) AS c, list(DISTINCT pair) AS matched
      FROM k JOIN tp USING (pair) GROUP BY r, k, notice, label, size, must HAVING count(DISTINCT pair) >= ceil({THRESHOLD} * size - 1e-9) AND list_has_all(list(DISTINCT pair), must)),
s AS (SELECT * FROM m x WHERE NOT EXISTS (SELECT 1 FROM m y WHERE x.r = y.r AND x.k = y.k AND x.notice <> y.notice
      AND list_has_all(y.matched, x.matched) AND (len(y.matched) > len(x.matched) OR y.c > x.c))),
g AS (SELECT r, list(DISTINCT label) AS ls, max(c) AS best, count(DISTINCT k) AS n FROM s GROUP BY r)
SELECT w.doc_id, cast(len(words) AS bigint) AS n_words, cast(coalesce(b.n, 0) AS bigint) AS n_base,
       cast(b.lo AS bigint) AS first_word, cast(b.hi AS bigint) AS last_word, coalesce(b.labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(g.ls, [])))), ',') AS labels,
       coalesce(g.best, CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END) AS score, cast(coalesce(g.n, 0) AS bigint) AS n_blocks
FROM w LEFT JOIN b USING (r) LEFT JOIN g USING (r)
"""


SQL = _sql()
