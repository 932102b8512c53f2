"""Line dedup by a deletion-neighbourhood join.

A line is a run of text between line feeds; its words are what white space (blank, tab, vertical
tab, form feed, carriage return) separates.  Two lines are the same when their words are; they are
near when one word inserted, deleted or changed turns one into the other (lines of ``min_words`` or
more; any value from 1 on is exact).  A line goes when an equal or near line stands earlier, by
(document id, line number); so the earliest stays.  Blank lines always stay.

The neighbourhood: deleting word ``i`` of an ``n``-word line gives the variant key
``(n - 1, i, words before i, words after i)``; the undeleted line emits the same key for each of
its ``n + 1`` gaps.  Lines are within one edit exactly when they share a key, and all lines that
share one are near each other, so every line is compared with the earliest of its keys and no
pairs within a key are made.  Keys are hashes: a running XOR of word hashes salted with the
position from the start (before ``i``) and from the end (after ``i``).  Equal keys are verified by
comparing the words.

Before variants are emitted, an exact filter: one edit leaves the first or the last quarter (at
least) of a line as it is.  A line of ``n`` words has ends of ``p`` words, half the largest power
of two up to ``n``; a line whose ``n`` is itself a power of two also has the ends of ``n - 1``
words, so that both lines of a pair have ends of one size.  Lines whose ends nobody shares emit
nothing.

Exact copies are folded by a 128-bit hash with a map-side combined minimum.  Line text is only
moved for lines that pass the filter: their hashes modulo ``SIEVE`` are broadcast, which bounds
that table, and lines that slip through cost time, not correctness (with many more candidates than
``SIEVE``, all distinct lines are moved, once).  All of it is DataFrame expressions.

Hot keys: occurrences are folded into distinct lines before any join; joins on ends and variants
are salted by the line; lines that make up more than one in ``HOT`` of all occurrences, fewer than
``HOT`` in number, meet their occurrences by a broadcast join.

Defined cases: null text has no lines and stays null; repeated rows (equal id and text) count as
one occurrence and fare alike; of equal lines at one place (a tie) all stay; a null id sorts first;
extra columns are carried along by ``dedup_lines``; a line of any length is one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, read

MIN_WORDS = 8
SIEVE = 1 << 21
HOT = 10_000
SALTS = 8


def _tidy(line: Column) -> Column:
    odd = line.contains("  ")
    for blank in "\t\r\f\x0b":
        odd = odd | line.contains(blank)
    return F.when(odd, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(F.trim(line))


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, th, pos, line)`` of every line that isn't blank; th is the text's hash."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    return rows.select("id", "th", "pos", _tidy(F.col("raw")).alias("line")).filter("line <> ''")


def _hashes(lines: DataFrame) -> DataFrame:
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line"))


def _with_ends(lines: DataFrame, min_words: int) -> DataFrame:
    """Adds ``ends``: keys of a line's first and last words, in one or two sizes; none for a short
    line.  The number of words is a column of its own, so that it is counted once."""
    lines = lines.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1)
    half = F.when(F.col("n") == 1, 0).otherwise(F.call_function("shiftleft", F.lit(1), F.length(F.bin("n")) - 2))
    lines = lines.withColumn("p", F.when(F.col("n") >= min_words, half))

    def ends(p: Column) -> list[Column]:
        cut = lambda k: F.call_function("substring_index", F.col("line"), F.lit(" "), k)
        return [F.xxhash64(F.lit("first"), p, cut(p)), F.xxhash64(F.lit("last"), p, cut(-p))]

    n, p = F.col("n"), F.col("p")
    # the largest power of two up to n - 1 is half of n where n is a power of two
    both = F.when((n > min_words) & (n.bitwiseAND(n - 1) == 0), F.array(*ends(p), *ends(F.shiftright(p, 1)))).otherwise(F.array(*ends(p)))
    return lines.withColumn("ends", F.when(n >= min_words, both).otherwise(F.expr("cast(array() as array<bigint>)"))).drop("n", "p")


def _meet(lines: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """Join on a key that many lines may share: lines are salted, ``keys`` (a row a key) repeated."""
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod("h1", F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), [key, "salt"], how).drop("salt")


def _near(docs: DataFrame, lines: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """``(h1, h2, near_first)``: for a distinct line, the earliest near line that is earlier."""
    keyed = lines.select("h1", "h2", F.explode("ends").alias("k"))
    shared = keyed.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("k")
    some = scratch.table(_meet(keyed, shared, "k", "left_semi").select("h1", "h2").distinct(), "some")

    sieve = some.select(F.pmod("h1", F.lit(SIEVE)).alias("r")).distinct()
    source = _hashes(_occurrences(docs, id_col, text_col).select("line"))
    text = source.join(F.broadcast(sieve), F.pmod("h1", F.lit(SIEVE)) == F.col("r"), "left_semi")
    text = text.groupBy("h1", "h2").agg(F.any_value("line").alias("line")).join(some, ["h1", "h2"], "left_semi")
    text = text.join(lines.select("h1", "h2", "first"), ["h1", "h2"])
    text = scratch.table(text.select("h1", "h2", "first", F.split("line", " ").alias("words")), "near_lines")
    scratch.drop("some")

    words = text.select("h1", "h2", F.size("words").alias("n"), F.posexplode("words").alias("i", "w"))
    words = words.select("h1", "h2", "n", "i", F.xxhash64("i", "w").alias("from_start"), F.xxhash64(F.col("n") - F.col("i"), "w").alias("from_end"))
    line = Window.partitionBy("h1", "h2").orderBy("i")
    before = F.coalesce(F.bit_xor("from_start").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    # the XOR from i to the end is the whole line's XOR less that of the words before i
    ahead = F.coalesce(F.bit_xor("from_end").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    whole = F.bit_xor("from_end").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    words = words.select("h1", "h2", "n", "i", before.alias("before"), whole.bitwiseXOR(ahead).alias("onward"), "from_start", "from_end")
    zero = F.lit(0).cast("long")
    deleted = F.struct((F.col("n") - 1).alias("m"), F.col("i").alias("at"), F.col("before").alias("a"), F.col("onward").bitwiseXOR(F.col("from_end")).alias("b"))
    gap = F.struct(F.col("n").alias("m"), F.col("i").alias("at"), F.col("before").alias("a"), F.col("onward").alias("b"))
    last = F.struct(F.col("n").alias("m"), F.col("n").alias("at"), F.col("before").bitwiseXOR(F.col("from_start")).alias("a"), zero.alias("b"))
    variants = words.select("h1", "h2", F.explode(F.when(F.col("i") == F.col("n") - 1, F.array(deleted, gap, last)).otherwise(F.array(deleted, gap))).alias("v"))
    variants = variants.select("h1", "h2", F.xxhash64("v.m", "v.at", "v.a", "v.b").alias("key"), F.col("v.at").alias("at"), F.col("v.m").alias("m"))

    variants = scratch.table(variants, "variants")
    met = variants.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("key")
    few = _meet(variants, met, "key", "left_semi").join(text.select("h1", "h2", "first"), ["h1", "h2"])
    few = scratch.table(few, "met")
    scratch.drop("variants")
    low = few.groupBy("key").agg(F.min(F.struct("first", "h1", "h2")).alias("low"))
    pairs = _meet(few, low, "key", "inner").filter(F.col("low.first") < F.col("first"))
    pairs = pairs.select("h1", "h2", "m", "at", F.col("low.h1").alias("g1"), F.col("low.h2").alias("g2")).distinct()

    mine = text.select("h1", "h2", F.col("words").alias("x"))
    theirs = text.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("words").alias("y"), F.col("first").alias("near_first"))
    checked = pairs.join(mine, ["h1", "h2"]).join(theirs, ["g1", "g2"])

    def without(a: str) -> Column:
        cut = F.concat(F.slice(a, F.lit(1), F.col("at")), F.slice(a, F.col("at") + 2, F.greatest(F.size(a) - F.col("at") - 1, F.lit(0))))
        return F.when(F.size(a) == F.col("m"), F.col(a)).otherwise(cut)

    return checked.filter(without("x") == without("y")).groupBy("h1", "h2").agg(F.min("near_first").alias("near_first"))


def line_fates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, th, removed, near)`` per document row with lines to drop: line numbers, sorted."""
    scratch = Scratch(docs.sparkSession, "lines")
    every = _with_ends(_hashes(_occurrences(docs, id_col, text_col)), min_words).select("id", "th", "pos", "h1", "h2", "ends")
    every = scratch.table(every, "occurrences")
    lines = scratch.table(every.groupBy("h1", "h2").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n"), F.any_value("ends").alias("ends")), "distinct")
    near = _near(docs, lines, scratch, id_col, text_col)
    fate = lines.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").filter("n > 1 or near_first is not null")
    fate = scratch.table(fate, "fates")
    total = lines.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    what = every.select("id", "th", "pos", "h1", "h2")
    often = F.broadcast(fate.filter(hot))  # fewer than HOT rows
    out = what.join(often, ["h1", "h2"]).unionByName(what.join(often.select("h1", "h2"), ["h1", "h2"], "left_anti").join(fate.filter(~hot), ["h1", "h2"]))
    same_place = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.pos") == F.col("pos"))
    is_near = F.col("near_first").isNotNull()
    out = out.filter(is_near | ~same_place).select("id", "th", "pos", (is_near & same_place).alias("near"))
    out = out.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("removed"), F.collect_set(F.when(F.col("near"), F.col("pos"))).alias("near"))
    return scratch.close(out)


def _with_fates(docs: DataFrame, fates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, text, removed, near)``: whole rows as a struct, so no column name can clash."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("th"))
    return rows.join(fates, same, "left").select("row", "text", "removed", "near")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies and near copies of lines taken out of the text column."""
    fates = line_fates(docs, id_col, text_col, min_words)
    lines = F.split(F.col("text"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    # the lines are bound once, as a lambda's variable
    kept = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n"))[0]
    clean = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)
    out = _with_fates(docs, fates, id_col, text_col)
    return out.select(*((clean if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fates = line_fates(docs)
    slim = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    f = fates.select(F.col("id").alias("_fid"), F.col("th").alias("_fth"), "removed", F.size("near").alias("near"))
    out = slim.join(f, F.col("doc_id").eqNullSafe(F.col("_fid")) & (F.col("_th") == F.col("_fth")), "left")
    gone = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    out = out.select("doc_id", "n_lines", gone.alias("n_removed"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))
    return out


SQL = f"""
WITH o AS (
  SELECT doc_id, k - 1 AS pos, trim(regexp_replace(string_split(text, chr(10))[k], '[ \\t\\r\\f\\v]+', ' ', 'g')) AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(k)
), l AS (
  SELECT line, min((doc_id, pos)) AS first, string_split(line, ' ') AS ws FROM o WHERE line <> '' GROUP BY line
), e AS (
  SELECT line, first, ws, len(ws) AS n FROM l WHERE len(ws) >= {MIN_WORDS}
), v AS (
  SELECT line, first, n, n - 1 AS m, i, md5(array_to_string(ws[1:i], ' ') || '|' || array_to_string(ws[i + 2:], ' ')) AS key
  FROM e, unnest(range(0, n)) u(i)
  UNION ALL
  SELECT line, first, n, n AS m, i, md5(array_to_string(ws[1:i], ' ') || '|' || array_to_string(ws[i + 1:], ' ')) AS key
  FROM e, unnest(range(0, n + 1)) u(i)
), s AS (
  SELECT m, i, key, min(first) AS low FROM v GROUP BY ALL HAVING count(*) > 1
), near AS (
  SELECT line, min(low) AS low FROM v JOIN s USING (m, i, key) WHERE low < first GROUP BY line
), f AS (
  SELECT doc_id, pos, (doc_id, pos) <> first AS copy, near.low IS NOT NULL AS is_near
  FROM o JOIN l USING (line) LEFT JOIN near USING (line)
), g AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (is_near AND NOT copy) AS nn, string_agg(pos, ',' ORDER BY pos) AS removed
  FROM f WHERE copy OR is_near GROUP BY doc_id
)
SELECT doc_id, cast(len(string_split(text, chr(10))) AS bigint) AS n_lines, cast(coalesce(n, 0) AS bigint) AS n_removed,
       cast(coalesce(nn, 0) AS bigint) AS n_near, coalesce(removed, '') AS removed_lines
FROM documents LEFT JOIN g USING (doc_id)
"""
