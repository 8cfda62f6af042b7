"""Spelling variants by asymmetric q-chunks: words within one edit, and the form each one is a variant of.

Of two words the one that is not longer, of length L, gives two disjoint chunks of q = L // 2 code points, at
positions 0 and q; the other gives its positional grams of that length. One inserted, deleted or replaced code
point touches at most one chunk, and moves the other by at most one place, so near words have a chunk and a gram in
common whose positions differ by one at most (grams further away can join nothing and are not made). Pairs that
meet are verified by their edit distance.

A chunk of more than ``CROWD`` words would pair too many, so its words meet in smaller groups: the chunk is cut out,
and what is left must differ by one edit as well. Words of one length that differ in a place are equal without it;
of unequal lengths, the longer one is equal to the other without one of its code points. Both are joined by
equality, and a group holds no more words than one code point has values. No pair is lost either way.

Defined results: null and empty texts have no words; a null id is written as an empty text before the colon; rows
that repeat count as often as they occur; other columns are not read; a table without words gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm.common import Scratch, table, within
from cohortlift.operators.joins import hot_key_join

#: Words have so many code points and occurrences at least; a form occurs so many times as often as its variant.
SHORTEST, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many occurrences loses a code point.
ONE_IN = 31
#: Words of a chunk that are paired directly.
CROWD = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = " "  # in no word


def words(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of all texts, some occurrences without one code point, and how often they occur."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]{%d,}" % SHORTEST), F.lit(0))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    h = F.crc32(named.cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))
    return (
        docs.select("doc_id", F.explode(runs).alias("run"))
        .select(F.when(h % ONE_IN == 0, without).otherwise(F.col("run")).alias("word"))
        .where(F.char_length("word") >= SHORTEST)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def _piece(length: Column | int, second: int, start: Column, q: Column) -> Column:
    """Key of a chunk or gram (for words of ``length``, the second chunk or not), where it starts, its length."""
    text = F.substring("word", start + 1, q)
    key = F.xxhash64(length, F.lit(second), text)
    return F.struct(key.alias("key"), start.alias("start"), q.alias("q"), length.alias("of"))


def chunks(vocabulary: DataFrame) -> DataFrame:
    length = F.char_length("word")
    q = (length / 2).cast("int")
    pieces = F.array(_piece(length, 0, F.lit(0), q), _piece(length, 1, q, q))
    return vocabulary.select("word", "n", F.inline(pieces))


def grams(vocabulary: DataFrame) -> DataFrame:
    """Positional grams that can meet a chunk of a word as long, or shorter by one."""
    length = F.char_length("word")
    shorter = length - 1
    q, q1 = (length / 2).cast("int"), (shorter / 2).cast("int")
    same = F.array(_piece(length, 0, F.lit(0), q), _piece(length, 1, q, q))
    moved = F.array(*[_piece(shorter, second, q1 * second + shift, q1) for second in (0, 1) for shift in (0, 1)])
    pieces = F.when(shorter >= SHORTEST, F.concat(same, moved)).otherwise(same)
    return vocabulary.select("word", "n", F.inline(pieces))


def _refined(pieces: DataFrame, chunk: bool) -> DataFrame:
    """Pieces of crowded chunks, under keys made of the rest of the word."""
    length = F.char_length("word")
    head = F.substring("word", F.lit(1), F.col("start"))
    rest = F.concat(head, F.lit(_GAP), F.substr("word", F.col("start") + F.col("q") + 1))
    places = F.filter(F.sequence(F.lit(0), F.char_length("rest") - 1), lambda i: i != F.col("start"))

    def one_less(place: Column, i: Column) -> Column:
        return F.xxhash64("key", place, F.substring("rest", F.lit(1), i), F.substr("rest", i + 2))

    in_place = F.transform(places, lambda i: one_less(i, i))
    if chunk:
        keys = F.concat(in_place, F.array(F.xxhash64("key", F.lit(-1), "rest", F.lit(""))))
    else:
        anywhere = F.transform(places, lambda i: F.xxhash64("key", F.lit(-1), _less("rest", i), F.lit("")))
        keys = F.when(F.col("of") == length, in_place).otherwise(F.array_distinct(anywhere))
    return pieces.withColumn("rest", rest).select("word", "n", "of", F.explode(keys).alias("key"))


def _less(text: str, i: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), i), F.substr(text, i + 2))


def _met(chunked: DataFrame, grammed: DataFrame) -> DataFrame:
    """Verified pairs (a, a_n, b, b_n) of words whose pieces have a key in common, repeats included."""
    left = chunked.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = grammed.select("key", "of", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # Of two words of one length each is a chunk word and a gram word: one of the two meetings is enough.
    once = (F.col("of") < F.char_length("b")) | (F.col("a") < F.col("b"))
    return left.join(right, "key").where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_pairs(vocabulary: DataFrame, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """(a, a_n, b, b_n): every pair of distinct words that differ by one edit, once. ``vocabulary`` is a table."""
    chunked, grammed = chunks(vocabulary), grams(vocabulary)
    sizes = chunked.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    crowded = within(scratch.write(sizes.where(F.col("size") > crowd).select("key"), "crowded"))
    plain = _met(chunked.join(crowded, "key", "left_anti"), grammed)
    dense = _met(
        _refined(chunked.join(crowded, "key", "left_semi"), chunk=True),
        _refined(grammed.join(crowded, "key", "left_semi"), chunk=False),
    )
    return plain.union(dense).distinct()


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root``: where the links (word, form) of each linked word end, followed twice as far each round.

    A form occurs ten times as often, so no path has more than 18 links.
    """
    now = scratch.write(links.select("word", F.col("form").alias("root")), "roots_0")
    step = 0
    while True:
        hops = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        hops = hops.join(now.select(F.col("root").alias("at")).distinct(), "at", "left_semi")
        hops = scratch.write(hops, f"hops_{step}")
        if hops.isEmpty():
            return now
        step += 1
        further = hot_key_join(now, hops, [("root", "at")], "left", ["word"])
        now = scratch.write(further.select("word", F.coalesce("next", "root").alias("root")), f"roots_{step}")


def variants(docs: DataFrame, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    vocabulary = scratch.write(words(docs), "vocabulary")
    pairs = scratch.write(near_pairs(vocabulary, scratch, crowd), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "a", "a_n")
    )
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    of_word = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.n") >= RATIO * F.col("n")
    found = vocabulary.join(of_word, "word", "left").select(
        "word",
        F.when(is_form, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(is_form, -F.col("best.n")).alias("form_n"),
    )
    found = scratch.write(found, "forms")
    ends = roots(found.where("form is not null"), scratch)
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, their near words and forms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(docs, Scratch(spark, "op12"))


OP12_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run
    FROM documents) GROUP BY doc_id, run
),
octets AS (
  SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS o
  FROM runs
),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), o),
           lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS BIGINT)]))) AS h
  FROM octets CROSS JOIN crc
),
kept AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
shorter AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n
  FROM near GROUP BY word
),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
         CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
paths AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT paths.word, forms.form FROM paths JOIN forms ON forms.word = paths.at WHERE forms.form IS NOT NULL
)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN paths p ON p.word = f.word JOIN forms e ON e.word = p.at WHERE e.form IS NULL
"""
