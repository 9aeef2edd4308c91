"""Phrase collocations by set-oriented (SETM) relational mining.

Texts are cut at punctuation and line ends into pieces and these into words; A-Z are lower-cased.  Everything is
counted per language.  Phrases of 2 to ``longest`` words that occur ``least`` times or more are candidates; a
candidate scores ``floor(1000 * a * n / (l * r))`` at its lowest cut, and goes where a longer candidate holds its
words and occurs as often.  The first ``top`` phrases of each language stay.

Method: the occurrences of frequent words are written as a relation ``(row, at, gram)``, bucketed by row and
sorted by row and position.  To lengthen phrases by a word the relation is merge-joined with itself by row and
adjacent position (both parts of a phrase are then frequent), the pairs are group-counted, and only occurrences
of frequent pairs, found by a semi-join, are written as the relation of the next length.  All that follows (cuts,
longer phrases, ranks) are equi-joins of the tables of frequent phrases.

Distribution: equal texts of a language are one row with a weight, so groups of copies are counted once; buckets
hold whole rows, so the merge joins move nothing.  Counts are combined in the map tasks before they are shuffled, so a
phrase that makes up a third of all occurrences is one row a task.  The table of frequent phrases of one length
(at most one in ``least`` occurrences) is broadcast up to ``BROADCAST_ROWS`` rows, beyond that it is joined
by a shuffle, whose hot keys adaptive execution splits.  Rows and phrases go by 64-bit hashes; rows by two of them,
and words and frequent phrases by one that is proven to be unique over all of them, or else taken with another seed.

Defined cases:
* a null language is ``und``; null and empty texts hold no words; repeated rows count each;
* ids are not read; a text of any length is one row of the first shuffle, so one text must fit a task;
* equal scores go by falling count, then by the phrase's UTF-8 bytes; an empty table gives no rows;
* other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensortwin.llm.common import stored
from sensortwin.session import scratch_path

LONGEST, LEAST, TOP = 5, 100, 2000
#: Rows (of 24 bytes) up to which a table of frequent phrases is broadcast.
BROADCAST_ROWS = 500_000
#: A position is ``piece * 2^32 + word``, so that words of different pieces are never adjacent.
PIECE_BITS = 32


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    plain = F.length(text) == F.octet_length(text)  # pure ASCII, where lower() does just that
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words_of(piece: Column) -> Column:
    return F.array_remove(F.split(F.replace(piece, F.lit("\t"), F.lit(" ")), " "), "")


def pieces_of(text: Column) -> Column:
    return F.split(lower_ascii(text), r"[.,;:!?\x0A-\x0D]")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of the first ``top`` phrases of each language."""
    spark = docs.sparkSession
    rows = stored(docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text <> ''")
                  .groupBy("lang", "text").agg(F.count(F.lit(1)).alias("w")), "setm-rows")
    words = _word_counts(rows)
    seed = _unique_seed(words, "lang", "word")
    total = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "setm-total")
    first = stored(words.where(F.col("f") >= least).select(
        "lang", _item(seed).alias("gram"), F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.lit(1).alias("k")), "setm-frequent")
    with _merge_joins(spark), _Relations(spark) as relations:
        frequent, tables = relations.write(_occurrences(rows, first, seed)), [first]
        for k in range(2, longest + 1):
            tables.append(_longer(frequent, tables[-1], k, least))
            if k == longest or tables[-1].isEmpty():
                break
            known = tables[-1].select(F.col("left").alias("l"), F.col("right").alias("r"), F.col("gram").alias("g"))
            frequent = relations.write(_bounded(_pairs(frequent).alias("p").join(_sized(known), ["l", "r"]).select(
                "h", "h2", "at", F.col("g").alias("gram"), "w"), known))
    every = tables[0].select("lang", "phrase", "f", "k")
    for t in tables[1:]:
        every = every.union(t.select("lang", "phrase", "f", "k"))
    return _ranked(_maximal(_scored(stored(every, "setm-phrases"), total)), top)


# -- words ------------------------------------------------------------------------------------------
def _word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""
    pieces = rows.select("lang", "w", F.explode(pieces_of(F.col("text"))).alias("piece")).where("piece <> ''")
    words = pieces.select("lang", "w", F.explode(words_of(F.col("piece"))).alias("word"))
    return stored(words.groupBy("lang", "word").agg(F.sum("w").alias("f")), "setm-words")


def _item(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", "word")


def _unique_seed(table: DataFrame, *key: str) -> int:
    """The first seed by which no two rows of ``table`` (distinct in ``key``) have the same hash."""
    seed = 0
    while not table.select(F.xxhash64(F.lit(seed), *key).alias("h")).groupBy("h").count().where("count > 1").isEmpty():
        seed += 1
    return seed


def _occurrences(rows: DataFrame, first: DataFrame, seed: int) -> DataFrame:
    """(h, h2, at, gram, w) of every frequent word: row by two hashes, position, word, weight of the row."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.xxhash64("lang", "text").alias("h"), F.xxhash64("text", F.lit(1), "lang").alias("h2"), "lang", "text", "w")
    dealt = keyed.repartition(parts, "h").sortWithinPartitions("h", "h2")
    pieces = dealt.select("h", "h2", "lang", "w", F.posexplode(pieces_of(F.col("text"))).alias("piece", "words")).where("words <> ''")
    words = pieces.select("h", "h2", "lang", "w", "piece", F.posexplode(words_of(F.col("words"))).alias("word_no", "word"))
    placed = words.select("h", "h2", (F.shiftleft(F.col("piece").cast("long"), PIECE_BITS) + F.col("word_no")).alias("at"), _item(seed).alias("gram"), "w")
    known = first.select("gram")
    return _bounded(placed.join(_sized(known), "gram", "left_semi").select("h", "h2", "at", "gram", "w"), known)


# -- relations ----------------------------------------------------------------------------------------
def _sized(table: DataFrame) -> DataFrame:
    """A broadcast of a table proven small, or the table."""
    return F.broadcast(table) if _small(table) else table


def _small(table: DataFrame) -> bool:
    return table.count() <= BROADCAST_ROWS


def _bounded(joined: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a join with a frequent table, dealt by row again where the join was not a broadcast."""
    if _small(known):
        return joined
    return joined.repartition(int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")


class _Relations:
    """Bucketed and sorted tables below the shared folder; their catalog entries go at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> _Relations:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def write(self, relation: DataFrame) -> DataFrame:
        name = f"setm_{uuid.uuid4().hex}"
        (relation.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h", "h2", "at")
         .option("path", scratch_path(self.spark, "llm-setm-relation")).saveAsTable(name))
        self.names.append(name)
        return self.spark.table(name)


@contextmanager
def _merge_joins(spark: SparkSession) -> Iterator[None]:
    """Tables that are bucketed by the row are joined by row and position as they lie."""
    mine = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.enabled": "true",
            "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {key: spark.conf.get(key, None) for key in mine}
    try:
        for key, value in mine.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _pairs(relation: DataFrame) -> DataFrame:
    """Occurrences whose next word starts another one: (row, at, w) with the left and the right part."""
    left = relation.select("h", "h2", F.col("at"), (F.col("at") + 1).alias("next"), F.col("gram").alias("l"), "w")
    right = relation.select(F.col("h").alias("rh"), F.col("h2").alias("rh2"), F.col("at").alias("rat"), F.col("gram").alias("r"))
    on = (F.col("h") == F.col("rh")) & (F.col("h2") == F.col("rh2")) & (F.col("next") == F.col("rat"))
    return left.join(right.hint("merge"), on).select("h", "h2", "at", "l", "r", "w")


def _longer(relation: DataFrame, shorter: DataFrame, k: int, least: int) -> DataFrame:
    """The frequent phrases of ``k`` words, from occurrences and phrases of one word less."""
    found = stored(_pairs(relation).groupBy("l", "r").agg(F.sum("w").alias("f")).where(F.col("f") >= least), "setm-counts")
    seed = _unique_seed(found, "l", "r")
    begin = shorter.select(F.col("gram").alias("l"), "lang", F.col("phrase").alias("begin"))
    end = shorter.select(F.col("gram").alias("r"), "last")
    return stored(found.join(begin, "l").join(end, "r").select(
        "lang", F.xxhash64(F.lit(seed), "l", "r").alias("gram"), F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f",
        F.lit(k).alias("k"), F.col("l").alias("left"), F.col("r").alias("right")), "setm-frequent")


# -- scores -------------------------------------------------------------------------------------------
def _scored(every: DataFrame, total: DataFrame) -> DataFrame:
    """Candidates with their lowest cut: lang, phrase, k, a, l, r, n, score."""
    words = F.split("phrase", " ")
    cuts = (every.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
            .select("*", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("begin"),
                    F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest")))
    sized = (cuts.join(every.select("lang", F.col("phrase").alias("begin"), F.col("f").alias("l")), ["lang", "begin"])
             .join(every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(total, "lang"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    sized = sized.withColumn("above", (wide["a"] * wide["n"]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    score = F.expr("above div below")
    best = sized.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score")


def _maximal(scored: DataFrame) -> DataFrame:
    """Without phrases whose words a longer candidate holds and that occur no more often."""
    words = F.split("phrase", " ")
    parts = (scored.where("k >= 3").select("lang", "k", F.col("a").alias("longer"), words.alias("words"), F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
             .select("lang", "longer", "words", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("start"))
             .select("lang", F.array_join(F.slice("words", F.col("start"), F.col("size")), " ").alias("phrase"), "longer"))
    held = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return scored.join(held, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # cut before the shuffle as well
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))
