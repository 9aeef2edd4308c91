"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle (five words by default) is hashed once.  The upper bits of the hash choose one of
``BINS`` bins, the smallest hash of a bin is its sample.  Empty bins are filled by optimal
densification: bin i takes the sample of the non-empty bin j whose hash of (i, j) is smallest, which
is the first hit of a random probe sequence over the bins that all documents share.  Of each bin
only the low ``BITS`` bits are stored, packed as hexadecimal text.  Two fingerprints agree in a bin
by chance with probability 2**-BITS, so the likeness is (matches/BINS - 2**-BITS)/(1 - 2**-BITS),
held to 0..1.

Nulls and edge cases: a null text counts as empty; an empty text, or one without words, has the empty
fingerprint (likeness 1 to another empty one, 0 to any other); fewer words than a shingle are one
shingle; equal texts have equal fingerprints.  Other columns stay as they are in :func:`fingerprint`;
the names it adds are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensortwin.llm.common import stored

BINS = 128
BITS = 8
WORDS = 5


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """One 64-bit hash per shingle of ``words`` lower-cased words; null texts and texts without words
    have none.  Words are hashed once, shingles from the words' hashes."""
    token = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = F.transform(token, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(
            F.size(h) < words, F.array(F.xxhash64(h))).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)])))

    return _let(hashed, windows)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, though ``body`` names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def samples(hashes: Column, bins: int = BINS) -> Column:
    """The sample of each bin, densified; the empty array for no hashes."""
    shift = 64 - (bins - 1).bit_length()

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, shift).cast("int")

    def fill(s: Column) -> Column:
        # sorted hashes of one bin are neighbours, the first is its smallest
        lead = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
        return _let(lead, lambda a: _let(F.map_from_arrays(F.transform(a, bin_of), a), lambda m: F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)),
            lambda b: F.coalesce(F.try_element_at(m, b), F.array_min(
                F.transform(a, lambda x: F.struct(F.xxhash64(b, bin_of(x)).alias("h"), x.alias("x"))))["x"]))))

    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(_let(F.array_sort(hashes), fill))


def packed(text: Column, bins: int = BINS, bits: int = BITS, words: int = WORDS) -> Column:
    """Fingerprint of a text as hexadecimal digits, ``bits`` (4 or 8) per bin."""
    digits = bits // 4
    low = _let(shingle_hashes(text, words), lambda h: samples(h, bins))
    return F.array_join(F.transform(low, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit((1 << bits) - 1)))), digits, "0")), "")


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity from two fingerprints, corrected for chance matches; null if
    either is null."""
    digits, chance = bits // 4, 2.0**-bits
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substr(a, i * digits + 1, F.lit(digits)) == F.substr(b, i * digits + 1, F.lit(digits))))
    fair = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(bins)) - chance) / (1 - chance)))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(fair)


def fingerprint(docs: DataFrame, text_col: str = "text", as_col: str = "fingerprint", bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """The documents with their fingerprint in ``as_col``."""
    return docs.withColumn(as_col, packed(F.col(text_col), bins, bits, words))


def following(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, prev): for each distinct id the one before it in descending order (nulls last), the
    first id having the last one before it.  Ids are range-partitioned and sorted; a partition
    looks at its neighbours only through one row per partition."""
    part = stored(ids.select(F.col(id_col).alias("id")).distinct().repartitionByRange(F.col("id").desc_nulls_last()).withColumn(
        "p", F.spark_partition_id()), "fp-ids")
    within = Window.partitionBy("p").orderBy(F.col("id").desc_nulls_last())
    rows = part.withColumn("prev", F.lag(F.struct("id")).over(within))
    # one row per partition: its last id is the one before the next partition's first
    ends = part.groupBy("p").agg(F.struct(F.min(F.when(F.col("id").isNotNull(), F.col("id"))).alias("least"), F.max(F.col("id").isNull()).alias("none")).alias("e")).select(
        "p", F.struct(F.when(~F.col("e.none"), F.col("e.least")).alias("id")).alias("last"))
    ends = ends.withColumn("before", F.coalesce(F.lag("last").over(Window.orderBy("p")), F.first("last").over(
        Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("p", "before")
    return rows.join(F.broadcast(ends), "p").select("id", F.coalesce("prev", "before")["id"].alias("prev"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, words: int = WORDS) -> DataFrame:
    """Each document with its fingerprint, that of its edited text and their likeness.

    The edited text: the last floor(n/2) of n code points are replaced by the first as many (or all)
    of the next document by descending id (after the last: the first).  Where an id repeats, the
    greatest of its texts counts as the next document; every input row gives an output row."""
    def key(c: str, k: str) -> list[Column]:  # a null id is a key like any other
        return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k), F.col(c).isNull().alias(f"{k}_null")]

    # the same columns on both sides of the last join, so that one shuffle of the texts serves both
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *key(id_col, "k"))
    half = F.floor(F.length("text") / 2).cast("int")
    link = following(docs.select(F.col(id_col).alias("id"))).select(*key("id", "k"), *key("prev", "f"))
    need = rows.groupBy(F.col("k").alias("f"), F.col("k_null").alias("f_null")).agg(F.max(half).alias("need"))
    # for every next document: whose edited text it serves and with how many of its code points
    serves = link.join(need, ["f", "f_null"])
    sent = rows.join(serves, ["k", "k_null"]).groupBy(F.col("f").alias("k"), F.col("f_null").alias("k_null")).agg(F.max(F.struct(
        F.substring("text", F.lit(1), F.col("need")).alias("head"), packed(F.col("text"), bins, bits, words).alias("fp"))).alias("next"))
    out = rows.join(sent, ["k", "k_null"], "left")
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.head", F.lit(1), half))
    own_id = F.when(~F.col("k_null"), F.col("k").cast(docs.schema[id_col].dataType))
    out = out.select(own_id.alias(id_col), n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
                     packed(F.col("text"), bins, bits, words).alias("fingerprint"), packed(edited, bins, bits, words).alias("edited_fingerprint"),
                     F.col("next.fp").alias("next_fp"))
    return out.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins, bits).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("next_fp"), bins, bits).alias("near_next"))
