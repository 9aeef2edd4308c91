"""Document quality: base rules, and a decision list learned from labelled documents.

``features`` measures every whole text by DataFrame functions, ``learn`` fits an ordered list of threshold
conjunctions for documents of bad quality, ``verdicts`` evaluates the base rules and the list as one Spark
conditional expression.  No Python runs on rows.

Method: sequential covering.  The values of each measure are cut at quantiles of the good and of the bad labelled
rows.  A rule grows on two thirds of the rows: one aggregate counts good and bad rows by measure and bin among those the
rule still covers, and the threshold of the greatest information gain joins the conjunction, until no good row is
covered or nothing is gained.  It is pruned on the other third: of its beginnings the one that best tells bad from good
there stays.  A rule enters the list if its precision over all rows left is ``precision`` or more (with one
row of each kind added, so that few rows prove nothing); rows it covers are taken out, and the next rule grows on the
rest.  The first rule that holds for a document names the reason it goes.

Distribution: measures need no shuffle and are written once (numbers only); labels join those by id.  Every
growing step is one aggregate over the binned labelled rows that returns a count per measure and bin, so the driver
holds at most ``len(MEASURES) * (2 * CUTS + 3)`` counts, and all labelled rows are used at any size.

Defined cases:
* null and empty texts have no words: all counts 0, every measure 0, base rules failed, not kept;
* very long texts are measured whole, as one row; windows of words are told apart by 64-bit hashes;
* rows whose ``crc32(id)`` is divisible by 5 are held out of learning; labelled rows without an id or quality are not
  used; repeated ids and labels count each time; equal gains go to the first measure in order, then to the smaller cut;
* too few labels, or none, learn no rule: the base rules alone decide; an empty table gives no rows;
* other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensortwin.llm.common import stored

#: Steps between the quantiles, least to greatest value, by which each measure is cut, for the good and for the bad rows.
CUTS = 16
MAX_RULES, MAX_CONDITIONS = 12, 3
#: Precision that a rule must have, with one good and one bad row added to those it covers.
PRECISION = 0.9
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "mean_word_chars", "symbol_share", "mark_share", "upper_share", "other_share", "repeat_share", "distinct_share",
            "dup_line_share", "words_a_line")


# -- measures ---------------------------------------------------------------------------------------
def _repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = F.transform(F.slice(words, F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(sorted_windows: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return F.coalesce(a["hash"] == b["hash"], F.lit(False))

        twice = F.filter(sorted_windows, lambda w, i: same(w, F.get(sorted_windows, i - 1)) | same(w, F.get(sorted_windows, i + 1)))
        starts = F.sort_array(F.transform(twice, lambda w: w["at"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(starts, first, lambda s, at: F.struct((s["n"] + F.least(F.lit(3), at - s["last"])).alias("n"), at.alias("last")))["n"]

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bind(placed, covered)).otherwise(0)

    return F.when(n >= 3, _bind(windows, count)).otherwise(0)


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def features(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, the base counts, ``base_failed`` and the measures."""
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(id).alias("doc_id"), F.array_remove(F.split(t, SPACE), "").alias("words"), F.split(t, "\n").alias("every_line"))
    lined = cut.select("doc_id", "words", F.size("words").alias("n"), F.array_join("words", "").alias("joined"),
                       F.filter("every_line", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))

    def chars(kept: str) -> Column:
        return F.length(F.regexp_replace("joined", f"[^{kept}]+", "")).cast("long")

    counted = lined.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.length("joined").cast("long").alias("word_chars"), chars("#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("n")).cast("long").alias("n_repeat_words"),
        chars("!?").alias("marks"), chars(r"\p{Lu}").alias("uppers"), F.length(F.regexp_replace("joined", r"[\p{L}\p{M}]+", "")).alias("others"),
        F.size(F.array_distinct("words")).alias("distinct"), F.size("lines").alias("n_lines"))

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("marks", "n_words").alias("mark_share"), share("uppers", "word_chars").alias("upper_share"), share("others", "word_chars").alias("other_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("distinct", "n_words").alias("distinct_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_words", "n_lines").alias("words_a_line"))


# -- rules --------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def holds(self) -> Column:
        return F.col(self.measure) > self.cut if self.above else F.col(self.measure) <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction, with the good and bad labelled rows it covered when it entered the list."""
    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def holds(self) -> Column:
        return reduce(Column.__and__, [c.holds() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f" ({self.bad} bad, {self.good} good)"


def first_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null where none does."""
    out = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        out = F.when(rules[number - 1].holds(), number).otherwise(out)
    return out


def verdicts(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """The base counts of ``features``, with ``kept`` and the rule that rejects a document."""
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                           (~F.col("base_failed") & first_rule(rules).isNull()).alias("kept"), first_rule(rules).alias("rule"))


# -- learning -----------------------------------------------------------------------------------------
def learn(measured: DataFrame, labels: DataFrame, id: str = "doc_id", quality: str = "quality", max_rules: int = MAX_RULES,
          max_conditions: int = MAX_CONDITIONS, precision: float = PRECISION) -> list[Rule]:
    """The decision list for documents of quality 0, from the labelled rows of ``features``."""
    known = labels.select(F.col(id).alias("doc_id"), (F.col(quality) == 0).cast("int").alias("bad")).where("doc_id IS NOT NULL AND bad IS NOT NULL")
    rows = measured.join(known, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = stored(rows.select(*[F.col(m).cast("double").alias(m) for m in MEASURES], "bad",
                              (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")), "quality-labelled")
    cuts = _cuts(rows)
    if cuts is None:
        return []
    bins = stored(rows.select(*[_bin(m, cuts[m]).alias(m) for m in MEASURES], "bad", "prune"), "quality-bins")
    rules: list[Rule] = []
    left = bins
    while len(rules) < max_rules:
        grown = _grow(left.where("NOT prune"), max_conditions)
        if not grown:
            break
        conditions, bad, good = _prune(left, grown)
        if (bad + 1) / (bad + good + 2) < precision:
            break
        rules.append(Rule(tuple(Condition(m, above, cuts[m][at]) for m, above, at in conditions), bad, good))
        left = left.where(~_binned(conditions))
    return rules


def _cuts(rows: DataFrame) -> dict[str, list[float]] | None:
    """Thresholds of each measure: quantiles of the bad rows and of the good ones."""
    steps = [i / CUTS for i in range(CUTS + 1)]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(m, steps, 10_000).alias(m) for m in MEASURES]).collect()  # two rows
    return {m: sorted({v for r in found for v in r[m]}) for m in MEASURES} if len(found) == 2 else None


def _bin(measure: str, cuts: list[float]) -> Column:
    """How many of the cuts are below the value: 'above cut i' is 'bin > i'."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(measure)))


def _binned(conditions: list[tuple[str, bool, int]]) -> Column:
    return reduce(Column.__and__, [F.col(m) > at if above else F.col(m) <= at for m, above, at in conditions])


def _grow(rows: DataFrame, max_conditions: int) -> list[tuple[str, bool, int]]:
    """Conditions in order of entry: each gives the greatest information gain among the rows still covered."""
    conditions: list[tuple[str, bool, int]] = []
    while len(conditions) < max_conditions:
        covered = rows.where(_binned(conditions)) if conditions else rows
        at = F.posexplode(F.array(*MEASURES)).alias("measure", "bin")
        counts = covered.select("bad", at).groupBy("measure", "bin").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()  # measures x bins
        by = [{r.bin: (r.bad, r.n - r.bad) for r in counts if r.measure == i} for i in range(len(MEASURES))]
        bad, good = (sum(v[j] for v in by[0].values()) for j in (0, 1))
        if not bad or not good:
            break
        best = _best(by, bad, good)
        if best is None:
            break
        conditions.append(best)
    return conditions


def _best(by: list[dict[int, tuple[int, int]]], bad: int, good: int) -> tuple[str, bool, int] | None:
    before = log2(bad / (bad + good))
    best, gain = None, 1e-9
    for measure, bins in zip(MEASURES, by, strict=True):
        below_bad = below_good = 0
        for b in sorted(bins)[:-1]:
            below_bad, below_good = below_bad + bins[b][0], below_good + bins[b][1]
            for above, p, n in ((True, bad - below_bad, good - below_good), (False, below_bad, below_good)):
                if p and (g := p * (log2(p / (p + n)) - before)) > gain:
                    best, gain = (measure, above, b), g
    return best


def _prune(rows: DataFrame, conditions: list[tuple[str, bool, int]]) -> tuple[list[tuple[str, bool, int]], int, int]:
    """The beginning of the conjunction that best tells bad from good in the pruning rows, and the bad and good rows
    it covers in all."""
    held = [F.sum(F.when(where & _binned(conditions[:k]) & (F.col("bad") == bad), 1).otherwise(0)) for k in range(1, len(conditions) + 1)
            for where in (F.col("prune"), F.lit(True)) for bad in (1, 0)]
    c = rows.agg(F.array(*held).alias("c")).first().c
    c = [v or 0 for v in c]

    def worth(k: int) -> float:
        bad, good = c[4 * k : 4 * k + 2]
        return (bad - good) / (bad + good) if bad + good else -1.0

    k = max(range(len(conditions)), key=lambda k: (worth(k), -k))
    return conditions[: k + 1], c[4 * k + 2], c[4 * k + 3]
