"""Quality rules, phrase mining and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from sensortwin.llm import centroids, collocations, quality_rules
from sensortwin.llm.common import stored, table

from .helpers import WORDS, awkward, documents, prose

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"


# -- quality rules ------------------------------------------------------------------------------
def plain_counts(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = list(zip(words, words[1:], words[2:]))
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            repeats += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), failed


def base(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_base_counts_equal_the_plain_rules(spark):
    df, rows = awkward(spark)
    r = random.Random(4)
    odd = [(100 + i, "".join(r.choice("ab \t\n\r\x0b\x0c#|é \U0001f600A!") for _ in range(r.randrange(300)))) for i in range(60)]
    odd += [(200, "a b a b a b a"), (201, "x\nx\n \nx\n\n"), (202, "a b c d a b c e b c d")]
    got = Counter((x.doc_id, *base(x)) for x in quality_rules.features(df.unionByName(documents(spark, odd))).collect())
    assert got == Counter((i, *plain_counts(t)) for i, t in rows + odd)


def test_first_rule_decides_and_rules_read_as_written(spark):
    c = quality_rules.Condition
    rules = [quality_rules.Rule((c("n_words", False, 2.0),), 3, 0), quality_rules.Rule((c("symbol_share", True, 0.1), c("upper_share", False, 0.5)), 5, 1)]
    text = {1: "a b", 2: "a b c #|#|", 3: "a b c d", 4: "ABC DEF GH #|#", 5: ""}
    rows = quality_rules.verdicts(quality_rules.features(documents(spark, list(text.items()))), rules).collect()
    assert {r.doc_id: r.rule for r in rows} == {1: 1, 2: 2, 3: None, 4: None, 5: 1}
    assert not any(r.kept for r in rows)  # too short for the base rules
    assert str(rules[1]) == "symbol_share > 0.1 and upper_share <= 0.5 (5 bad, 1 good)"


def labelled(spark, n=600):
    """Documents of which every fifth is shouted or salted with symbols, and their labels."""
    r, rows, labels = random.Random(9), [], []
    for i in range(n):
        words = [r.choice(WORDS) + str(r.randrange(400)) for _ in range(r.randrange(60, 200))]
        kind = r.choice(["upper", "salt"]) if i % 5 == 0 else ""
        if kind == "upper":
            words = [w.upper() + "!!" for w in words]
        elif kind == "salt":
            words = [w + r.choice(["###", "$$$"]) for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if kind else 1, 0))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: q for i, q, _ in labels}


def test_learned_list_separates_planted_junk_and_skips_held_out_labels(spark):
    docs, labels, truth = labelled(spark)
    measured = stored(quality_rules.features(docs), "t")
    rules = quality_rules.learn(measured, labels)
    kept = {r.doc_id: r.kept for r in quality_rules.verdicts(measured, rules).collect()}
    assert kept == {i: q == 1 for i, q in truth.items()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = spark.createDataFrame([(i, 1 - truth[i] if i in held else truth[i], 0) for i in truth], "doc_id long, quality int, toxic int")
    assert quality_rules.learn(measured, wrong) == rules  # held-out labels are not read
    assert quality_rules.learn(measured, labels) == rules


def test_growing_takes_the_best_gain(spark):
    """The first condition of a rule has the greatest gain of all thresholds, by plain counting."""
    docs, labels, truth = labelled(spark, 300)
    measured = stored(quality_rules.features(docs), "t")
    rule = quality_rules.learn(measured, labels)[0]
    rows = [(r, truth[r.doc_id] == 0) for r in measured.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]

    def gain(c):
        hit = [bad for r, bad in rows if (r[c.measure] > c.cut) == c.above]
        p, all_bad = sum(hit), sum(b for _, b in rows)
        return p * (math.log2(p / len(hit)) - math.log2(all_bad / len(rows))) if p else 0

    values = {m: sorted({r[m] for r, _ in rows}) for m in quality_rules.MEASURES}
    best = max(gain(quality_rules.Condition(m, above, v)) for m in values for v in values[m] for above in (True, False))
    assert gain(rule.conditions[0]) >= 0.8 * best  # thresholds are quantiles, and a third of the rows prunes


def test_no_labels_learn_nothing(spark):
    df, _ = awkward(spark)
    measured = stored(quality_rules.features(df), "t")
    none = spark.createDataFrame([(1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.learn(measured, none) == []
    one_kind = spark.createDataFrame([(i, 0, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    assert quality_rules.learn(measured, one_kind) == []
    assert {r.doc_id: r.kept for r in quality_rules.verdicts(measured, []).collect()}[3] is False


def test_quality_on_the_tables(spark):
    """On sf0.1, held out: junk goes, and no document that the base rules pass and the labels call good."""
    sf = "/root/testdata/sf0.1"
    measured = stored(quality_rules.features(table(spark, sf, "documents")), "t")
    labels = table(spark, sf, "labels")
    rows = quality_rules.verdicts(measured, quality_rules.learn(measured, labels)).join(labels, "doc_id").where("crc32(string(doc_id)) % 5 = 0").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad) and sum(r.kept for r in good) >= 0.98 * len(good)


# -- collocations ---------------------------------------------------------------------------------
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, longest=5, least=100, top=2000):
    """(lang, text) rows -> the operator's rows."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if held[p] < a:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def lang_documents(spark, rows):
    full = [(i, t, lang, "s", 1, 2, "w") for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, gram string, h long, w long, phrase string")


def phrases(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["New York", "alpha", "beta", "of the", "Ünder", "x, y", "one two three four five six", "a\tb", "tail."]) for _ in range(n))


@pytest.mark.parametrize("broadcast", [True, False])
def test_collocations_equal_counting(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    rows = [(r, phrases(i, 150)) for i, r in enumerate(["en", "de", None, "und"] * 8)]
    rows += [("en", "the very same text, copied here")] * 40 + [("fr", "la la la la la la")] * 3 + [("en", None), (None, ""), ("en", " . ,\n"), ("xx", "one")]
    got = [tuple(r) for r in collocations.mine(lang_documents(spark, rows), least=7, top=25).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_collocations(rows, least=7, top=25)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("setm_")]


def test_collocations_join_without_exchange(spark):
    """The relation is merge-joined with itself as it lies: no exchange below the join."""
    rows = lang_documents(spark, [("en", phrases(i, 50)) for i in range(6)])
    with collocations._merge_joins(spark), collocations._Relations(spark) as relations:
        r = relations.write(rows.selectExpr("h", "h as h2", "doc_id as at", "h as gram", "w").repartition(8, "h"))
        plan = collocations._pairs(r)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"  # the caller's settings are back


def test_collocations_on_the_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = [tuple(r) for r in collocations.mine(docs, least=10).collect()]
    want = plain_collocations(rows, least=10)
    assert len(want) > 50 and len(got) == len(want) and set(got) == want


def test_hash_seeds_are_tried_until_unique(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "c")], "lang string, word string")
    assert collocations._unique_seed(rows, "lang", "word") == 0


# -- centroids --------------------------------------------------------------------------------------
def plain_centroids(rows, width, k, rounds=3):
    """(id, vector) -> {(id, ints): (cluster, distance)} lists and the centroids."""
    kept = [(i, [math.floor(Fraction(float(v)) * 64) for v in x]) for i, x in rows
            if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None))
    centers = [x for _, x in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[near(x)[1]].append(x)
        centers = [[sum(v) // len(groups[j]) for v in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centers)]
    return [(i, *near(x)[::-1]) for i, x in kept], centers


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 1, 0.5, "c") for i, x in rows], "vec_id long, embedding array<float>, label int, rest double, cluster string")


def test_centroids_equal_plain_rounds(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(j % 3, 1) for j in range(64)]) for i in range(150)]
    rows += rows[:5] + [(5, [0.25] * 64), (900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [float("inf")] + [0.0] * 63), (904, [None] + [0.0] * 63)]
    rows = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in rows]
    got, centers = centroids.cluster(vectors(spark, rows))
    want, want_centers = plain_centroids(rows, 64, 16)
    assert centers == want_centers
    assert Counter(map(tuple, got.collect())) == Counter(want)
    total = sum(d for *_, d in want)
    for row in centroids.digest(got, centers).collect():
        assert row.inertia == total and row.cluster_inertia == sum(d for _, j, d in want if j == row.cluster)
        assert row.centroid_sha256 == hashlib.sha256(",".join(map(str, want_centers[row.cluster])).encode()).hexdigest()


def test_centroids_of_huge_components_are_exact(spark):
    rows = [(i, [float(i)] * 64) for i in range(20)] + [(50, [2.0**60] * 64), (51, [-(2.0**60)] * 64), (52, [3.0e38] + [0.0] * 63)]
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in rows]
    got, centers = centroids.cluster(vectors(spark, rows))
    want, want_centers = plain_centroids(rows, 64, 16)
    assert centers == want_centers
    assert Counter(map(tuple, got.collect())) == Counter((i, j, d if d < 1 << 63 else None) for i, j, d in want)
    unknown = {r.cluster: (r.cluster_inertia, r.inertia) for r in centroids.digest(got, centers).collect()}
    for j in {j for _, j, _ in want}:
        whole = sum(d for _, c, d in want if c == j)
        assert unknown[j][0] == (whole if all(d < 1 << 63 for _, c, d in want if c == j) and whole < 1 << 63 else None)


def test_few_or_no_vectors(spark):
    got, centers = centroids.cluster(vectors(spark, [(1, [1.0] * 64), (2, [2.0] * 64)]))
    assert len(centers) == 2 and sorted(r.distance for r in got.collect()) == [0, 0]
    got, centers = centroids.cluster(vectors(spark, [(1, None)]))
    assert centers == [] and centroids.digest(got, centers).count() == 0


def test_filter_keeps_the_nearest_and_prunes():
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.normal(0, 0.1, (400, 64)) @ np.diag(4 * 0.85 ** np.arange(64))).astype(np.int64)
    centers = x[:16].copy()
    centers[3] = centers[2]  # a tie goes to the smaller number
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, np.argsort(-values)]
    lead, rest = centroids._parts(x.astype(float), axes, 16)
    which, best, exact = centroids.nearest(x, lead, rest, centers, axes)
    d = ((x[:, None, :] - centers[None]) ** 2).sum(2)
    assert (which == d.argmin(1)).all() and (best == d.min(1)).all()
    assert exact < 0.6 * d.size


def test_limbs_add_up():
    for v in (0, 5, -5, 1 << 70, -(1 << 133) + 7):
        assert sum(limb << (centroids.LIMB_BITS * i) for i, limb in enumerate(centroids._limbs(v))) == v
