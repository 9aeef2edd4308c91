"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fit
  1. Labelled training rows (ids whose crc32 modulo the number of folds is not 0) are thinned to
     about ``max_examples`` by a hash of the id; that documented bound also bounds what is broadcast.
  2. Terms are words and their leading 3 to 6 letters.  The vocabulary is the ``max_terms`` terms of the sample that
     rank first by chi-square among those more frequent in toxic examples than in the sample, and the
     ``background`` most frequent three-letter beginnings, which give texts without any of the former their
     neighbours.  How far a term speaks for either label is left to the votes.  Words and beginnings that occur in
     the same documents as a shorter beginning of theirs are left out.
  3. Document frequencies of these terms are counted over *all* documents.
  4. The sample's TF-IDF vectors (unit length) are grouped by equality: one index entry holds how
     many examples of either label it stands for and the smallest id as evidence.  Entries are sorted
     so that similar ones are neighbours and cut into blocks; the index is held by term and block, with
     the largest weight of each term in each block.
  5. The raw votes of the sample, each example left out of its own neighbours, give a logistic
     calibration.

Score
  Documents are scored in batches, and only the nearest entries asked for leave a batch (none when documents are
  merely kept or rejected).  The index stays sparse; one run of blocks at a time is spread out as a dense array.
  The block maxima bound the cosine of every entry of a block; runs of blocks are
  scored in the order of their bounds, for those documents whose bound reaches their k-th best cosine so far, so the k
  nearest entries are exact, and all ties of the k-th are taken.  They vote with weight 1/(1 - cosine + 0.05),
  smoothed by the rate of the sample; a document without any term takes the rate of the examples
  without any.  The calibrated vote is the score, the nearest entries are the evidence.

Nulls and edge cases: a null or empty text has no terms and takes that rate; labels that are null or
not 0/1 are ignored, repeated labels of one id count as the larger; ids that repeat in the documents
each get a row; with no usable label, or labels of one kind only, every score is the smoothed rate
(0.5 without any).  Very long texts are scored whole.  Ids are integers; they only pick the fold and name the evidence;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensortwin.llm.common import map_rows, ship, slices, stored, texts_of

MAX_EXAMPLES = 20_000
MAX_TERMS = 256
BACKGROUND = 64
MIN_COUNT = 2
NEIGHBOURS = 25
FOLDS = 5
BLOCK = 64
#: Blocks scored together, and documents scored together.
RUN = 16
BATCH = 512
#: Bytes of texts that are Python strings at once, and word beginnings a worker remembers.
SLICE_BYTES = 4 << 20
KNOWN = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")
_PREFIXES = (3, 4, 5, 6)


def held_out(id_col) -> F.Column:
    """The rows no label is learned from: crc32 of the id as text modulo ``FOLDS`` is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def terms_of(word: str) -> list[str]:
    """The word itself and, marked by ``*``, its beginnings."""
    return [word] + [word[:n] + "*" for n in _PREFIXES if len(word) >= n]


class Vocabulary:
    """Chosen terms and their inverse document frequencies; finds the terms of a text."""

    def __init__(self, idf: dict[str, float]):
        self.terms = sorted(idf)
        self.idf = np.array([idf[t] for t in self.terms])
        self.number = {t: i for i, t in enumerate(self.terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def count(self, text: str) -> Counter:
        """How often each chosen term occurs."""
        out: Counter = Counter()
        known, number = self.known, self.number
        if len(known) > KNOWN:
            known.clear()
        most = _PREFIXES[-1]
        for w, n in Counter(words(text)).items():
            head = w[:most]  # all of a word's beginnings
            got = known.get(head)
            if got is None:
                got = known[head] = tuple(number[t] for t in terms_of(head)[1:] if t in number)
            for t in got:
                out[t] += n
            if (whole := number.get(w)) is not None:
                out[whole] += n
        return out

    def vector(self, counts: Counter) -> tuple[tuple[int, float], ...]:
        """Unit TF-IDF vector as (term, weight) pairs; empty without terms of positive weight."""
        raw = [(t, (1 + math.log(c)) * self.idf[t]) for t, c in sorted(counts.items())]
        norm = math.sqrt(sum(w * w for _, w in raw))
        return tuple((t, round(float(w / norm), 6)) for t, w in raw) if norm else ()


def packed(vectors: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, terms, weights) of many vectors, end to end."""
    starts = np.cumsum([0, *map(len, vectors)], dtype=np.int32)
    return starts, np.array([t for v in vectors for t, _ in v], np.int32), np.array([w for v in vectors for _, w in v], float)


@dataclass
class Index:
    """Block-max inverted index of distinct labelled vectors: weights by term, block and place in the block.
    ``vectors``: a list of vectors, or what :func:`packed` makes of it."""

    vectors: list | tuple
    negatives: np.ndarray
    positives: np.ndarray
    evidence: list
    terms: int = 0

    def __post_init__(self):
        starts, terms, weights = self.vectors if isinstance(self.vectors, tuple) else packed(self.vectors)
        self.size = len(starts) - 1
        lengths = np.diff(starts)
        # bytes that sort as the (term, weight) pairs of a vector by falling weight do
        falling = np.lexsort((-weights, np.repeat(np.arange(self.size), lengths)))
        pairs = np.empty(len(terms), [("t", ">i4"), ("w", ">f8")])
        pairs["t"], pairs["w"] = terms[falling], weights[falling]
        raw, wide = pairs.tobytes(), pairs.itemsize
        keys = [raw[wide * a : wide * z] for a, z in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
        order = np.array(sorted(range(self.size), key=keys.__getitem__), int)
        self.negatives, self.positives = self.negatives[order].astype(float), self.positives[order].astype(float)
        self.evidence = [self.evidence[i] for i in order.tolist()]
        # as arrays they travel compactly
        self.starts = np.cumsum([0, *lengths[order]])
        moved = np.arange(len(terms)) + np.repeat(starts[order] - self.starts[:-1], lengths[order])
        self.vectors = (terms[moved], weights[moved])
        self.terms = max(self.terms, int(terms.max(initial=-1)) + 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "largest"}

    def _run(self, run: int) -> np.ndarray:
        """Weights of a run of blocks as a (term, entry) array, entries filled up to a whole run."""
        out = np.zeros((self.terms, RUN * BLOCK))
        first, end = run * RUN * BLOCK, min((run + 1) * RUN * BLOCK, self.size)
        a, z = self.starts[first], self.starts[end]
        terms, weights = self.vectors
        out[terms[a:z], np.repeat(np.arange(end - first), np.diff(self.starts[first : end + 1]))] = weights[a:z]
        return out

    def _load(self) -> None:
        """Block maxima, by term."""
        if "largest" not in self.__dict__:
            runs = -(-self.size // (BLOCK * RUN))
            self.largest = np.concatenate([self._run(r).reshape(self.terms, RUN, BLOCK).max(2) for r in range(runs)], 1)

    def vector(self, entry: int) -> tuple[tuple[int, float], ...]:
        a, z = self.starts[entry], self.starts[entry + 1]
        return tuple(zip(self.vectors[0][a:z].tolist(), self.vectors[1][a:z].tolist(), strict=True))

    def nearest(self, vector, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines of the k nearest entries of positive cosine and all ties of the k-th."""
        return self.nearest_of([vector], k)[0]

    def nearest_of(self, vectors: list, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for many vectors."""
        n = len(vectors)
        if not self.terms or not self.size:
            return [(np.empty(0, int), np.empty(0))] * n
        self._load()
        q = np.zeros((n, self.terms))
        for i, v in enumerate(vectors):
            for t, w in v:
                if t < self.terms:
                    q[i, t] = w
        bound = (q @ self.largest).reshape(n, -1, RUN).max(2)  # of each run of blocks
        top, kth = np.zeros((n, k)), np.zeros(n)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for run in np.argsort(-bound.sum(0), kind="stable").tolist():
            at = np.flatnonzero((bound[:, run] > 0) & (bound[:, run] >= kth - 1e-9))
            if not len(at):
                continue
            first = run * RUN * BLOCK
            cosines = q[at] @ self._run(run)
            both = np.concatenate([top[at], cosines], 1)
            top[at] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
            kth[at] = top[at].min(1)
            d, e = np.nonzero(cosines > np.maximum(0.0, kth[at] - 1e-9)[:, None])
            found.append((at[d], e + first, cosines[d, e]))
        if not found:
            return [(np.empty(0, int), np.empty(0))] * n
        d, e, c = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = c >= kth[d] - 1e-9
        d, e, c = d[keep], e[keep], np.minimum(c[keep], 1.0)
        order = np.lexsort((e, -c.round(9), d))
        d, e, c = d[order], e[order], c[order]
        ends = np.searchsorted(d, np.arange(n + 1))
        return [(e[a:z], c[a:z]) for a, z in zip(ends, ends[1:], strict=False)]


@dataclass
class Model:
    vocabulary: Vocabulary
    index: Index
    rate: float
    empty_rate: float
    slope: float = 1.0
    offset: float = 0.0
    k: int = NEIGHBOURS

    def _vote(self, entries: np.ndarray, cosines: np.ndarray, without: tuple[int, int] | None = None) -> float:
        """Raw vote for toxic (0 to 1); ``without``: an entry and label of which one example does not vote."""
        weight = 1.0 / (1.0 - cosines + 0.05)
        pos, neg = self.index.positives[entries], self.index.negatives[entries]
        if without is not None:
            (pos if without[1] else neg)[entries == without[0]] -= 1  # fancy indexing made copies above
        yes, every = float((weight * pos).sum()), float((weight * (pos + neg)).sum())
        return (yes + self.rate) / (every + 1.0)

    def votes_left_out(self, entries: list[int], labels: list[int]) -> list[float]:
        """The raw vote of an example of each entry, by all others."""
        out = []
        for at in range(0, len(entries), BATCH):
            part = entries[at : at + BATCH]
            near = self.index.nearest_of([self.index.vector(e) for e in part], self.k)
            out += [self._vote(*found, (e, y)) for found, e, y in zip(near, part, labels[at : at + BATCH], strict=True)]
        return out

    def score_texts(self, texts: list[str], most: int | None = None) -> list[tuple[float, list[tuple[int, float]]]]:
        """Calibrated probability and the neighbours of every text, of these the ``most`` nearest (None: all)."""
        out = []
        for at in range(0, len(texts), BATCH):
            vectors = [self.vocabulary.vector(self.vocabulary.count(t)) for t in texts[at : at + BATCH]]
            for v, (entries, cosines) in zip(vectors, self.index.nearest_of(vectors, self.k), strict=True):
                if not v:
                    out.append((self.empty_rate, []))
                    continue
                vote = self._vote(entries, cosines) if len(entries) else self.rate
                vote = min(max(vote, 1e-6), 1 - 1e-6)
                odds = self.slope * math.log(vote / (1 - vote)) + self.offset
                near = list(zip(entries[:most].tolist(), cosines[:most].tolist(), strict=True))
                out.append((1 / (1 + math.exp(-min(max(odds, -30.0), 30.0))), near))
        return out

    def forget(self) -> None:
        """Drop what can be made again, so that a reused worker holds nothing of this model but its arrays."""
        self.vocabulary.known.clear()
        self.index.__dict__.pop("largest", None)


def calibration(votes: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of label on log-odds of the vote (Newton, slightly shrunk
    towards the identity so that separable votes stay finite)."""
    if not len(votes) or not 0 < (labels * counts).sum() < counts.sum():
        return 1.0, 0.0
    x = np.log(np.clip(votes, 1e-6, 1 - 1e-6) / (1 - np.clip(votes, 1e-6, 1 - 1e-6)))
    design, beta, prior = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (counts * (p - labels)) + (beta - prior)
        hess = (design * (counts * p * (1 - p))[:, None]).T @ design + np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS,
        background: int = BACKGROUND, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Fit on labelled rows of ``docs`` outside the held-out fold (see the module's text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    total = usable.count()
    part = min(1.0, max_examples / max(total, 1))
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    # about max_examples ids and labels, 16 bytes each: small enough to send to every task
    sample = stored(docs.join(F.broadcast(chosen), "id").select("id", "y", "text"), "tox-sample")

    def by_label(batch):
        texts, ys = texts_of(batch), batch.column("y").to_pylist()
        yes, every = Counter(), Counter()
        for t, y in zip(texts, ys, strict=True):
            got = {x for w in set(words(t)) for x in terms_of(w)}
            every.update(got)
            if y:
                yes.update(got)
        return {"term": list(every), "n": list(every.values()), "n_pos": [yes[t] for t in every]}

    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = int(size["n"]), int(size["p"])
    rate = (p + 0.5) / (n + 1)
    chosen_terms = []
    if 0 < p < n:
        counted = map_rows(sample, by_label, "term string, n long, n_pos long").groupBy("term").agg(
            F.sum("n").cast("double").alias("n"), F.sum("n_pos").cast("double").alias("a"))
        a, m, big_n, big_p = F.col("a"), F.col("n"), F.lit(float(n)), F.lit(float(p))
        chi2 = big_n * F.pow(a * (big_n - big_p) - (m - a) * big_p, 2) / (
            m * (big_n - m) * big_p * (big_n - big_p))
        ranked = counted.where((m < big_n) & (a >= MIN_COUNT) & (a * big_n > m * big_p)).select("term", "n", "a", chi2.alias("chi2"))
        # several for each place, as those that tell the same documents apart are merged
        usable_terms = ranked.orderBy(F.desc("chi2"), "term").limit(16 * max_terms)

        def begun(term, other):
            return (other != term) & other.endswith("*") & term.startswith(F.regexp_replace(other, r"\*$", ""))

        # a beginning occurs wherever its continuations do: with equal counts these are the same documents
        alike = usable_terms.groupBy("n", "a", F.substring("term", 1, _PREFIXES[0])).agg(
            F.collect_list("term").alias("terms"), F.first("chi2").alias("chi2"))
        chosen_terms = [r["term"] for r in alike.select("chi2", F.explode(F.filter(
            "terms", lambda t: ~F.exists("terms", lambda u: begun(t, u)))).alias("term")).orderBy(
            F.desc("chi2"), "term").limit(max_terms).collect()]
        frequent = counted.where((m < big_n) & (F.length("term") == _PREFIXES[0] + 1) & F.col("term").endswith("*"))
        chosen_terms += [r["term"] for r in frequent.orderBy(F.desc("n"), "term").limit(background).collect() if r["term"] not in set(chosen_terms)]
    # document frequencies of the chosen terms over every document
    plain = Vocabulary(dict.fromkeys(chosen_terms, 1.0))
    sent = spark.sparkContext.broadcast(plain)

    def frequencies(batch):
        seen = Counter()
        for t in texts_of(batch):
            seen.update(sent.value.count(t).keys())
        return {"term": [-1, *seen], "df": [batch.num_rows, *seen.values()]}

    df = {r["term"]: r["df"] for r in map_rows(docs.select("text"), frequencies, "term int, df long", SLICE_BYTES,
                                               lambda: sent.value.known.clear()).groupBy("term").agg(
        F.sum("df").alias("df")).collect()} if chosen_terms else {}
    sent.unpersist()
    every = df.get(-1, 0)
    vocabulary = Vocabulary({t: math.log(1 + every / max(1, df.get(i, 0))) for t, i in plain.number.items()})
    seen = spark.sparkContext.broadcast(vocabulary)

    def vectors(batch):
        starts, terms, weights = packed([seen.value.vector(seen.value.count(t)) for t in texts_of(batch)])
        return {"terms": pa.ListArray.from_arrays(pa.array(starts), pa.array(terms)), "weights": pa.ListArray.from_arrays(pa.array(starts), pa.array(weights)),
                "y": batch.column("y"), "id": batch.column("id")}

    # arrays from the tasks to the index: a Python object for each weight would be hundreds of MB
    groups = map_rows(sample, vectors, "terms array<int>, weights array<double>, y int, id long", SLICE_BYTES,
                      lambda: seen.value.known.clear()).groupBy("terms", "weights").agg(
        F.sum(1 - F.col("y")).alias("neg"), F.sum("y").alias("pos"), F.min("id").alias("id")).toArrow()
    seen.unpersist()
    lengths, neg, pos, ids = (x.to_numpy() for x in (pc.list_value_length(groups["terms"]), groups["neg"], groups["pos"], groups["id"]))
    some = lengths > 0
    none = list(zip(neg[~some].tolist(), pos[~some].tolist(), strict=True))
    flat = np.cumsum([0, *lengths[some]], dtype=np.int32), *(pc.list_flatten(groups[c]).to_numpy() for c in ("terms", "weights"))
    index = Index(flat, neg[some], pos[some], ids[some].tolist(), len(plain.terms))
    model = Model(vocabulary, index, rate, (none[0][1] + rate) / (sum(none[0]) + 1) if none else rate, k=k)
    if index.size:
        fitted = spark.sparkContext.broadcast(model)
        counts = zip(index.negatives.tolist(), index.positives.tolist(), strict=True)
        rows = spark.createDataFrame([(e, y, int(c)) for e, both in enumerate(counts) for y, c in enumerate(both) if c],
                                     "entry int, y int, c long").repartition(spark.sparkContext.defaultParallelism)

        def left_out(batch):
            entries, ys = batch.column("entry").to_pylist(), batch.column("y").to_pylist()
            return {"vote": fitted.value.votes_left_out(entries, ys), "y": ys, "c": batch.column("c")}

        votes = map_rows(rows, left_out, "vote double, y int, c long", done=lambda: fitted.value.forget()).groupBy(
            F.round("vote", 3).alias("vote")).agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("y")).alias("p")).orderBy("vote").collect()
        fitted.unpersist()
        model.slope, model.offset = calibration(
            *(np.array(x, float) for x in ([v["vote"] for v in votes], [v["p"] / v["c"] for v in votes], [v["c"] for v in votes])))
    return model


def score(docs: DataFrame, model: Model, evidence: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``score``, ``predicted`` and ``evidence``, the nearest entries as
    (example id, cosine, toxic examples, clean examples)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch):
        m = sent.value
        scored = m.score_texts(texts_of(batch), evidence)
        return {id_col: batch.column(0), "score": [s for s, _ in scored], "predicted": [int(s >= 0.5) for s, _ in scored],
                "evidence": [[{"example": m.index.evidence[e], "cosine": c, "toxic": int(m.index.positives[e]), "clean": int(m.index.negatives[e])}
                              for e, c in near] for _, near in scored]}

    return map_rows(docs.select(id_col, docs[text_col].alias("text")), run,
                    f"`{id_col}` {id_type}, score double, predicted int, evidence array<struct<example:long,cosine:double,toxic:int,clean:int>>",
                    SLICE_BYTES, done=lambda: sent.value.forget())


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below the threshold; texts are scored in place, so
    no join is needed and rows of null or repeated ids are judged by their own text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        m = sent.value
        try:
            for batch in batches:
                for part in slices(batch, SLICE_BYTES):
                    low = [s < threshold for s, _ in m.score_texts([t or "" for t in part.column(place).to_pylist()], 0)]
                    yield part.filter(pa.array(low, pa.bool_()))
        finally:
            m.forget()

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
