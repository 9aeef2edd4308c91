"""Benchmark decontamination: documents that hold a passage of a benchmark item, up to edits.

Texts become words (lower case, ASCII punctuation dropped).  A window of a document matches an item
of m words if their word edit distance is at most ``EDITS`` * m.  Items are grouped by length: items
of a group are represented by their first L words (L: the group's smallest length), windows have
those L words too.

  1. Anchors: an item of m words within distance d of a window shares at least
     m - GRAM + 1 - GRAM * d runs of ``GRAM`` words with it, none shifted by more than d (q-gram
     lemma), so only windows around so many runs are candidates.  Runs are found by a hash table of
     the items' grams, in tasks; no window that could match is lost.
  2. CGK: a random walk reads the window's L words, copying the current word at each of 3L steps and
     moving on by a random bit that depends on step and word.  Words that agree keep two walks in
     step, so edit distance becomes Hamming distance.
  3. LSH: each of ``ROUNDS`` independent walks is sampled at ``SAMPLES`` positions (sampled with the
     item's own walk, within the steps it needs); equal samples make a candidate pair.  The number of
     rounds follows from the target recall at the largest allowed distance.
  4. Verification: the exact edit distance of the whole item against the document around the window
     (item against any substring, banded dynamic programming).

Items come from a table of any size: they are sent to the tasks in slices of at most
``ITEM_WORDS`` words, one pass over the documents per slice.

Items with fewer than ``GRAM`` words have no runs and allow no edits: their words are looked up as they are.

Nulls and edge cases: null or empty texts match nothing, and items without a word after normalisation are in
no document; every other item is searched, without an id too, and each text where several share an id; items equal in
id and text count as one; documents that repeat give their rows again; equal distances keep the first window;
very long texts are searched whole.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensortwin.llm.common import map_rows, ship, slices

#: Word edits allowed, as a share of the item's words.
EDITS = 0.15
GRAM = 3
SAMPLES = 4
RECALL = 0.95
#: Words of benchmark items sent to a task at once (16 bytes each and tables of about 50).
ITEM_WORDS = 1_000_000
_DROP = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_U = np.uint64
_MASK = (1 << 64) - 1
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M1
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the normalised words of a text."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.lower().encode("utf-8", "surrogatepass").translate(_DROP).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the runs of n words; element i starts at word i."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        acc = _mix((acc + h[i : len(h) - n + 1 + i]) * _M1)
    return acc


def allowed(m: int, edits: float = EDITS) -> int:
    """Largest word edit distance for an item of m words.  It stays where a window within it is sure
    to share a run of ``GRAM`` words: m - GRAM + 1 - GRAM * distance >= 1."""
    return max(0, min(int(m * edits), (m - GRAM) // GRAM))


def walks(windows: np.ndarray, round_: int, steps: int) -> np.ndarray:
    """CGK walks of a (windows x words) array: the word read at each step, 0 past the end."""
    n, length = windows.shape
    at, rows = np.zeros(n, np.int64), np.arange(n)
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], 1)
    out = np.empty((n, steps), np.uint64)
    for j in range(steps):
        word = padded[rows, np.minimum(at, length)]
        out[:, j] = word
        salt = _U(((round_ << 32) + j + 1) * int(_M1) & _MASK)
        at = at + (_mix(word + salt) >> _U(63)).astype(np.int64)
    return out


def distance_in(item: np.ndarray, doc: np.ndarray, most: int) -> tuple[int, int, int]:
    """Smallest edit distance of the item to any substring of ``doc``: (distance, start, end); the
    distance is ``most`` + 1 if it is larger than ``most``."""
    m = len(item)
    cost, start = np.zeros(len(doc) + 1, np.int64), np.arange(len(doc) + 1)
    ramp = np.arange(len(doc) + 1)
    for i in range(1, m + 1):
        step = cost[:-1] + (doc != item[i - 1])  # keep or replace
        drop = cost[1:] + 1  # item word missing in the document
        best = np.concatenate([[i], np.minimum(step, drop)])
        origin = np.concatenate([[0], np.where(step <= drop, start[:-1], start[1:])])
        # extra document words: running minimum of best - position
        lead = best - ramp
        low = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == low, ramp, 0))
        cost, start = low + ramp, origin[source]
        if cost.min() > most:
            return most + 1, 0, 0
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


@dataclass
class Slice:
    """Lookup tables of a slice of the benchmark."""

    items: list  # (item id, word hashes)
    edits: float = EDITS
    groups: list = field(init=False)

    def __post_init__(self):
        self.short = [self._lookup([(i, h) for i, h in self.items if len(h) == n], n) for n in range(1, GRAM)]
        self.items = [(i, h) for i, h in self.items if len(h) >= GRAM]
        by_length: dict[int, list[int]] = {}
        for k, (_, h) in enumerate(self.items):
            # lengths of a group differ by at most a tenth
            by_length.setdefault(int(math.log(len(h)) / math.log(1.1)), []).append(k)
        self.groups = []
        for members in by_length.values():
            length = min(len(self.items[k][1]) for k in members)
            most = max(allowed(len(self.items[k][1]), self.edits) for k in members)
            heads = np.stack([self.items[k][1][:length] for k in members])
            tables = []
            for r in range(rounds(length, most)):
                place = np.random.default_rng(r).choice(2 * length, size=min(SAMPLES, 2 * length), replace=False)
                order = np.argsort(key := self._keys(heads, r, place), kind="stable")
                tables.append((place, key[order], np.array(members)[order]))
            self.groups.append((length, most, tables))
        g = [(x, k, o) for k, (_, h) in enumerate(self.items) for o, x in enumerate(grams(h).tolist())]
        gram, item, offset = (np.array(c, t) for c, t in zip(zip(*g, strict=True), (np.uint64, np.int64, np.int64), strict=True)) if g else (
            np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(gram, kind="stable")
        self.gram, self.gram_item, self.gram_offset = gram[order], item[order], offset[order]
        self.group_of = np.zeros(len(self.items), np.int64)
        for n, members in enumerate(by_length.values()):
            self.group_of[members] = n
        size = np.array([len(h) for _, h in self.items], np.int64)
        self.most = np.array([allowed(n, self.edits) for n in size.tolist()], np.int64)
        self.need = size - GRAM + 1 - GRAM * self.most  # runs that most edits leave at least
        self.filter = np.zeros(1 << 20, bool)  # a quick look before the search
        self.filter[(self.gram >> _U(44)).astype(np.int64)] = True

    @staticmethod
    def _keys(windows: np.ndarray, r: int, place: np.ndarray) -> np.ndarray:
        seen = walks(windows, r, int(place.max()) + 1)[:, place]
        key = np.full(len(windows), _U(r + 1))
        for c in range(seen.shape[1]):
            key = _mix((key + seen[:, c]) * _M1)
        return key

    @staticmethod
    def _lookup(items: list, n: int) -> tuple[int, np.ndarray, list]:
        """Items of n words by the hash of their run."""
        key = np.array([grams(h, n)[0] for _, h in items], np.uint64)
        order = np.argsort(key, kind="stable")
        return n, key[order], [items[k][0] for k in order]

    def matches(self, doc: np.ndarray) -> list[tuple[object, int, int, int, int]]:
        """(item id, distance, start word, end word, item words) of every item the document holds."""
        return self._short_matches(doc) + self._long_matches(doc)

    def _short_matches(self, doc: np.ndarray) -> list[tuple[object, int, int, int, int]]:
        out = []
        for n, keys, ids in self.short:
            if len(keys) and len(doc) >= n:
                runs, first = np.unique(grams(doc, n), return_index=True)
                at = np.searchsorted(runs, keys)
                hit = np.nonzero(runs[np.minimum(at, len(runs) - 1)] == keys)[0]
                out += [(ids[k], 0, int(first[at[k]]), int(first[at[k]]) + n, n) for k in hit.tolist()]
        return out

    def _long_matches(self, doc: np.ndarray) -> list[tuple[object, int, int, int, int]]:
        g = grams(doc)
        if not len(g) or not len(self.gram):
            return []
        at = np.nonzero(self.filter[(g >> _U(44)).astype(np.int64)])[0]
        lo, hi = np.searchsorted(self.gram, g[at], "left"), np.searchsorted(self.gram, g[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return []
        count = hi - lo
        spread = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        item = self.gram_item[spread]
        # where the item would start by each run; as items are few, one number holds both
        begin = np.repeat(at, count) - self.gram_offset[spread] + (1 << 20)
        mark = np.sort(item << 40 | begin)
        item, begin = mark >> 40, (mark & ((1 << 40) - 1)) - (1 << 20)
        near = np.searchsorted(mark, mark + 2 * self.most[item], "right") - np.arange(len(mark))
        item, begin = item[near >= self.need[item]], begin[near >= self.need[item]]
        group = self.group_of[item]
        found: dict[int, tuple[int, int, int]] = {}
        for n in np.unique(group).tolist():
            length, most, tables = self.groups[n]
            # each item has its own windows; one found without an edit needs no further walk
            of, first = item[group == n], begin[group == n]
            todo = set(of.tolist())
            tried: set[tuple[int, int]] = set()
            for r, (place, keys, members) in enumerate(tables):
                base = np.unique(first[np.isin(of, list(todo))])
                starts = np.unique((base[:, None] + np.arange(2 * most + 1)).ravel())
                starts = starts[(starts > -length) & (starts < len(doc))]
                pairs: set[tuple[int, int]] = set()
                for part in np.array_split(starts, max(1, -(-len(starts) * length // 500_000))):
                    pick = part[:, None] + np.arange(length)
                    inside = (pick >= 0) & (pick < len(doc))
                    key = self._keys(np.where(inside, doc[np.clip(pick, 0, len(doc) - 1)], _U(0)), r, place)
                    a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    for w in np.nonzero(b > a)[0].tolist():
                        pairs.update((int(k), int(part[w])) for k in members[a[w] : b[w]])
                for k, start in sorted(pairs - tried):
                    if k in todo:
                        self._verify(doc, k, start, found)
                        if k in found and not found[k][0]:
                            todo.discard(k)
                tried |= pairs
                if not todo:
                    break
        return [(self.items[k][0], *found[k], len(self.items[k][1])) for k in sorted(found)]

    def _verify(self, doc: np.ndarray, k: int, start: int, found: dict) -> None:
        """Exact distance of item k around a window; the smallest one so far stays in ``found``."""
        item, most = self.items[k][1], int(self.most[k])
        a = max(0, start - most)
        d, x, y = distance_in(item, doc[a : start + len(item) + 2 * most], most)
        if d <= most and (k not in found or (d, a + x) < found[k][:2]):
            found[k] = (d, a + x, a + y)


def rounds(length: int, most: int, recall: float = RECALL) -> int:
    """Independent walks for the target recall.  A walk meets an edit at any of about ``most`` places
    of its 2L sampled steps and leaves step with probability 1/2 for a few steps each, so a sample
    agrees with probability of about 1 - 3 * most / length or more."""
    agree = max(0.3, 1 - 3 * most / max(length, 1)) ** min(SAMPLES, 2 * length)
    return 1 if not most else max(2, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def item_slices(items: DataFrame, id_col: str, text_col: str) -> list[list]:
    """The benchmark as lists of (id, word hashes) of at most ``ITEM_WORDS`` words each (or one
    item).  Slices are numbered by Spark; one slice at a time is fetched."""
    one = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).distinct()
    # words are at least a character and a space, so characters / 2 bound them
    size = F.length("text") / 2 + 1
    total = one.agg(F.sum(size).alias("s")).first()["s"] or 0
    parts = max(1, math.ceil(total / ITEM_WORDS))
    sliced = one.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    for part in range(parts):
        yield [(r["item"], word_hashes(r["text"])) for r in sliced.where(F.col("part") == part).orderBy("item", "text").collect()]


def find(docs: DataFrame, items: DataFrame, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item it holds: ids, the word edit distance and the words it spans."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    out = None
    for part in item_slices(items, item_id_col, item_text_col):
        sent = spark.sparkContext.broadcast(Slice(part, edits))

        def run(batch, sent=sent):
            ids, rows = batch.column(0).to_pylist(), []
            for i, t in zip(ids, batch.column("text").to_pylist(), strict=True):
                rows += [(i, *m) for m in sent.value.matches(word_hashes(t))]
            if not rows:
                return None
            return dict(zip((id_col, item_id_col, "distance", "start_word", "end_word", "item_words"), zip(*rows, strict=True), strict=True))

        found = map_rows(docs.select(id_col, docs[text_col].alias("text")), run,
                         f"`{id_col}` {id_type}, `{item_id_col}` {item_type}, distance int, start_word int, end_word int, item_words int")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, edits: float = EDITS, text_col: str = "text", item_id_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """The documents, all columns, that hold no benchmark item; texts are judged in place, so no join
    is needed and rows of null or repeated ids are judged by their own text."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)
    for part in item_slices(items, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(Slice(part, edits))

        def run(batches, sent=sent):
            for batch in batches:
                for rows in slices(batch):
                    free = [not sent.value.matches(word_hashes(t)) for t in rows.column(place).to_pylist()]
                    yield rows.filter(pa.array(free, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
