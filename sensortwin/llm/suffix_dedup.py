"""Exact substring dedup with suffix arrays built by induced sorting.

Every byte that lies in a ``length``-byte string which also starts earlier (in a document of smaller
id, or earlier in the same document) is removed; strings are judged on the input.

Bringing equal strings together.  A string's anchor is the position of its smallest ``GRAM``-byte
hash (leftmost on ties), so equal strings have anchors of equal hash at equal places.  Strings of a
document that share an anchor overlap; together they are one snippet.  Equal snippets under one
anchor hash collapse: inside a map batch before the shuffle (a hot passage or a group of copies sends
one row per batch), then over all rows.  All but the first occurrence are repeated as a whole.

Suffix arrays.  Distinct snippets under a shared anchor hash may still hold equal strings: they
meet in a shard, whose concatenation gets a suffix array by induced sorting (types, leftmost-S
substrings sorted recursively, L then S suffixes induced), and permuted common prefixes (each suffix
against its predecessor in the array, taken in text order, capped at ``length``).  Runs of the array
with prefixes of at least ``length`` are the equal strings; all but the earliest are repeated.  An
anchor hash with more than ``HOT`` distinct snippets is shared out over shards by its strings
themselves, so that no task holds an unbounded group.

Nulls and edge cases: a null text counts as empty; texts shorter than ``length`` lose nothing; every
input row gives an output row; rows of equal id and text are one document (they get equal results, none
repeats the other); rows of equal id with different texts are ordered by a digest of the text; a null id
comes before all others.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensortwin.llm.common import map_rows, ship, slices, stored

LENGTH = 100
GRAM = 24
#: Bytes of snippets in one suffix array, about.
SHARD_BYTES = 512 << 10
#: Distinct snippets of one anchor hash that may share a shard.
HOT = 20_000
_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


# -- suffix array -----------------------------------------------------------------------------
def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of an array of small non-negative integers (a proper prefix sorts first)."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int64)
    is_s = _types(s)
    lms = np.nonzero(is_s[1:] & ~is_s[:-1])[0] + 1
    induce = _induce if s.max() < 4096 else _induce_plain
    order = induce(s, is_s, lms)
    order = order[np.isin(order, lms, assume_unique=True)] if len(lms) else order[:0]
    if len(lms) > 1:
        name_of = _names(s, lms, order)
        if name_of.max() + 1 < len(lms):
            order = lms[suffix_array(name_of)]
    return induce(s, is_s, order)


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than their successor); the last suffix is L."""
    n = len(s)
    step = np.empty(n, np.int64)
    step[:-1] = np.sign(s[1:] - s[:-1])
    step[-1] = -1
    # equal neighbours take the type of the next differing one
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-S substrings, in text order; equal substrings share a rank."""
    n = len(s)
    ends = np.append(lms[1:], n - 1)
    end_of = np.zeros(n, np.int64)
    end_of[lms] = ends
    a, b = order[:-1], order[1:]
    size = end_of[a] - a
    same = (size == end_of[b] - b) & (end_of[a] != n - 1) & (end_of[b] != n - 1)
    alive, off = np.nonzero(same)[0], 0
    while len(alive):
        if off >= 64:  # the few long ones as a whole
            for i in alive:
                same[i] = np.array_equal(s[a[i] : a[i] + size[i] + 1], s[b[i] : b[i] + size[i] + 1])
            break
        equal = s[a[alive] + off] == s[b[alive] + off]
        same[alive[~equal]] = False
        alive = alive[equal & (size[alive] > off)]
        off += 1
    rank = np.zeros(n, np.int64)
    rank[order] = np.r_[0, np.cumsum(~same)]
    return rank[lms]


def _buckets(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.bincount(s))
    return np.r_[0, ends[:-1]], ends


def _spread(sa: np.ndarray, where: np.ndarray, chars: np.ndarray, items: np.ndarray, step: int) -> None:
    """Put items at the moving borders of their characters' buckets, in order."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.r_[True, c[1:] != c[:-1]]
    at = np.arange(len(c))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    sa[where[c] + step * nth] = items[order]
    values, counts = c[first], np.diff(np.r_[np.nonzero(first)[0], len(c)])
    where[values] += step * counts


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix order from the order of the leftmost-S suffixes.  A bucket's suffixes are taken a
    batch at a time: batches only grow by runs of the bucket's own character."""
    n = len(s)
    starts, ends = _buckets(s)
    used = np.nonzero(ends > starts)[0]
    sa = np.full(n, -1)
    # leftmost-S suffixes at the ends of their buckets, last one first
    tail = ends - 1
    if len(lms):
        _spread(sa, tail, s[lms][::-1], lms[::-1], -1)
    s_from = tail + 1
    head = starts.copy()
    sa[head[s[n - 1]]] = n - 1
    head[s[n - 1]] += 1
    for c in used:
        done = starts[c]
        while done < head[c]:
            done, batch = head[c], sa[done : head[c]] - 1
            batch = batch[batch >= 0]
            batch = batch[~is_s[batch]]
            if len(batch):
                _spread(sa, head, s[batch], batch, 1)
        batch = sa[s_from[c] : ends[c]] - 1
        if len(batch):
            _spread(sa, head, s[batch], batch, 1)
    # S suffixes from the right; the leftmost-S ones are placed anew
    tail = ends - 1
    for c in used[::-1]:
        done = ends[c] - 1
        while done > tail[c]:
            batch, done = sa[tail[c] + 1 : done + 1][::-1] - 1, tail[c]
            batch = batch[batch >= 0]
            batch = batch[is_s[batch]]
            if len(batch):
                _spread(sa, tail, s[batch], batch, -1)
        batch = sa[starts[c] : head[c]][::-1] - 1
        batch = batch[batch >= 0]
        batch = batch[is_s[batch]]
        if len(batch):
            _spread(sa, tail, s[batch], batch, -1)
    return sa


def _induce_plain(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same, one suffix at a time, for alphabets almost as large as the text."""
    starts, ends = (x.tolist() for x in _buckets(s))
    n = len(s)
    # the letter of an L (S) suffix, -1 for the other kind; the last place stands for "before the text"
    as_l = np.append(np.where(is_s, -1, s), -1).tolist()
    as_s = np.append(np.where(is_s, s, -1), -1).tolist()
    sa, tail = [0] * n, [e - 1 for e in ends]
    for i, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist(), strict=True):
        sa[tail[c]] = i
        tail[c] -= 1
    head, last = starts[:], int(s[n - 1])
    sa[head[last]] = n - 1
    head[last] += 1
    for i in sa:  # entries are filled in ahead of the loop
        c = as_l[i - 1]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    tail = [e - 1 for e in ends]
    for i in reversed(sa):
        c = as_s[i - 1]
        if c >= 0:
            sa[tail[c]] = i - 1
            tail[c] -= 1
    return np.array(sa)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position in text order the common prefix with its predecessor in the suffix array,
    up to ``most``; 0 for the first suffix.  Eight bytes are compared at a time."""
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.r_[s.astype(np.uint8), np.zeros(most + 16, np.uint8)]
    word = np.lib.stride_tricks.as_strided(padded, (n + most + 8, 8), (1, 1))
    out = np.zeros(n, np.int64)
    alive = np.nonzero(before >= 0)[0]
    off = 0
    while len(alive) and off < most:
        equal = word[alive + off] == word[before[alive] + off]
        run = np.where(equal.all(1), 8, np.argmin(equal, 1))
        out[alive] += run
        alive = alive[run == 8]
        off += 8
    return np.minimum(np.minimum(out, n - np.arange(n)), np.minimum(most, np.where(before >= 0, n - before, 0)))


def repeated_starts(snippets: list[bytes], order: np.ndarray, counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For every snippet the starts (of its first ``counts`` ones) of strings that another snippet of
    smaller ``order`` holds, by suffix array and permuted common prefixes."""
    text = np.frombuffer(b"".join(snippets), np.uint8)
    offset = np.r_[0, np.cumsum([len(x) for x in snippets])]
    sa = suffix_array(text)
    prefix = common_prefixes(text, sa, length)
    owner = np.repeat(np.arange(len(snippets)), np.diff(offset))
    own = np.arange(len(text)) - offset[owner] < counts[owner]
    group = np.cumsum(prefix[sa] < length)  # runs of equal strings in the array
    keep = own[sa]
    at, group = sa[keep], group[keep]
    mine = order[owner[at]]
    least = np.full(group.max() + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, mine)
    late = np.sort(at[mine > least[group]])
    cut = np.searchsorted(late, offset)
    return [late[a:b] - o for a, b, o in zip(cut[:-1], cut[1:], offset, strict=False)]


# -- anchors ----------------------------------------------------------------------------------
def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` = 16 + 8 bytes from each position, by doubling."""
    h = (raw.astype(np.uint64) + _U(1)) * _M1
    h ^= h >> _U(29)
    width = 1
    eight = None
    while width < 16:
        h = h[:-width] * _M2 + h[width:]
        h ^= h >> _U(31)
        width *= 2
        if width == 8:
            eight = h
    n = len(raw) - GRAM + 1
    out = (h[:n] * _M1 + eight[16 : 16 + n]) * _M2
    return out ^ (out >> _U(32))


_POS = 26  # low bits that hold a position
_PIECE = 8 << 20  # bytes looked at together; longer texts go on with the same strings


def anchors(raw: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first string start, number of strings) of the snippets of a text."""
    for begin in range(0, max(0, len(raw) - length + 1), _PIECE):
        piece = raw[begin : begin + _PIECE + length - 1]
        h = _gram_hashes(piece)
        key = (h >> _U(_POS) << _U(_POS)) | np.arange(len(h), dtype=np.uint64)
        low, width, window = key, 1, length - GRAM + 1
        while width * 2 <= window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
        place = (low & _U((1 << _POS) - 1)).astype(np.int64)
        first = np.nonzero(np.r_[True, place[1:] != place[:-1]])[0]
        yield h[place[first]], first + begin, np.diff(np.r_[first, len(place)])


def spans(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals; touching ones are joined."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _unions(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of intervals, by document; they come in the order of document and start, touching ones are joined."""
    if not len(doc):
        return doc, start, end
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * step)  # no interval reaches into the next document
    first = np.r_[True, start[1:] + doc[1:] * step > reach[:-1]]
    last = np.r_[np.flatnonzero(first)[1:] - 1, len(doc) - 1]
    return doc[first], start[first], reach[last] - doc[first] * step


# -- the operator -----------------------------------------------------------------------------
_OCCURRENCE = "h long, s long, doc struct<id:{t},d:long>, start long, n int, whole boolean"


def _occurrences(docs: DataFrame, length: int, id_type: str) -> DataFrame:
    """Snippets of all documents: anchor hash, snippet hash, document, first start, strings.  Of equal
    snippets in a batch the first stays; the others are ``whole``: repeated in full."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = _OCCURRENCE.format(t=id_type)
    schema = to_arrow_schema(T._parse_datatype_string(ddl))

    doc_type = schema.field("doc").type
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = {}
                for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    data = (t or "").encode("utf-8", "surrogatepass")
                    if len(data) >= length:
                        texts[(i is not None, i, digest64(data))] = data  # rows of equal id and text are one
                names = sorted(texts, key=lambda x: (x[0], x[1] if x[0] else 0, x[2]))
                found = []  # of each document in order: hashes of anchors and snippets, document, starts, numbers of strings
                for k, name in enumerate(names):
                    data = texts[name]
                    for h, start, n in anchors(np.frombuffer(data, np.uint8), length):
                        ends = start + n + (length - 1)
                        own = np.fromiter([digest(data[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)], np.uint64, len(start))
                        found.append((h, own, np.full(len(start), k), start, n))
                if not found:
                    continue
                h, own, doc, start, n = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((own, h))  # stable: of equal snippets the earliest comes first
                new = np.r_[True, (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])]
                keep, again = np.sort(order[new]), np.sort(order[~new])
                w_doc, w_start, w_end = _unions(doc[again], start[again], start[again] + n[again] + (length - 1))
                # a key of their own spreads these rows; n is the number of strings again
                w_key = np.fromiter([digest(f"{names[k][1]} {names[k][2]} {a}") for k, a in zip(w_doc.tolist(), w_start.tolist(), strict=True)],
                                    np.uint64, len(w_doc))
                top = _U(1 << 63)
                cols = [np.r_[h[keep], w_key - top].view(np.int64), np.r_[own[keep] - top, np.zeros(len(w_doc), np.uint64)].view(np.int64),
                        np.r_[doc[keep], w_doc], np.r_[start[keep], w_start], np.r_[n[keep], w_end - w_start - length + 1],
                        np.r_[np.zeros(len(keep), bool), np.ones(len(w_doc), bool)]]
                ids, digests = pa.array([x[1] for x in names], doc_type.field(0).type), pa.array([x[2] for x in names], pa.int64())
                for at in range(0, len(cols[0]), 100_000):
                    x, y, k, a, m, whole = (c[at : at + 100_000] for c in cols)
                    place = pa.array(k)
                    struct = pa.StructArray.from_arrays([ids.take(place), digests.take(place)], fields=list(doc_type))
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), struct, pa.array(a, pa.int64()), pa.array(m.astype(np.int32)), pa.array(whole)],
                                                     schema=schema)

    return docs.mapInArrow(run, ddl)


def digest64(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _shard(length: int, schema: pa.Schema):
    """Repeated strings among the snippets of one shard, as intervals."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, starts = table.column("doc").combine_chunks(), table.column("start").to_numpy()
        counts = table.column("n").to_numpy().astype(np.int64)
        place = pa.table({"id": doc.field("id"), "d": doc.field("d"), "start": table.column("start")})
        by = pc.sort_indices(place, sort_keys=[(c, "ascending") for c in place.column_names], null_placement="at_start")
        order = np.empty(len(starts), np.int64)
        order[by.to_numpy()] = np.arange(len(starts))
        got = repeated_starts(table.column("bytes").to_pylist(), order, counts, length)
        rows = [(k, a, b) for k, late in enumerate(got) if len(late) for a, b in _runs(late + starts[k], length)]
        k, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.Table.from_arrays([doc.take(pa.array(k, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _runs(at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of the strings that start at the sorted places ``at``."""
    cut = np.nonzero(np.diff(at) > length)[0]
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + length).tolist(), strict=True))


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, start, end): byte intervals that repeat earlier text; they may overlap."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    interval = f"doc struct<id:{id_type},d:long>, start long, `end` long"
    arrow = to_arrow_schema(T._parse_datatype_string(interval))
    first = Window.partitionBy("h", "s").orderBy(F.col("doc.id").asc_nulls_first(), "doc.d", "start")
    found = _occurrences(docs, length, id_type).repartition("h").withColumn("nth", F.row_number().over(first))
    classes = F.sum(F.when((F.col("nth") == 1) & ~F.col("whole"), 1).otherwise(0)).over(Window.partitionBy("h"))
    found = stored(found.withColumn("classes", classes).where("whole or nth > 1 or classes > 1").withColumn(
        "whole", F.col("whole") | (F.col("nth") > 1)).drop("nth"), "suffix-snippets")
    whole = found.where("whole").select("doc", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end"))

    # bytes of the distinct snippets: each document is read once for all of its own
    wanted = found.where("not whole").groupBy("doc").agg(F.collect_list(F.struct("h", "start", "n", "classes")).alias("want"))
    row = f"h long, doc struct<id:{id_type},d:long>, start long, n int, classes long, bytes binary"

    def cut(batch):
        out = {"h": [], "doc": [], "start": [], "n": [], "classes": [], "bytes": []}
        for doc, packed, want in zip(*(batch.column(c).to_pylist() for c in ("doc", "packed", "want")), strict=True):
            data = unpack(packed)
            for w in want:
                out["bytes"].append(data[w["start"] : w["start"] + w["n"] + length - 1])
                out["doc"].append(doc)
                for c in ("h", "start", "n", "classes"):
                    out[c].append(w[c])
        return out

    texts = _packed(docs, id_type)
    key = [F.col("doc.id").eqNullSafe(F.col("tid")), F.col("doc.d") == F.col("td")]
    pieces = map_rows(wanted.join(texts, key).select("doc", "packed", "want"), cut, row)
    pieces = stored(pieces.where(f"classes <= {HOT}").unionByName(_strings(pieces.where(f"classes > {HOT}"), length)), "suffix-pieces")
    total = pieces.agg(F.sum(F.length("bytes")).alias("b")).first()["b"] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    late = pieces.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).select("shard", "doc", "start", "n", "bytes").groupBy(
        "shard").applyInArrow(_shard(length, arrow), interval)
    return stored(whole.unionByName(late), "suffix-intervals")


def _strings(pieces: DataFrame, length: int) -> DataFrame:
    """Single strings of the snippets, each under its own hash: for anchor hashes so common that
    their snippets don't fit a shard.  Of equal strings the earliest and, for every other one, a
    pair of rows would do; equal ones meet in a shard of at most that many, single ones are dropped."""
    schema = "h long, doc " + pieces.schema["doc"].dataType.simpleString() + ", start long, n int, classes long, bytes binary"

    def run(batch):
        out = {"h": [], "doc": [], "start": [], "n": [], "classes": [], "bytes": []}
        for doc, start, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "start", "n", "bytes")), strict=True):
            for k in range(n):
                one = data[k : k + length]
                out["h"].append(digest64(one))
                out["doc"].append(doc)
                out["start"].append(start + k)
                out["n"].append(1)
                out["classes"].append(1)
                out["bytes"].append(one)
        return out

    rows = map_rows(pieces, run, schema)
    # neighbours in the order of an equal string suffice: each row with the one before it
    order = Window.partitionBy("bytes").orderBy(F.col("doc.id").asc_nulls_first(), "doc.d", "start")
    before = F.lag(F.struct("doc", "start")).over(order)
    pair = rows.withColumn("before", before).where("before is not null").withColumn("h", F.xxhash64("doc", "start", "bytes"))
    return pair.drop("before").unionByName(pair.select("h", F.col("before.doc").alias("doc"), F.col("before.start").alias("start"), "n", "classes", "bytes"))


def _packed(docs: DataFrame, id_type: str) -> DataFrame:
    """(tid, td, packed): texts compressed before they are shuffled."""
    import zstandard

    def run(batch):
        data = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        z = zstandard.ZstdCompressor(level=3)
        return {"tid": batch.column("id"), "td": [digest64(x) for x in data], "packed": [z.compress(x) for x in data]}

    return map_rows(docs, run, f"tid {id_type}, td long, packed binary")


def unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, the removed runs as ``removed`` (start, end in bytes) and
    ``kept``, the remaining bytes."""
    found = repeats(docs, length, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    texts = _packed(docs, id_type)
    joined = texts.join(found, [F.col("tid").eqNullSafe(F.col("doc.id")), F.col("td") == F.col("doc.d")], "left")

    def run(batch):
        out = {id_col: batch.column("tid"), "n_bytes": [], "removed": [], "kept": []}
        for packed, got in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = unpack(packed)
            cut = spans([(x["start"], x["end"]) for x in got or ()])
            edges = [0, *(e for ab in cut for e in ab), len(data)]
            out["n_bytes"].append(len(data))
            out["removed"].append([{"start": a, "end": b} for a, b in cut])
            out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return out

    return map_rows(joined.select("tid", "packed", "spans"), run,
                    f"`{id_col}` {id_type}, n_bytes long, removed array<struct<start:long,`end`:long>>, kept binary")


def digest(result: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Byte counts, number of removed runs and SHA-256 of what stays, from :func:`dedup`'s rows."""
    return result.select(id_col, "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                         F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
