"""N-gram Jaccard self-join by parity sketches.

A document's set is its distinct word shingles as 64-bit hashes.  Every shingle flips one bit of a
sketch, so the Hamming distance of two sketches never exceeds the symmetric difference of the sets.
Two sets of a and b shingles with Jaccard similarity of at least t differ in at most
d = (a + b)(1 - t)/(1 + t) shingles.  Sizes are cut into bands whose sets have partners in their own
or the next band only, and take part in both.  A band's sketch has d + 1 words of 2^32 bits (held
sparsely), and some to spare; each shingle falls into one word, so d differing shingles touch d words
at most and linked sets share the others (pigeonhole).  (band, word number, word) is the join key.

Unrelated sets share empty words by chance.  With fewer empty words than spare ones a set must share
a word with bits with every partner, so empty ones are no keys.  A set with more of them takes part in
a further sketch as well, and in the last one with all its words too; two such sets meet there.  (Sets so
small that d is 0 link with equal sets only.)

A set of the band's size differs from its partners in fewer than d shingles mostly, so it shares several
words with each of them: ``need``, at least one.  Keys are put in one order, the rarest first; the first key that
two linked sets share is followed by ``need`` - 1 shared ones at least.  So the last ``need`` - 1 keys that a set has in
common with any other do not count, and sets that meet others in fewer words than they need (a few frequent
word sequences) meet nobody.

Nothing emits all pairs of a key.  Every node is paired with the key's smallest node only (a star).  Then
  1. star pairs are verified exactly on the sets, and the links found give components;
  2. linked sets of which no star pair shows the link still share a key, hence a chain of star pairs.
     Components that failed star pairs connect form groups.  The sketches of *different* components are compared
     among the sets of a group or, where that takes fewer comparisons, among those of each key of the group, in tasks of
     two bounded chunks.  Sets that near sketches connect are then compared exactly in such tasks, and only links that
     join two components leave the task.  Sets that one component already holds are never compared with each other again.
Sets move for pairs whose sketches (``WIDTH`` bits) are near enough only, and intermediate tables go once
the components are known.
This finds the exact components; no cap, sample or prefix is involved.

A set is a node of the graph, named by a 64-bit hash of its shingles that is proven to name one set only
(else all are named with another seed).  Ids come in at the end, as the smallest id of a component, so
rows that share an id, or have none, each link by their own text.

Nulls and edge cases: null or empty texts and texts without words have an empty set, link with
nothing and are their own component.  Fewer words than a shingle: the whole sequence is one
shingle.  Every input row (repeated rows too) gives an output row; where rows of different sets share an
id, each has the component of its own set.  A component of rows without any id is null.  Very long texts are
one set like all others.  Only the id and the text are read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensortwin.llm.common import Scratch, components, join_path, map_rows, open_store, ship, slices, stored, write_once
from sensortwin.session import scratch_path

#: Words of a sketch beyond the largest difference, as a share of it: so many empty words do no harm.
SPARE = 0.1
#: Sketches a set with too many empty words takes part in before its empty words become keys as well.
SKETCHES = 4
#: Low bits of a key that tell the band and sketch.
PART = 0xFFF
#: Sets of a group, and their shingles, that one task compares with as many others.
CHUNK = 1024
CHUNK_SHINGLES = 1_000_000
#: Bits of the sketch that sorts out pairs before their sets are sent.
WIDTH = 2048
#: Comparisons of sketches that cost as much as sending one.
ROW_COST = 100
#: Comparisons of two chunks for each task that makes them, and the most tasks.
CHUNK_PAIRS, MOST_TASKS = 4, 10_000
#: Ids (8 bytes each) up to which the documents whose sets are compared are picked by a broadcast.
BROADCAST_IDS = 2_000_000
#: Parts over which the rows of one set are spread when they learn their component.
SALT = 8
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads bits."""
    x = (x ^ (x >> _U(30))) * _M2
    x = (x ^ (x >> _U(27))) * _M3
    return x ^ (x >> _U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text (A-Z lower-cased, words
    divided by ASCII white space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < n:
        acc = np.full(1, len(h), np.uint64) * _M1
        for x in h[:, None]:
            acc = mix((acc + x) * _M1)
        return acc
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        acc = mix((acc + h[i : len(h) - n + 1 + i]) * _M1)
    return np.unique(acc)


def _marked(keys: np.ndarray, band: int, sketch: int) -> np.ndarray:
    """Distinct keys with the band and sketch in their low bits."""
    return np.unique(keys & ~_U(PART) | _U((band * (SKETCHES + 1) + sketch) & PART))


def set_name(s: np.ndarray, seed: int = 0) -> tuple[int, int] | tuple[None, None]:
    """The node of a set and a second hash that tells two sets of one node apart; none for an empty one."""
    if not len(s):
        return None, None
    raw = hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


class Bands:
    """Size bands and their sketches for a similarity threshold."""

    def __init__(self, similarity: Fraction):
        if not 0 < similarity < 1:
            raise ValueError("similarity must lie between 0 and 1")
        self.t = similarity
        self.c = (1 - similarity) / (1 + similarity)
        self.borders = [1]  # smallest size of each band; partners lie in the same or the next one

    def border(self, b: int) -> int:
        while len(self.borders) <= b:
            self.borders.append(max(self.borders[-1] + 1, math.ceil(self.borders[-1] / self.t)))
        return self.borders[b]

    def band(self, size: int) -> int:
        self.border(0)
        while self.borders[-1] <= size:
            self.border(len(self.borders))
        return bisect.bisect_right(self.borders, size) - 1

    def of(self, size: int) -> list[int]:
        """The set's own band and the next one, where a partner could be there."""
        b = self.band(size)
        return [b, b + 1] if self.border(b + 1) * self.t <= size else [b]

    def apart(self, b: int) -> int:
        """Differing shingles of a linked pair at most whose larger set lies in band b."""
        return int(2 * (self.border(b + 1) - 1) * self.c)

    def differ(self, size: int, b: int) -> int:
        """Differing shingles at most of a set and a partner, if the larger one lies in band b."""
        return int((size + min(self.border(b + 1) - 1, int(size / self.t))) * self.c)

    def sketches(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each sketch of a set the keys that it shares with every partner at least, and its distinct join keys:
        hashes of (band, sketch, word number, bits set in the word), in the low bits the band and sketch."""
        for b in self.of(len(s)):
            most = self.apart(b)
            if not most:
                continue  # only equal sets link, and they are one node already
            spare = 1 + math.ceil(SPARE * most)
            words, apart = most + spare, self.differ(len(s), b)
            for again in range(SKETCHES):
                x = mix(s ^ _U((b << 8) + again + 1))
                at = np.sort(((x >> _U(32)) % _U(words)) << _U(32) | x & _U(0xFFFFFFFF))
                # a bit is set if an odd number of shingles flips it
                first = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0]
                odd = np.diff(np.r_[first, len(at)]) & 1 == 1
                at = at[first[odd]]
                number, begin = np.unique(at >> _U(32), return_index=True)
                acc = np.add.reduceat(mix(at * _M1 + _U(b << 8 | again)), begin) if len(at) else at
                keys = _marked(acc, b, again)
                yield max(1, len(keys) - apart), keys
                if words - len(keys) < spare:
                    break
            else:  # empty words count too
                full = np.zeros(words, np.uint64)
                full[number.astype(np.int64)] = acc
                keys = _marked(mix(full + np.arange(words, dtype=np.uint64) * _M2 + _U(b)), b, SKETCHES)
                yield max(1, len(keys) - apart), keys

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Join keys of a set."""
        out = [keys for _, keys in self.sketches(s)]
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        return self.enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b))

    def enough(self, both: int, a: int, b: int) -> bool:
        return both * self.t.denominator >= self.t.numerator * (a + b - both)


def _describe(docs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(id, n_shingles, node, mark) of every row, with its other columns but the text, and the seed of the names."""
    seed = 0
    rest = [c for c in docs.columns if c not in ("id", "text")]
    while True:
        def run(batch, seed=seed):
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            node, mark = zip(*[set_name(s, seed) for s in sets], strict=True)
            return {"id": batch.column("id"), "n_shingles": [len(s) for s in sets], "node": node, "mark": mark, **{c: batch.column(c) for c in rest}}

        rows = stored(map_rows(docs, run, "id long, n_shingles long, node long, mark long" + "".join(f", {c} long" for c in rest)), "ngram-rows")
        two = rows.where("node is not null").groupBy("node").agg(F.min("mark").alias("a"), F.max("mark").alias("z")).where("a != z")
        if two.isEmpty():
            return rows, seed
        seed += 1


def _key_rows(docs: DataFrame, n: int, bands: Bands, seed: int) -> DataFrame:
    """(key, node, need): nodes under their sketch keys, with the keys of that sketch that they share with every partner."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("need", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                seen: set[int] = set()
                keys, nodes, needs = [], [], []
                for t in part.column("text").to_pylist():
                    s = shingles(t, n)
                    i, _ = set_name(s, seed)
                    if i is None or i in seen:
                        continue  # an equal set of this batch has the keys already
                    seen.add(i)
                    for need, k in bands.sketches(s):
                        keys.append(k)
                        nodes.append(np.full(len(k), i, np.int64))
                        needs.append(np.full(len(k), need, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)),
                                                      pa.array(np.concatenate(needs))], schema=schema)

    return docs.select("text").mapInArrow(run, "key long, node long, need long")


def _meeting(docs: DataFrame, n: int, bands: Bands, seed: int, held: Scratch) -> DataFrame:
    """(key, node, lead): nodes under the keys that count, where two nodes or more meet, and the smallest of them."""
    key = Window.partitionBy("key")
    both = held.stored(_key_rows(docs, n, bands, seed).withColumn("a", F.min("node").over(key)).withColumn("z", F.max("node").over(key)).withColumn(
        "often", F.count("*").over(key)).where("a != z").select("key", "node", "need", "often"), "ngram-shared")
    # a node's most frequent keys of a sketch, one fewer than it shares with any partner, do not count.  Rows that come
    # twice have one rank
    hottest = F.dense_rank().over(Window.partitionBy("node", F.col("key").bitwiseAND(F.lit(PART))).orderBy(F.desc("often"), F.desc("key")))
    rows = both.withColumn("hottest", hottest).where("hottest >= need").select("key", "node").distinct()
    return held.stored(rows.withColumn("lead", F.min("node").over(key)).withColumn("z", F.max("node").over(key)).where("lead != z").drop("z"), "ngram-keys")


def parity(s: np.ndarray) -> np.ndarray:
    """The set's sketch in ``WIDTH`` bits: two of them differ in no more bits than their sets in shingles."""
    x = mix(s) & _U(WIDTH - 1)
    return np.packbits((np.bincount(x.astype(np.int64), minlength=WIDTH) & 1).astype(np.uint8)).view(np.int64)


def _of_nodes(docs: DataFrame, names: DataFrame, wanted: DataFrame, n: int, seed: int, held: Scratch, column: str, value) -> DataFrame:
    """(node, ``value`` of its set) of the wanted nodes, written once.  The documents are picked by the id that names
    each node; those without an id are all looked at."""

    def run(batch):
        out: dict[int, np.ndarray] = {}
        for t in batch.column("text").to_pylist():
            s = shingles(t, n)
            if len(s) and (node := set_name(s, seed)[0]) not in out:
                out[node] = value(s)
        return {"node": list(out), column: list(out.values())} if out else None

    wanted = held.stored(wanted.distinct(), "ngram-asked")
    ids = held.stored(names.join(wanted, "node").where("id is not null").select("id").distinct(), "ngram-wanted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    picked = docs.join(ids, "id", "left_semi").select("text").union(docs.where("id is null").select("text"))
    rows = map_rows(picked, run, f"node long, {column} array<long>").join(wanted, "node", "left_semi")
    return held.stored(rows.dropDuplicates(["node"]), f"ngram-{column}")


def _sets(docs: DataFrame, names: DataFrame, wanted: DataFrame, n: int, seed: int, held: Scratch) -> DataFrame:
    return _of_nodes(docs, names, wanted, n, seed, held, "set", lambda s: s.view(np.int64))


def _read_chunk(fs, root: str, chunk: int, column: str) -> pa.Table:
    """(node, label, m, value) of one chunk."""
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(join_path(root, f"chunk={chunk}"))) if f.base_name.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read(["node", "label", "m", column]) for f in sorted(files)])


def _compare(check, folder: str, column: str):
    """What ``check`` finds among the rows of two chunks, which the task reads from ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                one = _read_chunk(fs, root, a, column)
                two = one.slice(0, 0) if a == b else _read_chunk(fs, root, b, column)
                yield from check(pa.concat_tables([one, two]), np.r_[np.full(len(one), 2 if a == b else 0), np.ones(len(two), np.int64)]).to_batches()

    return run


def _partners(side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with those it is compared with.  ``side``: 2 for a group or chunk compared with itself, else 0 and 1
    for the two chunks."""
    right = np.nonzero(side == 1)[0]
    for i in np.nonzero(side != 1)[0]:
        others = np.arange(i + 1, len(side)) if side[i] == 2 else right
        if len(others):
            yield i, others


def _likely(bands: Bands):
    """Pairs of nodes of different components with sketches near enough; of all such pairs as many as connect the same nodes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    far, all_ = bands.t.denominator - bands.t.numerator, bands.t.denominator + bands.t.numerator

    def run(table: pa.Table, side: np.ndarray) -> pa.Table:
        node, label, size = (table.column(c).to_numpy() for c in ("node", "label", "m"))
        words = table.column("bits").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(table), WIDTH // 64)
        tied = np.arange(len(table))  # rows that the pairs found so far connect
        found = []
        for i, others in _partners(side):
            others = others[(label[others] != label[i]) & (tied[others] != tied[i])]
            near = others[np.bitwise_count(words[others] ^ words[i]).sum(1, dtype=np.int64) * all_ <= (size[others] + size[i]) * far]
            for j in near:
                if tied[j] != tied[i]:
                    tied[tied == tied[j]] = tied[i]
                    found.append((node[i], node[j]))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _linker(bands: Bands):
    """Links between different components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    c, t = float(bands.c), float(bands.t)

    def run(table: pa.Table, side: np.ndarray) -> pa.Table:
        label = table.column("label").to_pylist()
        lists = table.column("set").combine_chunks()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])
        sets = [flat[x:y] for x, y in zip(ends, ends[1:], strict=False)]
        size = np.array([len(s) for s in sets])
        words = np.array([parity(s.view(np.uint64)) for s in sets]).view(np.uint64)
        up = {x: x for x in label}

        def find(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        links = []
        for i, others in _partners(side):
            least, most = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
            others = others[least * bands.t.denominator >= bands.t.numerator * most]
            apart = np.bitwise_count(words[others] ^ words[i]).sum(1, dtype=np.int64)
            order = np.argsort(apart, kind="stable")
            for j, d in zip(others[order], apart[order], strict=True):
                if d > c * (size[i] + size[j]) + 1e-9:
                    if d > c * size[i] * (1 + 1 / t):
                        break  # too far for a partner of any size
                    continue
                a, b = find(label[i]), find(label[j])
                if a != b and bands.linked(sets[i], sets[j]):
                    up[max(a, b)] = min(a, b)
                    links.append((label[i], label[j]))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def join(docs: DataFrame, n: int = 5, similarity: float | Fraction = Fraction(8, 10),
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id reachable over
    links between sets of ``n``-word shingles with Jaccard similarity of at least ``similarity``."""
    ship(docs.sparkSession)
    bands = Bands(Fraction(similarity).limit_denominator(1000))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows, seed = _describe(docs, n)
    of_node = _components(docs, rows, n, bands, seed)
    spread = of_node.select("node", "component_id", F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt"))
    known = rows.where("node is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    found = known.join(spread, ["node", "salt"]).select(F.col("id").alias(id_col), "n_shingles", "component_id")
    return found.union(rows.where("node is null").select(F.col("id").alias(id_col), "n_shingles", F.col("id").alias("component_id")))


def _components(docs: DataFrame, rows: DataFrame, n: int, bands: Bands, seed: int) -> DataFrame:
    """(node, root, component_id) of every node: the component's own name and its smallest id."""
    held = Scratch(docs.sparkSession)
    names = held.stored(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.max("n_shingles").alias("m")), "ngram-names")

    # star pairs of sketch keys, between nodes
    keyed = _meeting(docs, n, bands, seed, held)
    star = held.stored(keyed.where("node != lead").select(F.col("node").alias("x"), F.col("lead").alias("y")).distinct(), "ngram-star")

    # 1. exact check of the star pairs.  Sizes alone rule out some, sketches nearly all others that fail: only the sets
    # of pairs that may be linked are sent
    nodes = held.stored(star.select(F.col("x").alias("node")).union(star.select(F.col("y").alias("node"))).distinct(), "ngram-nodes")
    bits = _of_nodes(docs, names, nodes, n, seed, held, "bits", parity)
    t = bands.t
    sized = star.join(names.select(F.col("node").alias("x"), F.col("m").alias("mx")), "x").join(names.select(F.col("node").alias("y"), F.col("m").alias("my")), "y")
    near = F.least("mx", "my") * t.denominator >= F.greatest("mx", "my") * t.numerator
    sized = held.stored(sized.withColumn("near", near), "ngram-sizes")
    apart = F.aggregate(F.zip_with("bx", "by", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, one: total + one)
    near = apart * (t.denominator + t.numerator) <= (F.col("mx") + F.col("my")) * (t.denominator - t.numerator)
    close = (sized.where("near").join(bits.select(F.col("node").alias("x"), F.col("bits").alias("bx")), "x")
             .join(bits.select(F.col("node").alias("y"), F.col("bits").alias("by")), "y").select("x", "y", near.alias("near")))
    close = held.stored(close.union(sized.where("not near").select("x", "y", "near")), "ngram-close")
    maybe = close.where("near")
    sets = _sets(docs, names, maybe.select(F.col("x").alias("node")).union(maybe.select(F.col("y").alias("node"))), n, seed, held)
    both = F.size(F.array_intersect("s", "r"))
    verified = (maybe.join(sets.select(F.col("node").alias("x"), F.col("set").alias("s")), "x")
                .join(sets.select(F.col("node").alias("y"), F.col("set").alias("r")), "y")
                .select("x", "y", (both * t.denominator >= t.numerator * (F.size("s") + F.size("r") - both)).alias("linked")))
    checked = held.stored(verified.union(close.where("not near").select("x", "y", F.lit(False).alias("linked"))), "ngram-checked")
    label = held.stored(components(checked.where("linked"), "x", "y"), "ngram-label")

    # 2. components that failed pairs connect
    failed = checked.where("not linked").select("x", "y")
    for side in ("x", "y"):
        failed = failed.join(label.select(F.col("node").alias(side), "root"), side, "left").withColumn(
            side, F.coalesce("root", side)).drop("root")
    failed = held.stored(failed.where("x != y").distinct(), "ngram-failed")
    if not failed.isEmpty():
        member = _grouped(names.join(nodes, "node", "left_semi"), label, failed, bands, held)
        # sketches tell which members may have a link to another component; only the sets of those are compared, with
        # those that near sketches connect them to
        near = _inside(_by_key(member, keyed, held), bits, "bits", F.lit(WIDTH // 64), _likely(bands), "a long, b long", held)
        near = components(near).select("node", F.col("root").alias("g"))
        member = held.stored(member.drop("g").join(near, "node").select("g", "node", "label", "m", "z"), "ngram-likely")
        sets = _sets(docs, names, member.select("node"), n, seed, held)
        links = _inside(member, sets, "set", F.col("m"), _linker(bands), "a long, b long", held)
        label = held.stored(_merged(label, links), "ngram-closed")
    rooted = names.join(label, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    found = stored(rooted.join(least, "root").select("node", "root", "component_id"), "ngram-components")
    held.clear()
    return found


def _grouped(nodes: DataFrame, label: DataFrame, failed: DataFrame, bands: Bands, held: Scratch) -> DataFrame:
    """(g, node, label, m, z) of the nodes in groups of components that failed star pairs connect."""
    group = held.stored(components(failed, "x", "y").select(F.col("node").alias("label"), F.col("root").alias("g")), "ngram-groups")
    member = nodes.join(label.select("node", "root"), "node", "left").select("node", "m", F.coalesce("root", "node").alias("label")).join(group, "label")
    # linked sets lie in the same size cell or in neighbouring ones (cells grow by 1/t)
    cell = F.floor(F.log("m") / math.log(1 / bands.t) + 1e-9).cast("int")
    return held.stored(member.select("g", "node", "label", "m", cell.alias("z")), "ngram-sized")


def _by_key(member: DataFrame, keyed: DataFrame, held: Scratch) -> DataFrame:
    """The members, in groups of those that share a key where this takes fewer comparisons than those of the whole group:
    linked sets share one."""
    shared = held.stored(keyed.select("key", "node").join(member, "node"), "ngram-by-key")
    mixed = shared.groupBy("g", "key").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a != b")
    # half the square of a key; of a group half that of each size, and the next size.  A row more costs as much as some comparisons
    by_key = mixed.groupBy("g").agg(F.sum(F.col("n") * (F.col("n") / 2 + ROW_COST)).alias("keyed"))
    whole = member.groupBy("g", "z").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum(F.col("n") * F.col("n") * 1.5 + F.col("n") * ROW_COST).alias("whole"))
    cut = held.stored(whole.join(by_key, "g", "left").select("g", F.coalesce(F.col("keyed") < F.col("whole"), F.lit(True)).alias("cut")), "ngram-cut")
    apart = shared.join(mixed.select("g", "key"), ["g", "key"]).join(cut.where("cut"), "g").select(
        F.xxhash64("g", "key").alias("g"), "node", "label", "m", "z").distinct()
    return held.stored(member.join(cut.where("not cut"), "g").select("g", "node", "label", "m", "z").union(apart), "ngram-together")


def _inside(member: DataFrame, values: DataFrame, column: str, longs, check, schema: str, held: Scratch) -> DataFrame:
    """What ``check`` finds among the members of each group, by their ``values`` (``longs`` numbers each)."""
    # a group that one task can hold is sent to it whole; larger ones are cut into chunks
    member = member.withColumn("longs", longs)
    total = member.groupBy("g").agg(((F.count("*") <= CHUNK) & (F.sum("longs") <= CHUNK_SHINGLES)).alias("small"))
    member = held.stored(member.join(total, "g"), "ngram-grouped")
    small = member.where("small").select("g", "node", "label", "m").join(values, "node").select("g", "node", "label", "m", column).groupBy("g").applyInArrow(
        lambda group: check(group, np.full(len(group), 2)), schema)
    small = held.stored(small, "ngram-small")
    member = member.where("not small").drop("small")
    # members of a component of a chunk or more form chunks of that component alone ("pure", never
    # compared with each other); the rest of the group shares mixed chunks
    sizes = member.groupBy("g", "label").count().where(F.col("count") >= CHUNK)
    member = member.join(sizes, ["g", "label"], "left").withColumn("pure", F.when(F.col("count").isNotNull(), F.col("label")))
    per = member.groupBy(F.col("g").alias("pg"), F.col("pure").alias("pp"), F.col("z").alias("pz")).agg(
        F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("longs") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    spread = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    member = held.stored(member.join(per, (F.col("g") == F.col("pg")) & F.col("pure").eqNullSafe(F.col("pp")) & (F.col("z") == F.col("pz"))).select(
        "g", "label", "node", "m", "pure", "z", spread.alias("c")), "ngram-members")
    chunk = member.select("g", "pure", "z", "c").distinct()
    a, b = (chunk.select("g", F.col("pure").alias(f"p{s}"), F.col("z").alias(f"z{s}"), F.col("c").alias(f"c{s}")) for s in "ab")
    order_a, order_b = (F.struct(F.col(f"p{s}").isNotNull(), F.coalesce(f"p{s}", F.lit(0)), f"z{s}", f"c{s}") for s in "ab")
    # pairs of chunks, not of members
    tasks = a.join(b, "g").where((order_a <= order_b) & (F.abs(F.col("za") - F.col("zb")) <= 1)
                                 & (F.col("pa").isNull() | ~F.col("pa").eqNullSafe(F.col("pb"))))
    # large groups are written once, by chunk, and read by the tasks that compare them: no copies per pair of chunks
    def chunk_id(*parts: str):
        return F.xxhash64("g", *parts)

    spark = values.sparkSession
    folder = held.folder("ngram-chunks")
    placed = member.select(chunk_id("pure", "z", "c").alias("chunk"), "node", "label", "m").join(values, "node").repartition("chunk")
    write_once(placed.select("node", "label", "m", column, "chunk").write.partitionBy("chunk"), spark, folder)
    pairs = held.stored(tasks.select(chunk_id("pa", "za", "ca").alias("a"), chunk_id("pb", "zb", "cb").alias("b")).distinct(), "ngram-tasks")
    # their rows are few and small, so that adaptive execution would give them all to one task: as many as the work needs
    many = min(MOST_TASKS, 1 + pairs.count() // CHUNK_PAIRS)
    found = pairs.repartition(many, "a", "b").mapInArrow(_compare(check, folder, column), schema)
    return held.stored(found.union(small).distinct(), "ngram-links")


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after links between components."""
    merged = components(links)
    out = label.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
        "node", F.coalesce("top", "root").alias("root"))
    # nodes that had no verified pair of their own yet
    alone = merged.join(label.select("node", "root"), "node", "left_anti")
    return out.union(alone.select("node", "root"))


def representatives(docs: DataFrame, n: int = 5, similarity: float | Fraction = Fraction(8, 10), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The documents, all columns, that stay when one of each component stays: the row of the smallest id (none is
    the largest), and of rows with that id the one whose text has the smallest hash, so neither order nor repeated ids
    decide.  Copies without an id go like all others; of rows equal in id and text one stays.  Rows without words
    link with nothing and all stay.

    Texts move only where the rows to drop are too many for a broadcast.
    """
    ship(docs.sparkSession)
    bands = Bands(Fraction(similarity).limit_denominator(1000))
    key = ["_row_id", "_text_a", "_text_b"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select("*", F.col(id_col).cast("long").alias(key[0]), F.xxhash64(text).alias(key[1]), F.xxhash64(F.lit(1), text).alias(key[2]))
    plain = keyed.select(F.col(key[0]).alias("id"), F.col(text_col).alias("text"), F.col(key[1]).alias("a"), F.col(key[2]).alias("b"))
    rows, seed = _describe(plain, n)
    of_node = _components(plain.select("id", "text"), rows, n, bands, seed)

    each = rows.where("node is not null").groupBy("node", "id", "a", "b").agg(F.count("*").alias("copies"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")
    best = F.min(rank).alias("best")
    members = stored(each.join(of_node.select("node", "root"), "node").select("root", "id", "a", "b", "copies"), "ngram-texts")
    members = stored(members.join(members.groupBy("root").agg(best), "root").select(
        F.col("id").alias(key[0]), F.col("a").alias(key[1]), F.col("b").alias(key[2]), "copies", (rank != F.col("best")).alias("goes")), "ngram-best")

    def same(side: DataFrame):
        return keyed[key[0]].eqNullSafe(side["_i"]) & (keyed[key[1]] == side["_a"]) & (keyed[key[2]] == side["_b"])

    def keys_of(where: str) -> DataFrame:
        found = members.where(where).select(F.col(key[0]).alias("_i"), F.col(key[1]).alias("_a"), F.col(key[2]).alias("_b"))
        return F.broadcast(found) if found.count() <= BROADCAST_IDS else found

    goes, repeats = keys_of("goes"), keys_of("copies > 1 and not goes")
    every = docs.columns
    stays = keyed.join(goes, same(goes), "left_anti")
    once = stays.join(repeats, same(repeats), "left_anti").select(*every)
    one = F.struct(*every)
    again = stays.join(repeats, same(repeats), "left_semi").groupBy(*key).agg(F.min_by(one, F.to_json(one)).alias("_one")).select("_one.*")
    return once.unionByName(again)
