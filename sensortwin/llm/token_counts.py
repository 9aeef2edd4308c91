"""Token counts of documents in flat token files that have no index.

A token file is a plain sequence of little-endian unsigned 16-bit ids; an end-of-document id follows
each document.  Files are cut into byte blocks of fixed size; a task reads a block by its range and
finds the end ids in one vectorised search.  A document may span blocks: each block reports its
number of ends and its last end, and a prefix scan over the blocks of a file (running count of ends,
running maximum of end places) tells every block how many documents precede it and where the open one
began.  Work is one read of the files; what the scan moves is one row per block.

:func:`write_tokens` makes such files: byte-level BPE ids per document in tasks, one file per task,
named for the attempt and listed only by the finished task's rows, so lost executors leave nothing
that is read.  Its rows tell which document stands at which place of a file; they hold no lengths.

Nulls and edge cases: a null or empty text is a document of 0 tokens; the end id's own string inside a
text is ordinary text; rows of null or repeated ids are documents of their own; tokens after the last
end of a file are an unfinished document and are reported with ``finished`` false; an empty file has
no rows.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensortwin.llm.common import join_path, map_rows, ship, slices, stored, texts_of
from sensortwin.llm.warc import open_store, read_range

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
END = 50256
BLOCK_TOKENS = 8 << 20


@lru_cache(maxsize=2)
def encoder(path: str = DEFAULT_RANKS):
    """Byte-level BPE of a public rank file (a bare name is looked up in the tokenizer package)."""
    import public_tokenizers
    import tiktoken

    with open(path if "/" in path else public_tokenizers.path(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, folder: str, ranks: str = DEFAULT_RANKS, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids below ``folder``; returns (file, n, id): the n-th document of a file."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = docs.schema["id"].dataType
    schema = pa.schema([("file", pa.string()), ("n", pa.int64())]).append(to_arrow_schema(docs.select("id").schema).field("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        fs.create_dir(root, recursive=True)
        name, out, n = f"tokens-{uuid.uuid4().hex}.bin", None, 0
        encode = encoder(ranks).encode_ordinary
        try:
            for batch in batches:
                for part in slices(batch):
                    out = out or fs.open_output_stream(join_path(root, name), compression=None)
                    for t in texts_of(part):
                        out.write(np.array(encode(t) + [end], "<u2").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), pa.array(range(n, n + part.num_rows), pa.int64()), part.column("id")], schema=schema)
                    n += part.num_rows
        finally:
            if out:
                out.close()

    return stored(docs.mapInArrow(run, f"file string, n long, id {id_type.simpleString()}"), "tokens-order")


def file_sizes(files: DataFrame, folder: str) -> DataFrame:
    """(file, tokens) of the named files, asked from their store in tasks."""

    def run(batch):
        fs, root = open_store(folder)
        names = batch.column("file").to_pylist()
        return {"file": names, "tokens": [i.size // 2 for i in fs.get_file_info([join_path(root, x) for x in names])]}

    return map_rows(files.select("file").distinct(), run, "file string, tokens long")


def scan(spark: SparkSession, files: DataFrame, folder: str, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, n, n_tokens, finished): the length of each document of the named files."""
    blocks = file_sizes(files, folder).where("tokens > 0").select(
        "file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("tokens") - 1).cast("long"), F.lit(block_tokens).cast("long"))).alias("begin"))

    def read(batch):
        fs, root = open_store(folder)
        out = {"file": [], "begin": [], "size": [], "ends": [], "last_end": [], "places": []}
        for file, begin, total in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "tokens")), strict=True):
            size = min(block_tokens, total - begin)
            ids = np.frombuffer(read_range(fs, join_path(root, file), 2 * begin, 2 * size), "<u2")
            places = np.flatnonzero(ids == end) + begin
            out["file"].append(file)
            out["begin"].append(begin)
            out["size"].append(size)
            out["ends"].append(len(places))
            out["last_end"].append(int(places[-1]) if len(places) else None)
            out["places"].append(places)
        return out

    found = stored(map_rows(blocks.repartition("file", "begin"), read, "file string, begin long, size long, ends long, last_end long, places array<long>"), "tokens-blocks")
    # prefix scan over block summaries; places stay where they are
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    carry = found.select("file", "begin", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("n_before"),
                         F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("open_from"))
    whole = found.join(carry, ["file", "begin"]).select(
        "file", F.col("n_before"), "open_from", F.posexplode("places").alias("k", "place"), "places").select(
        "file", (F.col("n_before") + F.col("k")).alias("n"),
        (F.col("place") - F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.get("places", F.col("k") - 1)) - 1).alias("n_tokens"),
        F.lit(True).alias("finished"))
    rest = found.groupBy("file").agg(F.sum("ends").alias("n"), F.max(F.col("begin") + F.col("size")).alias("size"), F.coalesce(F.max("last_end"), F.lit(-1)).alias("last")).where(
        "size - last > 1").select("file", "n", (F.col("size") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("finished"))
    return whole.unionByName(rest)
