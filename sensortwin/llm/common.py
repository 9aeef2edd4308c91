"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensortwin.session import scratch_path


#: Spark's setting that removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: lineage ends there,
    and a lost executor costs only the tasks that read it, not the work that made it.  The write's
    shuffle files go with its end, as nothing else reads them."""
    spark = df.sparkSession
    path = path or scratch_path(spark, f"llm-{name}")
    write_once(df.write, spark, path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator, which it removes as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def folder(self, name: str) -> str:
        self.folders.append(scratch_path(self.spark, f"llm-{name}"))
        return self.folders[-1]

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, self.folder(name))

    def clear(self) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        while self.folders:
            path = hadoop.Path(self.folders.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write_once(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Write Parquet to ``path``; the shuffle files of the write are removed when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, by URI or local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application (they may have no copy)."""
    sc = spark.sparkContext
    if getattr(sc, "_sensortwin_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="sensortwin-code-")  # the driver's own; it serves the file to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = Path(folder, "sensortwin_llm.zip")
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(file))
    sc._sensortwin_shipped = True


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, slice_bytes: int | None = None,
             done: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over batches: ``fn`` gets one batch of about ``slice_bytes`` and returns ``{column: values}``;
    ``done`` is called at the end of each task (to empty what the worker has remembered)."""
    ship(df.sparkSession)
    struct = T._parse_datatype_string(schema)
    names = [f.name for f in struct.fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, slice_bytes or SLICE_BYTES):
                    out = fn(part)
                    if out is not None:
                        yield pa.RecordBatch.from_arrays([out[n].cast(arrow.field(n).type) if isinstance(out[n], pa.Array)
                                                          else pa.array(out[n], type=arrow.field(n).type) for n in names], schema=arrow)
        finally:
            if done:
                done()

    return df.mapInArrow(run, struct)


#: Bytes of a batch that one call of a mapped function handles at once.
SLICE_BYTES = 16 << 20


def slices(batch: pa.RecordBatch, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of about ``size`` bytes (one row at least): bounded task memory."""
    if not batch.num_rows:
        return
    step = max(1, int(batch.num_rows * (size or SLICE_BYTES) / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def join_path(*parts: str) -> str:
    return posixpath.join(*parts)


#: Edges that one task may contract (about 100 bytes each).
EDGES_PER_TASK = 300_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long ids: one row ``(node, root)`` for every
    node of an edge; ``root`` is the smallest id of the component.

    Every round contracts the edges of each partition to a star forest (union-find over the
    partition, so at most one edge per node leaves it), then jumps each parent to its own parent.
    Rounds end when no node has two parents and no parent has a parent, or when the forest is small
    enough (``EDGES_PER_TASK``) for one task to contract the rest.  Only edges move; each round is
    written to the shared folder.  Self-loops are allowed, null ids are left out.
    """
    ship(edges.sparkSession)
    loops = stored(edges.select(F.greatest(a, b).cast("long").alias("x"), F.least(a, b).cast("long").alias("r")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()), "cc-edges")
    state = loops.where("x != r")
    while True:
        if state.count() <= EDGES_PER_TASK:
            state = stored(state.coalesce(1).mapInArrow(_contract, "x long, r long"), "cc-roots")
            break
        forest = stored(state.repartition("x").mapInArrow(_contract, "x long, r long").distinct(), "cc-forest")
        parent = forest.groupBy("x").agg(F.min("r").alias("p"), F.max("r").alias("q"))
        # a child with two parents keeps the smaller one and links all others to it
        extra = forest.join(parent.where("p != q").select("x", "p"), "x").where("r != p").select(
            F.col("r").alias("x"), F.col("p").alias("r"))
        single = parent.select("x", F.col("p").alias("r"))
        up = parent.select(F.col("x").alias("r"), F.col("p").alias("rr"))
        jumped = single.join(up, "r", "left").select(
            "x", F.coalesce("rr", "r").alias("r"), F.col("rr").isNotNull().alias("moved"))
        step = stored(jumped.unionByName(extra.withColumn("moved", F.lit(True))), "cc-step")
        state = step.select(F.greatest("x", "r").alias("x"), F.least("x", "r").alias("r")).where("x != r")
        if step.where("moved").isEmpty():
            break
    roots = loops.select(F.col("r").alias("node")).union(loops.select(F.col("x").alias("node"))).distinct()
    return roots.join(state.select(F.col("x").alias("node"), F.col("r").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges; emits ``(node, smallest node of its group)``."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    for batch in batches:
        for x, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, r = find(x), find(r)
            if x != r:
                up[max(x, r)] = min(x, r)
    nodes = [x for x in list(up) if find(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())],
                                         names=["x", "r"])
