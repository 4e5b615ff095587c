"""What the operators of this subpackage share: shared scratch tables and connected components."""

from __future__ import annotations

import atexit
import shutil
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. On a local master where that is unset, one below the warehouse folder; elsewhere it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    spark.conf.set("spark.checkpoint.dir", own)
    atexit.register(shutil.rmtree, own.removeprefix("file:"), ignore_errors=True)
    return own


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder below the scratch folder."""
    return f"{scratch_root(spark)}/sparkveil-{spark.sparkContext.applicationId}"


def release_scratch(spark: SparkSession) -> bool:
    """Delete all that this application's operators have written to the scratch folder. Results that have not been written elsewhere can't be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting that a command's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet below the shared scratch folder and read it again.

    The shuffles that made it go as soon as it is written. The operators join such tables by plain joins: Spark knows their sizes, broadcasts those under its own threshold, and splits the partitions of hot keys where both sides are dealt by the join alone.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # else they stay until the driver's next garbage collection
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows and 4 MB at most in this session, unless it has settings of its own: texts are long, and the defaults cost memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


#: So many links are joined up in one go by one worker, 16 bytes each.
PIECE = 500_000


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least): the distinct nodes of links ``u``-``v`` and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def _contracted(batches):
    """Links, ``PIECE`` at a time, as stars around their smallest nodes."""
    import pyarrow as pa

    def star(held):
        u, v = (np.concatenate(c) for c in zip(*held))
        nodes, low = least_nodes(u, v)
        some = nodes != low
        return pa.record_batch([pa.array(nodes[some]), pa.array(low[some])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= PIECE:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of ``links``, two bigint columns; the component is its smallest node.

    Every round joins up ``PIECE`` links at a time where they lie and then exchanges the stars that this leaves,
    by a large-star and a small-star step of map-side combined minima; so no component is ever gathered anywhere,
    and every round is written to the shared scratch folder. If there are at most ``PIECE`` links, the first step does it all.
    Rows with a null end are ignored, loops and repeated links do no harm, and an empty table has no components.
    """
    some = links.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a is not null and b is not null and a <> b")
    edges = materialise(some.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before, n = None, edges.count()
    for _ in range(rounds):
        if n <= PIECE:
            edges = materialise(edges.coalesce(1).mapInArrow(_contracted, "u bigint, v bigint"))
            break
        edges = edges.mapInArrow(_contracted, "u bigint, v bigint")
        edges = materialise(edges.distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select(F.col("v").alias("node"), F.col("v").alias("component")))


def carried(df: DataFrame, names: list[str] | None = None) -> Column:
    """The columns of ``df`` as one, ``row``, so that none can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in names or df.columns]).alias("row")


#: Bits of the hash of a text that tells apart rows which share an id; one more marks a null id.
KEY_BITS = 30


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``id`` and ``th``, which tell rows apart: the id and a hash of the text, or, where the id is null, two hashes of the text. Only rows equal in both have the same."""
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("bigint")
    th = F.pmod(F.xxhash64(text, F.lit(7)), F.lit(1 << KEY_BITS)) + F.when(ident.isNull(), 1 << KEY_BITS).otherwise(0)
    return [F.coalesce(ident, F.xxhash64(text)).alias("id"), th.cast("int").alias("th")]


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes) of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, without a loop over words of up to 16 bytes.

    Words of up to 8 bytes of one length never have the same hash; longer ones and words of several lengths by chance alone; those over 16 bytes have their XXH64.
    """
    space = np.concatenate(([True], _SPACE[np.frombuffer(data, np.uint8)], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    n = ends - starts
    eight = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), 0, (1,))  # the 8 bytes from each byte on
    size = n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = mixed(mixed(eight[starts] & _MASK[np.minimum(n, 8)]) + size)
    more = np.flatnonzero(n > 8)
    if len(more):
        h[more] = mixed(h[more] ^ mixed((eight[starts[more] + 8] & _MASK[np.minimum(n[more] - 8, 8)]) + np.uint64(0xA0761D6478BD642F)))
        for i in np.flatnonzero(n > 16).tolist():
            h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return starts, ends, h


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, hashes, first): the words of all texts end to end; those of text i are ``first[i]`` to ``first[i + 1]``."""
    data = b"\n".join(texts)
    starts, ends, h = word_hashes(data)
    at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return data, starts, ends, h, np.concatenate(([0], np.searchsorted(starts, at)))


def run_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each run of words, from word hashes ``h``; equal runs have equal hashes wherever they stand."""
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


_POWERS: list[np.ndarray] = []
_BASE = 0x9E3779B97F4A7C15
_LIMIT = 1 << 22


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's first powers; kept up to a bounded length."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = max(n, 1 << 16)
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    if size <= _LIMIT:
        _POWERS[:] = out
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
