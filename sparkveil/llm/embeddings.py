"""Embedding near-dedup: an exact join of unit vectors, chunk by chunk.

Every vector has a home cell, that of its nearest pivot. The vectors are dealt by cell into ranges and packed into chunks of at most
``TILE``, one row each. Each two chunks meet once, by Spark's cartesian product, which reads the chunks again where they are
needed: a vector is shuffled twice and written twice however many there are, and no cell or group is gathered anywhere.

On unit vectors a cosine of at least ``c`` is an angle of at most ``acos(c)``. By the triangle inequality a vector has no partner in a chunk whose middle is
further from it than that angle and the chunk's radius; such vectors are left out of the comparison. Equal vectors are joined once, with their number.

How much this prunes depends on the vectors: where unrelated ones are nearly as far from every chunk's middle as from each other, as
random ones of many dimensions are, the work is that of all pairs (README).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, least_nodes, materialise

#: Vectors in a row of the written chunks.
TILE = 8192
CELL = 8192
#: So many partial counts and links are held in a task before they are put together.
HELD = 400_000
MAX_PIVOTS = 1024
SAMPLE = 4096
_SLACK = 1e-6


def unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / top  # no overflow on the way
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def choose_pivots(sample: list[np.ndarray], count: int) -> np.ndarray:
    """Farthest-first from the sample, padded with zeros to one length."""
    width = max(map(len, sample))
    x = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    picked, far = [0], 2 - 2 * (x @ x[0])
    while len(picked) < min(count, len(x)):
        i = int(far.argmax())
        if far[i] <= 1e-9:
            break
        picked.append(i)
        far = np.minimum(far, 2 - 2 * (x @ x[i]))
    return x[picked]


def packed(batches, kind: str, chunk: int):
    """Runs of at most ``chunk`` vectors of one length as one row each, from ``(size, id, copies, vector)`` sorted by size."""

    def row(held):
        ids, copies = (np.concatenate([h[c] for h in held]) for c in (1, 2))
        return pa.record_batch([pa.array([int(ids[0])], pa.int64()), pa.array([held[0][0]], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), copies.tobytes(), b"".join([v for h in held for v in h[3]])))], names=["c", "size", "ids", "copies", "vectors"])

    held, n = [], 0
    for batch in batches:
        sizes, ids, copies = (batch.column(i).to_numpy() for i in range(3))
        vectors = batch.column(3).to_pylist()
        cut = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
        for lo, hi in zip(cut, cut[1:]):
            while lo < hi:
                if held and (held[0][0] != sizes[lo] or n == chunk):
                    yield row(held)
                    held, n = [], 0
                end = min(hi, lo + chunk - n)
                held.append((int(sizes[lo]), ids[lo:end].astype("<i8"), copies[lo:end].astype("<i8"), vectors[lo:end]))
                n += end - lo
                lo = end
    if held:
        yield row(held)


def may_link(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """The rows of ``x`` that can have a partner among ``y`` by the triangle inequality of angles."""
    middle = y.sum(axis=0)
    if not middle.any():
        return np.arange(len(x))
    middle = unit(middle[None, :])[0]
    far = np.arccos(np.clip((y @ middle).min(), -1, 1)) + np.arccos(np.clip(cosine, -1, 1)) + _SLACK
    return np.arange(len(x)) if far >= np.pi else np.flatnonzero(x @ middle >= np.cos(far) - _SLACK)


def join_chunks(x: np.ndarray, y: np.ndarray, x_copies: np.ndarray, y_copies: np.ndarray, cosine: float, same: bool):
    """(links of each row of x, of each row of y, to others, a forest of the links as two arrays); the rows of y are counted on from those of x unless both are the ``same``."""
    n_x, n_y, links = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    xs, ys = (np.arange(len(x)), np.arange(len(y))) if same else (may_link(x, y, cosine), may_link(y, x, cosine))
    y32 = y[ys].astype(np.float32)
    for at in range(0, len(xs) if len(ys) else 0, 512):
        rows = xs[at : at + 512]
        near = np.flatnonzero(x[rows].astype(np.float32) @ y32.T >= cosine - 1e-4)
        for lo in range(0, len(near), 1 << 18):
            i, j = np.divmod(near[lo : lo + (1 << 18)], len(ys))
            i, j = rows[i], ys[j]
            ok = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
            i, j = i[ok], j[ok]
            if same:
                i, j = i[i != j], j[i != j]
            if not len(i):
                continue
            n_x += np.bincount(i, y_copies[j], len(x)).astype(np.int64)
            if not same:
                n_y += np.bincount(j, x_copies[i], len(y)).astype(np.int64)
            u, v = least_nodes(i, j if same else j + len(x))
            links.append((u[u != v], v[u != v]))
    if not links:
        return n_x, n_y, np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = (np.concatenate(c) for c in zip(*links))
    u, v = least_nodes(u, v)
    return n_x, n_y, u[u != v], v[u != v]


def near_vectors(table: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, tile: int = TILE) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, a row for each row of ``table``.

    ``n_links`` counts the other rows at cosine ``cosine`` (above 0) or more, in double precision;
    ``component_id`` is the smallest id reachable, the row's own included; ``kept`` marks rows that have
    the smallest id. A vector that is null, empty, zero or has a null, infinite or NaN component links with
    nothing, and vectors of different lengths do not link. Rows that share an id count as rows of their own.
    A null id is no component: its row has its group's, or null. Other columns are not looked at; an empty
    table gives an empty one.
    """
    # vectors of floats stay floats until they are compared: half the bytes, and the same doubles
    single = table.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"

    def doubles(raw, size):
        return np.frombuffer(raw, kind).astype(np.float64).reshape(-1, size)

    def clean(batches):
        for batch in batches:
            out, keys = [], []
            for v in batch.column(1):
                got = key = None
                if v.is_valid and len(v) and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False)
                    if np.isfinite(x).all() and x.any():
                        got = x.astype(kind).tobytes()
                        key = hashlib.sha256((unit(x[None, :].astype(np.float64))[0] + 0.0).astype("<f8")).digest()[:16]
                out.append(got)
                keys.append(key)
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], names=["id", "key", "vector"])

    plain = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    rows = plain.mapInArrow(clean, "id bigint, key binary, vector binary")
    alike = materialise(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn("id", F.xxhash64("key")))
    n = alike.count()
    marked = materialise(rows.select("id", "key"))
    if not n:
        return marked.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.coalesce(F.col("id").isNotNull(), F.lit(False)).alias("kept"))
    spark = table.sparkSession
    share = min(1.0, SAMPLE / n)
    sample = alike.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) <= int(share * (1 << 20))).select("vector").limit(2 * SAMPLE).collect() or alike.select("vector").limit(1).collect()
    sample = [unit(np.frombuffer(v, kind).astype(np.float64)[None, :])[0] for v in sorted(bytes(x["vector"]) for x in sample)]
    pivots = spark.sparkContext.broadcast(choose_pivots(sample, min(MAX_PIVOTS, -(-n // cell))))

    def deal(batches):
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors], np.int64) // np.dtype(kind).itemsize
            cells = np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes):
                some = np.flatnonzero(sizes == size)
                p = pivots.value[:, :size]
                cells[some] = (unit(doubles(b"".join([vectors[i] for i in some]), size))[:, : p.shape[1]] @ p.T).argmax(axis=1)
            yield pa.record_batch([pa.array(sizes.astype(np.int32)), pa.array(cells), *batch.columns], names=["size", "cell", "id", "copies", "vector"])

    dealt = alike.select("id", "copies", "vector").mapInArrow(deal, "size int, cell int, id bigint, copies bigint, vector binary")
    dealt = dealt.repartitionByRange("size", "cell", "id").sortWithinPartitions("size", "cell", "id").select("size", "id", "copies", "vector")
    chunks = materialise(dealt.mapInArrow(lambda batches: packed(batches, kind, tile), "c bigint, size int, ids binary, copies binary, vectors binary"))

    def join(batches):
        counted, linked, size = [], [], 0  # partial sums by id and links, put together where they lie

        def added():
            ids, n = (np.concatenate(z) for z in zip(*counted))
            ids, at = np.unique(ids, return_inverse=True)
            u, v = least_nodes(*(np.concatenate(z) for z in zip(*linked)))
            n, u, v = np.bincount(at, n, len(ids)).astype(np.int64), u[u != v], v[u != v]
            counted[:], linked[:] = [(ids, n)], [(u, v)]
            return len(ids) + len(u)

        def row():
            (ids, n), (u, v) = counted.pop(), linked.pop()
            cols = pa.array(np.concatenate((ids, u))), pa.array(np.concatenate((n, np.zeros(len(u), np.int64))))
            return pa.record_batch([*cols, pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(v)])], names=["id", "n", "other"])

        for batch in batches:
            for k in range(batch.num_rows):
                c, width, ids, copies, vectors, *other = (col[k].as_py() for col in batch.columns)
                if width != other[1]:
                    continue
                same = c == other[0]
                x = unit(doubles(vectors, width))
                y = x if same else unit(doubles(other[4], width))
                (i, m), (j, w) = ((np.frombuffer(d, "<i8") for d in z) for z in ((ids, copies), other[2:4]))
                n_x, n_y, u, v = join_chunks(x, y, m, w, cosine, same)
                if not len(u):
                    continue
                names = i if same else np.concatenate((i, j))
                n = n_x if same else np.concatenate((n_x, n_y))
                counted.append((names[n > 0], n[n > 0]))
                linked.append((names[u], names[v]))
                size += len(u) + len(counted[-1][0])
                if size > HELD:
                    size = added()
                    if 2 * size > HELD:
                        yield row()
                        size = 0
        if counted:
            added()
            yield row()

    twin = chunks.select(*[F.col(x).alias(f"{x}2") for x in chunks.columns])
    pairs = chunks.hint("shuffle_replicate_nl").join(twin, F.col("c") <= F.col("c2"))
    joined = materialise(pairs.mapInArrow(join, "id bigint, n bigint, other bigint"))
    links = joined.where("other is null").groupBy("id").agg((F.sum("n")).alias("n"))
    groups = connected_components(joined.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = materialise(groups.join(alike.select(F.col("id").alias("node"), "low"), "node"))
    lows = materialise(named.groupBy("component").agg(F.min("low").alias("least")))
    named = named.join(lows, "component").select(F.col("node").alias("id"), "least")
    known = alike.select("key", "id", "low", "copies").join(links, "id", "left").join(named, "id", "left")
    known = known.select("key", (F.col("copies") + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("least", "low").alias("component"))
    known = materialise(known)
    out = marked.join(known, "key", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.col("n") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce(F.col("id") == F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")), F.lit(False)).alias("kept"),
    )
