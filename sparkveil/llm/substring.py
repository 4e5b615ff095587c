"""Exact substring dedup by fixed-block anchors.

Every run of ``window`` words holds one whole non-overlapping reference block of
``block = (window + 1) // 2`` words, wherever the run starts. So the reference blocks of all
documents are the index, and every rolling run of ``block`` words is a probe; a window can be
repeated only if it covers a probe that hits. Hits are extended: the windows around them
(and only those) are resolved by a 128-bit hash of their words' hashes within a hash-addressed partition
to the smallest document that holds them. Joined windows are the maximal exact repeats.

Nothing is sent for single words or windows as rows. Documents are dealt in batches of bounded
size; a batch sends to each of the partitions one sorted blob of its distinct hashes, and gets
back one byte for each, in that order. A hot passage is therefore one entry for each batch. There are
as many partitions as ``PART`` batches each make, so that what a task holds stays the same however
large the input is. Blobs get shorter as partitions and batches grow in number; there are never more of them than words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import materialise, mixed, shuffle_partitions, words_of

BATCH_BYTES = 4 << 20
#: So many batches make a partition of the hashes, at least.
PART = 8
_LAST = np.iinfo(np.int64).max
_SEED, _SECOND = 0xD1B54A32D192ED03, 0xAEF17502108EF2D9


def hashes_of_runs(words: np.ndarray, length: int, seed: int = _SEED) -> np.ndarray:
    """The hash of every run of ``length`` words, by start."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out *= np.uint64(seed)
        out += words[i : i + n]
    return mixed(out + np.uint64(length))


class Batch:
    """Words of the documents of a batch and their hashes, end to end, with windows that never cross a document's end."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.data, self.starts, self.ends, self.words, self.first = words_of(texts)
        self.sizes = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.at = np.arange(len(self.words)) - self.first[self.doc]

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the runs inside one document."""
        h = hashes_of_runs(self.words, length)
        start = np.flatnonzero(self.at[: len(h)] + length <= self.sizes[self.doc[: len(h)]])
        return start, h[start]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def probes(batch: Batch, block: int, parts: int):
    """(part, key, flags, position groups): the distinct probe keys of a batch, by part and key. A key has 30 bits; flag 1: on a reference block, flag 2: more than once."""
    start, h = batch.runs(block)
    key = (part_of(h, parts) << 30) | (h & np.uint64(0x3FFFFFFF)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, start = key[order], start[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((cut, [len(key)])))
    on = np.logical_or.reduceat(batch.at[start] % block == 0, cut) if len(cut) else np.zeros(0, bool)
    return key[cut], on.astype(np.uint32) | ((counts > 1).astype(np.uint32) << 1), start, counts


def blobs(part: np.ndarray, parts: int, *arrays: np.ndarray):
    """For each part that has entries: (part, a blob of each array)."""
    edge = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edge)).tolist():
        yield (p, *[x[edge[p] : edge[p + 1]].tobytes() for x in arrays])


def rows(values: list[tuple], schema: pa.Schema, most: int = 256):
    for at in range(0, len(values), most):
        part = values[at : at + most]
        yield pa.record_batch([pa.array([v[i] for v in part], schema.field(i).type) for i in range(len(schema))], schema=schema)


_SENT = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("blob", pa.binary()), ("ids", pa.binary())])
_REPLY = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("bits", pa.binary())])
_SENT_SQL, _REPLY_SQL = "part int, batch bigint, blob binary, ids binary", "batch bigint, part int, bits binary"
_STORED_SQL = "batch bigint, ids binary, nulls binary, sizes binary, texts binary"


def _store(batches):
    """Deal documents into batches of a bounded size (one document may be more): ids, sizes and the compressed texts."""
    from pyspark import TaskContext

    task, n = TaskContext.get().partitionId(), 0
    held, size = [], 0
    squeeze = zstandard.ZstdCompressor(level=1)
    schema = pa.schema([("batch", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())])

    def out():
        ids = np.array([_LAST if i is None else i for i, _ in held], "<i8")
        row = ((task << 32) | n, ids.tobytes(), np.array([i is None for i, _ in held], np.uint8).tobytes(), np.array([len(t) for _, t in held], "<i8").tobytes(), squeeze.compress(b"".join(t for _, t in held)))
        return next(rows([row], schema))

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            if held and size + len(raw) > BATCH_BYTES:
                yield out()
                held, size, n = [], 0, n + 1
            held.append((i, raw))
            size += len(raw)
    if held:
        yield out()


def _open(ids: bytes, sizes: bytes, texts: bytes) -> tuple[np.ndarray, Batch]:
    raw, cut = zstandard.ZstdDecompressor().decompress(texts, max_output_size=0) if texts else b"", np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<i8"))))
    return np.frombuffer(ids, "<i8"), Batch([raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())])


def _opened(table: pa.Table, k: int = 0):
    row = {c: table.column(c)[k].as_py() for c in ("batch", "ids", "nulls", "sizes", "texts")}
    ids, batch = _open(row["ids"], row["sizes"], row["texts"])
    return row["batch"], ids, np.frombuffer(row["nulls"], np.uint8).astype(bool), batch


def _bits(replies: pa.Table) -> np.ndarray:
    """The replies of all parts, in the order of the batch's entries."""
    got = sorted(zip(replies.column("part").to_pylist(), replies.column("bits").to_pylist()))
    return np.concatenate([np.frombuffer(b, np.uint8) for _, b in got]).astype(bool) if got else np.zeros(0, bool)


def _hit_reply(key, table):
    """For each entry: is its key on a reference block somewhere, and does it stand in more than one place?"""
    entries = [np.frombuffer(b, "<u4") for b in table.column("blob").to_pylist()]
    sizes = np.cumsum([0] + [len(e) for e in entries])
    every = np.concatenate(entries)
    order = np.argsort(every >> np.uint32(2), kind="stable")
    keys, flags = every[order] >> np.uint32(2), every[order] & np.uint32(3)
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.concatenate((cut, [len(keys)])))
    any_flag = np.bitwise_or.reduceat(flags, cut)
    hit = (any_flag & 1).astype(bool) & ((counts > 1) | (any_flag & 2).astype(bool))
    back = np.zeros(len(every), np.uint8)
    back[order] = np.repeat(hit, counts)
    part = table.column("part")[0].as_py()
    return pa.table([table.column("batch"), pa.array([part] * table.num_rows, pa.int32()), pa.array([back[a:b].tobytes() for a, b in zip(sizes[:-1], sizes[1:])], pa.binary())], schema=_REPLY)


def _low_reply(key, table):
    """For each entry: does a document outside the batch with a smaller id hold the window?"""
    hashes = [np.frombuffer(b, "<u8") for b in table.column("blob").to_pylist()]
    sizes = np.cumsum([0] + [len(e) // 2 for e in hashes])
    every, ids = np.concatenate(hashes).reshape(-1, 2), np.concatenate([np.frombuffer(b, "<i8") for b in table.column("ids").to_pylist()])
    order = np.lexsort((every[:, 1], every[:, 0]))
    cut = firsts(every[order])
    low = np.minimum.reduceat(ids[order], cut)
    back = np.zeros(len(every), np.uint8)
    back[order] = ids[order] > np.repeat(low, np.diff(np.concatenate((cut, [len(every)]))))
    part = table.column("part")[0].as_py()
    return pa.table([table.column("batch"), pa.array([part] * table.num_rows, pa.int32()), pa.array([back[a:b].tobytes() for a, b in zip(sizes[:-1], sizes[1:])], pa.binary())], schema=_REPLY)


def firsts(h: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before it."""
    return np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1)))) if len(h) else np.zeros(0, np.int64)


def hit_windows(batch: Batch, hit_bits: np.ndarray, window: int, block: int, parts: int):
    """(start, two hashes) of the windows that cover a probe that hits."""
    _, _, start, counts = probes(batch, block, parts)
    hits = np.zeros(len(batch.words) + 1, np.int64)
    hits[start[np.repeat(hit_bits, counts)]] = 1
    before = np.concatenate(([0], np.cumsum(hits)))
    at, h = batch.runs(window)
    some = before[at + window - block + 1] > before[at]
    at, h = at[some], h[some]
    second = hashes_of_runs(batch.words, window, _SECOND)[at] if len(at) else h
    return at, np.stack((h, second), axis=1)


def lows(batch: Batch, ids: np.ndarray, at: np.ndarray, h: np.ndarray, parts: int):
    """Distinct window hashes by part with the smallest id of the batch, and how to get back to the windows."""
    key, doc = part_of(h[:, 0], parts), ids[batch.doc[at]]
    order = np.lexsort((doc, h[:, 1], h[:, 0], key))
    key, h, doc, at = key[order], h[order], doc[order], at[order]
    cut = firsts(h)
    return key[cut], h[cut], doc[cut], doc, at, np.diff(np.concatenate((cut, [len(h)])))


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, n_removed, kept)``, a row for each row of ``docs``.

    A word is a run of characters other than ASCII white space, unchanged. Each word that is
    covered by a window of ``window`` words whose words also start somewhere in a document with a
    smaller id is removed; ``kept`` is what is left, joined by one space. Windows are judged on
    the input. A null text has no words. A null id counts as larger than all others, rows that
    share an id do not remove from each other, and other columns of ``docs`` are not looked at.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    stored = materialise(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, _STORED_SQL))
    parts = max(shuffle_partitions(spark), -(-stored.count() // PART))

    def send(batches):
        for t in batches:
            for k in range(t.num_rows):
                name, _, _, batch = _opened(t, k)
                key, flags, _, _ = probes(batch, block, parts)
                packed = ((key & 0x3FFFFFFF).astype(np.uint32) << np.uint32(2)) | flags
                yield from rows([(p, name, b, None) for p, b in blobs(key >> 30, parts, packed)], _SENT)

    hits = stored.mapInArrow(send, _SENT_SQL).groupBy("part").applyInArrow(_hit_reply, _REPLY_SQL)
    hits = materialise(hits)

    def extend(key, left, right):
        name, ids, _, batch = _opened(left)
        at, h = hit_windows(batch, _bits(right), window, block, parts)
        part, h, low, _, _, _ = lows(batch, ids, at, h, parts)
        return pa.Table.from_batches(list(rows([(p, name, a, b) for p, a, b in blobs(part, parts, h, low)], _SENT)), _SENT)

    found = stored.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(extend, _SENT_SQL).groupBy("part").applyInArrow(_low_reply, _REPLY_SQL)
    found = hits.select("batch", F.lit(0).alias("kind"), "part", "bits").unionByName(found.select("batch", F.lit(1).alias("kind"), "part", "bits"))
    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(key, left, right):
        _, ids, nulls, batch = _opened(left)
        kind = np.array(right.column("kind").to_pylist(), np.int64)
        hit, low = (_bits(right.filter(pa.array(kind == k, pa.bool_()))) for k in (0, 1))
        at, h = hit_windows(batch, hit, window, block, parts)
        _, _, first, doc, at, counts = lows(batch, ids, at, h, parts)
        gone = np.zeros(len(batch.words) + 1, np.int64)
        at = at[np.repeat(low, counts) | (doc > np.repeat(first, counts))]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        kept, removed = [], []
        for t, lo, hi in zip(batch.texts, batch.first.tolist(), batch.first[1:].tolist()):
            left = lo + np.flatnonzero(~gone[lo:hi])
            removed.append(hi - lo - len(left))
            words = t.split() if len(left) == hi - lo else [batch.data[s:e] for s, e in zip(batch.starts[left].tolist(), batch.ends[left].tolist())]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.table([pa.array(ids, pa.int64(), mask=nulls), pa.array(batch.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=out)

    done = stored.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(cut, "id bigint, n_words bigint, n_removed bigint, kept string")
    return done.withColumnRenamed("id", id_col)


def brute_force(docs: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple[int, int, str]]:
    """The same by a dictionary of windows, for tests: id to (words, removed, SHA-256 of what is kept)."""
    first: dict[tuple, int] = {}
    split = {i: (t or "").encode().split() for i, t in docs}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out
