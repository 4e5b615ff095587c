"""SimHash near-dedup: bit-sliced Hamming comparison inside pigeonhole buckets.

Fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of any ``blocks``
parts, so each way of choosing those parts is one table of buckets, and every link meets in
one of its buckets. Inside a bucket the fingerprints are turned into 64 bit planes, one bit a
member, and the distances of a query to 64 members at a time grow in carry-save counters of
three machine words; query rows whose members all exceed the radius are abandoned early.
A bucket beyond ``TILE`` members is cut into chunks whose pairs are compared as separate
tiles. A tile returns a spanning forest of its links, never all of its pairs.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import KEY_BITS, carried, connected_components, materialise, row_key, run_hashes, words_of

TILE = 2048
BLOCK = 512


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of every shingle, repeats included; fewer words make one shingle, no word none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    whole = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [h(whole, 42)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return [h(whole[s:e], 42) for s, e in zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist())]


def simhash(hashes: list[int] | np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes: zero."""
    if not len(hashes):
        return 0
    return int(majority(np.array(hashes, "<u8"), np.zeros(1, np.int64))[0])


#: A byte's bits as 8 bytes.
_SPREAD = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view("<u8")[:, 0]


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For runs of hashes that begin at ``first`` (none empty): the bits set in over half of a run. Counts grow as 64 byte lanes in 8 words, 255 hashes at a time."""
    sizes = np.diff(np.concatenate((first, [len(h)])))
    pieces = -(-sizes // 255)
    run = np.repeat(np.arange(len(first)), pieces)
    cut = first[run] + 255 * (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    out = np.zeros((len(first), 64), np.int64)
    step = 512
    for lo in range(0, len(cut), step):
        part = cut[lo : lo + step]
        end = cut[lo + step] if lo + step < len(cut) else len(h)
        lanes8 = _SPREAD[h[part[0] : end].astype("<u8").view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes8, part - part[0], axis=0).view(np.uint8).reshape(len(part), 64)
        np.add.at(out, run[lo : lo + step], sums)
    return np.packbits(out * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every whole text; a null or blank text has fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [simhash(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """[64, words]: plane i holds bit i of every fingerprint, one lane a fingerprint."""
    m = len(fps)
    bits = np.zeros((-(-m // 64) * 64, 64), np.uint8)
    bits[:m] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lanes): for each row with a partner, the bit set of members at most ``radius`` bits away, itself excluded. radius: 0 to 62."""
    m, planes = len(fps), bit_planes(fps)
    width = planes.shape[1]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    depth = max(1, (radius + 1 - 1).bit_length())
    start = (1 << depth) - 1 - radius
    pad = np.zeros(width, np.uint64)
    if m % 64:
        pad[-1] = full << np.uint64(m % 64)
    rows_out, bits_out = [], []
    chunk = max(64, min(BLOCK, (1 << 17) // width))
    for at in range(0, m, chunk):
        rows = np.arange(at, min(m, at + chunk))
        q = fps[rows].astype(np.uint64)
        over = np.repeat(pad[None, :], len(rows), axis=0)
        over[np.arange(len(rows)), rows // 64] |= np.uint64(1) << (rows % 64).astype(np.uint64)
        digits = [np.full((len(rows), width), full if start >> d & 1 else 0, np.uint64) for d in range(depth)]
        for i in range(0, 64, 2):
            x = planes[i][None, :] ^ (-((q >> np.uint64(i)) & np.uint64(1)).astype(np.int64)).view(np.uint64)[:, None]
            y = planes[i + 1][None, :] ^ (-((q >> np.uint64(i + 1)) & np.uint64(1)).astype(np.int64)).view(np.uint64)[:, None]
            half = x ^ y
            x &= y
            x |= half & digits[0]  # the carry of a full adder of two planes and the lowest digit
            digits[0] ^= half
            for d in digits[1:]:
                y = d & x
                d ^= x
                x = y
            over |= x
            if i >= 14 and i % 8 == 6:
                alive = (over != full).any(axis=1)
                left = int(alive.sum())
                if not left:
                    break
                if left * 4 < len(alive) * 3:
                    rows, q, over = rows[alive], q[alive], over[alive]
                    digits = [d[alive] for d in digits]
        found = ~over
        some = found.any(axis=1)
        if some.any():
            rows_out.append(rows[some])
            bits_out.append(found[some])
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros((0, width), np.uint64)
    return np.concatenate(rows_out), np.concatenate(bits_out)


def lanes(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def forest(rows: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph that ``within`` returns, breadth first."""
    where = {int(r): k for k, r in enumerate(rows)}
    new = np.zeros(bits.shape[1], np.uint64)
    np.bitwise_or.at(new, rows // 64, np.uint64(1) << (rows % 64).astype(np.uint64))
    out = []
    for seed in where:
        if not int(new[seed // 64]) >> (seed % 64) & 1:
            continue
        new[seed // 64] &= ~np.uint64(1 << (seed % 64))
        todo = [seed]
        while todo:
            u = todo.pop()
            got = bits[where[u]] & new
            if got.any():
                new &= ~got
                reached = lanes(got).tolist()
                out += [(u, v) for v in reached]
                todo += reached
    return out


def grouped(batches, flush, least: int = BLOCK):
    """Feed ``flush`` runs of whole groups (column 0, sorted) of at least ``least`` rows, column arrays each."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
        if held[0][0][0] == held[-1][0][-1]:
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(cols[0])) + 1))
        at = 0
        for c in cut.tolist():
            if c - at >= least:
                yield from flush([x[at:c] for x in cols])
                at = c
        held = [[x[at:] for x in cols]]
    if held:
        yield from flush([np.concatenate(c) for c in zip(*held)])


def plan_blocks(n: int, radius: int, width: int = 64, spare: int | None = None) -> list[list[tuple[int, int]]]:
    """For each table the (offset, bits) parts that must agree. ``spare`` is their number in a table; without it, more parts and tables as the count grows, so buckets stay small."""

    def cost(blocks: int) -> float:
        tables = comb(blocks, radius)
        kept = (blocks - radius) * width // blocks
        return tables * n * (1 + n / 2.0**kept / 1000)

    blocks = radius + spare if spare else min(range(radius + 1, radius + 4), key=cost)
    cuts = [width * i // blocks for i in range(blocks + 1)]
    parts = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
    return [[parts[i] for i in keep] for keep in combinations(range(blocks), blocks - radius)]


def masks(n: int, radius: int, spare: int | None = None) -> list[int]:
    """The bits that must agree in each table."""
    return [sum(((1 << bits) - 1) << at for at, bits in table) for table in plan_blocks(n, radius, spare=spare)]


def split_groups(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` of ``(g, ...)`` with ``tile``: groups ``g`` beyond ``TILE`` rows are cut into chunks by a hash of ``by``, with a tile for each pair of chunks. ``rows`` should be a written table."""
    hot = materialise(rows.groupBy("g").count().where(F.col("count") > TILE).select("g", F.ceil(F.col("count") / TILE).cast("int").alias("parts")))
    if not hot.count():
        return rows.withColumn("tile", F.col("g"))
    rows = rows.join(hot, "g", "left").withColumn("i", F.pmod(F.xxhash64(by, F.lit(7)), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("g", F.least("i", j), F.greatest("i", j)))
    return rows.withColumn("tile", F.explode(F.when(F.col("parts").isNull(), F.array("g")).otherwise(pairs))).drop("parts", "i")


def tiles(fps: DataFrame, radius: int, n: int, spare: int | None = None) -> DataFrame:
    """``(fp, g, tile)``: each row once for each tile of each table that it takes part in."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(n, radius, spare)]
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("bigint"))) for t, m in enumerate(signed)]
    return split_groups(fps.select("fp", F.explode(F.array(*keys)).alias("g")), "fp")


def in_groups(rows: DataFrame, *columns: str) -> DataFrame:
    """``(tile, *columns)``, a tile in one partition, its rows next to each other."""
    return rows.select("tile", *columns).repartition("tile").sortWithinPartitions("tile")


#: So many rows of shared numbers are looked at together.
MANY = 1 << 16


def shared_places(rows: DataFrame, column: str) -> DataFrame:
    """``(g, key)``, once each: the rows of each of the 64-bit numbers in the binary ``column`` that more than one ``key`` has. Written."""

    def spread(batches):
        for batch in batches:
            parts = [np.frombuffer(b, "<i8") for b in batch.column(1).to_pylist()]
            if parts:
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                yield pa.record_batch([pa.array(np.concatenate(parts)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], names=["g", "key"])

    def distinct(held):
        g, key = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((key, g))
        g, key = g[order], key[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])))
        return g[new], key[new]

    def several(g, key):
        same = g[1:] == g[:-1]
        some = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        return pa.record_batch([pa.array(g[some]), pa.array(key[some])], names=["g", "key"])

    def common(batches):
        """Whole numbers' rows, at least ``least`` at a time: Spark sorts by one column much faster than by two."""
        held, n, least = [], 0, MANY
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n < least or not batch.num_rows:
                continue
            g, key = distinct(held)
            at = int(np.searchsorted(g, held[-1][0][-1]))
            if at:
                yield several(g[:at], key[:at])
            held, n = [(g[at:], key[at:])], len(g) - at
            least = max(MANY, 2 * n)
        if n:
            yield several(*distinct(held))

    each = rows.select("key", column).mapInArrow(spread, "g bigint, key bigint")
    return materialise(each.repartition("g").sortWithinPartitions("g").mapInArrow(common, "g bigint, key bigint"))


def linked_tile(cols, verify):
    """Links (a, b) of keys, a spanning forest of each tile, from columns tile, key, data, blocks, g.

    ``verify(cols, lo, hi)`` gives for the tile of these rows two functions: the later rows that row i is to be compared with, and whether two rows are alike.
    Two rows that share several blocks are compared at the least of them alone.
    """
    keys, a, b = cols[1], [], []
    cut = np.concatenate(([0], np.flatnonzero(np.diff(cols[0])) + 1, [len(keys)])).tolist()
    for lo, hi in zip(cut, cut[1:]):
        if hi - lo < 2:
            continue
        others, alike = verify(cols, lo, hi)
        label, blocks, g = np.arange(hi - lo), {}, int(cols[4][lo])

        def of(i):
            if i not in blocks:
                blocks[i] = set(np.frombuffer(cols[3][lo + i], "<i8").tolist())
            return blocks[i]

        for i in range(hi - lo - 1):
            found = others(i)
            for j in found[label[found] != label[i]].tolist():
                if label[i] != label[j] and min(of(i) & of(j)) == g and alike(i, j):
                    label[label == label[j]] = label[i]
                    a.append(int(keys[lo + i]))
                    b.append(int(keys[lo + j]))
    if a:
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links that join every two fingerprints of ``fps.fp`` (distinct, not null) at most ``radius`` bits apart, directly or by others."""

    def flush(cols):
        values = cols[1].astype(np.int64, copy=False)
        rows, bits = within(values.view(np.uint64), radius)
        if len(rows):
            pairs = np.array(forest(rows, bits), np.int64)
            yield pa.record_batch([pa.array(values[pairs[:, 0]]), pa.array(values[pairs[:, 1]])], names=["a", "b"])

    dealt = in_groups(tiles(fps.select("fp"), radius, fps.count()), "fp")
    return dealt.mapInArrow(lambda it: grouped(it, flush), "a bigint, b bigint")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint, component_id)``, a row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over fingerprints at most ``radius`` bits apart,
    the row's own included. Null and blank texts have fingerprint zero and link like any other.
    A null id is carried but never names a component unless no other id is there; repeated ids
    and rows stay; other columns of ``docs`` are not looked at; an empty table gives an empty one.
    """
    marked = materialise(fingerprints(docs, words, id_col, text_col))
    groups = marked.groupBy("fp").agg(F.min("id").alias("low"))
    groups = materialise(groups)
    linked = connected_components(near_links(groups, radius))
    linked = materialise(linked.select(F.col("node").alias("fp"), "component").join(groups, "fp"))
    lows = materialise(linked.groupBy("component").agg(F.min("low").alias("least")))
    linked = materialise(linked.join(lows, "component").select("fp", "least"))
    names = materialise(groups.join(linked, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id")))
    return marked.join(names, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int) -> bytes:
    """The distinct shingles of a text as sorted 32-bit hashes."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64).astype("<u4")).tobytes()


def resemblance(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets; of two empty ones 1."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


BANDS, ROWS = 12, 3
#: Texts of a similarity of 0.8 have SimHashes 10 bits apart on average, with a deviation of 3.
NEAR = 22
#: Tiles of fewer rows are compared without bit planes.
PLANES = 128
_ORDERS = np.random.default_rng(7).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def shingles_of(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes: words are lower-cased in ASCII and parted by ASCII white space; fewer words make one shingle, no word none."""
    out, raw = [], [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    for at in range(0, len(raw), 64):
        _, _, _, h, first = words_of(raw[at : at + 64])
        lo, hi = first[:-1], first[1:]
        n = np.maximum(hi - lo - words + 1, np.minimum(hi - lo, 1))
        cut = np.cumsum(n)
        start = np.arange(n.sum()) - np.repeat(cut - n - lo, n)
        runs = run_hashes(h, start, np.minimum(start + words, np.repeat(hi, n)))
        out += [np.unique(r) for r in np.split(runs, cut[:-1])]
    return out


def band_blocks(shingles: np.ndarray) -> bytes:
    """``BANDS`` 64-bit blocks of a shingle set, each of the least members in ``ROWS`` random orders."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = shingles[None, at : at + 4096] * _ORDERS[:, :1]
        least = np.minimum(least, (x + _ORDERS[:, 1:]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], "<u8").tobytes()


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each group of linked texts the row with the smallest id stays, with all its columns.

    Texts are linked if their sets of ``words``-word shingles have a Jaccard similarity of at least ``similarity``; equal sets always are. Others are
    compared if they share one of ``BANDS`` blocks, each of ``ROWS`` least members (at a similarity of 0.8 about one pair in 5,000 does not): then the bit-sliced comparison
    finds those whose SimHashes, of the distinct shingles, are at most ``radius`` bits apart, and their sets decide. Null and blank texts are equal.

    A null id counts as the largest. A row goes for its own sake alone: rows that share an id, or have a null one, but not their text are documents of
    their own, in the order of a hash of the text; rows that share both are one document, stated more than once, and stay or go together. An empty table gives an empty one. Other columns, whatever their names, are carried along.
    """
    plain = docs.select(*row_key(id_col, text_col), F.col(f"`{text_col}`").cast("string").alias("text"))

    def signed(batches):
        for batch in batches:
            sets = shingles_of(batch.column(2).to_pylist(), words)
            keys = [[xxhash.xxh64_intdigest(s, seed) for s in sets] for seed in (1, 2)]
            keys = [pa.array(np.array(k, np.uint64).view(np.int64)) for k in keys]
            yield pa.record_batch([*batch.columns[:2], *keys, pa.array([band_blocks(s) for s in sets], pa.binary())], names=["id", "th", "key", "check", "blocks"])

    def whole(batches):
        for batch in batches:
            sets = shingles_of(batch.column(1).to_pylist(), words)
            data = [np.uint64(simhash(s)).tobytes() + np.unique(s.astype("<u4")).tobytes() for s in sets]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["key", "data"])

    marked = materialise(plain.mapInArrow(signed, "id bigint, th int, key bigint, check bigint, blocks binary"))
    order = F.struct((F.col("th") >= 1 << KEY_BITS).alias("last"), "id", "th")
    forms = materialise(marked.groupBy("key", "check").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    shared = shared_places(marked.select("key", "blocks"), "blocks")
    keys = materialise(shared.select("key").distinct())
    some = forms.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", "first.id", "first.th")
    sets = plain.join(materialise(some), ["id", "th"]).dropDuplicates(["key"]).select("key", "text").mapInArrow(whole, "key bigint, data binary")
    blocks = marked.join(keys, "key", "left_semi").groupBy("key").agg(F.min("blocks").alias("blocks"))
    sets = materialise(sets.join(blocks, "key"))

    def verify(cols, lo, hi):
        data = cols[2][lo:hi]
        fps = np.array([np.frombuffer(x, "<u8", 1)[0] for x in data], np.uint64)
        sets = [np.frombuffer(x, "<u4", -1, 8) for x in data]

        def alike(i, j):
            n, m = sorted((len(sets[i]), len(sets[j])))
            if n < similarity * m:
                return False
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return both >= similarity * (n + m - both)

        if hi - lo < PLANES:
            return lambda i: i + 1 + np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius), alike
        rows, bits = within(fps, radius)
        at = {r: k for k, r in enumerate(rows.tolist())}
        none = np.zeros(0, np.int64)

        def others(i):
            found = lanes(bits[at[i]]) if i in at else none
            return found[found > i]

        return others, alike

    members = split_groups(shared, "key").join(sets, "key")
    links = in_groups(members, "key", "data", "blocks", "g").mapInArrow(lambda it: grouped(it, partial(linked_tile, verify=verify), 64), "a bigint, b bigint")
    groups = connected_components(links).withColumnRenamed("node", "key")
    named = materialise(groups.join(forms, "key"))
    firsts = materialise(named.groupBy("component").agg(F.min("first").alias("keep")))
    named = materialise(named.join(firsts, "component").select("key", "check", "keep"))
    exact = forms.where("n > 1").join(named, ["key", "check"], "left_anti").select("key", "check", F.col("first").alias("keep"))
    judged = materialise(named.unionByName(exact))
    gone = marked.select("id", "th", "key", "check").join(judged, ["key", "check"]).where((F.col("id") != F.col("keep.id")) | (F.col("th") != F.col("keep.th")))
    gone = materialise(gone.select("id", "th").distinct())
    rows = docs.select(*row_key(id_col, text_col), carried(docs)).join(gone, ["id", "th"], "left_anti")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
