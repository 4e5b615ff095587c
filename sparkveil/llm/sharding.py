"""Resharding by minimum-cost flow.

Documents live in old shards; the new layout has other shards with given capacities. The sizes
of hash blocks of the old shards are summed up (a table whose length is a parameter). A
minimum-cost flow from old shards to new ones, where a byte that stays in its shard costs
nothing and one that moves costs one, says how many bytes go from where to where. It is
realised by walking an old shard's blocks in order: whole blocks go to one shard, and only
the few blocks on a cut are divided, by documents. Files are rewritten only for shards that give or take.
"""

from __future__ import annotations

from bisect import bisect_right
from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window, functions as F

from .common import carried, materialise

BLOCKS = 1024


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest way to send all supply to demand of the same total: {(from, to): amount}. Successive shortest paths with potentials over the bipartite graph; ``cost(i, j)`` is a whole number of at least 0."""
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    left, room = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    up = [0] * (n + m)
    while any(left):
        far, back, todo = {}, {}, []
        for i in range(n):
            if left[i]:
                far[i] = 0
                heappush(todo, (0, i))
        done: set[int] = set()
        while todo:
            d, u = heappop(todo)
            if u in done:
                continue
            done.add(u)
            steps = [(n + j, cost(u, j)) for j in range(m)] if u < n else [(i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n))]
            for v, c in steps:
                e = d + c + up[u] - up[v]
                if v not in done and e < far.get(v, e + 1):
                    far[v], back[v] = e, u
                    heappush(todo, (e, v))
        end = min((j for j in range(m) if room[j]), key=lambda j: far[n + j] + up[n + j])
        path, v = [n + end], n + end
        while v in back:
            v = back[v]
            path.append(v)
        path.reverse()
        amount = min(left[path[0]], room[end], *(flow[(v, u - n)] for u, v in zip(path[1::2], path[2::2])))
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[(u, v - n)] = flow.get((u, v - n), 0) + amount
            else:
                flow[(v, u - n)] -= amount
        left[path[0]] -= amount
        room[end] -= amount
        most = max(far.values())
        for v in range(n + m):
            up[v] += far.get(v, most)
    return {k: v for k, v in flow.items() if v}


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def plan(old_sizes: list[int], capacities: list[int], old_shards: int | None = None) -> list[list[tuple[int, int]]]:
    """For each old shard, (cut, new shard) in order: bytes from the last cut to this one go to that shard. What stays comes first. What is in old shards from number ``old_shards`` on is nowhere yet, so all of it moves."""
    stays = lambda i, j: i == j and (old_shards is None or i < old_shards)
    flow = min_cost_flow(old_sizes, capacities, lambda i, j: int(not stays(i, j)))
    out = []
    for i in range(len(old_sizes)):
        own = sorted(((j, v) for (a, j), v in flow.items() if a == i), key=lambda x: (not stays(i, x[0]), x[0]))
        cuts, at = [], 0
        for j, v in own:
            at += v
            cuts.append((at, j))
        out.append(cuts)
    return out


def reshard(docs: DataFrame, shards: int = 24, old_shards: int = 16, blocks: int = BLOCKS, capacities: list[int] | None = None, old_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, size, text_crc32, old_shard, shard, slot)``, a row for each row of ``docs``.

    ``old_col`` names the column of the old shard (0 to ``old_shards`` - 1); rows where it is null or another number
    have no old shard (null) and move as they must. Without it a hash of the id gives the old layout. ``capacities`` are bytes of the new shards, as many in all as the documents
    have; none: equal. Sizes of the new shards differ from their capacity by the few documents on cuts.
    ``slot`` is gapless from 0 in each shard. Null texts have size 8 and the CRC-32 of no bytes; null ids
    and repeated rows are placed like others; an empty table gives an empty one. The driver sees
    ``(old_shards + 1) * blocks`` rows at most.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    old = F.col(f"`{old_col}`").cast("int") if old_col else F.pmod(h, F.lit(old_shards)).cast("int")
    old = F.when(old.between(0, old_shards - 1), old).otherwise(old_shards)
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("crc"), h.alias("h"), old.alias("old"))
    narrow = materialise(narrow.withColumn("block", F.pmod(F.shiftright("h", 20), F.lit(blocks)).cast("int")))
    sums = {(r["old"], r["block"]): r["bytes"] for r in narrow.groupBy("old", "block").agg(F.sum("size").alias("bytes")).collect()}
    sizes = [sum(v for (o, _), v in sums.items() if o == i) for i in range(old_shards + 1)]
    cuts = plan(sizes, capacities or even(sum(sizes), shards), old_shards)
    ahead = []
    for i in range(old_shards + 1):
        at, ends = 0, [c for c, _ in cuts[i]]
        for b in range(blocks):
            size = sums.get((i, b), 0)
            if size:
                first, last = bisect_right(ends, at), bisect_right(ends, at + size - 1)
                ahead.append((i, b, at, cuts[i][first][1] if first == last else None))
            at += size
    spark = docs.sparkSession
    where = spark.createDataFrame(ahead, "old int, block int, ahead bigint, whole int")
    inside = Window.partitionBy("old", "block").orderBy("h", "id", "size", "crc")
    placed = narrow.join(F.broadcast(where), ["old", "block"])
    placed = placed.withColumn("start", F.col("ahead") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    middle = F.col("start") + F.floor(F.col("size") / 2)
    shard = F.col("whole")
    for i in range(old_shards + 1):
        for k, (_, j) in enumerate(cuts[i]):
            low = cuts[i][k - 1][0] if k else 0
            shard = F.when(F.col("whole").isNull() & (F.col("old") == i) & (middle >= low) & (middle < cuts[i][k][0]), F.lit(j)).otherwise(shard)
    placed = materialise(placed.select("id", "size", "crc", "old", "block", shard.alias("shard"), "start"))
    counts = sorted(tuple(r) for r in placed.groupBy("shard", "old", "block").count().collect())
    offsets, seen = [], {}
    for s, o, b, n in counts:
        offsets.append((s, o, b, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    before = spark.createDataFrame(offsets, "shard int, old int, block int, before bigint")
    inside = Window.partitionBy("shard", "old", "block").orderBy("start")
    placed = placed.join(F.broadcast(before), ["shard", "old", "block"]).withColumn("slot", F.col("before") + F.row_number().over(inside) - 1)
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.when(F.col("old") < old_shards, F.col("old")).alias("old_shard"), "shard", "slot")


def rewrite(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", files: int = 8, text_col: str = "text", old_col: str | None = None) -> list[int]:
    """Write the documents of the affected shards (those that give or take) below ``path/shard=N`` in slot order; the others' files stay as they are. Returns the affected shards.

    ``placed`` is what ``reshard`` made of ``docs`` with the same columns. Rows are matched by id, text and old shard, equal ones by number, so null
    and repeated ids are kept. An affected shard that keeps no row loses its files.
    """
    hit = sorted({r[0] for r in placed.where("not old_shard <=> shard").select(F.explode(F.array("old_shard", "shard"))).distinct().collect()} - {None})
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    keys = ["id", "size", "crc", "old"]
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    old = F.col(f"`{old_col}`").cast("int") if old_col else F.lit(None).cast("int")
    marked = docs.select(carried(docs, names), F.col(f"`{id_col}`").alias("id"), (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text).alias("crc"), old.alias("old"))
    held = {r[0] for r in placed.select("old_shard").distinct().collect()}
    if old_col:  # rows without an old shard are matched as such
        marked = marked.withColumn("old", F.when(F.col("old").isin(sorted(held - {None})), F.col("old")))
    marked = marked.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    kept = placed.select(F.col(id_col).alias("id"), "size", F.col("text_crc32").alias("crc"), (F.col("old_shard") if old_col else old).alias("old"), "shard", "slot")
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("shard", "slot"))).where(F.col("shard").isin(hit))
    same = [marked[k].eqNullSafe(kept[k]) for k in (*keys, "nth")]
    whole = marked.join(kept, same).select(*[F.col("row").getField(c).alias(c) for c in names], "shard", "slot")
    dealt = whole.repartition("shard", F.pmod(F.xxhash64("slot"), F.lit(files))).sortWithinPartitions("shard", "slot")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    left = {r[0] for r in placed.select("shard").distinct().collect()}
    spark = docs.sparkSession
    for shard in hit:
        if shard not in left:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return hit
