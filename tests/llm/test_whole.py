"""Operators against the whole of what they promise, without the gates that find candidates."""

import pathlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkveil.llm import embeddings, linededup, mixing, sharding, simhash
from sparkveil.llm.common import least_nodes, materialise


def test_line_dedup_by_edit_similarity_alone(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    rows = []
    for n in [1, 2, 3, 5, 8, 10, 10, 15, 20, 50] * 12:
        words = [word() for _ in range(n)]
        line = " ".join(words)
        words[r.randrange(n)] = word()
        k = r.randrange(len(line))
        rows += [line, " ".join(words), line[:k] + "#" + line[k + 1 :], line[:k] + line[k + 1 :]]
    rows += ["\u6f22" * 3 + "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(80))]
    rows.append(rows[-1][:40] + "\u4e00" + rows[-1][41:])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    got = {x.doc_id for x in linededup.line_dedup(df, radius=None).where("n_removed = 0").collect()}
    forms = [linededup.normal_form(x) for x in rows]
    top = list(range(len(forms)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(forms)):
        for j in range(i):
            if linededup.alike(forms[i], forms[j], 0.8):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    assert got == {i for i in range(len(forms)) if find(i) == i}


def test_pieces_miss_no_short_pair():
    r = random.Random(12)
    for _ in range(3000):
        a = "".join(r.choice("ab c") for _ in range(r.randint(1, linededup.SHORT)))
        b = list(a)
        for _ in range(r.randint(1, 6)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = r.choice(["", "x", "a"])
        b = "".join(b)
        if 0 < len(b) <= linededup.SHORT and linededup.alike(a, b, 0.8):
            x, y = (set(np.frombuffer(linededup.pieces_of(t, 0.8), "<u4").tolist()) for t in (a, b))
            assert x & y


def test_near_dedup_by_jaccard_alone(spark):
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    texts = []
    for k in range(60):
        words = [word() for _ in range(300)]
        other = words[: r.randint(270, 278)] + [word() for _ in range(30)]
        texts += [" ".join(words), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    sets = [set(np.frombuffer(simhash.shingle_set(t, 5), "<u4").tolist()) for t in texts]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    assert {x.doc_id for x in simhash.near_dedup(df).collect()} == set(low)
    assert len(set(low)) < 70


def test_near_dedup_of_passages_repeated(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    texts = []
    for _ in range(30):
        p, q = (" ".join(word() for _ in range(60)) for _ in range(2))
        texts += [" ".join((p, p, p, p, p, q)), " ".join((p, q, q, q, q, q))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {x.doc_id for x in simhash.near_dedup(df).collect()} == set(range(0, 60, 2))
    same = spark.createDataFrame([(1, "a b " * 3), (2, "a b " * 30), (3, "b a " * 7)], "doc_id bigint, text string")
    assert [x.doc_id for x in simhash.near_dedup(same).collect()] == [1]


def test_mix_of_high_rates(spark):
    df = spark.range(4001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix(df, weights={"a": 0.9, "b": 0.1})
    n = {x["source"]: x["count"] for x in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 3600.9) < 360 and abs(n["b"] - 400) < 140
    assert out.where("source = 'a'").select("mix_copy").distinct().count() == n["a"]


def test_rewrite_over_a_layout(spark, tmp_path):
    path = str(tmp_path / "layout")
    rows = [(i, "x" * 20, 0, i) for i in range(40)] + [(100 + i, "y" * 20, 1, i) for i in range(20)] + [(200 + i, "z" * 20, 2, i) for i in range(4)] + [(None, "n", 3, 1), (None, "n", 3, 2), (7, "r", 3, 3), (7, "r", 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, old int, other int")
    docs.withColumn("shard", F.col("old")).write.partitionBy("shard").parquet(path)
    size = lambda i: sum(len(t) + 8 for _, t, o, _ in rows if o == i)
    whole = [size(0) + size(3), 0, size(2), 0]
    whole[1] = size(1)
    placed = sharding.reshard(docs, 4, 4, 4, capacities=whole, old_col="old")
    before = {p.name for s in (1, 2) for p in (tmp_path / "layout" / f"shard={s}").glob("*.parquet")}
    assert sharding.rewrite(docs, placed, path, old_col="old") == [0, 3]
    assert before == {p.name for s in (1, 2) for p in (tmp_path / "layout" / f"shard={s}").glob("*.parquet")}
    got = spark.read.parquet(path)
    assert Counter((x.doc_id, x.text, x.old, x.other) for x in got.collect()) == Counter(rows)
    assert {x.shard for x in got.where("old = 3").collect()} == {0}


def test_vectors_are_not_copied_for_each_cell(spark, monkeypatch):
    """What op5 writes and shuffles for a vector does not grow with the number of cells."""
    written = []

    def counted(df):
        out = materialise(df)
        size = sum(f.stat().st_size for f in pathlib.Path(out.inputFiles()[0].removeprefix("file://")).parent.glob("*.parquet")) if out.inputFiles() else 0
        written.append(size)
        return out

    monkeypatch.setattr(embeddings, "materialise", counted)
    x = np.random.default_rng(5).standard_normal((3000, 32)).astype(np.float32)
    x[1000:1400] = x[:400] + 0.05 * x[2000:2400]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(6)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, cell=50, tile=100).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.9).sum(axis=1) - 1).tolist())) and max(got.values()) > 0
    assert sum(written) < 4 * x.nbytes


def test_lines_meet_whatever_the_size_of_the_table(spark):
    """Lines that share only runs of under 16 bytes: more documents beside them change nothing."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(4))
    rows = []
    for step in (3, 4, 5, 8) * 5:
        words = [word() for _ in range(40)]
        rows += [" ".join(words), " ".join(w[:3] + "#" if k % step == 0 else w for k, w in enumerate(words))]
    other = [""] * 3000

    def kept(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
        return {x.doc_id for x in linededup.line_dedup(df, radius=None).where(f"n_removed = 0 and doc_id < {len(rows)}").collect()}

    assert kept(rows) == kept(rows + other)


def test_hot_tile_of_lines_has_the_groups_of_all_pairs():
    """Links of a tile, made in the order of likeness with words and couples of letters first, join what a comparison of all pairs joins."""
    r = random.Random(32)
    word = lambda: "".join(r.choice("etaoinsh字\U0001d11e") for _ in range(r.randint(1, 7)))
    base = [word() for _ in range(30)]
    forms = []
    for _ in range(120):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            k = r.randrange(len(words))
            words[k : k + 1] = r.choice([[word()], [words[k] + "s"], [], [words[k], word()]])
        forms.append(" ".join(words))
    forms = sorted(set(forms))
    n, one = len(forms), np.array([1], "<i8").tobytes()
    cols = [np.ones(n, np.int64), np.arange(n), np.array(forms, object), np.array([one] * n, object), np.ones(n, np.int64), np.zeros(n, np.int64)]
    links = [(u, v) for x in linededup.linked_lines(cols, 16, 0.8, 0) for u, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
    assert all(linededup.alike(forms[u], forms[v], 0.8) for u, v in links)
    want = [(u, v) for u in range(n) for v in range(u) if linededup.alike(forms[u], forms[v], 0.8)]
    assert 0 < len(want) < n * (n - 1) // 2
    got, all_ = ({x: y for x, y in zip(*(z.tolist() for z in least_nodes(*np.array(pairs).T)))} for pairs in (links, want))
    assert got == all_ and len(links) == len(got) - len(set(got.values()))


def test_distances_of_many_pairs_at_once():
    """Against one pair at a time: lengths of one to many words of the vectors, edits from none to over the limit, few and many letters, empty texts."""
    r = random.Random(33)
    for letters, longest, similarity in (("ab", 30, 0.8), ("etaoin shrdlu", 320, 0.8), ("etaoin 字\U0001d11e\x00", 900, 0.8), ([chr(0x4E00 + k) for k in range(500)], 200, 0.7)):
        texts, i, j = [""], [0], [0]
        for _ in range(300):
            a = [r.choice(letters) for _ in range(r.randint(1, longest))]
            b = list(a)
            for _ in range(r.randint(0, round(0.7 * len(a)))):
                k = r.randrange(len(b) + 1)
                b[k : k + r.randint(0, 1)] = r.choice([[], [r.choice(letters)]])
            i.append(len(texts))
            j.append(len(texts) + 1)
            texts += ["".join(a), "".join(b)] if r.random() < 0.5 else ["".join(b), "".join(a)]
        sizes = np.array([len(t) for t in texts])
        i, j = np.array(i), np.array(j)
        most = ((1 - similarity) * np.maximum(sizes[i], sizes[j]) + 1e-9).astype(np.int64)
        some = np.abs(sizes[i] - sizes[j]) <= most
        i, j, most = i[some], j[some], most[some]
        got = linededup.alike_pairs(texts, i, j, most).tolist()
        want = [linededup.edit_distance_within(texts[x], texts[y], k) for x, y, k in zip(i.tolist(), j.tolist(), most.tolist())]
        assert got == want and 0 < sum(want) < len(want)


def test_a_hot_tile_is_compared_in_batches(monkeypatch):
    """Six hundred noisy copies of a line, most pairs just under the similarity: letters of one pair at a time took nearly all of the time."""
    r = random.Random(34)
    word = lambda: "".join(r.choice("etaoinsh") for _ in range(r.randint(2, 7)))
    base, forms = [word() for _ in range(80)], []
    for _ in range(600):
        words = list(base)
        for k in r.sample(range(80), 14):
            words[k] = word()
        forms.append(" ".join(words))
    n, one = len(forms), np.array([1], "<i8").tobytes()
    cols = [np.ones(n, np.int64), np.arange(n), np.array(forms, object), np.array([one] * n, object), np.ones(n, np.int64), linededup.line_hashes(forms).view(np.int64)]
    single, edit = [], linededup.edit_distance
    monkeypatch.setattr(linededup, "edit_distance", lambda a, b, most: (single.append(1) if max(len(a), len(b)) > linededup.GAP else None) or edit(a, b, most))
    links = [(u, v) for x in linededup.linked_lines(cols, 16, 0.8, 0) for u, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
    assert all(linededup.alike(forms[u], forms[v], 0.8) for u, v in links[:50])
    single.clear()
    list(linededup.linked_lines(cols, 16, 0.8, 0))
    assert len(single) < 100, len(single)


def test_lines_that_share_a_block_before_this_tile():
    """Pairs that go to another tile, the least block that both have, are the same as by sets."""
    r = random.Random(35)
    tile = np.repeat(np.arange(40), 12)
    g = np.repeat(np.array([r.randrange(20, 60) for _ in range(40)]), 12)
    blocks = [np.array(r.choices(range(-30, 60), k=r.randint(0, 8)) + [int(x)], "<i8").tobytes() for x in g]
    rows, after = linededup.shared_before(np.array(blocks, object), g, tile)
    got = {(int(rows[k]), int(rows[k + d])) for k in range(len(rows)) for d in range(1, int(after[k]) + 1)}
    sets = [set(np.frombuffer(b, "<i8").tolist()) for b in blocks]
    want = {(x, y) for x in range(len(g)) for y in range(x + 1, len(g)) if tile[x] == tile[y] and min(sets[x] & sets[y]) < g[x]}
    assert {p for p in got if p[0] != p[1]} == want


def test_shuffles_go_when_a_table_is_written(spark):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(k).getName().startswith("shuffle_") and files.apply(k).length() for k in range(files.size()))

    before = held()
    df = materialise(spark.range(200_000).repartition(3, "id"))
    assert held() <= before and df.count() == 200_000


def test_shared_places_of_groups_in_many_batches(spark, monkeypatch):
    """Numbers of one key alone go, repeats too, also of numbers whose rows come in many pieces."""
    monkeypatch.setattr(simhash, "MANY", 50)
    r = random.Random(36)
    rows = [(k % 900, [r.choice([-5, 7, r.randrange(10**6), r.randrange(300)]) for _ in range(6)]) for k in range(3000)]
    df = spark.createDataFrame([(k, np.array(b, "<i8").tobytes()) for k, b in rows], "key bigint, blocks binary").repartition(3)
    got = [(x.g, x.key) for x in simhash.shared_places(df, "blocks").collect()]
    keys: dict = {}
    for k, b in rows:
        for x in b:
            keys.setdefault(x, set()).add(k)
    assert Counter(got) == Counter((g, k) for g, ks in keys.items() if len(ks) > 1 for k in ks)
