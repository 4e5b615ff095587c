import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import embeddings, html, langid, linededup, mixing, packing, sharding, simhash, sketch, substring
from sparkveil.llm.common import connected_components
from sparkveil.llm.pagegen import labelled_pages

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, component_id string, mix_copy int, n_removed int"


def corpus():
    """Near and exact copies, repeats inside a text, nulls, blanks, a long text, repeated rows."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, texts = [line(40) for _ in range(4)], []
    for i in range(60):
        parts = [line(r.randint(1, 30)) for _ in range(r.randint(1, 5))]
        if i % 3 == 0:
            parts.insert(1, r.choice(shared))
        if i % 5 == 0:
            parts.append(r.choice(shared) + " x" * r.randint(0, 1))
        texts.append("\n".join(parts))
    base = line(200)
    texts += [base] * 5 + [base + " end", base.upper(), None, "", "  \n\t ", "one", "one", "two words", "a b 日本", line(5000)]
    texts += [" ".join(w if k % 60 else word() for k, w in enumerate(base.split())) for _ in range(4)]
    rows = [(i * 3, t, "en", f"s{min(i, 3)}", 0, 1, "x", 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[2], rows[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(n, linked):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in linked:
        top[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None)]
    got = dict(tuple(x) for x in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    pairs = [(a, b) for a, b in links if b is not None and a != b]
    names = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(names)}
    of = groups(len(names), [(at[a], at[b]) for a, b in pairs])
    low = {}
    for x, g in zip(names, of):
        low.setdefault(g, x)
    assert got == {x: low[g] for x, g in zip(names, of)}


def test_within_against_brute_force():
    r = np.random.default_rng(2)
    fps = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps[100:200] = fps[:100] ^ (np.uint64(1) << r.integers(0, 63, 100).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 63, 100).astype(np.uint64))
    for radius in (0, 1, 2, 3, 4, 7, 12, 14):
        rows, bits = simhash.within(fps, radius)
        got = {(int(i), int(j)) for k, i in enumerate(rows) for j in simhash.lanes(bits[k])}
        assert got == {(i, j) for i in range(300) for j in range(300) if i != j and int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_simhash(spark, docs, empty):
    rows = [(r[0], r[1]) for r in corpus()]
    fps = [simhash.simhash(simhash.shingle_hashes(t, 4)) for _, t in rows]
    of = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = {}
    for (i, _), g in zip(rows, of):
        low[g] = min(low.get(g, i), i)
    got = Counter(tuple(r) for r in simhash.simhash_components(docs).collect())
    assert got == Counter((i, f"{f:016x}", low[g]) for (i, _), f, g in zip(rows, fps, of))
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.simhash(simhash.shingle_hashes("a b", 4)) == simhash.simhash(simhash.shingle_hashes(" A\tb ", 4))


def test_tiles_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    fps = [(int(k) << 56 | 1 << (k % 50)) for k in range(1, 120)]
    df = spark.createDataFrame([(f if f < 1 << 63 else f - (1 << 64),) for f in fps], "fp bigint")
    got = connected_components(simhash.near_links(df, 4)).count()
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert got == len({x for p in linked for x in p})


def test_near_dedup(docs, empty):
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and simhash.near_dedup(empty).count() == 0
    rows = [(r[0], r[1]) for r in corpus()]
    sets = [frozenset(np.frombuffer(simhash.shingle_set(t, 5), "<u4").tolist()) for _, t in rows]
    fps = [simhash.simhash(simhash.shingle_hashes(t, 5)) for _, t in rows]
    near = lambda i, j: sets[i] == sets[j] or (fps[i] ^ fps[j]).bit_count() <= 12 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    of = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near(i, j)])
    low = {}
    for (i, _), g in zip(rows, of):
        low[g] = min(low.get(g, i), i)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for (i, _), g in zip(rows, of) if low[g] == i)


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs, weights={"s0": 1, "s1": 1, "s3": 2}, total=3.0).toPandas()
    assert mixing.mix(empty).count() == 0 and set(out.source) <= {"s0", "s1", "s3"}
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4 > 0).cast("int")).alias("source"))
    n = mixing.mix(big, weights={"s0": 0.5, "s1": 0.5}, total=1.0).groupBy("source").count().collect()
    assert all(abs(r["count"] - 10000) < 400 for r in n)
    counts = Counter(r["n"] for r in mixing.mix(big, total=2.0, weights={"s0": 0.25, "s1": 0.75}).groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert abs(20000 - sum(counts.values()) - 20000 * np.exp(-2)) < 300


def test_line_dedup(docs, empty):
    got = linededup.line_dedup(docs)
    assert linededup.line_dedup(empty).count() == 0
    rows = sorted(((r[0], r[1]) for r in corpus()), key=lambda x: x[0])
    first, seen = {}, []
    for i, t in dict(rows).items():
        for k, line in enumerate((t or "").split("\n")):
            if f := linededup.normal_form(line):
                first.setdefault(f, (i, k))
                seen.append((i, k, f))
    forms = list(first)
    h = linededup.line_hashes(forms)
    of = groups(len(forms), [(i, j) for i in range(len(forms)) for j in range(i) if int(h[i] ^ h[j]).bit_count() <= 3 and linededup.alike(forms[i], forms[j], 0.8)])
    low = {}
    for f, g in zip(forms, of):
        low[g] = min(low.get(g, (1 << 60, 0)), first[f])
    keep = {f: low[g] for f, g in zip(forms, of)}
    gone = {}
    for i, k, f in seen:
        if keep[f] != (i, k):
            gone.setdefault(i, set()).add(k)
    texts = dict(rows)
    for r in got.collect():
        t = texts[r.doc_id]
        want = t if r.doc_id not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[r.doc_id])
        assert r.text == want and r.n_removed == len(gone.get(r.doc_id, ()))


def test_edit_distance():
    r = random.Random(3)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(400):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(2))
        for most in (0, 1, 3, 8):
            assert linededup.edit_distance_within(a, b, most) == (slow(a, b) <= most)


def test_substring(spark, docs, empty):
    got = substring.substring_dedup(docs.dropDuplicates(["doc_id"]), window=13).collect()
    want = substring.brute_force(list(dict((r[0], r[1]) for r in corpus()).items()), 13)
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == want
    assert sum(w[1] for w in want.values()) > 500 and substring.substring_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, "a " * 30), (1, "a " * 30), (None, "a " * 30)], "doc_id bigint, text string")
    assert sorted(r.n_removed for r in substring.substring_dedup(twice).collect()) == [0, 0, 30]


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(20, 8))
    x = [list(map(float, base[i % 20] + 0.25 * r.normal(size=8))) for i in range(300)]
    rows = [(i, v) for i, v in enumerate(x)] + [(300, x[7]), (301, x[7]), (302, [2 * a for a in x[8]]), (303, None), (304, [0.0] * 8), (305, [float("nan")] + [1.0] * 7), (306, []), (307, [1.0, 2.0]), (308, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ok = {i: np.array(v) for i, v in rows if v and np.isfinite(v).all() and np.any(v)}
    cos = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    links = [(i, j) for i in ok for j in ok if i != j and cos(ok[i], ok[j])]
    n, of, low = Counter(i for i, _ in links), groups(len(rows), links), {}
    for i, g in enumerate(of):
        low.setdefault(g, i)
    for cell, tile in ((8192, 8192), (40, 32)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, cell=cell, tile=tile).collect()}
        assert got == {i: (n[i], low[of[i]], low[of[i]] == i) for i, _ in rows}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_language(spark):
    r = random.Random(6)
    syllables = {"aa": "ka lo mi ten rus".split(), "bb": "sch ung ber ver ich".split(), "cc": "tion eau aux oui ment".split()}
    made = lambda l, n: " ".join("".join(r.choice(syllables[l]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, made(l, r.randint(3, 60)), l) for i, l in enumerate(["aa", "bb", "cc"] * 60)] + [(900, None, "aa"), (901, "12 !", "bb"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("held", langid.fold())
    filters = langid.fit(df.where("not held"))
    got = langid.identify(df, filters).collect()
    held = [x for x in got if x.held and x.doc_id < 900]
    assert len(held) > 15 and all(x.lang_pred == x.lang and 0 <= x.lang_score <= 1 for x in held)
    assert {x.lang_pred for x in got if x.doc_id >= 900} == {"und"}
    assert all(x.held == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    none = langid.fit(df.limit(0))
    assert {x.lang_pred for x in langid.identify(df.limit(3), none).collect()} == {"und"}


def test_sharding(spark, docs, empty, tmp_path):
    out = sharding.reshard(docs, shards=6, old_shards=4, blocks=8)
    got = out.toPandas()
    assert Counter(got.doc_id) == Counter(r[0] for r in corpus()) and sharding.reshard(empty, 6, 4, 8).count() == 0
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    text = dict((r[0], r[1]) for r in corpus())
    flow = sharding.min_cost_flow([10, 20, 30], [30, 15, 15], lambda i, j: int(i != j))
    assert sum(v for (i, j), v in flow.items() if i != j) == 20
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    sizes = sharding.reshard(big, 24, 16).groupBy("shard").agg(F.sum("size").alias("s")).toPandas().s
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 120
    placed = sharding.reshard(big, 24, 16)
    hit = sharding.rewrite(big, placed, str(tmp_path / "files"))
    assert spark.read.parquet(str(tmp_path / "files")).count() == placed.where(F.col("shard").isin(hit)).count()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    got = packing.pack(docs.dropDuplicates(["doc_id"]), length=64, with_ids=True).toPandas()
    t = Tokenizer.from_file(packing.default_vocabulary())
    for i, text in dict((r[0], r[1]) for r in corpus()).items():
        part = got[got.doc_id == i].sort_values("start")
        ids = np.frombuffer(b"".join(part.ids), "<u4").tolist()
        assert ids == t.encode(text or "", add_special_tokens=False).ids + [2] and set(part.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(x) == c for x, c in zip(part.ids, part.ids_crc32))
    sizes = got.groupby("sequence_id").length.sum()
    assert (sizes[:-1] == 64).all() and packing.pack(empty).count() == 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all()


@pytest.mark.parametrize("text", ["don't STOP's x's", "ab1c2 d--e!!", "É ﬁne naïve—dash", "a<|endoftext|>b <|endoftext|>", "x'll,y've ''s", "東京2024年。", "áb"])
def test_word_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    assert np.frombuffer(packing.encoder(packing.default_vocabulary()).encode(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_sketch(spark, docs, empty):
    data = dict((r[0], r[1] or "") for r in corpus())
    one = docs.dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in sketch.edited_fingerprints(one).collect()}
    ids = sorted(data)
    for k, i in enumerate(ids):
        text, after = data[i], data[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = ({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if (w := x.encode().split()) else set() for x in (text, edited))
        assert abs(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.17
    assert sketch.edited_fingerprints(empty).count() == 0
    assert len({got[i].fingerprint for i in ids if data[i] == data[180]}) == 1
    parts = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "k l m n o p"), (2, "q")], "k int, t string").select("k", sketch.sketch(F.col("t")).alias("s"))
    assert {r.k: len(r.s) for r in sketch.merged_sketches(parts, "k", "s").collect()} == {1: 8, 2: 1}
    n = spark.createDataFrame([(" ".join(map(str, range(3000))),)], "t string").select(sketch.distinct_shingles(sketch.sketch(F.col("t")))).first()[0]
    assert abs(n - 2996) < 900


def test_ranges_of_ids(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = sketch.with_next(df, most=100)
    from pyspark.sql import Window

    by = Window.partitionBy("bucket").orderBy("ghost", "id")
    got = {int(r.text): int(r.n) for r in rows.withColumn("n", F.lead("text").over(by)).where("not ghost").collect()}
    assert got == {i: (i + 1) % 5000 for i in range(5000)}


def test_html(spark):
    chain = html.default_chain()
    pages = labelled_pages(120, seed=77)
    good = sum(chain.extract(h) == "\n\n".join(t for y, t in truth if y) for h, truth in pages)
    assert good >= 0.9 * len(pages)
    page = "<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav><article><h1>Big  &amp;\n news</h1><p><b>One<br>two<p>Three &lt;4&gt;</article><div class='comments'><p>I disagree with this.</p></div><footer>(c) us</footer>"
    rows = [(1, page), (2, None), (3, ""), (4, "<p"), (5, "<script>var x='<p>no</p>'")]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id bigint, html string")).collect()}
    assert got == {1: "Big & news\n\nOne two\n\nThree <4>", 2: "", 3: "", 4: got[4], 5: ""}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    made = lambda n: " ".join("".join(r.choice("ka lo mi ten rus".split()) for _ in range(r.randint(1, 3))) for _ in range(n))
    texts = ["\n".join(made(r.randint(10, 40)) for _ in range(4)) for _ in range(60)]
    texts += [texts[0], "12 34", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(docs.count())
    assert kept == [63, 61, 60, 60]
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) and (out.groupby("sequence_id").length.sum() <= 4096).all()
