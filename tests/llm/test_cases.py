"""Null and repeated ids, clashing columns, hostile words and pages, and operators against independent brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkveil.llm import html, langid, linededup, mixing, packing, sharding, simhash, sketch, substring
from sparkveil.llm.common import connected_components, least_nodes, release_scratch, scratch_folder

A, B = "a line of ten quite ordinary words that stands somewhere else too", "here is another thing altogether, which only one text has in it"
IDS = "doc_id bigint, text string"


def test_rows_without_or_with_one_id_lose_nothing(spark):
    tables = (
        ([(1, A), (None, A), (None, B), (None, None)], [(1, A), (None, ""), (None, B), (None, None)], [(1, A), (None, B), (None, None)]),
        ([(5, A), (5, A), (5, B), (-3, A + " x"), (7, B + "\n" + A)], [(5, ""), (5, ""), (5, B), (-3, A + " x"), (7, "")], [(5, B), (-3, A + " x"), (7, B + "\n" + A)]),
    )
    for rows, lines, near in tables:
        df = spark.createDataFrame(rows, IDS).repartition(2)
        got = linededup.line_dedup(df, linededup.WIDE, few=linededup.SPARE).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(lines)
        assert Counter((r.doc_id, r.text) for r in simhash.near_dedup(df).collect()) == Counter(near)
    df = spark.createDataFrame([(1, A), (2, A), (2, B)], IDS)
    assert Counter((r.doc_id, r.text) for r in linededup.line_dedup(df).collect()) == Counter([(1, A), (2, ""), (2, B)])


def lines_by_hand(rows, similarity):
    """What stays of each (id, text), ids not null and each once, by comparing all lines with all lines."""
    forms = []
    for i, t in sorted(rows):
        forms += [(" ".join(x.lower().split()), i, k) for k, x in enumerate((t or "").split("\n")) if x.split()]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    names = sorted({f for f, _, _ in forms})
    group = {f: f for f in names}
    for a, b in itertools.combinations(names, 2):
        n = max(len(a), len(b))
        if abs(len(a) - len(b)) <= (1 - similarity) * n and distance(a, b) <= (1 - similarity) * n + 1e-9:
            old, new = group[a], group[b]
            group = {f: new if g == old else g for f, g in group.items()}
    seen, out = set(), {}
    for f, i, k in forms:
        if group[f] in seen:
            out.setdefault(i, set()).add(k)
        seen.add(group[f])
    return {i: t if i not in out else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out[i]) for i, t in rows}


def test_lines_by_hand(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    pool = [" ".join(word() for _ in range(r.randint(1, 14))) for _ in range(40)]

    def spoiled(line):
        words = line.split(" ")
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(words))
            words[k : k + 1] = r.choice([[word()], [words[k][:1] + "#" + words[k][2:]], [], [words[k], "x"]]) or ["y"]
        return "  ".join(words).upper() if r.random() < 0.2 else " ".join(words)

    rows = [(3 * i - 20, "\n".join(spoiled(r.choice(pool)) for _ in range(r.randint(0, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, IDS).repartition(4)
    got = {x.doc_id: x.text for x in linededup.line_dedup(df, linededup.WIDE, few=linededup.SPARE).collect()}
    want = lines_by_hand(rows, 0.8)
    lost = sum(got[i] != want[i] for i in want)
    assert lost <= 0.05 * len(rows), lost


def test_measured_recall_of_lines():
    """Of pairs of lines with every kind of edit up to a similarity of 0.8, the share that meets in a block and passes the SimHash."""
    r = random.Random(22)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9)))
    met = total = 0
    for _ in range(1500):
        words = [word() for _ in range(r.choice([4, 8, 12, 20, 40, 80]))]
        other = list(words)
        for _ in range(max(1, round(r.uniform(0.02, 0.14) * len(words)))):
            k = r.randrange(len(other))
            other[k : k + 1] = r.choice([[word()], [other[k] + "s"], [], [other[k], word()]]) or ["z"]
        a, b = " ".join(words), " ".join(other)
        if a == b or not linededup.alike(a, b, 0.8):
            continue
        total += 1
        keys = [set(np.frombuffer(x + (linededup.piece_keys(t, 0.8) if len(t) <= linededup.SHORT else b""), "<u8").tolist()) for x, t in zip(linededup.blocks_of([a.encode(), b.encode()], linededup.run_length(10**6)), (a, b))]
        fps = linededup.line_hashes([a, b])
        near = int(fps[0] ^ fps[1]).bit_count() <= linededup.WIDE or max(len(words), len(other)) <= linededup.SPARE
        met += bool(keys[0] & keys[1]) and near
    assert total > 1000 and met / total >= 0.9, met / total


def test_words_apart_is_no_less_than_the_distance():
    r = random.Random(23)
    for _ in range(2000):
        a = ["".join(r.choice("ab") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 9))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 2)] = ["".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 2))]
        most = r.randint(0, 8)
        if b and linededup.words_apart(a, b, most) <= most:
            assert linededup.edit_distance_within(" ".join(a), " ".join(b), most)


def test_names_that_clash(spark):
    names = ["_id", "_bad", "_lines", "_kept", "_gone", "_html_of_page", "mix_source", "mix_cdf", "mix_parts", "mix_times", "row", "id", "th", "bad", "keep", "source", "from", "n", "component", "a.b"]
    schema = IDS + ", html string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, t, "<p>x", *([str(i % 2)] * len(names))) for i, t in enumerate([A, B, A + "\n" + B, None, ""])]
    df = spark.createDataFrame(rows, schema)
    same = lambda out, more: out.columns == [*df.columns, *more] and all(x["mix_cdf"] == x["a.b"] == str(x["doc_id"] % 2) for x in out.collect())
    assert same(linededup.line_dedup(df), ["n_removed"])
    assert same(simhash.near_dedup(df), [])
    assert same(mixing.mix(df, total=3.0), ["mix_copy", "mix_key"])
    assert same(html.extract_text(df, out_col="main"), ["main"])
    assert same(langid.identify(df, langid.fit(df, lang_col="source")), ["lang_pred", "lang_score", "lang_cover"])
    for out in (simhash.simhash_components(df), substring.substring_dedup(df), packing.pack(df), sketch.edited_fingerprints(df)):
        assert {x["doc_id"] for x in out.collect()} == set(range(5))


def test_fingerprints_by_hand(spark):
    """XXH64 of joined four-word runs, bit by bit."""
    texts = ["One two  THREE four\tfive six", "a b", "", None, "Ünder ÄB cd ef gh", "x " * 9]

    def by_hand(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode()
        words = [w for w in words.replace(b"\t", b" ").split(b" ") if w]
        runs = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64(x, seed=42).intdigest() for x in runs]
        return f"{sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h)) if h else 0:016x}"

    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, texts[1])]
    got = Counter((x.doc_id, x.fingerprint) for x in simhash.simhash_components(spark.createDataFrame(rows, IDS)).collect())
    assert got == Counter((i, by_hand(t)) for i, t in rows)
    of = {(x.doc_id, x.fingerprint): x.component_id for x in simhash.simhash_components(spark.createDataFrame(rows, IDS)).collect()}
    assert of[(None, by_hand(texts[1]))] == 1 and of[(2, by_hand(""))] == 2 == of[(3, by_hand(""))]


def test_wide_radius():
    r = np.random.default_rng(5)
    fps = r.integers(0, 1 << 63, 200, dtype=np.uint64) & np.uint64(0xFFFFFFFFFF)
    for radius in (15, 16, 18, 22, 31):
        rows, bits = simhash.within(fps, radius)
        got = {(int(i), int(j)) for k, i in enumerate(rows) for j in simhash.lanes(bits[k])}
        assert got == {(i, j) for i in range(200) for j in range(200) if i != j and int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_shingle_sets_are_those_of_the_words():
    r = random.Random(24)
    texts = [" ".join(r.choice(["a", "B", "cc", "long" * 7, "日本"]) for _ in range(r.randint(0, 12))) for _ in range(300)] + [None]
    of = {}
    for t, s in zip(texts, simhash.shingles_of(texts, 3)):
        words = (t or "").lower().split()
        runs = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set())
        assert len(runs) == len(s)
        assert of.setdefault(frozenset(runs), s.tobytes()) == s.tobytes()
    assert len(set(of.values())) == len(of)


def test_words_of_equal_polynomials(spark):
    """Words of the Thue-Morse kind, which hash alike as polynomials modulo a power of two."""
    t = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    u = t.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{t} {rest}"), (2, f"{u} {rest}"), (3, f"{u} {rest}"), (4, f"{t[:2048]} {rest}"), (5, f"{u[:2048]} {rest}")], IDS)
    assert {x.doc_id: x.n_removed for x in substring.substring_dedup(df).collect()} == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0}


def test_components_over_rounds(spark, monkeypatch):
    monkeypatch.setattr("sparkveil.llm.common.PIECE", 64)
    r = random.Random(25)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(150)] + [(2000, i) for i in range(2001, 2150)]
    got = dict(tuple(x) for x in connected_components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect())
    nodes, low = least_nodes(*(np.array(c) for c in zip(*[x for x in links if x[0] != x[1]])))
    assert got == dict(zip(nodes.tolist(), low.tolist()))


def test_scratch_goes(spark):
    import os

    linededup.line_dedup(spark.createDataFrame([(1, A)], IDS)).count()
    path = scratch_folder(spark).removeprefix("file:").replace("//", "/", 1) if scratch_folder(spark).startswith("file://") else scratch_folder(spark)
    assert os.path.isdir(path) and release_scratch(spark) and not os.path.isdir(path)


def test_viterbi_by_enumeration():
    r = random.Random(26)
    for _ in range(200):
        n = r.randint(1, 7)
        moves = [[r.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
        ends = [r.uniform(-1, 1) for _ in range(2)]
        scores = [r.uniform(-2, 2) for _ in range(n)]
        value = lambda y: ends[y[0]] + sum(s for s, k in zip(scores, y) if k) + sum(moves[a][b] for a, b in itertools.pairwise(y))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert html.Chain({}, moves, ends).decode(scores) == list(best)
    assert html.Chain({}, [[0, 0], [0, 0]], [0, 0]).decode([]) == []


def test_training_climbs_the_likelihood():
    """Gradients end where small steps to either side lose: on one page of two blocks, by trying them."""
    page = [("<p>alpha one</p><div>beta two</div>", [(1, "alpha one"), (0, "beta two")])]
    chain = html.train(page * 4, epochs=200, decay=0.0)
    assert chain.extract(page[0][0]) == "alpha one"


HAND = """<!doctype html><html><head><title>News &amp; more</title><style>p{}</style></head><body>
<div id="header"><a href="/">Home</a> <a href="/b">Business</a></div>
<nav><ul><li><a href=1>World</a><li><a href=2>Sport</a></ul></nav>
<article><h1>Rain &mdash; at last</h1><p>After ten dry weeks, rain fell over the hills on Monday, and farmers were glad of it.</p>
<p>The river, which had been <b>very low</b>,<br>rose by two metres in a night, the agency said.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=3>More rain to come</a></ul></aside>
<form><label>Your mail</label><input name=m><button>Subscribe</button></form>
<div class="comments"><p>I do not believe a word of it!</p></div>
<footer>&copy; 2024 The Paper. All rights reserved.</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_page_labelled_by_hand():
    got = html.default_chain().extract(HAND)
    assert got == "Rain — at last\n\nAfter ten dry weeks, rain fell over the hills on Monday, and farmers were glad of it.\n\nThe river, which had been very low, rose by two metres in a night, the agency said."


def test_hostile_pages():
    import time

    deep = html.leaf_blocks('<div class="content">' * 10_000 + "<p>x</p>" + "</div>" * 9_999 + "<p>y</p></div><p>z")
    assert [b[1] for b in deep] == ["x", "y", "z"] and ["w=content" in b[0] for b in deep] == [True, True, False]
    for part in ("<a b", '<p title="x', "<div>x", "<b><span></li>", "<p a='\"'", "<!--", "<script>", "</p>", "&amp;", "<p><a>"):
        at = time.perf_counter()
        html.leaf_blocks(part * (200_000 // len(part)), lambda f, d: d)
        assert time.perf_counter() - at < 5, part


def test_pages_of_many_kinds(spark):
    rows = [(1, "u", HAND), (1, "u", HAND), (2, None, None), (None, "", ""), (3, "v", "<")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = Counter((x.page_id, x.url, x.text) for x in html.extract_text(df).collect())
    text = html.default_chain().extract(HAND)
    assert got == Counter([(1, "u", text)] * 2 + [(2, None, ""), (None, "", ""), (3, "v", html.default_chain().extract("<"))])
    assert html.extract_text(df.limit(0)).count() == 0


def test_language_by_hand(spark):
    """N-gram sets of the learned texts, kept exactly, in place of the filters."""
    r = random.Random(27)
    alphabets = {"xx": "abcdefgh", "yy": "efghijkl", "zz": "ijklmnop"}
    made = lambda k, n: " ".join("".join(r.choice(alphabets[k]) for _ in range(r.randint(2, 6))) for _ in range(n))
    rows = [(i, made(k, r.randint(2, 40)), k) for i, k in enumerate(list(alphabets) * 50)] + [(500, None, "xx"), (501, "12!", "yy"), (502, "", None), (3, "ij kl", "zz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("held", langid.fold())
    got = {(x.doc_id, x.text): (x.lang_pred, x.lang_score) for x in langid.identify(df, langid.fit(df.where("not held"))).collect()}

    def grams(text):
        out = Counter()
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            w = f" {w} "
            for n in langid.SIZES:
                out.update(w[i : i + n] for i in range(len(w) - n + 1) if n > 2 or w[i : i + n].strip())
        return out

    learned = {}
    for k in alphabets:
        own = [grams(t) for i, t, lang in rows if lang == k and t and zlib.crc32(str(i).encode()) % 5]
        total = sum(own, Counter())
        learned[k] = {g for g in total if sum(g in o for o in own) >= (2 if len(own) >= 20 else 1)}
    for i, t, _ in rows:
        g = grams(t or "")
        pred, score = got[(i, t)]
        if not g:
            assert (pred, score) == ("und", 0.0)
            continue
        true = {k: sum(n for x, n in g.items() if x in learned[k]) for k in learned}
        best = max(true.values())
        assert true[pred] >= best - 0.02 * sum(g.values()) and abs(score - true[pred] / sum(true.values())) < 0.02


def test_sample_of_languages_is_bounded():
    code = langid.letters_of("abc de" * 30_000)
    h, n = langid.counted(code)
    whole, counts = np.unique(langid.ngrams(code), return_counts=True)
    assert (h == whole).all() and (n == counts).all()


def test_flow_by_search():
    r = random.Random(28)
    for _ in range(30):
        n, m = r.randint(1, 3), r.randint(1, 3)
        supply = [r.randint(0, 4) for _ in range(n)]
        cuts = sorted(r.randint(0, sum(supply)) for _ in range(m - 1))
        demand = [b - a for a, b in zip([0, *cuts], [*cuts, sum(supply)])]
        flow = sharding.min_cost_flow(supply, demand, lambda i, j: int(i != j))
        assert all(sum(v for (a, _), v in flow.items() if a == i) == supply[i] for i in range(n)) and all(sum(v for (_, b), v in flow.items() if b == j) == demand[j] for j in range(m))
        cells = [(i, j) for i in range(n) for j in range(m)]

        def least(k, left, room):
            if k == len(cells):
                return 0 if not any(left) else 10**9
            i, j = cells[k]
            return min(v * (i != j) + least(k + 1, [x - v * (a == i) for a, x in enumerate(left)], [x - v * (b == j) for b, x in enumerate(room)]) for v in range(min(left[i], room[j]) + 1))

        assert sum(v for (i, j), v in flow.items() if i != j) == least(0, supply, demand)


def test_shards_by_hand(spark):
    rows = [(i if i % 9 else None, "é" * (i % 17) if i % 7 else None, [0, 1, 2, None, 9][i % 5]) for i in range(300)] + [(4, "r", 1), (4, "r", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, old int")
    got = sharding.reshard(df, 5, 3, 16, old_col="old").collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((x.doc_id, x.size, x.text_crc32, x.old_shard) for x in got) == Counter((i, size(t), zlib.crc32((t or "").encode()), o if o in (0, 1, 2) else None) for i, t, o in rows)
    total = sum(size(t) for _, t, _ in rows)
    for s in range(5):
        own = [x for x in got if x.shard == s]
        assert sorted(x.slot for x in own) == list(range(len(own))) and abs(sum(x.size for x in own) - total / 5) <= 2 * 42


def test_sketches_by_hand(spark):
    """near_next, containment and merged sketches from whole shingle sets; more shingles than a sketch holds."""
    r = random.Random(29)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(r.choice(words) for _ in range(900))
    texts = {None: "null id", 1: long, 2: long[: len(long) // 2], 3: "a b c d e f", 4: "", 5: None, 6: "a b c d e f"}
    df = spark.createDataFrame(list(texts.items()) + [(6, "a b c d e f")], IDS).repartition(3)
    got = sketch.edited_fingerprints(df).collect()
    shingles = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set()
    order = [None, 1, 2, 3, 4, 5, 6, 6]
    assert sorted(x.doc_id or 0 for x in got) == [x or 0 for x in order]
    for i, j in itertools.pairwise(order):
        a, b = shingles(texts[i]), shingles(texts[j])
        want = len(a & b) / len(a | b) if a | b else 1.0
        assert any(abs(x.near_next - want) < 0.13 for x in got if x.doc_id == i)
    pair = spark.createDataFrame([(long, texts[2])], "a string, b string").select(sketch.containment(sketch.sketch(F.col("b")), sketch.sketch(F.col("a"))), sketch.distinct_shingles(sketch.sketch(F.col("a")))).first()
    assert pair[0] > 0.8 and abs(pair[1] - len(shingles(long))) < 0.3 * len(shingles(long))
    parts = spark.createDataFrame([(1, long), (1, texts[2]), (2, ""), (None, "a b c d e f g")], "k int, t string").select("k", sketch.sketch(F.col("t")).alias("s"))
    merged = {x.k: x.s for x in sketch.merged_sketches(parts, "k", "s").collect()}
    assert merged[2] == [] and len(merged[None]) == 3
    assert merged[1] == sorted(set(parts.where("k = 1").select(F.explode("s")).distinct().toPandas().col))[: sketch.K]


def test_null_ids_in_ranges(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id") * F.col("id")).alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    got = sketch.edited_fingerprints(df, k=4).select("doc_id", "near_next").count()
    rows = sketch.with_next(df, most=100)
    sizes = [x["count"] for x in rows.groupBy("bucket").count().collect()]
    assert got == 4000 and len(sizes) > 20 and max(sizes) < 300


@pytest.mark.parametrize("radius", [3, None])
def test_very_long_and_empty_lines(spark, radius):
    long = " ".join(str(i) for i in range(40_000))
    rows = [(1, "\n\n" + long + "\n" + "字" * 5000), (2, long + " x\n\n" + "字" * 4999 + "漢"), (3, "\r\n \n")]
    got = {x.doc_id: (x.text, x.n_removed) for x in linededup.line_dedup(spark.createDataFrame(rows, IDS), radius).collect()}
    assert got[1] == (rows[0][1], 0) and got[3] == (rows[2][1], 0) and got[2][1] >= 1


def test_packing_rows_without_ids(spark):
    rows = [(None, "one two"), (None, "three"), (2, "four"), (2, "four"), (3, None)]
    out = packing.pack(spark.createDataFrame(rows, IDS), length=8).collect()
    assert sum(x.length for x in out) == sum(x.doc_tokens for x in out if x.start == 0)
    assert Counter(x.doc_id for x in out if x.start == 0) == Counter([None, None, 2, 2, 3])


def test_hash_of_edited_text(spark):
    rows = [(2, "日本語ab"), (1, "xyz")]
    got = {x.doc_id: x.edited_sha256 for x in sketch.edited_fingerprints(spark.createDataFrame(rows, IDS)).collect()}
    assert got == {1: hashlib.sha256("xy日".encode()).hexdigest(), 2: hashlib.sha256("日本語xy".encode()).hexdigest()}


def test_pipeline_by_hand(spark, tmp_path):
    """Every stage against the rows that plain Python makes of what the stage before it kept; null ids and a column that clashes among them."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(31)
    made = lambda n: " ".join("".join(r.choice("ka lo mi ten rus".split()) for _ in range(r.randint(1, 3))) for _ in range(n))
    texts = ["\n".join(made(r.randint(12, 30)) for _ in range(3)) for _ in range(40)]
    shared = made(20)
    texts += [texts[3], texts[4] + " lo", shared + "\n" + made(25), made(22) + "\n" + shared, shared, "12 34 !", None, ""]
    texts += [texts[5].replace("\n", " ") + " mi", texts[5].replace("\n", " ")]
    rows = [(i if i != 44 else None, t, "en", ["a", "b", None][i % 3] if i % 7 else "c", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("row", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    docs, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name)), [tuple(x) for x in out.collect()]

    docs, got = step("language", docs)
    kept = [x for x in rows if x[1] and any(c.isalpha() for c in x[1])]
    assert Counter(got) == Counter(kept)
    docs, got = step("lines", docs)
    last = 1 << 62
    left = lines_by_hand([(last if x[0] is None else x[0], x[1]) for x in kept], 0.8)
    kept = [(i, t, *x[2:4], len(t)) for x in kept for i, t in [(x[0], left[last if x[0] is None else x[0]])] if t.strip()]
    assert Counter(got) == Counter(kept)
    docs, got = step("near", docs)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (x[1].lower().split() for x in kept)]
    low = list(range(len(kept)))
    for i, j in itertools.combinations(range(len(kept)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            old, new = low[j], low[i]
            low = [new if x == old else x for x in low]
    first = {}
    for x, g in zip(kept, low):
        first[g] = min(first.get(g, x), x, key=lambda y: last if y[0] is None else y[0])
    kept = list(first.values())
    assert Counter(got) == Counter(kept) and len(kept) < len(low)
    docs, got = step("mix", docs)
    n = Counter(x[3] for x in kept)
    weight = sum(v**0.5 for v in n.values())
    want = Counter()
    for x in kept:
        rate = n[x[3]] ** 0.5 / weight * len(kept) / n[x[3]]
        u = (int(hashlib.md5(f"mix|{'' if x[0] is None else x[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        times, p, total = 0, np.exp(-rate), np.exp(-rate)
        while total <= u:
            times += 1
            p *= rate / times
            total += p
        want[x] += times
    assert Counter(got) == +want
    _, got = step("pack", docs)
    t = Tokenizer.from_file(packing.default_vocabulary())
    sizes = Counter()
    for x, k in want.items():
        sizes[(x[0], len(t.encode(x[1], add_special_tokens=False).ids) + 1)] += k
    assert Counter((x[0], x[4]) for x in got if x[1] == 0) == +sizes
    assert sum(x[2] for x in got) == sum(size * k for (_, size), k in sizes.items()) and max(x[6] + x[2] for x in got) <= 4096
