"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct 40-bit hashes of a text's
five-word shingles. Sketches of parts merge into the sketch of the whole, and two sketches
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 128
WORDS = 5
BITS = 40


def bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The sketch of a text: shingles of ``words`` words (runs of other than ASCII white space); fewer words make one shingle, none an empty sketch. Null: as empty."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return sketch_of_hashes(F.transform(parts, lambda w: F.xxhash64(w)), k, words)


def sketch_of_hashes(hashes: Column, k: int = K, words: int = WORDS) -> Column:
    """The same from the array of a text's word hashes."""

    def runs(h: Column) -> Column:
        last = F.size(h) - words
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(words)]), 64 - BITS))
        few = F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))
        every = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(last < 0, few).otherwise(each)
        return F.slice(F.sort_array(F.array_distinct(every)), 1, k)

    return bind(hashes, runs)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets from their sketches."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union's shingles that both have, 0 to 1; two empty sketches: 1."""
    return bind(merge(a, b, k), lambda union: F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * (2.0**BITS) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too, 0 to 1; an empty ``a``: 1."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    """A sketch as text: 10 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def merged_sketches(parts: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """``(key, column)``: the sketch of each key's parts together.

    Every hash is a row; only the ``k`` least of a key leave any task (a rank within the key is cut before the exchange), so a hot key burdens no task. A key
    whose sketches are all null or empty has the empty one; null is a key like any other.
    """
    each = parts.select(F.col(f"`{key}`").alias("k"), F.explode_outer(F.col(f"`{column}`")).alias("h")).distinct()
    least = each.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.col("h").asc_nulls_last()))).where(F.col("n") <= k)
    return least.groupBy("k").agg(F.sort_array(F.collect_list("h")).alias("h")).select(F.col("k").alias(key), F.col("h").alias(column))


#: Quantiles of the ids that bound the ranges; a power of two.
QUANTILES = 4096


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1000) -> DataFrame:
    """``(id, text, ghost, bucket)`` where a lead over (bucket, id, ghost) sees the next document by id, and after the last the first.

    Documents fall into ranges of ids whose bounds follow the ids' quantiles, ``QUANTILES`` at most; each range is one
    window group and carries a copy (ghost) of the first document of the next range, so no window
    spans the table. Ranges number ``rows / max(most, sqrt(rows))``; beyond the quantiles they are even steps of the ids. Null ids,
    which come first, fall into ranges of a hash of the text.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    cut = [i / QUANTILES for i in range(QUANTILES + 1)]
    n, marks = base.agg(F.count("*"), F.percentile_approx("id", cut, 50_000)).first()
    ranges = n / max(most, n**0.5)
    step = max(1, round(QUANTILES / max(1, ranges)))  # quantiles a range
    each = max(1, round(ranges / QUANTILES))  # ranges between two quantiles
    marks = marks or [0]
    marks = sorted({*marks[::step], marks[-1]}) if n > most else marks[:1]
    bounds = F.split(F.lit(",".join(map(str, marks))), ",").cast("array<bigint>")
    halves = F.array(*[F.lit(QUANTILES >> i) for i in range(QUANTILES.bit_length())])

    def found(lo: Column, half: Column) -> Column:
        there = (lo + half <= len(marks)) & (F.get(bounds, lo + half - 1) <= F.col("id"))
        return F.when(there, lo + half).otherwise(lo)

    base = base.withColumn("at", F.aggregate(halves, F.lit(0), found))  # how many bounds are not above the id
    low, high = (F.get(bounds, F.col("at") + i).cast("double") for i in (-1, 0))
    inside = F.least(F.lit(each - 1), F.floor((F.col("id") - low) * float(each) / (high - low)))
    place = F.when(F.col("at") == 0, 0).when(F.col("at") == len(marks), 1 + (len(marks) - 1) * each).otherwise(1 + (F.col("at") - 1) * each + inside)
    nulls = max(1, round(ranges))
    by_text = F.floor((F.shiftright(F.xxhash64("text"), 11) + 2**52).cast("double") / 2.0**53 * nulls)  # in the hashes' signed order
    bucket = F.when(F.col("id").isNull(), by_text.cast("bigint") - nulls).otherwise(place)
    base = base.withColumn("bucket", bucket.cast("bigint"))
    first = base.groupBy("bucket").agg(F.min_by(F.struct("id", "text"), F.struct("id", F.xxhash64("text"))).alias("f"))
    names = base.select("bucket").distinct()
    by = Window.orderBy("bucket")
    back = names.select("bucket", F.coalesce(F.lag("bucket").over(by), F.max("bucket").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    ghosts = first.join(back, "bucket").select("f.id", "f.text", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    return base.select("id", "text", "bucket", F.lit(False).alias("ghost")).unionByName(ghosts)


def edited_fingerprints(docs: DataFrame, k: int = K, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The edited text has its last half (of code points, rounded down) replaced by the first as many, or
    all, of the next document by ascending id; after the last comes the first. Null ids come first, rows
    with one id follow each other by a hash of the text. A null text is empty; an empty sketch resembles
    only an empty one; a lone document is its own next one; an empty table gives an empty one.
    """
    by = Window.partitionBy("bucket").orderBy("ghost", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    rows = with_next(docs, id_col, text_col).withColumn("next", F.lead("text").over(by)).withColumn("own", sketch(F.col("text"), k, words))
    rows = rows.withColumn("next_own", F.lead("own").over(by)).where("not ghost")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    rows = rows.withColumn("changed", sketch(F.col("edited"), k, words))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"),
    )
