"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the mix over its share of the corpus.
Each document draws how often it appears by inverting the Poisson distribution of that mean
at a number in (0, 1) that a hash of the seed and its id gives; it is exploded by that count, and
the copies are dealt to partitions and ordered there by another hash, which is a global shuffle.
Everything is a DataFrame function; the only shuffle of texts is the one asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import carried

#: The mean of one draw at most; a higher rate is the sum of as many draws as it takes.
MAX_RATE = 1000.0
SMALL = 4096


def uniform(seed: str, *cols: Column) -> Column:
    """A number in (0, 1) with 52 bits from the MD5 of the seed and the columns as text."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def poisson_table(rate: Column) -> Column:
    """The distribution function of a Poisson variable of the given mean at 0, 1, ...: as far as 52 bits can tell."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.array(F.exp(-rate)).alias("cdf"), (-rate).alias("log"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(log))).alias("cdf"), log.alias("log"))

    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["cdf"]))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float = 1.0, source_col: str = "source") -> DataFrame:
    """``(source, rate)``: the mean repetitions of each source's documents.

    ``weights`` are target shares by source (sources not named get 0); without them a source's share goes with
    its number of documents to the power ``temperature``. ``total`` is the size of the mix relative to the corpus. A null source
    is a source of its own, which only ``temperature`` can choose.
    """
    n = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.lit(None).cast("map<string,double>")
        n = n.withColumn("w", F.coalesce(F.element_at(named, F.coalesce("source", F.lit(""))), F.lit(0.0)))
    sums = n.agg(F.sum("n").alias("all"), F.sum("w").alias("ws"))
    rate = F.when(F.col("ws") > 0, F.lit(float(total)) * F.col("w") / F.col("ws") * F.col("all") / F.col("n")).otherwise(F.lit(0.0))
    return n.join(F.broadcast(sums)).select("source", rate.alias("rate"))  # one row of sums


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of ``docs`` for each repetition of each document, and ``mix_copy`` (from 0) and ``mix_key``; globally shuffled, ordered by ``mix_key`` in each partition.

    Rows that share an id draw the same count. A null id draws like an empty one. A document whose draw is 0 is not in the mix:
    that is what a rate below 1 asks for. A rate over ``MAX_RATE`` is drawn in parts, by further hashes of the id. Columns named ``mix_copy`` and ``mix_key`` are replaced, others are carried along; an empty
    table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("mix_copy", "mix_key")]
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE).cast("int"))
    table = rates(docs, weights, temperature, total, source_col).withColumn("parts", parts)
    table = table.select("source", "parts", poisson_table(F.col("rate") / F.col("parts")).alias("cdf"))
    source = F.col(f"`{source_col}`").cast("string")
    few = len(docs.select(source.alias("s")).distinct().limit(SMALL + 1).collect()) <= SMALL
    rows = docs.select(carried(docs, names), F.col(f"`{id_col}`").cast("string").alias("id"), source.alias("from"))
    joined = rows.join(F.broadcast(table) if few else table, F.col("from").eqNullSafe(F.col("source")))
    more = F.when(F.col("parts") > 1, F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: uniform(seed + "-more", i, F.col("id")))).otherwise(F.array().cast("array<double>"))
    draws = F.transform(F.concat(F.array(uniform(seed, F.col("id"))), more), lambda u: F.aggregate("cdf", F.lit(0), lambda acc, p: acc + (p <= u).cast("int")))
    times = F.col("times")
    joined = joined.select("row", "id", F.aggregate(draws, F.lit(0), lambda acc, n: acc + n).alias("times"))
    copies = joined.withColumn("mix_copy", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    key = F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce("id", F.lit("")), F.col("mix_copy").cast("string")))
    copies = copies.select(*[F.col("row").getField(c).alias(c) for c in names], "mix_copy", key.alias("mix_key"))
    return copies.repartition("mix_key").sortWithinPartitions("mix_key")


def mix_sql(table: str = "documents", temperature: float = 0.5, total: float = 1.0, seed: str = "mix", columns: str = "doc_id, text, lang, source, n_chars", extra: str = ", mix_copy, mix_key") -> str:
    """DuckDB SQL for ``mix`` without given weights."""
    return f"""
WITH n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {temperature}) AS w FROM {table} GROUP BY source),
rates AS (SELECT source, {float(total)} * w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS p
        FROM rates, range(0, 1200) r(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 40)),
drawn AS (SELECT *, (('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {2**52}.0 AS u FROM {table}),
times AS (SELECT d.* EXCLUDE (u), (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.p <= d.u) AS t FROM drawn d),
copies AS (SELECT * EXCLUDE (t), unnest(range(0, t))::INTEGER AS mix_copy FROM times)
SELECT {columns}{extra} FROM (SELECT *, md5('{seed}-order|' || coalesce(doc_id::VARCHAR, '') || '|' || mix_copy) AS mix_key FROM copies)
"""
