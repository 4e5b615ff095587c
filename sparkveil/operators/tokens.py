"""Reversible tokens: issue, restore, clean up and count them, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.detectors import Registry, default_registry


def issue(redacted: DataFrame, text_col: str, created: Column, ttl_seconds: int = 86_400, salt: str | None = None) -> DataFrame:
    """``(token, original_text, redaction_type, created, expires)`` for the rows with spans. The type is that of the first reported span, the last in the text.

    A token has 32 hexadecimal digits: random, or with ``salt`` those of a SHA-256 of the text, which tests and retries can repeat.
    A TTL of 0 means a day.
    """
    token = F.substring(F.sha2(F.concat(F.col(text_col), F.lit(salt)).cast("binary"), 256), 1, 32) if salt is not None else F.replace(F.uuid(), F.lit("-"))
    life = ttl_seconds or 86_400
    return redacted.where("n_spans > 0").select(token.alias("token"), F.col(text_col).alias("original_text"), F.col("redactions")[0]["type"].alias("redaction_type"), created.alias("created"), (created + F.make_dt_interval(secs=F.lit(float(life)))).alias("expires"))


def restore(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """``(token, original_text, status)`` for each wanted token; expired ones work until they are cleaned up, unknown ones are ``invalid``."""
    return wanted.select("token").join(store.select("token", "original_text"), "token", "left").withColumn("status", F.when(F.col("original_text").isNull(), "invalid").otherwise("restored"))


def cleanup(store: DataFrame, now: Column) -> DataFrame:
    """What is left: tokens that do not expire before ``now``."""
    return store.where(~(now > F.col("expires")))


def stats(store: DataFrame) -> DataFrame:
    return store.groupBy("redaction_type").agg(F.count("*").alias("n"))


def summary(store: DataFrame, registry: Registry | None = None) -> DataFrame:
    """A row with ``total_tokens``, ``active_patterns`` and ``tokens_by_type``, a map."""
    each = store.groupBy("redaction_type").agg(F.count("*").alias("n"))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("redaction_type", "n")))).alias("tokens_by_type"))
    return total.select("total_tokens", F.lit(len((registry or default_registry()).detectors)).alias("active_patterns"), "tokens_by_type")


def rotate_keys(store: DataFrame) -> DataFrame:
    """The store as it is: tokens are random names of rows, not ciphertext, so a change of keys leaves nothing to be done."""
    return store
