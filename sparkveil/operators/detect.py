"""Detection, overlap resolution and rewriting: no shuffle, one pass over a text.

A text goes through one Arrow function that searches it with every detector whose signs it has, resolves overlaps in one pass over the sorted
candidates, and returns the spans kept and the gaps between them; what becomes of a span is a column expression over these.
Time is linear in the number of spans, plans stay small, and a repetition of groups costs no Java stack. The function is marked as not
deterministic, so that no filter on its result is pushed below it to run it twice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.detectors import Detector, Registry, default_registry
from ..functions.regex import check, compiled, to_java

_SPAN = "array<struct<start:int,nlen:int,nprio:int,type:string,original:string,placeholder:string,confidence:double>>"
_KEPT = "array<struct<type:string,start:int,end:int,original:string,placeholder:string,confidence:double,context:string>>"
_FOUND = f"struct<gaps:array<string>,spans:{_KEPT}>"
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("nlen", pa.int32()), ("nprio", pa.int32()), ("type", pa.string()), ("original", pa.string()), ("placeholder", pa.string()), ("confidence", pa.float64())]))
_KEPT_ARROW = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("original", pa.string()), ("placeholder", pa.string()), ("confidence", pa.float64()), ("context", pa.string())]))
_FOUND_ARROW = pa.struct([("gaps", pa.list_(pa.string())), ("spans", _KEPT_ARROW)])
_DIGIT = re.compile("[0-9]")
#: Bytes of context to each side of a span.
WINDOW = 20


@dataclass(frozen=True)
class CustomPattern:
    """A pattern of one request: it adds spans of type ``custom`` but leaves the text as it is."""

    name: str
    pattern: str
    replacement: str = ""
    confidence: float = 0.0
    description: str = ""


def may_match(text: Column, detector: Detector) -> Column:
    """Cheap conditions first, the pattern last."""
    hit = F.rlike(text, F.lit(to_java(detector.regex)))
    if detector.needs is None:
        return F.rlike(text, F.lit("[0-9]")) & hit
    need = None
    for sign in detector.needs:
        need = text.contains(sign) if need is None else need | text.contains(sign)
    return hit if need is None else need & hit


def matches(text: Column, detector: Detector) -> Column:
    """All leftmost matches that do not overlap, as strings; null for a null text."""
    return F.when(may_match(text, detector), F.regexp_extract_all(text, F.lit(to_java(detector.regex)), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def search(text: str, registry: Registry) -> list[tuple]:
    """Spans of all detectors, ordered by start, the longer first, the higher priority first, then by type: start, -length, -priority, type, original, placeholder, confidence, in characters."""
    out, digit = [], _DIGIT.search(text) is not None
    for d in registry.detectors:
        if d.needs is None and not digit or d.needs and not any(sign in text for sign in d.needs):
            continue
        for m in compiled(d.regex, d.trusted)(text):
            if m.end() > m.start():
                out.append((m.start(), m.start() - m.end(), -d.priority, d.kind, m.group(), d.placeholder, d.confidence))
    out.sort(key=lambda s: s[:4])
    return out


def fold(spans: list[tuple]) -> list[tuple]:
    """Disjoint spans of sorted ones. Each candidate meets the last one kept: it is added if it begins at or after its end, takes its place if it is longer, or as long and of higher priority, and else goes."""
    kept: list[tuple] = []
    for s in spans:
        if not kept or s[0] >= kept[-1][0] - kept[-1][1]:
            kept.append(s)
        elif s[1:3] < kept[-1][1:3]:
            kept[-1] = s
    return kept


def found(text: str, spans: list[tuple]) -> dict:
    """The gaps between disjoint ascending spans, and the spans with byte offsets and context."""
    gaps, out, at = [], [], 0
    raw = text.encode("utf-8", "surrogatepass") if spans else b""
    place = 0  # bytes up to ``at``
    for start, nlen, _, kind, original, shown, confidence in spans:
        gap = text[at:start]
        gaps.append(gap)
        first = place + len(gap.encode("utf-8", "surrogatepass"))
        place = first + len(original.encode("utf-8", "surrogatepass"))
        at = start - nlen
        context = raw[max(0, first - WINDOW) : place + WINDOW].decode("utf-8", "replace")
        out.append({"type": kind, "start": first, "end": place, "original": original, "placeholder": shown, "confidence": confidence, "context": context})
    gaps.append(text[at:])
    return {"gaps": gaps, "spans": out}


def _as_dicts(spans: list[tuple]) -> list[dict]:
    names = ("start", "nlen", "nprio", "type", "original", "placeholder", "confidence")
    return [dict(zip(names, s)) for s in spans]


def candidates(text: Column, registry: Registry) -> Column:
    """All detectors' spans in the order of ``search``; null for a null text."""

    @F.arrow_udf(_SPAN)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _as_dicts(search(t, registry)) for t in texts.to_pylist()], _SPAN_ARROW)

    return run.asNondeterministic()(text)


def resolve(spans: Column) -> Column:
    """Disjoint spans of sorted ones, as ``fold`` has it."""

    @F.arrow_udf(_SPAN)
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else _as_dicts(fold([tuple(s.values()) for s in r])) for r in rows.to_pylist()], _SPAN_ARROW)

    return run.asNondeterministic()(spans)


def spans_of(text: Column, registry: Registry) -> Column:
    """A struct of ``gaps`` and resolved ``spans`` of a text; null for a null text."""

    @F.arrow_udf(_FOUND)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else found(t, fold(search(t, registry))) for t in texts.to_pylist()], _FOUND_ARROW)

    return run.asNondeterministic()(text)


def rewrite(text: Column, parts: Column, replacement=lambda s: s["placeholder"]) -> Column:
    """The text with the spans of ``parts``, as from ``spans_of``, replaced."""
    each = F.transform(F.arrays_zip(parts["gaps"], parts["spans"]), lambda x: F.concat(x["gaps"], F.when(x["spans"].isNull(), "").otherwise(replacement(x["spans"]))))
    return F.when(F.size(parts["spans"]) == 0, text).otherwise(F.array_join(each, ""))


def reported(parts: Column) -> Column:
    """Spans as a result reports them: byte offsets, placeholder, confidence and context, from the last to the first."""
    keep = ("type", "start", "end", "original")
    return F.reverse(F.transform(parts["spans"], lambda s: F.struct(*[s[k].alias(k) for k in keep], s["placeholder"].alias("replacement"), s["confidence"].alias("confidence"), s["context"].alias("context"))))


#: What a span becomes in each mode beyond plain replacement; the plain engine treats all modes as ``replace``.
MODES = {
    "replace": lambda s: s["placeholder"],
    "mask": lambda s: F.repeat(F.lit("*"), F.char_length(s["original"])),
    "remove": lambda s: F.lit(""),
    "hash": lambda s: F.sha2(s["original"].cast("binary"), 256),
    "tokenize": lambda s: F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat_ws("|", s["type"], s["original"]).cast("binary"), 256), 1, 32)),
}


def rewrite_texts(df: DataFrame, text_col: str = "text", registry: Registry | None = None, custom: tuple[CustomPattern, ...] = (), mode: str = "replace", effective_modes: bool = False, apply_custom: bool = False, strict: bool = True, key: str | None = None) -> DataFrame:
    """``df`` with ``redacted_text``, ``redactions`` and ``n_spans`` (columns of these names are replaced, all others are carried along).

    A null text gives nulls. A text beyond the registry's byte limit raises an error, or with ``strict=False`` gives nulls
    and ``too_long``. ``mode`` changes nothing unless ``effective_modes`` is set; ``encrypt`` then needs ``key`` (16, 24 or 32 bytes). ``custom`` patterns are looked for in the rewritten text and
    reported after the others; invalid ones are skipped; only ``apply_custom`` lets them change the text.
    """
    registry = registry or default_registry()
    new = ["redacted_text", "redactions", "n_spans", *([] if strict else ["too_long"])]
    names = [c for c in df.columns if c not in new]
    source = F.col(f"`{text_col}`").cast("string")
    long = F.octet_length(source) > registry.max_text_length
    guarded = F.when(~long, source).when(long & F.lit(strict), F.raise_error(F.lit("text exceeds the maximum length")).cast("string"))
    use = MODES["replace"]
    if effective_modes:
        use = (lambda s: F.base64(F.aes_encrypt(s["original"], F.lit(key), F.lit("ECB")))) if mode == "encrypt" else MODES[mode]
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None)
    out = df.select(row.alias("row"), guarded.alias("text"), F.coalesce(long, F.lit(False)).alias("too_long"))
    out = out.withColumn("parts", spans_of(F.col("text"), registry))
    out = out.select("row", "too_long", rewrite(F.col("text"), F.col("parts"), use).alias("redacted_text"), reported(F.col("parts")).alias("redactions"))
    for c in custom:
        try:
            check(c.pattern)
        except ValueError:
            continue
        one = Registry((Detector("custom", c.pattern, 30, c.replacement or "[CUSTOM_REDACTED]", c.confidence),), registry.max_text_length)
        out = out.withColumn("parts", spans_of(F.col("redacted_text"), one))
        out = out.withColumn("redactions", F.concat("redactions", reported(F.col("parts"))))
        if apply_custom:
            out = out.withColumn("redacted_text", rewrite(F.col("redacted_text"), F.col("parts")))
        out = out.drop("parts")
    out = out.withColumn("n_spans", F.size("redactions"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], *new)


def explode_spans(redacted: DataFrame, *keep: str) -> DataFrame:
    """A row for each reported span."""
    return redacted.select(*keep, F.explode("redactions").alias("s")).select(*keep, "s.*")


def stats_by_type(redacted: DataFrame, *keys: str) -> DataFrame:
    return explode_spans(redacted, *keys).groupBy(*keys, "type").agg(F.count("*").alias("n"))


def capabilities(spark, registry: Registry | None = None) -> DataFrame:
    registry = registry or default_registry()
    kinds = [d.kind for d in registry.detectors]
    modes = ["replace", "mask", "remove", "tokenize", "hash", "encrypt"]
    return spark.createDataFrame([("sparkveil", "0.1.0", kinds, modes, True, True, True, registry.max_text_length)], "name string, version string, supported_types array<string>, supported_modes array<string>, reversible boolean, custom_patterns boolean, policies boolean, max_text_length int")
