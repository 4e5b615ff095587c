"""Pattern libraries: parsing, validation, scores, and scans of text with a library's patterns."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.regex import check, compiled

SCHEMA = "id string, name string, category string, regex string, confidence double, description string, examples array<string>, replacement string, enabled boolean"


_KEY = re.compile(r"""("[^"]*"|'[^']*'|[^\s#'"\[{][^:#]*?)\s*:(?:\s+(.*)|)$""")


def _scalar(text: str):
    text = text.strip()
    if text[:1] == "'":
        end = re.match(r"'((?:[^']|'')*)'\s*(?:#.*)?$", text)
        if not end:
            raise ValueError(f"YAML_PARSE_ERROR: {text}")
        return end[1].replace("''", "'")
    if text[:1] == '"':
        end = re.match(r'("(?:[^"\\]|\\.)*")\s*(?:#.*)?$', text)
        if not end:
            raise ValueError(f"YAML_PARSE_ERROR: {text}")
        try:
            return json.loads(end[1])
        except ValueError:
            return re.sub(r"\\(.)", r"\1", end[1][1:-1])
    if text[:1] == "[":
        end = re.match(r"\[(.*)\]\s*(?:#.*)?$", text)
        if not end:
            raise ValueError(f"YAML_PARSE_ERROR: {text}")
        return [_scalar(x) for x in re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+?)\s*(?:,|$)""", end[1])]
    text = re.split(r"(?:^|\s)#", text)[0].strip()
    if text in ("", "~", "null"):
        return {} if text == "{}" else None
    if text == "{}":
        return {}
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse(text: str) -> dict:
    """A library or a configuration from the part of YAML that they are written in: mappings and lists by indentation, lists in brackets, plain and quoted scalars, comments. ValueError (``YAML_PARSE_ERROR``) for anything else."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]
    if any("\t" in x[: len(x) - len(x.lstrip())] for x in text.splitlines()):
        raise ValueError("YAML_PARSE_ERROR: tab in indentation")

    def block(i: int, deep: int):
        """(value, next line) of the block that begins at line i with this indentation."""
        if lines[i][1] == "-" or lines[i][1].startswith("- "):
            out: list = []
            while i < len(lines) and lines[i][0] == deep and (lines[i][1] == "-" or lines[i][1].startswith("- ")):
                rest = lines[i][1][1:].strip()
                if not rest:
                    value, i = block(i + 1, lines[i + 1][0]) if i + 1 < len(lines) and lines[i + 1][0] > deep else (None, i + 1)
                elif _KEY.match(rest):
                    inner = deep + len(lines[i][1]) - len(rest)
                    lines[i] = (inner, rest)
                    value, i = block(i, inner)
                else:
                    value, i = _scalar(rest), i + 1
                out.append(value)
            return out, i
        made: dict = {}
        while i < len(lines) and lines[i][0] == deep:
            m = _KEY.match(lines[i][1])
            if not m:
                raise ValueError(f"YAML_PARSE_ERROR: {lines[i][1]}")
            key, rest = m[1].strip("\"'"), (m[2] or "").strip()
            i += 1
            if rest and not rest.startswith("#"):
                made[key] = _scalar(rest)
            elif i < len(lines) and (lines[i][0] > deep or lines[i][0] == deep and lines[i][1].startswith("- ")):
                made[key], i = block(i, lines[i][0])
            else:
                made[key] = None
        if i < len(lines) and lines[i][0] > deep:
            raise ValueError(f"YAML_PARSE_ERROR: {lines[i][1]}")
        return made, i

    if not lines:
        raise ValueError("YAML_PARSE_ERROR: not a mapping")
    out, end = block(0, lines[0][0])
    if end < len(lines) or not isinstance(out, dict):
        raise ValueError("YAML_PARSE_ERROR: not a mapping")
    return out


def frame(spark: SparkSession, library: dict) -> DataFrame:
    rows = [tuple(p.get(k) if k != "confidence" else float(p.get(k) or 0) for k in ("id", "name", "category", "regex", "confidence", "description", "examples", "replacement", "enabled")) for p in library.get("patterns") or []]
    return spark.createDataFrame(rows, SCHEMA)


def pattern_faults(pattern: dict) -> list[tuple[str, str, str]]:
    """(severity, code, detail) of one pattern, in the order of the checks."""
    out = [("error", f"MISSING_{k.upper()}", k) for k in ("id", "name", "category", "regex") if not pattern.get(k)]
    regex = pattern.get("regex") or ""
    good = False
    if regex:
        try:
            check(regex)
            good = True
        except ValueError:
            out.append(("error", "INVALID_REGEX", regex))
    if not 0 <= float(pattern.get("confidence") or 0) <= 1:
        out.append(("error", "INVALID_CONFIDENCE", str(pattern.get("confidence"))))
    if good:
        out += [("warning", "EXAMPLE_MISMATCH", str(k)) for k, e in enumerate(pattern.get("examples") or [], 1) if not any(True for _ in compiled(regex)(str(e)))]
    if not pattern.get("replacement"):
        out.append(("warning", "MISSING_REPLACEMENT", ""))
    if ".*.*" in regex or ".+.+" in regex:
        out.append(("warning", "PERFORMANCE_RISK", ""))
    if regex in (".*", ".+"):
        out.append(("warning", "BROAD_PATTERN", ""))
    if regex.count("|") > 10:
        out.append(("warning", "COMPLEX_ALTERNATION", str(regex.count("|"))))
    return out


def validate(library: dict) -> dict:
    """Faults and statistics of a library."""
    faults = [("warning", f"MISSING_{k.upper()}", "") for k in ("version", "framework", "description") if not library.get(k)]
    patterns = library.get("patterns") or []
    if not patterns:
        faults.append(("error", "NO_PATTERNS", ""))
    seen: set = set()
    for p in patterns:
        if p.get("id") in seen:
            faults.append(("error", "DUPLICATE_ID", str(p.get("id"))))
        seen.add(p.get("id"))
        faults += pattern_faults(p)
    meta = library.get("metadata") or {}
    errors, warnings = (sum(f[0] == s for f in faults) for s in ("error", "warning"))
    with_examples = sum(bool(p.get("examples")) for p in patterns)
    score = min(1.0, max(0.0, 1 - 0.1 * errors - 0.02 * warnings + 0.1 * with_examples / len(patterns))) if patterns else 0.0
    bands: dict[str, int] = {}
    categories: dict[str, int] = {}
    for p in patterns:
        c = float(p.get("confidence") or 0)
        band = "high" if c >= 0.9 else "medium" if c >= 0.7 else "low" if c >= 0.5 else "very_low"
        bands[band] = bands.get(band, 0) + 1
        categories[p.get("category") or ""] = categories.get(p.get("category") or "", 0) + 1
    stats = {"total": len(patterns), "enabled": sum(bool(p.get("enabled")) for p in patterns), "categories": categories, "confidence_levels": bands, "compliance_score": score, "coverage": {"categories": len(categories), **({"compliance_frameworks": meta["compliance_frameworks"]} if "compliance_frameworks" in meta else {})}}
    return {"valid": not errors, "errors": [f for f in faults if f[0] == "error"], "warnings": [f for f in faults if f[0] == "warning"], "statistics": stats}


def score_patterns(patterns: DataFrame, examples_match: Column | None = None) -> DataFrame:
    """A row of statistics of a patterns table: counts, bands, share with examples."""
    c = F.col("confidence")
    n = lambda cond: F.sum(cond.cast("bigint"))
    return patterns.agg(
        F.count("*").alias("total"), n(F.col("enabled")).alias("enabled"), F.countDistinct("category").alias("categories"),
        n(c >= 0.9).alias("high"), n((c >= 0.7) & (c < 0.9)).alias("medium"), n((c >= 0.5) & (c < 0.7)).alias("low"), n(c < 0.5).alias("very_low"),
        n(F.length("regex") - F.length(F.regexp_replace("regex", r"\|", "")) > 10).alias("complex"),
    )


def scan(df: DataFrame, patterns: list[tuple[str, str]], text_col: str = "text", *keep: str, trusted: bool = False) -> DataFrame:
    """``(*keep, pattern, n)``: matches of each (id, regex) in each text that has some; one pass over the table for all patterns. Patterns that are not ``trusted`` end the query if they take too long over a text."""

    @F.arrow_udf("array<struct<pattern:string,n:int>>")
    def count(texts: pa.Array) -> pa.Array:
        finds = [(i, compiled(regex, trusted)) for i, regex in patterns]
        rows = [[] if t is None else [{"pattern": i, "n": n} for i, find in finds if (n := sum(1 for _ in find(t)))] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("pattern", pa.string()), ("n", pa.int32())])))

    found = df.select(*keep, count.asNondeterministic()(F.col(text_col).cast("string")).alias("found"))
    return found.select(*keep, F.explode("found").alias("c")).select(*keep, "c.pattern", "c.n")
