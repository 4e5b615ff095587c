"""Language identification with bit-sliced Bloom filters of character n-grams.

One table holds the Bloom filters of all languages side by side: a row for each hash position,
a bit for each language. A lookup reads the rows of an n-gram's positions and ANDs them, which
gives the bit mask of all languages that contain it. Over a text, the masks' bits are counted
by language; a count ``c`` of ``n`` n-grams with false-positive rate ``f`` stands for
``(c - f n) / (1 - f)`` true members. The largest decides.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import mixed

SIZES = (2, 3, 4, 5)
PROBES = 3
ROWS_LOG2 = 21
SAMPLE_DOCS = 1500
MIN_SHARE = 2e-5
MAX_LANGUAGES = 1024
_STEP = 1 << 16
#: A sample is chosen in steps of one in so many.
_SHARES = 1 << 40


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other signs one 0, with a 0 at both ends; empty without letters."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.where(_letters()[raw], raw, 0)
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    code = code[keep]
    if not len(code):
        return code
    return np.concatenate(([0], code, [0] if code[-1] else [])).astype(np.uint64)


def ngrams(code: np.ndarray, sizes=SIZES) -> np.ndarray:
    """Hashes of all n-grams that lie in one word, its borders included; repeats stay."""
    out = []
    zero = np.concatenate(([0], np.cumsum(code == 0)))
    for n in sizes:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += code[i : i + m]
        if n > 2:
            h = h[zero[n - 1 : n - 1 + m] == zero[1 : 1 + m]]  # no border inside
        else:
            h = h[(code[:m] != 0) | (code[1 : 1 + m] != 0)]
        out.append(mixed(h))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parts_of(code: np.ndarray):
    """The n-grams of a text by parts of ``_STEP`` signs; for each size, parts overlap by less than an n-gram."""
    for at in range(0, len(code), _STEP):
        yield np.concatenate([ngrams(code[max(0, at - k + 1) : at + _STEP], (k,)) for k in SIZES]) if at else ngrams(code[:_STEP])


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and how often it has them."""
    h, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for part in parts_of(code):
        x, m = np.unique(part, return_counts=True)
        h, where = np.unique(np.concatenate((h, x)), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate((n, m)), minlength=len(h)).astype(np.int64)
    return h, n


def positions(h: np.ndarray, k: int, rows_log2: int) -> np.ndarray:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.uint64(k) * step) & np.uint64((1 << rows_log2) - 1)).astype(np.int64)


class Filters:
    """Bloom filters of many languages, sliced by bit: ``table[row, word]`` has a bit for each language."""

    def __init__(self, languages: list[str], prior: list[int], rows_log2: int = ROWS_LOG2):
        self.languages, self.prior, self.rows_log2 = languages, prior, rows_log2
        self.words = -(-len(languages) // 64)
        self.table = np.zeros((1 << rows_log2, self.words), np.uint64)
        self.false = np.zeros(len(languages))

    def add(self, language: int, h: np.ndarray) -> None:
        for k in range(PROBES):
            self.table[positions(h, k, self.rows_log2), language // 64] |= np.uint64(1) << np.uint64(language % 64)

    def close(self) -> None:
        """Settle the false-positive rates: the share of rows that are set, to the number of probes."""
        for i in range(len(self.languages)):
            self.false[i] = float(((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** PROBES

    def compact(self) -> None:
        if len(self.languages) <= 8:
            self.table = self.table.astype(np.uint8)

    def counts(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.languages), np.int64)
        for at in range(0, len(h), _STEP):
            part = h[at : at + _STEP]
            mask = self.table[positions(part, 0, self.rows_log2)]
            for k in range(1, PROBES):
                mask &= self.table[positions(part, k, self.rows_log2)]
            if self.table.dtype == np.uint8:
                seen = np.bincount(mask[:, 0], minlength=256)
                for i in range(len(out)):
                    out[i] += seen[(np.arange(256) >> i) & 1 == 1].sum()
            else:
                for i in range(len(out)):
                    out[i] += int(((mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum())
        return out

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, coverage): the winner's share of all languages' corrected counts, and of the text's n-grams; ``und`` without letters."""
        code = letters_of(text) if text else np.zeros(0)
        if not len(code) or not self.languages:
            return "und", 0.0, 0.0
        n, seen = 0, np.zeros(len(self.languages), np.int64)
        for h in parts_of(code):
            seen += self.counts(h)
            n += len(h)
        true = np.clip((seen - self.false * n) / (1 - self.false), 0, None)
        best = max(range(len(true)), key=lambda i: (true[i], self.prior[i], -i))
        total = float(true.sum())
        return self.languages[best], float(true[best] / total) if total else 0.0, float(min(1.0, true[best] / n)) if n else 0.0


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS, rows_log2: int = ROWS_LOG2, min_share: float = MIN_SHARE, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id") -> Filters:
    """Fit on a bounded sample of the labelled rows of ``docs``: about ``per_language`` whole documents of each language, however many there are, chosen by a hash of id and text.

    An n-gram belongs to a language if it makes up ``min_share`` of the language's sample and stands in two documents there
    (one, if the sample has under 20). Counting is done on the executors, which return each language's n-grams only: at most
    ``2**rows_log2 / 8``, the most frequent first. Null texts and languages are left out. Over ``MAX_LANGUAGES`` languages: ValueError.
    """
    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(order_col).cast("string"), F.col(text_col).cast("string"), F.lit(6)).alias("o")).where("text is not null and lang is not null")
    counts = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = {r["lang"]: r["count"] for r in sorted(counts, key=lambda r: r["lang"])}
    filters = Filters(list(counts), list(counts.values()), rows_log2)
    if not counts:
        return filters
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(_SHARES, per_language * _SHARES // n + 1)))])
    sample = known.where(F.pmod("o", F.lit(_SHARES)) < F.element_at(share, F.col("lang"))).select("lang", "text")
    most = (1 << rows_log2) // 8

    def count(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, n = counted(letters_of(text))
                if len(h):
                    order = np.argsort(h & np.uint64(31), kind="stable")
                    h, n = h[order], n[order]
                    edge = np.searchsorted(h & np.uint64(31), np.arange(33))
                    yield pa.record_batch([pa.array([lang] * 32), pa.array(range(32), pa.int32()), pa.array([h[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()), pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], names=["lang", "part", "grams", "counts"])

    def total(key, table):
        h = np.concatenate([np.frombuffer(b, "<u8") for b in table.column("grams").to_pylist()])
        n = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("counts").to_pylist()]).astype(np.int64)
        h, where = np.unique(h, return_inverse=True)
        docs_with, n_all = np.bincount(where, minlength=len(h)), np.bincount(where, weights=n, minlength=len(h)).astype(np.int64)
        seen = table.num_rows
        keep = np.flatnonzero((docs_with >= (2 if seen >= 20 else 1)) & (n_all >= min_share * n.sum() / 32))
        keep = keep[np.argsort(-n_all[keep], kind="stable")][: most // 32]
        return pa.table([table.column("lang").slice(0, 1), pa.array([h[keep].tobytes()], pa.binary())], names=["lang", "grams"])

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("grams", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    found = sample.mapInArrow(count, schema).groupBy("lang", "part").applyInArrow(total, "lang string, grams binary").collect()
    index = {lang: i for i, lang in enumerate(filters.languages)}
    for r in found:
        filters.add(index[r["lang"]], np.frombuffer(r["grams"], "<u8"))
    filters.close()
    filters.compact()
    return filters


def identify(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``lang_score``, ``lang_cover`` of every whole text (columns of these names are replaced).

    ``und`` with score 0 if a text is null or has no letter, or nothing was learned. Ties go to the language with more
    labelled rows, then to the first by name. The filters are sent once to each executor; their size is fixed by ``rows_log2`` and the number of languages.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(filters)
    names = ["lang_pred", "lang_score", "lang_cover"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    schema = T.StructType(list(docs.schema.fields))
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    for n, t in zip(names, ("string", "double", "double")):
        schema = schema.add(n, t)

    def run(batches):
        model = sent.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(at)]
            new = [pa.array([g[0] for g in got], pa.string()), *(pa.array([g[i] for g in got], pa.float64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.fieldNames())

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema)  # columns are told apart by place


def fold(id_col: str = "doc_id"):
    """The held-out fold: CRC-32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
