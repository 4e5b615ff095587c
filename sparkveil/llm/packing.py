"""Packing by concatenate and cut: two-pass prefix sums, then fixed windows.

The first pass turns documents into token ids and notes, for each, the partition it is in and
the tokens before it there. The second adds up the partitions' totals (a row for each
partition), which gives every document its offset in one endless run of ids; cutting that run
at every ``length`` ids is then local to a row, and a document that crosses cuts gives a
boundary record for each sequence it touches. Only the last sequence has padding.
"""

from __future__ import annotations

import functools
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise

END_ID = 2
CACHE = 400_000
_TAIL = b".,;:!?*#$%&()[]{}-+=/\"<>|~^_`@\\"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """Token ids of whole texts as little-endian 16-bit integers, by words.

    The vocabulary's normaliser and splitter treat ASCII white space as an end of a word, ignore ASCII
    case and cut between letters and other signs, so a text's ids are those of its words, and a word's
    are those of its stem and of the signs after it. A stem of ASCII letters goes to the tokenizer's
    model at once, other words go through the whole tokenizer. Words met before come from two tables of
    a bounded size: as one is full it takes the place of the older one, from which words in use are taken over.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}
        self.cache = cache

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            stem = word.rstrip(_TAIL)
            if not stem.isalpha() or b"<|" in word:
                ids = _packed(self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids)
            elif stem == word:
                ids = _packed([t.id for t in self.model.tokenize(word.decode("ascii"))])
            else:
                ids = self[stem] + self[word[len(stem) :]]
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if len(self) > self.cache:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8").lower().split()))


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@functools.cache
def encoder(path: str, cache: int = CACHE) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(path, cache)


def token_table(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """``(id, part, before, n, ids)``: 16-bit ids of every whole text and ``end_id``, the partition and the ids before it there."""
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        words, part, before = encoder(path, cache), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # so many bytes at a time
                size, to = 0, at
                while to < batch.num_rows and (to == at or size < 2_000_000):
                    size += batch.column(1)[to].as_buffer().size if batch.column(1)[to].is_valid else 0
                    to += 1
                ids = [words.encode(t.as_py()) + end for t in batch.column(1).slice(at, to - at)]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(np.full(len(n), part), pa.int32()), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], names=["id", "part", "before", "n", "ids"])
                at = to

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, part int, before bigint, n bigint, ids binary")


def pack(docs: DataFrame, length: int = 4096, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, and the ids themselves on demand.

    Every row of ``docs`` is packed, repeated ones too; a null or empty text is the end id alone;
    other columns are not looked at; an empty table gives no pieces. ``cache``: words that each of a worker's two tables holds.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    table = materialise(token_table(docs, vocabulary, end_id, id_col, text_col, cache))
    totals = table.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = materialise(totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("ahead")))  # a row a partition; written, its size is known
    size = length

    def run(batches):
        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            ids, n, first = cols["ids"].to_pylist(), cols["n"].to_pylist(), (np.array(cols["before"]) + np.array(cols["ahead"])).tolist()
            row, start, count, crc, sequence, offset, kept = [], [], [], [], [], [], []
            for k in range(batch.num_rows):
                wide, at = np.frombuffer(ids[k], "<u2").astype("<u4"), 0
                while at < n[k]:
                    s, o = divmod(first[k] + at, size)
                    m = min(size - o, n[k] - at)
                    row.append(k)
                    start.append(at)
                    count.append(m)
                    crc.append(zlib.crc32(piece := wide[at : at + m].tobytes()))
                    sequence.append(s)
                    offset.append(o)
                    if with_ids:
                        kept.append(piece)
                    at += m
            out = [cols["id"].take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, count, crc)), cols["n"].take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (sequence, offset))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.record_batch(out, names=names)

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    return table.join(ahead, "part").select("id", "before", "ahead", "n", "ids").mapInArrow(run, schema).withColumnRenamed("id", id_col)
