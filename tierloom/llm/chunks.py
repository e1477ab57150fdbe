"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of every text: each byte's random number enters a 16-bit sum that shifts by one bit a byte, so the
sum depends on the last 16 bytes alone. A chunk ends where the sum's top bits are zero, so an insertion moves the boundaries
around it and no others. Digests are of two neighbouring chunks each: a chunk is repeated where it stands with its neighbour in
another document, so chance neighbours of common chunks make no run. Runs of repeated chunks make spans, and a span of
`MIN_WORDS` words or `MIN_BYTES` bytes or more is a repeat: a single common word or line is left alone, the words cut off at a
passage's two ends are made up for by a bound lower than the passages wanted (50 words), and scripts without spaces are
measured by their bytes. A passage that stands twice in one document is found in the same way, and told apart as `inner`.

Digests have 64 bits. At 10 ** 13 chunks one of them meets another by chance with a probability of 5 in 10 ** 7; a span needs
several in a row, so such a meeting at most adds a chunk to a span.

The document with the smallest id keeps a repeated chunk (of null ids alone: the one with the least hash); in all others a
repeat's chunks are removed, and so are those that a document repeats within itself. Documents are rows that differ in id or
text: rows equal in both count as one. Null and empty texts have no chunks. A null id is after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, settle, sifted

#: Shortest and longest chunk in bytes, and the bits that must be zero at a boundary (mean distance 2 ** MASK_BITS).
LEAST, MOST, MASK_BITS, SEED = 8, 512, 4, 17
MIN_WORDS, MIN_BYTES = 28, 256
GATHER = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True

_GEAR = np.random.default_rng(SEED).integers(0, 1 << 16, 256, dtype=np.uint16)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Positions after which the gear hash asks for a cut. data: bytes."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):  # sums of 2, 4, 8, 16 bytes, each shifted by its age
        older = h[:-k] << np.uint16(k)
        h = h.copy()
        h[k:] += older
    return np.flatnonzero(h >> np.uint16(16 - MASK_BITS) == 0) + 1


def cuts(text: bytes, at: list[int] | None = None) -> list[int]:
    """Ends of the chunks of a text; at: candidate ends, if already known."""
    n, out, last = len(text), [], 0
    for c in at if at is not None else boundaries(np.frombuffer(text, np.uint8)).tolist():
        if c - last < LEAST:
            continue
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def words_of(text: bytes, ends: list[int]) -> np.ndarray:
    """Words that begin in each chunk, parted by ASCII white space."""
    word = ~_SPACE[np.frombuffer(text, np.uint8)]
    word[1:] &= ~word[:-1] if len(word) > 1 else True
    first = np.concatenate(([0], word.cumsum()))
    return np.diff(first[[0, *ends]])


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (a hash of id and text), digest of a chunk and the next one, and place, for every chunk but the last.

    place: the chunk's number (25 bits), its bytes (10) and words (9), the next chunk's bytes (10) and words (9). The only chunk
    of a text stands alone.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            column, at = b.column(2).cast(pa.binary()), 0
            while at < len(column):
                row, places, digests, size = [], [], [], 0
                while at < len(column) and size < GATHER:
                    text = column[at].as_py() or b""
                    size += len(text)
                    if text:
                        ends = cuts(text)
                        edge, wide, n = [0, *ends], np.diff([0, *ends]), words_of(text, ends)
                        if len(ends) > 1:
                            digests += [digest(text[a:z]) for a, z in zip(edge, edge[2:], strict=False)]
                            places.append((np.arange(len(ends) - 1) << 38) | (wide[:-1] << 28) | (n[:-1] << 19) | (wide[1:] << 9) | n[1:])
                        else:
                            digests.append(digest(text, 1))
                            places.append((wide << 28) | (n << 19))
                        row.append(np.full(len(places[-1]), at))
                    at += 1
                if row:
                    take = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(np.concatenate(places))], names=["id", "key", "digest", "place"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, key long, digest long, place long")


def _bytes(p: int) -> int:
    return p >> 28 & 0x3FF


def _words(p: int) -> int:
    return p >> 19 & 0x1FF


def runs(places: list[int], min_words: int, min_bytes: int) -> list[list[int]]:
    """Runs of neighbouring pairs (indexes into the sorted places) whose chunks have min_words words or min_bytes bytes together."""
    out, run, words, size = [], [], 0, 0
    for i, p in enumerate([*places, None]):
        if run and (p is None or p >> 38 != (places[i - 1] >> 38) + 1):
            last = places[i - 1]
            if words + (last & 0x1FF) >= min_words or size + (last >> 9 & 0x3FF) >= min_bytes:
                out.append(run)
            run, words, size = [], 0, 0
        if p is not None:
            run.append(i)
            words += _words(p)
            size += _bytes(p)
    return out


def _spans(listed: list[dict], min_words: int, min_bytes: int) -> list[dict[int, tuple[int, dict]]]:
    """For each run of the listed pairs its chunks: number -> words and the pair they are of."""
    out = []
    for run in runs([c["place"] for c in listed], min_words, min_bytes):
        own = {}
        for c in (listed[k] for k in run):
            at = c["place"] >> 38
            own.setdefault(at, (_words(c["place"]), c))
            if c["place"] >> 9 & 0x3FF:
                own[at + 1] = (c["place"] & 0x1FF, c)
        out.append(own)
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One row per document with repeats: id, key, spans (their number), words, longest (words of the longest), removed_words,
    inner (words that the document itself has before), first_id (the smallest id that keeps a chunk of the spans) and removed
    (numbers of the chunks to cut)."""
    found = chunks(docs, id_col, text_col)
    shared = found.groupBy("digest").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = settle(shared.select("digest", "first", "least", (F.col("least") != F.col("most")).alias("across")), "repeated")
    listed = F.array_sort(F.collect_set(F.struct("place", "digest", "first", "least", "across"))).alias("chunks")
    per_doc = sifted(found, shared, "digest").join(shared, "digest").groupBy("id", "key").agg(listed)
    kind = per_doc.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (own, key, listed) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                seen, again = set(), []
                for c in listed:
                    if c["digest"] in seen:
                        again.append(c)
                    seen.add(c["digest"])
                spans = _spans([c for c in listed if c["across"]], min_words, min_bytes)
                inner = {at: n for s in _spans(again, min_words, min_bytes) for at, (n, _) in s.items()}
                if spans or inner:
                    kept = lambda c, own=own, key=key: c["least"] == key if c["first"] is None else own is not None and own <= c["first"]
                    gone = inner | {at: n for s in spans for at, (n, c) in s.items() if not kept(c)}
                    words = [sum(n for n, _ in s.values()) for s in spans]
                    first = min((c["first"] for s in spans for _, c in s.values() if c["first"] is not None), default=None)
                    out.append((i, len(spans), sum(words), max(words, default=0), sum(gone.values()), sum(inner.values()), first, sorted(gone)))
            if out:
                i, *columns = zip(*out, strict=True)
                kinds = [pa.int64()] * 5 + [b.schema.field(0).type, pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "key", "spans", "words", "longest", "removed_words", "inner", "first_id", "removed"])

    return per_doc.select("id", "key", "chunks").mapInArrow(run, f"id {kind}, key long, spans long, words long, longest long, removed_words long, inner long, first_id {kind}, removed array<int>")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs with every repeat cut out of all documents but the one that keeps it; documents left without text stay, empty."""
    found = repeats(docs, id_col, text_col, min_words, min_bytes).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "removed")
    own = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own"), F.xxhash64(id_col, text_col).alias("_key"))
    own = own.join(found, (own["_key"] == found["_key"]) & own["_own"].eqNullSafe(found["_id"]), "left").select("_row", "removed")

    @F.pandas_udf("string")
    def cut(text, removed):
        out = text.copy()
        for i, (t, r) in enumerate(zip(text, removed, strict=True)):
            if t is not None and r is not None and len(r):
                b, drop = t.encode(), set(r)
                ends = cuts(b)
                out.iloc[i] = b"".join(b[a:z] for k, (a, z) in enumerate(zip([0, *ends], ends, strict=False)) if k not in drop).decode("utf-8", "ignore")
        return out

    cut = F.when(F.size("removed") > 0, cut(F.col(f"_row.{text_col}"), F.col("removed"))).otherwise(F.col(f"_row.{text_col}"))
    return own.select(F.col("_row").withField(text_col, cut).alias("_row")).select("_row.*")


def op2_chunks(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = repeats(docs).drop("removed").withColumnRenamed("first_id", "first_doc_id")
    own = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_key"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    both = own.join(found, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("id")), "left")
    return both.select(F.col("_id").alias("doc_id"), "n_bytes", (F.coalesce("spans", F.lit(0)) > 0).alias("has_repeat"), zero("spans"), zero("words"), zero("longest"), zero("removed_words"), zero("inner"), "first_doc_id")
