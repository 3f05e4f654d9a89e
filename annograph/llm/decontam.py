"""Benchmark decontamination: n-gram seeds, an upper bound, then local alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, hashed_words, sequences, small_batches, within

#: Words of a seed; for ``rare``: seeds in more than this share of the documents
#: (or this many) are common; an item keeps at least so many of its rarest ones.
SEED, COMMON_SHARE, COMMON_DOCS, LEAST_SEEDS = 3, 0.001, 20, 8
#: Alignment: points of a match, a mismatch and a skipped word; an item is found
#: where the score is at least this share of its words.
MATCH, MISMATCH, GAP, THRESHOLD = 1.0, -0.5, 0.5, 0.5
#: Bytes of benchmark text that are held at once; more items go in blocks.
BLOCK_BYTES = 8 << 20
_BITS = 20


@dataclass
class Index:
    """Seeds of some items: seed j occurs at the rows low[j]..low[j+1] of ``at``."""

    items: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    low: np.ndarray
    at: np.ndarray
    filter: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.seeds & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that hold a seed, and which."""
        p = np.flatnonzero(self.filter[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        if not len(p) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        j = np.searchsorted(self.seeds, h[p])
        j[j == len(self.seeds)] = 0
        ok = self.seeds[j] == h[p]
        return p[ok], j[ok]

    def only(self, keep: np.ndarray) -> Index:
        n = np.diff(self.low)
        rows = np.repeat(keep, n)
        return Index(self.items, self.words, self.seeds[keep], np.append(0, np.cumsum(n[keep])), self.at[rows])


def index_items(items: list[tuple[int, str | None]]) -> Index:
    """Index of (item_id, text); items of fewer than SEED words hold no seed."""
    raw, offsets = buffers(pa.array([t or "" for _, t in items], pa.string()))
    h, first = hashed_words(raw, offsets, fold=True, plain=True)
    words = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    at = np.array([(i, p) for i, w in enumerate(words) for p in range(len(w) - SEED + 1)], np.int64).reshape(-1, 2)
    hashes = np.concatenate([sequences(w, SEED) for w in words]) if words else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")
    seeds, low = np.unique(hashes[order], return_index=True)
    return Index([i for i, _ in items], words, seeds, np.append(low, len(order)), at[order])


def rare(index: Index, seen: np.ndarray, documents: int) -> Index:
    """The seeds that few documents hold, and each item's rarest in any case.

    The queries don't use it: an edited copy may hold none of the seeds it keeps.
    """
    keep = seen <= max(COMMON_DOCS, COMMON_SHARE * documents)
    seed_of = np.repeat(np.arange(len(index.seeds)), np.diff(index.low))
    pairs = np.unique(np.column_stack([index.at[:, 0], seed_of]), axis=0)
    item, seed = pairs[:, 0], pairs[:, 1]
    order = np.lexsort((seed, seen[seed], item))
    rank = np.arange(len(order)) - np.searchsorted(item, item)  # items stay in order, so places are ranks
    keep[seed[order][rank < LEAST_SEEDS]] = True
    return index.only(keep)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word lists, and its end in ``text``.

    Smith-Waterman by rows: a gap along the row is a running maximum.
    """
    slope = GAP * np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1)
    best, end = 0.0, 0
    for w in item:
        step = np.where(text == w, MATCH, MISMATCH)
        row = np.maximum(above - GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + step)
        row = np.maximum(np.maximum.accumulate(row + slope) - slope, 0)
        if (k := int(row.argmax())) and row[k] > best:
            best, end = float(row[k]), k
        above = row
    return best, end


def find(index: Index, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(text, item, score, last word) of the items found in texts laid end to end."""
    starts = within(first, SEED)
    p, j = index.hits(sequences(h, SEED)[starts]) if len(starts) else (np.zeros(0, np.int64),) * 2
    if not len(p):
        return []
    at = starts[p]
    n = index.low[j + 1] - index.low[j]
    rows = np.repeat(index.low[j] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
    at = np.repeat(at, n)
    item, diagonal = index.at[rows, 0], at - index.at[rows, 1]
    doc = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    size = np.array([len(w) for w in index.words])[item]
    new = np.ones(len(doc), bool)  # hits of one item further apart than its length are tried apart
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > size[1:])
    found: dict[tuple[int, int], tuple[float, int]] = {}
    low = np.flatnonzero(new)
    for a, b in zip(low.tolist(), np.append(low[1:], len(doc)).tolist(), strict=True):
        d, i, words = int(doc[a]), int(item[a]), index.words[int(item[a])]
        pad = len(words) // 2 + 2
        s = max(int(first[d]), int(diagonal[a]) - pad)
        e = min(int(first[d + 1]), int(diagonal[b - 1]) + len(words) + pad)
        if np.isin(words, h[s:e]).sum() < THRESHOLD * len(words):  # no alignment scores more than the words it can match
            continue
        score, end = align(words, h[s:e])
        score /= len(words) * MATCH
        if score >= THRESHOLD and score > found.get((d, i), (0.0, 0))[0]:
            found[d, i] = (score, s + end - int(first[d]))
    return [(d, i, *v) for (d, i), v in sorted(found.items())]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Items by blocks of at most about BLOCK_BYTES, however large the table."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-int(size) // BLOCK_BYTES)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x))


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words(*buffers(column), fold=True, plain=True)


def indexes(benchmark: DataFrame) -> list[Index]:
    """Indexes of all seeds; one per block of items."""
    small_batches(benchmark.sparkSession)
    return [index_items(items) for items in _blocks(benchmark)]


def find_in_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (share of the item's words, 0.5 to 1), end_word.

    One row for every document and item of which an exact, edited or
    paraphrased copy is found, the best one; a copy shares at least SEED
    successive words with the item, however many documents hold them. Null and empty texts hold none; an
    empty benchmark, or items of under three words, are found nowhere; repeated
    rows give repeated results; null ids are returned as they are.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, score double, end_word long"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = None
    for index in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = find(index, *_hashed(b.column("text")))
                ids = b.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.items[g[1]] for g in got], pa.int64()), pa.array([round(g[2], 6) for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int64())], ["doc_id", "item_id", "score", "end_word"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    out = documents
    for index in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[g[0] for g in find(index, *_hashed(b.column(b.schema.get_field_index("text")).cast(pa.string())))]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, documents.schema)
    return out
