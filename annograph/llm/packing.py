"""Best-fit packing under conflicts of source and duplicate cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, text_or_empty
from .setjoin import Rule, similar_classes

#: Words a bin holds, and the records a task packs at a time.
CAPACITY, BLOCK_ROWS = 2048, 20_000
#: Tasks that pack, at most; a task packs slice after slice.
MOST_TASKS = 1 << 15


class Bins:
    """Open bins by what is left in them, with bitmaps of what they hold.

    A bin's mask has a bit per tag (a source or a duplicate cluster). ``some``
    has bit r where a bin with r left exists; ``blocked[tag]`` has bit r where
    every bin with r left holds the tag. So the next r that may fit an item is
    found in a few words of bits, however many bins conflict with it.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.some = 0
        self.blocked: dict[int, int] = {}
        self.by_left: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.common: list[int] = [0] * (capacity + 1)
        self.count = 0

    def _set_common(self, left: int, mask: int) -> None:
        old = self.common[left]
        for bits, on in ((old & ~mask, False), (mask & ~old, True)):
            while bits:
                tag = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                at = self.blocked.get(tag, 0)
                self.blocked[tag] = at | 1 << left if on else at & ~(1 << left)
        self.common[left] = mask

    def _put(self, left: int, mask: int, bin_id: int) -> None:
        groups = self.by_left[left]
        self._set_common(left, self.common[left] & mask if groups else mask)
        groups.setdefault(mask, []).append(bin_id)
        self.some |= 1 << left

    def _take(self, left: int, mask: int) -> int:
        groups = self.by_left[left]
        bin_id = groups[mask].pop()
        if not groups[mask]:
            del groups[mask]
            if groups:
                common = -1
                for m in groups:
                    common &= m
                self._set_common(left, common)
            else:
                self._set_common(left, 0)
                self.some &= ~(1 << left)
        return bin_id

    def place(self, size: int, tags: tuple[int, ...]) -> tuple[int, int]:
        """Bin and offset: the tightest compatible bin, else a new one."""
        own, fits = 0, self.some
        for t in tags:
            own |= 1 << t
            fits &= ~self.blocked.get(t, 0)
        fits = fits >> size << size
        while fits:
            left = (fits & -fits).bit_length() - 1
            for mask in self.by_left[left]:
                if not mask & own:
                    bin_id = self._take(left, mask)
                    self._close(left - size, mask | own, bin_id)
                    return bin_id, self.capacity - left
            fits &= fits - 1
        bin_id = self.count
        self.count += 1
        self._close(self.capacity - size, own, bin_id)
        return bin_id, 0

    def _close(self, left: int, mask: int, bin_id: int) -> None:
        if left:
            self._put(left, mask, bin_id)


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[list[tuple[int, int, int]]]:
    """(bin, offset, length) of each record's pieces; longest remainders first.

    A record longer than a bin fills bins of its own; only its remainder shares
    one. Records of the same source, or the same cluster, never share a bin;
    a null source or cluster conflicts with nothing.
    """
    tag_of: dict[tuple[str, object], int] = {}
    seen: dict[tuple[str, object], int] = {}
    keys = [[k for k in (("source", s), ("cluster", c)) if k[1] is not None] for s, c in zip(sources, clusters, strict=True)]
    for own in keys:
        for k in own:
            seen[k] = seen.get(k, 0) + 1
    for own in keys:
        for k in own:
            if seen[k] > 1:
                tag_of.setdefault(k, len(tag_of))
    bins, out = Bins(capacity), [[] for _ in sizes]
    rest = np.array([s % capacity for s in sizes], np.int64)
    for i, s in enumerate(sizes):
        for _ in range(s // capacity):
            out[i].append((bins.count, 0, capacity))
            bins.count += 1
    for i in np.argsort(-rest, kind="stable").tolist():
        if rest[i]:
            b, at = bins.place(int(rest[i]), tuple(tag_of[k] for k in keys[i] if k in tag_of))
            out[i].append((b, at, int(rest[i])))
    return out


def _sized(documents: DataFrame, near: Rule | None) -> DataFrame:
    """doc_id, n_words (with the end mark), source and cluster of every row."""
    given = "cluster" in documents.columns
    source = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
    own = F.col("cluster").cast("string") if given else F.xxhash64(text_or_empty()).cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("own_id"), text_or_empty().alias("text"), source.alias("source"), own.alias("own"))
    if given or not near:
        words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]", -1), ""))
        sized = rows.select("own_id", (words + 1).cast("long").alias("n_words"), "source", F.col("own").alias("cluster"))
    else:
        keyed = rows.withColumn("doc_id", F.coalesce("own_id", F.xxhash64("text")))
        linked = similar_classes(keyed, near, keep=("own_id", "source", "own"))
        cluster = F.when(F.col("n_shingles") > 0, F.col("component_id").cast("string")).otherwise(F.col("own"))
        sized = linked.select("own_id", (F.col("n_words") + 1).alias("n_words"), "source", cluster.alias("cluster"))
    return sized.withColumnRenamed("own_id", "doc_id")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, near: Rule | None = None) -> DataFrame:
    """Every document's pieces in bins of ``capacity`` words.

    Returns doc_id, piece (from 0), bin (long), bin_offset, length, n_words,
    source, cluster. A document counts its words and one end mark, so null and
    empty texts take 1, and very long ones fill bins of their own. The cluster
    is that of column ``cluster`` where there is one, else, with ``near``, the
    component of texts that it links (a hash for texts without words), else a
    hash of the text, so that exact copies never share a bin. Rows of null
    doc_id are linked by their texts. Rows are dealt out evenly whatever their
    source, cluster or doc_id, and each task packs them in slices of
    ``block_rows`` to twice as many: fits are the best within a slice, and
    memory is that of a slice. Repeated rows and ties are packed one by one, in
    the order of (remainder, doc_id); an empty table gives no rows; of other
    columns none is read.
    """
    small_batches(documents.sparkSession)
    sized = materialise(_sized(documents, near), "sizes")
    parts = min(MOST_TASKS, max(1, -(-sized.count() // block_rows)))
    schema = "doc_id long, piece int, bin long, bin_offset int, length int, n_words long, source string, cluster string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition in slices of block_rows, so that an uneven deal costs no memory."""
        from pyspark import TaskContext

        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 2 * block_rows:
                yield block(held, part, number)
                held, n, number = [], 0, number + 1
        if n:
            yield block(held, part, number)

    def block(held: list[pa.RecordBatch], part: int, number: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("n_words", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        places = pack(t["n_words"].to_pylist(), t["source"].to_pylist(), t["cluster"].to_pylist(), capacity)
        row = np.repeat(np.arange(len(places)), [len(p) for p in places])
        flat = np.array([x for p in places for x in p], np.int64).reshape(-1, 3)
        piece = np.concatenate([np.arange(len(p)) for p in places]) if places else np.zeros(0)
        base = (part << 46) | (number << 26)
        own = t.take(pa.array(row))
        columns = [own["doc_id"], pa.array(piece.astype(np.int32)), pa.array(flat[:, 0] + base), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2].astype(np.int32)), own["n_words"], own["source"], own["cluster"]]
        return pa.Table.from_arrays(columns, names=["doc_id", "piece", "bin", "bin_offset", "length", "n_words", "source", "cluster"]).combine_chunks().to_batches()[0]

    return sized.repartition(parts).mapInArrow(run, schema)
