"""Batches of texts, and counts of their tokens over the whole corpus.

Texts are stored once, in compressed batches of a few MB, several of which make
a run. A run's distinct tokens (hashes) go out sorted, in chunks, to the task
that owns their range of hashes. That task sweeps over the chunks of all runs
in the order of their first tokens, so it holds no more than the chunks that
overlap, and sends each run those of its tokens that further documents hold.
The rows exchanged grow with the tokens, as runs and chunks are cut by size;
a token of every document is one entry per run, and nothing is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Bytes of text in a batch and, from the smallest to the largest corpus, in a run.
BATCH_BYTES, RUN_BYTES = 4 << 20, (4 << 20, 32 << 20)
#: A corpus is cut into about so many runs until they reach their largest size.
RUNS = 96
#: Tokens that a counting task is given, as long as there are few such tasks;
#: tokens that it holds at a time; and tokens in a chunk.
TASK_TOKENS, MOST_TASKS, HELD_TOKENS, CHUNK_TOKENS = 2_000_000, 20_000, 2_000_000, (8, 8192)
#: Partitions at most of anything that is dealt out by run.
MOST_PARTITIONS = 100_000


#: Compression of texts that are moved more than once.
TEXT_LEVEL = 4


def packed_bytes(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def plain_bytes(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def ints(values: np.ndarray, width: int) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return packed_bytes(np.ascontiguousarray(planes.T).tobytes())


def from_ints(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(plain_bytes(raw), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def pack_texts(ids: pa.Array, texts: pa.Array, level: int = TEXT_LEVEL) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_texts(blob: bytes) -> tuple[pa.Array, pa.Array]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return batch.column(0), batch.column(1)


@dataclass(frozen=True)
class Size:
    """What a corpus's size decides: nothing of it changes a result."""

    text_bytes: int
    tokens: int

    @property
    def run_bytes(self) -> int:
        return min(max(self.text_bytes // RUNS, RUN_BYTES[0]), RUN_BYTES[1])

    @property
    def runs(self) -> int:
        return max(1, -(-self.text_bytes // self.run_bytes))

    @property
    def bits(self) -> int:
        """Bits of a token that are counted: few different ones of a corpus are equal in them."""
        return min(54, max(40, math.ceil(math.log2(self.tokens + 2)) + 10))

    @property
    def tasks(self) -> int:
        return min(MOST_TASKS, max(16, -(-self.tokens // TASK_TOKENS)))

    @property
    def chunk(self) -> int:
        """Tokens in a chunk, of which a task may hold one of every run."""
        return min(max(4 * HELD_TOKENS // self.runs, CHUNK_TOKENS[0]), CHUNK_TOKENS[1])

    def counted(self, tokens: np.ndarray) -> np.ndarray:
        return tokens >> np.uint64(64 - self.bits)

    def task_of(self, counted: np.ndarray) -> np.ndarray:
        return ((counted >> np.uint64(self.bits - 32)) * np.uint64(self.tasks)) >> np.uint64(32)


def text_batches(documents: DataFrame, size: Size, skip: Callable[[pa.RecordBatch], np.ndarray] | None = None, level: int = TEXT_LEVEL) -> DataFrame:
    """A written table of (run, batch, blob); ``skip`` marks rows to leave out.

    ``documents`` has doc_id (not null) and text (not null). A text longer than
    a batch is a batch of its own. A run's batches are numbered in order.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = run_number = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        texts: list[pa.Array] = []
        held = in_run = 0

        def flush() -> pa.RecordBatch:
            blob = pack_texts(pa.concat_arrays(ids), pa.concat_arrays(texts), level)
            return pa.RecordBatch.from_arrays([pa.array([run_number], pa.int64()), pa.array([number], pa.int64()), pa.array([blob], pa.binary())], ["run", "batch", "blob"])

        for b in batches:
            if skip is not None and b.num_rows:
                b = b.filter(pa.array(~skip(b)))
            i, t = b.column("doc_id"), b.column("text").cast(pa.large_string())
            at = 0
            while at < len(i):
                n = max(1, min(len(i) - at, 256))
                part = t.slice(at, n)
                ids.append(i.slice(at, n))
                texts.append(part)
                held += part.nbytes
                at += n
                if held >= BATCH_BYTES:
                    yield flush()
                    number, in_run, held = number + 1, in_run + held, 0
                    ids, texts = [], []
                    if in_run >= size.run_bytes:
                        run_number, in_run = number, 0
        if ids:
            yield flush()

    return materialise(documents.mapInArrow(run, "run long, batch long, blob binary"), "batches", compression="uncompressed")


def merged(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens in order, and how often each is there."""
    flat = np.concatenate(tokens)
    flat.sort()
    head = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
    return flat[head], np.diff(head, append=len(flat))


def chunk_edges(task: np.ndarray, chunk: int) -> np.ndarray:
    """Starts of chunks of at most ``chunk`` entries of one task each, and the end."""
    edge = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task)) if len(task) else np.zeros(1, np.int64)
    cuts = [np.arange(a, b, chunk) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return np.concatenate([*cuts, [len(task)]]).astype(np.int64)


def classes(counts: np.ndarray) -> np.ndarray:
    """0 for tokens of one document; else growing with the logarithm of the count."""
    return np.where(counts < 2, 0, np.minimum(255, 8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


#: Document numbers and tokens of a batch's texts, each pair once.
Tokens = Callable[[pa.Array], np.ndarray]


def shared_tokens(batches: DataFrame, tokens: Tokens, size: Size) -> DataFrame:
    """(run, tokens, classes): the tokens of each run that two documents or more hold.

    ``tokens`` gives the tokens of a batch's texts, one for each document that
    holds it. Classes tell how widespread a token is; equal tokens have equal
    classes in all runs.
    """
    width = -(-size.bits // 8)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []

        def close() -> pa.RecordBatch:
            tok, n = merged(own)
            task = size.task_of(tok)
            edge = chunk_edges(task, size.chunk)
            pairs = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            start = edge[:-1]
            pay = [ints(np.diff(tok[a:b], prepend=np.uint64(0)), width) for a, b in pairs]
            num = [ints(np.minimum(n[a:b], 65535), 2) if n[a:b].max() > 1 else b"" for a, b in pairs]  # empty: all are 1
            return pa.RecordBatch.from_arrays(
                [pa.array(task[start].astype(np.int32)), pa.array(tok[start].astype(np.int64)), pa.array([at] * len(pairs), pa.int64()), pa.array(pay, pa.binary()), pa.array(num, pa.binary())],
                ["task", "first", "run", "tokens", "n"],
            )

        for b in rows:
            for run, blob in zip(b.column("run").to_pylist(), b.column("blob"), strict=True):
                if run != at:
                    if own:
                        yield close()
                    at, own = run, []
                tok = size.counted(tokens(unpack_texts(blob.as_buffer())[1]))
                if len(tok):
                    own.append(tok)
        if own:
            yield close()

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        inside, limit = 0, HELD_TOKENS

        def below(frontier: int | None) -> Iterator[pa.RecordBatch]:
            """Answer all tokens before the frontier; no later chunk holds one of them."""
            nonlocal held, inside, limit
            cut = [len(t) if frontier is None else int(np.searchsorted(t, np.uint64(frontier))) for _, t, _ in held]
            flat = np.concatenate([t[:k] for (_, t, _), k in zip(held, cut, strict=True)])
            n = np.concatenate([c[:k] for (_, _, c), k in zip(held, cut, strict=True)])
            order = np.argsort(flat)
            flat = flat[order]
            head = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
            kind = np.empty(len(flat), np.uint8)
            if len(head):
                kind[order] = np.repeat(classes(np.add.reduceat(n[order], head)), np.diff(head, append=len(flat)))
            by: dict[int, tuple[list, list]] = {}
            low = 0
            for (run, t, _), k in zip(held, cut, strict=True):
                some = np.flatnonzero(kind[low : low + k])
                if len(some):
                    got = by.setdefault(run, ([], []))
                    got[0].append(t[some])
                    got[1].append(kind[low + some])
                low += k
            held = [(r, t[k:], c[k:]) for (r, t, c), k in zip(held, cut, strict=True) if k < len(t)]
            inside = sum(len(t) for _, t, _ in held)
            limit = max(HELD_TOKENS, 2 * inside)
            if by:
                packed = [(r, ints(np.diff(np.concatenate(a), prepend=np.uint64(0)), 8), packed_bytes(np.concatenate(b).tobytes())) for r, (a, b) in by.items()]
                cols = list(zip(*packed, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["run", "tokens", "classes"])

        for b in rows:
            for first, run, pay, num in zip(*(b.column(c).to_pylist() for c in ("first", "run", "tokens", "n")), strict=True):
                if inside > limit:
                    yield from below(first)
                tok = np.cumsum(from_ints(pay, width), dtype=np.uint64)
                held.append((run, tok, from_ints(num, 2).astype(np.int64) if num else np.ones(len(tok), np.int64)))
                inside += len(tok)
        if held:
            yield from below(None)

    small_batches(batches.sparkSession)
    sent = batches.select("run", "blob").mapInArrow(send, "task int, first long, run long, tokens binary, n binary")
    return sent.repartitionById(size.tasks, F.col("task")).sortWithinPartitions("first").mapInArrow(count, "run long, tokens binary, classes binary")


class Shared:
    """A run's tokens that further documents hold, with their classes."""

    def __init__(self, size: Size, rows: list[tuple[bytes, bytes]]):
        self.size = size
        tok = np.concatenate([np.cumsum(from_ints(t, 8), dtype=np.uint64) for t, _ in rows] or [np.zeros(0, np.uint64)])
        kind = np.frombuffer(b"".join(plain_bytes(c) for _, c in rows), np.uint8)
        self.tokens, first = np.unique(tok, return_index=True)
        self.kinds = kind[first]
        # by a token's last bits: the number, from 1 on, of the last token that ends in them; the others are left over
        self.slot = np.zeros(1 << 22, np.int32)
        at, number = self._slots(self.tokens), np.arange(1, len(self.tokens) + 1, dtype=np.int32)
        self.slot[at] = number
        self.left = np.flatnonzero(self.slot[at] != number)

    @staticmethod
    def _slots(tokens: np.ndarray) -> np.ndarray:
        return (tokens & np.uint64((1 << 22) - 1)).view(np.int64)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """The class of each token, 0 for those of one document."""
        own = self.size.counted(tokens)
        out = np.zeros(len(own), np.uint8)
        at = self.slot[self._slots(own)]
        some = np.flatnonzero(at)
        at, own = at[some] - 1, own[some]
        hit = self.tokens[at] == own
        out[some[hit]] = self.kinds[at[hit]]
        if len(self.left):
            some, own, rest = some[~hit], own[~hit], self.tokens[self.left]
            at = np.minimum(np.searchsorted(rest, own), len(rest) - 1)
            out[some] = np.where(rest[at] == own, self.kinds[self.left[at]], 0)
        return out


#: ``use(run)`` gives two functions: one for each of the run's blobs, in order,
#: and one for its end.
PerRun = Callable[[int, list[tuple[bytes, bytes]]], tuple[Callable[[bytes], Iterator[pa.RecordBatch]], Callable[[], Iterator[pa.RecordBatch]]]]


def by_run(batches: DataFrame, more: DataFrame, size: Size, use: PerRun, schema: str) -> DataFrame:
    """``use(run, [(a, b), ...])`` with the further rows (run, a, b) of each run, then its blobs."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, each, end = None, [], None, None
        for b in rows:
            for r, seq, one, two in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if r != at:
                    if end is not None:
                        yield from end()
                    at, held, each, end = r, [], None, None
                if seq < 0:
                    held.append((one, two))
                    continue
                if each is None:
                    each, end = use(r, held)
                yield from each(one)
        if end is not None:
            yield from end()

    small_batches(batches.sparkSession)
    blobs = batches.select("run", F.col("batch").alias("seq"), F.col("blob").alias("a"), F.lit(None).cast("binary").alias("b"))
    a, b = (c for c in more.columns if c != "run")
    union = blobs.unionAll(more.select("run", F.lit(-1).cast("long"), F.col(a), F.col(b)))
    parts = min(MOST_PARTITIONS, max(16, 2 * size.runs))
    return union.repartition(parts, "run").sortWithinPartitions("run", "seq").mapInArrow(run, schema)
