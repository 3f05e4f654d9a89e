"""Removal of passages of 13 words or more that an earlier document holds too.

Every window of WINDOW words has an anchor, the least hash of its GRAM-word
sequences, so equal windows have equal anchors wherever they are. Anchors of
one document only are dropped by their count over the corpus; the passages
around the others go to the task that owns the anchor's range of hashes. That
task sweeps over them in the order of anchors and builds, for each bounded
shard of them, a compressed FM-index of the distinct passages; the passages are
streamed through it by backward search, which reports for each window that is
matched in full the smallest document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, copies_of, frequent_texts, hashed_words, materialise, mixed, sequences, small_batches, text_hashes, text_or_empty, within
from .exchange import TEXT_LEVEL, Shared, Size, by_run, chunk_edges, from_ints, ints, packed_bytes, plain_bytes, shared_tokens, text_batches, unpack_texts
from .fmindex import FMIndex

WINDOW, GRAM = 13, 8
#: An anchor of this class (8 * log2 of its documents) or more sends each of its
#: windows by the window's own hash, so that no anchor makes a shard too large.
HOT = 8 * 12
#: Words of a shard, passages of a chunk (a task may hold one chunk of every
#: run), and tasks for each of the exchange's.
SHARD_WORDS, CHUNK, SPREAD = 1_000_000, (8, 1024), 2


def anchors(h: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within texts, each one's anchor position, all sequence hashes."""
    starts = within(first, window)
    g = sequences(h, gram)
    if not len(starts):
        return starts, starts, g
    span = window - gram + 1
    best = np.arange(len(g))
    reach = 1
    while reach < span:  # leftmost least hash of the next 1, 2, 4, ... sequences
        hop = min(reach, span - reach)
        ahead = best[hop:]
        here = best[: len(ahead)]
        best = np.where(g[ahead] < g[here], ahead, here)
        reach += hop
    return starts, best[starts], g


def _anchor_tokens(texts: pa.Array) -> np.ndarray:
    """The anchors of each text, once for each text that has them."""
    h, first = hashed_words(*buffers(texts))
    _, at, g = anchors(h, first)
    at = np.unique(at)
    doc, tok = np.searchsorted(first, at, "right") - 1, g[at]
    order = np.lexsort((tok, doc))
    doc, tok = doc[order], tok[order]
    return tok[np.append(True, (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1]))[: len(tok)]]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = high - low
    return np.repeat(low - np.append(0, np.cumsum(n))[:-1], n) + np.arange(int(n.sum()))


def _codes(h: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the words of each passage: with their places in it, and without."""
    own = mixed(h * np.uint64(2) + np.uint64(1))
    plain = np.append(np.uint64(0), np.cumsum(own))
    sums = np.append(np.uint64(0), np.cumsum(own * (np.arange(len(h), dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
    mass = plain[stop] - plain[begin]
    return (sums[stop] - sums[begin]) - mass * (begin.astype(np.uint64) * np.uint64(2)), mass


def _distinct(holder: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries equal in all keys, the one of the least holder, by the first key; and each entry's group."""
    order = np.lexsort((holder, *reversed(keys)))
    head = np.append(True, np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys]))[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    return order[head], group


def _passages(size: Size, tasks: int):
    """For ``by_run``: the passages around anchors that other documents have too.

    A row per chunk: a run's distinct passages, each with the smallest document
    that holds it, by their key, which is the anchor (or, for hot anchors, the
    window); and where they occur in the run's documents.
    """

    def use(run: int, rows: list[tuple[bytes, bytes]]):
        shared = Shared(size, rows)
        found: list[tuple[np.ndarray, ...]] = []
        texts_of: list[np.ndarray] = []
        where: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen = [0, 0]  # documents and passages so far

        def each(blob: bytes) -> Iterator[pa.RecordBatch]:
            ids, texts = unpack_texts(blob)
            base, seen[0] = seen[0], seen[0] + len(ids)
            raw, offsets = buffers(texts)
            h, first, starts, ends = hashed_words(raw, offsets, places=True)
            win, at, g = anchors(h, first)
            if not len(win):
                return
            own = np.unique(at)
            kind = shared.of(g[own])[np.searchsorted(own, at)]
            win, at, kind = win[kind > 0], at[kind > 0], kind[kind > 0]
            if not len(win):
                return
            low = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (win[1:] != win[:-1] + 1)) | (kind >= HOT))
            n = np.diff(np.append(low, len(win)))  # windows of each passage
            begin, key, place = win[low], g[at[low]], at[low] - win[low]
            if (hot := kind[low] >= HOT).any():
                key = np.where(hot, sequences(h, WINDOW)[begin], key)
                place = np.where(hot, 255, place)
            doc = np.searchsorted(first, begin, "right") - 1
            stop = begin + n + WINDOW - 1
            code, mass = _codes(h, begin, stop)
            holder = ids.to_numpy()[doc]
            one, group = _distinct(holder, key, code, mass, n)
            lo, hi = starts[begin[one]], ends[stop[one] - 1]
            found.append((key[one], code[one], mass[one], n[one], place[one], holder[one], hi - lo))
            texts_of.append(raw[_ranges(lo, hi)])
            where.append((group + seen[1], doc + base, begin - first[doc]))
            seen[1] += len(one)
            return
            yield

        def end() -> Iterator[pa.RecordBatch]:
            if not found:
                return
            key, code, mass, n, place, holder, length = (np.concatenate(x) for x in zip(*found, strict=True))
            text, kind, doc, begin = np.concatenate(texts_of), *(np.concatenate(x) for x in zip(*where, strict=True))
            from_ = np.append(0, np.cumsum(length))
            one, group = _distinct(holder, key, code, mass, n)
            kind = group[kind]
            order = np.lexsort((begin, doc, kind))
            kind, doc, begin = kind[order], doc[order], begin[order]
            task = ((key[one] >> np.uint64(32)) * np.uint64(tasks)) >> np.uint64(32)
            edge = chunk_edges(task, min(max(SHARD_WORDS // (WINDOW * size.runs), CHUNK[0]), CHUNK[1]))
            for number, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                own = one[a:b]
                lo, hi = np.searchsorted(kind, (a, b))
                passages = [ints(length[own], 6), ints(n[own], 1), ints(place[own], 1), ints(holder[own].view(np.uint64), 8), packed_bytes(text[_ranges(from_[own], from_[own + 1])].tobytes(), TEXT_LEVEL)]
                occurrences = [ints(kind[lo:hi] - a, 4), ints(doc[lo:hi], 4), ints(begin[lo:hi], 6)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(task[a])], pa.int32()), pa.array([int(key[own[0]]) >> 1], pa.int64()), pa.array([run], pa.int64()), pa.array([number], pa.int64()), pa.array([passages], pa.list_(pa.binary())), pa.array([occurrences], pa.list_(pa.binary()))],
                    ["task", "first", "run", "chunk", "passages", "occurrences"],
                )

        return each, end

    return use


def smallest_holders(words: np.ndarray, first: np.ndarray, holders: np.ndarray, asked: np.ndarray, cut: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of the streamed texts, in order, the smallest holder of an
    indexed passage that has it; the largest integer where none has.

    ``words`` and ``first`` are the passages that are indexed, ``holders`` the
    smallest document of each, ``asked`` and ``cut`` the texts that are streamed.
    """
    index = FMIndex(words, first, holders, window)
    _, at = index.matches(asked, cut)
    at = at[within(cut, window)]
    out = np.full(len(at), np.iinfo(np.int64).max)
    hit = at >= 0
    out[hit] = index.least(at[hit])
    return out


class _Chunk:
    """A chunk of passages that is being answered."""

    def __init__(self, run: int, chunk: int, parts: list[bytes]):
        self.run, self.chunk = run, chunk
        length, n, place, holder, text = (from_ints(parts[0], 6), from_ints(parts[1], 1), from_ints(parts[2], 1), from_ints(parts[3], 8), plain_bytes(parts[4]))
        self.n, self.holder = n.astype(np.int64), holder.view(np.int64)
        self.words, self.first = hashed_words(np.frombuffer(text, np.uint8), np.append(0, np.cumsum(length.astype(np.int64))))
        place, begin = place.astype(np.int64), self.first[:-1]
        hot = place == 255
        self.key = np.empty(len(n), np.uint64)
        for way, gram, at in ((hot, WINDOW, begin), (~hot, GRAM, begin + place)):
            if way.any():
                self.key[way] = sequences(self.words, gram)[at[way]]
        self.done = 0
        self.answers: list[np.ndarray] = []


def _shard_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by their first keys; answers each chunk's windows."""
    held: list[_Chunk] = []
    inside, limit = 0, SHARD_WORDS

    def below(frontier: int | None) -> Iterator[pa.RecordBatch]:
        """Index and stream the passages of keys before the frontier, which no later chunk holds."""
        nonlocal held, inside, limit
        stop = [len(c.n) if frontier is None else max(c.done, int(np.searchsorted(c.key, np.uint64(frontier)))) for c in held]
        words = np.concatenate([c.words[c.first[c.done] : c.first[e]] for c, e in zip(held, stop, strict=True)])
        count = np.concatenate([np.diff(c.first[c.done : e + 1]) for c, e in zip(held, stop, strict=True)])
        n = np.concatenate([c.n[c.done : e] for c, e in zip(held, stop, strict=True)])
        holder = np.concatenate([c.holder[c.done : e] for c, e in zip(held, stop, strict=True)])
        if len(n):
            first = np.append(0, np.cumsum(count))
            code, mass = _codes(words, first[:-1], first[1:])
            one, group = _distinct(holder, code, mass, n)
            cut = np.append(0, np.cumsum(count[one]))
            some = words[_ranges(first[one], first[one + 1])]
            answer = smallest_holders(some, cut, holder[one], some, cut)
            begin = np.append(0, np.cumsum(n[one]))
            answer = answer[_ranges(begin[group], begin[group + 1])]
            at = np.append(0, np.cumsum(n))
        low = 0
        for c, e in zip(held, stop, strict=True):
            if e > c.done:
                c.answers.append(answer[at[low] : at[low + e - c.done]])
                low += e - c.done
                c.done = e
            if c.done == len(c.n):
                data = ints(np.concatenate(c.answers).view(np.uint64), 8)
                yield pa.RecordBatch.from_arrays([pa.array([c.run], pa.int64()), pa.array([c.chunk], pa.int64()), pa.array([data], pa.binary())], ["run", "chunk", "data"])
        held = [c for c in held if c.done < len(c.n)]
        inside = sum(int(c.first[-1] - c.first[c.done]) for c in held)
        limit = max(SHARD_WORDS, 2 * inside)

    for b in batches:
        for first, run, chunk, parts in zip(*(b.column(c).to_pylist() for c in ("first", "run", "chunk", "passages")), strict=True):
            if inside > limit:
                yield from below(2 * first)
            held.append(_Chunk(run, chunk, parts))
            inside += len(held[-1].words)
    if held:
        yield from below(None)


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _without(run: int, rows: list[tuple[bytes, bytes]]):
    """For ``by_run``: each document without the words that earlier documents' windows cover."""
    by: dict[int, dict[bytes, bytes]] = {}
    for head, data in rows:
        by.setdefault(int.from_bytes(head[:8], "little"), {})[head[8:]] = data
    whos, places, leasts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for parts in by.values():
        packed = parts[b"o"]
        sizes = np.frombuffer(packed[:12], "<u4").astype(np.int64)
        cut = 12 + np.append(0, np.cumsum(sizes))
        kind, doc, begin = (from_ints(packed[cut[i] : cut[i + 1]], w).astype(np.int64) for i, w in enumerate((4, 4, 6)))
        n = from_ints(packed[cut[3] :], 1).astype(np.int64)
        low = np.append(0, np.cumsum(n))
        whos.append(np.repeat(doc, n[kind]).astype(np.int32))
        places.append(_ranges(begin, begin + n[kind]))
        leasts.append(from_ints(parts[b"r"], 8).view(np.int64)[_ranges(low[kind], low[kind + 1])])
    by.clear()
    who, place, least = np.concatenate(whos), np.concatenate(places), np.concatenate(leasts)
    order = np.argsort(who, kind="stable")
    who, place, least = who[order], place[order], least[order]
    seen = [0]

    def each(blob: bytes) -> Iterator[pa.RecordBatch]:
        ids, texts = unpack_texts(blob)
        base, seen[0] = seen[0], seen[0] + len(ids)
        raw, offsets = buffers(texts)
        numbers = ids.to_numpy()
        _, first = hashed_words(raw, offsets)
        cover = np.zeros(int(first[-1]) + WINDOW + 1, np.int32)
        a, b = np.searchsorted(who, (base, base + len(ids)))
        own = who[a:b] - base
        hit = (first[own] + place[a:b])[least[a:b] < numbers[own]]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        gone = np.cumsum(cover) > 0
        out = []
        for i, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            words = raw[offsets[i] : offsets[i + 1]].tobytes().split()
            if lost := int(gone[low:high].sum()):
                words = list(compress(words, (~gone[low:high]).tolist()))
            out.append((high - low, lost, hashlib.sha256(b" ".join(words)).hexdigest()))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return each, lambda: iter(())


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    Windows are judged on the input. Null and empty texts have no words; very
    long texts are batches of their own; rows of one doc_id, repeated rows among
    them, don't remove words from each other; rows of null doc_id neither lose
    words nor make others lose any; an empty table gives no rows. Columns other
    than doc_id and text are not read. Words are compared by 64-bit hashes.
    """
    spark = documents.sparkSession
    small_batches(spark)
    text = text_or_empty()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *text_hashes(text))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]", -1), "")
    alone = F.col("doc_id").isNull() | (F.col("text") == "")
    sized = rows.select("doc_id", F.size(words).cast("long").alias("n"), F.octet_length("text").alias("bytes"), "h1", "h2", F.when(alone, F.sha2(F.array_join(words, " "), 256)).alias("own"))
    sized = materialise(sized, "sized")
    total = sized.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    size = Size(int(total["bytes"] or 0), int(total["n"] or 0))
    frequent = frequent_texts(sized.where(f"n >= {WINDOW}"))

    def copied(b: pa.RecordBatch) -> np.ndarray:
        return copies_of(frequent, b)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that need no index: those without id or text, and copies of frequent texts."""
        nothing = hashlib.sha256(b"").hexdigest()
        for b in batches:
            n, copy = b.column("n").to_numpy(), copied(b)
            keep = b.column("own").is_valid().to_numpy(zero_copy_only=False) | copy
            sha = [nothing if c else s for s, c in zip(b.column("own").to_pylist(), copy.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(np.where(copy, n, 0)), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]).filter(pa.array(keep))

    batches = text_batches(rows.where("doc_id is not null and text <> ''"), size, copied)
    shared = shared_tokens(batches, _anchor_tokens, size)
    tasks = SPREAD * size.tasks
    cut = by_run(batches, shared, size, _passages(size, tasks), "task int, first long, run long, chunk long, passages array<binary>, occurrences array<binary>")
    cut = materialise(cut, "passages", compression="uncompressed")
    answers = cut.select("task", "first", "run", "chunk", "passages").repartitionById(tasks, F.col("task")).sortWithinPartitions("first").mapInArrow(_shard_task, "run long, chunk long, data binary")

    def pack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            head = [c.to_bytes(8, "little") + b"o" for c in b.column("chunk").to_pylist()]
            data = [np.array([len(x) for x in o], "<u4").tobytes() + b"".join(o) + n for o, n in zip(b.column("occurrences").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(head, pa.binary()), pa.array(data, pa.binary())], ["run", "a", "b"])

    def head(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            own = [c.to_bytes(8, "little") + b"r" for c in b.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(own, pa.binary()), b.column("data")], ["run", "a", "b"])

    pair = "run long, a binary, b binary"
    where = cut.select("run", "chunk", F.get("passages", F.lit(1)).alias("n"), "occurrences").mapInArrow(pack, pair)
    done = by_run(batches, where.unionAll(answers.mapInArrow(head, pair)), size, _without, _RESULT)
    return done.unionAll(sized.mapInArrow(apart, _RESULT))
