"""Shared parts: the work folder, Arrow plumbing and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space, for ``translate``.
BLANKS = " \t\n\x0b\x0c\r"

#: Bytes of rows that a Python worker gets at once; a longer row comes alone.
BATCH_LIMIT = 2 << 20
#: Bytes of text hashed at once; the numpy temporaries, eight times as large, stay in the cache.
CHUNK = 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEQ = np.uint64(0xD6E8FEB86659FD93)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is
    made and set, so that later calls of the session find it again. On a
    cluster there is no such folder, and its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="annograph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage; a lost executor costs at most the tasks it ran.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, when all that reads them is written itself."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._work_path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, as texts may be long; always to the same value."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_LIMIT))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Texts with at least so many equal ones are reduced to the first of them
#: before an index, the most frequent texts, at most so many. Others are found by it.
FREQUENT_COPIES, FREQUENT_TEXTS = 8, 200_000


def text_hashes(text) -> list:
    """Columns h1 and h2: two hashes of a text, by which exact copies are known."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(0x5EED), text, F.octet_length(text)).alias("h2")]


def frequent_texts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, smallest doc_id) of the most frequent texts, by h1; ``rows`` has doc_id, h1, h2."""
    found = rows.where("doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    found = found.where(F.col("copies") >= FREQUENT_COPIES).orderBy(F.desc("copies"), "h1", "h2").limit(FREQUENT_TEXTS).orderBy("h1").collect()
    return tuple(np.array([r[c] for r in found], np.int64) for c in ("h1", "h2", "first"))


def copies_of(frequent: tuple[np.ndarray, np.ndarray, np.ndarray], rows: pa.RecordBatch) -> np.ndarray:
    """Which rows are copies of a frequent text of a smaller doc_id."""
    h1, h2, first = frequent
    if not len(h1) or not rows.num_rows:
        return np.zeros(rows.num_rows, bool)
    own = rows.column("h1").to_numpy()
    at = np.minimum(np.searchsorted(h1, own), len(h1) - 1)
    ids = rows.column("doc_id").fill_null(-(1 << 63)).to_numpy()
    return (h1[at] == own) & (h2[at] == rows.column("h2").to_numpy()) & (first[at] < ids)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = (made[0], made[1])
    return _powers


def _class(fold: bool, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte tables: is it part of a word, and the value that is hashed."""
    part = np.ones(256, bool)
    part[[9, 10, 11, 12, 13, 32]] = False
    value = np.arange(256, dtype=np.uint64) + np.uint64(1)
    if fold:
        value[65:91] = value[97:123]
    if plain:
        part[:128] = False
        for low, high in ((48, 58), (65, 91), (97, 123)):
            part[low:high] = True
    return part, value


_CLASSES = {(f, p): _class(f, p) for f in (False, True) for p in (False, True)}


def _cuts(white: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size``, ended at a document's end or at white space."""
    n, start = int(offsets[-1]), 0
    ends = offsets[1:]
    while start < n:
        stop = min(n, start + size)
        if stop < n:
            k = int(np.searchsorted(ends, stop, "right")) - 1
            if k >= 0 and ends[k] > start:
                stop = int(ends[k])
            else:
                back = np.flatnonzero(white[start:stop])
                if len(back):
                    stop = start + int(back[-1]) + 1
                else:
                    at = stop
                    limit = int(ends[int(np.searchsorted(ends, start, "right"))])
                    while at < limit and not white[at : at + size].any():
                        at += size
                    rest = np.flatnonzero(white[at : min(at + size, limit)]) if at < limit else []
                    stop = at + int(rest[0]) + 1 if len(rest) else limit
        yield start, stop
        start = stop


def hashed_words(raw: np.ndarray, offsets: np.ndarray, fold: bool = False, plain: bool = False, places: bool = False):
    """64-bit hashes of the words of texts laid end to end.

    Returns (hashes, first word of each text with the total at the end) and,
    with ``places``, the words' byte starts and ends. ``fold`` lower-cases A-Z;
    ``plain`` takes runs of letters, digits and non-ASCII bytes as words.
    """
    part, value = _CLASSES[fold, plain]
    inside = part[raw]
    white = ~inside
    hashes, starts, ends = [], [], []
    for low, high in _cuts(white, offsets, CHUNK):
        own = inside[low:high]
        first = own.copy()
        first[1:] &= ~own[:-1]
        last = own.copy()
        last[:-1] &= ~own[1:]
        edge = offsets[(offsets > low) & (offsets < high)] - low
        if len(edge):
            edge = np.unique(edge)
            first[edge] = own[edge]
            last[edge - 1] = own[edge - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _tables(high - low + 1)
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        np.cumsum(value[raw[low:high]] * power[: high - low], out=total[1:])
        hashes.append(mixed((total[e] - total[s]) * inverse[s]))
        starts.append(s + low)
        ends.append(e + low)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    first_word = np.searchsorted(s, offsets)
    if places:
        return h, first_word, s, np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return h, first_word


def word_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each of the texts laid end to end."""
    inside = _CLASSES[False, False][0][raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edge] = inside[edge]
    return np.diff(np.append(0, np.cumsum(first))[offsets])


def sequences(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word sequences starting at each word, across text borders."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _SEQ
        out += h[i : i + n]
    return mixed(out)


def within(first_word: np.ndarray, k: int) -> np.ndarray:
    """Starts of the k-word sequences that stay inside one text."""
    n = int(first_word[-1])
    ok = np.ones(max(n - k + 1, 0), bool)
    for b in np.unique(first_word[1:-1]):
        ok[max(b - k + 1, 0) : b] = False
    return np.flatnonzero(ok)
