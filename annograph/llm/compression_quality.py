"""Quality by compression: how much better a dictionary of good text fits than one of bad text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, text_or_empty

#: Bounds of the labelled sample: rows of each label for the dictionaries and
#: for calibration, and pieces of a label's rows that a dictionary is built from.
DICT_ROWS, FIT_ROWS, DICT_PIECES = 800, 2000, 16_384
#: Texts are compressed in pieces of so many bytes, so that a repeated sentence
#: doesn't hide what the dictionaries say.
PIECE, LEVEL = 1024, 3
#: Of the dictionary builder: size, length of a segment and of the matches it counts.
DICT_BYTES, SEGMENT, MATCH = 112_640, 48, 6


@dataclass
class Model:
    """Two dictionaries, and the logistic curve over the normalised size difference."""

    good: bytes
    bad: bytes
    slope: float
    shift: float

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.shift, -30, 30)))


class Meter:
    """Compressed sizes of a text, piece by piece, under either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        for d in (good, bad):
            made = zstandard.ZstdCompressionDict(d)
            made.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, raw: bytes) -> float:
        """Bytes that the good dictionary saves beside the bad one, per byte of text; 0 without any."""
        view = memoryview(raw)
        good, bad = (sum(len(p.compress(view[i : i + PIECE])) for i in range(0, len(raw), PIECE)) for p in self.packers)
        return (bad - good) / len(raw) if raw else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the size difference, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    scale = np.array([x.std() + 1e-9, 1.0])
    a = a / scale
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    w = w / scale
    return float(w[0]), float(w[1])


def dictionary(pieces: list[bytes]) -> bytes:
    """A zstandard dictionary of the pieces; of too few for its builder, the pieces themselves.

    The builder takes its segments from stretches of the pieces in turn, so like
    pieces are spread by the order of their checksums.
    """
    pieces = sorted((p for p in pieces if len(p) >= MATCH), key=lambda p: (zlib.crc32(p), p))
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, k=SEGMENT, d=MATCH).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-DICT_BYTES:].rjust(16, b" ")


def _sampled_ids(labels: DataFrame, label: str) -> list[tuple[int, int, int]]:
    """(doc_id, label, remainder) of each label's rows of lowest doc_id hash.

    Counts give the hash below which about enough rows lie, so that what
    reaches the driver is bounded however many rows and partitions there are.
    """
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    known = labels.where(F.col(label).isin(0, 1) & (part != 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    known = known.select("doc_id", "y", part.cast("int").alias("part"), F.xxhash64("doc_id").alias("h"))
    low = F.lit(False)
    for r in known.groupBy("y", "part").count().collect():  # at most four rows
        n = FIT_ROWS if r["part"] else DICT_ROWS
        low = low | ((F.col("y") == r["y"]) & (F.col("part") == r["part"]) & _lowest("h", (n + 6 * n**0.5) / r["count"]))
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in known.where(low).collect():
        taken.setdefault((r["y"], r["part"]), []).append((r["h"], r["doc_id"]))
    return [(i, y, of) for (y, of), rows in sorted(taken.items()) for _, i in sorted(rows)[: FIT_ROWS if of else DICT_ROWS]]


def _lowest(h: str, share: float):
    """Whether a 64-bit hash is in this share of the lowest ones."""
    return F.col(h) <= min(2**63 - 1, int(min(1.0, share) * 2**64) - 2**63)


def _dictionaries(texts: DataFrame) -> tuple[bytes, bytes]:
    """Dictionaries of good and bad text, from pieces all over the whole texts."""
    size = {r["y"]: int(r["n"] or 0) for r in texts.groupBy("y").agg(F.sum(F.ceil(F.octet_length("t") / PIECE)).alias("n")).collect()}
    raw = F.encode("t", "UTF-8")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length("t") / PIECE).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.substring(raw, i * PIECE + 1, F.lit(PIECE)).alias("piece")))
    pieces = texts.where("t <> ''").select("doc_id", "y", F.explode(cut).alias("p")).select("y", "p.piece", F.xxhash64("doc_id", "p.i").alias("h"))
    chosen = [
        [bytes(r["piece"]) for r in pieces.where((F.col("y") == y) & _lowest("h", DICT_PIECES / max(1, size.get(y, 0)))).select("piece").collect()]
        for y in (1, 0)
    ]
    return dictionary(chosen[0]), dictionary(chosen[1])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from labelled rows whose crc32(doc_id as text) mod 3 is not 1.

    Of these, remainder 0 gives the dictionaries and 2 the calibration. Each
    sample is the labelled ids of lowest hash, bounded as documented above; the
    texts are taken whole, and where a label's have more than DICT_PIECES
    pieces, the dictionary is built from those of lowest hash. Of rows that
    share an id, the least text counts. Null labels, null texts and labels
    without a document are left out; without texts of both labels every score
    is 0.5. Only the sampled ids, at most 2 * (DICT_ROWS + FIT_ROWS), are
    broadcast, and only the dictionaries' pieces and one number per calibration
    text reach the driver.
    """
    spark = documents.sparkSession
    ids = spark.createDataFrame(_sampled_ids(labels, label), "doc_id long, y int, part int")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t")).where("t is not null")
    texts = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "part").agg(F.min("t").alias("t"))
    texts = materialise(texts, "labelled")
    good, bad = _dictionaries(texts.where("part = 0"))
    small_batches(spark)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(good, bad)
        for b in batches:
            d = [meter.difference(t.as_buffer().to_pybytes()) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(d, pa.float64())], ["y", "d"])

    fit = sorted((r["y"], r["d"]) for r in texts.where("part = 2").select("y", "t").mapInArrow(measure, "y int, d double").collect())
    y, d = np.array([float(a) for a, _ in fit]), np.array([b for _, b in fit])
    slope, shift = calibrate(d, y) if len(set(y)) == 2 else (0.0, 0.0)
    return Model(good, bad, slope, shift)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and size_difference of every whole text.

    A null text scores as an empty one; every row, repeated ones too, gives one
    row; doc_id may be null (held_out is then false); a very long text is
    compressed piece by piece; an empty table gives no rows. Only doc_id and
    text are read, whatever other columns there are.
    """
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model.good, model.bad)
        for b in batches:
            d = np.array([meter.difference(t.as_buffer().to_pybytes()) for t in b.column("text")], np.float64)
            p = model.probability(d)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(d)], ["doc_id", "held_out", "score", "predicted", "size_difference"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long"), held.alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, size_difference double")
