"""Token ids in Parquet list columns, for selective reads.

Rows lie in ascending doc_id order over files in name order. ``ids`` is
dictionary-encoded (a vocabulary fits one dictionary page), counts and
positions are delta-encoded, row groups are of ROW_GROUP bytes and every column
chunk has a page index, so that a reader gets single documents or only the
metadata without decoding the rest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, new_path, small_batches, text_or_empty

ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Bytes of text encoded at once, but for a longer text.
BATCH = 4 << 20
#: Units kept with their ids by a worker; beyond, a new table starts and the last one is kept to take from.
WORD_CACHE = 250_000

FORMAT = {
    "parquet.block.size": str(ROW_GROUP),
    "parquet.page.size": str(PAGE),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#part_start": "false",
    "compression": "zstd",
}

#: A Latin word after at most one space: one pre-token.
_LETTERS = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = ~_LETTER[33:127]
#: Byte-level vocabularies write visible bytes as themselves, others from U+0100 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_NAMES = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

_WHITE = re.compile(r"\s")


class Encoder:
    """Ids of whole texts.

    The vocabulary's pre-tokeniser starts anew at a lone space or line feed
    between two visible characters. Texts where all white space is of that kind
    are cut there into units (a word with the space before it, or a line feed),
    and, for the byte-level pattern, between an ASCII letter and a digit or sign.
    A batch's units are made distinct by Arrow, each new one is encoded once per
    worker, and the ids are laid out by index. Other texts, and those that
    contain an added token's string, are encoded in one piece. A new unit of
    Latin letters is one pre-token and goes straight to the library's model.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [t.encode() for t in special if t]
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        probe = self.tokenizer.encode("a b\nc", add_special_tokens=False).ids
        parts = [i for x in ("a", " b", "\n", "c") for i in self.tokenizer.encode(x, add_special_tokens=False).ids]
        self.by_word = len(feed) == 1 and probe == parts and not any(_WHITE.search(t) for t in special)
        self.feed = feed[0] if feed else -1
        made = json.loads(self.tokenizer.to_str())
        split, model = made.get("pre_tokenizer") or {}, made["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        quiet = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        bare = made.get("normalizer") is None and made.get("post_processor") is None
        self.direct = bool(plain and quiet and bare and model.get("type") == "BPE")
        self.units: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, units: list[str]) -> None:
        """Ids of new units; None for those whose texts are to be encoded in one piece."""
        table, rest = self.units, units
        if self.direct:
            rest, tokenize, space = [], self.tokenizer.model.tokenize, _BYTE_NAMES[32]
            for u in units:
                if u.isascii() and (u.isalpha() or u[0] == " " and u[1:].isalpha()):
                    name = u
                elif _LETTERS.fullmatch(u):
                    name = u.encode().decode("latin-1").translate(_BYTE_NAMES)
                else:
                    rest.append(u)
                    continue
                if name[0] == " ":
                    name = space + name[1:]
                table[u] = array("I", [t.id for t in tokenize(name)]).tobytes()
        plain = []
        for u in rest:
            body = u[1:] if u[0] == " " else u
            if u == "\n":
                table[u] = np.array([self.feed], "<u4").tobytes()
            elif not body or _WHITE.search(body):
                table[u] = None
            else:
                plain.append(u)
        for low in range(0, len(plain), 20_000):
            part = plain[low : low + 20_000]
            ids = np.array(self.tokenizer.encode("\n".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.feed), len(ids)).tolist()
            if len(ends) != len(part):
                raise ValueError("the vocabulary joins line feeds with words")
            raw, at = ids.tobytes(), 0
            for u, end in zip(part, ends, strict=True):
                table[u] = raw[4 * at : 4 * end]
                at = end + 1

    def _special_in(self, raw: np.ndarray) -> np.ndarray:
        """Where strings of added tokens start."""
        found, text = [], raw.tobytes()
        for t in self.special:
            at = text.find(t)
            while at >= 0:
                found.append(at)
                at = text.find(t, at + 1)
        return np.array(found, np.int64)

    def _by_unit(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their count in each text, without those of the texts that the third array marks."""
        feeds = raw == 10
        white = feeds | (raw == 32)
        cut = np.zeros(len(raw) + 1, bool)
        cut[:-1] = white
        cut[1:] |= feeds
        if self.direct:
            cut[1:-1] |= _LETTER[raw[:-1]] & _SIGN[raw[1:]]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        width = np.int32 if len(raw) < 1 << 31 else np.int64
        strings = pa.string() if width == np.int32 else pa.large_string()
        units = pa.Array.from_buffers(strings, len(at) - 1, [None, pa.py_buffer(at.astype(width)), pa.py_buffer(raw)]).dictionary_encode()
        index, names = units.indices.to_numpy(), units.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.units) > WORD_CACHE:
            self.older, self.units = self.units, {}
        unseen = [u for u in names if u not in self.units]
        self.units.update((u, self.older[u]) for u in unseen if u in self.older)
        self._learn([u for u in unseen if u not in self.older])
        ids = [self.units[u] for u in names]

        odd = np.zeros(len(offsets) - 1, bool)
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        odd[filled] = white[offsets[filled]] | white[offsets[filled + 1] - 1]
        strange = np.array([x is None for x in ids], bool)
        places = np.concatenate([np.flatnonzero(white[:-1] & white[1:]) + 1, at[:-1][strange[index]], self._special_in(raw)])
        odd[np.searchsorted(offsets, places, "right") - 1] = True

        size = np.array([len(x or b"") // 4 for x in ids], width)
        flat, first = np.frombuffer(b"".join([x or b"" for x in ids]), "<i4"), np.cumsum(size, dtype=width) - size
        text_of = np.searchsorted(at, offsets)
        n = size[index]
        if odd.any():
            n[np.repeat(odd, np.diff(text_of))] = 0
        end = np.cumsum(n, dtype=width)
        at_id = np.repeat(first[index] - (end - n), n)
        at_id += np.arange(len(at_id), dtype=width)
        return flat[at_id], np.diff(np.append(0, end)[text_of]), odd

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, ``end`` after each, and their counts with it."""
        if self.by_word:
            ids, sizes, odd = self._by_unit(raw, offsets)
        else:
            ids, sizes, odd = np.zeros(0, "<i4"), np.zeros(len(offsets) - 1, np.int64), offsets[1:] > offsets[:-1]
        if odd.any():
            parts, done, at = [], 0, np.append(0, np.cumsum(sizes))
            for k in np.flatnonzero(odd).tolist():
                own = np.frombuffer(self.whole(raw[offsets[k] : offsets[k + 1]].tobytes().decode()), "<i4")
                parts += [ids[done : at[k]], own]
                done, sizes[k] = at[k], len(own)
            ids = np.concatenate([*parts, ids[done:]])
        sizes = sizes + 1
        last = np.cumsum(sizes) - 1
        out = np.full(len(ids) + len(sizes), end, "<i4")
        keep = np.ones(len(out), bool)
        keep[last] = False
        out[keep] = ids
        return out, sizes


def _joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches laid together until they hold ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(documents: DataFrame, path: str, vocabulary: str, end_id: int) -> str:
    """Encode all texts and write them to ``path``; returns it.

    Null and empty texts hold the end id alone. Rows with equal doc_id, null
    among them, lie side by side, over several files if they are many; no row is dropped. Columns other than doc_id
    and text are not read. An empty table writes a file without rows.
    """
    spark = documents.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = encoder(vocabulary), 0
        for b in _joined(batches, BATCH):
            raw, offsets = buffers(b.column("text"))
            low = 0
            while low < b.num_rows:
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + 2 * BATCH, "right")) - 1)
                own = offsets[low : high + 1]
                flat, sizes = enc.encode(raw[own[0] : own[-1]], own - own[0], end_id)
                ends = np.append(0, np.cumsum(sizes))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                columns = [b.column("doc_id")[low:high], pa.array(sizes), b.column("part")[low:high], pa.array(total + ends[:-1]), ids]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "part", "part_start", "ids"])
                total, low = total + int(ends[-1]), high

    rows = documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    # the text's head and a salt only divide the rows of a frequent doc_id among tasks
    keyed = rows.withColumns({"_head": F.substring("text", 1, 32), "_salt": F.rand(0)}).repartitionByRange("doc_id", "_head", "_salt")
    dealt = keyed.select("doc_id", "text").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    dealt.mapInArrow(run, "doc_id long, n_tokens long, part int, part_start long, ids array<int>").write.options(**FORMAT).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``, the ids of all documents before each.

    One number per file is summed up and broadcast.
    """
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(F.broadcast(first), "part").withColumn("start", F.col("_first") + F.col("part_start")).drop("_first")


def digest(tokens: DataFrame) -> DataFrame:
    """Start, count and checksum of each document's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("ids")
            flat, at = column.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.append(0, np.cumsum(b.column("n_tokens").to_numpy()))
            raw = memoryview(flat.tobytes())
            sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_documents(documents: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids to the shared folder and read their digest back."""
    spark = documents.sparkSession
    return digest(read_tokens(spark, write_tokens(documents, new_path(spark, "tokens"), vocabulary, end_id)))
