"""Exact set-similarity self-join on word shingles.

Equal sets are one class. Each set's prefix, its rarest tokens by corpus count,
is indexed; sets that can link share a prefix token, so they meet in its list.
Lists whose sets all meet in another list are dropped, the others bundled by the
sets that they share, and each bundle is joined. In it, the sets that share a
token are kept by size, with the position of the token in each set, so that
blocks of too small sets and positions too late for the overlap needed are
skipped; and the answers of a set follow from those of the most similar set
already answered: its whole component is skipped once they link, and a set that
the similar one misses by far needs no comparison. Large bundles are cut into blocks; what the blocks found tells
which sets of different blocks are linked already, and only the others meet.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, copies_of, discard, frequent_texts, hashed_words, materialise, mixed, sequences, small_batches, text_hashes, text_or_empty, within
from .components import connected_components
from .exchange import Shared, Size, by_run, shared_tokens, text_batches, unpack_texts

#: Sets and tokens of a block of a bundle; larger bundles are cut into blocks.
BLOCK_DOCS, BLOCK_TOKENS = 150, 1_000_000
#: How tables of hashes are written, as these don't pack.
_PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
#: Tokens of the bundles that are joined in one task, about.
TASK_TOKENS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles link at ``percent`` of their union or more."""

    words: int = 5
    percent: int = 80

    def overlap(self, a: int, b: int) -> int:
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least(self, n: int) -> int:
        """Size of the smallest set that a set of size n can link with."""
        return -(-self.percent * n // 100)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, set size by document); each token once, in order.

    Tokens are 54-bit hashes. A text of fewer words is one token, of all; a
    text without words has none.
    """
    return counted_shingles(texts, words)[:3]


def counted_shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``shingles``, and the words by document."""
    docs, toks, sizes, counts = [], [], [], []
    for low in range(0, len(texts), 200):
        part = texts.slice(low, 200)
        h, first = hashed_words(*buffers(part), fold=True)
        n = np.diff(first)
        starts = within(first, words)
        tok = sequences(h, words)[starts] >> np.uint64(10)
        doc = np.repeat(np.arange(len(part)), np.maximum(n - words + 1, 0))
        short = np.flatnonzero((n > 0) & (n < words))
        if len(short):
            own = np.array([sequences(h[first[i] : first[i + 1]], int(n[i]))[0] for i in short], np.uint64)
            own = mixed(own + n[short].astype(np.uint64)) >> np.uint64(10)
            tok, doc = np.concatenate([tok, own]), np.concatenate([doc, short])
        key = (doc.astype(np.uint64) << np.uint64(54)) | tok
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        doc, tok = (key >> np.uint64(54)).astype(np.int64), key & np.uint64((1 << 54) - 1)
        sizes.append(np.bincount(doc, minlength=len(part)))
        counts.append(n)
        docs.append(doc + low)
        toks.append(tok)
    empty = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, (docs, toks, sizes, counts))) if docs else (empty, empty.astype(np.uint64), empty, empty)


def _signatures(doc: np.ndarray, tok: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (0x1234567, 0x89ABCDEF):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(tok + np.uint64(salt)))])
        edge = np.searchsorted(doc, np.arange(n + 1))
        out.append((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
    return out[0], out[1]


def _narrow(tokens: np.ndarray) -> bytes:
    """Tokens of 54 bits in seven bytes each."""
    return np.ascontiguousarray(tokens.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def _tokens(words: int):
    def run(texts: pa.Array) -> np.ndarray:
        return shingles(texts, words)[1] << np.uint64(10)

    return run


class _Roots:
    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.of(a), self.of(b)
        self.up[max(a, b)] = min(a, b)


def link(sets: list[np.ndarray], prefixes: list[np.ndarray], rule: Rule, sides: list[int] | None = None, known: list | None = None) -> list[tuple[int, int]]:
    """Pairs that link, enough of them to connect all that links connect.

    ``sets`` by size, each in the common order of tokens; a prefix is the
    positions of a set's indexed tokens. With ``sides`` (0 or 1), only pairs of
    different sides are tried. Sets that are equal in ``known`` are connected
    already.
    """
    roots = _Roots(len(sets))
    if known is not None:
        head: dict = {}
        for i, c in enumerate(known):
            roots.join(i, head.setdefault(c, i))
    # token -> numbers and positions of the earlier sets in whose prefix it is, by size
    lists: dict[int, tuple[array, array]] = {}
    begin: dict[int, int] = {}
    bags: list[frozenset | None] = [None] * len(sets)
    missed: list[dict[int, int]] = [{} for _ in sets]  # overlaps of pairs that were tried and don't link
    sizes = np.array([len(s) for s in sets], np.int64)
    where = None if sides is None else np.array(sides)
    found: list[tuple[int, int]] = []

    def bag(i: int) -> frozenset:
        if bags[i] is None:
            bags[i] = frozenset(sets[i].tolist())
        return bags[i]

    for x, s in enumerate(sets):
        n, small = len(s), rule.least(len(s))
        seen, ahead = [], []
        for p in prefixes[x].tolist():
            t = int(s[p])
            if t in lists:
                ids, at = lists[t]
                k = begin[t]  # sets are by size: the block of too small ones stays skipped
                while k < len(ids) and sizes[ids[k]] < small:
                    k += 1
                begin[t] = k
                if k < len(ids):
                    who, pos = np.frombuffer(ids, np.int32)[k:].copy(), np.frombuffer(at, np.int32)[k:].copy()
                    seen.append(who)
                    ahead.append(np.minimum(sizes[who] - pos, n - p))  # the most that they can still share
        if seen:
            who, most = np.concatenate(seen), np.concatenate(ahead)
            own, first, shared = np.unique(who, return_index=True, return_counts=True)
            # the first shared token is the first in order, so with it comes the largest bound
            need = -(-rule.percent * (sizes[own] + n) // (100 + rule.percent))
            ok = most[first] >= need
            if where is not None:
                ok &= where[own] != where[x]
            own, shared = own[ok], shared[ok]
            like, like_n = -1, 0  # the most similar set that was compared, and the overlap
            for y in own[np.argsort(-shared, kind="stable")].tolist():
                if roots.of(y) == roots.of(x):
                    continue
                alpha = rule.overlap(n, len(sets[y]))
                if like >= 0:
                    miss = missed[like].get(y, missed[y].get(like))
                    if miss is not None and miss + n - like_n < alpha:
                        continue  # what x has beyond the similar set is too little
                o = len(bag(x) & bag(y))
                if o >= alpha:
                    roots.join(x, y)
                    found.append((x, y))
                else:
                    missed[x][y] = o
                if o > like_n:
                    like, like_n = y, o
        for p in prefixes[x].tolist():
            ids, at = lists.setdefault(int(s[p]), (array("i"), array("i")))
            begin.setdefault(int(s[p]), 0)
            ids.append(x)
            at.append(p)
    return found


_MEMBER = ("list", "i", "j", "side", "doc_id", "component", "toks", "pre")


def _joined(rule: Rule):
    """Links within (list, i, j) groups that come sorted by group and set size.

    Where i and j differ, only sets of different sides meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def close() -> pa.RecordBatch:
            crossed = key[1] != key[2]
            got = link([r[2] for r in rows], [r[3] for r in rows], rule, [r[4] for r in rows] if crossed else None, [r[1] for r in rows])
            a, b = [rows[i][0] for i, _ in got], [rows[j][0] for _, j in got]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            for t, i, j, side, doc_id, component, toks, pre in zip(*(b.column(c).to_pylist() for c in _MEMBER), strict=True):
                if (t, i, j) != key:
                    if len(rows) > 1:
                        yield close()
                    key, rows = (t, i, j), []
                rows.append((doc_id, component, _wide(toks), np.frombuffer(pre, "<i4"), side))
        if len(rows) > 1:
            yield close()

    return run


def _blocks(sets: Column, tokens: Column) -> Column:
    """Blocks for so many sets of so many tokens in all."""
    return F.greatest(F.lit(1), F.ceil(sets / BLOCK_DOCS), F.ceil(tokens / BLOCK_TOKENS)).cast("int")


def _bundles(indexed: DataFrame) -> DataFrame:
    """(list, doc_id, block, k): the sets that have to meet, by bundles of lists.

    Of lists of the same members one stays. A set's home is its longest list; a
    list whose members all have the same home lies within it and is dropped. The
    others go into the bundle named by the home of their member of least hash,
    so lists that share most members, as those of near copies do, make one
    bundle, and a set is sent once for most of its lists and not once a token.
    Bundles are named by one step only: they don't grow into one another.
    """
    entries = indexed.select("doc_id", "n", F.explode("listed").alias("list"))
    whole = entries.groupBy("list").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.expr("bit_xor(xxhash64(doc_id))").alias("x"), F.expr("sum(shiftrightunsigned(xxhash64(1, doc_id), 34))").alias("y"),
    ).where("m > 1")
    distinct = whole.groupBy("m", "w", "low", "high", "x", "y").agg(F.min("list").alias("list")).select("list", "m")
    member = materialise(_with_list(entries, distinct), "entries")
    home = member.groupBy("doc_id").agg(F.max_by("list", F.struct("m", "list")).alias("home"))
    inside = member.join(home, "doc_id").groupBy("list").agg(F.min("home").alias("one"), F.max("home").alias("other"), F.min_by("home", F.struct(F.xxhash64("doc_id"), "doc_id")).alias("bundle"))
    kept = inside.where("one <> other or one = list").select("list", "bundle")
    dealt = _with_list(member, kept).groupBy(F.col("bundle").alias("list"), "doc_id").agg(F.max("n").alias("n"))
    dealt = materialise(dealt, "bundles")
    size = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    out = _with_list(dealt, size.where("m > 1").select("list", _blocks(F.col("m"), F.col("w")).alias("k"))).select("list", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int").alias("block"), "k")
    discard(member)
    return out


def _links(rows: DataFrame, rule: Rule, tokens: int, name: str) -> DataFrame:
    """Links of rows of _MEMBER and n, each (list, i, j) group in one task."""
    parts = max(32, -(-tokens // TASK_TOKENS))
    dealt = rows.repartition(parts, "list", "i", "j").sortWithinPartitions("list", "i", "j", "n", "doc_id")
    return materialise(dealt.select(*_MEMBER).mapInArrow(_joined(rule), "a long, b long"), name)


def _connected(member: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the component that the links give them, their own id where they have none."""
    known = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("found"))
    return member.drop("component").join(known, "doc_id", "left").withColumn("component", F.coalesce("found", "doc_id")).drop("found")


def _between(long: DataFrame, links: DataFrame, rule: Rule, tokens: int) -> DataFrame:
    """Links between the blocks of large bundles, given those found within blocks.

    ``long`` has the members of such bundles with their sets. First one set of
    each component and bundle meets those of the others. Then, where the sets of
    a bundle are still not all connected, those outside its largest component
    meet all sets of other components. So the rows grow with a bundle's size
    times the blocks of its outsiders, not with its square, and no pair is left
    out.
    """
    light, sets = long.select("list", "doc_id", "block", F.col("n").alias("size")), long.select("list", "doc_id", "n", "toks", "pre")
    whole = _connected(light, links)
    heads = whole.groupBy("list", "component").agg(F.min("doc_id").alias("doc_id"), F.min_by("size", "doc_id").alias("size"))
    more = links.unionAll(_links(_paired(heads, sets), rule, tokens, "head_links"))
    whole = materialise(_connected(light, more), "connected")
    parts = whole.groupBy("list", "component").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("w"))
    largest = F.max(F.struct("count", "component", "w"))
    main = parts.groupBy("list").agg(largest.alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("count").alias("m"), F.sum("w").alias("w"))
    outsiders = _blocks(F.col("m") - F.col("top.count"), F.col("w") - F.col("top.w")).alias("ko")
    open_ = materialise(_with_list(whole, main.where("parts > 1").select("list", F.col("top.component").alias("main"), outsiders)), "open")
    others = open_.where("component <> main")
    # task (-1 - block of the main component, block of outsiders): the sides differ
    members = open_.where("component = main").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ko") - 1)))
    members = members.select("list", (-1 - F.col("block")).cast("int").alias("i"), "j", F.lit(0).alias("side"), "doc_id", "component")
    blocks = open_.where("component = main").select("list", "block").distinct().groupBy("list").agg(F.collect_list("block").alias("blocks"))
    guests = _with_list(others, blocks).withColumn("block", F.explode("blocks"))
    guests = guests.select("list", (-1 - F.col("block")).cast("int").alias("i"), F.pmod(F.xxhash64("doc_id"), F.col("ko")).cast("int").alias("j"), F.lit(1).alias("side"), "doc_id", "component")
    across = members.unionAll(guests).join(sets, ["list", "doc_id"]).select(*_MEMBER, "n")
    among = _paired(others.select("list", "component", "doc_id", "size"), sets)
    return more.unionAll(_links(among.unionAll(across), rule, tokens, "outsider_links"))


#: A bundle's rows meet what is known of the bundle in so many parts.
PARTS = 4


def _with_list(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``known``, one row a bundle; a large bundle is no hot key."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("_part")
    every = F.explode(F.array(*(F.lit(k).cast("long") for k in range(PARTS)))).alias("_part")
    return rows.select("*", part).join(known.select("*", every), ["list", "_part"]).drop("_part")


def _paired(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (list, component, doc_id, size in tokens) with their sets, in all pairs of blocks of each bundle."""
    k = rows.groupBy("list").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("k"))
    dealt = _with_list(rows, k).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    paired = dealt.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc_id", "component")
    return paired.join(sets, ["list", "doc_id"]).select(*_MEMBER, "n")


def similar_classes(documents: DataFrame, rule: Rule = Rule(), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id for every document, then n_words and the
    columns ``keep`` if any are named.

    Words are of lower-cased (A-Z) text. component_id is the smallest doc_id
    reachable by links, itself included. Null and empty texts, and those
    without words, have no shingles and link with nothing; very long texts are
    sets like others. Rows of equal doc_id and equal text come back as often as
    they are there; rows of one doc_id are one node of the graph. Rows of null
    doc_id link with nothing and have a null component_id. An empty table gives
    no rows. Other columns are not read. Tokens are 54-bit hashes of shingles.
    """
    spark = documents.sparkSession
    small_batches(spark)
    text = text_or_empty()
    carried = {f"keep_{k}": c for k, c in enumerate(keep)}  # by number, as names may clash
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *text_hashes(text), *(F.col(f"`{c}`").alias(k) for k, c in carried.items()))
    words = rule.words

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets = buffers(b.column("text"))[1]
            doc, tok, n, w = counted_shingles(b.column("text"), words)
            one, two = _signatures(doc, tok, b.num_rows)
            numbers = {"n": n, "s1": one, "s2": two, "bytes": np.diff(offsets), "w": w}
            columns = {"doc_id": b.column("doc_id"), **{k: pa.array(np.asarray(v, np.int64)) for k, v in numbers.items()}, "h1": b.column("h1"), "h2": b.column("h2"), **{k: b.column(k) for k in carried}}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n", "s1", "s2", "bytes", "w", "h1", "h2")] + [rows.schema[k] for k in carried])
    sets = materialise(rows.mapInArrow(measure, schema), "sets")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    total = sets.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    size = Size(int(total["bytes"] or 0), int(total["n"] or 0))
    frequent = frequent_texts(sets.where("n > 0"))

    batches = text_batches(rows.select("doc_id", "text", "h1", "h2").where("doc_id is not null and text <> ''"), size, lambda b: copies_of(frequent, b), level=3)
    shared = shared_tokens(batches, _tokens(words), size)

    def index(_: int, more: list[tuple[bytes, bytes]]):
        known = Shared(size, more)

        def each(blob: bytes) -> Iterator[pa.RecordBatch]:
            ids, texts = unpack_texts(blob)
            doc, tok, sizes = shingles(texts, words)
            if not len(tok):
                return
            kind = known.of(tok << np.uint64(10))
            length = sizes - -(-rule.percent * sizes // 100) + 1
            # tokens of no other document come first: where these fill the prefix, nothing is listed
            some = np.bincount(doc, weights=kind == 0, minlength=len(sizes)) < length
            keep = some[doc]
            doc, tok, kind, sizes = doc[keep], tok[keep], kind[keep], np.where(some, sizes, 0)
            if not len(tok):
                return
            order = np.argsort((doc << 8) | kind, kind="stable")  # each document's tokens are in order
            tok, kind = tok[order], kind[order]
            start = np.append(0, np.cumsum(sizes))
            place = np.arange(len(tok)) - start[doc]
            listed = (kind > 0) & (place < length[doc])
            out: list[tuple] = []
            for d in np.unique(doc[listed]).tolist():
                low, high = start[d], start[d + 1]
                own = listed[low:high]
                out.append((ids[d].as_py(), int(sizes[d]), _narrow(tok[low:high]), np.flatnonzero(own).astype("<i4").tobytes(), tok[low:high][own].view(np.int64)))
            if out:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n", "toks", "pre", "listed"])

        return each, lambda: iter(())

    indexed = materialise(by_run(batches, shared, size, index, "doc_id long, n long, toks binary, pre binary, listed array<long>"), "indexed", **_PLAIN)
    # rows of one doc_id are one node, but each is a set; their number keeps them apart
    whole = indexed.select("doc_id", "n", "toks", "pre")
    member = materialise(_bundles(indexed).join(indexed.drop("listed"), "doc_id"), "members", **_PLAIN)
    discard(batches, indexed)
    within_blocks = member.select("list", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "doc_id", F.col("doc_id").alias("component"), "toks", "pre", "n")
    links = _links(within_blocks, rule, size.tokens, "links")
    long = member.where("k > 1")
    if long.take(1):
        links = _between(long, links, rule, size.tokens)
    discard(member)
    linked = connected_components(links)

    reps = classes.join(linked, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    return sets.join(reps.withColumnsRenamed({"n": "_n", "s1": "_1", "s2": "_2"}), (F.col("n") == F.col("_n")) & (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        *([F.col("w").alias("n_words")] if keep else []), *(F.col(k).alias(c) for k, c in carried.items()),
    )


def keep_first(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One document of each group of linked ones, with all its columns: the one of
    the smallest doc_id; of rows that share it, the first by its columns. Rows of
    null doc_id all stay, as do null and empty texts, which link with nothing;
    very long texts are compared whole; an empty table gives no rows. Columns may
    have any names.
    """
    kept = similar_classes(documents, rule).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    # columns may have any names, so a row travels as one struct
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"))
    same = rows.join(kept, "id", "left_semi")
    again = same.groupBy("id").count().where("count > 1").select("id")
    once = same.join(again, "id", "left_anti").select("row")
    first = same.join(again, "id", "left_semi").groupBy("id").agg(F.min("row").alias("row")).select("row")
    return once.unionAll(first).unionAll(rows.where("id is null").select("row")).select("row.*")
