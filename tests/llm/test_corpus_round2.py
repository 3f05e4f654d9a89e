"""Findings of the second round on the corpus operators."""

import tracemalloc

import numpy as np
import pyarrow as pa

from annograph.llm import common, exchange, setjoin


def test_hashing_stays_in_the_cache():
    """Text is hashed in temporaries that a core's cache holds; a word longer than one of them is one all the same."""
    words = [f"w{k % 7919}" for k in range(50_000)]
    raw, offsets = common.buffers(pa.array([" ".join(words)]))
    common.hashed_words(raw, offsets)
    tracemalloc.start()
    plain = common.hashed_words(raw, offsets)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.5e6
    h, first = common.hashed_words(*common.buffers(pa.array([" ".join(words), "x" * 300_000, "a b"])))
    assert first.tolist() == [0, 50_000, 50_001, 50_003] and (h[:50_000] == plain).all() and len(np.unique(h)) == 7919 + 3


def test_run_is_sorted_once():
    """A run's tokens of all batches are sorted and counted together, however often a batch has one."""
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 500, n).astype(np.uint64) for n in (900, 1, 300)]
    tok, n = exchange.merged(parts)
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert (tok == want[0]).all() and (n == want[1]).all() and len(exchange.merged([np.zeros(0, np.uint64)])[0]) == 0


def test_tokens_of_equal_last_bits():
    """Tokens that end in the same bits are told apart, though only the last of them is found directly."""
    size = exchange.Size(1000, 1000)
    tokens = np.unique(np.concatenate([np.arange(1, 4000, 3, dtype=np.uint64) + (np.uint64(k) << np.uint64(22)) for k in (0, 1, 5)]))
    kinds = (np.arange(len(tokens)) % 255 + 1).astype(np.uint8)
    known = exchange.Shared(size, [(exchange.ints(np.diff(tokens, prepend=np.uint64(0)), 8), exchange.packed_bytes(kinds.tobytes()))])
    asked = np.concatenate([tokens[::-1], tokens + np.uint64(1), tokens + (np.uint64(9) << np.uint64(22))])
    got = known.of(asked << np.uint64(64 - size.bits))
    assert (got[: len(tokens)] == kinds[::-1]).all() and not got[len(tokens) :].any() and len(known.left) > 0


def test_shingles_lie_in_their_document():
    texts = pa.array(["a b c d e f", "", "a b", None, "x " * 7, "a b c d e"])
    doc, tok, size, words = setjoin.counted_shingles(texts.fill_null(""), 5)
    assert size.tolist() == [2, 0, 1, 0, 1, 1] and words.tolist() == [6, 0, 2, 0, 7, 5] and doc.tolist() == [0, 0, 2, 4, 5]
    assert tok[-1] in tok[:2]


def test_pairs_of_blocks_are_bounded_by_tokens(spark, monkeypatch):
    # blocks of 150 sets at most, but of any length, once met in one task
    monkeypatch.setattr(setjoin, "BLOCK_TOKENS", 1000)
    rows = spark.range(40).selectExpr("7L AS list", "id AS component", "id AS doc_id", "100L AS size")
    sets = spark.range(40).selectExpr("7L AS list", "id AS doc_id", "100L AS n", "cast('' AS binary) AS toks", "cast('' AS binary) AS pre")
    held, met = {}, set()
    for r in setjoin._paired(rows, sets).collect():
        held.setdefault((r.i, r.j), []).append(r.doc_id)
    for ids in held.values():
        met |= {(a, b) for a in ids for b in ids}
    assert len(met) == 40 * 40
    assert max(100 * len(ids) for ids in held.values()) < 4000
