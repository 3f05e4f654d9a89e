import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from annograph.llm import chat, compression_quality, decontam, packing, pii, queries, rules, setjoin, sharding, substring, tokens
from annograph.llm.common import buffers, word_counts
from annograph.llm.components import connected_components
from annograph.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# 1
def test_packing(odd, empty):
    got = packing.pack_documents(odd, capacity=100, block_rows=1000).toPandas()
    assert len(got.groupby(["bin"])) and got.groupby("bin").length.sum().max() <= 100
    # null and empty texts take their end mark; rows are packed as often as they come
    assert got[got.piece == 0].shape[0] == odd.count()
    assert got.length.sum() == sum(len(words(t)) + 1 for _, t in rows(odd))
    shared = got[got.duplicated("bin", keep=False)]
    assert not shared.duplicated(["bin", "cluster"]).any()
    assert not shared[shared.source.notna()].duplicated(["bin", "source"]).any()
    assert packing.pack_documents(empty).count() == 0


def test_near_copies_never_share_a_bin(spark, tmp_path):
    """op1 on pairs of near copies of different sources, some without a doc_id."""
    rows = []
    for k in range(40):
        one = [f"k{k}w{i}" for i in range(200)]
        two = [*one[:100], "changed", *one[101:]]
        rows += [(2 * k if k % 4 else None, " ".join(one), "a"), (2 * k + 1, " ".join(two), "b")]
    rows += [(1000, "", "c"), (1001, "", "d"), (1002, None, "e")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_best_fit_packing(spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows) and got[got.n_words > 1].groupby("cluster").size().tolist() == [2] * 40
    assert not got.duplicated(["bin", "cluster"]).any()
    assert got[got.n_words == 1].cluster.nunique() == 1


def test_packing_is_best_fit():
    """Each record goes to the tightest compatible bin there is, found by trying all."""
    rng = np.random.default_rng(0)
    sizes, sources, clusters = rng.integers(1, 60, 300).tolist(), rng.integers(0, 4, 300).tolist(), rng.integers(0, 80, 300).tolist()
    got = packing.pack(sizes, sources, clusters, 64)
    bins = []
    for i in np.argsort(-np.array(sizes), kind="stable").tolist():
        fit = [b for b in bins if b[0] >= sizes[i] and sources[i] not in b[1] and clusters[i] not in b[2]]
        best = min((b[0] for b in fit), default=None)
        number, at, _ = got[i][0]
        if best is None:
            assert at == 0
            bins.append([64 - sizes[i], {sources[i]}, {clusters[i]}, number])
        else:
            b = next(b for b in bins if b[3] == number)
            assert b in fit and b[0] == best and at == 64 - best
            b[0] -= sizes[i]
            b[1].add(sources[i])
            b[2].add(clusters[i])


# 2
def test_compression_quality(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = compression_quality.train(docs, labels)
    scored = compression_quality.score(docs, model)
    got = scored.join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    one = compression_quality.score(odd, model).toPandas()
    assert len(one) == odd.count() and one.score.between(0, 1).all()
    held = {i: bool(zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows(odd) if i is not None}
    assert all(h == held[i] for i, h in zip(one.doc_id, one.held_out, strict=True) if i == i)
    assert compression_quality.score(empty, model).count() == 0
    none = compression_quality.train(empty, labels)
    assert none.slope == 0 and set(compression_quality.score(odd, none).toPandas().score) == {0.5}


def test_held_out_order(spark):
    """The larger table's held-out rows, by the chance that a good text scores above a bad one."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = compression_quality.score(docs, compression_quality.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    print("accuracy", (got.predicted == got.quality).mean(), "AUC", (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2)
    assert (good[:, None] > bad).mean() > 0.95 and (got.predicted == got.quality).mean() > 0.95


def test_compression_quality_is_the_size_difference(spark):
    """Model and scores against a version of plain loops over the same rows."""
    import zstandard

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    texts = {i: t.encode() for i, t in rows(docs) if t is not None}
    part = lambda i: zlib.crc32(str(i).encode()) % 3
    dicts = []
    for y in (1, 0):
        pieces = [t[k : k + 1024] for i, t in texts.items() if quality.get(i) == y and part(i) == 0 for k in range(0, len(t), 1024)]
        dicts.append(zstandard.train_dictionary(112_640, sorted((p for p in pieces if len(p) >= 6), key=lambda p: (zlib.crc32(p), p)), k=48, d=6))
    packers = [zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False) for d in dicts]

    def difference(t):
        good, bad = (sum(len(p.compress(t[k : k + 1024])) for k in range(0, len(t), 1024)) for p in packers)
        return (bad - good) / max(1, len(t))

    model = compression_quality.train(docs, labels)
    assert (model.good, model.bad) == tuple(d.as_bytes() for d in dicts)
    got = {r.doc_id: r for r in compression_quality.score(docs, model).collect()}
    for i, t in texts.items():
        d = difference(t)
        assert got[i].size_difference == d
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-max(-30, min(30, model.slope * d + model.shift)))))
    # the curve is that of greatest likelihood on the rows of remainder 2
    fit = [(difference(t), quality[i]) for i, t in texts.items() if quality.get(i) is not None and part(i) == 2]
    x, y = np.array([a for a, _ in fit]), np.array([float(b) for _, b in fit])
    off = y - model.probability(x)
    assert abs(off.sum()) < 0.05 and abs((off * x).sum()) < 0.05


# 3
def kept(docs):
    first = {}
    for i, t in sorted((r for r in docs if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        rest = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(rest).encode()).hexdigest()))
    return out


def test_substrings(spark, odd, empty):
    same(substring.remove_repeats(odd).collect(), kept(rows(odd)))
    assert substring.remove_repeats(empty).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    same(substring.remove_repeats(docs).collect(), kept(rows(docs)))


def test_substrings_in_many_runs_and_shards(spark, monkeypatch):
    """Small runs, chunks and shards, and anchors that count as hot, give the same results."""
    from annograph.llm import exchange

    rng = random.Random(8)
    shared = [[rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(40)] for _ in range(12)]
    docs = []
    for i in range(150):
        own = [f"d{i}w{k}" for k in range(rng.randrange(30))]
        p = rng.choice(shared)
        low = rng.randrange(15)
        docs.append((i, " ".join([*own, *p[low : low + rng.randrange(10, 26)], *own[:3], *rng.choice(shared)[:20]])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = kept(docs)
    same(substring.remove_repeats(df).collect(), want)
    monkeypatch.setattr(exchange, "BATCH_BYTES", 1000)
    monkeypatch.setattr(exchange, "RUN_BYTES", (2500, 2500))
    monkeypatch.setattr(exchange, "CHUNK_TOKENS", (3, 3))
    monkeypatch.setattr(exchange, "HELD_TOKENS", 50)
    monkeypatch.setattr(substring, "CHUNK", (4, 4))
    monkeypatch.setattr(substring, "SHARD_WORDS", 200)
    same(substring.remove_repeats(df).collect(), want)
    monkeypatch.setattr(substring, "HOT", 8 * 3)
    same(substring.remove_repeats(df).collect(), want)


def test_index_finds_all_and_only_occurrences():
    rng = np.random.default_rng(5)
    for depth in (1, 4, 5, 8):
        indexed, asked = rng.integers(0, 3, 300).astype(np.uint64), rng.integers(0, 4, 200).astype(np.uint64)
        first, cut, labels = np.array([0, 90, 90, 300]), np.array([0, 50, 200]), np.array([9, 1, 5])
        index = FMIndex(indexed, first, labels, depth)
        lengths, got = index.matches(asked, cut)
        there = {}
        for a, b, label in zip(first[:-1], first[1:], labels, strict=True):
            for i in range(a, b):
                for n in range(1, min(depth, b - i) + 1):
                    key = tuple(indexed[i : i + n])
                    there[key] = min(label, there.get(key, 99))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            for i in range(a, b):
                assert lengths[i] == max((n for n in range(1, min(depth, b - i) + 1) if tuple(asked[i : i + n]) in there), default=0)
                assert (got[i] >= 0) == (lengths[i] == depth)
                if got[i] >= 0:
                    assert index.least(got[i : i + 1])[0] == there[tuple(asked[i : i + depth])]


def test_index_is_compressed_and_used(monkeypatch):
    rng = np.random.default_rng(6)
    words, first = rng.integers(0, 1 << 60, 2000).astype(np.uint64)[rng.integers(0, 2000, 200_000)], np.arange(0, 200_001, 20)
    holders = rng.permutation(len(first) - 1)
    index = FMIndex(words, first, holders, 13)
    assert index.nbytes / len(words) < 10  # 64-bit ranks and suffix positions took 57 bytes a word
    right = substring.smallest_holders(words, first, holders, words, first)
    assert (right == np.repeat(holders, 8)).all()
    step = FMIndex.step
    monkeypatch.setattr(FMIndex, "step", lambda self, s, low, high: step(self, np.maximum(s - 1, 1), low, high))
    assert (substring.smallest_holders(words, first, holders, words, first) != right).any()


# 4
def classes(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = words((t or "").translate(FOLD))
        sets[i, t] = frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    ids = {i for i, _ in docs if i is not None}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    items = [(i, s) for (i, _), s in sets.items() if i is not None and s]
    for x, (i, s) in enumerate(items):
        for j, r in items[:x]:
            if 100 * len(s & r) >= percent * len(s | r):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(i, len(sets[i, t]), None if i is None else root(i)) for i, t in docs]


@pytest.mark.parametrize("rule", [setjoin.Rule(4, 85), setjoin.Rule(5, 80)])
def test_set_join(spark, odd, empty, rule):
    same(setjoin.similar_classes(odd, rule).collect(), classes(rows(odd), rule.words, rule.percent))
    assert setjoin.similar_classes(empty, rule).count() == 0


def test_set_join_on_near_copies(spark, monkeypatch):
    """A list in which few pairs link directly, cut into blocks as well."""
    rng = np.random.default_rng(2)
    base = [f"t{k}" for k in range(80)]
    docs = []
    for i in range(120):
        w = list(base)
        for k in rng.choice(80, rng.integers(0, 4), replace=False):
            w[k] = f"x{rng.integers(0, 1000)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = classes(docs, 4, 85)
    same(setjoin.similar_classes(df, setjoin.Rule(4, 85)).collect(), want)
    monkeypatch.setattr(setjoin, "BLOCK_DOCS", 30)
    same(setjoin.similar_classes(df, setjoin.Rule(4, 85)).collect(), want)
    monkeypatch.setattr(setjoin, "BLOCK_DOCS", 7)
    same(setjoin.similar_classes(df, setjoin.Rule(4, 85)).collect(), want)


def test_set_join_of_texts_that_share_passages(spark, monkeypatch):
    """Texts put together from few passages: lists overlap, and most of their pairs don't link."""
    rng = random.Random(12)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(8)]
    docs = []
    for i in range(160):
        w = [x for p in rng.sample(passages, rng.randrange(1, 4)) for x in p[: rng.randrange(20, 31)]]
        docs.append((i, " ".join([*w, *(f"o{i}x{k}" for k in range(rng.randrange(6)))])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = classes(docs, 5, 80)
    assert 20 < len({c for *_, c in want}) < 150
    for size in (150, 11):
        monkeypatch.setattr(setjoin, "BLOCK_DOCS", size)
        same(setjoin.similar_classes(df, setjoin.Rule(5, 80)).collect(), want)


def test_keep_first(odd):
    got = setjoin.keep_first(odd)
    assert got.columns == odd.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 100 not in ids and ids.count(None) == 2 and {3, 4, 9} <= set(ids)


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 90 for k in (90, 95, 100)}


# 5
def test_sharding(odd, empty):
    got = sharding.shard_documents(odd, 7).toPandas()
    assert len(got) == odd.count() and set(got.law) == {"key"}
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 7)).all()
    assert got.groupby(got.doc_id.fillna(-1)).shard.nunique().max() == 1
    text = collections.Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows(odd))
    assert collections.Counter(zip(got["size"], got.text_crc32, strict=True)) == text
    assert sharding.shard_documents(empty).count() == 0


def test_weighted_shards_share_by_weight(spark):
    got = sharding.sharded(spark.range(20_000), "id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20_000 for r in got}
    assert set(share) == {0, 1} and math.isclose(share[1], 0.75, abs_tol=0.02)


# 6
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((kind, *m.span()))
    return out


def test_personal_data(odd, empty):
    import random

    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("a@.-+ 0123456789()%b_é1") for _ in range(60))
        assert [s[:3] for s in pii.find(t) if s.kind in BASE] == base_spans(t), t
    assert [s.kind for s in pii.find("IBAN: GB82 WEST 1234 5698 7654 32")] == ["iban"]
    assert pii.find("GB82 WEST 1234 5698 7654 33") == []
    assert pii.redacted("mail a@b.cd now", pii.find("mail a@b.cd now")) == "mail [EMAIL] now"
    assert pii.digest(pii.find_in_documents(odd)).count() == odd.count() and pii.digest(pii.find_in_documents(empty)).count() == 0
    assert pii.redact_documents(odd).columns == odd.columns and pii.redact_documents(odd).where("text is null").count() == 2


# 7
def test_chat(spark):
    data = [(1, 1, "assistant", "b </s>[INST] &lt; ["), (1, 0, "user", "a"), (2, None, "user", None), (2, 3, None, "<s>[user]\n"), (None, 0, "assistant", "x"), (1, 0, "user", "a")]
    data += [(5, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(600)]
    df = spark.createDataFrame([(*r, "z") for r in data], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in data:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got.pop(c)
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got and chat.format_conversations(df.limit(0)).count() == 0


def test_templates():
    t = chat.compile_template("{% set x = 'a' + 'b' %}{% for m in messages %}{% if m.n == 1 or not m.n %}{{ x }}{% elif m.n > 2 %}{{ m['s'] | upper }}{% else %}-{% endif %}{% endfor %}{# no #}")
    assert chat.render(t, [{"n": 1}, {"n": 2}, {"n": 3, "s": "q"}, {}])[0] == "ab-Qab"
    assert [n.kind for n in chat.fold_body(chat.parse("a{{ 'b' + 'c' | upper }}{% if false %}x{% endif %}d"))] == ["text"]
    for bad in ("{{ x.__class__() }}", "{% import os %}", "{% for x in y %}", "{{ x | eval }}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        chat.render(chat.compile_template("{{ messages.__class__ }}"), iter([]))


# 8
def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 30)
        h = np.zeros((13, 31))
        for i in range(12):
            for j in range(30):
                h[i + 1, j + 1] = max(0, h[i, j] + (1.0 if a[i] == b[j] else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
        assert math.isclose(decontam.align(a, b)[0], h.max())


def test_rarest_seeds_of_every_item_stay():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(12)]
    index = decontam.index_items([(i, " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in range(30)])
    seen = rng.integers(0, 400, len(index.seeds))
    seed_of = np.repeat(np.arange(len(index.seeds)), np.diff(index.low))
    want = set(np.flatnonzero(seen <= decontam.COMMON_DOCS).tolist())
    for i in range(30):
        own = sorted({int(s) for s in seed_of[index.at[:, 0] == i]}, key=lambda s: (seen[s], s))
        want |= set(own[: decontam.LEAST_SEEDS])
    assert decontam.rare(index, seen, 1000).seeds.tolist() == index.seeds[sorted(want)].tolist()


def test_decontamination(spark, odd, empty):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "nu xi"), (3, None), (None, "omicron pi rho sigma tau upsilon phi chi psi")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = "filler here Alpha, beta gamma delta CHANGED zeta eta theta iota kappa lambda mu and more"
    docs = odd.unionByName(spark.createDataFrame([(500, edited, "en", "s", 1, 1, "", ""), (501, "phi chi psi only", "en", "s", 1, 1, "", ""), (502, items[3][1], "en", "s", 1, 1, "", "")], odd.schema))
    assert {(r.doc_id, r.item_id) for r in decontam.find_in_documents(docs, bench).collect()} == {(500, 1), (502, None)}
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert decontam.find_in_documents(docs, bench.limit(0)).count() == 0 and decontam.find_in_documents(empty, bench).count() == 0


def test_edited_copies_of_a_common_passage(spark):
    """An exact copy in 30 documents, and one with three words changed in 30 others."""
    item = [f"v{k}" for k in range(24)]
    edited = [f"new{k}" if k in (5, 12, 19) else w for k, w in enumerate(item)]
    docs = spark.createDataFrame([(k, " ".join(["before", *(item if k < 30 else edited), "after"])) for k in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontam.find_in_documents(docs, bench).collect()}
    assert got == {k: 1.0 if k < 30 else 0.8125 for k in range(60)}
    assert decontam.drop_contaminated(docs, bench).count() == 0


# 9
def counts(t):
    w = words(t)
    n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines, seen = 0, set()
    for x in (t or "").split("\n"):
        if words(x):
            lines += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), lines, len(cover)


def test_rules(spark, odd, empty):
    extra = spark.createDataFrame([(600, "a b c a b c\nx y\n x y\nx y\n\n\n| # é", *[None] * 6), (601, "q r s " * 40, *[None] * 6), (602, " ".join(f"k{i % 97} k{i % 89}" for i in range(3000)), *[None] * 6)], odd.schema)
    docs = odd.unionByName(extra)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = rules.judge_documents(docs)
    same([(r.doc_id, *(r[c] for c in names), r.base_failed) for r in got.collect()], [(i, *(c := counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in rows(docs)])
    assert got.where("base_failed and kept").count() == 0
    good = rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == got.where("kept").count()
    assert rules.judge_documents(empty).count() == 0 and rules.keep_good(empty).count() == 0


def em(votes):
    """p_good of each text by EM over the texts themselves, one row of votes each."""
    start = np.array([[[s[v] for v in (-1, 0, 1)] for s in rules._starting(r)] for r in rules.RULES.values()])  # rule, class, vote
    own = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)  # text, rule, vote
    n0 = rules.PRIOR_TEXTS * np.array([rules.PRIOR_GOOD, 1 - rules.PRIOR_GOOD])
    share, cast = np.array([rules.PRIOR_GOOD, 1 - rules.PRIOR_GOOD]), start
    for _ in range(400):
        like = np.exp(np.einsum("trv,rcv->tc", own, np.log(np.maximum(cast, 1e-9)))) * share
        p = like / like.sum(1, keepdims=True)
        share = (p.sum(0) + n0) / (len(votes) + n0.sum())
        cast = (np.einsum("trv,tc->rcv", own, p) + start * n0[:, None]) / (p.sum(0) + n0)[:, None]
    return p[:, 0]


def test_rules_weigh_their_votes(spark):
    """On labelled texts the posterior is EM's own and better than dropping on any bad vote."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rules.judge_documents(docs).toPandas()
    left = got[~got.base_failed].copy()
    votes = left[[f"v_{k}" for k in rules.RULES]].to_numpy()
    assert np.allclose(left.p_good, em(votes), atol=2e-6)
    assert (left.kept == (left.p_good >= 0.5)).all() and not got[got.base_failed].kept.any()
    left["all_pass"] = (votes >= 0).all(1)
    assert (left.kept & ~left.all_pass).sum() > 10  # single bad votes that the others outweigh
    judged = left.merge(labels.toPandas().drop_duplicates("doc_id"), on="doc_id")
    right = lambda kept: (kept == (judged.quality == 1)).mean()
    assert right(judged.kept) > right(judged.all_pass) and judged[judged.kept].quality.mean() >= judged[judged.all_pass].quality.mean()
    model = rules.learn(rules.votes(rules.materialise(rules.features(docs), "rules")))
    for k, prior, g, b in zip(rules.RULES, map(rules._starting, rules.RULES.values()), model[1], model[2], strict=True):
        assert max(abs(g[v] - prior[0][v]) + abs(b[v] - prior[1][v]) for v in (-1, 0, 1)) > 0.1, k
    known = rules.accuracies(model)
    assert known["symbols"] > 0.99 and known["dup_lines"] < 0.2  # agreement says that repeated lines tell nothing


# 10
def test_tokens(spark, odd, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    more = ["a  b", " lead", "x\n\ny", "tab\tz", "<|endoftext|> a <|endoftext|>", "nb sp", "a\r\nb", "don't we'll\nI'm", "\x1c odd \x85", "日本 語", "a\n b \nc"]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(700 + k, x) for k, x in enumerate(more)], "doc_id long, text string"))
    got = tokens.token_documents(docs, path).collect()
    at, want = 0, []
    for i, x in sorted(rows(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    same(got, want)
    assert tokens.token_documents(empty, path).count() == 0


def test_encoder_by_units(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "WORD_CACHE", 50)
    rng = random.Random(5)
    bits = ["a", "it's", "b,c", "x1", "<|endof", "<|endoftext|>", "é", "ß", "×", "ŉ", " ", " ", " ", "\n", "\t", "'s", "'", "12", ".", "!?", " ", "\x85", "\x1c", "漢", "🙂", "\r", "’t", "​", "\x00", "é"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        library, own = Tokenizer.from_file(path), tokens.Encoder(path)
        for size in [0, *range(40)]:
            texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(16))) for _ in range(size)]
            raw = [x.encode() for x in texts]
            ids, sizes = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
            got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if size else []
            assert got == [library.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def test_token_files_have_indexes(spark, tmp_path):
    import pyarrow.parquet as pq

    import public_tokenizers

    docs = spark.createDataFrame([(k, f"some words {k} " * 40) for k in range(500)], "doc_id long, text string")
    path = tokens.write_tokens(docs, str(tmp_path / "ids"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    for file in (tmp_path / "ids").glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(k).path_in_schema.split(".")[0]: group.column(k) for k in range(group.num_columns)}
        assert all(c.has_offset_index for c in columns.values())
        assert columns["ids"].has_dictionary_page and not columns["n_tokens"].has_dictionary_page
        assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    one = spark.read.parquet(path).where("doc_id = 77").select("n_tokens")
    assert one.count() == 1


def test_tokens_of_one_id(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(None if k % 2 else 5, "the same words" if k % 4 else f"own words {k}") for k in range(4000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes make one task
    try:
        path = tokens.write_tokens(docs.repartition(4), str(tmp_path / "ids"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = [r["count"] for r in spark.read.parquet(path).groupBy("part").count().collect()]
    assert sum(held) == 4000 and max(held) < 1500
    starts = [(r.start, r.n_tokens) for r in tokens.read_tokens(spark, path).orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_few_edges_in_one_task(spark):
    """As many edges as one task may hold need no exchange after their own; both ways give the same components."""
    rng = np.random.default_rng(15)
    pairs = [*rng.integers(0, 400, (250, 2)).tolist(), *[[k, k + 1] for k in range(1000, 1200)], [5, 5]]
    edges = spark.createDataFrame(pairs, "a long, b long")
    one, many = connected_components(edges), connected_components(edges, few=0)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()} and one.count() == many.count()
    assert "Aggregate" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert connected_components(edges.limit(0)).count() == 0


def test_shingles_count_words():
    """The words come with the shingles, so a text is scanned for them once."""
    texts = pa.array(["a b  c\td e", "", None, " \n", "x", "Zwei Wörter", " lead and trail "] + ["w " * k for k in range(400)])
    doc, tok, n, w = setjoin.counted_shingles(texts, 4)
    assert w.tolist() == word_counts(*buffers(texts)).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts.to_pylist()]
    assert [x.tolist() for x in (doc, tok, n)] == [x.tolist() for x in setjoin.shingles(texts, 4)]
