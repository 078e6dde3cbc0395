"""Similarity joins, shards, retrieval and trained models against brute force or held-out rows."""

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from bizlens.llm import decontaminate, jaccard_join, langid, quality, queries, sharding, storage, vector_dedup  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

EDGE = "doc_id long, text string, n int, node string"


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def _brute_near_duplicates(rows):
    sets = {i: _shingles(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = _components(sets, links)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.root for r in storage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == _components(nodes, [e for e in edges if e[0] != e[1]])


def test_jaccard_join_equals_brute_force(spark):
    """Chains, stars around a base and copies: components of all pairs, links on the edge of 0.8 included."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 9, 40, 120]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy)))
    rows += [(900, ""), (901, None), (902, " \t\n"), (903, "one two"), (904, "ONE  two")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], EDGE)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == _brute_near_duplicates(rows)
    kept = {r.doc_id for r in jaccard_join.representatives(df).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_jaccard_join_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 1, "x"), (None, "a b c d e f", 1, "x"),
                                (2, "a b c d e f", None, None)], EDGE)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_suffix_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(2))
        assert jaccard_join.suffix_bound(x, y, 4) <= len(np.setxor1d(x, y))
        share = len(np.intersect1d(x, y)) * 100 >= 80 * len(np.union1d(x, y))
        assert jaccard_join.similar(x, y, 80) == share


def test_shards(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op5_splitter_shards(spark, SF_SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    sums = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    limit = max(r.size for r in rows) + sharding.GROUP_SHARE * sum(sums) / 8
    assert max(sums) - sum(sums) / 8 <= limit and sum(sums) / 8 - min(sums) <= limit
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_with_a_hot_group(spark):
    """A third of all rows hold one text: its group is subdivided, small groups stay whole."""
    rows = [(i, "the same text", 1, "x") for i in range(3000)] + [(i, f"text {i // 2} " * 3, 1, "x") for i in range(3000, 9000)]
    got = sharding.assign(spark.createDataFrame(rows, EDGE)).collect()
    sums = np.bincount([r.shard for r in got], weights=[r.size for r in got], minlength=8)
    assert sums.max() <= 1.02 * sums.mean() and sums.min() >= 0.98 * sums.mean()
    of = {}
    for r in got:
        of.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(of[zlib.crc32(b"the same text")]) >= 2
    assert all(len(v) == 1 for k, v in of.items() if k != zlib.crc32(b"the same text"))


def test_shard_edges(spark):
    df = spark.createDataFrame([(1, "", 1, "x"), (2, None, 1, "x"), (None, "a", 1, "x"), (2, None, 1, "x")], EDGE)
    got = sorted(((r.doc_id or 0), r.size, r.text_crc32) for r in sharding.assign(df).collect())
    assert got == [(0, 2, zlib.crc32(b"a")), (1, 1, 0), (2, 1, None), (2, 1, None)]
    assert sharding.assign(df.limit(0)).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    """Rows without an id, repeated rows and clashing names: every row once, slots gapless."""
    rows = [(i % 30 if i % 7 else None, f"text {i % 11}" if i % 5 else None, i, "x") for i in range(200)] + [(3, "text 3", 3, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot string")
    sharding.write(df, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.doc_id, r.text, r.shard_in, r.slot_in) for r in got), key=key) == sorted(rows, key=key)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sharding.write(df.limit(0), str(tmp_path / "none"))


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 20))
    x = np.concatenate([base, base[:30] + 0.08 * rng.normal(size=(30, 20)) * np.linalg.norm(base[:30], axis=1)[:, None] / 4,
                        np.repeat(base[:1], 40, 0) + 0.05 * rng.normal(size=(40, 20)), 3 * base[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    rows += [(900, None, 0, ""), (901, [0.0] * 20, 0, ""), (902, [float("nan")] + [1.0] * 19, 0, ""), (903, [None] + [1.0] * 19, 0, ""),
             (904, [], 0, ""), (905, [1.0], 0, ""), (None, x[0].tolist(), 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    root = _components(range(len(x)), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    right = sum(got[i].n_links == near[i].sum() - 1 for i in range(len(x)))
    assert right >= 0.9 * len(x) and sum(got[i].component_id == root[i] for i in range(len(x))) >= 0.9 * len(x)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906))
    assert got[None].component_id is None and not got[None].kept
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("probes", [vector_dedup.PROBES, 3])
def test_links_count_at_both_ends(spark, monkeypatch, probes):
    """Far more lists than probes: a link that one end finds counts for the other one too; recall against brute force."""
    monkeypatch.setattr(vector_dedup, "LISTS_ROOT", 4)
    monkeypatch.setattr(vector_dedup, "PROBES", probes)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(600, 32))
    away -= (away * x[:600]).sum(1, keepdims=True) * x[:600]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.905, 0.95, (600, 1))
    x = np.concatenate([x, cos * x[:600] + np.sqrt(1 - cos ** 2) * away, x[:20]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(df).collect()}
    near = (x @ x.T >= 0.9).sum(1) - 1
    assert all(got[i] <= near[i] for i in range(len(x)))
    # pairs that no other link touches: both ends say the same
    plain = [i for i in range(20, 600) if near[i] == 1 and near[2400 + i] == 1]
    assert len(plain) > 500 and all(got[i] == got[2400 + i] for i in plain)
    if probes == vector_dedup.PROBES and probes > 3:
        assert sum(got[i] == near[i] for i in range(len(x))) >= 0.99 * len(x)


def _leaks(spark, path):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    return items, docs, {(d, i) for i, t in items.items() for d, x in docs.items() if t in x}


def test_decontamination_finds_copies_and_paraphrases(spark):
    items, docs, exact = _leaks(spark, SF_SMALL)
    got = {(r.doc_id, r.item_id) for r in queries.op6_latent_decontamination(spark, SF_SMALL).collect()}
    assert exact <= got and len(got - exact) <= 1 + len(exact) // 20
    rng = random.Random(8)
    clean = [docs[d] for d in sorted(set(docs) - {d for d, _ in got})][:40]
    rows = [(i, t) for i, t in enumerate(clean)]
    for i, t in sorted(items.items())[:20]:  # one word of eight replaced, another dropped now and then
        words = [f"other{rng.randrange(10**6)}" if k % 8 == 3 else w for k, w in enumerate(t.split()) if k % 15 != 7]
        rows.append((1000 + i, f"{clean[i % 40]} {' '.join(words)} {clean[(i + 1) % 40]}"))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows] + [(None, items[0], 1, "x"), (5000, None, 1, "x"), (5001, "", 1, "")], EDGE)
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    found = {(1000 + i, i) for i in sorted(items)[:20]} & got
    assert len(found) >= 15 and not {d for d, _ in got if d < 1000}
    left = {r.doc_id for r in decontaminate.keep(df.where("doc_id is not null"), bench).collect()}
    assert set(range(len(clean))) | {5000, 5001} <= left and not left & {d for d, _ in got}
    assert decontaminate.matches(df.limit(0), bench).count() == 0 and decontaminate.matches(df, bench.limit(0)).count() == 0


def test_lcs():
    rng = random.Random(6)
    for _ in range(50):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.lcs(x, y) == table[-1, -1]


def test_quality_on_labelled_rows(spark):
    path = SF_SMALL.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    half = spark.read.parquet(f"{path}/labels.parquet").where("doc_id % 2 = 0")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in quality.score(docs, half).collect()}
    held = [i for i in labels if i % 2 and i in got]
    assert np.mean([got[i].kept == (labels[i] == 1) for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == docs.count()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1, "x"), (None, "a", 1, "x"), (2, "", 1, "x"), (2, "", 1, "x")], EDGE)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r.kept and r.score == 1 for r in quality.score(docs, labels).collect())
    assert quality.keep(docs, labels).count() == 4
    both = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, both).count() == 4 and quality.score(docs.limit(0), both).count() == 0
    assert quality.keep(docs, both).columns == docs.columns


def test_language_network_gradients():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in langid.init(3, hidden=3, seed=2).items()}
    x, live = langid._padded([b"abca", b"bc", b"a"])
    y = np.array([0, 1, 2])
    _, g = langid.gradients(w, x, live, y)
    for name in w:
        index = tuple(rng.integers(0, s) for s in w[name].shape) if name[0] != "x" else (97, 1)
        keep, step = w[name][index], 1e-3
        w[name][index] = keep + step
        up, _ = langid.gradients(w, x, live, y)
        w[name][index] = keep - step
        down, _ = langid.gradients(w, x, live, y)
        w[name][index] = keep
        assert g[name][index] == pytest.approx((up - down) / (2 * step), rel=0.02, abs=1e-4)


def test_language_on_held_out_rows(spark):
    path = SF_SMALL.replace("sf0.001", "sf0.01")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = langid.identify(spark.read.parquet(f"{path}/documents.parquet")).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]) >= 0.97


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(i, "hello there my friend " * 3, "en", 1) for i in range(40)] + [(i, "größe straße über können " * 3, "de", 1) for i in range(40, 80)]
    df = spark.createDataFrame(rows + [(100, None, "en", 1), (101, "123 !!", "en", 1), (102, "", None, 1), (None, "über können", None, 1)], schema)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert {got[i].lang_pred for i in (100, 101, 102)} == {"und"} and got[None].lang_pred == "de" and not got[None].held_out
    assert all(got[i].lang_pred == ("en" if i < 40 else "de") for i in range(80))
    nothing = spark.createDataFrame([(1, "text", None, 1)], schema)
    assert [(r.lang_pred, r.score) for r in langid.identify(nothing).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    texts = {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = storage.materialise(stage(spark, docs, SF_SMALL), f"test{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= before
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            assert sum(labels.get(i) == 0 for i in after) <= 0.2 * sum(v == 0 for v in labels.values())
        if k == 1:
            roots = {i: c for i, (_, c) in _brute_near_duplicates([(i, texts[i]) for i in before]).items()}
            assert set(after) == set(roots.values())
        if k == 2:
            items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
            assert not any(t in r.text for r in after.values() for t in items)
        if k >= 3:
            assert set(after) == before
        if k < 4:
            texts = {i: r.text for i, r in after.items()}
        before = set(after)
    assert all(r.n_tokens == len(r.tokens) == len(r.offsets) for r in after.values())


def test_latent_space_is_fitted_on_every_document(spark):
    # words of 2,400 documents that go together one way in most of them and another way in the rest; a sample differs
    rng = np.random.default_rng(3)
    names = ["alpha", "beta", "gamma", "delta", "kappa", "sigma"]
    share = rng.dirichlet(np.ones(6), size=4)
    texts = [" ".join(rng.choice([*names, "other"], size=int(rng.integers(1, 70)), p=[*(0.8 * share[i % 4]), 0.2])) for i in range(2400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame([(1, " ".join(names))], "item_id long, text string")
    [found] = decontaminate.prepare(docs, bench)
    gram = np.zeros((6, 6))
    at = {int(h): i for i, h in enumerate(found.vocabulary)}
    for t in [*texts, " ".join(names)]:
        hashes, counts = decontaminate.plain_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        for _, a, b in zip(*decontaminate.windows(counts, decontaminate.FIT_WORDS)):
            v = np.zeros(6)
            for h in hashes[a:b].tolist():
                if h in at:
                    v[at[h]] += found.idf[at[h]]
            square = sum(found.idf[at[h]] ** 2 for h in hashes[a:b].tolist() if h in at)
            gram += np.outer(v, v) / max(square, 1e-9)
    values, vectors = np.linalg.eigh(gram)
    assert np.allclose(np.abs(vectors[:, ::-1].T @ found.space), np.eye(6), atol=2e-3)


def test_small_components_are_not_written_as_a_file_for_each_shuffle_partition(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "67")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(i, i + 1) for i in range(0, 900) if i % 9]
        out = storage.components(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.root for r in out.collect()} == _components({x for e in edges for x in e}, edges)
        assert len(out.inputFiles()) <= max(2, spark.sparkContext.defaultParallelism)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
