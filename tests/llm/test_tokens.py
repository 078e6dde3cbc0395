"""Alignment, divergence and token files against plain versions on whole texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from bizlens.llm import align_tokens, divergence, pieces, queries, token_files  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

A_PATH, B_PATH = align_tokens.paths()
A = tokenizers.Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
W = tokenizers.Tokenizer.from_file(token_files.tokenizer_path())
LETTERS = list("ab' \n\t.,srel1²é!  日🙂\x1c  ▁́<|>Xß\x00\r à ” ") + [
    "<|endoftext|>", "</s>", "<0x41>", " the ", " and", "\n\n", "<|ENDOFTEXT|>", "unbelievably", "Straße."]
TEXTS = st.lists(st.lists(st.sampled_from(LETTERS), max_size=60).map("".join), max_size=5)
EDGE = "doc_id long, text string, id string, start int, pairs int, row int, part int"


def _pair():
    return align_tokens._pair(A_PATH, B_PATH)


def _plain(text):
    """(A ids, B ids, groups as (A ids, B ids)) by walking over the bytes."""
    pair = _pair()
    raw = (" " + (text or "")).encode()
    a = A.encode(" " + text, add_special_tokens=False).ids if text else []
    b = B.encode(text) if text else []
    if not text or any(b"".join(t[i] for i in ids) != raw for t, ids in ((pair.bytes_a, a), (pair.bytes_b, b))):
        return [], [], []
    ends = lambda ids, t: np.cumsum([len(t[i]) for i in ids]).tolist()
    ea, eb = ends(a, pair.bytes_a), ends(b, pair.bytes_b)
    groups, x, y = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        i, j = ea.index(cut) + 1, eb.index(cut) + 1
        if groups and (i == x or j == y):  # tokens of no bytes: none in these vocabularies
            raise AssertionError
        groups.append((a[x:i], b[y:j]))
        x, y = i, j
    return a, b, groups


def _text_of(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def _expected(texts):
    """The contract's row of each text, links counted one by one."""
    all_groups = [_plain(t) for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, _, g in all_groups]
    count = Counter(p for ls in links for p in set(ls))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(len(a), len(b), len(g), len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls),
             hashlib.sha256(_text_of(g).encode()).hexdigest() if a else "") for (a, b, g), ls in zip(all_groups, links)]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_pieces_equal_whole_texts(texts):
    a, n_a, b, n_b = _pair().encode(texts)
    to_a, to_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
    for i, t in enumerate(texts):
        want_a, want_b, _ = _plain(t)
        assert a[to_a[i]:to_a[i + 1]].tolist() == want_a and b[to_b[i]:to_b[i + 1]].tolist() == want_b
    ids, n = token_files._tokenizer(token_files.tokenizer_path())([t.encode() for t in texts])
    ends = np.concatenate(([0], np.cumsum(n)))
    for i, t in enumerate(texts):
        assert ids[ends[i]:ends[i + 1]].tolist() == W.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("slots", [16, 1 << 12])
def test_kept_pieces_turn_over(slots):
    """Full tables give way; short and long pieces, zero bytes and repeats come back as computed."""
    rng = random.Random(slots)
    names = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    kept = pieces.Kept(lambda ps: [[list(p) for p in ps], [[len(p)] * (len(p) % 3) for p in ps]], 2, slots)
    for _ in range(4):
        some = rng.choices(names, k=2500)
        data = np.frombuffer(b"".join(some), np.uint8)
        ends = np.cumsum([len(p) for p in some])
        (x, n_x), (y, n_y) = kept(data, ends - [len(p) for p in some], ends)
        assert x.tolist() == data.tolist() and n_x.tolist() == [len(p) for p in some]
        assert y.tolist() == [len(p) for p in some for _ in range(len(p) % 3)] and n_y.tolist() == [len(p) % 3 for p in some]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60))), min_size=1, max_size=6), st.integers(1, 7))
def test_lockstep_finds_every_cut(ends, every):
    """Random token ends in several documents, in one lane each and cut into short lanes."""
    docs = [(sorted(a | {61}), sorted(b | {61})) for a, b in ends]
    ends_a = np.concatenate([np.array(a) + 61 * i for i, (a, _) in enumerate(docs)])
    ends_b = np.concatenate([np.array(b) + 61 * i for i, (_, b) in enumerate(docs)])
    first_a = np.cumsum([0] + [len(a) for a, _ in docs])[:-1]
    first_b = np.cumsum([0] + [len(b) for _, b in docs])[:-1]
    want = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    for starts in ((first_a, first_b), align_tokens.lanes(ends_a, ends_b, first_a, first_b, every)):
        a, b = align_tokens.lockstep(ends_a, ends_b, *starts)
        assert ends_a[a - 1].tolist() == want == ends_b[b - 1].tolist()


def test_links_of_large_groups():
    """Groups counted from distinct ids and links expanded in portions give the same."""
    rng = np.random.default_rng(3)
    n = 400
    a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
    cuts = np.array([1, 2, 80, 90, 300, 400])
    docs = np.array([0, 0, 1, 1, 1, 2])
    want = Counter()
    for d, lo, hi in zip(docs, [0, *cuts[:-1]], cuts):
        want.update((d, x * 100 + y) for x in a[lo:hi] for y in b[lo:hi])
    before = align_tokens.PAIRS
    try:
        for portion in (1 << 20, 500, 7):
            align_tokens.PAIRS = portion
            got = align_tokens.linked(a, b, cuts, cuts, docs, 100)
            assert {(d, p): c for d, p, c in zip(*(x.tolist() for x in got))} == want
    finally:
        align_tokens.PAIRS = before


def test_alignment_query_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {d.doc_id: w for d, w in zip(docs, _expected([d.text for d in docs]))}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_token_alignment(spark, SF_SMALL).collect()}
    assert got == want


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_alignment_edges(spark, frequent):
    """Nulls, empty and very long texts, repeats, clashing names; counts broadcast, joined, and both."""
    texts = ["the cat", "the cat", None, "", "▁ no", "x" * 3000 + " the  end\n\n", "the <|endoftext|> dog\tsat", "日本語のテキスト", " "]
    rows = [(i, t, "x", 1, 2, 3, 4) for i, t in enumerate(texts)] + [(None, "the cat", "y", 1, 2, 3, 4), (0, "the cat", "z", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, EDGE)
    want = _expected([t for _, t, *_ in rows])
    got = align_tokens.alignment_query(df, A_PATH, B_PATH, frequent)
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    assert align_tokens.alignment_query(df.limit(0), A_PATH, B_PATH, frequent).count() == 0


def test_alignment_outputs(spark):
    text = "Unbelievably long\nStraße, 日本"
    df = spark.createDataFrame([(7, text, "x", 1, 2, 3, 4)], EDGE)
    r = align_tokens.align(df, A_PATH, B_PATH).first()
    a, b, groups = _plain(text)
    assert r.a_ids == a and r.b_ids == b and len(r.a_cuts) == len(groups)
    cut = lambda ids, ends: [ids[x:y] for x, y in zip([0, *ends], ends)]
    assert list(zip(cut(a, r.a_cuts), cut(b, r.b_cuts))) == groups
    long = "word " * 40_000 + "日" * 20_000
    df = spark.createDataFrame([(1, long, "x", 1, 2, 3, 4)], EDGE)
    r = align_tokens.align(df, A_PATH, B_PATH, ("n_a", "n_b")).first()
    assert (r.n_a, r.n_b) == (len(A.encode(" " + long, add_special_tokens=False).ids), len(B.encode(long)))


# ------------------------------------------------------------- divergence
def _audit(rows, least=10, top=10):
    """Dense version: every group has every kept term of its language."""
    rows = [tuple(x or "" for x in r) for r in rows]
    term = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        words = term.findall(text.translate(low))
        groups[lang].add(source)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) * (x - y) // (x + y)
        for s in sources:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            over = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pair), ("term", over)) for k, (v, i) in enumerate(found)}
    return out


def test_divergence_against_dense_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = [tuple(r) for r in queries.op12_source_divergence(spark, SF_SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == _audit([(d.lang, d.source, d.text) for d in docs])


@pytest.mark.parametrize("held", [divergence.HELD_TERMS, 1])
def test_divergence_edges(spark, held, monkeypatch):
    """Nulls, empty, wordless and long texts, ties, repeats, one source, clashing names; workers that pass sums on early."""
    rng = random.Random(5)
    words = ["Ab", "ab", "É", "日本", "x9y", "c-d", "\x7fz", "É", "é"]
    rows = [(rng.choice(["en", "", None]), rng.choice(["s", "t", None, "ü"]), " ".join(rng.choices(words, k=rng.randint(0, 6))))
            for _ in range(150)]
    rows += [("en", "s", None), ("solo", "one", "ab " * 30), ("none", "p", "123"), ("none", "q", ""), ("en", "only", "!"),
             ("en", "s", "ab\n" * 50_000)] + [("tie", s, "same word") for s in "uvw"] * 5
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, n int, docs int")
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    got = [tuple(r) for r in divergence.audit(df).collect()]
    assert len(got) == len(set(got)) and set(got) == _audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_beyond_64_bits(spark):
    """Counts whose products pass 2^63 stay exact."""
    n, m = 9_876_543_210_987, 12_345_678_901
    rows = [("en", "a", "x", n, n + m), ("en", "b", "x", m, n + m), ("en", "a", "y", 3, 3),
            ("en", "a", None, 0, 0), ("en", "b", None, 0, 0)]
    counts = spark.createDataFrame(rows, "lang string, source string, term string, n long, lang_n long")
    groups, shares = divergence.shares(counts)
    got = {(r.source, r.term): (r.p, r.q) for r in shares.collect()}
    share = lambda c, t: 1 + 10 ** 9 * (c + 2) // (t + 4)
    assert got == {("a", "x"): (share(n, n + 3), share(n + m, n + m + 3)), ("b", "x"): (share(m, m), share(n + m, n + m + 3)),
                   ("a", "y"): (share(3, n + 3), share(3, n + m + 3))}
    assert {r.source: r.p0 for r in groups.collect()} == {"a": share(0, n + 3), "b": share(0, m)}


# ------------------------------------------------------------ token files
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 2 ** 32 - 1)), min_size=1, max_size=300), st.floats(0.05, 1))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    packed = token_files.pack_block(ids, percentile)
    assert token_files.unpack_block(b"xx" + packed + b"yy", 2).tolist() == ids.tolist()
    _, low, width, odd = token_files.BLOCK.unpack_from(packed)
    offsets = ids.astype(np.int64) - low
    assert odd == int((offsets >> width > 0).sum()) <= (1 - percentile) * len(ids) + 1e-6
    assert not width or (offsets >> (width - 1) > 0).mean() > 1 - percentile - 1e-9


def test_files_hold_documents_and_find_ids(tmp_path):
    rng = np.random.default_rng(1)
    counts = [int(x) for x in rng.integers(0, 40, 60)] + [3000, 0]
    docs = [None, *range(len(counts) - 1)]
    ids = rng.integers(0, 50_000, sum(counts)).astype(np.uint32)
    writer = token_files.Writer(str(tmp_path), "a.tok", block_ids=64)
    writer.add(docs[:20], counts[:20], ids[:sum(counts[:20])])
    writer.add(docs[20:], counts[20:], ids[sum(counts[:20]):])
    assert writer.close() == (tmp_path / "a.tok").stat().st_size
    reader = token_files.Reader(str(tmp_path / "a.tok"))
    assert [None if n else int(d) for d, n in zip(reader.docs, reader.null)] == docs and reader.counts.tolist() == counts
    for start, n in ((0, 0), (0, 64), (63, 2), (100, 1000), (len(ids) - 1, 1)):
        assert reader.ids(start, n).tolist() == ids[start:start + n].tolist()
    before, token_files.READ_IDS = token_files.READ_IDS, 100
    try:
        runs = list(reader.documents())
    finally:
        token_files.READ_IDS = before
    assert len(runs) > 5 and np.concatenate([r[2] for r in runs]).tolist() == ids.tolist()
    assert [a for a, _, _ in runs] == [0, *(b for _, b, _ in runs[:-1])] and runs[-1][1] == len(counts)
    (tmp_path / "b.tok").write_bytes((tmp_path / "a.tok").read_bytes()[:-1])
    with pytest.raises(ValueError):
        token_files.Reader(str(tmp_path / "b.tok"))


def _token_rows(rows):
    """(doc_id, n_tokens, crc32) in order, with the ids before each."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*W.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_query(spark):
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    assert sorted(tuple(r) for r in queries.op13_token_files(spark, SF_SMALL).collect()) == _token_rows(docs)


def test_token_files_edges(spark, tmp_path):
    """Nulls, empty and very long texts, equal ids, repeated rows, clashing names; several files a task."""
    texts = ["Hello the world", "", None, "word " * 30_000, "ünïcödé <|endoftext|>"]
    rows = [(i * 3 % 50, texts[i % 5] if i % 5 != 3 or i < 5 else "b") for i in range(60)] + [(None, "n"), (None, None), (4, "t"), (4, "t")]
    df = spark.createDataFrame([(a, b, "x", 1, 2, 3, 4) for a, b in rows], EDGE)
    files = token_files.write(df, token_files.tokenizer_path(), str(tmp_path), file_ids=40, block_ids=32)
    listed = files.orderBy("start").collect()
    assert len(listed) > 3 and sum(f.n_docs for f in listed) == len(rows)
    assert [f.start for f in listed] == np.cumsum([0, *(f.n_ids for f in listed[:-1])]).tolist()
    got = sorted(token_files.read(files).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert [r.doc_id for r in got] == sorted((a for a, _ in rows), key=lambda a: -1 if a is None else a)
    want = Counter((a, tuple(W.encode(b or "", add_special_tokens=False).ids) + (2,)) for a, b in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert token_files.round_trip(spark, df.limit(0), token_files.tokenizer_path()).count() == 0


def test_files_of_failed_attempts_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "x", 1, 2, 3, 4)], EDGE)
    files = token_files.write(df, token_files.tokenizer_path(), str(tmp_path))
    stray = token_files.Writer(str(tmp_path), "part-000000-0000-lost.tok")
    stray.add([99], [1], np.array([5], np.uint32))
    stray.close()
    assert [r.doc_id for r in token_files.read(files).collect()] == [1]


def test_code_point_classes_need_little_memory():
    import tracemalloc

    from bizlens.llm import bpe
    bpe.code_point_classes.cache_clear()
    tracemalloc.start()
    kinds = bpe.code_point_classes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6 and [int(kinds[ord(c)]) for c in "aé漢5٣ -"] == [bpe.LETTER] * 3 + [bpe.NUMBER] * 2 + [bpe.INSIDE, bpe.OTHER]
