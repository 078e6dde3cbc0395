"""Passages that the first documents of their anchors hold only in parts."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from bizlens.llm import chunk_dedup  # noqa: E402

LETTERS = "abcdefghijklmnop"


def _text(rng, n, most=8):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, most))) for _ in range(n))


def _edited(rng, passage, places):
    words = passage.split()
    for k in places:
        words[k] = "q" + words[k] + "q"
    return " ".join(words)


def _missing(spark, rows, expect):
    """Documents of ``expect`` (id: passage) without a row that covers their passage."""
    spans = {}
    for r in chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    text, out = dict(rows), []
    for i, passage in expect.items():
        a = text[i].encode().index(passage.encode())
        if not any(s <= a and a + len(passage.encode()) <= e for s, e in spans.get(i, ())):
            out.append(i)
    return out


def test_earlier_edited_copies_hide_nothing(spark):
    rng = random.Random(7)
    rows, expect = [], {}
    for _ in range(60):
        passage = _text(rng, 60)
        copies = [_edited(rng, passage, (20, 40)), _edited(rng, passage, (10, 30, 50)), passage, passage]
        for k, copy in enumerate(copies):
            if k >= 2:
                expect[len(rows)] = passage
            rows.append((len(rows), f"{_text(rng, rng.randint(0, 60))} {copy} {_text(rng, rng.randint(0, 60))}"))
    assert not _missing(spark, rows, expect)


def test_a_window_shared_in_part_and_whole(spark):
    """The first document shares one half, another the other half; later ones share all of it."""
    rng = random.Random(9)
    left, right = _text(rng, 70), _text(rng, 70)
    rows = [(1, f"{_text(rng, 20)} {left} {_text(rng, 20)}"), (2, f"{_text(rng, 20)} {right} {_text(rng, 20)}")]
    rows += [(i, f"{_text(rng, 20)} {left} {right} {_text(rng, 20)}") for i in (3, 4)]
    assert not _missing(spark, rows, {1: left, 2: right, 3: left, 4: left})
    assert not _missing(spark, rows, {3: right, 4: right})
    seam = " ".join([*left.split()[-30:], *right.split()[:30]])
    assert not _missing(spark, rows, {3: seam, 4: seam})


def test_passages_of_short_words(spark):
    rng = random.Random(11)
    rows, expect = [], {}
    for p in range(200):
        passage = _text(rng, 50, 1 + p % 2)
        for _ in range(2):
            expect[len(rows)] = passage
            rows.append((len(rows), f"{_text(rng, rng.randint(0, 60))} {passage} {_text(rng, rng.randint(0, 60))}"))
    assert not _missing(spark, rows, expect)


def test_passages_of_digits(spark):
    rng = random.Random(12)
    table = "\n".join(" ".join(str(rng.randrange(10)) for _ in range(4)) for _ in range(14))
    rows = [(i, f"{_text(rng, 30)}\n{table}\n{_text(rng, 30)}") for i in range(2)]
    assert not _missing(spark, rows, dict.fromkeys(range(2), table))


def _covered(rows, least=50):
    """(document, word) of every window of ``least`` whole words that an earlier document has, and that a later one has."""
    import re
    spans = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for i, t in rows}
    raw = {i: t.encode() for i, t in rows}
    where = {}
    for i, words in spans.items():
        for k in range(len(words) - least + 1):
            where.setdefault(raw[i][words[k][0]:words[k + least - 1][1]], []).append((i, k))
    cut, kept = set(), set()
    for at in where.values():
        first = min(i for i, _ in at)
        if any(i != first for i, _ in at):
            for i, k in at:
                (kept if i == first else cut).update((i, w) for w in range(k, k + least))
    return cut, kept, spans


def test_every_covered_word_and_no_other(spark):
    """Against all windows of all documents: copies, edits, shared parts, repeats, equal texts."""
    rng = random.Random(21)
    pool = [_text(rng, n) for n in (50, 52, 70, 120, 49)]
    line = _text(rng, 12)
    rows = []
    for i in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.5 else _text(rng, rng.randint(0, 60)) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.2:
            parts.append("\n".join([line] * rng.randint(1, 30)))
        if rng.random() < 0.2:
            parts = [_edited(rng, p, [rng.randrange(len(p.split()))]) if p else p for p in parts]
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(200 + k, rows[k % 7 * 9][1]) for k in range(30)]
    cut, kept, spans = _covered(rows)
    got_cut, got_kept = set(), set()
    for r in chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = {(r.doc_id, w) for w, (a, b) in enumerate(spans[r.doc_id]) if r.start <= a and b <= r.end}
        assert len(words) == r.n_words >= 50 and r.kept == (r.first_doc_id == r.doc_id) and r.first_doc_id <= r.doc_id
        (got_kept if r.kept else got_cut).update(words)
    assert got_cut == cut and got_kept == kept


def test_repeated_lines_cost_no_more_than_their_length(spark):
    """A line repeated 4,000 times in two texts: pairs of occurrences would be 16 million."""
    import time
    line = _text(random.Random(3), 12)
    rows = [(1, "start " + "\n".join([line] * 4000)), (2, "\n".join([line] * 4000) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    begin = time.time()
    got = {r.doc_id: r.n_words for r in chunk_dedup.repeated_passages(df).collect()}
    assert got == {1: 48_000, 2: 48_000} and time.time() - begin < 120


def test_window_hashes_are_those_of_the_bytes():
    import numpy as np
    data = np.frombuffer(b"the cat sat on the cat sat on", np.uint8)
    a, b = chunk_dedup.window_hashes(data, np.array([0, 15, 4]), np.array([11, 26, 11]))
    assert a[0] == a[1] != a[2] and b[0] == b[1] != b[2] and a[0] != b[0]
