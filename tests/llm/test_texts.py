"""Byte-level BPE, personal data, licences and passages against plain references."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from bizlens.llm import bpe, chunk_dedup, licenses, pii, queries  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

RANKS = bpe.read_ranks(bpe.ranks_path())
REFERENCE = tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
EDGE = "doc_id long, text string, ids string, entities int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab' \n\tsrel1²é!  日🙂\x1c")) | st.characters(exclude_categories=["Cs"]),
                        max_size=300), max_size=4))
def test_encoder_equals_the_library(texts):
    for text, ids in zip(texts, bpe.Encoder(RANKS).encode(texts)):
        assert ids.tolist() == REFERENCE.encode_ordinary(text)


def test_scan_carries_over_blocks():
    text = ("word's  'll x!'s \n " * 400)[:5000]
    assert bpe.Encoder(RANKS).encode([text])[0].tolist() == REFERENCE.encode_ordinary(text)


def test_digest_query_round_trip(spark):
    got = {r.doc_id: r for r in queries.op1_byte_bpe(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = REFERENCE.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_encode_edges(spark):
    long = "x" * 200_000 + " " * 1000 + "é" * 1000
    df = spark.createDataFrame([(1, "", "a", 1), (2, None, "b", 2), (None, "a b", "c", 3), (2, long, "d", 4), (2, long, "d", 4)], EDGE)
    out = bpe.decode(bpe.encode(df, bpe.ranks_path()), bpe.ranks_path()).collect()
    assert sorted((r.doc_id or 0, len(r.decoded)) for r in out) == [(0, 3), (1, 0), (2, 0), (2, 203_000), (2, 203_000)]
    tokens = [r for r in bpe.encode(df, bpe.ranks_path()).collect() if r.doc_id is None][0]
    assert tokens.offsets == [0, 1] and bpe.encode(df.limit(0), bpe.ranks_path()).count() == 0


def _surrogates(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], EDGE)
    return {r.doc_id: r for r in pii.replace(df, **kw).collect()}


def test_surrogates_keep_type_form_and_coreference(spark):
    out = _surrogates(spark, ["Mrs. Mary Miller met MR. JOHN SMITH. Smith wrote to j.smith@acme.com and J.Smith@Acme.com.",
                              "Smith, card 4111 1111 1111 1111 or 4111111111111111, 10.0.0.1, +1 (212) 555-1234, 212-555-1234",
                              "Mr Smith; number 1234567890123456 stays", None, "", "plain words only"])
    first = out[0].text
    assert not re.search("(?i)mary|miller|john|acme", first) and len({e.surrogate.casefold() for e in out[0].entities if e.kind == "email"}) == 1
    names = {e.surrogate.casefold() for e in out[0].entities if e.kind == "last-latin"}
    last = [e.surrogate for e in out[2].entities if e.kind == "last-latin"][0]
    assert last.casefold() in names and "MR." in first and last.upper() in first
    mary = [e.surrogate for e in out[0].entities if e.kind == "first.f-latin"][0]
    assert pii._GENDER.get(mary.casefold()) == "f"
    cards = [e.surrogate for e in out[1].entities if e.kind == "card"]
    assert cards[0].replace(" ", "") == cards[1] and cards[0][4] == " " and pii.luhn(cards[1]) and cards[1] != "4111111111111111"
    phones = [re.sub(r"\D", "", e.surrogate) for e in out[1].entities if e.kind == "phone"]
    assert phones[0] == phones[1] and "+1 (" in out[1].text
    assert "1234567890123456" in out[2].text and out[3].text is None and out[4].text == "" and out[5].text == "plain words only"
    assert out[3].entities == [] and out[5].ids == "x"


def test_surrogates_are_distinct_and_new(spark):
    """Many first names draw from a short list: collisions are settled, on both ways of passing them on."""
    names = [f"{a}{b}" for a in "BCDFGHKLMNPRSTVW" for b in ("anor", "elin", "orix", "umel")]
    texts = [f"Mrs. {n} Zzyk" for n in names]
    for most in (pii.BROADCAST_MOST, 0):
        out = _surrogates(spark, texts, broadcast_most=most)
        drawn = [e.surrogate.casefold() for r in out.values() for e in r.entities if e.kind.startswith("first")]
        assert len(drawn) == len(set(drawn)) == len(names) and not set(drawn) & {n.casefold() for n in names}


def test_every_planted_value_goes_and_clean_texts_stay(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    out = {r.doc_id: r for r in queries.op3_pii_surrogates(spark, SF_SMALL).collect()}
    assert set(out) == set(docs)
    for i, text in docs.items():
        values = re.findall(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\d.])\d+\.\d+\.\d+\.\d+(?!\.?\d)", text)
        assert not any(v in out[i].text for v in values)
        if not re.search(r"\d|@", text):
            assert out[i].text == text


def test_licence_notices(spark):
    texts = ["words before Released under the MIT license! and after", "ALL*** RIGHTS### RESERVED", licenses.TEMPLATES[3][1],
             licenses.TEMPLATES[3][1].replace("copy", "duplicate"), "all rights are not reserved", None, "", "the of and"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1), (0, texts[0], "y", 2)], EDGE)
    got = {(r.doc_id, r.license): r for r in licenses.notices(df).collect()}
    assert set(got) == {(0, "MIT"), (1, "all-rights-reserved"), (2, "MIT"), (3, "MIT")}
    assert got[0, "MIT"].dice == 1 and got[0, "MIT"].first_word == 2 and got[0, "MIT"].n_words == 5
    assert 0.8 <= got[3, "MIT"].dice < 1
    assert licenses.notices(df.limit(0)).count() == 0


def test_licence_query_against_plain_search(spark):
    plain = lambda t: " ".join(re.findall(r"[a-z0-9]+", t.lower()))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    short = [(n, plain(t)) for n, t in licenses.TEMPLATES if len(t) < 80]
    expect = {(d.doc_id, n) for d in docs for n, t in short if f" {t} " in f" {plain(d.text)} "}
    assert expect <= {(r.doc_id, r.license) for r in queries.op4_license_notices(spark, SF_SMALL).collect()}


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(n))


def test_repeated_passages_resist_shifts(spark):
    import random
    rng = random.Random(5)
    rows, expect = [], {}
    for p in range(40):
        n = rng.choice([51, 60, 90, 30])
        passage = _words(rng, n)
        for _ in range(2):
            i = len(rows)
            rows.append((i, f"{_words(rng, rng.randint(0, 80))} {passage} {_words(rng, rng.randint(0, 80))}", "", 1))
            if n > 50:
                expect[i] = passage
    df = spark.createDataFrame(rows + [(None, rows[0][1], "", 1), (900, None, "", 1), (901, "", "", 1), (0, rows[0][1], "", 2)], EDGE)
    found = chunk_dedup.repeated_passages(df)
    spans = {}
    for r in found.collect():
        spans.setdefault(r.doc_id, []).append(r)
    text = {r[0]: r[1] for r in rows}
    assert set(spans) == set(expect)
    for i, passage in expect.items():
        a = text[i].encode().index(passage.encode())
        assert any(r.start <= a and r.end >= a + len(passage.encode()) for r in spans[i])
        assert all(r.kept == (i % 2 == 0) and r.first_doc_id == i // 2 * 2 for r in spans[i])
    cut = {r.doc_id: r.text for r in chunk_dedup.remove(df.where("doc_id < 100"), found).collect()}
    assert all((p in cut[i]) == (i % 2 == 0) for i, p in expect.items())
    assert chunk_dedup.repeated_passages(df.limit(0)).count() == 0


def test_periodic_passages_are_cut_too(spark):
    df = spark.createDataFrame([(1, "start here " + "De " * 300, "", 1), (2, "De " * 320 + "end", "", 1)], EDGE)
    assert {r.doc_id for r in chunk_dedup.repeated_passages(df).collect()} == {1, 2}
