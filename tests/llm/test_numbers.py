"""Numbers of several kinds standing side by side in one run of digits."""

import re

import pytest

pytest.importorskip("public_tokenizers")

from bizlens.llm import pii  # noqa: E402

CARD = "4111 1111 1111 1111"
SIDE_BY_SIDE = {
    f"{CARD} 12/27": [("card", "4111111111111111")],
    "4111-1111-1111-1111 123": [("card", "4111111111111111")],
    f"no 3 {CARD}": [("card", "4111111111111111")],
    "4111-1111-1111-1111-5500-0000-0000-0004": [("card", "4111111111111111"), ("card", "5500000000000004")],
    "123-45-6789 987-65-4321": [("ssn", "123456789"), ("ssn", "987654321")],
    "2024-01-15 212-555-1234": [("phone", "2125551234")],
    "212-555-1234 212-555-9876": [("phone", "2125551234"), ("phone", "2125559876")],
    f"123-45-6789 {CARD} 212-555-1234": [("ssn", "123456789"), ("card", "4111111111111111"), ("phone", "2125551234")],
    f"+1 212 555 1234 {CARD}": [("phone", "2125551234"), ("card", "4111111111111111")],
    "1234 5678 9012 10.0.0.1": [("ip", "10.0.0.1")],
    "1234 5678 9012 34-56@x.com": [("email", "34-56@x.com")],
    "1234567890123456 and 1 2 3 4 5 6 7 8 9 10 11 12 13": [],
}


@pytest.mark.parametrize("text", SIDE_BY_SIDE)
def test_numbers_side_by_side(text):
    assert [(kind, canon) for _, _, kind, canon in pii.detect(text)] == SIDE_BY_SIDE[text]


def test_no_value_stays(spark):
    df = spark.createDataFrame(list(enumerate(SIDE_BY_SIDE)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replace(df).collect()}
    for i, (text, values) in enumerate(SIDE_BY_SIDE.items()):
        plain = re.sub(r"[ -]", "", out[i])
        assert values and values[0][0] in ("email", "ip") or re.sub(r"\d", "0", out[i]) == re.sub(r"\d", "0", text)
        assert not any(canon in plain for kind, canon in values if kind not in ("email", "ip"))
