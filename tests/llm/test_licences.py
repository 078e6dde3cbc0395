"""Notices of sibling licences and versions, each reported as itself alone."""

import pytest

pytest.importorskip("public_tokenizers")

from bizlens.llm import licenses  # noqa: E402

GPL = ("This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public "
       "License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any "
       "later version.")
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
NOTICES = [
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    (GPL.format(";", "", ";", 2), "GPL-2.0"), (GPL.format(":", "", ",", 3), "GPL-3.0"),
    (GPL.format(":", "Affero ", ",", 3), "AGPL-3.0"), (GPL.format(";", "Lesser ", ";", "2.1"), "LGPL-2.1"),
    (GPL.format(":", "Lesser ", ",", 3), "LGPL-3.0"),
    (CC.format(""), "CC-BY-4.0"), (CC.format("-ShareAlike"), "CC-BY-SA-4.0"), (CC.format("-NoDerivatives"), "CC-BY-ND-4.0"),
    (CC.format("-NonCommercial"), "CC-BY-NC-4.0"), (CC.format("-NonCommercial-ShareAlike"), "CC-BY-NC-SA-4.0"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
     "commercial or non-commercial, and by any means.", "Unlicense"),
]


def test_siblings_are_told_apart(spark):
    rows = [(i, f"some words before. {t} And some behind") for i, (t, _) in enumerate(NOTICES)]
    rows.append((99, f"{NOTICES[0][0]} words between them {NOTICES[8][0]}"))
    got = {}
    for r in licenses.notices(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {**{i: {name} for i, (_, name) in enumerate(NOTICES)}, 99: {"GPL-2.0", "CC-BY-SA-4.0"}}
