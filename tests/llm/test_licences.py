import pytest
from tests.llm.conftest import prose
from tests.llm.llm_helpers import rows_of

from compassframe.llm import licence_scan


@pytest.fixture(scope="module")
def got(small, odd):
    common = "of the work and of this software in the form of a copy and to any person the rights to use"
    docs = odd + [(100 + i, prose(i, 50) + "\n" + common + f" {i}") for i in range(40)]
    docs += [
        (500, prose(1, 30) + " Released under the MIT License."), (501, "x\nThis work is licensed under the GNU General Public License, version 3."),
        (502, "LICENSED UNDER CC BY-NC 4.0. " + prose(2, 80)), (503, "Licensed under the Apache License, Version 2.0\n\nSPDX-License-Identifier: MIT"),
        (504, "the license of the driver was renewed"), (505, "a general public debate on version 3 of the law"),
        (506, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
        (507, "permission is granted to leave the room free of charge"), (500, prose(1, 30) + " Released under the MIT License."),
    ]
    return docs, rows_of(licence_scan.scan(small(docs)))


def test_families_are_named_and_others_unknown(got):
    docs, rows = got
    assert len(rows) == len(docs)
    named = {r.doc_id: (r.n_paragraphs, r.licences) for r in rows if r.n_paragraphs}
    assert named == {500: (1, "MIT"), 501: (1, "GPL"), 502: (1, "CC-BY-NC"), 503: (2, "Apache-2.0,MIT"), 506: (1, "BSD")}
    assert all((r.probability is None) == (r.n_paragraphs == 0) for r in rows)
    assert len([r for r in rows if r.doc_id == 500]) == 2


def test_every_template_names_its_family(spark, small):
    docs = [(100 * f + i, f"{prose(i, 12)} {t} {prose(i + 1, 12)}") for f, name in enumerate(licence_scan.FAMILIES)
            for i, t in enumerate(licence_scan.TEMPLATES[name])]
    found = {r.doc_id: r.licences for r in rows_of(licence_scan.scan(small(docs)))}
    wrong = {d: x for d, x in found.items() if x != licence_scan.FAMILIES[d // 100]}
    assert len(wrong) <= 1, wrong


def test_every_template_is_named_whatever_the_corpus(spark, small):
    """Hot sets of pairs, licence lines without a licence word and wrapped notices do not blunt the model."""
    docs = [(100 * f + i, f"{prose(i, 12)} {t} {prose(i + 1, 12)}") for f, name in enumerate(licence_scan.FAMILIES)
            for i, t in enumerate(licence_scan.TEMPLATES[name])]
    hot = [(10_000 + i, f"{prose(i, 9)} of the {prose(i + 1, 9)}") for i in range(3000)]
    unmarked = [(20_000 + i, t) for i, t in enumerate([
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute",
        "(at your option) any later version.", "This Source Code Form is subject to the terms of the Mozilla Public"] * 30)]
    wrong = {}
    for r in rows_of(licence_scan.scan(small(docs + hot + unmarked))):
        if r.doc_id < 10_000 and r.licences != licence_scan.FAMILIES[r.doc_id // 100] or 10_000 <= r.doc_id < 20_000 and r.licences:
            wrong[r.doc_id] = r.licences
    assert wrong == {}


def test_unknown_sets_are_counted_over_the_corpus(spark, small):
    docs = [(i, "talk of the town") for i in range(500)] + [(600 + i, f"x {t} y") for i, t in enumerate(
        ["subject to the terms", "any person obtaining it", "a copy of this", "in all copies", "released under the bridge"])]
    templates = licence_scan.Templates(spark)
    rows = licence_scan.candidates(small(docs), templates.vocabulary)
    assert sorted(r.n for r in rows_of(licence_scan.unknown_sets(rows, templates))) == [1, 1, 1, 1, 1, 500]
    near = small([(1, "talk of the town\n\nthis copyright\n\nany person obtaining it"), (2, licence_scan.TEMPLATES["MIT"][4])])
    assert rows_of(licence_scan.unknown_sets(licence_scan.candidates(near, templates.vocabulary), templates)) == []


def test_wrapped_notices_and_several_licences(spark, small):
    gpl = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as\n"
           "# published by the Free Software Foundation, either version 3 of the\n# License, or (at your option) any later version.\n")
    lgpl = gpl.replace("GNU General Public License as\n# published", "GNU Lesser General Public\n# License as published").replace("program", "library")
    docs = [(1, gpl), (2, lgpl), (3, "Dual licensed under the MIT License or licensed under the Apache License, Version 2.0"),
            (4, f"{prose(1, 300)} Released under the MIT License. {prose(2, 300)} Licensed under CC BY-NC 4.0 {prose(3, 300)} all rights reserved"),
            (5, "Released under\r\n  the MIT\r\n  License."), (6, "Released under the bridge\n\nthe MIT campus")]
    found = {r.doc_id: r.licences for r in rows_of(licence_scan.scan(small(docs)))}
    assert found == {1: "GPL", 2: "LGPL", 3: "Apache-2.0,MIT", 4: "CC-BY-NC,MIT,Proprietary", 5: "MIT", 6: ""}


def test_empty_table(spark, small, odd):
    assert rows_of(licence_scan.scan(small(odd).limit(0))) == []
