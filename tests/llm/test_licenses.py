import random

import pytest

from versewright.llm import licenses


def variants(text, rnd):
    """The same licence in other layouts."""
    lines = text.split("\n")
    yield "\n".join("   " + x.upper() for x in lines)
    yield "Copyright (c) 2019-2024 Somebody, Inc.\nAll rights reserved.\n\n" + text
    yield "© 2020 A. Person\r\n" + text.replace("\n", "\r\n")
    yield text.replace("license", "licence").replace("License", "Licence").replace('"', "“").replace("noninfringement", "non-infringement")
    yield "\n".join(("/* " if rnd.random() < 0.5 else " * ") + x for x in lines)


def test_packaged_licences_in_other_layouts(spark):
    rnd = random.Random(1)
    rows = [(k, name, v) for k, (name, text) in enumerate(licenses.license_texts()) for v in (text, *variants(text, rnd))]
    found = licenses.scanned(spark.createDataFrame(rows, "doc_id long, wanted string, text string")).collect()
    wrong = [(r.wanted, r.license, r.text[:60]) for r in found if r.license != r.wanted]
    assert len(found) > 100 and not wrong


@pytest.mark.parametrize("change", [lambda t: t[: len(t) // 2], lambda t: t + "\nAnd one more condition.", lambda t: t.replace("without", "with"), lambda t: "see: " + t])
def test_other_texts_are_no_licence(spark, change):
    rows = [(1, change(text)) for name, text in licenses.license_texts() if name in ("MIT", "ISC", "BSD-3-Clause")]
    found = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.license for r in found} == {None}


def test_notices_within_texts(spark):
    rows = [(1, "Story.\nReleased under the MIT license\nlicensed under cc by-nc 4.0!\nReleased under the MIT License."), (2, "we license nothing"), (3, "under the MIT License")]
    found = {r.doc_id: r.license_notices for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ["CC-BY-NC-4.0", "MIT"], 2: [], 3: []}


def test_odd_rows(spark, odd, empty):
    found = licenses.scanned(odd)
    rows = found.collect()
    assert len(rows) == 11 and [c for c in odd.columns if c != "license"] == found.columns[:-3]
    for r in rows:
        assert (r.license_digest is None) == (r.text is None) and r.license is None and r.license_notices == []
    assert licenses.scanned(empty).count() == 0
    own = licenses.known_licenses(spark, [("first", "No ID at all."), ("second", "no id at all")])
    assert [r.doc_id for r in licenses.scanned(odd, own).where("license = 'first'").collect()] == [None]
    assert licenses.scanned(odd, own.where("false")).count() == 11
