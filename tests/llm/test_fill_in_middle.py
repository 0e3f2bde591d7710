"""Fill-in-the-middle against a version that keeps all units, and the edges of its contract."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heronry.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.text(alphabet="ab é😀\n\t\x0b<>PSM ", max_size=40))
def test_any_text(doc_id, text):
    made = fim.transform(doc_id, text)
    assert tuple(made) == plain_version(doc_id, text)
    assert fim.restore(made.output, made.form) == text


def test_all_forms_and_cuts_occur():
    made = [fim.transform(i, "one two  three <S four\n") for i in range(400)]
    assert {m.form for m in made} == {"plain", "spm", "psm"}
    cut = [m for m in made if m.form != "plain"]
    assert {m.prefix_chars for m in cut} == {0, 3, 7, 14, 17, 22, 23}
    assert 0.4 < len(cut) / len(made) < 0.6


@pytest.mark.parametrize("text", ["", "<P>", "a <M> b", "x<S>"])
def test_stays_plain(text):
    assert all(fim.transform(i, text).form == "plain" for i in range(50))


def test_markers_that_only_seem_to_begin():
    for i in range(200):
        made = fim.transform(i, "<S <P <M > < P> S>")
        assert fim.restore(made.output, made.form) == "<S <P <M > < P> S>"


def test_long_text_with_few_or_many_units():
    for text in ("x" * 300_000, "a " * 100_000, " " * 100_000 + "end"):
        doc_id = next(i for i in range(100) if fim.transform(i, "a b").form != "plain")
        assert tuple(fim.transform(doc_id, text)) == plain_version(doc_id, text)


def test_tables(spark):
    """Nulls, repeated rows, columns of clashing names, an empty table."""
    rows = [(1, "one two three", "x", 5), (1, "one two three", "y", 6), (None, "a b", None, None), (2, None, None, 1), (3, "", "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    got = fim.digests(docs).collect()
    assert len(got) == 5 and got[0] == got[1]
    by = {r["doc_id"]: r for r in got}
    for doc_id, text in ((1, "one two three"), (2, ""), (3, ""), (None, "a b")):
        want = plain_version("" if doc_id is None else doc_id, text)
        r = by[doc_id]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == want[:4]
        assert r["output_sha256"] == hashlib.sha256(want[4].encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    outputs = {r["doc_id"]: r for r in fim.transformed(docs).collect()}
    assert outputs[1]["output"] == plain_version(1, "one two three")[4]
    assert fim.digests(docs.limit(0)).count() == 0
