"""Fill-in-the-middle transformation by a two-pass streaming matcher of constant memory.

A text is matched twice from left to right. The first pass only counts units; the second advances a
lazy iterator of matches to the two ranks drawn for the document and keeps the two character
offsets. No array of units is ever made: beside the text and its output a document costs a counter
and one match.

Defined results: a null text is empty and stays plain, as does a text that holds a marker. A null
id counts as the empty decimal text. Repeated rows give equal rows. Columns other than ``doc_id``
and ``text`` are not read. One text is one cell and is handled in one task, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from heronry.llm.runtime import id_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space and the word after it, or white space alone.
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Of a hundred documents so many stay plain, and so many of the others put the suffix first.
PLAIN_PERCENT = 50
SUFFIX_FIRST_PERCENT = 80
SEED = 42

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


class Transformed(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits for a document: two cuts, plain or not, and the order of the parts."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def count_units(text: str) -> int:
    """First pass."""
    n = 0
    for _ in UNIT.finditer(text):
        n += 1
    return n


def offsets(text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: the characters that the first ``first`` and ``second`` units span; ``first`` is not larger."""
    units = UNIT.finditer(text)
    ends = [0, 0]
    passed = 0
    for i, rank in enumerate((first, second)):
        ends[i] = ends[i - 1] if i else 0
        while passed < rank:
            ends[i] = next(units).end()
            passed += 1
    return ends[0], ends[1]


def transform(doc_id: int | None, text: str, seed: int = SEED) -> Transformed:
    """The transformed text with its form: plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle)."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= PLAIN_PERCENT or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return Transformed(n, "plain", None, None, text)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = offsets(text, first, second)
    if h4 % 100 < SUFFIX_FIRST_PERCENT:
        return Transformed(n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])))
    return Transformed(n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])))


def restore(output: str, form: str) -> str:
    """The text behind an output.

    The parts hold no marker, and a marker cannot begin inside a part or inside another marker
    (none ends as one begins), so the first of each kind is the one that was put in.
    """
    if form == "plain":
        return output
    inner = SUFFIX if form == "psm" else PREFIX
    cut, last = output.index(inner, len(PREFIX)), output.index(MIDDLE)
    head, tail = output[len(PREFIX) : cut], output[cut + len(inner) : last]
    middle = output[last + len(MIDDLE) :]
    return head + middle + tail if form == "psm" else tail + middle + head


def _outputs(docs: DataFrame, seed: int, schema: str, row) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(doc_id.as_py(), text.as_py(), seed) for doc_id, text in zip(batch.column(0), batch.column(1))]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return id_text(docs).mapInArrow(run, schema)


def _text_row(doc_id: int | None, text: str, seed: int) -> tuple:
    made = transform(doc_id, text, seed)
    return doc_id, made.output, made.form, made.n


def _digest_row(doc_id: int | None, text: str, seed: int) -> tuple:
    made = transform(doc_id, text, seed)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, *made[:4], digest(made.output), digest(restore(made.output, made.form))


def transformed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, output, form, n): the texts a model is trained on."""
    return _outputs(docs, seed, "doc_id long, output string, form string, n long", _text_row)


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Counts, cuts and digests of every document's output and of the text rebuilt from it."""
    return _outputs(docs, seed, SCHEMA, _digest_row)
