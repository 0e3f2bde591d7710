"""Scalar functions as column expressions; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronry import config


# Fixed values that results depend on: characters not allowed in a name, a full resource name, an id in a link.
NOT_IN_NAMES = "[^a-zA-Z0-9_-]"
RESOURCE = "^projects/[^/]+/locations/[^/]+/ragCorpora/[^/]+$"
ID_IN_LINK = "/d/([a-zA-Z0-9-_]+)"


def sanitize(name: Column) -> Column:
    """Each character outside letters, digits, ``_`` and ``-`` becomes one ``_``."""
    return F.regexp_replace(name, NOT_IN_NAMES, "_")


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_resource_name(name: Column) -> Column:
    return name.rlike(RESOURCE)


def resource_name(prefix: str, corpus_id: Column) -> Column:
    return F.concat(F.lit(prefix + "/"), corpus_id)


def file_id(link: Column) -> Column:
    """The id in a document link, null where there is none."""
    return F.nullif(F.regexp_extract(link, ID_IN_LINK, 1), F.lit(""))


def truncate(content: Column, limit: int = config.CONTENT_LIMIT) -> Column:
    """The first ``limit`` code points."""
    return F.substring(content, 1, limit)


def folder_link(folder_id: Column) -> Column:
    return F.concat(F.lit("folder://"), folder_id)


def document_uri(source: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("doc://"), source, F.lit("/"), doc_id.cast("string"))


def time_text(ts: Column) -> Column:
    """A timestamp as text, missing as the empty string."""
    return F.coalesce(ts.cast("string"), F.lit(""))


def decode_utf8(content: Column) -> Column:
    """Bytes as text, null where they are not UTF-8; missing bytes are an empty text."""
    text = F.coalesce(content, F.lit(b"")).cast("string")
    return F.when(F.is_valid_utf8(text), text)


def tokens(text: Column) -> Column:
    """Whitespace tokens, none of them empty."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def hash_bucket(token: Column, buckets: int = 64) -> Column:
    """A stable bucket from the first 32 bits of the token's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def plain_zero(x: Column) -> Column:
    """Signed zero made plain, so that equal distances print alike."""
    return F.when(F.abs(x) < 1e-6, F.lit(0.0)).otherwise(x)
