"""The library's queries over the driver's tables, each with the same query in SQL.

``documents`` are the files of a corpus, their ``source`` the folder, ``benchmark`` the questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry import catalog, config
from heronry.functions import scalars
from heronry.operators import chunking, retrieval
from heronry.sources import dispatch, folders, parsers

PREFIX = "projects/p/locations/l/ragCorpora"
WIDE = 0.8

# Fixed inline inputs, the same rows in Spark and SQL.
CORPORA = [
    (f"{PREFIX}/1", "sales", "2024-01-01 00:00:00", "2024-02-01 00:00:00"),
    (f"{PREFIX}/2", "sales", "2023-01-01 00:00:00", None),
    (f"{PREFIX}/3", "my_team_notes", None, None),
    (f"{PREFIX}/4", "Caf__2024", "2024-05-01 12:30:00", "2024-05-02 00:00:00"),
]
NAMES = [f"{PREFIX}/9", f"{PREFIX}/1", "sales", "Sales", "my team notes", "my_team_notes", "a/b/c d", "Café 2024", "😀x", ""]
LINKS = ["https://x.example/document/d/1AbC-_9/edit", "https://x.example/presentation/d/zz/edit#s", "https://x.example/spreadsheets/d/S_1", "https://x.example/drive/folders/F1", "plain text", ""]
FILES = [
    ("application/vnd.google-apps.presentation", "a"), ("application/pdf", "b.docx"), ("x/presentation", "c"), ("x/y", "d.pptx"), ("x/y", "e.PPTX"),
    ("x/wordprocessingml.document", "f"), ("x/y", "g.docx"), ("x/spreadsheetml.sheet", "h"), ("x/y", "i.xlsx"), ("application/vnd.ms-excel", "j.xls"),
    ("text/html", "k.html"), ("text/plain", "l.txt"), (None, "m.docx"), ("application/pdf", None),
]
REQUESTED = [(0, "src3"), (1, "O'Brien"), (2, "src3"), (3, "missing"), (4, "src0"), (5, "old")]
EXTRA_FOLDERS = [("x1", "O'Brien", folders.FOLDER_MIME, False), ("x2", "old", folders.FOLDER_MIME, True), ("x3", "missing", "text/plain", False), ("x0", "src0", folders.FOLDER_MIME, None)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, corpus: str | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    docs = docs if corpus is None else docs.where(F.col("lang") == corpus)
    return docs.select("doc_id", scalars.document_uri(F.col("source"), F.col("doc_id")).alias("uri"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _retrieved(spark: SparkSession, sf_dir: str, threshold: float, corpus: str | None = None) -> DataFrame:
    """Nearest chunks of every question, in all documents or in those of one corpus (a value of ``lang``)."""
    docs = _documents(spark, sf_dir, corpus)
    found = retrieval.retrieve(_questions(spark, sf_dir), chunking.chunk_tokens(docs.select("doc_id", "text")), config.TOP_K, threshold)
    return found.join(docs.select("doc_id", "uri"), "doc_id").select("query_id", F.col("rn").cast("long").alias("rn"), "doc_id", "chunk_idx", "uri", "dist")


def _wide_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _retrieved(spark, sf_dir, WIDE)
    return retrieval.sources(found.select("query_id", F.col("rn").alias("pos"), "uri", F.concat(F.lit("document "), "doc_id").alias("title")))


def _document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _wide_sources(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "uri"))).alias("s"))
    return found.select("query_id", F.size("s").cast("long").alias("n_sources"), F.array_join("s.uri", " ").alias("uris"))


def _dense(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    found = retrieval.dense_top_k(asked, vectors, config.TOP_K, threshold)
    return found.select("query_id", F.col("rn").cast("long").alias("rn"), "vec_id", "dist")


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = retrieval.similar_documents(docs, docs.where(F.col("doc_id") % 20 == 0), config.TOP_K, config.DISTANCE_THRESHOLD)
    return found.select("query_id", F.col("rn").cast("long").alias("rn"), "doc_id", "dist")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_text(_documents(spark, sf_dir)).select("doc_id", "chunk_idx", "n_tokens", "chunk")


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = scalars.truncate(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.length(content).cast("long").alias("n"), F.md5(content).alias("content_md5"))


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _documents(spark, sf_dir).select("doc_id", F.explode(scalars.tokens(F.col("text"))).alias("token"))
    return words.groupBy("doc_id", scalars.hash_bucket(F.col("token")).alias("bucket")).agg(F.count("*").alias("tf"))


def _registry(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CORPORA, "resource_name string, display_name string, c string, u string")
    return rows.select("resource_name", "display_name", F.col("c").cast("timestamp").alias("create_time"), F.col("u").cast("timestamp").alias("update_time"))


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


def _sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark).unionByName(_table(spark, sf_dir, "documents").select(F.col("text").alias("name")))
    return names.select(F.md5("name").alias("name_md5"), F.md5(scalars.sanitize(F.col("name"))).alias("clean_md5"))


def _folder_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = _table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    own = own.select(F.concat(F.lit("f-"), "name").alias("folder_id"), "name", F.lit(folders.FOLDER_MIME).alias("mime_type"), F.lit(False).alias("trashed"))
    extra = spark.createDataFrame(EXTRA_FOLDERS, "folder_id string, name string, mime_type string, trashed boolean")
    return spark.createDataFrame(REQUESTED, "ord long, name string"), own.unionByName(extra)


def _parsed(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from heronry.sources.writers import as_files

        files = as_files(_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("file_id"), "text"), kind)
        return parsers.parse_files(files).select(F.col("file_id").cast("long").alias("item_id"), "status", "content")

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "retrieve_topk_default": lambda s, d: _retrieved(s, d, config.DISTANCE_THRESHOLD),
    "retrieve_topk_wide": lambda s, d: _retrieved(s, d, WIDE),
    "retrieve_in_corpus": lambda s, d: _retrieved(s, d, WIDE, "fr"),
    "sources_distinct": _wide_sources,
    "document_search": _document_search,
    "dense_topk_default": lambda s, d: _dense(s, d, config.DISTANCE_THRESHOLD),
    "dense_topk_wide": lambda s, d: _dense(s, d, WIDE),
    "similar_documents": _similar,
    "chunk_documents": _chunks,
    "truncate_content": _truncated,
    "term_buckets": _buckets,
    "sanitize_name": _sanitized,
    "resolve_corpus": lambda s, d: catalog.resolve(_names(s), _registry(s), PREFIX),
    "corpus_exists": lambda s, d: catalog.exists(_names(s), _registry(s), PREFIX),
    "list_corpora": lambda s, d: catalog.listing(_registry(s)),
    "list_files": lambda s, d: _table(s, d, "documents").select(F.concat(F.lit("document "), "doc_id").alias("title"), scalars.document_uri(F.col("source"), F.col("doc_id")).alias("uri"), F.col("lang").alias("corpus")).distinct(),
    "folder_lookup": lambda s, d: folders.found(*_folder_tables(s, d)).select("ord", "name", scalars.folder_link(F.col("folder_id")).alias("path")),
    "folder_not_found": lambda s, d: folders.not_found(*_folder_tables(s, d)),
    "extract_file_id": lambda s, d: s.createDataFrame([(x,) for x in LINKS], "link string").select("link", scalars.file_id(F.col("link")).alias("file_id")),
    "mime_dispatch": lambda s, d: s.createDataFrame(FILES, "mime_type string, name string").select("mime_type", "name", dispatch.parser_of(F.col("mime_type"), F.col("name")).alias("parser")),
    **{f"parse_{k}": _parsed(k) for k in ("docx", "pptx", "xlsx", "pdf")},
}


def _values(rows: list, columns: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(quote, r if isinstance(r, tuple) else (r,))) + ')' for r in rows)}) v({columns})"


_STRIDE = config.CHUNK_SIZE - config.CHUNK_OVERLAP
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_CLEAN = "regexp_replace({}, '[^a-zA-Z0-9_-]', '_', 'g')"
_CHUNKS_SQL = f"""
  words AS (SELECT doc_id, 'doc://' || source || '/' || doc_id AS uri, {_WORDS} AS w FROM documents),
  numbered AS (SELECT doc_id, uri, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - {config.CHUNK_SIZE}) / {_STRIDE}.0) AS BIGINT)))) AS chunk_idx FROM words WHERE len(w) > 0),
  chunks AS (SELECT doc_id, uri, CAST(chunk_idx AS BIGINT) AS chunk_idx, w[chunk_idx * {_STRIDE} + 1 : chunk_idx * {_STRIDE} + {config.CHUNK_SIZE}] AS words FROM numbered)"""


def _cosine(items: str, key: str, queries: str) -> str:
    """CTEs up to ``dists`` (query_id, key, dist) of ``items`` (key, words) and ``queries`` (query_id, text)."""
    return f"""
  it AS (SELECT {key}, t, count(*) AS tf FROM (SELECT {key}, unnest(words) AS t FROM {items}) GROUP BY {key}, t),
  inorm AS (SELECT {key}, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS n FROM it GROUP BY {key}),
  qt AS (SELECT query_id, t, count(*) AS tf FROM (SELECT query_id, unnest({_WORDS}) AS t FROM {queries}) GROUP BY query_id, t),
  qnorm AS (SELECT query_id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS n FROM qt GROUP BY query_id),
  dots AS (SELECT query_id, {key}, sum(it.tf * qt.tf) AS dot FROM it JOIN qt USING (t) GROUP BY query_id, {key}),
  raw AS (SELECT query_id, {key}, round(1 - dot / nullif(qnorm.n * inorm.n, 0), 6) AS x FROM dots JOIN qnorm USING (query_id) JOIN inorm USING ({key})),
  dists AS (SELECT query_id, {key}, CASE WHEN abs(x) < 1e-6 THEN 0.0::DOUBLE ELSE x END AS dist FROM raw)"""


def _ranked(order: str, threshold: float) -> str:
    return f"""
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, {order}) AS rn FROM dists WHERE dist < {threshold}),
  best AS (SELECT * FROM ranked WHERE rn <= {config.TOP_K})"""


_BENCH = "(SELECT item_id AS query_id, text FROM benchmark)"


def _retrieve_sql(threshold: float, documents: str = "documents") -> str:
    return f"WITH {_CHUNKS_SQL.replace('FROM documents', 'FROM ' + documents)}, {_cosine('chunks', 'doc_id, uri, chunk_idx', _BENCH)}, {_ranked('doc_id, chunk_idx', threshold)}"


_SOURCES_SQL = f"""{_retrieve_sql(WIDE)},
  firsts AS (SELECT query_id, uri, min(rn) AS p, arg_min('document ' || doc_id, rn) AS title FROM best GROUP BY query_id, uri),
  srcs AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS pos, uri, title FROM firsts)"""


def _dense_sql(threshold: float) -> str:
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  raw AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_dot_product(q.e, v.e) / nullif(sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)), 0), 6) AS x FROM v AS q, v WHERE q.vec_id % 20 = 0),
  dists AS (SELECT query_id, vec_id, CASE WHEN abs(x) < 1e-6 THEN 0.0::DOUBLE ELSE x END AS dist FROM raw), {_ranked('vec_id', threshold)}
  SELECT query_id, rn, vec_id, dist FROM best"""


_REGISTRY_SQL = f"reg AS (SELECT r AS resource_name, d AS display_name, CAST(c AS TIMESTAMP) AS create_time, CAST(u AS TIMESTAMP) AS update_time FROM {_values(CORPORA, 'r, d, c, u')})"
_RESOLVE_SQL = f"""WITH {_REGISTRY_SQL},
  firsts AS (SELECT display_name, resource_name AS found FROM (SELECT *, row_number() OVER (PARTITION BY display_name ORDER BY create_time NULLS LAST, resource_name) AS rk FROM reg) WHERE rk = 1),
  names AS (SELECT * FROM {_values(NAMES, 'name')}),
  resolved AS (SELECT name, CASE WHEN regexp_matches(name, '^projects/[^/]+/locations/[^/]+/ragCorpora/[^/]+$') THEN name
    ELSE coalesce((SELECT found FROM firsts WHERE display_name = name), (SELECT found FROM firsts WHERE display_name = {_CLEAN.format('name')}),
      '{PREFIX}/' || {_CLEAN.format("list_extract(string_split(name, '/'), -1)")}) END AS resource_name FROM names)"""
_FOLDERS_SQL = f"""WITH req AS (SELECT * FROM {_values(REQUESTED, 'ord, name')}),
  allf AS (SELECT DISTINCT 'f-' || source AS folder_id, source AS name, '{folders.FOLDER_MIME}' AS mime_type, false AS trashed FROM documents UNION ALL SELECT * FROM {_values(EXTRA_FOLDERS, 'folder_id, name, mime_type, trashed')}),
  live AS (SELECT name, min(folder_id) AS folder_id FROM allf WHERE mime_type = '{folders.FOLDER_MIME}' AND NOT coalesce(trashed, false) GROUP BY name)"""

ORACLE_SQL: dict[str, str] = {
    "retrieve_topk_default": f"{_retrieve_sql(config.DISTANCE_THRESHOLD)} SELECT query_id, rn, doc_id, chunk_idx, uri, dist FROM best",
    "retrieve_topk_wide": f"{_retrieve_sql(WIDE)} SELECT query_id, rn, doc_id, chunk_idx, uri, dist FROM best",
    "retrieve_in_corpus": f"{_retrieve_sql(WIDE, "(SELECT * FROM documents WHERE lang = 'fr') AS documents")} SELECT query_id, rn, doc_id, chunk_idx, uri, dist FROM best",
    "sources_distinct": f"{_SOURCES_SQL} SELECT query_id, pos, uri, title FROM srcs",
    "document_search": f"{_SOURCES_SQL} SELECT query_id, count(*) AS n_sources, string_agg(uri, ' ' ORDER BY pos) AS uris FROM srcs GROUP BY query_id",
    "dense_topk_default": _dense_sql(config.DISTANCE_THRESHOLD),
    "dense_topk_wide": _dense_sql(WIDE),
    "similar_documents": f"""WITH items AS (SELECT doc_id, {_WORDS} AS words FROM documents), asked AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 20 = 0),
      {_cosine('items', 'doc_id', 'asked')}, {_ranked('doc_id', config.DISTANCE_THRESHOLD)} SELECT query_id, rn, doc_id, dist FROM best""",
    "chunk_documents": f"WITH {_CHUNKS_SQL} SELECT doc_id, chunk_idx, CAST(len(words) AS BIGINT) AS n_tokens, array_to_string(words, ' ') AS chunk FROM chunks",
    "truncate_content": f"SELECT doc_id, CAST(length(substring(text, 1, {config.CONTENT_LIMIT})) AS BIGINT) AS n, md5(substring(text, 1, {config.CONTENT_LIMIT})) AS content_md5 FROM documents",
    "term_buckets": f"SELECT doc_id, CAST(('0x' || substring(md5(t), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS t FROM documents) GROUP BY ALL",
    "sanitize_name": f"SELECT md5(name) AS name_md5, md5({_CLEAN.format('name')}) AS clean_md5 FROM (SELECT name FROM {_values(NAMES, 'name')} UNION ALL SELECT text FROM documents)",
    "resolve_corpus": f"{_RESOLVE_SQL} SELECT name, resource_name FROM resolved",
    "corpus_exists": f"{_RESOLVE_SQL} SELECT name, (resource_name IN (SELECT resource_name FROM reg) OR name IN (SELECT display_name FROM reg)) AS corpus_exists FROM resolved",
    "list_corpora": f"WITH {_REGISTRY_SQL} SELECT resource_name, display_name, coalesce(strftime(create_time, '%Y-%m-%d %H:%M:%S'), '') AS create_time, coalesce(strftime(update_time, '%Y-%m-%d %H:%M:%S'), '') AS update_time FROM reg",
    "list_files": "SELECT DISTINCT 'document ' || doc_id AS title, 'doc://' || source || '/' || doc_id AS uri, lang AS corpus FROM documents",
    "folder_lookup": f"{_FOLDERS_SQL} SELECT CAST(ord AS BIGINT) AS ord, req.name, 'folder://' || folder_id AS path FROM req JOIN live USING (name)",
    "folder_not_found": f"{_FOLDERS_SQL} SELECT CAST(ord AS BIGINT) AS ord, name FROM req WHERE name NOT IN (SELECT name FROM live)",
    "extract_file_id": f"SELECT link, nullif(regexp_extract(link, '/d/([a-zA-Z0-9_-]+)', 1), '') AS file_id FROM {_values(LINKS, 'link')}",
    "mime_dispatch": f"""SELECT mime_type, name, CASE WHEN contains(m, 'application/vnd.google-apps') THEN 'native' WHEN contains(m, 'pdf') THEN 'pdf'
      WHEN contains(m, 'presentation') OR ends_with(n, '.pptx') THEN 'pptx' WHEN contains(m, 'wordprocessingml') OR ends_with(n, '.docx') THEN 'docx'
      WHEN contains(m, 'spreadsheetml') OR ends_with(n, '.xlsx') OR ends_with(n, '.xls') THEN 'xlsx' ELSE 'unsupported' END AS parser
      FROM (SELECT *, coalesce(mime_type, '') AS m, coalesce(name, '') AS n FROM {_values(FILES, 'mime_type, name')})""",
    **{f"parse_{k}": "SELECT item_id, 'success' AS status, text AS content FROM benchmark" for k in ("docx", "pptx", "pdf")},
    "parse_xlsx": "SELECT item_id, 'success' AS status, 'text,n' || chr(10) || CASE WHEN regexp_matches(text, '[,\"\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END || ',' || item_id || chr(10) AS content FROM benchmark",
}
