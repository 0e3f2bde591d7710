"""Queries that go through stored indexes and models, each with the same query in SQL.

Corpora are the languages of ``documents``, or, where a question is put to several, their sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry import config
from heronry.operators import answers, chunking, embedding, text_index
from heronry.operators.vector_store import VectorStore
from heronry.plans import queries as base
from heronry.storage import materialize, shared_path

SOURCES = 20
ANSWER_WORDS = 20
DIGITS = 10_000


def _store_topk(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    vectors = base._table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    store = VectorStore.create(vectors, shared_path(spark, "vectors"))
    asked = vectors.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return store.search(asked, config.TOP_K, threshold).select("query_id", F.col("rn").cast("long").alias("rn"), "vec_id", "dist")


def _index(spark: SparkSession, sf_dir: str, corpus: str) -> text_index.TextIndex:
    docs = base._table(spark, sf_dir, "documents").select(F.col(corpus).alias("corpus"), "doc_id", "text")
    return text_index.over(chunking.chunk_tokens(docs))


def _with_uri(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    named = base._documents(spark, sf_dir).select("doc_id", "uri")
    return found.join(named, "doc_id").select("query_id", F.col("rn").cast("long").alias("rn"), "doc_id", "chunk_idx", "corpus", "uri", "dist")


def _languages(spark: SparkSession, sf_dir: str) -> list[str]:
    rows = base._table(spark, sf_dir, "documents").select("lang").where("lang IS NOT NULL").distinct().collect()
    return sorted(r["lang"] for r in rows)


def _found(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    questions = base._questions(spark, sf_dir)
    found = _index(spark, sf_dir, "lang").search(questions, text_index.everywhere(questions, _languages(spark, sf_dir)), config.TOP_K, threshold)
    return _with_uri(spark, sf_dir, found)


def _in_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = base._questions(spark, sf_dir)
    two = F.array(F.col("query_id") % SOURCES, (F.col("query_id") * 7 + 3) % SOURCES)
    scope = questions.select("query_id", F.explode(F.transform(two, lambda i: F.concat(F.lit("src"), i.cast("string")))).alias("corpus"))
    return _with_uri(spark, sf_dir, _index(spark, sf_dir, "source").search(questions, scope, config.TOP_K, base.WIDE))


def first_words() -> Callable[[str, list[str]], str | None]:
    """A generator that answers with the first words of the nearest context."""
    return lambda text, chunks: " ".join(chunks[0].split()[:ANSWER_WORDS])


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts' texts are joined to the few that were found; they never go through the search."""
    found = materialize(_found(spark, sf_dir, config.DISTANCE_THRESHOLD), "contexts")  # read twice, searched once
    wanted = base._table(spark, sf_dir, "documents").join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = chunking.chunk_text(wanted.select("doc_id", "text")).select("doc_id", "chunk_idx", "chunk")
    contexts = found.join(chunks, ["doc_id", "chunk_idx"]).select("query_id", "rn", "chunk", "uri", F.concat(F.lit("document "), "doc_id").alias("title"))
    rows = answers.answer(base._questions(spark, sf_dir), contexts, first_words)
    return rows.select("query_id", "status", "message", "answer", F.size("contexts").cast("long").alias("n_contexts"), F.array_join("sources.uri", " ").alias("uris"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each conversation, its contexts the turns: every third uri missing, some responses without contexts."""
    turn = F.struct("turn", F.when(F.col("turn") % 3 < 2, F.concat(F.lit("turn://"), "role")).alias("uri"), F.substring("text", 1, 20).alias("title"))
    rows = base._table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    contexts = F.transform("turns", lambda t: F.struct(t["uri"].alias("uri"), t["title"].alias("title")))
    none = F.when(F.col("query_id") % 11 == 0, F.lit(None)).when(F.col("query_id") % 7 == 0, F.slice(contexts, 1, 0)).otherwise(contexts)
    return rows.select("query_id", none.alias("contexts"))


def _uri_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.uri_set(_found(spark, sf_dir, base.WIDE))


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as whole numbers of 1/10000, so that they compare in text."""
    docs = base._table(spark, sf_dir, "documents").select("doc_id", "text")
    made = embedding.embed(docs, embedding.fit(docs))
    digits = F.transform("embedding", lambda x: F.round(x.cast("double") * DIGITS).cast("long").cast("string"))
    return made.select("doc_id", "model_id", "dim", F.array_join(digits, " ").alias("digits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vector_store_topk": lambda s, d: _store_topk(s, d, config.DISTANCE_THRESHOLD),
    "vector_store_topk_wide": lambda s, d: _store_topk(s, d, base.WIDE),
    "retrieve_indexed_topk": lambda s, d: _found(s, d, config.DISTANCE_THRESHOLD),
    "retrieve_in_corpora": _in_corpora,
    "embed_documents": _embedded,
    "answer_batch": _answers,
    "nested_contexts": lambda s, d: answers.unnest(_responses(s, d)),
    "nested_sources": lambda s, d: answers.nested_sources(_responses(s, d)),
    "uri_set": _uri_set,
}


def _found_sql(threshold: float, scope: str = "") -> str:
    """CTEs up to ``best`` with corpus: the language, or within ``scope`` (query_id, corpus) the source."""
    corpus = "source" if scope else "lang"
    held = f" JOIN ({scope}) AS sc USING (query_id, corpus)" if scope else " WHERE corpus IS NOT NULL"
    return f"""WITH {base._CHUNKS_SQL}, {base._cosine("chunks", "doc_id, uri, chunk_idx", base._BENCH).replace("dists AS (", "alldists AS (")},
  dists AS (SELECT alldists.*, corpus FROM alldists JOIN (SELECT doc_id, {corpus} AS corpus FROM documents) AS c USING (doc_id){held}), {base._ranked("doc_id, chunk_idx", threshold)}"""


_SCOPE = f"SELECT DISTINCT item_id AS query_id, 'src' || unnest([item_id % {SOURCES}, (item_id * 7 + 3) % {SOURCES}]) AS corpus FROM benchmark"
_RESPONSES_SQL = """WITH turns AS (SELECT conv_id AS query_id, list({'t': turn, 'uri': CASE WHEN turn % 3 < 2 THEN 'turn://' || role END, 'title': substring(text, 1, 20)} ORDER BY turn) AS c FROM conversations GROUP BY conv_id),
  responses AS (SELECT query_id, CASE WHEN query_id % 11 = 0 THEN NULL WHEN query_id % 7 = 0 THEN [] ELSE c END AS c FROM turns),
  flat AS (SELECT query_id, i - 1 AS pos, c[i].uri AS uri, c[i].title AS title FROM (SELECT query_id, c, unnest(range(1, len(c) + 1)) AS i FROM responses WHERE len(c) > 0) UNION ALL SELECT query_id, NULL, NULL, NULL FROM responses WHERE c IS NULL OR len(c) = 0)"""
_EMBED_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {base._WORDS} AS w FROM documents),
  tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM docs) GROUP BY rid, t),
  dfs AS (SELECT t, count(*) AS df, row_number() OVER (ORDER BY count(*) DESC, t) AS place FROM tf GROUP BY t),
  feats AS (SELECT t, place, ln(((SELECT count(*) FROM docs) + 1) / CAST(df + 1 AS DOUBLE)) + 1 AS idf FROM dfs WHERE place <= {embedding.FEATURES}),
  raw AS (SELECT rid, t, tf * idf AS x FROM tf JOIN feats USING (t)),
  x AS (SELECT rid, t, x / sqrt(sum(x * x) OVER (PARTITION BY rid)) AS x FROM raw),
  signs AS (SELECT t, j, CASE WHEN substring(md5(t || ':' || j), 1, 1) >= '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM (SELECT t, unnest(range({embedding.DIMENSIONS})) AS j FROM feats)),
  drawn AS (SELECT rid, j, sum(x * s) AS y FROM x JOIN signs USING (t) GROUP BY rid, j),
  sums AS (SELECT t, j, sum(x * y) AS p FROM x JOIN drawn USING (rid) GROUP BY t, j),
  proj AS (SELECT t, j, p / sqrt(sum(p * p) OVER (PARTITION BY j)) AS p FROM sums),
  vecs AS (SELECT rid, j, sum(x * p) AS v FROM x JOIN proj USING (t) GROUP BY rid, j),
  unit AS (SELECT rid, j, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY rid)) AS FLOAT) AS v FROM vecs),
  texts AS (SELECT rid, string_agg(CAST(CAST(round(CAST(v AS DOUBLE) * {DIGITS}) AS BIGINT) AS VARCHAR), ' ' ORDER BY j) AS digits FROM unit GROUP BY rid)
  SELECT doc_id, 'cooccurrence-{embedding.DIMENSIONS}-' || substring((SELECT md5(string_agg(t, chr(10) ORDER BY place)) FROM feats), 1, 12) AS model_id, {embedding.DIMENSIONS} AS dim, digits FROM docs LEFT JOIN texts USING (rid)"""

ORACLE_SQL: dict[str, str] = {
    "vector_store_topk": base._dense_sql(config.DISTANCE_THRESHOLD),
    "vector_store_topk_wide": base._dense_sql(base.WIDE),
    "retrieve_indexed_topk": f"{_found_sql(config.DISTANCE_THRESHOLD)} SELECT query_id, rn, doc_id, chunk_idx, corpus, uri, dist FROM best",
    "retrieve_in_corpora": f"{_found_sql(base.WIDE, _SCOPE)} SELECT query_id, rn, doc_id, chunk_idx, corpus, uri, dist FROM best",
    "embed_documents": _EMBED_SQL,
    "answer_batch": f"""{_found_sql(config.DISTANCE_THRESHOLD)},
      firsts AS (SELECT query_id, uri, min(rn) AS p FROM best GROUP BY query_id, uri),
      srcs AS (SELECT query_id, count(*) AS n, string_agg(uri, ' ' ORDER BY p) AS uris FROM firsts GROUP BY query_id),
      ctx AS (SELECT query_id, count(*) AS n_contexts FROM best GROUP BY query_id),
      nearest AS (SELECT query_id, array_to_string(chunks.words[1:{ANSWER_WORDS}], ' ') AS answer FROM best JOIN chunks USING (doc_id, chunk_idx) WHERE rn = 1)
      SELECT item_id AS query_id, CASE WHEN n_contexts IS NULL THEN 'warning' ELSE 'success' END AS status, CASE WHEN n_contexts IS NULL THEN '{answers.NOTHING}' ELSE n || ' source(s)' END AS message, answer, coalesce(n_contexts, 0) AS n_contexts, coalesce(uris, '') AS uris
      FROM benchmark LEFT JOIN ctx ON ctx.query_id = item_id LEFT JOIN srcs ON srcs.query_id = item_id LEFT JOIN nearest ON nearest.query_id = item_id""",
    "nested_contexts": f"{_RESPONSES_SQL} SELECT query_id, pos, uri, title FROM flat",
    "nested_sources": f"""{_RESPONSES_SQL}, firsts AS (SELECT query_id, uri, min(pos) AS p, arg_min(title, pos) AS title FROM flat WHERE uri <> '' GROUP BY query_id, uri)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS pos, uri, title FROM firsts""",
    "uri_set": f"{_found_sql(base.WIDE)} SELECT DISTINCT corpus, uri FROM best",
}
