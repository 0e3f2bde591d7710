"""From retrieved contexts to answers: nested contexts, batch answers and sets of sources.

Nothing here depends on how contexts were found. A question's contexts are at most the k that were
retrieved for it, so they may be gathered into an array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators import retrieval

#: Makes, once in a task, a function of a question and its contexts in order that gives the answer, or none.
Generator = Callable[[], Callable[[str, list[str]], str | None]]

NOTHING = "No results found"


def unnest(responses: DataFrame) -> DataFrame:
    """(query_id, pos, uri, title) of responses (query_id, contexts: array of structs with uri and title), from 0 in order.

    A response without contexts, null or empty, keeps one row with null pos; a null context keeps
    its place with null fields.
    """
    rows = responses.select("query_id", F.posexplode_outer("contexts").alias("pos", "context"))
    return rows.select("query_id", F.col("pos").cast("long").alias("pos"), F.col("context.uri").alias("uri"), F.col("context.title").alias("title"))


def nested_sources(responses: DataFrame) -> DataFrame:
    """(query_id, pos, uri, title): the distinct sources of each response, the first of each uri."""
    return retrieval.sources(unnest(responses))


def gather(found: DataFrame) -> DataFrame:
    """(query_id, contexts) of contexts (query_id, rn, chunk, uri, title): arrays in the order of ``rn``."""
    return found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", "chunk", "uri", "title"))).alias("contexts"))


def generate(asked: DataFrame, generator: Generator | None) -> DataFrame:
    """``asked`` (query_id, text, contexts) with an ``answer``, null where there are no contexts; the generator is made once for each task."""
    if generator is None:
        return asked.withColumn("answer", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer_of = generator()
        for batch in batches:
            answers = [answer_of(text.as_py(), chunks.as_py()) if chunks.is_valid and len(chunks) else None for text, chunks in zip(batch.column("text"), batch.column("chunks"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(answers, pa.string())], [*batch.schema.names[:-1], "answer"])

    rows = asked.select("query_id", "text", "contexts", F.col("contexts.chunk").alias("chunks"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("chunks").schema)
    return rows.mapInArrow(run, schema + ", answer string")


def answer(questions: DataFrame, found: DataFrame, generator: Generator | None = None) -> DataFrame:
    """One row for each question (query_id, text): status, message, answer, contexts and distinct sources, both in order.

    ``found`` are the contexts (query_id, rn, chunk, uri, title). A question without contexts has
    status warning, empty arrays and no answer; without a generator no question has one.
    """
    asked = questions.select("query_id", "text").join(gather(found), "query_id", "left")
    told = generate(asked, generator)
    empty = F.array().cast(told.schema["contexts"].dataType)
    contexts = F.coalesce("contexts", empty)
    # of a row's few contexts the first of each uri, without leaving the row
    named = F.filter(contexts, lambda c: c["uri"].isNotNull() & (c["uri"] != ""))
    firsts = F.filter(named, lambda c, i: F.array_position(F.transform(named, lambda x: x["uri"]), c["uri"]) == i + 1)
    sources = F.transform(firsts, lambda c: F.struct(c["title"].alias("title"), c["uri"].alias("uri")))
    none = F.size(contexts) == 0
    message = F.when(none, NOTHING).otherwise(F.concat(F.size(sources).cast("string"), F.lit(" source(s)")))
    return told.select("query_id", F.when(none, "warning").otherwise("success").alias("status"), message.alias("message"), "answer", contexts.alias("contexts"), sources.alias("sources"))


def uri_set(found: DataFrame) -> DataFrame:
    """(corpus, uri): the set of sources of all contexts (corpus, uri) of a corpus, in no order."""
    return found.where(F.col("uri").isNotNull() & (F.col("uri") != "")).select("corpus", "uri").distinct()


def uri_sketches(found: DataFrame, bits: int = 14) -> DataFrame:
    """(corpus, sketch): a sketch of each corpus's set of sources in 2^bits bytes at most; relative error about 1.04 / 2^(bits / 2).

    Sketches of parts of the contexts merge, so sets need not be kept to be counted over time.
    """
    some = found.where(F.col("uri").isNotNull() & (F.col("uri") != ""))
    return some.groupBy("corpus").agg(F.hll_sketch_agg("uri", bits).alias("sketch"))


def merged_counts(sketches: DataFrame) -> DataFrame:
    """(corpus, n_uris) from any number of sketches of each corpus."""
    return sketches.groupBy("corpus").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_uris"))
