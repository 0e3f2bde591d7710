"""Nested contexts, batch answers, and sets of sources with their sketches."""

import pytest
from pyspark.sql import functions as F

from heronry.operators import answers

RESPONSES = "query_id long, contexts array<struct<uri: string, title: string>>"


def test_unnest_keeps_order_and_empty_responses(spark):
    rows = [(1, [("b", "B"), None, ("a", None), ("", "t"), ("b", "other"), (None, "n")]), (2, []), (3, None), (4, [("a", "A")])]
    df = spark.createDataFrame(rows, RESPONSES).repartition(3)
    got = sorted(map(tuple, answers.unnest(df).collect()), key=repr)
    want = [(1, 0, "b", "B"), (1, 1, None, None), (1, 2, "a", None), (1, 3, "", "t"), (1, 4, "b", "other"), (1, 5, None, "n"), (2, None, None, None), (3, None, None, None), (4, 0, "a", "A")]
    assert got == sorted(want, key=repr)
    assert sorted(map(tuple, answers.nested_sources(df).collect())) == [(1, 1, "b", "B"), (1, 2, "a", None), (4, 1, "a", "A")]


FOUND = "query_id long, rn int, chunk string, uri string, title string"


def test_every_question_has_one_row(spark):
    questions = spark.createDataFrame([(i, f"q{i}") for i in range(5)] + [(9, None)], "query_id long, text string").repartition(2)
    found = spark.createDataFrame([(1, 2, "two", "u", "T2"), (1, 1, "one", "u", "T1"), (1, 3, "three", "v", None), (3, 1, "x", None, "t"), (9, 1, "y", "", "t")], FOUND)
    made = []

    def factory():
        made.append(1)
        return lambda text, chunks: f"{text}: {'+'.join(chunks)}" if text else None

    got = {r["query_id"]: r for r in answers.answer(questions, found, factory).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 9] and not made  # made in tasks, not here
    assert got[1]["answer"] == "q1: one+two+three" and [c["rn"] for c in got[1]["contexts"]] == [1, 2, 3]
    assert [tuple(s) for s in got[1]["sources"]] == [("T1", "u"), (None, "v")] and got[1]["message"] == "2 source(s)"
    assert got[3]["status"] == "success" and got[3]["sources"] == []
    assert got[9]["answer"] is None and got[9]["status"] == "success"
    for i in (0, 2, 4):
        assert tuple(got[i])[1:] == ("warning", answers.NOTHING, None, [], [])
    assert all(r["answer"] is None for r in answers.answer(questions, found).collect())
    assert answers.answer(questions, found.limit(0)).where("status = 'warning'").count() == 6
    assert answers.answer(questions.limit(0), found).count() == 0


def test_generator_that_fails_fails_the_job(spark):
    questions = spark.createDataFrame([(1, "q")], "query_id long, text string")
    found = spark.createDataFrame([(1, 1, "c", "u", "t")], FOUND)

    def factory():
        def fail(text, chunks):
            raise RuntimeError("no model")

        return fail

    with pytest.raises(Exception, match="no model"):
        answers.answer(questions, found, factory).collect()


def test_sets_and_sketches(spark):
    """Sketches of three parts merge to within three standard errors of the exact sets."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("corpus"), F.concat(F.lit("u"), F.col("id") % 20_011).alias("uri"))
    rows = rows.unionByName(spark.createDataFrame([("a", None), ("a", ""), ("c", None)], "corpus string, uri string"))
    exact = {r["corpus"]: r["count"] for r in answers.uri_set(rows).groupBy("corpus").count().collect()}
    parts = [answers.uri_sketches(rows.where(F.coalesce(F.crc32("uri"), F.lit(0)) % 3 == i)) for i in range(3)]
    counted = {r["corpus"]: r["n_uris"] for r in answers.merged_counts(parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()}
    assert set(counted) == set(exact) == {"a", "b"}
    for corpus, n in exact.items():
        assert abs(counted[corpus] - n) <= 3 * 1.04 / 2**7 * n
