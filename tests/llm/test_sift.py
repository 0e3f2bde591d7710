"""Texts stay where they are unless a join may find something, and windows of divided grams are packed."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from heronry.llm import near_copies, runtime, suffix_dedup


def test_sift_loses_no_key(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("a"), (F.col("id") % 7).alias("b"), F.lit("text").alias("text"))
    keys = rows.where("a % 10 = 3 or a is null").select("a", "b")
    for pages in (runtime.SIFT_PAGES, 0):
        monkeypatch.setattr(runtime, "SIFT_BITS", 16 if pages else 0)
        may, clear = (x.collect() for x in runtime.sift(rows, keys, ["a", "b"]))
        assert len(may) + len(clear) == 3000 and len({r.a for r in may + clear}) == 3000
        assert not [r for r in clear if r.a is None or r.a % 10 == 3]
        assert len(may) < 400
    assert [x.count() for x in runtime.sift(rows, keys.where("a < 0"), ["a", "b"])] == [0, 3000]


def text_moved(df):
    """Whether all scans of texts lie below a shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Union" not in plan


def test_texts_without_a_find_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(80))) for i in range(40)] + [(90, " ".join(f"w1x{j}" for j in range(80)))], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, cut = near_copies.keep_one(docs), suffix_dedup.remove_passages(docs)
        assert not text_moved(kept) and not text_moved(cut)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
        assert sorted(r.doc_id for r in cut.where("text = ''").collect()) == [1, 90] and cut.count() == 41
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_a_divided_gram_do_not_grow_with_its_windows():
    """A row for each slice and length; with a row for each window there would be 3,000 and more."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 120).astype(np.uint8).tobytes() for _ in range(30)]
    texts[7] = texts[3][:60] + texts[7][60:]
    n = len(texts)
    columns = {"shard": [9] * n, "gram": [4] * n, "context": list(range(n)), "weight": [1] * n, "slices": [2] * n, "n": [101] * n, "bytes": texts}
    types = [pa.int64()] * 4 + [pa.int64(), pa.int32(), pa.binary()]
    table = pa.table([pa.array(c, k) for c, k in zip(columns.values(), types)], list(columns))
    found = suffix_dedup.search_shard(table, [20]).to_pylist()
    packed = [r for r in found if r["kind"] == suffix_dedup.SLICE]
    windows = np.concatenate([np.frombuffer(r["windows"], np.int64).reshape(3, -1) for r in packed], axis=1)
    assert len(packed) == 2 and {r["first"] for r in packed} == {0, 1}
    assert [(r["context"], r["first"], r["last"]) for r in found if r["kind"] == suffix_dedup.RUN] == [(3, 0, 40), (7, 0, 40)]
    assert len(set(windows[0])) == windows.shape[1] == n * 101 - 41 and (windows[2] < 0).sum() == 41


def test_sets_of_a_small_family_are_sent_once(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FAMILY", 4)
    lists = {10: [1, 2, 3], 11: [1, 2], 12: [2, 3], 13: [3, 4], 20: [7, 8], 30: [21, 22, 23], 31: [23, 24, 25]}
    members = spark.createDataFrame([(u, s) for u, own in lists.items() for s in own], "unit long, sid long")
    got = {}
    for r in near_copies.gathered(members).collect():
        got.setdefault(r.unit, []).append(r.sid)
    assert {u: sorted(s) for u, s in got.items()} == {1: [1, 2, 3, 4], 7: [7, 8], 30: [21, 22, 23], 31: [23, 24, 25]}
