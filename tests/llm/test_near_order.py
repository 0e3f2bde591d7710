"""The sample that orders shingles does not change which near copies are found."""

from heronry.llm import near_copies


def test_sample_decides_no_result(spark, monkeypatch):
    rows = []
    for i in range(60):
        words = [f"w{(i * 7 + j * j) % 23}x{j % 5}" if j % 3 else "common" for j in range(60)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:-1], "end"])), (3 * i + 2, " ".join([*words[20:], f"tail{i}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    for sample in (0, 10_000):
        monkeypatch.setattr(near_copies, "SAMPLE", sample)
        kept.append(sorted(r["doc_id"] for r in near_copies.keep_one(docs).select("doc_id").collect()))
    assert kept[0] == kept[1] and 0 < len(kept[0]) < len(rows)
