"""What is shuffled grows with the input and no faster."""

import numpy as np

from heronry.llm import simhash, suffix_dedup


def test_contexts_of_unique_grams_are_not_gathered(spark, monkeypatch):
    stored = {}

    def kept(df, name, put=suffix_dedup.materialize):
        stored[name] = put(df, name)
        stored[name, "rows"] = stored[name].count()
        return stored[name]

    monkeypatch.setattr(suffix_dedup, "materialize", kept)
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(60)]
    texts[40] = " ".join([*texts[40].split()[:80], *texts[3].split()[40:120]])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = {r.doc_id: len(r.text.split()) for r in suffix_dedup.remove_passages(docs).collect()}
    assert {d for d, n in cut.items() if n < (160 if d == 40 else 200)} == {3, 40}
    assert stored["sa-anchors", "rows"] > 300 and stored["sa-contexts", "rows"] < 0.2 * stored["sa-anchors", "rows"]


def test_prefixes_of_a_fingerprint_do_not_grow_with_the_table(spark, monkeypatch):
    sent = []

    def ways(bits, flips, made=simhash.masks):
        found = made(bits, flips)
        sent.append(len(found))
        return found

    rng = np.random.default_rng(3)
    fps = rng.integers(-(1 << 63), 1 << 63, 300, np.int64)
    fps[150:200] = fps[:50] ^ (np.int64(1) << rng.integers(0, 62, 50)) ^ (np.int64(1) << rng.integers(0, 62, 50))
    frame = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    roots = []
    for count in (40_000, 4_000_000):
        with monkeypatch.context() as m:
            m.setattr(simhash, "masks", ways)
            linked = simhash.links(frame, count, 4)
        roots.append(sorted(map(tuple, simhash.components(linked).collect())))
    assert sent[0] == sent[1]
    assert roots[0] == roots[1] and len(roots[0]) == (fps[150:200] != fps[:50]).sum() > 40
