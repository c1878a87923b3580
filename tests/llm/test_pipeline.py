"""The pipeline on a small corpus with planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from specloom.llm import common

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    rows = [(i, text(120)) for i in range(20)]
    rows += [(20, rows[3][1]), (21, text(60) + " " + passage + " " + text(60)), (22, text(70) + " " + passage + " " + text(50)), (23, text(60) + " password=b7db7aa4a5fcc78305 " + text(60)), (24, "too short"), (25, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = common.table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.cut(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns
        seen.append({x.doc_id: x for x in now.collect()})
    quality, near, repeats, clean = seen
    assert set(quality) == set(range(24))
    assert set(near) == set(quality) - {20}
    before = dict(rows)
    assert repeats[21].text == before[21] and passage not in repeats[22].text
    assert repeats[22].text == before[22].replace(passage + " ", "") and repeats[22].n_chars == len(repeats[22].text)
    assert "[SECRET]" in clean[23].text and "b7db7aa4" not in clean[23].text
    assert all(clean[i].text == before[i] for i in range(20))
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {p.doc_id for p in packed} == set(clean)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(packed)
