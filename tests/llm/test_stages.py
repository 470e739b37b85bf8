"""The pipeline's stages on planted cases."""

import random

import corpus_pipeline
from tessera.llm import decontaminate, neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(10_000)) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_decontamination_by_one_item(spark, tmp_path):
    rng = random.Random(4)
    items = [words(rng, 20), words(rng, 30), "only five words in here"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    part = items[1].split()
    clean = [words(rng, 60), None, "", " ".join(part[:7]), words(rng, 9) + " " + " ".join(part[3:10]) + " " + words(rng, 9), "only five words in there"]
    planted = [words(rng, 20) + " " + items[0] + " " + words(rng, 20), items[1].upper(), words(rng, 5) + " " + " ".join(part[11:19]), "so " + items[2], items[0] + " " + items[1]]
    docs = frame(spark, clean + planted)
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(len(clean)))
    flags = decontaminate.contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).where("contaminated").collect()
    assert [r.doc_id for r in flags] == [len(clean) + 4]  # op10's column keeps its limit of two items


def test_one_row_of_each_class(spark):
    rng = random.Random(6)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    near = " ".join([*a.split()[:-1], "edit"])
    rows = [(3, a), (3, a), (3, b), (None, near), (None, c), (None, c), (7, a), (9, d), (9, d), (None, None), (None, None), (10, ""), (11, ""), (11, ""), (12, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], SCHEMA)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, a), (3, b), (None, c), (9, d), (None, None), (10, ""), (11, ""), (12, None)], key=str)
