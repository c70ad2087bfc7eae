"""The pipeline's stages on a small table: what goes, what stays, and that each stage takes the one before."""

import random

import corpus_pipeline
from eventloom.llm.queries import ORACLE_SQL, QUERIES

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    kinds = {"en": "the and of ing er on".split(), "de": "der und ein sch keit ü".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(lang, 60), lang, f"s{i % 2}", 1) for i in range(40) for lang in ["en" if i % 3 else "de"]]
    item = make("en", 30)
    rows += [(40, rows[1][1], "en", "s0", 1), (41, rows[2][1] + " more", "en", "s1", 1), (42, make("en", 20) + " " + item, "en", "s0", 1), (43, None, "en", "s0", 1), (44, "123", None, None, None), (45, "", "de", "s1", 1)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept[0] == list(range(43))
    assert kept[1] == [*range(40), 42]
    assert kept[2] == list(range(40))
    assert set(kept[3]) <= set(kept[2]) and max(map(kept[3].count, kept[3])) <= 2
    assert kept[4] == kept[3]
    assert sorted(r["start"] for r in docs.collect())[0] == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert set(ORACLE_SQL) <= set(QUERIES)
