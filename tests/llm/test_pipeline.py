"""The pipeline's stages on a small fixture, against the operators' own brute force."""

from collections import Counter

import corpus_pipeline as P
from bankspark.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA


def test_stages_in_order_and_their_columns(spark, documents, odd, tmp_path):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    spark.createDataFrame([(4, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    passage = (70, "before W1 w2, w3 w4 w5 w6 w7 w8 after")
    for rows in ([], [*odd, passage, (71, "clean text of a few words"), (72, "clean text of a few words")]):
        docs = documents(rows)
        for k, (name, stage) in enumerate(P.STAGES):
            path = f"{tmp_path}/{len(rows)}-{name}"
            result = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert result.columns == docs.columns
            result.write.parquet(path)
            docs = spark.read.schema(result.schema).parquet(path)
            if rows and name == "toxicity":
                assert docs.count() == len(rows)
            if rows and name == "near_dedup":
                assert sorted(r.doc_id for r in docs.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 6, 9, 70, 71]
            if rows and name == "decontamination":
                assert docs.filter("doc_id = 70").count() == 0 and docs.count() == 10
            if rows and name == "mixing":
                assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 3
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and (docs.count() == 0) == (not rows)


def test_run_over_documents(spark):
    rows = P.run(spark, DATA).orderBy("start").collect()
    assert rows and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids) and max(Counter(ids).values()) <= 2


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is P.run and set(ORACLES) <= set(QUERIES)
    assert all(n in entry.oracle_sql() for n in ORACLES)
