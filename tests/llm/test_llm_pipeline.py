"""The pipeline's stages: columns, planted rows, and the contract of the list."""

import base64

import corpus_pipeline
from skarn.llm._shared import stored

SF = "/root/testdata/sf0.001"
SECRET = "token = abcdefghijklmnop"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "jaccard", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.where("lang = 'en' and n_chars > 500").orderBy("doc_id").first()
    planted = [
        (10_001, base["text"], "en", "s", 1), (10_002, base["text"] + " more", "en", "s", 1), (10_003, "%%% 123", "en", "s", 1),
        (10_004, f"the and of that {base64.b64encode(SECRET.encode()).decode()} with this", "en", "s", 1), (10_005, None, "en", "s", 1),
    ]
    docs = stored(docs.unionByName(spark.createDataFrame(planted, docs.schema)), "planted")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.dtypes == spark.read.parquet(f"{SF}/documents.parquet").dtypes
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {10_003, 10_005} & set(seen["language"]) and {10_001, 10_002} <= set(seen["language"])
    assert not {10_001, 10_002} & set(seen["jaccard"])
    assert seen["secrets"][10_004] == "the and of that [secret] with this"
    assert set(seen["secrets"]) == set(seen["jaccard"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(seen["secrets"])


def test_stages_take_columns_of_any_name_null_ids_repeats_and_empty_tables(spark, tmp_path):
    """Names that the stages use themselves, in any case, come through unchanged."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _SCORE int, _lang_pred string, score string"
    rows = [(k, f"the cat number {k} sat on the mat and saw dog {k * k} run home to its own bed at night {k}", "en", "s", 9, k, "q", "r") for k in range(30)]
    rows += [rows[3], (None, rows[4][1], None, None, None, None, None, None), (40, None, "en", "s", 0, 1, "q", "r"), (41, "", "en", "s", 0, 1, "q", "r")]
    spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, kinds)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns, name
            assert {r["_SCORE"] for r in out.collect()} <= {r["_SCORE"] for r in docs.collect()}, name
        assert (corpus_pipeline.packed(spark, frame, str(tmp_path)).count() > 0) == (frame is docs)
