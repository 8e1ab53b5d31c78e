"""The pipeline's stages against their operators, and the entry points."""

import corpus_pipeline
from tidelog.llm import langid, quality
from tidelog.llm.common import read


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    one = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    two = corpus_pipeline.STAGES[1][1](spark, one, sf)
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in langid.identify(one).where("not rejected").collect()}


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_near_dedup", "mixing", "byte_bpe"]


def test_run_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, columns that clash: clean documents come out, nothing else does."""
    rng = __import__("random").Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    clean = [(1000 + k, " ".join(rng.choices(words, k=rng.randint(60, 300))), "en", "a", 1, 1, "s", "f", "b") for k in range(200)]
    docs = odd.union(spark.createDataFrame(clean + clean[:5], odd.schema))
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}/odd").collect()]
    assert 150 < len(got) and {k for k in got if k is not None} <= {r[0] for r in clean}
    empty.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").count() == 0
