"""The stages by the operators' own verdicts, and what goes in and out of them."""

import corpus_pipeline
from tablestate.llm import decontaminate, kneser_ney, packing, quality_rules, simhash
from tablestate.llm.common import table
from tablestate.llm.queries import oracle_sql, queries


def test_stages(spark, sf_dir):
    docs, labels, bench = (table(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    columns = docs.columns
    verdicts = {
        "quality_classifier": lambda d: [r.doc_id for r in kneser_ney.classified(d, labels).where("kept").collect()],
        "quality_rules": lambda d: [r.doc_id for r in quality_rules.quality_rules(d, labels).where("kept").collect()],
        "simhash_near_dedup": lambda d: {r.component_id for r in simhash.near_duplicates(d).collect()},
        "benchmark_decontamination": lambda d: [r.doc_id for r in decontaminate.contamination(d, bench).where("n_hit = 0").collect()],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        want = sorted(verdicts[name](docs))
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert sorted(r.doc_id for r in docs.collect()) == want
        assert 0 < docs.count() <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert sorted(map(repr, packed.drop("sequence_id", "offset").collect())) == sorted(map(repr, packing.packed_documents(docs).drop("sequence_id", "offset").collect()))
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(repr, whole.drop("sequence_id", "offset").collect())) == sorted(map(repr, packed.drop("sequence_id", "offset").collect()))


def test_registered():
    assert sorted(k.split("_")[0] for k in queries()) == sorted(f"op{n}" for n in range(1, 14))
    assert set(oracle_sql()) <= set(queries())
