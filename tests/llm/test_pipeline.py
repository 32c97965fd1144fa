from collections import Counter

import corpus_pipeline
from framewright.llm import decontaminate, mixing, neardup, quality


def test_stages_keep_what_they_should(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, ids = docs.columns, {}
    want = [
        lambda d: {r.doc_id for r in quality.classify(d, labels).collect() if r.predicted},
        lambda d: {r.component_id for r in neardup.components(d).collect()},
        lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in decontaminate.find_leaks(d, bench).collect()},
        lambda d: {r.doc_id for r in mixing.mix_documents(d).collect() if r.taken},
    ]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns
            assert {r.doc_id for r in out.collect()} == want[k](docs), name
        else:
            assert out.count() == docs.count() and out.agg({"shard": "max"}).first()[0] <= 39
        ids[name] = out.count()
        docs = out
    assert corpus_pipeline.run(spark, small).count() == ids["sharding"]


def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark, docs, none, small):
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        rows = out.collect()
        assert stage(spark, none, small).count() == 0
        if k < 4:
            assert out.columns == docs.columns and {r["size"] for r in rows} <= {"big"} and {r["block"] for r in rows} <= {2}, name
        if name == "near_duplicates":
            assert Counter(r.doc_id for r in rows)[10] == 1 and {r.doc_id for r in rows} >= {None, 3, 4}
        if name == "decontamination":
            assert len(rows) == docs.count()
        if name == "mixing":
            known = {(r.doc_id, r.text) for r in docs.collect()}
            assert sum((r.doc_id, r.text) not in known for r in rows) <= len({r.source for r in docs.collect()})
        if name == "sharding":
            assert len(rows) == docs.count() and len({r.shard for r in rows if r.doc_id == 10}) == 1
    clean = docs.withColumnsRenamed({"node": "mix_row", "key": "target"}).select(*base, "mix_row", "target")
    assert corpus_pipeline.mix(spark, clean, small).columns == clean.columns
