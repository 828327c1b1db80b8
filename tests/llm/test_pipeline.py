import corpus_pipeline
from fixtures_llm import SF, documents
from test_linedup import brute
from test_neardup import classes
from test_packing import check
from test_quality import verdict

from geoloom.session import cut_lineage


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    docs = cut_lineage(stages["quality_rules"](spark, docs, SF))
    want = [(k, verdict(t)[1]) for k, t in rows if verdict(t)[0]]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(rows) == sorted(want) and docs.columns == columns

    docs = cut_lineage(stages["line_dedup"](spark, docs, SF))
    gone = brute(rows, 50)
    want = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k, t])) for k, t in rows]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(rows) == sorted(x for x in want if x[1].strip()) and docs.columns == columns

    docs = cut_lineage(stages["near_dedup"](spark, docs, SF))
    want = classes(rows)
    rows = [x for x in rows if want[x[0]] == x[0]]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows) and docs.columns == columns

    packed = stages["best_fit_packing"](spark, docs, SF).collect()
    check(packed, rows, 2048)
    whole = corpus_pipeline.run(spark, SF).collect()
    fixed = lambda x: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in x)
    assert fixed(whole) == fixed(packed)


def test_stages_take_an_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
