"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import corpus_pipeline

from ambercol.llm import queries
from ambercol.llm.common import table, written

from .test_corpus import DATA, brute, check_packing, encoded, hits


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, items = docs.columns, [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], DATA), "test"))
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:5]]
    assert all(s.columns == columns for s in steps[:5])
    kept = {r.doc_id for r in queries.op6_quality_rules(spark, DATA).filter("kept").collect()}
    assert set(rows[1]) == kept and len(kept) < len(rows[0])
    assert set(rows[2]) == kept and all(len(r.text) == r.n_chars for r in rows[2].values() if r.text != rows[1][r.doc_id].text)
    groups = brute([(i, r.text) for i, r in rows[2].items()], 5)
    assert set(rows[3]) == {c for _, c in groups.values()}
    assert set(rows[4]) == {i for i, r in rows[3].items() if not hits(r.text, items)[1]}
    check_packing(steps[5].collect(), encoded([(i, r.text) for i, r in rows[4].items()]), 1024)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
