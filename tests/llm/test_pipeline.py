"""The pipeline's stages against brute-force versions."""

import corpus_pipeline
from test_search import held  # noqa: F401  the brute-force search

from thermolith.llm import pieces, quality, simhash
from thermolith.llm.shared import table


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    first = corpus_pipeline.quality_stage(spark, docs, folder).cache()
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, table(spark, folder, "labels")).collect()}
    assert {r["doc_id"] for r in first.collect()} == {i for i, s in scores.items() if s >= 0.5} and first.columns == docs.columns
    second = corpus_pipeline.near_copy_stage(spark, first, folder).cache()
    rows = sorted(first.collect(), key=lambda r: r["doc_id"])
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in rows}
    group = {r["doc_id"]: r["doc_id"] for r in rows}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(rows):
            for b in rows[:i]:
                x, y = sets[a["doc_id"]], sets[b["doc_id"]]
                low = min(group[a["doc_id"]], group[b["doc_id"]])
                if group[a["doc_id"]] != group[b["doc_id"]] and (a["text"] == b["text"] or len(x & y) >= 0.8 * len(x | y) > 0):
                    group[a["doc_id"]] = group[b["doc_id"]] = low
                    changed = True
    assert {r["doc_id"] for r in second.collect()} == {i for i, g in group.items() if i == g} and second.columns == docs.columns
    third = corpus_pipeline.decontamination_stage(spark, second, folder)
    items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
    assert {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in second.collect() if not held(r["text"], items)} and third.columns == docs.columns
    model = pieces.Model(pieces.read_model())
    last = corpus_pipeline.encoding_stage(spark, third, folder).collect()
    assert all(model.decode(r["ids"]) == r["text"] for r in last)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in whole} == {r["doc_id"] for r in last}


def test_stages_take_odd_and_empty_tables(spark, folder, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            rows = out.collect()
            ids = [r["doc_id"] for r in rows]
            assert len(rows) <= docs.count() and {r["text"] for r in rows} <= {r["text"] for r in docs.collect()}, name
            if name == "simhash near-dedup" and rows:  # null, empty and blank texts are two groups at most; copies of one text are one
                assert None in ids and {4, 6, 9, 10} <= set(ids) and not {2, 5, 7} & set(ids)
            if name == "benchmark decontamination":
                assert len(rows) == docs.count()  # none of the odd rows holds an item
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
