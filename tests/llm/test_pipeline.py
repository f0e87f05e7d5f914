"""The pipeline on the small table: each stage's decision takes effect, and clean documents stay."""

from __future__ import annotations

import re

import corpus_pipeline
from test_tokens_and_packing import check_packing

from redactstream.llm.queries import QUERIES, table
from redactstream.llm.store import keep
from redactstream.llm.subwords import Subwords, default_tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_over_documents(spark):
    docs = table(spark, SF, "documents")
    columns, ids, states = docs.columns, [], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = keep(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        ids.append((name, before - {r.doc_id for r in docs.collect()}))
        states[name] = docs
    gone = dict(ids)
    flagged = {r.doc_id for r in QUERIES["op8_toxicity"](spark, SF).where("toxic").collect()}
    assert gone["toxicity"] == flagged
    texts = [" ".join(r.text.lower().split()) for r in states["near_dedup"].collect() if r.text]
    assert len(texts) == len(set(texts)) and gone["near_dedup"]
    leaks = {r.doc_id for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    assert gone["decontamination"] <= leaks and not leaks & {r.doc_id for r in docs.collect()}
    assert gone["secret_scans"] == set()
    assert not any(re.search("[0-9a-f]{32}", r.text or "") for r in docs.collect())
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, Subwords(default_tokenizer()), {r.doc_id: r.text for r in docs.collect()})
