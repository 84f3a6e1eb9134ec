"""The pipeline against a plain run of its five stages."""

from __future__ import annotations

import brute

import corpus_pipeline
from sparkgrove.llm import toxicity
from sparkgrove.llm.common import table


def test_pipeline(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels)
    automaton = lexicon.automaton()
    kept = [r for r in sorted(docs.collect(), key=lambda r: r.doc_id) if lexicon.score(toxicity.folded(r.text), automaton) < toxicity.THRESHOLD]
    parts = brute.groups([brute.fingerprint(r.text) for r in kept])
    kept = [r for i, r in enumerate(kept) if parts[i] == i]
    known = brute.windows([tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()])
    kept = [r for r in kept if not brute.decontam_row(r.text, known)[4]]
    texts = {r.doc_id: r.text for r in kept}
    sizes = {r.doc_id: len((r.text or "").split()) for r in kept}
    queue = brute.mix_queue([(r.doc_id, r.source, sizes[r.doc_id]) for r in kept])
    taken, finish = {}, {}
    for at, source, doc_id, e, words in queue:
        taken[doc_id, e] = taken.get((doc_id, e), 0) + words
        finish[doc_id, e] = (at, source, doc_id)
    mixed = sorted((finish[x], x[0]) for x in taken if 2 * taken[x] > sizes[x[0]])
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == brute.token_rows([(doc_id, texts[doc_id]) for _, doc_id in mixed], by_id=False)
    assert len(mixed) > 50


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
