"""The pipeline against a plain version of its stages."""

import hashlib
from pathlib import Path

import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import brute_components, tokenizer  # noqa: E402
from tidemark.llm import decontam, pii, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the supplied tables")


def test_run_equals_the_plain_stages(spark):
    from tidemark.llm.common import documents

    docs = documents(spark, DATA)
    labels, bench = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).filter("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    kept = {c for _, c in brute_components(rows, *corpus_pipeline.NEAR).values()}
    items = [decontam.shingles(decontam.words_of(r.text.encode())) for r in bench.collect()]
    clean = []
    for i, t in rows:
        w = decontam.words_of(t.encode())
        own = decontam.shingles(w)
        if i in kept and not any((decontam.held(x, own, w) or 0) >= decontam.OVERLAP for x in items):
            clean.append((i, t))
    spans = {r.doc_id: r.spans for r in pii.personal_spans(spark.createDataFrame(clean, "doc_id long, text string")).collect()}
    library, _ = tokenizer()
    want = []
    for i, t in clean:
        out, at = "", 0
        for s in spans[i]:
            if s.start >= at:
                out += t[at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.end)
        ids = library.encode(out + t[at:], add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark):
    from tidemark.llm.common import documents

    docs = documents(spark, DATA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == list(corpus_pipeline.COLUMNS)


def test_a_worker_keeps_the_tables_of_one_operator(spark):
    """Workers go from stage to stage: what encoding and near_duplicates keep between tasks added up there."""
    from tidemark.llm import bpe, ngram_join
    from tidemark.llm.common import documents, tidy
    from tidemark.llm.queries import vocabulary_path

    path = vocabulary_path()

    def held(batches):
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch([pa.array([bpe.encoder_of.cache_info().currsize] * n), pa.array([len(ngram_join._hashes)] * n)], ["encoders", "hashes"])

    def fill(batches):
        bpe.encoder_of(path)
        ngram_join.word_hashes(b"one two three")
        yield from held(batches)

    def seen(run, module):
        run.__module__ = module
        rows = spark.range(0, 8, 1, 4).mapInArrow(tidy(run), "encoders long, hashes long").collect()
        return {tuple(r) for r in rows}

    assert seen(fill, bpe.__name__) == {(1, 3)}
    assert all(encoders == 0 for encoders, _ in seen(held, ngram_join.__name__))
    seen(fill, bpe.__name__)
    assert seen(held, "another") == {(0, 0)}
    docs = documents(spark, DATA).limit(50)
    bpe.bpe_digests(docs, path).collect()
    assert seen(held, decontam.__name__) == {(0, 0)}
