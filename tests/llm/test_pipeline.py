import os
import tempfile

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from versewright.llm import bpe, common, decontaminate, lines, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, odd):
    """A small corpus with odd rows and planted copies, leaks and shared passages."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 10_000)
    copies = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 5000)
    docs.unionByName(copies).unionByName(extra).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(os.path.join(folder, "benchmark.parquet"))
    return folder


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def rows(df):
    return sorted(map(str, map(tuple, df.select(*COLUMNS).collect())))


def test_all_but_the_last_return_documents(stages):
    for before, after in zip(stages, stages[1:-1]):
        assert after.dtypes == before.dtypes
        assert 0 < after.count() <= before.count()


def test_language_stage_keeps_clean_documents(stages):
    known, kept = stages[0], set(rows(stages[1]))
    own = known.where("doc_id < 10000")
    assert set(rows(own)) <= kept
    assert not any(r.text is None or not any(c.isalpha() for c in r.text) for r in stages[1].collect())


def test_line_stage(stages):
    before = {}
    for r in sorted(stages[1].collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        before.setdefault(r.doc_id, set()).update(r.text.split("\n"))
    seen = set()
    after = {r.doc_id: r.text for r in stages[2].collect()}
    for i in sorted(before, key=lambda i: (i is None, i or 0)):
        assert not any(len(x.split()) >= lines.LEAST_WORDS and x in seen for x in after[i].split("\n"))
        seen |= before[i]
    assert all(after[i] == "" or len(after[i].split()) < 200 for i in after if i is not None and 5000 <= i < 5020)
    assert stages[2].where("n_chars <> length(text)").count() == 0


def test_near_duplicate_stage(stages):
    found = [(r.doc_id, simhash.fingerprint(r.text.encode())) for r in stages[2].collect()]
    kept = {r.doc_id for r in stages[3].collect()}
    for i, f in found:
        group = [j for j, g in found if (f ^ g).bit_count() <= 3]
        if len(group) == 1:
            assert i in kept
    assert sum(simhash.fingerprint(r.text.encode()) == 0 for r in stages[3].collect()) <= 1


def test_decontamination_stage(spark, sf_dir, stages):
    items = [" ".join(decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = lambda text: any(f" {x} " in f" {' '.join(decontaminate.words_of(text))} " for x in items)
    before, after = stages[3].collect(), set(rows(stages[4]))
    assert sum(holds(r.text) for r in before) > 0
    assert {str(tuple(r)) for r in before if not holds(r.text)} == after


def test_token_stage(stages):
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY)) as f:
        ranks = {t: i for i, t in enumerate(bpe.read_ranks(f.read().splitlines()))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    found = stages[5].collect()
    assert len(found) == stages[4].count()
    for r in found:
        if r.doc_id is not None and r.doc_id < 10_000:
            assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_run_is_all_stages(spark, sf_dir, stages):
    assert sorted(map(str, map(tuple, corpus_pipeline.run(spark, sf_dir).drop("ids").collect()))) == sorted(map(str, map(tuple, stages[5].drop("ids").collect())))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
