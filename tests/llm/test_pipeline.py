"""The pipeline against a plain version of its stages on a small table."""

import hashlib
import random

import public_tokenizers as P
import pytest
from helpers import dedup_lines, docs_of, near_components

import corpus_pipeline
from rasterloom.llm import mixing


@pytest.fixture
def corpus(spark, tmp_path):
    r = random.Random(6)
    line = "a line that many documents share"
    rows = []
    for k in range(160):
        w = [f"word{r.randrange(900)}" for _ in range(r.randrange(30, 60))]
        rows.append((k, " ".join(w) + (f"\n{line}" if k % 3 == 0 else ""), f"s{k % 4}"))
    rows += [(200 + k, rows[k][1].replace("word1", "other1"), "s1") for k in range(20)]
    rows += [(300 + k, "### $$$ %%% " * 40, "s2") for k in range(40)]
    rows += [(400, None, None), (401, "", "s0"), (402, rows[1][1], "s3")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(160)] + [(300 + k, 0, 0) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_pipeline_agrees_with_plain_stages(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, path).collect()}
    assert not any(300 <= i < 340 for i in good) and all(i in good for i in range(160))
    left = [(i, t) for i, t, *_ in rows if i in good]
    source = {r[0]: r[2] for r in rows}
    lines = [(i, kept) for i, _, _, kept in dedup_lines(left)]
    first = {i for i, _, c in near_components(lines) if i == c}
    kept = [(i, t, source[i]) for i, t in lines if i in first]
    mixed = sorted((r["doc_id"], r["text"] or "") for r in mixing.mix(docs_of(spark, kept)).collect())

    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted((i, library.encode_ordinary(t)) for i, t in mixed)
    got = sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, path).collect())
    assert got == expected and len(got) > 100


def test_last_stage_decodes_each_copy(spark):
    rows = [(1, "hello wörld"), (1, "hello wörld"), (2, None), (3, ""), (None, "x \n" * 900)]
    got = corpus_pipeline.encoding(spark, docs_of(spark, rows), "").collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(str((r["doc_id"], r["decoded_sha256"])) for r in got) == sorted(str((i, sha(t))) for i, t in rows)


def test_stages_keep_the_columns(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near copies", "mixture", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns


def test_a_table_of_long_texts_keeps_its_good_ones(spark, tmp_path):
    from test_table_operators import long_texts

    good, bad = long_texts()
    docs_of(spark, [*good[:12], *bad[:12]]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k, _ in good] + [(k, 0, 0) for k, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert got and got <= {k for k, _ in good[:12]}


def test_null_ids_empty_tables_and_clashing_columns(spark, tmp_path):
    names = "row long, score long, kept long, size long, copies long, place long"
    docs = docs_of(spark, [(None, "plain words here " * 9), (None, None), (3, "other words stand there " * 9), (3, "other words stand there " * 9), (4, "### $$$ " * 30)], names)
    spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        at = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == docs.columns
        assert corpus_pipeline.encoding(spark, at, "").count() <= 2 * rows.count()
