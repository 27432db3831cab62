"""Suffix dedup, line dedup, n-gram join and BPE against plain versions, with the odd cases of each."""

import base64
from collections import Counter
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from helpers import dedup_lines, docs_of, near_components, remove_repeats
from pyspark.sql import functions as F

from rasterloom.llm import byte_bpe, components, line_dedup, ngram_join, suffix_dedup


def words(r, n, vocabulary=4000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# --- suffix dedup


def suffix_rows():
    r = random.Random(4)
    passage = " ".join(words(r, 150))
    other = "é" * 300
    rows = [(k, " ".join(words(r, r.randrange(5, 200)))) for k in range(12)]
    rows += [(20 + k, " ".join(words(r, 20)) + passage[k * 7 :] + " ".join(words(r, 9))) for k in range(5)]
    rows += [(30, passage), (31, passage), (32, None), (33, ""), (34, "x" * 399), (35, "ab" * 700), (36, other + "tail"), (37, other), (38, "short")]
    rows += [(40, passage[:500] + "!" + passage[501:]), (41, passage[:399])]
    return rows


def removed(spark, docs, **options):
    kept = suffix_dedup.remove_repeats(docs, **options)
    return [(r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in kept.collect()]


@pytest.mark.parametrize(("depth", "gram"), [(400, 128), (60, 24)])
def test_suffix_dedup_agrees_with_counting_windows(spark, depth, gram):
    rows = suffix_rows()
    expected = sorted((i, *x) for (i, _), x in zip(rows, remove_repeats(rows, depth), strict=True))
    assert sorted(removed(spark, docs_of(spark, rows), depth=depth, gram=gram)) == expected
    assert sum(x[2] for x in expected) > 0


def test_suffix_dedup_of_repeated_rows_null_ids_and_other_columns(spark):
    text = " ".join(words(random.Random(1), 120))
    rows = [(1, text), (1, text), (None, "lone " * 30 + text[5:]), (None, None)]
    docs = docs_of(spark, rows, "place int, ident int, d1 int, spans int, kept int")
    got = sorted(removed(spark, docs), key=lambda x: (x[0] is None, x[1]))
    expected = remove_repeats(rows, 400)
    assert [x[1:] for x in got[:2]] == [expected[0], expected[1]]
    assert sorted(x[1:] for x in got[2:]) == sorted(expected[2:])
    assert suffix_dedup.remove_repeats(docs).first()["row"]["d1"] == 1
    assert removed(spark, docs_of(spark, []).limit(0)) == []


def test_long_texts_are_hashed_in_parts(spark, monkeypatch):
    r = random.Random(9)
    long = " ".join(words(r, 120_000, 10**6))
    rows = [(1, long), (2, "start " + long[300_000:300_900] + " end")]
    got = {x[0]: x for x in removed(spark, docs_of(spark, rows))}
    assert (got[1][2], got[2][2]) == (900, 900) or got[1][2] == got[2][2] >= 900
    assert got[1][4].decode() == long[:300_000] + long[300_000 + got[1][2] :]


# --- line dedup


def line_rows():
    r = random.Random(2)
    pool = [" ".join(words(r, 4)) for _ in range(30)]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for k in range(25)]
    return [*rows, (30, None), (31, ""), (32, "\n\n"), (33, "  The Same Long Line\t\nshort"), (34, "the same long line\n\r the SAME long line \n"), (35, "ÉTÉ était là\nété était là"), (36, "été était là")]


def lines(docs, **options):
    k = line_dedup.dedup_lines(docs, **options)
    return sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in k.collect()), key=str)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 3), (4, 2), (7, 3)])
def test_line_dedup_agrees_with_a_dictionary(spark, batches, fanout):
    rows = line_rows()
    assert lines(docs_of(spark, rows), batches=batches, fanout=fanout) == sorted(dedup_lines(rows), key=str)


def test_line_dedup_odd_cases(spark):
    line = "a line of some length"
    rows = [(5, f"{line}\n{line}"), (5, f"{line}\nx"), (7, line), (None, line), (None, f"{line}!")]
    docs = docs_of(spark, rows, "pos int, drops int, lines int, h1 int")
    got = lines(docs)
    assert (5, 2, 0, f"{line}\n{line}") in got and (5, 2, 0, f"{line}\nx") in got
    assert (7, 1, 1, "") in got and (None, 1, 1, "") in got and (None, 1, 0, f"{line}!") in got
    kept = line_dedup.filter_lines(docs)
    assert kept.columns == docs.columns and kept.count() == 5
    assert lines(docs_of(spark, []).limit(0)) == []


def test_runs_are_levelled(spark, tmp_path):
    docs = docs_of(spark, [(k, f"line number {k} of many\nthe shared line of all") for k in range(12)])
    base = docs.select(F.col("doc_id").alias("place"), F.lit(0).cast("long").alias("ident"), "text")
    runs = line_dedup.LineRuns(spark, f"file://{tmp_path}/runs", fanout=2)
    for k in range(0, 12, 3):
        runs.add(line_dedup.hashed_lines(base.where(f"place >= {k} and place < {k + 3}")))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    stored = runs.runs()
    assert stored.count() == stored.select("h1", "h2").distinct().count() == 13


def test_batches_follow_the_ids(spark):
    docs = docs_of(spark, [(k if k < 12 else 10**12 + k, f"line number {k} of many\nthe shared line of all") for k in range(16)] + [(5, "x" * 200_000 + "\n" + "one more line\n" * 20_000)])
    base = docs.select(F.col("doc_id").alias("place"))
    assert len(set(line_dedup.cuts(base, 4))) == 3 and max(line_dedup.cuts(base, 4)) <= 12
    got = {(r["row"]["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert (0, 0) in got and (10**12 + 15, 1) in got and (5, 1) in got and (5, 0) in got


# --- n-gram join


def near_rows(seed, groups=6, copies=6):
    r = random.Random(seed)
    rows, k = [], 0
    for _ in range(groups):
        base = words(r, r.choice((3, 5, 8, 40, 120)))
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                w[r.randrange(len(w))] = f"edit{r.randrange(99)}"
            rows.append((k, " ".join(w)))
            k += 1
    return rows


def classes(docs):
    found = ngram_join.near_duplicates(docs)
    return sorted((r["row"]["doc_id"], r["n_shingles"], r["first"]["place"]) for r in found.collect())


@pytest.mark.parametrize("seed", range(2))
def test_join_agrees_with_all_pairs(spark, seed):
    rows = near_rows(seed) + [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (104, "ONE"), (105, "a b c d"), (106, "a b c d e"), (107, "a  b\tc\nd")]
    assert classes(docs_of(spark, rows)) == near_components(rows)


def test_long_lists_become_families(spark, monkeypatch):
    """Lists over a few members become families, cut into blocks; they must find the same links."""
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 5)
    r = random.Random(7)
    base = words(r, 60)
    rows = []
    for k in range(40):
        w = list(base)
        for _ in range(r.choice((1, 2, 3, 4, 6))):
            w[r.randrange(60)] = f"edit{r.randrange(30)}"
        rows.append((k, " ".join(w)))
    lists = ngram_join._map_lists

    def few(batches):
        ngram_join.SHORT = 4
        return lists(batches)

    monkeypatch.setattr(ngram_join, "_map_lists", few)
    assert classes(docs_of(spark, rows)) == near_components(rows)


def test_differences_from_a_hub_give_the_overlaps():
    r = np.random.default_rng(3)
    hub = np.arange(100)
    sets = [np.unique(np.concatenate([r.choice(hub, 80, replace=False), r.integers(200, 230, 12)])) for _ in range(9)]
    members = [{"common": len(np.intersect1d(hub, s)), "na": 100, "lacks": np.setdiff1d(hub, s), "adds": np.setdiff1d(s, hub)} for s in sets]
    assert ngram_join._overlaps(members[:4], members).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:4]]


def test_all_occurrences_are_counted(monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 300)
    r = random.Random(3)
    texts = [" ".join(words(r, 30, 40)) + " one two three four five" * (k % 3 == 0) for k in range(200)]
    true = Counter(int(x) for _, sets in ngram_join.sets_of(ngram_join.Rolling(), pa.array(texts)) for s in sets for x in s.view(np.int64))
    got = Counter()
    for at in (0, 90):
        batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 10])], names=["text"]) for k in range(at, at + 90 + 20 * (at > 0), 10)]
        for out in ngram_join._map_counts(iter(batches)):
            got.update({x["token"]: x["count"] for x in out.to_pylist()})
    assert got == true


def test_common_shingles_come_last_however_many(spark, monkeypatch):
    """Shingles of twenty documents are no prefix of documents with enough of their own, so no list grows with them."""
    r = random.Random(5)
    common = " ".join(words(r, 20))
    rows = [(k, f"{common} " + " ".join(f"own{k}x{j}" for j in range(60))) for k in range(20)]
    base = docs_of(spark, rows).select(F.col("doc_id").alias("place"), F.xxhash64("text").alias("ident"), "text")
    assert ngram_join.Join(base).lists().count() == 0
    monkeypatch.setattr(ngram_join, "MOST_SLOTS", 1024)
    monkeypatch.setattr(ngram_join, "SLOT_ROW", 256)
    ranks = ngram_join.Join(base).ranks()
    tokens = np.concatenate([s for _, sets in ngram_join.sets_of(ngram_join.Rolling(), pa.array([t for _, t in rows])) for s in sets])
    counts = np.bincount(ngram_join._slot(tokens, 1024), minlength=1024)
    assert ngram_join.slots_for(len(tokens)) == 1024 and ranks.tolist() == np.minimum(counts, 128).tolist()


def test_whole_rows_are_sent_once(spark):
    """Rows are dealt by place and ident for their component, and not again to keep one of each."""
    rows = near_rows(1) + [(300, "one two three four five six")] * 2 + [(200, ""), (200, "")]
    kept = ngram_join.keep_first(docs_of(spark, rows))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert sent and not [x for x in sent if "root" in x]
    found = near_components(rows)
    assert len([x for x in kept.collect() if x["text"]]) == len({c for _, n, c in found if n}) and kept.where("text = ''").count() == 2


def test_far_members_are_linked_with_near_ones():
    hub, near = set(range(100)), set(range(14, 106))
    far = set(range(26, 110))
    assert 4 * len(hub & near) >= 3 * len(hub | near) and 4 * len(hub & far) < 3 * len(hub | far) and 4 * len(near & far) >= 3 * len(near | far)
    row = lambda node, s, streams, at=0: (1, at, streams, node, len(s), len(hub & s), 100, s is near, sorted(hub - s), sorted(s - hub))
    rows = [row(8, near, False), row(9, far, False), row(9, far, True), row(8, near, False, 1), row(9, far, True, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=list(ngram_join.MEMBER))
    for size in (1, 2, 5):
        got = [r for out in ngram_join._map_family(iter([batch.slice(k, size) for k in range(0, 5, size)])) for r in out.to_pylist()]
        assert got == [{"a": 9, "b": 8}] * 2


def test_join_odd_cases(spark):
    text = "one two three four five six seven"
    rows = [(4, text), (4, text), (9, text.upper()), (None, text), (None, "something else altogether, quite different")]
    docs = docs_of(spark, rows, "node int, n int, first int, row int, list int")
    got = {(r["row"]["doc_id"], r["first"]["place"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {(4, 4), (9, 4), (None, 4), (None, 2**63 - 1)}
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "None"]
    assert classes(docs_of(spark, []).limit(0)) == []


def test_survivors_are_chosen_by_component_not_by_id(spark):
    r = random.Random(12)
    other = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(40))
    nameless, shared = [(None, other()) for _ in range(20)], [(7, other()) for _ in range(20)]
    for rows in (nameless, shared, nameless + shared):
        kept = [(x["doc_id"], x["text"]) for x in ngram_join.keep_first(docs_of(spark, rows)).collect()]
        assert sorted(map(str, kept)) == sorted(map(str, rows))
    text = other()
    rows = [(9, text), (3, text), (3, text), (3, text + " more"), (None, text), (None, ""), (None, ""), (None, None), (7, None)]
    kept = sorted(str((x["doc_id"], x["text"])) for x in ngram_join.keep_first(docs_of(spark, rows)).collect())
    assert len(kept) == 5 and sum("w" in k or "more" in k for k in kept) == 1 and any(k.startswith("(3,") for k in kept)
    long = [(1, other() + " " + "x y z " * 60_000), (2, other()), (1, other() + " " + "x y z " * 60_000)]
    assert ngram_join.keep_first(docs_of(spark, long)).count() == 3


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(-5, -4), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 120)) and got[-4] == -5


# --- BPE


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as P

    data = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return byte_bpe.Bpe(data, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_agrees_with_the_library(coder):
    bpe, library = coder
    r = random.Random(1)
    texts = ["", " ", "  a  b\n\n c ", " lead", "trail ", "a\n \nb", "x\n ", "    é", "a" * 5000, "ab" * 1000 + " " * 500 + "z", "don't we'll I'm", "1234 5678..!!\r\n\t x", "\U0001f600 ok \x1c y", "a \x85b", "<|endoftext|>", "żółć 漢字 नमस्ते"]
    texts += ["".join(r.choice("ab \n\té'1.\u3000") for _ in range(50)) for _ in range(2000)]
    for t in texts:
        ids = library.encode_ordinary(t)
        assert bpe.encode(t) == ids
        assert bpe.decode(ids) == t.encode() == bpe.unspell(bpe.spell(t))
    assert not any(bpe.low)


def test_other_patterns_are_cut_by_themselves(coder):
    import public_tokenizers as P

    pattern = r"\p{L}{1,3}|\s?[^\s\p{L}]+|\s+"
    data = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=coder[1]._mergeable_ranks, special_tokens={})
    bpe = byte_bpe.Bpe(data, pattern)
    for t in ("hello wonderful world 12", "  a  b\n\n c, don't 12.5 ", ""):
        assert bpe.encode(t) == library.encode_ordinary(t)


def test_full_memories_are_emptied(coder, monkeypatch):
    bpe, library = coder
    monkeypatch.setattr(byte_bpe, "MEMORY_WORDS", 5)
    r = random.Random(2)
    for _ in range(50):
        t = " ".join(words(r, 30, 20))
        assert bpe.encode(t) == library.encode_ordinary(t)


def test_encode_and_decode_frames(spark, coder):
    rows = [(1, "hello wörld"), (1, "hello wörld"), (2, None), (3, ""), (None, "x" * 20_000)]
    docs = docs_of(spark, rows, "ids int, tokens int")
    got = byte_bpe.encode(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    back = byte_bpe.decode(got).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in rows)
    d = byte_bpe.digests(docs).where("doc_id = 1").collect()
    assert len(d) == 2 and d[0]["n_tokens"] == len(coder[1].encode_ordinary("hello wörld"))
    assert byte_bpe.encode(docs_of(spark, []).limit(0)).count() == 0


def test_merges_equal_plain_ones(coder):
    bpe, _ = coder
    rng = random.Random(8)
    pieces = [bytes(rng.choice(b" abehlnorst\xc3\xb1") for _ in range(rng.choice([1, 2, 7, 12, 297, 298, 299, 300, 600]))) for _ in range(150)]

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            ranked = [(bpe.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in bpe.ranks]
            if not ranked:
                return [bpe.ranks[p] for p in parts]
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    assert [bpe.merge(p) for p in pieces] == [plain(p) for p in pieces]
    assert not any(bpe.low)
