"""Exact dedup, phrases and the Merkle manifest against plain versions, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, LOWER, docs_of

from rasterloom.llm import bloom, exact_dedup, merkle, phrases

ODD = [
    (1, "One  two three", "a"),
    (2, "One two\tthree", "a"),
    (3, "Onetwothree", None),
    (4, "", "b"),
    (5, None, "b"),
    (6, " \n\t", "a"),
    (7, "One two, three; ONE two three. one two three", "a"),
    (7, "One two, three; ONE two three. one two three", "a"),
    (None, "One two three", "a"),
    (None, None, None),
    (8, "déjà vu déjà vu déjà vu", "c", None),
    (9, "x " * 5000 + "END", "c", "und"),
    (10, "same same. same same! same", "c", "und"),
    (11, "same same. same same! same", "d", "de"),
]


def dedup_plain(rows):
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(k)
    out = []
    for text, of in groups.items():
        best = min(of, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0, k))
        out += [(rows[k][0], rows[best][0], len(of), hashlib.sha256(text.encode()).hexdigest()) for k in of]
    return sorted(out, key=str)


def deduped(found):
    rows = found.selectExpr("id", "keep_id", "group_size", "lower(hex(sha)) as sha", "kept").collect()
    return rows, sorted([tuple(r)[:4] for r in rows], key=str)


@pytest.mark.parametrize("bits", [2**33, 2**10])
def test_equal_texts_meet_whatever_the_filter_holds(spark, bits):
    rows, got = deduped(exact_dedup.report(docs_of(spark, [*ODD, *_texts(5)]), most_bits=bits))
    assert got == dedup_plain([*ODD, *_texts(5)])
    kept = Counter(r["sha"] for r in rows if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["sha"] for r in rows}
    assert all(r["id"] == r["keep_id"] for r in rows if r["kept"])


def _texts(seed):
    rng = random.Random(seed)
    return [(100 + k, " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))) for k in range(400)] + [(1000 + k, "hot copy") for k in range(300)] + [(2000 + k, f"text {k} alone") for k in range(300)]


def test_rows_that_stay_keep_their_columns(spark):
    docs = docs_of(spark, ODD, "row long, sha long, maybe long, _chunk long")
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(7, ODD[6][1]), (1, ODD[0][1]), (6, ODD[5][1]), (8, ODD[10][1]), (9, ODD[11][1]), (10, ODD[12][1])])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.report(none).count() == 0
    assert exact_dedup.keep_one(none).count() == 0
    assert phrases.collocations(none).count() == 0
    assert merkle.manifest(none).proofs().count() == 0


def test_filter_in_numpy_and_in_spark_agree(spark):
    values = np.random.default_rng(1).integers(-(2**63), 2**63, 500, dtype=np.int64)
    words = bloom.words_for(500, 2**20)
    table = bloom.table(spark.createDataFrame([(int(v),) for v in values], "h long"), words)
    bits = bloom.array(table)
    assert len(bits) == words and bloom.np_has(bits, values).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63, 3000, dtype=np.int64)
    got = bloom.probed(spark.createDataFrame([(int(v),) for v in [*values, *others]], "h long"), table, words).collect()
    assert {r["h"]: r["maybe"] for r in got} == dict(zip([int(v) for v in [*values, *others]], [bool(x) for x in bloom.np_has(bits, np.concatenate([values, others]))], strict=True))
    assert bloom.np_has(bits, others).mean() < 0.02


def phrases_plain(rows, min_count, share=50):
    f, n = Counter(), Counter()
    for r in rows:
        lang = r[3] if len(r) > 3 else "en"
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        if a < min_count or len(p) < 2:
            continue
        if len(p) == 2 and any(q == lang and len(t) == 3 and c >= min_count and p in (t[:2], t[1:]) and 100 * c >= share * a for (q, t), c in f.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], k + 1, *x[1:]) for k, x in enumerate(own)]
    return sorted(ranked)


@pytest.mark.parametrize("block", [10**6, 40])
def test_phrases_equal_a_plain_count(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    rng = random.Random(3)
    words = ["red", "Green", "blue", "é", "tea", "pot"]
    rows = ODD + [(50 + k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", "\n", "\t"]) for _ in range(rng.randint(0, 40))), "s", rng.choice(["en", "de", None, "und"])) for k in range(120)]
    got = sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows), min_count=4).collect())
    assert got == phrases_plain(rows, 4)
    assert sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows), min_count=4, top=3).collect()) == [r for r in phrases_plain(rows, 4) if r[1] <= 3]


def test_lists_of_blocks_are_not_rows(spark, monkeypatch):
    """No row that is read, written or sent is longer than a word: lists stay in the task that makes them."""
    names = []
    written = phrases.C.written
    monkeypatch.setattr(phrases.C, "written", lambda df, name: (names.append((name, df.dtypes)), written(df, name))[1])
    rows = [(k, "alpha beta gamma delta", "s", "en") for k in range(30)]
    assert phrases.collocations(docs_of(spark, rows)).count() > 0
    assert names and not [x for x in names if any("array" in kind or kind == "binary" for _, kind in x[1])]


def test_words_hash_alike_in_any_block():
    a, b = pa.array(["tea", "pot", "é", "teapot"], pa.large_string()), pa.array(["x", "teapot", "tea"], pa.large_string())
    one, two = phrases.word_hashes("en", a), phrases.word_hashes("en", b.slice(1))
    assert one[[3, 0]].tolist() == two.tolist() and len(set(one.tolist())) == 4
    assert not set(one.tolist()) & set(phrases.word_hashes("de", a).tolist())


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_plain(r, text):
    lang = r[3] if len(r) > 3 else "en"
    source = r[2] if len(r) > 2 else "s"
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], source, lang, None if r[1] is None else len(r[1]), text)])


def climb(nodes, group):
    """Root, and per leaf the (before, after) siblings by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            low = at // group * group
            paths[k].append((nodes[low:at], nodes[at + 1 : low + group]))
        nodes = [digest(*nodes[k : k + group]) for k in range(0, len(nodes), group)]
        where = [at // group for at in where]
    return nodes[0], paths


def merkle_plain(rows, group):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2] if len(r) > 2 else "s"].append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    roots, found = [], []
    for s in order:
        own = sorted(trees[s], key=lambda r: (r[0] is None, r[0] or 0, leaf_plain(r, r[1])))
        root, paths = climb([leaf_plain(r, r[1]) for r in own], group)
        roots.append(root)
        found.append((own, paths))
    top, tops = climb(roots, group)
    out = []
    for (own, paths), root, above in zip(found, roots, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            h = leaf_plain(r, r[1].translate(LOWER) if hit else r[1])
            for before, after in path + above:
                h = digest(*before, h, *after)
            out.append((r[0], leaf_plain(r, r[1]), root, top, digest(*[x for b, a in path + above for x in b + a]), h, h == top))
    return sorted(out, key=str)


def merkle_rows(spark, rows, group):
    from pyspark.sql import functions as F

    from rasterloom.llm import common as C

    changed = merkle.leaf_digest([*[F.col(f) for f in merkle.FIELDS[:-1]], C.ascii_lower(F.col("text"))])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(docs_of(spark, rows, "digest long, idx long"), carry={"changed": F.when(hit, changed)}, group=group).proofs()
    return sorted([tuple(r) for r in found.select("id", "digest", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256), merkle.folded(F.col("path"), F.coalesce("changed", "digest")).alias("f")).withColumn("v", F.col("f") == F.col("root")).collect()], key=str)


@pytest.mark.parametrize("group,chunk", [(16, 4096), (2, 3), (3, 4)])
def test_proofs_fold_to_the_root_unless_rows_are_changed(spark, monkeypatch, group, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    rows = ODD + [(100 + k, f"Text {k}", ["hot", "hot", "b", "é", "a"][k % 5]) for k in range(150)] + [(400 + k, "T", f"lone{k}") for k in range(9)]
    got = merkle_rows(spark, rows, group)
    assert got == merkle_plain(rows, group)
    assert {r[-1] for r in got} == {True, False}


def test_a_lone_row_is_its_own_root(spark):
    assert merkle_rows(spark, [(3, "abc")], 16) == merkle_plain([(3, "abc")], 16)
    got = merkle_rows(spark, [(3, "abc")], 16)[0]
    assert got[1] == got[2] == got[3] and got[4] == hashlib.sha256(b"").hexdigest()
