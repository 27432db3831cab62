"""Quality rules with thresholds learnt from the corpus, with DataFrame functions only.

Every text yields ratios (word length, symbols, repeated lines, repeated words).  Two fixed base
rules come first.  The ratios of the documents that pass them go into mergeable quantile sketches
per language and source, which are merged per language and over all.  A limit lies beyond an
outer quantile of its group by ``SPREAD`` times that quantile's distance from the median, so it
follows the group's own spread, and there are no fixed cutoffs.  The quantiles of a group are
blended with those of its language, and these with those of all, as if ``PRIOR`` documents of the
wider group had been seen: the same rule for groups of any size.  The limits join back on language
and source.

Defined cases: null text has no words and fails the base rule; null language or source form
groups of their own; repeated rows are judged alike; texts without words get ratios of 0; where
no document passes the base rules there is no limit and all have failed; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PRIOR, SPREAD = 100, 2.0
#: Values a sketch keeps; quantiles of groups up to that size are exact.
SKETCH = 4000
#: Ratio, the side that is bad, and the outer quantile: farther out where few texts have any.
RATIOS = {"chars_per_word": ("both", 0.9), "symbols_per_word": ("high", 0.9), "dup_line_ratio": ("high", 0.98), "repeat_ratio": ("high", 0.98)}


def _repeat_words(words: str) -> str:
    """Words within 3-word windows found twice or more, as one SQL expression, linear but for one sort.

    Windows are sorted as (hash, start); those equal to a neighbour are repeated; their starts,
    sorted, cover up to 3 words each, less what the next start covers.
    """
    windows = f"array_sort(transform(slice({words}, 1, greatest(size({words}) - 2, 0)), (w, k) -> struct(xxhash64(w, {words}[k + 1], {words}[k + 2]) as h, k as k)))"
    return windows


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), t.alias("text"))
    base = base.withColumn("words", F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+', -1), w -> w != '')"))
    base = base.withColumn("lines", F.expr(r"filter(split(text, '\n', -1), l -> trim(BOTH ' \t\n\u000b\f\r' FROM l) != '')"))
    base = base.select("doc_id", "lang", "source", "text", F.size("words").cast("long").alias("n_words"), F.expr(_repeat_words("words")).alias("win"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"))
    starts = "array_sort(transform(filter(win, (x, i) -> (i > 0 and win[i - 1].h = x.h) or (i + 1 < size(win) and win[i + 1].h = x.h)), x -> x.k))"
    base = base.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        (F.length("text") - F.length(F.regexp_replace("text", C.WORD, ""))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        "n_dup_lines",
        "n_lines",
        F.expr(starts).alias("starts"),
    )
    covered = F.expr("aggregate(starts, (cast(0 as bigint), -3), (a, s) -> named_struct('col1', a.col1 + least(3, s - a.col2), 'col2', s), a -> a.col1)")
    return base.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", covered.alias("n_repeat_words"))


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return {"chars_per_word": F.col("word_chars") / n, "symbols_per_word": F.col("n_symbols") / n, "dup_line_ratio": F.col("n_dup_lines") / lines, "repeat_ratio": F.col("n_repeat_words") / n}


def failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def points(outer: float) -> tuple[float, float, float]:
    return round(1 - outer, 4), 0.5, outer


def thresholds(rows: DataFrame, prior: int = PRIOR, spread: float = SPREAD) -> DataFrame:
    """(t_lang, t_source, <ratio>_low, <ratio>_high) of every group of ``rows``, from sketches of the rows that pass the base rules."""
    sketches = [F.kll_sketch_agg_double(F.when(~failed(), F.col(r)), SKETCH).alias(r) for r in RATIOS]
    fine = C.written(rows.groupBy("lang", "source").agg(F.count_if(~failed()).alias("n"), *sketches), "sketches")
    merged = [F.kll_merge_agg_double(r, SKETCH).alias(r) for r in RATIOS]
    by_lang = fine.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    every = fine.agg(F.sum("n").alias("n"), *merged)

    def quantiles(sketches: DataFrame) -> DataFrame:
        found = [F.when(F.col("n") > 0, F.array(*[F.kll_sketch_get_quantile_double(r, F.lit(p)) for p in points(outer)])).alias(r) for r, (_, outer) in RATIOS.items()]
        return sketches.select(*[c for c in ("lang", "source") if c in sketches.columns], "n", *found)

    def blended(narrow: DataFrame, wide: DataFrame, on: Column) -> DataFrame:
        wide = wide.select(*[F.col(c).alias(f"wide_{c}") for c in wide.columns])
        mean = "if({0} is null, wide_{0}, transform(arrays_zip({0}, wide_{0}), z -> (n * z.{0} + {1} * z.wide_{0}) / (n + {1})))"
        kept = [c for c in ("lang", "source", "n") if c in narrow.columns]
        return narrow.join(wide, on, "left").select(*kept, *[F.expr(mean.format(r, f"{prior}.0D")).alias(r) for r in RATIOS])

    langs = blended(quantiles(by_lang), quantiles(every), F.lit(True))
    groups = blended(quantiles(fine), langs, F.col("lang").eqNullSafe(F.col("wide_lang")))
    out = [F.col("lang").alias("t_lang"), F.col("source").alias("t_source")]
    for r in RATIOS:
        low, middle, high = (F.col(r)[k] for k in range(3))
        out += [(low - F.lit(spread) * (middle - low)).alias(f"{r}_low"), (high + F.lit(spread) * (high - middle)).alias(f"{r}_high")]
    return groups.select(*out)


def judge(docs: DataFrame, prior: int = PRIOR, spread: float = SPREAD, **columns) -> DataFrame:
    """One row per row of ``docs``: base metrics, base_failed and kept."""
    rows = C.written(measured(docs, **columns).select("*", *[c.alias(r) for r, c in ratios().items()]), "metrics")
    limits, _ = C.small(thresholds(rows, prior, spread))
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    bad = F.lit(False)
    for r, (side, _) in RATIOS.items():
        bad = bad | (F.col(r) > F.col(f"{r}_high"))
        if side == "both":
            bad = bad | (F.col(r) < F.col(f"{r}_low"))
    kept = ~failed() & ~F.coalesce(bad, F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def _array(values: list[str]) -> str:
    return "[" + ", ".join(values) + "]"


_Q = ", ".join(_array([f"list_sort(list({r}))[greatest(ceil({p} * count(*)), 1)::INT]" for p in points(outer)]) + f" AS {r}" for r, (_, outer) in RATIOS.items())


def _blend(narrow: str, wide: str) -> str:
    return ", ".join(
        f"CASE WHEN {narrow}.n IS NULL THEN {wide}.{r} ELSE " + _array([f"({narrow}.n * {narrow}.{r}[{k}] + {PRIOR}.0::DOUBLE * {wide}.{r}[{k}]) / ({narrow}.n + {PRIOR}.0::DOUBLE)" for k in (1, 2, 3)]) + f" END AS {r}" for r in RATIOS
    )


_BAD = " OR ".join(
    f"m.{r} > t.{r}[3] + {SPREAD}::DOUBLE * (t.{r}[3] - t.{r}[2])" + (f" OR m.{r} < t.{r}[1] - {SPREAD}::DOUBLE * (t.{r}[2] - t.{r}[1])" if side == "both" else "") for r, (side, _) in RATIOS.items()
)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT i, pos, words[pos] || chr(10) || words[pos + 1] || chr(10) || words[pos + 2] AS gram FROM (SELECT i, words, unnest(range(1, greatest(len(words) - 1, 1))) AS pos FROM w)),
p AS (SELECT i, pos FROM (SELECT *, count(*) OVER (PARTITION BY i, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT i, count(DISTINCT q)::BIGINT AS n_repeat_words FROM (SELECT i, unnest([pos, pos + 1, pos + 2]) AS q FROM p) GROUP BY i),
b AS (SELECT w.i, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (i)),
m AS (SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS chars_per_word, n_symbols / greatest(n_words, 1)::DOUBLE AS symbols_per_word, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_ratio FROM b),
o AS (SELECT * FROM m WHERE NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)),
a AS (SELECT {_Q} FROM o), c AS (SELECT lang, count(*) AS n, {_Q} FROM o GROUP BY lang), f AS (SELECT lang, source, count(*) AS n, {_Q} FROM o GROUP BY lang, source),
l AS (SELECT g.lang, {_blend("c", "a")} FROM (SELECT DISTINCT lang FROM m) g LEFT JOIN c ON g.lang IS NOT DISTINCT FROM c.lang CROSS JOIN a),
t AS (SELECT g.lang, g.source, {_blend("f", "l")} FROM (SELECT DISTINCT lang, source FROM m) g LEFT JOIN f ON g.lang IS NOT DISTINCT FROM f.lang AND g.source IS NOT DISTINCT FROM f.source JOIN l ON g.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce({_BAD}, false) AS kept
FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""
