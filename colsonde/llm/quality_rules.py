"""Quality rules with thresholds that follow each language and source; DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colsonde.llm import common

MEASURES = ("symbols", "dup_lines", "repeats", "word_length")


@dataclass(frozen=True)
class Fence:
    """A measure passes up to q75 + spread * (q75 - q25) + slack; ``low`` also bounds below.

    Measures are integers: symbols, duplicate lines and repeated words in thousandths of word
    characters, lines and words; mean word length in hundredths of a character. Lines count
    as FEW_LINES more and words as FEW_WORDS more, so that one repeat in a short text weighs
    little.
    """

    spread: int
    slack: int
    low: bool = False


FENCES = {
    "symbols": Fence(3, 40),
    "dup_lines": Fence(3, 150),
    "repeats": Fence(3, 150),
    "word_length": Fence(4, 150, True),
}

#: Added to the lines and words that repeats are measured against.
FEW_LINES, FEW_WORDS = 5, 50
#: Documents' worth of the wider group's limit that is blended into a group's own.
PRIOR = 100
#: A group's own limit counts as at most so many times the wider group's.
WIDEST = 2
#: Significant bits of a sketched value: errors stay within 1/32 of it.
SKETCH_BITS = 6


def base_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and __lines added.

    All are found within the row: 3-word windows by sorting the row's own window hashes.
    """
    text = common.text_of(column)
    full = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(common.WHITE)) != "")
    out = docs.withColumn("__w", common.words_of(text)).withColumn("__full", full)
    n = F.size("__w")
    trigram = lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    out = out.withColumn("__h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), trigram)))
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.withColumn("__s", F.when(again, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    repeated = lambda p, j: F.when(
        F.coalesce(F.get("__s", j - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get("__s", j + 1)["h"] == p["h"], F.lit(False)), p["i"]
    )
    out = out.withColumn("__r", F.when(F.col("__s").isNotNull(), F.array_compact(F.transform("__s", repeated))))
    covered = F.array_distinct(F.flatten(F.array(F.col("__r"), F.transform("__r", lambda i: i + 1), F.transform("__r", lambda i: i + 2))))
    return out.select(
        *[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns],
        n.cast("bigint").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("__full").cast("bigint").alias("__lines"),
    )


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _measures() -> dict[str, Column]:
    return {
        "symbols": F.expr("if(word_chars > 0, (1000 * n_symbols) div word_chars, 0L)"),
        "dup_lines": F.expr(f"(1000 * n_dup_lines) div (__lines + {FEW_LINES})"),
        "repeats": F.expr(f"(1000 * n_repeat_words) div (n_words + {FEW_WORDS})"),
        "word_length": F.expr("if(n_words > 0, (100 * word_chars) div n_words, 0L)"),
    }


def _rounded(value: Column) -> Column:
    """A value cut to its leading SKETCH_BITS bits: the key of a sketch cell."""
    drop = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return F.floor(value / F.pow(F.lit(2.0), drop)).cast("bigint") * F.pow(F.lit(2.0), drop).cast("bigint")


def sketch(counted: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: (lang, source, measure, cell, n) of documents that pass the base.

    A cell counts the values that share their leading bits, so sketches merge by adding counts,
    in any order with the same result, and each has a few hundred cells however many documents.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _rounded(v).alias("cell")) for k, v in _measures().items()]))
    return (
        counted.where(~_base_failed())
        .select("lang", "source", cells.alias("c"))
        .groupBy("lang", "source", "c.measure", "c.cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _limits(cells: DataFrame, by: list[str]) -> DataFrame:
    """One row a group: __docs, and __lo_<measure>, __hi_<measure>."""
    w = Window.partitionBy(*by, "measure")
    ranked = cells.groupBy(*by, "measure", "cell").agg(F.sum("n").alias("n"))
    ranked = ranked.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("total", F.sum("n").over(w))
    quantile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("cell")))
    per = ranked.groupBy(*by, "measure").agg(quantile(1).alias("q25"), quantile(3).alias("q75"), F.max("total").alias("total"))
    spread = F.coalesce(*[F.when(F.col("measure") == k, F.lit(f.spread)) for k, f in FENCES.items()])
    slack = F.coalesce(*[F.when(F.col("measure") == k, F.lit(f.slack)) for k, f in FENCES.items()])
    reach = spread * (F.col("q75") - F.col("q25")) + slack
    per = per.withColumn("hi", F.col("q75") + reach).withColumn("lo", F.greatest(F.col("q25") - reach, F.lit(0)))
    picks = [F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"__{side}_{k}") for k in MEASURES for side in ("lo", "hi")]
    return per.groupBy(*by).agg(F.max("total").alias("__docs"), *picks)


def _blend(own: DataFrame, wider: dict[str, Column], keep: list[str]) -> DataFrame:
    """Limits of groups, pulled to those of the ``wider`` group by PRIOR documents' worth of it."""
    out = []
    for k in MEASURES:
        for side in ("lo", "hi"):
            mine, theirs = F.col(f"__{side}_{k}"), wider[f"__{side}_{k}"]
            bounded = F.least(mine, theirs * WIDEST) if side == "hi" else F.greatest(mine, F.floor(theirs / WIDEST).cast("bigint"))
            blended = F.floor((F.col("__docs") * bounded + PRIOR * theirs).cast("decimal(38,0)") / (F.col("__docs") + PRIOR))
            out.append(blended.cast("bigint").alias(f"__{side}_{k}"))
    return own.select(*keep, *out)


def thresholds(cells: DataFrame) -> DataFrame:
    """(lang, source, __lo_*, __hi_*) of every group: blended with its language's, and those with all documents'.

    The smaller a group, the nearer it is to its language; there is no size at which that
    changes at once. A group full of junk widens its own limits up to WIDEST times its
    language's, a language up to that many times those of all.
    """
    cells = common.settle(cells, "quality-cells")
    everyone = _limits(cells, []).first()  # one row, or none
    names = [f"__{side}_{k}" for k in MEASURES for side in ("lo", "hi")]
    langs = _blend(_limits(cells, ["lang"]), {c: F.lit(everyone[c] if everyone else 0).cast("bigint") for c in names}, ["lang"])
    langs = langs.select(F.col("lang").alias("__lang"), *[F.col(c).alias(f"{c}_wide") for c in names])
    own = _limits(cells, ["lang", "source"]).join(langs, F.col("lang").eqNullSafe(F.col("__lang")))
    return _blend(own, {c: F.col(f"{c}_wide") for c in names}, ["lang", "source"])


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """``counted`` with base_failed and kept: the joined filter."""
    limits = limits.withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source")
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    passed = F.lit(True)
    for k, value in _measures().items():
        passed = passed & (value <= F.col(f"__hi_{k}"))
        if FENCES[k].low:
            passed = passed & (value >= F.col(f"__lo_{k}"))
    out = joined.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(passed, F.lit(False)))
    return out.drop(*limits.columns)


def apply_rules(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed and kept.

    The base fails texts of under 50 words, and those of which more than half the words lie in
    3-word windows found twice or more. The method judges the rest by thresholds read from
    quantile sketches of their (lang, source) group, blended with those of their language and
    of all documents (:func:`thresholds`). Null and empty texts have no words and fail; null
    lang or source make groups of their own; repeated rows count each time. Columns named as
    the results are replaced. Texts are read and counted once, written with their counts for
    the verdicts, and never shuffled.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    counted = common.settle(base_counts(docs.drop(*names), column), "quality-counts")
    limits = common.settle(thresholds(sketch(counted)), "quality-limits")
    return judge(counted, limits).drop("__lines")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; counts are kept in a small table, so texts are read once."""
    counted = common.settle(base_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality-counts")
    limits = common.settle(thresholds(sketch(counted)), "quality-limits")
    return judge(counted, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    ratio = {
        "symbols": "CASE WHEN word_chars > 0 THEN (1000 * n_symbols) // word_chars ELSE 0 END",
        "dup_lines": f"(1000 * n_dup_lines) // (n_lines + {FEW_LINES})",
        "repeats": f"(1000 * n_repeat_words) // (n_words + {FEW_WORDS})",
        "word_length": "CASE WHEN n_words > 0 THEN (100 * word_chars) // n_words ELSE 0 END",
    }
    cell = f"(value // (1::BIGINT << greatest(length(bin(value)) - {SKETCH_BITS}, 0))) * (1::BIGINT << greatest(length(bin(value)) - {SKETCH_BITS}, 0))"
    measures = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, ({v})::BIGINT AS value FROM base WHERE NOT base_failed" for k, v in ratio.items())
    spread = " ".join(f"WHEN '{k}' THEN {f.spread}" for k, f in FENCES.items())
    slack = " ".join(f"WHEN '{k}' THEN {f.slack}" for k, f in FENCES.items())

    def limits(by: str) -> str:
        return f"""
        SELECT {by}, measure, total, greatest(q25 - reach, 0) AS lo, q75 + reach AS hi FROM (
          SELECT *, (CASE measure {spread} END) * (q75 - q25) + (CASE measure {slack} END) AS reach FROM (
            SELECT {by}, measure, max(total) AS total, min(cell) FILTER (upto * 4 >= total) AS q25, min(cell) FILTER (upto * 4 >= total * 3) AS q75 FROM (
              SELECT {by}, measure, cell, sum(n) OVER (PARTITION BY {by}, measure ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {by}, measure) AS total
              FROM (SELECT {by}, measure, cell, count(*) AS n FROM cells GROUP BY ALL)) GROUP BY ALL))"""

    blended = (
        f"(o.total * greatest(o.lo, e.lo // {WIDEST}) + {PRIOR} * e.lo) // (o.total + {PRIOR}) AS lo, "
        f"(o.total * least(o.hi, {WIDEST} * e.hi) + {PRIOR} * e.hi) // (o.total + {PRIOR}) AS hi"
    )
    verdict = " AND ".join(
        [f"coalesce(max(hi) FILTER (measure = '{k}') >= any_value({k}), false)" for k in MEASURES]
        + [f"coalesce(max(lo) FILTER (measure = '{k}') <= any_value({k}), false)" for k, f in FENCES.items() if f.low]
    )
    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS f
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM t) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(f) - len(list_distinct(f)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(f)::BIGINT AS n_lines
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
cells AS (SELECT 1 AS one, lang, source, measure, {cell} AS cell FROM ({measures})),
own AS ({limits("lang, source")}),
langs AS ({limits("lang")}),
everyone AS ({limits("one")}),
wide AS (SELECT o.lang, o.measure, {blended} FROM langs o JOIN everyone e ON o.measure = e.measure),
lim AS (SELECT o.lang, o.source, o.measure, {blended} FROM own o JOIN wide e ON o.measure = e.measure AND o.lang IS NOT DISTINCT FROM e.lang),
v AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in ratio.items())} FROM base)
SELECT v.doc_id, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols,
       any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words, any_value(base_failed) AS base_failed,
       NOT any_value(base_failed) AND {verdict} AS kept
FROM v LEFT JOIN lim ON v.lang IS NOT DISTINCT FROM lim.lang AND v.source IS NOT DISTINCT FROM lim.source
GROUP BY v.doc_id
"""


SQL = _sql()
