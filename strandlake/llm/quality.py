"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

# Very common function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    """the of and to in is that for it as was with be by on not are this from or have an at
    der die und den von zu das mit sich des auf für ist nicht ein eine im dem
    de la le et les que du une des pour qui dans est au par sur pas avec se
    el los y en un del las por con no para al lo su una es""".split()
)


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; None leaves that side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The default table; metrics are columns that measures() makes.
RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("repeated_windows", "repeat_ratio", high=0.5),
    Rule("word_length", "mean_word_length", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.06),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)


#: Columns that measures() appends.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "mean_word_length", "symbol_ratio", "stop_ratio", "dup_line_ratio", "repeat_ratio")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression for the whole table; an undefined metric passes no bounded side."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (F.col(r.metric) >= r.low)
        if r.high is not None:
            verdict = verdict & (F.col(r.metric) <= r.high)
    return F.coalesce(verdict, F.lit(False))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append word, symbol, stop-word, line and repetition measures of the whole text.

    Null text counts as empty: every count is 0 and every ratio null.  Columns of docs with the names of
    measures are replaced.  Rows are independent, so repeated rows keep equal measures.
    """
    t = f"coalesce(`{text}`, '')"
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    split = docs.withColumn("_words", F.expr(f"array_remove(split({t}, '{WS}'), '')")).withColumn("_lines", F.expr(f"filter(split({t}, '\\n'), x -> trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM x) != '')"))
    window = "transform(sequence(0, size(_words) - 3), i -> concat(get(_words, i), ' ', get(_words, i + 1), ' ', get(_words, i + 2)))"
    split = split.withColumn("_tri", F.expr(f"CASE WHEN size(_words) >= 3 THEN {window} ELSE array() END"))
    # Windows with their places, in order of their words: equal ones are neighbours; their places then cover 3 words each.
    placed = "sort_array(transform(_tri, (w, i) -> struct(w, i)))"
    twice = f"transform(array({placed}), s -> transform(filter(s, (x, k) -> get(s, k - 1).w <=> x.w OR get(s, k + 1).w <=> x.w), x -> x.i))[0]"
    cover = f"aggregate(sort_array({twice}), struct(0L AS n, -9 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last)).n"
    bare = "split(lower(translate(text_, '.,;:?', '     ')), '" + WS + "')"
    out = split.withColumns({
        "n_words": F.expr("size(_words)").cast("long"),
        "word_chars": F.expr(f"length(translate({t}, ' \\t\\n\\u000B\\u000C\\r', ''))").cast("long"),
        "n_symbols": F.expr(f"length({t}) - length(translate({t}, '{SYMBOLS}', ''))").cast("long"),
        "n_dup_lines": F.expr("size(_lines) - size(array_distinct(_lines))").cast("long"),
        "n_repeat_words": F.expr(f"CASE WHEN size(array_distinct(_tri)) = size(_tri) THEN 0L ELSE {cover} END"),
        "n_stop_words": F.expr(f"size(filter({bare.replace('text_', t)}, w -> w IN ({stops})))").cast("long"),
        "n_lines": F.expr("size(_lines)").cast("long"),
    }).drop("_words", "_lines", "_tri")
    per = lambda a, b: F.try_divide(F.col(a), F.col(b))
    out = out.withColumns({"mean_word_length": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "stop_ratio": per("n_stop_words", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words")})

    # A generator of one row: a filter above would else repeat the expressions inside it, for every word of a window.
    return out.select(*(c for c in out.columns if c not in MEASURES), F.inline(F.array(F.struct(*MEASURES))))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """measures() with base_failed and kept; kept is the verdict of the whole table of rules."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ws = r"[\x20\x09-\x0D]+"
    return rf"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{ws}'), lambda x: x <> '') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
    r AS (SELECT row_number() OVER () AS rn, * FROM w),
    tri AS (SELECT rn, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM r)),
    hit AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS n FROM tri) WHERE n > 1),
    cov AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, i + unnest([0, 1, 2]) AS p FROM hit) GROUP BY rn),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{ws}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(string_split_regex(lower(translate(t, '.,;:?', '     ')), '{ws}'), lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
        len(ls)::BIGINT AS n_lines FROM r LEFT JOIN cov USING (rn)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND n_words > 0 AND n_lines > 0
        AND coalesce(word_chars::DOUBLE / nullif(n_words, 0) BETWEEN 2.0 AND 14.0 AND n_symbols::DOUBLE / nullif(n_words, 0) <= 0.1
        AND n_stop_words::DOUBLE / nullif(n_words, 0) >= 0.06 AND n_dup_lines::DOUBLE / nullif(n_lines, 0) <= 0.5, false) AS kept FROM b"""


SQL = {"op1_quality": _sql()}
QUERIES = {"op1_quality": op1_quality}
