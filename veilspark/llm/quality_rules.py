"""Operator 5: quality rules, a table of thresholds compiled to one projection of built-in functions.

A rule names a ratio, its bounds and the least number of words from which it is asked. verdict() turns the table into one
Boolean expression. Everything a row needs is bound once by lambda variables, so words are split and windows hashed once.

Defined results: null and empty texts have no words and fail; repeated rows are judged each alone; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


class Rule(NamedTuple):
    ratio: str
    least: float | None
    most: float | None
    from_words: int = 0


STOP_WORDS = ("the of and to in that is was for with as by on be are it at this from an and a "
              "de la le et les des est un une que dans du pour sur qui en au "
              "der die das und ist von zu den mit nicht ein eine auf im sich für "
              "el los las y del por con una se no su al es lo como para").split()

RULES = (
    Rule("mean_word_length", 1.5, 15.0),
    Rule("longest_word", None, 1000.0),
    Rule("symbols_per_word", None, 0.2),
    Rule("marks_per_word", None, 0.5),
    Rule("stop_word_share", 0.02, None, 50),
    Rule("capitals_share", None, 0.6),
    Rule("duplicate_line_share", None, 0.5),
)

#: name: SQL over the fields of `m` and the text `t`; shared subexpressions run before their guards, so no division may fail
RATIOS = {
    "mean_word_length": "try_divide(m.word_chars, m.n_words)",
    "longest_word": "m.longest",
    "symbols_per_word": "try_divide(m.n_symbols, m.n_words)",
    "marks_per_word": "try_divide(length(regexp_replace(t, '[^!?]+', '')), m.n_words)",
    "stop_word_share": "try_divide(m.n_stop, m.n_words)",
    "capitals_share": "try_divide(length(regexp_replace(t, '[^A-Z]+', '')), m.word_chars)",
    "duplicate_line_share": "try_divide(m.n_dup_lines, m.n_lines)",
}

_BLANK, _OTHER = "'[ \t-\r]+'", "'[^ \t-\r]'"
# sort_array, not array_sort: that one compares by an interpreted lambda
_REPEATS = """
transform(array(transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8)))), hs ->
  if(size(array_distinct(hs)) = size(hs), 0,
    transform(array(sort_array(transform(hs, (h, i) -> struct(h AS h, i AS i)))), s ->
      aggregate(
        sort_array(transform(filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) OR coalesce(get(s, j + 1).h = x.h, false)), x -> x.i)),
        struct(0 AS c, -8 AS last), (a, x) -> struct(a.c + least(8, x - a.last) AS c, x AS last), a -> a.c))[0]))[0]
"""


def measures(text: str) -> Column:
    """One struct of counts for the SQL expression `text`."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return F.expr(f"""
transform(array(coalesce({text}, '')), t ->
  transform(array(array_remove(split(t, {_BLANK}), '')), w ->
    transform(array(filter(split(t, '\\n'), l -> l RLIKE {_OTHER})), ls ->
      struct(
        cast(size(w) AS bigint) AS n_words,
        cast(length(array_join(w, '')) AS bigint) AS word_chars,
        cast(length(regexp_replace(t, '[^#*$%&|<>]+', '')) AS bigint) AS n_symbols,
        cast(size(ls) AS bigint) AS n_lines,
        cast(size(ls) - size(array_distinct(ls)) AS bigint) AS n_dup_lines,
        cast(if(size(w) < 8, 0, {_REPEATS}) AS bigint) AS n_repeat_words,
        size(filter(w, x -> lower(x) IN ({stop}))) AS n_stop,
        coalesce(array_max(transform(w, x -> length(x))), 0) AS longest))[0])[0])[0]
""")


def verdict(text: str, m: str = "m", rules: tuple[Rule, ...] = RULES) -> Column:
    parts = ["true"]
    for r in rules:
        ratio = RATIOS[r.ratio].replace("m.", f"{m}.").replace("(t,", f"({text},")
        bounds = [f"{ratio} >= {r.least}D"] * (r.least is not None) + [f"{ratio} <= {r.most}D"] * (r.most is not None)
        parts.append(f"({m}.n_words < {max(1, r.from_words)} OR ({' AND '.join(bounds)}))")
    return F.expr(" AND ".join(parts))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    failed = F.expr("m.n_words < 20 OR 100 * m.n_repeat_words > 30 * m.n_words")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("m", measures("t"))
    return rows.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"), (~failed & verdict("t", "m", rules)).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_aggregate(w[i:i+7], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(least(8, i - p)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS p FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: list_contains([STOP], lower(x)))) AS n_stop,
  coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 15.0 AND longest <= 1000 AND n_symbols / n_words <= 0.2
  AND (length(t) - length(translate(t, '!?', ''))) / n_words <= 0.5 AND (n_words < 50 OR n_stop / n_words >= 0.02)
  AND (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) / word_chars <= 0.6 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM f
""".replace("[STOP]", "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]")
