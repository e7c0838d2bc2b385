"""Quality rules: a table of thresholds compiled into one Spark projection, evaluated by built-in expressions only.

Words are runs of characters other than blank and U+0009 to U+000D. A rule names a measure and the range in which it passes; all
rules of a table become columns of the same projection, so a text is read and split once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "for", "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "pour",
    "der", "die", "das", "und", "ist", "ein", "eine", "zu", "den", "mit", "von", "el", "los", "las", "y", "en", "con", "para", "por", "del",
)


class Rule(NamedTuple):
    """``measure`` must be at least ``low`` and at most ``high``, where given, if the text has ``from_words`` words or more."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.01, None, 100),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("bullets", "bullet_line_ratio", None, 0.9, 50),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.5, 50),
    Rule("capitals", "capital_ratio", None, 0.5),
)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``_m`` of the counts of ``text``; a null text counts as empty.

    A repeated word is one that lies in a window of eight words which the text has twice or more. Hashes of the windows are
    sorted with their positions, so equal windows are neighbours, and the union of their ranges is a sum over sorted positions.
    Texts whose hashes are all distinct skip that. Windows are compared by 64 bits only, within one text: of a text of a million words
    two different windows have one hash in one of some 37 million cases.
    """
    step = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    step = step.withColumn("_w", F.filter(F.split("_t", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    # a word is hashed once, a window by the hashes of its words; these are bound by a lambda, as a column used once is put into the
    # function over windows by the optimizer and made again for each of them

    def windows(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*(F.get(x, i + k) for k in range(WINDOW))))

    hashes = F.get(F.transform(F.array(F.transform("_w", lambda w: F.xxhash64(w))), windows), F.lit(0))
    step = step.withColumn("_h", F.when(F.size("_w") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_p", F.when(F.size("_h") > F.size(F.array_distinct("_h")), pairs))

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get("_p", i - 1)["h"], F.get("_p", i + 1)["h"]
        return F.when((x["h"] == before) | (x["h"] == after), x["i"])

    step = step.withColumn("_at", F.array_sort(F.filter(F.transform("_p", twice), lambda i: i.isNotNull())))
    ranges = F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - x, F.lit(WINDOW))))
    step = step.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))

    def without(chars: str) -> Column:
        return (F.char_length("_t") - F.char_length(F.translate("_t", chars, ""))).cast("bigint")

    def lines(pattern: str) -> Column:
        return F.size(F.filter("_l", lambda x: x.rlike(pattern))).cast("bigint")

    fields = {
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.char_length(F.translate("_t", BLANKS, "")).cast("bigint"),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
        "n_repeat_words": F.coalesce(F.aggregate(ranges, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")),
        "n_lines": F.size("_l").cast("bigint"),
        "n_capitals": without(CAPITALS),
        "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint"),
        "n_bullet_lines": lines("^[\\x20\\x09]*[-*•]"),
        "n_ellipsis_lines": lines("([.][.][.]|…)[\\x20\\x09-\\x0D]*$"),
    }
    return step.withColumn("_m", F.struct(*(v.alias(k) for k, v in fields.items()))).drop("_t", "_w", "_h", "_p", "_at", "_l")


#: Each measure is one of these counts over another.
MEASURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
    "capital_ratio": ("n_capitals", "word_chars"),
}


def broken(rule: Rule) -> str:
    """SQL for a rule that a text breaks, over the counts; false where the measure has no denominator."""
    over, under = MEASURES[rule.measure]
    ratio = f"cast({over} as double) / {under}"
    tests = [f"{ratio} < {rule.low!r}"] * (rule.low is not None) + [f"{ratio} > {rule.high!r}"] * (rule.high is not None)
    return f"case when {under} = 0 or n_words < {rule.from_words} then false else {' or '.join(tests)} end"


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def rules(docs: DataFrame, table: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken, further counts ...)`` of every row of
    ``docs(doc_id, text, ...)``.

    ``broken`` lists the rules that the text breaks, joined by commas, and ``kept`` is true if base and rules hold. Null and empty
    texts have counts of 0 and fail the base. Doc_ids may be null or repeat; there is one row per row. Other columns are ignored.
    """
    flat = counts(docs.select("doc_id", "text")).select("doc_id", "_m.*")
    names = F.concat_ws(",", *(F.when(F.expr(broken(r)), F.lit(r.name)) for r in table))
    judged = flat.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("broken", names).withColumn("kept", F.expr("not base_failed and broken = ''"))
    first = ["doc_id", *BASE, "base_failed", "kept", "broken"]
    return judged.select(*first, *(c for c in flat.columns if c not in first))


def oracle_sql(table: tuple[Rule, ...] = RULES) -> str:
    """The same rows in SQL for another engine, by tables of windows instead of arrays."""
    names = ", ".join(f"case when {broken(r)} then '{r.name}' end" for r in table)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    blank = "[\\x20\\x09-\\x0D]"
    word = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{word}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM t),
g AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, sum(least({WINDOW}, coalesce(nx - i, {WINDOW})))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{blank}', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
  len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words, len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*[-*•]')))::BIGINT AS n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|…){blank}*$')))::BIGINT AS n_ellipsis_lines
  FROM t JOIN w USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, {BASE_FAILED} AS base_failed, concat_ws(',', {names}) AS broken FROM m)
SELECT *, NOT base_failed AND broken = '' AS kept FROM b"""
