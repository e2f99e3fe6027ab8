"""Quality rules: a threshold table compiled into one projection of built-in functions (no Python on the data path)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages.
STOP_WORDS = """the of and to in is that for it with as was on be by this are or an from at not
le la les de des et en un une du que qui est pour dans sur par au il elle pas avec
der die das und in den von zu mit ist des auf nicht ein eine dem sich im auch es
el los las y en que del se por con para una su al lo como no es""".split()


@dataclass(frozen=True)
class Rule:
    """``low * scale(denominator) <= 1000 * numerator <= high * denominator``, in whole thousandths."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None

    def passes(self) -> Column:
        value, base = F.expr(self.numerator) * 1000, F.expr(self.denominator)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (value >= base * self.low)
        if self.high is not None:
            ok = ok & (value <= base * self.high)
        return ok


#: Thresholds in thousandths of the denominator.
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=1500, high=15000),
    Rule("symbols per word", "n_symbols", "n_words", high=300),
    Rule("stop words per word", "if(n_words < 20, n_words, n_stop_words)", "n_words", low=10),  # too few words say nothing
    Rule("repeated lines", "n_dup_lines", "n_lines", high=500),
    Rule("upper-case letters", "n_upper", "word_chars", high=500),
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it, even where a filter is pushed down."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column, size: int) -> Column:
    """How many words lie in windows of ``size`` words that occur at least twice."""
    windows = F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(places, j + 1) - p, F.lit(size)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def places(order: Column) -> Column:
        same = lambda x, j: F.coalesce(x.h == F.get(order, j - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(order, j + 1).h, F.lit(False))
        return F.array_sort(F.transform(F.filter(order, same), lambda x: x.i))

    def counted(hashes: Column) -> Column:  # only texts in which some window is repeated need the windows in order
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(order, lambda o: _let(places(o), covered)))

    return F.coalesce(_let(windows, counted), F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with the counts that the rules use, in projections over each row.

    A null text counts as empty: every count is 0. Rows keep their other columns, except that
    columns of the same names as the counts are replaced.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    stop = sorted(set(STOP_WORDS))
    words = _let(F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(F.filter(w, lambda x: F.lower(x).isin(*stop))).cast("long").alias("n_stop_words"), _repeat_words(w, window).alias("n_repeat_words")))
    lines = _let(F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != ""), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.withColumns({
        "word_chars": F.char_length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_upper": (F.char_length(t) - F.char_length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long"),
        "_words": words,
        "_lines": lines,
    })
    fields = {"n_words": "_words", "n_stop_words": "_words", "n_repeat_words": "_words", "n_lines": "_lines", "n_dup_lines": "_lines"}
    return out.withColumns({k: F.col(f"{v}.{k}") for k, v in fields.items()}).drop("_words", "_lines")


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed``, ``failed_rules`` (names) and ``kept``.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in repeated five-word
    windows. ``kept``: not so, and no rule of the table fails. Null and empty texts fail the base.
    Repeated rows are judged each by itself; an empty table gives an empty table.
    """
    out = measures(docs, text)
    failed = F.filter(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    out = out.withColumns({"base_failed": (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20), "failed_rules": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's counts, base_failed and kept of every row of ``documents``; null and empty texts have no words and fail the base."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ",".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
OP10_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, hash(w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS h, w[i:i+4] AS g
    FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
m AS (SELECT t.*, len(w)::BIGINT AS n_words,
    coalesce(len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_upper,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
    coalesce(rep.n, 0) AS n_repeat_words FROM t LEFT JOIN rep USING (r)),
n AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 1000 * word_chars BETWEEN 1500 * n_words AND 15000 * n_words
    AND 1000 * n_symbols <= 300 * n_words AND (n_words < 20 OR 1000 * n_stop_words >= 10 * n_words)
    AND 1000 * n_dup_lines <= 500 * n_lines AND 1000 * n_upper <= 500 * word_chars AS kept FROM n
"""
