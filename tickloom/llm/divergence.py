"""Source divergence audit: how far the sources of a language are apart in their terms, by inclusion-exclusion over supports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts
from .terms import LETTERS, counted

#: Bytes of text whose terms are counted together in a task.
STRETCH = 8 << 20
#: Sources that meet in one block of a term's postings.
BLOCK = 64
#: Over so many keys one language's histograms are dealt.
SALTS = 64


def _group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, n, df) of stretches of rows."""
    for batch in batches:
        lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
        group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(zero_copy_only=False)
        for low, high, _, codes, rows, counts, terms in counted(batch.column(2), LETTERS, STRETCH):
            if not len(codes):
                continue
            names, of_row = np.unique(group[low:high], return_inverse=True)
            key = of_row[rows] * np.int64(len(terms)) + codes
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n, df = np.add.reduceat(counts[order], first), np.diff(np.append(first, len(key)))
            name, code = names[key[first] // len(terms)], key[first] % len(terms)
            take = lambda values, at: pa.array(values).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([take(lang.dictionary, name // len(source.dictionary)), terms.take(pa.array(code)), take(source.dictionary, name % len(source.dictionary)), pa.array(n.astype(np.int64)), pa.array(df.astype(np.int64))], ["lang", "term", "source", "n", "df"])


def kept_terms(docs: DataFrame, least: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, term, source, n, n_lang, first) of every term in at least ``least`` documents of its language.

    ``n`` counts occurrences in the source, ``n_lang`` in the language; ``first`` marks one row of each term of a
    language. Counts of a stretch of rows are summed before they are shuffled, once, by language and term.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = rows.mapInArrow(_group_counts, "lang string, term string, source string, n bigint, df bigint")
    counts = counts.repartition(parts(docs.sparkSession), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    first = F.row_number().over(term.orderBy("source")) == 1
    return counts.select("lang", "term", "source", "n", F.sum("df").over(term).alias("df"), F.sum("n").over(term).alias("n_lang"), first.alias("first")).where(F.col("df") >= least).drop("df")


def price(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (total + 2 terms))`` exactly; null without terms."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.when(terms > 0, _div(wide(count + 2) * F.lit(10**9).cast("decimal(10,0)"), wide(total + 2 * terms)) + 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))`` in whole numbers."""
    return _div((p - q) * (p - q), p + q)


def groups(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, support, total, terms, lang_total, zero, lang_sources, place) of every (lang, source) that occurs.

    ``support`` counts the kept terms of the group, ``terms`` those of the language, ``total`` the occurrences;
    ``zero`` is the price of a term that the group doesn't have. ``place`` numbers a language's sources.
    """
    names = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("total"), F.sum(F.col("first").cast("bigint")).alias("firsts"))
    rows = names.join(sums, ["lang", "source"], "left").na.fill(0, ["support", "total", "firsts"])
    of_lang = Window.partitionBy("lang")
    rows = rows.select("lang", "source", "support", "total", F.sum("firsts").over(of_lang).alias("terms"), F.sum("total").over(of_lang).alias("lang_total"), F.count(F.lit(1)).over(of_lang).alias("lang_sources"),
                       (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"))
    return rows.withColumn("zero", price(F.lit(0), F.col("total"), F.col("terms")))


def one_sided(kept: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, source, zero, cost): what the terms of a source cost against a group that has none of them, whose price is ``zero``.

    A source's counts are a histogram first; one row of it meets each distinct zero price of its language.
    """
    histogram = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")).join(group.select("lang", "source", "total", "terms"), ["lang", "source"])
    histogram = histogram.select("lang", "source", "times", price(F.col("n"), F.col("total"), F.col("terms")).alias("p"), F.pmod(F.xxhash64("source", "n"), F.lit(SALTS)).alias("salt"))
    zeros = group.select("lang", "zero").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return histogram.join(zeros, ["lang", "salt"]).groupBy("lang", "source", "zero").agg(F.sum(F.col("times") * distance(F.col("p"), F.col("zero"))).alias("cost"))


def overlaps(kept: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, a, b, value): what the terms that both sources have change in the sum of both one-sided costs and the constant.

    A term's postings are cut into blocks of sources that meet block by block, so no task holds all pairs of a term.
    """
    blocks = F.call_function("div", F.col("lang_sources") - 1, F.lit(BLOCK))
    post = kept.join(group.select("lang", "source", "total", "terms", "zero", "place", F.call_function("div", F.col("place"), F.lit(BLOCK)).alias("block"), blocks.alias("last")), ["lang", "source"])
    post = post.select("lang", "term", "place", "source", "block", "last", "zero", price(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    meet = lambda low: F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), lambda x: F.when(x < F.col("block"), low(x, F.col("block"))).otherwise(low(F.col("block"), x)))
    post = post.withColumn("pair", F.explode(meet(lambda x, y: F.struct(x.alias("x"), y.alias("y")))))
    side = lambda s, at: post.where(F.col("block") == F.col("pair")[at]).select("lang", "term", "pair", *[F.col(c).alias(f"{c}_{s}") for c in ("place", "source", "zero", "p")])
    both = side("a", "x").join(side("b", "y"), ["lang", "term", "pair"]).where("place_a < place_b")
    p, q, z, y = (F.col(c) for c in ("p_a", "p_b", "zero_a", "zero_b"))
    change = distance(p, q) - distance(p, y) - distance(z, q) + distance(z, y)
    return both.groupBy("lang", F.col("source_a").alias("a"), F.col("source_b").alias("b")).agg(F.sum(change).alias("value"))


def pair_distances(kept: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, a, b, value) of every two sources of a language, a's place before b's: the sum of the distance over all kept terms.

    Terms of neither source cost a constant, terms of one side a price from its histogram, both as if no term were
    shared; the postings of shared terms correct that.
    """
    g = group.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)))
    side = lambda s, rows: rows.select("lang", "salt", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "support", "zero", "place", "terms")])
    spread = group.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    pairs = side("a", g).join(side("b", spread), ["lang", "salt"]).where("place_a < place_b").drop("salt")
    constant = F.when(F.col("terms_a") > 0, (F.col("terms_a") - F.col("support_a") - F.col("support_b")) * distance(F.col("zero_a"), F.col("zero_b"))).otherwise(0)
    cost = one_sided(kept, group)
    pairs = pairs.select("lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"), "zero_a", "zero_b", constant.alias("value"))
    against = lambda s, o: cost.select("lang", F.col("source").alias(s), F.col("zero").alias(f"zero_{o}"), F.col("cost").alias(f"cost_{s}"))
    pairs = pairs.join(against("a", "b"), ["lang", "a", "zero_b"], "left").join(against("b", "a"), ["lang", "b", "zero_a"], "left")
    pairs = pairs.join(overlaps(kept, group).withColumnRenamed("value", "shared"), ["lang", "a", "b"], "left")
    return pairs.select("lang", "a", "b", sum((F.coalesce(F.col(c), F.lit(0)) for c in ("cost_a", "cost_b", "shared")), F.col("value")).alias("value"))


def telling_terms(kept: DataFrame, group: DataFrame, top: int = 10) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source has more of than its language, the furthest first."""
    rows = kept.join(group.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), price(F.col("n"), F.col("total"), F.col("terms")).alias("p"), price(F.col("n_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    return _ranked(rows.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): distances of every source of a language from each other one, and its telling terms.

    Part ``pair``: item is the other source, all ranks. Part ``term``: item is a term that the source has relatively
    more of than the language, the ``top`` furthest. Prices and distances are whole numbers, so results don't depend
    on partitioning.

    Null text, lang and source count as empty; sources without terms have pairs. Without kept terms all
    distances are 0. Equal values rank by item. Repeated rows count each; other columns are ignored; an empty table
    gives an empty one. One row of each source of a language is one task's work at most, one posting of each source
    for a term.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    kept = scratch.write(kept_terms(docs, least, text, lang, source))
    group = scratch.write(groups(docs, kept, lang, source))
    pairs = pair_distances(kept, group)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = _ranked(pairs.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value"))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(telling_terms(kept, group, top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", F.col("value").cast("bigint"), F.col("rank").cast("int"))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit over all of ``documents``."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n, v FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM f),
l AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, v, sum(n) AS n FROM f GROUP BY lang, term, v)),
s AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
