"""How far the sources of a language differ in their words, and in which words a source differs from its language.

Terms are runs of ASCII letters and of code points from U+0080 on, with A-Z lower-cased. A language keeps the V terms found in at least `min_docs` of its
documents. A group is a (language, source) that occurs, or a language. Each gives each kept term with `count` occurrences in it p = 1 + floor(10^9 * (count + 1) / (N + V)),
N being its occurrences of kept terms. f(p, q) = floor((p - q)^2 / q). All arithmetic is on whole numbers.

Sums of f over all V terms for each pair of sources come from inclusion and exclusion over supports, not from V terms a pair:

1. A source has few different counts. Its histogram (count, number of terms) prices the terms of the one side against the other's p of a term without occurrences, both ways.
2. Terms that both have meet in a join of postings on (language, term), which puts f of both in the place of the two one-sided prices. Its rows are summed where they are made.
3. V - |A| - |B| terms, corrected by the common ones, have no occurrences in either: one constant times their number.

The parts are rows (language, A, B, value) of one sum. Counts meet in each task first, then per (language, source, term), so a source or a term in a third of all
texts costs a row a task. The postings of a term are at most as many as the sources of its language, whose pairs are the result. Group constants are a table of a row
a group, which Spark broadcasts only below its own limit.

Results: null text, language and source are ''. Groups without kept terms have N = 0; a language with V = 0 has pairs of value 0. Repeated rows count each. No rows: no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back_memory, materialize, small_batches, table
from .terms import LETTERS, Counts, words_of

SCALE = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of texts with lang and source: occurrences, and texts that hold the term."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()

        def taken() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms, n, texts in counts.take():
                named = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*named, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(texts, pa.int64())], ["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts.add((lang, source), words_of(raw, LETTERS), len(raw or b""))
                if counts.full():
                    yield from taken()
        yield from taken()
        give_back_memory()

    counted = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total), exact for any long; missing where total is 0. At most 10^9 + 1 for count < total."""
    share = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return (1 + whole_div(share, F.when(total > 0, total).cast("decimal(20,0)"))).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): the square of numbers up to 10^9 fits a long."""
    return whole_div((p - q) * (p - q), q)


def kept_postings(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, lang_n, source, n): the occurrences of each kept term in each source that has it."""
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return by_term.where(F.col("docs") >= min_docs).select("lang", "term", "lang_n", F.explode("sources").alias("s")).select("lang", "term", "lang_n", "s.source", "s.n")


def groups_of(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """A row for each (lang, source): its number, V, the language's total, the group's total N + V, its kept terms, and its p of a term without occurrences."""
    each = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"))
    langs = postings.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    g = docs.select("lang", "source").distinct().join(each, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    total = F.col("n") + F.col("v")
    return g.select(F.monotonically_increasing_id().alias("g"), "lang", "source", "v", (F.col("lang_n") + F.col("v")).alias("lang_total"), total.alias("total"), "held", price(F.lit(0), total).alias("zero"))


def summed_pairs(priced: DataFrame, groups: DataFrame, pieces: int) -> DataFrame:
    """(a, b, value) for each ordered pair of sources of a language: f(p of a, p of b) over all its kept terms."""
    small = groups.select("lang", "v", "held", "g", "zero")
    # the other groups of a language are repeated for each piece, so that neither a language nor a source is one task
    others = small.select("lang", F.col("g").alias("o"), F.col("zero").alias("o_zero"), F.col("held").alias("o_held"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))
    in_piece = lambda df, *by: df.withColumn("piece", F.pmod(F.xxhash64(*by), F.lit(pieces)).cast("int")).join(others, ["lang", "piece"]).where("g <> o")

    histogram = priced.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("terms"))
    sided = in_piece(histogram, "g", "p").groupBy("g", "o").agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("o_zero"))).alias("there"), F.sum(F.col("terms") * gap(F.col("o_zero"), F.col("p"))).alias("back"))

    a, b = (priced.select("lang", "term", *[F.col(c).alias(f"{c}_{k}") for c in ("g", "p", "zero")]) for k in "ab")
    pa_, pb, za, zb = (F.col(c) for c in ("p_a", "p_b", "zero_a", "zero_b"))
    common = a.join(b, ["lang", "term"]).where("g_a < g_b").groupBy("g_a", "g_b").agg(
        F.sum(gap(pa_, pb) - gap(pa_, zb) - gap(za, pb) + gap(za, zb)).alias("there"), F.sum(gap(pb, pa_) - gap(pb, za) - gap(zb, pa_) + gap(zb, za)).alias("back"),
    )

    neither = in_piece(small, "g").select(F.col("g").alias("a"), F.col("o").alias("b"), F.coalesce((F.col("v") - F.col("held") - F.col("o_held")) * gap(F.col("zero"), F.col("o_zero")), F.lit(0).cast("long")).alias("value"))
    both_ways = lambda df, x, y: df.select(F.explode(F.array(F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col("there").alias("value")), F.struct(F.col(y).alias("a"), F.col(x).alias("b"), F.col("back").alias("value")))).alias("r")).select("r.*")
    parts = neither.unionByName(both_ways(sided, "g", "o")).unionByName(both_ways(common, "g_a", "g_b"))
    return parts.groupBy("a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part ('pair': item is another source; 'term': item is a word that the source has more of than its language), item, value, rank."""
    spark = docs.sparkSession
    d = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    postings = materialize(kept_postings(d, min_docs), "postings")
    groups = materialize(groups_of(d, postings), "groups")
    priced = postings.join(groups.select("lang", "source", "g", "v", "total", "lang_total", "zero"), ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("total")))

    pairs = summed_pairs(priced, groups, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = lambda k, *names: groups.select(F.col("g").alias(k), *[F.col(c).alias(n) for c, n in names])
    pairs = pairs.join(named("a", ("lang", "lang"), ("source", "source")), "a").join(named("b", ("source", "item")), "b")
    ranked = lambda df: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", ranked(pairs)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    q = price(F.col("lang_n"), F.col("lang_total"))
    terms = priced.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", ranked(terms)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: The same in SQL, term by term.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words GROUP BY ALL),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n.c, 0)::HUGEINT AS c FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
priced AS (SELECT x.*, 1 + (1000000000 * (c + 1)) // (sum(c) OVER (PARTITION BY x.lang, source) + v) AS p FROM dense x JOIN v ON x.lang = v.lang),
whole AS (SELECT x.lang, term, 1 + (1000000000 * (c + 1)) // (sum(c) OVER (PARTITION BY x.lang) + v) AS q FROM (SELECT lang, term, sum(c) AS c FROM dense GROUP BY ALL) x JOIN v ON x.lang = v.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM priced x JOIN priced y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT x.lang, x.source, x.term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM priced x JOIN whole w ON x.lang = w.lang AND x.term = w.term WHERE c > 0 AND p > q),
both_parts AS (SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term', * FROM term),
ranked AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
