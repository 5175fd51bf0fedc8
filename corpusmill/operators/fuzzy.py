"""Vocabulary terms that resemble query terms which the vocabulary lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions.stemming import indel, may_reach


def missing_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distinct terms (term) of four letters or more that neither are in the vocabulary (term) nor begin one of its words."""
    t = terms.select("term").distinct().where((F.length("term") >= C.FUZZY_MIN_LENGTH) & ~F.col("term").isin(*sorted(C.QUERY_STOPWORDS)))
    heads = vocab.select(F.explode(F.transform(F.sequence(F.lit(C.FUZZY_MIN_LENGTH), F.greatest(F.length("term"), F.lit(C.FUZZY_MIN_LENGTH))), lambda n: F.substring("term", 1, n))).alias("term"))
    return t.join(heads, "term", "left_anti")


def _shortened(word: Column, times: int) -> Column:
    """The word and all that up to ``times`` deletions of a letter make of it, each once."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    layers = [F.array(word)]
    for _ in range(times):
        layers.append(F.array_distinct(F.flatten(F.transform(F.filter(layers[-1], lambda x: F.length(x) > 1), without))))
    return F.array_distinct(F.concat(*layers))


def short_pairs(t: DataFrame, v: DataFrame, cutoff: float) -> DataFrame:
    """term, variant: all pairs of at most 12 letters together and a ratio of ``cutoff``, 72 or more.

    They have a common subsequence of that ratio, which both words reach by at most three deletions, so an equality join finds it.
    """
    def kept(df: DataFrame, name: str) -> DataFrame:
        short = df.where(F.length(name) <= 12 * (1 - cutoff / 200))  # the other has cutoff / 200 of the letters at least
        return short.select(name, F.explode(_shortened(F.col(name), 3)).alias("rest")).where((200 - cutoff) * F.length("rest") >= cutoff * F.length(name))

    total = F.length("term") + F.length("variant")
    found = kept(t, "term").join(kept(v, "variant"), "rest").where((total <= 12) & (200.0 * F.length("rest") >= cutoff * total))
    return found.select("term", "variant")


def variants(terms: DataFrame, vocab: DataFrame, cutoff: float = C.FUZZY_CUTOFF, most: int = C.FUZZY_VARIANTS) -> DataFrame:
    """term, variant, ratio: up to ``most`` vocabulary terms of a ratio of ``cutoff`` or more for each missing term.

    Pairs come from equality joins, not from comparing every term with every word: on the words' two-letter pieces, and for words that
    share none, which at a ratio of 72 takes both to be short (12 letters together), on what deletions leave. Below 72 every pair is compared.
    The edit distance, a lower bound of insertions and deletions, spares Python most pairs.
    """
    def pieces(df: DataFrame, name: str) -> DataFrame:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, 2))
        return df.select(name, F.explode(F.array_distinct(grams)).alias("piece"))

    t, v = missing_terms(terms, vocab), vocab.select(F.col("term").alias("variant"))
    near = may_reach(F.col("term"), F.col("variant"), cutoff)
    if cutoff < 72:
        pairs = t.crossJoin(v).where(near)
    else:
        pairs = pieces(t, "term").join(pieces(v, "variant"), "piece").where(near).select("term", "variant").union(short_pairs(t, v, cutoff)).distinct()
    pairs = pairs.where(100 * F.levenshtein("term", "variant") <= (100 - cutoff) * (F.length("term") + F.length("variant")))
    scored = pairs.withColumn("ratio", indel("term", "variant")).where(F.col("ratio") >= cutoff)
    w = Window.partitionBy("term").orderBy(F.desc("ratio"), "variant")
    return scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
