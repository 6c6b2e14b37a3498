"""Full-text search: analysis, postings, boolean, phrase and ranked queries.

A query over a plain table is one scan: texts are normalised once a row by a
character map, and the query's few terms are looked for as substrings between
spaces, so nothing is exploded or shuffled but the top k.  An index's postings are
written sorted by term, so that a term's row groups are the only ones read.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.porter import stem, stems

_SPLIT = r"[ \t\n\r\f]+"
#: Documents that a query of several words answers with at most.
CAP = 100
_WHITE = "\t\n\r\f"
_PUNCT = re.compile("[" + re.escape(string.punctuation) + "]")


def normal(text: Column) -> Column:
    """Lower case, white space as spaces, ASCII punctuation deleted."""
    return F.translate(F.lower(text), _WHITE + string.punctuation, " " * len(_WHITE))


@dataclass(frozen=True)
class Analyzer:
    """Lower case, ASCII punctuation deleted, split at white space, stopwords dropped, stemmed."""

    stemming: bool = True
    stopwords: tuple[str, ...] = ()

    @staticmethod
    def english() -> Analyzer:
        from pyspark.ml.feature import StopWordsRemover

        return Analyzer(True, tuple(StopWordsRemover.loadDefaultStopWords("english")))

    def column(self, text: Column) -> Column:
        """The tokens of a text; null for null."""
        words = F.split(normal(text), " ")
        stop = [_PUNCT.sub("", w) for w in self.stopwords]
        out = F.filter(words, lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")
        return stems(out) if self.stemming else out

    def terms(self, text: str) -> list[str]:
        """The same on the driver, for queries."""
        words = [w for w in re.split(_SPLIT, _PUNCT.sub("", text.lower())) if w]
        stop = {_PUNCT.sub("", w) for w in self.stopwords}
        words = [w for w in words if w not in stop]
        return [stem(w) for w in words] if self.stemming else words


PLAIN = Analyzer(stemming=False)


def has_all(tokens: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(tokens, t) for t in terms]) if terms else F.lit(False)


def boolean(query: str, holds) -> Column:
    """Operands joined by upper-case AND, OR and NOT, AND binding first; holds gives the column for an operand's words."""

    def operand(text: str) -> Column:
        text = text.strip()
        if text.startswith("NOT "):
            return ~operand(text[4:])
        return holds(text)

    parts = [reduce(lambda a, b: a & b, [operand(x) for x in part.split(" AND ")]) for part in query.split(" OR ")]
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))


def is_boolean(query: str) -> bool:
    return " AND " in query or " OR " in query or query.strip().startswith("NOT ")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: the optimizer doesn't copy what a generator makes into filters."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _has(spaced: Column, term: str) -> Column:
    """Whether a token is in normalised text that begins and ends with a space."""
    return F.contains(spaced, F.lit(f" {term} "))


def _times(spaced: Column, term: str) -> Column:
    """How often; every token gets spaces of its own first, so that neighbours don't share one."""
    apart, word = F.replace(spaced, F.lit(" "), F.lit("  ")), f" {term} "
    left = F.length(F.replace(apart, F.lit(word), F.lit("")))
    return F.when(_has(spaced, term), ((F.length(apart) - left) / len(word)).cast("int")).otherwise(0)


def _spaced(df: DataFrame, text: str) -> DataFrame:
    return _once(df, "_normal", F.concat(F.lit(" "), normal(F.col(text)), F.lit(" ")))


def _counts(df: DataFrame, text: str, terms: list[str], analyzer: Analyzer) -> DataFrame:
    """df with _tf: how often each of the terms is in the text.  Without stemming no array of tokens is made."""
    if not analyzer.stemming:
        return _once(_spaced(df, text), "_tf", F.array(*[_times(F.col("_normal"), t) for t in terms])).drop("_normal")
    tokens = _once(df, "_tokens", analyzer.column(F.col(text)))

    def times(term: str) -> Column:
        return F.coalesce(F.size(F.filter("_tokens", lambda w: w == term)), F.lit(0))

    return _once(tokens, "_tf", F.array(*map(times, terms))).drop("_tokens")


def weights(df: DataFrame, text: str, terms: list[str], analyzer: Analyzer) -> list[float]:
    """ln(N / df) of each term, N being the texts that aren't blank; 0 for terms that no text has."""
    counted = _counts(df.select(text), text, terms, analyzer)
    filled = F.count(F.when(F.length(F.trim(F.col(text))) > 0, 1)).alias("n")
    row = counted.agg(filled, *[F.count(F.when(F.col("_tf")[i] > 0, 1)).alias(f"d{i}") for i in range(len(terms))]).first()
    return [math.log(row["n"] / row[f"d{i}"]) if row[f"d{i}"] else 0.0 for i in range(len(terms))]


def ranked(df: DataFrame, key: str, text: str, query: str, k: int = 10, analyzer: Analyzer = PLAIN) -> DataFrame:
    """The k rows of greatest _score = sum of tf * ln(N / df) over the query's distinct terms; ties by key."""
    terms = sorted(set(analyzer.terms(query)))
    if not terms:
        return df.withColumn("_score", F.lit(0.0)).limit(0)
    weigh = weights(df, text, terms, analyzer)
    hit = _counts(df, text, terms, analyzer).filter(F.exists("_tf", lambda n: n > 0))
    score = reduce(lambda a, b: a + b, [F.col("_tf")[i] * F.lit(w) for i, w in enumerate(weigh)])
    return hit.withColumn("_score", score).drop("_tf").orderBy(F.desc("_score"), key).limit(k)


def contains(df: DataFrame, key: str, text: str, query: str, analyzer: Analyzer = PLAIN, cap: int = CAP) -> DataFrame:
    """A boolean query, one word, or (several words) the cap best rows of the ranked query."""
    if not is_boolean(query) and len(analyzer.terms(query)) != 1:
        return ranked(df, key, text, query, cap, analyzer).drop("_score")
    if analyzer.stemming:
        given, held = _once(df, "_tokens", analyzer.column(F.col(text))), lambda q: has_all(F.col("_tokens"), analyzer.terms(q))
        return given.filter(boolean(query, held)).drop("_tokens")

    def all_there(words: str) -> Column:
        found = [_has(F.col("_normal"), t) for t in analyzer.terms(words)]
        return reduce(lambda a, b: a & b, found) if found else F.lit(False)

    return _spaced(df, text).filter(boolean(query, all_there)).drop("_normal")


def phrase(df: DataFrame, text: str, query: str, analyzer: Analyzer = PLAIN) -> DataFrame:
    """Rows whose texts have the query's tokens one after another."""
    terms = analyzer.terms(query)
    if not terms:
        return df.limit(0)
    joined = F.array_join(analyzer.column(F.col(text)), " ") if analyzer.stemming or analyzer.stopwords else F.regexp_replace(normal(F.col(text)), " +", " ")
    given = _once(df, "_joined", F.concat(F.lit(" "), joined, F.lit(" ")))
    return given.filter(_has(F.col("_joined"), " ".join(terms))).drop("_joined")


def postings(df: DataFrame, key: str, text: str, analyzer: Analyzer = PLAIN) -> DataFrame:
    """term, doc, tf and positions (from 0); every task counts its own documents before the shuffle."""
    each = df.select(F.col(key).alias("doc"), F.posexplode(analyzer.column(F.col(text))).alias("pos", "term"))
    return each.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def write_postings(index: DataFrame, path: str) -> None:
    """Sorted by term across files and within, for pruning by min and max."""
    index.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(path)


def filled(df: DataFrame, text: str) -> int:
    """How many texts aren't blank."""
    return df.filter(F.length(F.trim(F.col(text))) > 0).count()


def index_ranked(index: DataFrame, n: int, query: str, k: int, analyzer: Analyzer) -> DataFrame:
    """doc and _score of ranked(), from the postings of the query's terms only."""
    terms = sorted(set(analyzer.terms(query)))
    mine = index.filter(F.col("term").isin(*terms)).select("term", "doc", "tf")
    weigh = {r["term"]: math.log(n / r["df"]) for r in frequencies(mine).collect()}  # a row for each term of the query
    idf = reduce(lambda a, t: a.when(F.col("term") == t, F.lit(weigh[t])), weigh, F.when(F.lit(False), F.lit(0.0)))
    return mine.groupBy("doc").agg(F.sum(F.col("tf") * idf).alias("_score")).orderBy(F.desc("_score"), "doc").limit(k)


def index_boolean(index: DataFrame, keys: DataFrame, query: str, analyzer: Analyzer) -> DataFrame:
    """doc of each document that a boolean query, or one of a single word, holds for; keys (doc) is asked only for what NOT leaves."""
    words = sorted({t for part in re.split(" AND | OR ", query) for t in analyzer.terms(re.sub(r"^(\s*NOT )+", "", part))})
    held = index.filter(F.col("term").isin(*words)).groupBy("doc").agg(F.collect_set("term").alias("_terms"))
    holds = boolean(query, lambda q: has_all(F.col("_terms"), analyzer.terms(q)))
    if re.search(r"(^|\s)NOT ", query):
        held = keys.select("doc").join(held, "doc", "left").select("doc", F.coalesce("_terms", F.expr("array()").cast("array<string>")).alias("_terms"))
    return held.filter(holds).select("doc")


def document_frequencies(df: DataFrame, text: str, analyzer: Analyzer = PLAIN) -> DataFrame:
    """term and df straight from texts: each row sends its distinct terms, which are summed before the one shuffle."""
    return df.select(F.explode(F.array_distinct(analyzer.column(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def frequencies(index: DataFrame) -> DataFrame:
    """term and df; postings hold one row for each term and document."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tf_idf(index: DataFrame, n: int) -> DataFrame:
    """term, doc, tf_idf = tf * ln(n / df)."""
    return index.join(frequencies(index), "term").select("term", "doc", (F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))).alias("tf_idf"))


def ranked_cosine(index: DataFrame, query: str, n: int, k: int = 10, analyzer: Analyzer = PLAIN) -> DataFrame:
    """doc and _score, the cosine of the query's and the document's tf-idf; 0 where either has no length."""
    from collections import Counter

    terms = Counter(analyzer.terms(query))
    weighed = tf_idf(index, n)
    norms = weighed.groupBy("doc").agg(F.sqrt(F.sum(F.col("tf_idf") * F.col("tf_idf"))).alias("norm"))
    asked = index.sparkSession.createDataFrame(list(terms.items()) or [("", 0)], "term string, qtf long")
    q = frequencies(index.filter(F.col("term").isin(*terms))).join(asked, "term").select("term", (F.col("qtf") * F.log(F.lit(float(n)) / F.col("df"))).alias("q"))
    length = sum(r["q"] ** 2 for r in q.collect()) ** 0.5  # a row for each term of the query
    dots = weighed.join(q, "term").groupBy("doc").agg(F.sum(F.col("tf_idf") * F.col("q")).alias("dot")).join(norms, "doc")
    score = F.when((F.col("norm") > 0) & F.lit(length > 0), F.col("dot") / (F.col("norm") * F.lit(length or 1.0))).otherwise(0.0)
    return dots.select("doc", score.alias("_score")).orderBy(F.desc("_score"), "doc").limit(k)


def top_terms(df: DataFrame, text: str, n: int = 10, analyzer: Analyzer = PLAIN) -> DataFrame:
    """The n terms of most documents; ties by term."""
    return document_frequencies(df, text, analyzer).orderBy(F.desc("df"), "term").limit(n)
