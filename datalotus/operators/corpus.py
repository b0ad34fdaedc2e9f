"""Corpus analytics: token counts, n-grams, TF-IDF, text metrics.

Tokens are an array column; `tokens` splits at white space, other tokenizers come
through `sources.tokenizers`. Counting is `explode` and a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from datalotus.operators.stats import median

STOPWORDS = frozenset("the a an and or of to in is are was were be for on at by with that this it as from not".split())


def tokens(c: Column, lower: bool = True) -> Column:
    return F.filter(F.split(F.lower(c) if lower else c, "\\s+"), lambda t: t != "")


def meaningful(words: Column, stopwords: frozenset[str] = STOPWORDS) -> Column:
    return F.filter(words, lambda t: ~t.isin(*sorted(stopwords)) & t.rlike("(?U)[\\p{L}\\p{Nd}]"))


def ngrams(words: Column, n: int) -> Column:
    m = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), m)
    for k in range(1, n):  # shifted copies side by side; a lambda over positions would split the text again for each
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), m), lambda a, b: F.concat_ws(" ", a, b))
    return out


def top_terms(df: DataFrame, column: str, n: int = 1, k: int = 20, stopwords: frozenset[str] = STOPWORDS) -> DataFrame:
    words = tokens(F.col(f"`{column}`"))
    terms = meaningful(words, stopwords) if n == 1 else ngrams(words, n)
    return df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k)


def text_metrics(df: DataFrame, column: str) -> DataFrame:
    """Lengths in characters and tokens."""
    c = F.col(f"`{column}`")
    rows = df.where(c.isNotNull()).select(F.length(c).alias("chars"), F.size(tokens(c)).alias("tokens"))
    m = rows.agg(F.count(F.lit(1)).alias("rows"), F.avg("chars").alias("mean_chars"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"), F.avg("tokens").alias("mean_tokens"), F.sum("tokens").alias("total_tokens"))
    return m.join(F.broadcast(median(rows, F.col("chars"), "median_chars"))).select("rows", "mean_chars", "median_chars", "min_chars", "max_chars", "mean_tokens", "total_tokens")  # one row


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    t = df.select(F.explode(tokens(F.col(f"`{column}`"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique")).withColumn("richness", F.col("unique") / F.col("total"))


def term_counts(df: DataFrame, words: str) -> DataFrame:
    """`df` with total, term and c in the place of its array `words`: one row per
    different word, counted in the row itself, so that no words are shuffled."""
    rest = [c for c in df.columns if c != words]
    s = df.select(*rest, F.size(words).alias("total"), F.sort_array(words).alias("__s"))
    # tokens are never empty, so the last position ends a run as well
    ends = F.filter(F.sequence(F.lit(1), F.col("total")), lambda i: F.element_at("__s", i) != F.coalesce(F.try_element_at("__s", i + 1), F.lit("")))
    e = s.where(F.col("total") > 0).select("*", ends.alias("__e"))
    before = F.concat(F.array(F.lit(0)), F.slice("__e", F.lit(1), F.size("__e") - 1))
    runs = F.zip_with("__e", before, lambda a, b: F.struct(F.element_at("__s", a).alias("term"), (a - b).alias("c")))
    return e.select(*rest, "total", F.inline(runs))


def tfidf(df: DataFrame, column: str, by: str | None = None, k: int = 20, id_column: str | None = None) -> DataFrame:
    """Summed tf-idf per term (and class): idf = ln((1+N)/(1+df)) + 1, tf = count/total.

    Rows of one id, class and length count as one document in df, as two rows in N.
    """
    keyed = df.where(F.col(f"`{column}`").isNotNull()).select(*([F.col(f"`{by}`").alias("class")] if by else [F.lit("all").alias("class")]), *([F.col(f"`{id_column}`").alias("doc")] if id_column else []), tokens(F.col(f"`{column}`")).alias("w")).where(F.size("w") > 0)
    n = keyed.agg(F.count(F.lit(1)).alias("docs"))
    ids = df.groupBy(F.col(f"`{id_column}`")).agg(F.count(F.lit(1)).alias("n")).where("n > 1") if id_column else None
    if ids is None or ids.isEmpty():
        counts = term_counts(keyed.drop("doc"), "w")
    else:  # the texts are shuffled once only where ids are repeated
        counts = term_counts(keyed.groupBy("class", "doc", F.size("w").alias("length")).agg(F.flatten(F.collect_list("w")).alias("w")), "w").withColumn("total", F.col("length"))
    tf = counts.groupBy("class", "term").agg(F.sum(F.col("c") / F.col("total")).alias("tf"), F.count(F.lit(1)).alias("d"))
    scored = tf.withColumn("df", F.sum("d").over(Window.partitionBy("term"))).join(F.broadcast(n)).withColumn("score", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))  # one row
    first = Window.partitionBy("class").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("class", "rank", "term", "score")


def language_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Script counters of text columns, summed: column, cells, thai, latin, digits, chars."""
    rows = []
    for c in columns:
        x = F.col(f"`{c}`")
        count = lambda p, x=x: F.coalesce(F.sum(F.regexp_count(x, F.lit(p))), F.lit(0)).cast("long")
        rows.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("cells"), count("[ก-ฮ]").alias("thai"), count("[A-Za-z]").alias("latin"), count("[0-9]").alias("digits"), F.coalesce(F.sum(F.length(x)), F.lit(0)).cast("long").alias("chars")))
    s = df.agg(F.array(*rows).alias("all")).select(F.inline("all"))
    letters = F.col("thai") + F.col("latin")
    share = F.when(letters > 0, F.col("thai") / letters)
    return s.withColumn("language", F.when(letters == 0, F.when(F.col("digits") > 0, "numeric").otherwise("empty")).when(share >= 0.7, "thai").when(share >= 0.15, "mixed").otherwise("english"))
