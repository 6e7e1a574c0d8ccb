"""Keywords of documents and of the corpus."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.text import KEYWORD_TOKEN, STOPWORDS, keyword_tokens


def keyword_source(title: Column, headings: Column, tags: Column, content: Column) -> Column:
    """The text from which a document's keywords come."""
    return F.concat_ws(" ", title, F.array_join(headings, " "), F.array_join(tags, " "), content)


@pandas_udf(ArrayType(StructType([StructField("word", StringType()), StructField("n", LongType())])))
def _most_frequent(texts: pd.Series, n: pd.Series) -> pd.Series:
    token, stop = re.compile(KEYWORD_TOKEN), frozenset(STOPWORDS)
    own = lambda t: [w for w in token.findall(t.lower()) if len(w) >= 3 and w not in stop and not w.isdigit()]
    return pd.Series([[{"word": w, "n": c} for w, c in Counter(own(t or "")).most_common(k)] for t, k in zip(texts, n)])


def document_keywords(df: DataFrame, text: str = "text", n: int = 25) -> DataFrame:
    """``df`` with keywords: its n most frequent tokens, ties by first occurrence; inside the row, without a shuffle.

    Arrow batches: as an expression the counts would be a fold that copies its result for every token.
    """
    return df.withColumn("keywords", F.transform(_most_frequent(F.col(text), F.lit(n)), lambda k: k["word"]))


def ranked_keywords(df: DataFrame, id_: str = "doc_id", text: str = "text", n: int = 25) -> DataFrame:
    """(id, rank, word, n): a row a keyword of each row; a scan without a shuffle."""
    each = df.select(F.col(id_).alias("id"), F.posexplode(_most_frequent(F.col(text), F.lit(n))).alias("rank", "k"))
    return each.select("id", (F.col("rank") + 1).alias("rank"), F.col("k.word").alias("word"), F.col("k.n").alias("n"))


def counted_keywords(df: DataFrame, id_: str = "doc_id", text: str = "text", n: int = 25) -> DataFrame:
    """The same of each id, which may have several rows, in DataFrame functions; counts combine by id and word.

    The texts are shuffled, by id, instead of their words with ids, places and counts: twice, by (id, word) and by id.
    """
    rows = df.select(F.col(id_).alias("id"), F.col(text).alias("text")).repartition("id")
    each = rows.select("id", F.posexplode(keyword_tokens(F.coalesce("text", F.lit("")))).alias("pos", "word"))
    counted = each.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    own = counted.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "word"))), 1, n).alias("top"))
    return own.select("id", F.posexplode("top").alias("rank", "t")).select("id", (F.col("rank") + 1).alias("rank"), F.col("t.word").alias("word"), (-F.col("t.m")).alias("n"))


def keyword_cloud(df: DataFrame, keywords_json: str = "keywords", order: str = "id", n: int = 25) -> DataFrame:
    """(word, n) of the keywords that most rows have; a row's list is JSON, and a malformed one counts for nothing.

    Ties go to the word seen first in the order of ``order``.
    """
    lists = df.select(F.col(order).alias("o"), F.from_json(keywords_json, "array<string>").alias("ws"))
    each = lists.select("o", F.posexplode("ws").alias("pos", "word")).where("word IS NOT NULL")
    counted = each.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("o", "pos")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(n).select("word", "n")


def distinct_headings(headings: Column, n: int = 20) -> Column:
    """The different ones of the first n headings, in order."""
    return F.array_distinct(F.slice(headings, 1, n))
