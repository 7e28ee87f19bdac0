"""License scan by diagonal voting, in DataFrame functions only.

Every rolling gram of a text's words is joined, by hash and then by the gram itself, to the places of the templates'
grams (a broadcast table: the templates are constants).  Grams whose hash no template has are dropped before they become
rows.  A match at word p of template place t votes for the diagonal p - t.  Phrases are templates of two-word grams: a
diagonal with all of a phrase's grams is a place where its words stand consecutively.  The paragraphs of whole license texts
are templates of three-word grams, each on its own, so that a text without its first sentence is still known: their
diagonals, which words put in or left out shift, are merged with neighbours up to an eighth of the template's length apart
(``reach``, 4 at least), and a merged span counts if it covers ``COVER`` of the template's grams.  Only votes, and one row a document, are
shuffled, once, by document.

Cases.  Null or blank text: no words, no labels, score 0.  Null doc_id, rows that repeat one: each row is a document.  Very long
texts: a row a matching gram.  Repeated places: each counts.  Ties of spans: each counts.  Extra columns, whatever their names,
aren't carried.  Empty table: empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfield.llm.license_texts import PARAGRAPHS

#: Phrases and labels (fixed values).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Words of the license texts and usual license lines, and their labels.
TEXTS = tuple((" ".join(re.findall("[0-9a-z]+", text.lower())), label) for label, text in PARAGRAPHS)
COVER = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All that isn't a word's character, in lower-cased text.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text) -> F.Column:
    """A-Z lower-cased and nothing else; all-ASCII text takes the faster way to the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def reach(grams: int) -> int:
    """How far apart diagonals of a template of so many grams may lie, to be one span."""
    return max(4, grams // 8)


def template_rows() -> list[tuple]:
    """words of a gram, the gram, template, its place, gram length, grams in the template, reach, label, whether it is a phrase."""
    out = []
    for number, (text, label) in enumerate(PHRASES + TEXTS):
        words, k = text.split(), 2 if number < len(PHRASES) else 3
        n = len(words) - k + 1
        out += [(words[p : p + k], " ".join(words[p : p + k]), number, p, k, n, reach(n), label, k == 2) for p in range(n)]
    return out


def matches(k: int, hashes: list[int]):
    """Start, hash and words of the k-grams whose hash a template has."""
    parts = lambda i: [F.get("words", i + j) for j in range(k)]
    every = F.when(F.col("n") >= k, F.sequence(F.lit(0), F.col("n") - k)).otherwise(F.array().cast("array<int>"))
    found = F.filter(every, lambda i: F.xxhash64(*parts(i)).isin(hashes))
    return F.transform(found, lambda i: F.struct(i.alias("p"), F.xxhash64(*parts(i)).alias("h"), F.concat_ws(" ", *parts(i)).alias("gram")))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = spark.createDataFrame(template_rows(), "w array<string>, gram string, template int, place int, k int, of int, reach int, label string, phrase boolean")
    rows = rows.withColumn("h", F.when(F.col("k") == 2, F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1)))).otherwise(F.xxhash64(*(F.get("w", F.lit(j)) for j in range(3))))).drop("w")
    hashes = {k: sorted({r["h"] for r in rows.where(F.col("k") == k).select("h").collect()}) for k in (2, 3)}  # constants
    # the row that stands for the document itself meets a row of its own
    templates = F.broadcast(rows.drop("k").unionByName(spark.createDataFrame([("", -1, 0, 0, 0, "", False, 0)], "gram string, template int, place int, of int, reach int, label string, phrase boolean, h long")))
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    words = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.array_remove(F.split(lowered(text), GAPS), "").alias("words")).withColumn("n", F.size("words"))
    own = F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("h"), F.lit("").alias("gram"))
    every = words.select("doc_id", "row", "n", F.explode(F.concat(F.array(own), matches(2, hashes[2]), matches(3, hashes[3]))).alias("m")).select("doc_id", "row", "n", "m.*")
    votes = every.join(templates, ["h", "gram"])
    votes = votes.select("doc_id", "row", "n", "template", "place", "of", "reach", "label", "phrase", (F.col("p") - F.col("place")).alias("diagonal")).repartition("row")

    by_diagonal = votes.groupBy("row", "doc_id", "n", "template", "of", "reach", "label", "phrase", "diagonal").agg(F.collect_set("place").alias("places"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(order) > F.col("reach"))
    merged = by_diagonal.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("row", "doc_id", "n", "template", "of", "label", "phrase", "span").agg(F.min("diagonal").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"))
    share = F.when(F.col("template") < 0, 0.0).otherwise(F.col("covered") / F.col("of"))
    spans = spans.withColumn("share", share)
    base, of_text = F.col("phrase") & (F.col("covered") == F.col("of")), ~F.col("phrase") & (F.col("template") >= 0) & (F.col("share") >= COVER)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id", "n").agg(
        F.sum(F.when(base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(base | of_text).alias("labels"),
        F.max(F.when(base | of_text, F.col("share")).otherwise(0.0)).alias("score"),
    ).select("doc_id", F.col("n").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
