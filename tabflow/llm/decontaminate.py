"""Benchmark decontamination with a positional inverted index (DataFrame functions only).

* Test windows: every run of ``width`` words of an item; a shorter item is one window.
* The index stores the postings (term, key, position) of every word of the test items in
  all documents, and each document's length, as a Parquet table in the shared folder:
  one reading of the corpus, no shuffle.  Term counts are counted from the index.
* A window whose words do not all occur has no match.  The lists of a window's ``rarest``
  rarest terms are intersected, shifted by the term's place in the item (position -
  place): equal shifts of one item in one document mean aligned terms.  With ``slop`` > 0
  shifts are put into overlapping bands, so that any ``slop`` + 1 neighbouring shifts
  share one.
* Candidates are compared with the document's words at that place, so phrase and
  proximity matches are both exact.

The test side is broadcast only if it has at most ``BROADCAST_ROWS`` rows, else joined
by shuffle.  The corpus is read twice, for the index and where candidates meet their
documents by row key; postings of rare terms are shuffled once.

Defined cases: null text has no words, such an item no window; equal rows are equal
results; an item occurring in several rows counts once by its id (a null id is '');
an empty table gives an empty result, no items give no hits; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import row_hash
from tabflow.session import materialize, scratch_path

WIDTH = 13
RAREST = 3
BROADCAST_ROWS = 1_000_000
END = "\0end"                       # marks a document's length in the index; no word holds a zero byte
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else (the plain ``lower`` where no other character has a lower case)."""
    odd = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]")
    return F.when(odd, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words(text_col: str) -> Column:
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return F.array_remove(F.split(text, _BREAK), "")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a test-side table if its row count is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def test_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, item_words, start, len): the windows of the test items."""
    listed = (items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"),
                           words(text_col).alias("item_words"))
              .dropDuplicates().withColumn("item", F.xxhash64("item_id", "item_words"))
              .filter(F.size("item_words") > 0))
    last = F.greatest(F.size("item_words") - width, F.lit(0))
    return (listed.withColumn("start", F.explode(F.sequence(F.lit(0), last)))
            .withColumn("len", F.least(F.size("item_words"), F.lit(width))))


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): lengths of the posting lists."""
    return index.filter(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def plan_windows(windows: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """Windows all of whose terms occur, with ``need``: places in the item of their rarest terms."""
    place = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))
    each = (windows.select("item", "start", "len", "item_words", place.alias("place"))
            .withColumn("term", F.get("item_words", F.col("place"))).drop("item_words")
            .join(counts, "term"))
    return (each.groupBy("item", "start", "len")
            .agg(F.array_sort(F.collect_list(F.struct("n", "term", "place"))).alias("by_rarity"))
            .filter(F.size("by_rarity") == F.col("len"))
            .select("item", "start", "len",
                    F.slice("by_rarity", 1, rarest).alias("rare"))
            .withColumn("need", F.transform("rare", lambda r: r["place"])))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (term, key, pos, doc_id) of ``terms``, in the order of the rows; one END posting per row stands
    at its length and alone has the id."""
    wanted = _small(terms.select("term").distinct().union(
        terms.sparkSession.createDataFrame([(END,)], "term string")))
    tokens = docs.select(F.col(id_col).alias("doc_id"), row_hash(id_col, text_col).alias("key"),
                         F.posexplode(F.concat(words(text_col), F.array(F.lit(END)))).alias("pos", "term"))
    postings = tokens.join(wanted, "term").select("term", "key", "pos", F.when(F.col("term") == END, F.col("doc_id"))
                                                  .alias("doc_id"))
    path = scratch_path(docs.sparkSession, "postings")
    postings.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def candidates(index: DataFrame, plan: DataFrame, slop: int = 0) -> DataFrame:
    """(key, item, start, len, base): windows whose rare terms meet on one shift, or for ``slop`` > 0 in a band of
    2 * (slop + 1) shifts; ``base`` is the document place of the window's first word for the band's first shift."""
    rare = plan.select("item", F.explode("rare").alias("r")).select(
        "item", F.col("r.term").alias("term"), F.col("r.place").alias("place")).distinct()
    shifted = (index.filter(F.col("term") != END).join(_small(rare), "term")
               .select("key", "item", "place", (F.col("pos") - F.col("place")).alias("shift")))
    band = F.floor(F.col("shift") / (slop + 1)).cast("long")
    shifted = shifted.withColumn("band", F.explode(F.array(band, band - 1)) if slop else band)
    met = shifted.groupBy("key", "item", "band").agg(F.collect_set("place").alias("places"))
    by_item = plan.groupBy("item").agg(F.collect_list(F.struct("start", "len", "need")).alias("windows"))
    held = F.filter("windows", lambda w: F.size(F.array_except(w["need"], F.col("places"))) == 0)
    return (met.join(_small(by_item), "item").withColumn("w", F.explode(held))
            .select("key", "item", F.col("w.start").alias("start"), F.col("w.len").alias("len"),
                    (F.col("band") * (slop + 1) + F.col("w.start")).alias("base")))


def _beside(docs: DataFrame, found: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_words, item_words, item_id, f): candidates ``f`` with the words of both sides."""
    per_row = found.groupBy("key").agg(F.collect_set(F.struct("item", "start", "len", "base")).alias("found"))
    phrase = windows.select("item", "item_id", "item_words").dropDuplicates(["item"])
    texts = docs.select(row_hash(id_col, text_col).alias("key"), F.col(text_col).alias("text")) \
        .join(per_row, "key").dropDuplicates(["key"])
    return (texts.select("key", words("text").alias("doc_words"), "found")
            .withColumn("f", F.explode("found")).withColumn("item", F.col("f.item")).join(_small(phrase), "item"))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 8, width: int = WIDTH, rarest: int = RAREST,
                      id_col: str = "doc_id", text_col: str = "text", **cols) -> DataFrame:
    """(key, item_id, start, len): windows all of whose words stand in the row near their places: the shifts (place in
    the row less place in the window) span at most ``slop``.  A word of the row may serve equal words of a window;
    ``key`` is ``row_hash`` of the row."""
    windows, plan, index = _prepare(docs, items, width, rarest, id_col, text_col, **cols)
    beside = _beside(docs, candidates(index, plan, slop), windows, id_col, text_col)
    # a match starts at one of the slop + 1 shifts of the first half of its band
    word_at = lambda i, d: F.get("doc_words", (F.col("f.base") + i + d).cast("int")).eqNullSafe(
        F.get("item_words", F.col("f.start") + i))
    matched = F.exists(F.sequence(F.lit(0), F.lit(slop)), lambda b: F.forall(
        F.sequence(F.lit(0), F.col("f.len") - 1), lambda i: F.exists(
            F.sequence(b, b + slop), lambda d: word_at(i, d))))
    return beside.filter(matched).select("key", "item_id", "f.start", "f.len").distinct()


def _prepare(docs, items, width, rarest, id_col="doc_id", text_col="text",
             item_id_col="item_id", item_text_col="text"):
    windows = materialize(test_windows(items, width, item_id_col, item_text_col))
    index = build_index(docs, windows.select(F.explode("item_words").alias("term")), id_col, text_col)
    return windows, materialize(plan_windows(windows, term_counts(index), rarest)), index


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, rarest: int = RAREST,
                   id_col: str = "doc_id", text_col: str = "text", **cols) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_words, ``matches`` (array of item_id, base, len: exact
    occurrences of test windows)."""
    windows, plan, index = _prepare(docs, items, width, rarest, id_col, text_col, **cols)
    here = F.slice("doc_words", F.col("f.base").cast("int") + 1, F.col("f.len"))
    there = F.slice("item_words", F.col("f.start") + 1, F.col("f.len"))
    found = candidates(index, plan).filter(F.col("base") >= 0)
    exact = (_beside(docs, found, windows, id_col, text_col).filter(here == there)
             .groupBy("key").agg(F.collect_list(
                 F.struct("item_id", F.col("f.base").cast("int").alias("base"), F.col("f.len").alias("len"))).alias("matches")))
    lengths = index.filter(F.col("term") == END).select("doc_id", "key", F.col("pos").cast("long").alias("n_words"))
    return lengths.join(exact, "key", "left")


def contamination(docs: DataFrame, items: DataFrame, per: int = 20, **options) -> DataFrame:
    """Per row: n_words, n_hit (words inside a test window's occurrence), n_items, items (sorted ids) and
    ``contaminated`` (n_hit > 0 and per * n_hit >= n_words)."""
    found = phrase_matches(docs, items, **options)
    place = F.flatten(F.transform("matches", lambda m: F.sequence(m["base"], m["base"] + m["len"] - 1)))
    none = F.array().cast("array<string>")
    items_of = F.coalesce(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))), none)
    hit = F.coalesce(F.size(F.array_distinct(place)), F.lit(0))
    hit = F.when(F.col("matches").isNull(), F.lit(0)).otherwise(hit).cast("long")
    return (found.select("doc_id", "key", "n_words", hit.alias("n_hit"), items_of.alias("items"))
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (per * F.col("n_hit") >= F.col("n_words"))))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """Rows that are not contaminated; columns as given."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, **options) \
        .filter("contaminated").select(F.col("key").alias("_bad")).distinct()
    return docs.join(bad, row_hash(id_col, text_col) == F.col("_bad"), "left_anti").select(*docs.columns)
