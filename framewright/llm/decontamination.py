"""Benchmark decontamination over a distributed positional inverted index.

1. The index: one posting (row, doc_id, term, position) for each place in the corpus of each word that a benchmark text
   holds, and one with the term ``HEADER`` for each document, whose position is its number of words. It is written once,
   by one scan of the documents, as a Parquet table in the checkpoint folder; all that follows reads its columns only.
2. Corpus frequencies of the benchmark's words are counts over the index.
3. Exact phrases. A text is cut into windows of ``window`` consecutive words (a text of fewer words is one window). The
   posting list of each window's rarest word gives places where it may start; that of the next rarest word, shifted by its
   offset, is joined with them. The places left are turned into diagonals (document position less text position), and the
   posting lists of all words of their windows, shifted likewise, are joined: runs of as many consecutive text positions
   as a window has words are its occurrences.
4. Proximity. A text is also cut into consecutive blocks of ``window`` words, the last one ending with the text. A match is
   a stretch of ``stretch`` document words that holds, in any order, at least ``near`` percent of a block's distinct words.
   Then at most d words are missing, so two of the d + 2 rarest stand in it: their lists are joined by block, and only
   where two meet the lists of all the block's words are read. A word that the corpus lacks counts as a missing one.

DataFrame functions only. Defined results: a null text has no words; a null item id or text gives no window; equal item
ids are one item; a repeated document row is a document of its own; other columns are ignored; empty tables give
documents without hits, or no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import durable, small, written

WINDOW, NEAR = 13, 80
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term of a document's header posting; no word has a separator.
HEADER = -1
_HEADER_WORD = "\x00"


def low(text: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def with_words(df: DataFrame, text: str, into: str = "words") -> DataFrame:
    """Add the words of a text, in order; a null has none. An empty piece can stand only first or last."""
    raw = df.withColumn("_raw", F.split(low(F.coalesce(F.col(text), F.lit(""))), SEPARATORS))
    first = (F.element_at("_raw", 1) == "").cast("int")
    last = (F.element_at("_raw", -1) == "").cast("int")
    return raw.withColumn(into, F.slice("_raw", first + 1, F.greatest(F.size("_raw") - first - last, F.lit(0)))).drop("_raw")


def item_words(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, terms) of the benchmark: rows (tid, item_id, n, at, term) for each word of each text, and (term, word)."""
    texts = with_words(items.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct(), "text")
    texts = durable(texts.where(F.size("words") > 0).select(F.monotonically_increasing_id().alias("tid"), "item_id", F.size("words").alias("n"), "words"))
    terms = durable(texts.select(F.explode("words").alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("term")))
    places = texts.select("tid", "item_id", "n", F.posexplode("words").alias("at", "word")).join(small(terms), "word")
    return durable(places.select("tid", "item_id", "n", "at", "term")), terms


def positional_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (row, doc_id, term, position) of ``docs`` (doc_id, text) for ``terms`` (word, term), and the headers."""
    worded = with_words(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text")), "text")
    words = worded.select("row", "doc_id", F.posexplode(F.array_append("words", F.lit(_HEADER_WORD))).alias("position", "word"))
    known = terms.union(terms.sparkSession.createDataFrame([(_HEADER_WORD, HEADER)], terms.schema))
    return written(words.join(small(known), "word").select("row", "doc_id", "term", "position"))


def _of_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    return index.join(small(terms.distinct()), "term", "left_semi")


def _of_rows(index: DataFrame, rows: DataFrame) -> DataFrame:
    return index.where(F.col("term") != HEADER).join(small(durable(rows.select("row").distinct())), "row", "left_semi").select("row", "position", "term")


def phrases(index: DataFrame, places: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (row, tid, item_id, start, stop): the longest runs of words that occurrences of a text's windows cover."""
    ranked = places.join(small(counts), "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    size = F.least(F.col("n"), F.lit(window))
    first = F.explode(F.sequence(F.greatest(F.col("at") - size + 1, F.lit(0)), F.least(F.col("at"), F.col("n") - size)))
    inside = ranked.select("tid", size.alias("size"), "at", "term", "freq", first.alias("first"))
    order = F.sort_array(F.collect_list(F.struct("freq", F.col("at"), "term")))
    windows = inside.groupBy("tid", "first", "size").agg(order.alias("order"))
    second = F.coalesce(F.get("order", F.lit(1)), F.get("order", F.lit(0)))
    windows = windows.where(F.col("order")[0]["freq"] > 0).select("tid", "first", "size", F.col("order")[0]["at"].alias("at1"), F.col("order")[0]["term"].alias("term1"), second["at"].alias("at2"), second["term"].alias("term2"))
    windows = durable(windows)
    one = _of_terms(index, windows.select(F.col("term1").alias("term")))
    met = one.join(small(windows), F.col("term") == F.col("term1")).withColumn("diagonal", F.col("position") - F.col("at1"))
    met = met.where(F.col("diagonal") + F.col("first") >= 0).select("row", "tid", "first", "size", "diagonal", "term2", (F.col("diagonal") + F.col("at2")).alias("place2"))
    two = _of_terms(index, windows.select(F.col("term2").alias("term"))).select(F.col("row").alias("row2"), "term", "position")
    met = durable(met.join(two, (F.col("row") == F.col("row2")) & (F.col("place2") == F.col("position")) & (F.col("term2") == F.col("term"))).select("row", "tid", "diagonal", "first", "size"))
    asked = met.select("row", "tid", "diagonal", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("at")).distinct()
    asked = asked.join(small(places), ["tid", "at"]).withColumn("position", F.col("diagonal") + F.col("at"))
    stand = asked.join(_of_rows(index, met), ["row", "position", "term"], "left_semi")
    run = F.col("at") - F.row_number().over(W.partitionBy("row", "tid", "diagonal").orderBy("at"))
    runs = stand.withColumn("run", run).groupBy("row", "tid", "item_id", "n", "diagonal", "run").agg(F.min("position").alias("start"), F.count("*").cast("int").alias("length"))
    return runs.where(F.col("length") >= size).select("row", "tid", "item_id", "start", (F.col("start") + F.col("length")).alias("stop"))


def proximity(index: DataFrame, places: DataFrame, counts: DataFrame, window: int = WINDOW, near: int = NEAR, stretch: int | None = None) -> DataFrame:
    """Rows (row, tid, item_id, at, start, words): stretches from document word ``start`` on that hold ``words`` of the
    distinct words of the block that starts at ``at``, ``near`` percent or more."""
    stretch = stretch or window + window // 4
    last = F.greatest(F.col("n") - window, F.lit(0))
    block = F.explode(F.array_distinct(F.filter(F.array((F.col("at") - F.col("at") % window), last), lambda b: (b <= F.col("at")) & (F.col("at") < b + window) & (b <= last))))
    words = places.select("tid", "item_id", "term", block.alias("block")).distinct().join(small(counts), "term", "left")
    rank = F.row_number().over(W.partitionBy("tid", "block").orderBy(F.coalesce("freq", F.lit(0)), "term"))
    words = words.withColumn("rank", rank).withColumn("distinct", F.count("*").over(W.partitionBy("tid", "block")))
    words = words.withColumn("need", F.ceil(F.col("distinct") * near / 100).cast("int"))
    words = durable(words.select("tid", "item_id", "block", "term", "rank", "need", (F.col("distinct") - F.col("need")).alias("spare")))
    rare = words.where(F.col("rank") <= F.col("spare") + 2)
    met = _of_terms(index, rare.select("term")).join(small(rare), "term").select("row", "tid", "block", "position", "rank", "need")
    around = W.partitionBy("row", "tid", "block").orderBy("position").rangeBetween(1 - stretch, stretch - 1)
    met = met.withColumn("_low", F.min("rank").over(around)).withColumn("_high", F.max("rank").over(around))
    met = met.where((F.col("_low") < F.col("_high")) | (F.col("need") < 2))
    # Postings lie in cells as long as a stretch; a stretch that holds the place of a meeting lies in its cell and the next ones.
    cell = F.floor(F.col("position") / stretch)
    cells = durable(met.select("row", "tid", "block", F.explode(F.sequence(cell - 1, cell + 1)).alias("cell")).distinct())
    lists = _of_rows(index, cells).withColumn("cell", cell)
    lists = cells.join(lists, ["row", "cell"]).join(small(words), ["tid", "block", "term"]).select("row", "tid", "item_id", "block", "position", "rank", "need")
    onwards = W.partitionBy("row", "tid", "item_id", "block").orderBy("position").rangeBetween(0, stretch - 1)
    found = lists.withColumn("words", F.size(F.collect_set("rank").over(onwards))).where(F.col("words") >= F.col("need"))
    return found.select("row", "tid", "item_id", F.col("block").alias("at"), F.col("position").alias("start"), "words")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, phrases, proximity): the rows of ``docs`` (row, doc_id, n_words), and what was found in them."""
    places, terms = item_words(items)
    index = positional_index(docs, terms)
    counts = durable(index.where(F.col("term") != HEADER).groupBy("term").agg(F.count("*").alias("freq")))
    rows = index.where(F.col("term") == HEADER).select("row", "doc_id", F.col("position").alias("n_words"))
    return rows, phrases(index, places, counts, window), proximity(index, places, counts, window, near)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near_items.

    A word is hit if it stands in an occurrence of a window; a document is contaminated if at least one word in twenty is.
    ``n_near_items`` counts the items with a proximity match and no exact one.
    """
    rows, exact, close = matches(docs, items, window, near)
    found = exact.select("row", "item_id", F.struct("start", "stop").alias("span")).union(close.select("row", "item_id", F.lit(None).cast("struct<start:int,stop:int>")).distinct())
    item = F.col("item_id").cast("string")
    spans, ids = F.array_sort(F.collect_set("span")), F.collect_set(F.when(F.col("span").isNotNull(), item))
    grouped = found.groupBy("row").agg(spans.alias("spans"), ids.alias("ids"), F.collect_set(item).alias("near_ids"))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["to"], x["stop"]).alias("to"), (acc["n"] + F.greatest(x["stop"] - F.greatest(x["start"], acc["to"]), F.lit(0))).alias("n"))
    grouped = grouped.select("row", F.aggregate("spans", start, step)["n"].alias("n_hit"), F.array_sort("ids").alias("ids"), F.size(F.array_except("near_ids", "ids")).cast("long").alias("n_near_items"))
    out = rows.join(small(durable(grouped)), "row", "left").select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near_items")


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) whose id has no contaminated text."""
    gone = durable(contamination(docs, items, **options).where("contaminated").select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti")
