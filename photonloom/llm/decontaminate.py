"""Benchmark passages in training texts, by a positional inverted index and built-in expressions only.

The index holds the postings (document, position) of every word that the benchmark has, stored once. Each window of an
item is looked up from its rarest words: the postings of its rarest and second rarest word are shifted by their offsets
in the window and intersected; in the few documents that are left, the postings of all its words have to agree. Phrase
matches are exact; `near` returns places where all words of an item's window lie within a span, in any order.

Words: A-Z in lower case, runs of ASCII letters, digits and non-ASCII characters. An item with fewer than `window` words
is one window.

Defined results: a null text has no words; an item without words never matches; items with equal ids are one item; rows
that share id and text are found alike; an empty table on either side finds nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonloom.llm.common import doc_key, packed, stored, unpacked

WINDOW = 10
#: A table of benchmark words or of document keys is broadcast when it has been counted and is no larger; beyond it joins
#: shuffle.
BROADCAST_ROWS = 200_000
# What separates words, and the letters that change case.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast if its counted rows are within the bound."""
    df = stored(df, "terms")
    return F.broadcast(df) if df.count() <= bound else df


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: wid, size, words, items (the ids of items that have it)."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    each = words.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("items")).select(F.xxhash64(F.concat_ws(" ", "words")).alias("wid"), F.size("words").alias("size"), "words", "items")


def read_words(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored postings (doc_id, text_key, pos, term) of the given words (word, term), and (doc_id, text_key, n_words) of
    every row; rows of one document stay together, texts are read once, and nothing is shuffled. The empty word, which
    no text has, stands at the end of each text; its place is the number of words."""
    each = docs.select(*doc_key(), F.posexplode(F.array_append(words_of(F.col("text")), F.lit(""))).alias("pos", "word"))
    written = stored(each.join(terms, "word").select("doc_id", "text_key", "pos", "term"), "postings")
    return written.where("term IS NOT NULL"), written.where("term IS NULL").select("doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the given words alone."""
    return read_words(docs, terms)[0]


def _offsets(windows: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, size, off, term, place): the words of each window, from the rarest in the index; places start at 1."""
    each = windows.select("wid", "size", F.posexplode("words").alias("off", "word")).join(terms, "word").join(counts, "term", "left")
    rare = Window.partitionBy("wid").orderBy(F.coalesce("n", F.lit(0)), "term", "off")
    return each.select("wid", "size", "off", "term", F.row_number().over(rare).alias("place"), F.coalesce("n", F.lit(0)).alias("n"))


def phrase_matches(postings: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_key, wid, size, start) of every occurrence of a window. A window with a word that no document has
    isn't looked up."""
    counts = stored(postings.groupBy("term").agg(F.count("*").alias("n")), "counts")
    places = _offsets(windows, terms, counts)
    places = small(places.withColumn("least", F.min("n").over(Window.partitionBy("wid"))).where("least > 0").drop("n", "least"))
    key = ["_doc", "text_key", "wid", "start"]

    def shifted(place: int) -> DataFrame:
        own = places.where(F.col("place") == place).select("term", "wid", "off", "size")
        return postings.join(own, "term").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc"), "text_key", "wid", (F.col("pos") - F.col("off")).alias("start"), "size").where("start >= 0")

    # Rows that share id and text have each posting several times.
    rarest = shifted(1).dropDuplicates(key)
    both = stored(rarest.where("size > 1").join(shifted(2).select(*key).distinct(), key).unionByName(rarest.where("size = 1")), "rarest")
    # The other words, in the documents that are left: at each place of a candidate its word is looked up.
    asked = both.join(places.where("place > 2").drop("size"), "wid").select(*key, "size", (F.col("start") + F.col("off")).alias("pos"), "term")
    docs = small(both.select("_doc", "text_key").distinct())
    there = postings.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc"), "text_key", "pos", "term").join(docs, ["_doc", "text_key"], "left_semi").distinct()
    held = asked.join(there, ["_doc", "text_key", "pos", "term"]).groupBy(*key, "size").agg(F.count("*").alias("n")).where("n = size - 2").drop("n")
    return held.select(*key, "size").unionByName(both.where("size <= 2").select(*key, "size"))


def near(postings: DataFrame, windows: DataFrame, terms: DataFrame, span: int) -> DataFrame:
    """Proximity: (doc_id, text_key, wid, start) where all distinct words of a window lie within `span` words from the
    position of its rarest word on either side. Words meet within one document and one stretch of it, the rarest first; each further
    word is looked up only around the places that are left."""
    counts = stored(postings.groupBy("term").agg(F.count("*").alias("n")), "counts")
    places = _offsets(windows, terms, counts)
    places = small(places.withColumn("least", F.min("n").over(Window.partitionBy("wid"))).where("least > 0").groupBy("wid", "term").agg(F.min("place").alias("place")))
    need = places.groupBy("wid").agg(F.count("*").alias("need"))
    key, doc = ["_doc", "text_key", "wid", "start"], F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc")
    anchors = postings.join(places.where("place = 1").select("wid", "term"), "term").select(doc, "text_key", "wid", F.col("pos").alias("start")).distinct()
    cells = anchors.withColumn("cell", F.explode(F.array(*[F.floor(F.col("start") / span).cast("int") + d for d in (-1, 0, 1)])))
    there = postings.select(doc, "text_key", F.col("pos").alias("p"), "term", F.floor(F.col("pos") / span).cast("int").alias("cell"))

    def met(at: DataFrame, which: str) -> DataFrame:
        asked = at.join(places.where(which).select("wid", "term"), "wid")
        return asked.join(there, ["_doc", "text_key", "term", "cell"]).where(F.abs(F.col("p") - F.col("start")) < span).select(*key, "term").distinct()

    second = places.where("place > 1").groupBy("wid").agg(F.min("place").alias("place"))
    places = small(places.join(second.withColumnRenamed("place", "second"), "wid", "left"))
    left = stored(met(cells, "place = second").select(*key), "near").join(cells, key).unionByName(cells.join(need.where("need = 1").select("wid"), "wid", "left_semi"))
    found = met(left, "place > 0").groupBy(*key).agg(F.count("*").alias("n")).join(need, "wid").where("n = need")
    return found.select(F.when(F.col("_doc") != -(1 << 63), F.col("_doc")).alias("doc_id"), "text_key", "wid", "start")


def benchmark_terms(windows: DataFrame) -> DataFrame:
    """(word, term) of the windows' words, and the empty word without a term."""
    words = windows.select(F.explode("words").alias("word")).distinct().select("word", F.xxhash64("word").alias("term"))
    return small(words.unionByName(windows.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(None).cast("long").alias("term"))))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences of windows (`_doc`: the id with null as the smallest number), the windows themselves, and the number of
    words of every row."""
    windows = stored(item_windows(benchmark, window), "windows")
    terms = benchmark_terms(windows)
    postings, sizes = read_words(docs, terms)
    return stored(phrase_matches(postings, windows, terms), "matches"), windows, sizes


def hits(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Per document with a match: words inside matches, and the items as sorted strings."""
    at = found.select("_doc", "text_key", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct().groupBy("_doc", "text_key").agg(F.count("*").alias("n_hit"))
    of = found.select("_doc", "text_key", "wid").distinct().join(windows.select("wid", F.explode("items").alias("item")), "wid").select("_doc", "text_key", "item").distinct()
    items = of.groupBy("_doc", "text_key").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    return at.join(items, ["_doc", "text_key"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items of every document."""
    found, windows, sizes = matches(docs, benchmark, window)
    out = sizes.withColumn("_doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(hits(found, windows), ["_doc", "text_key"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def summary(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a match, all columns kept."""
    found, _, _ = matches(docs, benchmark, window)
    rows = packed(docs).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    return unpacked(rows.join(small(found.select("_doc", "text_key").distinct()), ["_doc", "text_key"], "left_anti"), docs.columns)
