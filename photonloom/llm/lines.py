"""Line deduplication by a deletion-neighbourhood join, with built-in expressions only.

A line is compared by its words, A-Z in lower case. A line goes if the same line, or one within an edit of one word
(replaced, inserted or deleted), stands earlier in the corpus, by (doc_id, line number); the earlier one need not stay
itself. Lines of fewer than NEAR_WORDS words go only if an equal line is earlier; blank lines stay.

Every variant of a line with one word deleted is a hashed key. Lines of equal length within one replacement share the
variant at the place of the change; a line and one that is a word shorter share the shorter itself. Keys are joined to
the earliest line of each key, never pair by pair, and the edit distance of line and earliest is verified on the words.
Before variants are made, lines are set aside that can have no partner: of two lines within one edit, the longer one with
N words, either the first or the last (N - 1) / 2 words agree, so a line that shares neither half with a line of about its
length has none.

Keys are hashes of 64 bits and lines are counted as equal by two of them.

Defined results: a null text stays null; rows that share id and text stay alike; rows that share an id only are ordered
by their text's hash; null ids come first; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import let, packed, prefix_sums, stored, sum_of, unpacked
from photonloom.llm.decontaminate import lowered

NEAR_WORDS = 8
#: Documents with lines to verify are picked by a broadcast of their keys when they have been counted and are no more.
BROADCAST_ROWS = 1_000_000
NO_ID = -(1 << 63)
_KEY = ["_doc", "text_key"]


def normal(text: Column) -> Column:
    """A-Z in lower case, and one space for each run of white space within a line."""
    low = lowered(text)
    uneven = [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\f", "\r")]
    return F.when(uneven[0] | uneven[1] | uneven[2] | uneven[3] | uneven[4], F.regexp_replace(low, r"[ \t\x0B\f\r]+", " ")).otherwise(low)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def _halves(t: Column, n: Column) -> list[Column]:
    """Short hashes of the halves that t shares with a partner within one edit, if the longer one has n or n + 1 words."""
    half = lambda length, side: F.hash(length, F.lit(side), F.call_function("substring_index", t, F.lit(" "), F.floor((length - 1) / 2).cast("int") * side))
    return [half(n, 1), half(n, -1), half(n + 1, 1), half(n + 1, -1)]


def occurrences(docs: DataFrame) -> DataFrame:
    """Stored, one row per line with words: place, two hashes, number of words, hashes of its halves."""
    each = _keyed(docs.select("doc_id", "text")).select(*_KEY, F.posexplode(split_lines(normal(F.col("text")))).alias("line", "raw")).select(*_KEY, "line", F.trim("raw").alias("t")).where("t <> ''")
    each = each.withColumn("n", F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1)
    halves = F.when(F.col("n") >= NEAR_WORDS, F.array(*_halves(F.col("t"), F.col("n"))))
    return stored(each.select(*_KEY, "line", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), halves.alias("halves")), "lines")


def distinct_lines(occ: DataFrame) -> DataFrame:
    """Stored, one row per different line: its first place and how often it occurs."""
    half = [F.min(F.col("halves")[i]).alias(f"half{i}") for i in range(4)]
    return stored(occ.groupBy("h1", "h2").agg(F.min(F.struct(*_KEY, "line")).alias("first"), F.count("*").alias("times"), *half), "distinct-lines")


def with_possible_partner(distinct: DataFrame) -> DataFrame:
    """Lines long enough for an edit that share a half with a different line of about their length."""
    long = distinct.where("half0 IS NOT NULL")
    halves = long.select("h1", "h2", F.explode(F.array(*[F.col(f"half{i}") for i in range(4)])).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("k")).where("k > 1").select("half")
    return halves.join(shared, "half").select("h1", "h2").distinct().join(long, ["h1", "h2"]).select("h1", "h2", "first")


def _fetch(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The words of lines, read at their first places."""
    places = stored(lines.select("first.*", "h1", "h2", "first").groupBy(*_KEY).agg(F.collect_list(F.struct("line", "h1", "h2", "first")).alias("own")), "places")
    rows = _keyed(docs.select("doc_id", "text")).select(*_KEY, "text")
    if places.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(places.select(*_KEY)), _KEY, "left_semi")
    each = rows.join(places, _KEY).select(let(split_lines(normal(F.col("text"))), lambda s: F.transform("own", lambda o: F.struct(o["h1"].alias("h1"), o["h2"].alias("h2"), o["first"].alias("first"), F.split(F.trim(s[o["line"]]), " ").alias("w")))).alias("o"))
    return each.select(F.explode("o").alias("o")).select("o.*").dropDuplicates(["h1", "h2"])


def _variants(w: Column) -> Column:
    """Array of (kind, key): kind 0 and 1 for each deletion, with and without its place; kind 2 for the line itself.
    A key is the XOR of the 64-bit hashes of words with their places, so that a deletion is a prefix and a shifted suffix."""
    def xor(a: Column, b: Column) -> Column:
        return a.bitwiseXOR(b)

    def placed(shift: int) -> Column:
        return F.transform(w, lambda x, i: F.xxhash64(x, i - shift))

    def deletions(here: Column, moved: Column) -> Column:
        parts = F.struct(prefix_sums(here, add=xor).alias("p"), prefix_sums(moved, add=xor).alias("q"), sum_of(moved, xor).alias("t"))
        body = let(parts, lambda s: F.transform(w, lambda _, i: xor(xor(s["p"][i], s["t"]), xor(s["q"][i], moved[i]))))
        keys = let(body, lambda b: F.flatten(F.transform(b, lambda k, i: F.array(
            F.struct(F.lit(0).alias("kind"), F.xxhash64(F.lit(0), F.size(w), k, i).alias("key")), F.struct(F.lit(1).alias("kind"), F.xxhash64(F.lit(1), F.size(w) - 1, k).alias("key"))))))
        return F.concat(keys, F.array(F.struct(F.lit(2).alias("kind"), F.xxhash64(F.lit(1), F.size(w), sum_of(here, xor)).alias("key"))))

    return let(placed(0), lambda here: let(placed(1), lambda moved: deletions(here, moved)))


def _within_one(a: Column, b: Column) -> Column:
    """Word sequences within one edit: equal but for one place, or equal once the longer one's first difference is
    left out."""
    def differs(x: Column, y: Column) -> Column:
        return F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d))

    def left_out(x: Column, y: Column) -> Column:
        at = F.coalesce(F.array_position(F.zip_with(F.slice(x, 1, F.size(y)), y, lambda p, q: p != q), True).cast("int"), F.lit(0))
        return let(F.when(at == 0, F.size(x)).otherwise(at), lambda k: F.concat(F.slice(x, 1, k - 1), F.slice(x, k + 1, F.size(x))) == y)

    return F.when(F.size(a) == F.size(b), differs(a, b) <= 1).when(F.size(a) == F.size(b) + 1, left_out(a, b)).when(F.size(b) == F.size(a) + 1, left_out(b, a)).otherwise(False)


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of the lines of which an earlier line is within one edit. A candidate has one number, in the order of the corpus:
    it stands for the line in all its variants."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many tasks for the variants, however few bytes the lines have
    place = [F.col(f"first.{c}") for c in (*_KEY, "line")]
    own = _fetch(docs, stored(with_possible_partner(distinct), "partners")).repartitionByRange(parts, *place).sortWithinPartitions(*place)
    own = stored(own.select(F.monotonically_increasing_id().alias("no"), "h1", "h2", "w"), "candidates")
    made = stored(own.select("no", F.explode(_variants(F.col("w"))).alias("v")).select("no", F.col("v.kind").cast("byte").alias("kind"), "v.key"), "variants")
    # Replacements meet replacements; deletions meet the lines themselves. Keys of one line only are left out.
    of = lambda f, kind: f(F.when(F.col("kind") == kind, F.col("no")))
    met = made.groupBy("key").agg(of(F.min, 0).alias("e0"), of(F.max, 0).alias("x0"), of(F.min, 1).alias("e1"), of(F.min, 2).alias("e2")).where("e0 <> x0 OR (e1 IS NOT NULL AND e2 IS NOT NULL)")
    pairs = made.join(met, "key").select("no", F.when(F.col("kind") == 0, F.col("e0")).when(F.col("kind") == 1, F.col("e2")).otherwise(F.col("e1")).alias("earlier")).where("earlier < no").distinct()
    return pairs.join(own, "no").join(own.select(F.col("no").alias("earlier"), F.col("w").alias("x")), "earlier").where(_within_one(F.col("w"), F.col("x"))).select("h1", "h2").distinct()


def dropped(docs: DataFrame) -> DataFrame:
    """(_doc, text_key, gone, n_near): the lines to drop in each document, and how many of them only for an edit."""
    occ = occurrences(docs)
    distinct = distinct_lines(occ)
    near = near_lines(docs, distinct).withColumn("near", F.lit(True))
    marked = stored(distinct.join(near, ["h1", "h2"], "left").where("times > 1 OR near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "marked")
    hit = occ.select(*_KEY, "line", "h1", "h2").join(marked, ["h1", "h2"]).withColumn("again", F.struct(*_KEY, "line") != F.col("first")).where("again OR near")
    return hit.groupBy(*_KEY).agg(F.array_sort(F.collect_set("line")).alias("gone"), F.count_distinct(F.when(~F.col("again"), F.col("line"))).alias("n_near"))


def _rest(docs: DataFrame) -> DataFrame:
    """The packed documents with `kept`, the text without the dropped lines, n_lines, n_dropped and n_near."""
    lines = split_lines(F.col("text"))
    ends = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(lines)))
    rest = let(lines, lambda s: let(ends, lambda e: F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.slice(s, e[i - 1] + 2, e[i] - e[i - 1] - 1)))))
    joined = _keyed(packed(docs)).join(dropped(docs), _KEY, "left")
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)), "n_dropped": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")), "n_near": F.coalesce("n_near", F.lit(0))}
    return joined.select("_row", "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("kept"), *[v.cast("long").alias(k) for k, v in counts.items()])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without the dropped lines, all columns kept."""
    return unpacked(_rest(docs), docs.columns, F.col("kept"))


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_near and the hash of the remaining text of every document."""
    return _rest(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
