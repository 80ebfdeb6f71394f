"""Document fingerprints from closed syncmers, with Spark expressions only.

A text is a sequence of words: stretches without white space, of which those over ``PIECE`` characters
(Chinese, Japanese, Thai, encoded lines) are cut before two characters whose hash is less than that of
the pair before and at most that of the ``NEAR`` pairs on each side, so that an insertion moves the cuts
beside it only. A longer piece without such a place, as of one repeated character, is cut every
``PIECE`` characters from its own beginning. A run of
``K`` words is chosen if the smallest hash among its words stands at one of its two ends: whether a
run is chosen depends on the run alone, so an edit disturbs only the runs that touch it. The
fingerprint lists position and hash of every chosen run in text order.

Two fingerprints are matched by position without regard to where a text begins: beside the anchors
themselves, the marks of a text are its links, one for each two anchors in a row, made of both hashes
and the number of words between them. A shared link is a place at which both texts have the same
anchors at the same distance; moved, repeated or scattered runs share anchors but no links. The likeness
is the Jaccard similarity of the sets of marks.

Defined cases: a null text is an empty one; a text of fewer than K words has one anchor, the hash of
all its words, at position 0, and so has the fingerprint of a longer text without a chosen run (5 to 7
words with K = 5); a text without words has none, and two such fingerprints have likeness 1; equal texts
have equal fingerprints; texts of any length are taken whole; further columns, whatever their names, are
ignored. The following document is the next in descending id order, null ids last;
documents with equal ids follow each other by a hash of their text; rows that repeat id and text
stand in the chain once and get the same result; a lone document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.llm.common import WORD, staged, table, text_or_empty

K = 5
PIECE = 32
NEAR = 3
HASH = 1 << 31  # an anchor is its position times this, plus its hash
RANGE = 1_000_000  # texts in a range of the chain


def _hashes(text: Column) -> Column:
    """array<long>: hashes of the words of ``text``."""

    def pieces(words: Column) -> Column:
        several = F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) > PIECE, _cut(w)).otherwise(F.array(w))))
        return F.when(F.exists(words, lambda w: F.char_length(w) > PIECE), several).otherwise(words)

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.transform(F.transform(F.array(words), pieces)[0], lambda w: F.xxhash64(w))


def _cut(stretch: Column) -> Column:
    """array<string>: the pieces of a stretch of over ``PIECE`` characters, cut by its content."""

    def places(chars: Column, pairs: Column) -> Column:
        def lowest(i: Column) -> Column:
            own = F.get(pairs, i)
            return (own < F.get(pairs, i - 1)) & (own <= F.least(*(F.get(pairs, i + j) for j in range(-NEAR, NEAR + 1) if j)))

        ends = F.array(F.size(chars))
        return F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(NEAR), F.size(pairs) - 1 - NEAR), lowest), ends)

    def between(chars: Column, cuts: Column) -> Column:
        def piece(j: Column) -> Column:
            start, end = F.get(cuts, j), F.get(cuts, j + 1)
            return F.transform(F.sequence(start, end - 1, F.lit(PIECE)), lambda at: F.array_join(F.slice(chars, at + 1, F.least(F.lit(PIECE), end - at)), ""))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), piece))

    def cut(chars: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(chars) - 2), lambda i: F.xxhash64(F.get(chars, i), F.get(chars, i + 1)))
        cuts = F.transform(F.array(pairs), lambda hashes: places(chars, hashes))[0]
        return F.transform(F.array(cuts), lambda found: between(chars, found))[0]

    return F.transform(F.array(F.regexp_extract_all(stretch, F.lit("(?s)."), F.lit(0))), cut)[0]


def _chosen(hashes: Column, k: int) -> Column:
    def run(i: Column) -> Column:
        parts = [F.get(hashes, i + j) for j in range(k)]
        return F.when(F.least(*parts[1:-1]) >= F.least(parts[0], parts[-1]), i.cast("long") * HASH + F.xxhash64(*parts).bitwiseAND(HASH - 1))

    several = F.array_compact(F.transform(F.sequence(F.lit(0), F.size(hashes) - k), run))
    return F.when(F.size(hashes) >= k, several).otherwise(_whole(hashes))


def _whole(hashes: Column) -> Column:
    return F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes).bitwiseAND(HASH - 1))).otherwise(F.array().cast("array<long>"))


def anchors(text: Column, k: int = K) -> Column:
    """array<long>: position and hash of the chosen runs of ``text`` in order, or of all its words at
    position 0 where no run is chosen."""

    def either(hashes: Column) -> Column:
        return F.transform(F.array(_chosen(hashes, k)), lambda found: F.when(F.size(found) > 0, found).otherwise(_whole(hashes)))[0]

    return F.transform(F.array(_hashes(text)), either)[0]


def _position(anchor: Column) -> Column:
    return F.shiftright(anchor, 31)


def _hash(anchor: Column) -> Column:
    return anchor.bitwiseAND(HASH - 1)


def marks(found: Column) -> Column:
    """array<int>: the distinct hashes of anchors, and of links, which are negative."""
    own = F.transform(found, lambda a: _hash(a).cast("int"))

    def link(i: Column) -> Column:
        a, b = F.get(found, i), F.get(found, i + 1)
        return F.xxhash64(_hash(a), _position(b) - _position(a), _hash(b)).bitwiseOR(-HASH).cast("int")

    links = F.transform(F.sequence(F.lit(0), F.size(found) - 2), link)
    return F.array_distinct(F.when(F.size(found) > 1, F.concat(own, links)).otherwise(own))


def printed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda a: F.concat_ws(":", _position(a).cast("string"), _hash(a).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the marks of two lists of anchors."""

    def of(one: Column, other: Column) -> Column:
        shared = F.size(F.array_intersect(one, other))
        together = F.size(one) + F.size(other) - shared
        return F.when(together > 0, shared / together).otherwise(F.lit(1.0))

    both = F.array(F.struct(marks(a).alias("one"), marks(b).alias("other")))
    return F.transform(both, lambda x: of(x["one"], x["other"]))[0]


def following(keys: DataFrame) -> DataFrame:
    """Add (next_id, next_mark, own_rows) to distinct (id, mark, rows, ...) rows, in descending id order, cyclic.

    Rows are dealt by range, followed inside each range, and the first row of each range closes the
    gap to the range before; there is one such row for each partition, so that table is broadcast.
    """
    spark = keys.sparkSession
    keys = staged(keys, "chain-keys")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // RANGE))
    order = [F.desc_nulls_last("id"), F.asc("mark")]
    dealt = staged(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "chain")
    inside = Window.partitionBy("part").orderBy(*order)
    led = dealt.withColumn("place", F.row_number().over(inside)).withColumn("after", F.lead(F.struct("id", "mark", "rows")).over(inside))
    firsts = led.where("place = 1").select("part", F.struct("id", "mark", "rows").alias("first"))
    along = Window.orderBy("part")
    gaps = firsts.select("part", F.coalesce(F.lead("first").over(along), F.first("first").over(along)).alias("gap"))
    joined = led.join(F.broadcast(gaps), "part").withColumn("after", F.coalesce("after", "gap"))
    return joined.select(*keys.columns, F.col("after.id").alias("next_id"), F.col("after.mark").alias("next_mark"), F.col("after.rows").alias("own_rows"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, n_chars, fingerprint) for every row: the operator on its own."""
    text = text_or_empty(text_col)
    return docs.select(id_col, F.char_length(text).cast("long").alias("n_chars"), printed(anchors(text, k)).alias("fingerprint"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edits: the last third replaced by the next text's beginning.

    Texts are shuffled once; the next document then sends only the characters that are asked of it
    and its anchors.
    """
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    keys = texts.select("id", "mark", F.char_length("text").cast("long").alias("n_chars")).groupBy("id", "mark").agg(F.min("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("rows"))
    asked = staged(following(keys), "chain-next").select(
        F.col("next_id").alias("own_id"), F.col("next_mark").alias("own_mark"), F.col("id").alias("asker_id"), F.col("mark").alias("asker_mark"), F.floor(F.col("n_chars") / 3).cast("int").alias("asked_chars"), "own_rows"
    )

    def own(left: str, right: str) -> Column:
        return F.col("id").eqNullSafe(F.col(left)) & (F.col("mark") == F.col(right))

    def send(requests: DataFrame) -> DataFrame:
        return texts.join(requests, own("own_id", "own_mark")).select(
            "asker_id", "asker_mark", F.substring("text", F.lit(1), F.col("asked_chars")).alias("tail"), anchors(F.col("text")).alias("next_anchors")
        )

    repeated = send(asked.where("own_rows > 1")).dropDuplicates(["asker_id", "asker_mark"])
    sent = send(asked.where("own_rows = 1")).unionByName(repeated)
    met = texts.join(sent, own("asker_id", "asker_mark"))
    n = F.char_length("text").cast("long")
    edited = met.withColumn("n_chars", n).withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("tail")))
    marked = edited.select("id", "n_chars", "next_anchors", F.sha2("edited", 256).alias("edited_sha256"), anchors(F.col("text")).alias("own"), anchors(F.col("edited")).alias("changed"))
    return marked.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_anchors")).alias("near_next"),
    )


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
