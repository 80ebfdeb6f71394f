"""SimHash near-duplicates: Golay-code keys, verified links, connected components.

Fingerprints. Words of the lower-cased (A-Z) text form shingles of three words; a bit of the 64 is
set if more than half of the shingles' XXH64 hashes have it.

Candidates. The binary Golay code [23, 12] covers every 23-bit word within distance 3, and a word at
distance 3 from its codeword has five more at distance 4. Decoding a segment to all codewords within
distance 4 (one or six of them) makes any two words that differ in one bit share a codeword: the one
within 3 of the first is within 4 of the second. A fingerprint is cut into three segments A, B, C.
If two fingerprints differ in at most two bits, one of the ordered pairs AB, BC, CA has an equal
first segment and at most one error in its second: errors (2,0,0), (1,0,1) leave BC; (0,2,0),
(1,1,0) leave CA; (0,0,2), (0,1,1) leave AB. So each pair gives the keys (first segment, codeword of
the second), 16 a fingerprint on average, and every link shares one.

Links. Only distinct fingerprints take part; copies share a class by themselves. Members of a key
with up to ``BUCKET`` members are joined and verified. Members of larger keys are linked exactly by
another way that needs no pairs: each sends the 65 words within one bit of it, and those that send
the same word (at most 65) are within two bits of each other, while any two within two bits share
such a word. Components follow by alternating large-star and small-star steps.

Defined cases: a null text is an empty one; texts of one or two words have one shingle; without words
the fingerprint is 0, linked like any other; repeated rows keep their number; the class of rows
without any id is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import only_keys, staged, table, text_or_empty, without_keys

WORDS, SEED, BITS = 3, 42, 64
BUCKET = 64
CHUNK = 1 << 15
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator polynomial of the Golay code. A fixed value.
GENERATOR = 0b110001110101
#: Bit ranges of the segments A, B, C, and the pairs (exact, decoded).
SEGMENTS = ((0, 21), (21, 22), (43, 21))
PAIRS = ((0, 1), (1, 2), (2, 0))


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text's three-word shingles."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    shingles = max(1, len(words) - WORDS + 1)
    starts, ends = starts[:shingles], ends[min(WORDS, len(words)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, shingles, CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > shingles, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and for each syndrome its error patterns of weight
    up to 4: the leader first, then the five of weight 4 or the leader again."""
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [remainder(1 << bit) for bit in range(23)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for bit in range(12):
        low ^= np.where(np.arange(low.size) >> bit & 1, single[bit], 0).astype(np.int32)
    for bit in range(11):
        high ^= np.where(np.arange(high.size) >> bit & 1, single[12 + bit], 0).astype(np.int32)
    patterns: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for bit in bits:
                syndrome ^= single[bit]
            patterns.setdefault(syndrome, []).append(sum(1 << bit for bit in bits))
    near = np.zeros((1 << 11, 6), np.int32)
    for syndrome, found in patterns.items():
        near[syndrome] = (found + [found[0]] * 5)[:6]
    return low, high, near


def codewords(words: np.ndarray) -> np.ndarray:
    """(n, 6): the 12 data bits of all codewords within distance 4; repeated where there is only one."""
    low, high, near = golay_tables()
    syndromes = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ near[syndromes]) >> 11


def keys(fps: np.ndarray) -> np.ndarray:
    """(n, 18): the keys of fingerprints (uint64); keys within a row may repeat."""
    cut = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    return np.concatenate([(pair << 34) + (cut[exact] << 12)[:, None] + codewords(cut[decoded]) for pair, (exact, decoded) in enumerate(PAIRS)], axis=1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        found = np.sort(keys(fps.view(np.uint64)), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        yield pa.RecordBatch.from_arrays([pa.array(found[first]), pa.array(np.repeat(fps, first.sum(axis=1)))], ["key", "fp"])


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct edges (a < b) whose components are those of all links between distinct fingerprints."""
    keyed = staged(nodes.select("fp").mapInArrow(_keys, "key long, fp long"), "simhash-keys")
    sizes = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "simhash-sizes")
    met = staged(keyed.join(sizes, "key"), "simhash-buckets")
    few = met.where(F.col("members") <= bucket).select("key", "fp")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowd = met.where(F.col("members") > bucket).select("fp").distinct()
    around = F.expr(f"concat(array(fp), transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i)))")
    sent = crowd.select("fp", F.explode(around).alias("word"))
    stars = sent.groupBy("word").agg(F.array_sort(F.collect_list("fp")).alias("members")).where(F.size("members") > 1)
    spokes = stars.select(F.col("members")[0].alias("a"), F.explode(F.slice("members", 2, BITS + 1)).alias("b"))
    return pairs.unionByName(spokes).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of an edge but the roots."""

    def stars(current: DataFrame, large: bool) -> DataFrame:
        ways = current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        if large:
            ways = ways.unionByName(current.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = staged(ways.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least")), "stars-least")
        linked = ways.join(least, "u")
        if large:
            moved = linked.where("v > u").select(F.col("least").alias("a"), F.col("v").alias("b"))
        else:
            own = least.where("least < u").select(F.col("least").alias("a"), F.col("u").alias("b"))
            moved = linked.select(F.col("least").alias("a"), F.col("v").alias("b")).unionByName(own)
        return staged(moved.where("a < b").distinct(), "stars")

    def mark(current: DataFrame):
        one, other = F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(1))
        halves = [F.sum(part) for h in (one, other) for part in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
        return current.agg(F.count(F.lit(1)), *halves).first()

    current = staged(edges, "stars")
    before = mark(current)
    while before[0]:
        current = stars(stars(current, large=True), large=False)
        now = mark(current)
        if now == before:
            break
        before = now
    return current.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``."""
    marked = staged(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_fingerprints, docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("fp")).schema), "simhash")
    nodes = staged(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = components(links(nodes, bucket))
    rooted = staged(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    classes = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-classes")
    named = staged(rooted.join(classes, "root").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class: the one with the class's id. Texts of other documents are shuffled, those
    of the documents that stay are not.

    Rows that repeat both id and text are one document and become one row. Where a class has no id at
    all, one row of each of its texts stays, and so do texts of other rows without id.
    """
    found = near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(id_col).eqNullSafe(F.col("component_id")).cast("long").alias("own"))
    rows = staged(found.groupBy("id").agg(F.sum("own").alias("kept")).where("kept <> 1"), "simhash-kept")
    once = without_keys(docs, id_col, rows.select("id"))
    again = only_keys(docs, id_col, rows.where("kept > 1").select("id"))
    return once.unionByName(again.dropDuplicates([id_col, text_col]))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
