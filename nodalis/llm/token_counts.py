"""Token counts through a digest cache.

Every text is reduced to the SHA-256 of its normalised content. Counts are stored under that digest
and the digest of the tokenizer's file, so neither a changed text nor a changed vocabulary ever
meets an old count. Only digests without a stored count are encoded, once each however often their
text occurs, and the new counts are appended to the cache.

The registered query starts with an empty cache. Normalising means that a null text is an empty one; nothing that could change a count is touched.
Defined cases: an empty text has 0 tokens; a text of any length is one text; rows without an id
are counted like others; further columns, whatever their names, are ignored; repeated rows are counted each, encoded once; an empty
table gives no rows and leaves the cache as it is; two jobs that append the same digest at once are
harmless, as readers take one count per digest.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import bitmap, fresh_path, staged, table, text_or_empty, with_membership

OVER = 1024
MEMO_WORDS = 300_000  # words in each of the memory's two generations
#: Characters that every Unicode version puts in the same class, so that any engine splits them alike.
SETTLED = regex.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u024f\\u2010-\\u2027]*+")
#: The word pattern of byte-level BPE vocabularies. A fixed value.
BYTE_LEVEL_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CACHE = "content_digest binary, n_tokens long, tokenizer_digest string"


class TokenCounter:
    """Counts the tokens of whole texts as the tokenizers library does.

    For byte-level BPE a text's tokens are those of its words, so counts of words are kept and only
    new words are encoded. Texts that hold an added token or a character outside SETTLED, and all
    texts of other kinds of tokenizer, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        made = json.loads(Path(path).read_text())
        before = made.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in made.get("added_tokens", [])]
        self.by_word = not made.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not self.by_word or not SETTLED.fullmatch(text) or any(x in text for x in self.added):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = BYTE_LEVEL_WORDS.findall(text)
        if new := [w for w in set(words) if w not in self.memo]:
            if len(self.memo) + len(new) > MEMO_WORDS:
                self.memo, self.older = {}, self.memo
                new = list(set(words))
            self.memo.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in self.memo]
            self.memo.update(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch(new, add_special_tokens=False)), strict=True))
        return sum(map(self.memo.__getitem__, words))


@cache
def counter(path: str) -> TokenCounter:
    """One counter for each worker process and tokenizer."""
    return TokenCounter(path)


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, done = counter(path).count, set()
        for batch in batches:
            found = {}
            for digest, text in zip(batch.column("content_digest").to_pylist(), batch.column("text"), strict=True):
                if digest not in done:  # rows that repeat id and text
                    done.add(digest)
                    found[digest] = count(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["content_digest", "n_tokens"])

    return encode


def _exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_cache(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """Stored counts (content_digest, n_tokens) of one tokenizer version."""
    if not _exists(spark, cache_path):
        return spark.createDataFrame([], "content_digest binary, n_tokens long")
    return spark.read.schema(_CACHE).parquet(cache_path).where(F.col("tokenizer_digest") == tokenizer).drop("tokenizer_digest")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, content_digest, n_tokens) for every row of ``docs``; new counts go to the cache.

    Of each missing digest the row with the smallest id lends its text. Bitmaps of the stored digests, of
    the missing ones and of those that several rows share tell most rows apart where they lie: a text
    that is surely missing and surely alone is encoded in place, one that is surely stored goes nowhere.
    Only texts that repeat, or whose place in a bitmap another digest holds, are shuffled, by digest and
    id together, so copies of one text never meet in one task.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    keyed = staged(texts.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content_digest"), "token-digests")
    stored = read_cache(spark, cache_path, version)
    lenders = keyed.groupBy("content_digest").agg(F.min("id").alias("lender"), F.count(F.lit(1)).alias("rows"))
    misses = staged(lenders.join(stored, "content_digest", "left_anti"), "token-misses")
    maps = {"stored": stored, "shared": misses.where("rows > 1"), "missing": misses}
    told = with_membership(texts, "content_digest", {name: staged(bitmap(keys, "content_digest"), f"token-{name}") for name, keys in maps.items()})
    alone = told.where("NOT stored AND NOT shared")
    lent = told.where("missing AND (stored OR shared)").alias("t").join(
        misses.alias("m"),
        (F.col("t.content_digest") == F.col("m.content_digest")) & F.col("t.id").eqNullSafe(F.col("m.lender")),
        "left_semi",
    )
    counted = alone.select("content_digest", "text").unionByName(lent.select("content_digest", "text")).mapInArrow(_encoder(tokenizer_path), "content_digest binary, n_tokens long")
    counted = counted.dropDuplicates(["content_digest"])  # of such rows in two tasks
    counted.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    known = read_cache(spark, cache_path, version).join(lenders.select("content_digest"), "content_digest", "left_semi")
    counts = staged(known.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keyed.join(counts, "content_digest").select(F.col("id").alias(id_col), "n_bytes", "content_digest", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query starts from an empty cache, so that its figures show the whole work."""
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER).alias("over_limit"))
