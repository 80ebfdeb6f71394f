"""Alignment of two tokenizers over the same bytes.

Both tokenizers encode a space and the text. Each side's cumulative byte ends go to a dictionary from
end to index; the intersection of the two key sets, sorted, cuts both id lists into groups, and every
slice is expanded into its links. A link is a pair of token occurrences of one group; a pair of ids
counts as many documents as hold it linked.

The texts of a portion are aligned as one, so that they share one pair of dictionaries; where a text's
joined bytes differ from its own, it takes no part. A group is expanded by its distinct ids and how often
they occur once it has many links, so one long group never costs the product of its lengths.

Counting needs every document twice, before and after the counts are known. Tasks cut their documents
into chunks of bounded size and write, beside each document's links as places in its chunk's list of
pairs, that list once. Only these lists meet the counts, and each comes back to its chunk's documents:
what is shuffled by pair has one row for a chunk and pair, however common the pair is.

Defined cases: texts that are null or empty, or whose joined bytes differ from the space and the text in
either tokenizer, have no tokens: zeros and an empty list of groups; texts of any length are taken
whole; repeated rows and rows without id count as documents of their own; further columns, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, count
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodalis.llm.byte_bpe import PATTERN, portions
from nodalis.llm.common import staged, table, text_or_empty
from nodalis.llm.sentencepieces import SPACE
from nodalis.llm.token_counts import SETTLED, TokenCounter

POINTS = 1 << 20  # bytes of texts that are aligned together, unless one is longer
FEW_LINKS = 64  # links up to which a group is written out by occurrences
CHUNK_ENTRIES, CHUNK_DOCS = 1 << 20, 1 << 14


@dataclass(frozen=True)
class Record:
    """A text's groups as written, codes of its links, numbers of tokens and groups, (codes, times) of long groups."""

    groups: str
    codes: np.ndarray
    n_a: int
    n_b: int
    n_groups: int
    long: list | tuple


def byte_of_symbol() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves,
    the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def same_merges(path: str, symbols: dict[str, int]) -> dict[bytes, int] | None:
    """The ranks of a byte-level BPE file whose ids are in the order of its merges; else None."""
    model = json.loads(Path(path).read_text())["model"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    ids = [model["vocab"].get(t, -1) for t in merged]
    known = [t for t in model["vocab"] if all(c in symbols for c in t)]
    if ids != sorted(set(ids)) or ids[:1] < [0] or len(ids) + len(symbols) != len(known) or model.get("ignore_merges"):
        return None
    return {bytes(map(symbols.__getitem__, t)): model["vocab"][t] for t in known}


class Aligner:
    """Two tokenizers and their tokens' bytes."""

    def __init__(self, json_path: str, model_path: str):
        counter = TokenCounter(json_path)
        self.first = counter.tokenizer
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=model_path)
        symbols = byte_of_symbol()
        ranks = same_merges(json_path, symbols) if counter.by_word else None
        # The same vocabulary in a faster library, for texts of characters that both split alike.
        self.fast = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        a_bytes = {i: bytes(map(symbols.__getitem__, t)) if all(c in symbols for c in t) else t.encode() for t, i in self.first.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(SPACE, " ").encode() for i in range(self.second.get_piece_size()) for p in [self.second.id_to_piece(i)]]
        self.set_tables()

    def set_tables(self) -> None:
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        #: Ids with what follows them: a comma, or the end of their side of a group.
        self.printed = [f"{i}{mark}" for x, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for mark in marks for i in range(len(x))]
        a_count = len(self.a_bytes)
        self.places = 0, a_count, 2 * a_count, 2 * a_count + len(self.b_bytes)

    def encode_first(self, text: str) -> list[int]:
        if self.fast and SETTLED.fullmatch(text):
            return self.fast.encode_ordinary(" " + text)
        return self.first.encode(" " + text, add_special_tokens=False).ids

    @staticmethod
    def long_group(left: Iterable[int], right: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of a group's pairs of distinct ids, and how many links each stands for."""
        (x, n), (y, m) = ((np.array(list(c)), np.array(list(c.values()))) for c in (Counter(left), Counter(right)))
        return (x[:, None] << 32 | y[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()

    def records(self, a_lists: list[list[int]], b_lists: list[list[int]]) -> list[Record]:
        """The records of texts whose tokens have the same bytes on both sides."""
        if not a_lists:
            return []
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_lists, b_lists))
        a_stops, b_stops = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (a_lists, b_lists))
        a_ends = np.cumsum(self.a_sizes[a])
        a_index, b_index = dict(zip(a_ends.tolist(), count(1))), dict(zip(np.cumsum(self.b_sizes[b]).tolist(), count(1)))  # noqa: B905
        common = sorted(a_index.keys() & b_index.keys())
        a_to, b_to = (np.fromiter(map(x.__getitem__, common), np.int64, len(common)) for x in (a_index, b_index))
        a_from, b_from = np.concatenate([[0], a_to[:-1]]), np.concatenate([[0], b_to[:-1]])
        n, m = a_to - a_from, b_to - b_from
        # Both sides' ids in the order of the groups' text, each with the mark that follows it.
        of_a, of_b = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[a_to - 1] = last_b[b_to - 1] = True
        order[np.arange(len(a)) + b_from[of_a]] = a + np.where(last_a, self.places[1], self.places[0])
        order[np.arange(len(b)) + a_to[of_b]] = b + np.where(last_b, self.places[3], self.places[2])
        pieces = list(map(self.printed.__getitem__, order.tolist()))
        # Links of all groups but the long ones.
        links = np.where(n * m <= FEW_LINKS, n * m, 0)
        ends = np.cumsum(links)
        of = np.repeat(np.arange(len(links)), links)
        within = np.arange(len(of)) - (ends - links)[of]
        codes = a[a_from[of] + within // m[of]] << 32 | b[b_from[of] + within % m[of]]
        last = np.searchsorted(np.array(common), a_ends[a_stops - 1])  # each text's last group
        long: dict[int, list] = {}
        for g in np.flatnonzero(links == 0).tolist():
            found = self.long_group(a[a_from[g] : a_to[g]].tolist(), b[b_from[g] : b_to[g]].tolist())
            long.setdefault(int(np.searchsorted(last, g)), []).append(found)
        out, i, j, g = [], 0, 0, 0
        for k, (text_end, code_end, group_end) in enumerate(zip((a_stops + b_stops).tolist(), ends[last].tolist(), (last + 1).tolist(), strict=True)):
            out.append(Record("".join(pieces[i:text_end])[:-1], codes[j:code_end], len(a_lists[k]), len(b_lists[k]), group_end - g, long.get(k, ())))
            i, j, g = text_end, code_end, group_end
        return out

    def align(self, texts: list[str]) -> list[Record | None]:
        """The record of every text; None where it has no tokens."""
        a_lists = [self.encode_first(t) if t else [] for t in texts]
        b_lists = self.second.encode([t or "" for t in texts], num_threads=1)
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        held = [i for i, t in enumerate(texts) if t and b"".join(map(a_bytes, a_lists[i])) == (whole := b" " + t.encode()) and b"".join(map(b_bytes, b_lists[i])) == whole]
        found: list[Record | None] = [None] * len(texts)
        for i, record in zip(held, self.records([a_lists[i] for i in held], [b_lists[i] for i in held]), strict=True):
            found[i] = record
        return found


@cache
def aligner(json_path: str, model_path: str) -> Aligner:
    """One aligner for each worker process and pair of files."""
    return Aligner(json_path, model_path)


def distinct_links(record: Record) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a record's links in order, and how often each occurs."""
    codes, times = np.unique(record.codes, return_counts=True)
    if not record.long:
        return codes, times
    codes, times = (np.concatenate(x) for x in zip((codes, times), *record.long, strict=True))
    codes, back = np.unique(codes, return_inverse=True)
    summed = np.zeros(len(codes), np.int64)
    np.add.at(summed, back, times)
    return codes, summed


def narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs."""
    return values.astype(next(k for k in ("<u1", "<u2", "<u4", "<i8") if not len(values) or values.max() <= np.iinfo(k).max)).tobytes()


def wide(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that narrow() has packed."""
    return np.frombuffer(packed, {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[len(packed) // n]).astype(np.int64) if n else np.zeros(0, np.int64)


def _schema(id_type: T.DataType) -> T.StructType:
    whole, blob, longs = T.LongType(), T.BinaryType(), T.ArrayType(T.LongType())
    fields = [("id", id_type), ("n_a", whole), ("n_b", whole), ("n_groups", whole), ("n_links", whole), ("groups", T.StringType()), ("chunk", whole), ("n_pairs", whole), ("steps", blob), ("times", blob), ("pairs", longs), ("docs", longs)]
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


class _Chunk:
    """Documents of one task that share a list of pairs."""

    def __init__(self, id_type: pa.DataType):
        self.id_type, self.rows, self.links, self.entries = id_type, [], [], 0

    def add(self, key: object, record: Record | None) -> None:
        if record is None:
            links = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.rows.append((key, 0, 0, 0, 0, ""))
        else:
            links = distinct_links(record)
            self.rows.append((key, record.n_a, record.n_b, record.n_groups, int(links[1].sum()), record.groups))
        self.links.append(links)
        self.entries += len(links[0])

    def full(self) -> bool:
        return self.entries >= CHUNK_ENTRIES or len(self.rows) >= CHUNK_DOCS

    def batch(self, chunk: int) -> pa.RecordBatch:
        """One row for each document and one for the chunk's pairs."""
        sizes = [len(codes) for codes, _ in self.links]
        pairs, places, docs = np.unique(np.concatenate([c for c, _ in self.links]), return_inverse=True, return_counts=True)
        steps, at = [], 0
        for size in sizes:
            steps.append(narrow(np.diff(places[at : at + size], prepend=0)))
            at += size
        n, columns = len(self.rows), list(zip(*self.rows, strict=True))
        arrays = [
            pa.array([*columns[0], None], self.id_type),
            *(pa.array([*x, None], pa.int64()) for x in columns[1:5]),
            pa.array([*columns[5], None], pa.string()),
            pa.array([chunk] * (n + 1), pa.int64()),
            pa.array([*sizes, None], pa.int64()),
            pa.array([*steps, None], pa.binary()),
            pa.array([*(narrow(times) for _, times in self.links), None], pa.binary()),
            *(pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))]) for x in (pairs, docs.astype(np.int64))),
        ]
        return pa.RecordBatch.from_arrays(arrays, _schema(T.LongType()).names)


def align(docs: DataFrame, json_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's alignment: (id, n_a, n_b, n_groups, n_links, groups) and its links as (chunk, n_pairs,
    steps, times), and for every chunk a row of its (pairs, docs): codes and in how many documents they are."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, open_ = aligner(json_path, model_path), TaskContext.get().partitionId() << 32, None
        for batch in (part for whole in batches for part in portions(whole, "text", POINTS)):
            for key, record in zip(batch.column("id").to_pylist(), held.align(batch.column("text").to_pylist()), strict=True):
                open_ = open_ or _Chunk(batch.schema.field("id").type)
                open_.add(key, record)
                if open_.full():
                    yield open_.batch(number)
                    open_, number = None, number + 1
        if open_:
            yield open_.batch(number)

    return rows.mapInArrow(aligned, _schema(rows.schema["id"].dataType))


def link_counts(docs: DataFrame, json_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row of ``docs``.

    ``count_sum`` adds up the document counts of all links, ``n_best`` counts the links whose count is the
    highest that their first id has anywhere."""
    found = align(docs, json_path, model_path, id_col, text_col)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    written = staged(found.withColumn("groups_sha256", digest).drop("groups"), "alignment")
    lists = written.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select("chunk", "place", "x.pairs", "x.docs")
    counts = staged(lists.groupBy("pairs").agg(F.sum("docs").alias("count")), "link-counts").withColumn("a", F.shiftright("pairs", 32))
    best = counts.groupBy("a").agg(F.max("count").alias("highest"))  # one row for each id of the first vocabulary at most
    known = counts.join(F.broadcast(best), "a").select("pairs", "count", (F.col("count") == F.col("highest")).alias("top"))
    back = lists.select("chunk", "place", "pairs").join(known, "pairs").select(F.col("chunk").alias("of"), "place", "count", "top")
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own = written.where("pairs IS NULL").select(*kept, "chunk", "n_pairs", "steps", "times")
    schema = T.StructType([own.schema[name] for name in kept] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def summed(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        place = pairs.column("place").to_numpy()
        count, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], top[place] = pairs.column("count").to_numpy(), pairs.column("top").to_numpy(zero_copy_only=False)
        sums = []
        for n, steps, times in zip(*(documents.column(c).to_pylist() for c in ("n_pairs", "steps", "times")), strict=True):
            at, often = np.cumsum(wide(steps, n)), wide(times, n)
            sums.append((int(top[at] @ often), int(count[at] @ often)))
        out = documents.select(kept)
        for i, name in enumerate(("n_best", "count_sum")):
            out = out.append_column(name, pa.array([s[i] for s in sums], pa.int64()))
        return out

    return own.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(summed, schema).withColumnRenamed("id", id_col)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = link_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
