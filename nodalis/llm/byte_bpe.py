"""Byte-level BPE encoding and decoding with pre-tokenisation by array scans.

A batch of texts becomes one array of code points. A table gives every code point its class; white
space and apostrophes are told apart further by what follows them. Each such symbol is a function from
the state before it to the state after it (the kind of word that is open), and functions compose
associatively: the few that composition can ever yield are numbered once, so that a block scan of
table look-ups gives the state at every position, and with it where words begin. No regular
expression sees the texts. The slices between those places are merged by rank, new words of like length
together, with a memory of words in two generations; token ends are kept as byte offsets, from which
decoding gathers all bytes at once.

The classes come from the engine that the reference library itself splits with, asked once for every
code point, so that both follow the same version of Unicode. The pattern must be PATTERN.

Defined cases: a null text is an empty one and has no tokens; strings of special tokens are ordinary
text; texts and words of any length are taken whole (long words by a heap); rows without id and
repeated rows are encoded each; further columns, whatever their names, are ignored; an empty table
gives no rows. Decoding an id that the vocabulary lacks raises; null lists decode to null.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import table, text_or_empty

#: The pattern of words that the scan implements. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Contractions by their letters; what follows the apostrophe. Fixed values.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")
OTHER, LETTER, NUMBER, SPACE, END = range(5)
BREAK = 0xD800  # between texts: no text can hold it
#: Symbols: the classes, white space before white space or the end of a text (WIDE), before other text as a
#: space (JOINS) or not (LONE), apostrophes of contractions with one and with two letters.
WIDE, JOINS, LONE, ONE, TWO = SPACE, 5, 6, 7, 8
SYMBOLS = 9
#: States: nothing open; an open word of letters, numbers, other characters, white space; a space that the
#: next word takes; one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, OPENED, LAST_LETTER, TWO_LETTERS = range(8)
BLOCK = 64
POINTS = 1 << 20  # code points that are scanned together, unless one text is longer
MEMO_WORDS = 100_000  # words in each of the memory's two generations
LONG_WORD = 48  # bytes from which merging uses a heap
FEW_WORDS, BATCH_WORDS = 16, 1 << 13  # new words of like length that are merged one by one, or together
NEVER = np.int32(np.iinfo(np.int32).max)


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a word begins) by state and symbol."""
    after, begins = np.zeros((8, SYMBOLS), np.uint8), np.ones((8, SYMBOLS), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (WIDE, IN_SPACE), (JOINS, OPENED), (LONE, FRESH), (ONE, LAST_LETTER), (TWO, TWO_LETTERS), (END, FRESH)):
        after[:, symbol] = state
    for state, symbol in ((IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_OTHERS, OTHER), (IN_SPACE, WIDE), (OPENED, LETTER), (OPENED, NUMBER), (OPENED, OTHER)):
        begins[state, symbol] = False
    for state in (IN_OTHERS, OPENED):  # an apostrophe inside a word of others is one of them
        after[state, [ONE, TWO]] = IN_OTHERS
        begins[state, [ONE, TWO]] = False
    for state, to in ((TWO_LETTERS, LAST_LETTER), (LAST_LETTER, FRESH)):
        after[state, LETTER] = to
        begins[state, LETTER] = False
    return after, begins


class Scanner:
    """Finds where words begin, by a scan over composed transition functions."""

    def __init__(self, classes: np.ndarray):
        self.classes = classes
        after, begins = transitions()
        self.begins = begins.ravel()
        known = {tuple(range(8)): 0}
        makers = [tuple(int(s) for s in after[:, symbol]) for symbol in range(SYMBOLS)]
        for f in makers:
            known.setdefault(f, len(known))
        queue = list(known)
        for f in queue:  # all functions that symbols compose to
            for g in makers:
                if (h := tuple(g[s] for s in f)) not in known:
                    known[h] = len(known)
                    queue.append(h)
        self.size = np.uint16(len(known))
        self.functions = np.array(list(known), np.uint8)
        self.states = np.ascontiguousarray(self.functions[:, FRESH])
        self.of_symbol = np.array([known[f] for f in makers], np.uint8)
        self.composed = np.array([[known[tuple(g[s] for s in f)] for g in known] for f in known], np.uint8).ravel()

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return self.composed[first * self.size + then]

    def scan(self, functions: np.ndarray) -> np.ndarray:
        """The composition of all functions up to each place: inside blocks, over blocks, then together."""
        n = len(functions)
        rows = -(-n // BLOCK)
        padded = np.zeros(rows * BLOCK, np.uint8)
        padded[:n] = functions
        steps = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
        for i in range(1, BLOCK):
            steps[i] = self.compose(steps[i - 1], steps[i])
        if rows > 1:
            before = np.concatenate([np.zeros(1, np.uint8), self.scan(steps[-1])[:-1]])
            steps = self.compose(np.broadcast_to(before, steps.shape), steps)
        return np.ascontiguousarray(steps.T).ravel()[:n]

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """The symbol of each code point; the last one is a BREAK."""
        found = self.classes[points]
        blank = found == SPACE
        edge = np.flatnonzero(blank[:-1] & ~blank[1:] & (found[1:] != END))
        marks = np.flatnonzero(points == ord("'"))
        found[edge] = np.where(points[edge] == 32, JOINS, LONE)
        if len(marks):
            last = len(points) - 1
            one, two = points[np.minimum(marks + 1, last)], points[np.minimum(marks + 2, last)]
            found[marks[np.isin(one, [ord(c) for c in SHORT])]] = ONE
            for a, b in LONG:
                found[marks[(one == ord(a)) & (two == ord(b))]] = TWO
        return found

    def words(self, texts: list[str]) -> list[list[bytes]]:
        """The words of every text as UTF-8."""
        if not texts:
            return []
        joined = chr(BREAK).join(texts) + chr(BREAK)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.symbols(points)
        states = self.states[self.scan(self.of_symbol[symbols])]
        before = np.concatenate([np.zeros(1, np.uint8), states[:-1]])
        starts = np.flatnonzero(self.begins[before * np.uint8(SYMBOLS) + symbols])
        ends = np.flatnonzero(points[starts] == BREAK)  # a break is a slice of its own
        packed = joined.encode("utf-8", "surrogatepass")
        if len(packed) > len(points):  # from code points to bytes
            sizes = np.ones(len(points), np.uint8)
            for first in (0x80, 0x800, 0x10000):
                sizes += points >= first
            starts = (np.cumsum(sizes, dtype=np.int64) - sizes)[starts]
        places = [*starts.tolist(), len(packed)]
        slices = list(map(packed.__getitem__, map(slice, places, places[1:])))
        return [slices[a:b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)]


@cache
def scanner() -> Scanner:
    """Classes of all code points, as the library's engine sees them."""
    import tiktoken

    every = "".join(map(chr, [*range(BREAK), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        engine = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        held = bytes(engine.encode_ordinary(every)).decode()
        classes[np.frombuffer(held.encode("utf-32-le"), "<u4")] = kind
    classes[BREAK] = END
    return Scanner(classes)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


class ByteBpe:
    """A vocabulary of ranks with its memory of merged words."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes, first {missing[0]}")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        by_id: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.known = np.array([t is not None for t in by_id])
        self.lengths = np.array([len(t or b"") for t in by_id], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(t or b"" for t in by_id), np.uint8)
        self.pair_tables()
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def pair_tables(self) -> None:
        """All pairs of ids that make a token: sorted keys with the token's id, and a table for single bytes."""
        ranks, size = self.ranks, len(self.lengths) + 1
        found = [(a * size + b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        keys, made = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.keys, self.made = np.append(keys, np.int64(size) * size), np.append(made, NEVER).astype(np.int32)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)] + [size - 1], np.int32)  # the last: behind a word's end
        codes = self.of_byte.astype(np.int64)
        self.byte_pairs = self.joined(codes[:, None], codes[None, :])

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that pairs of ids make together; NEVER where they make none."""
        wanted = left.astype(np.int64) * (len(self.lengths) + 1) + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.made[at], NEVER)

    def merge_batch(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of short words, all merged together: every round joins each word's best pair."""
        width = max(map(len, words)) + 1
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.full((len(words), width), 256, np.int16)
        letters[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids, pairs = self.of_byte[letters], self.byte_pairs[letters[:, :-1], letters[:, 1:]]
        live = np.arange(len(words))
        while True:
            at = pairs[live].argmin(axis=1)
            best = pairs[live, at]
            open_ = best < NEVER
            live, at, best = live[open_], at[open_], best[open_]
            if not len(live):
                break
            places = np.arange(width - 1)
            ids[live[:, None], places] = np.take_along_axis(ids[live], places + (places > at[:, None]), axis=1)
            ids[live, at] = best
            ids[live, -1] = self.of_byte[256]
            places = places[:-1]
            pairs[live[:, None], places] = np.take_along_axis(pairs[live], places + (places > at[:, None]), axis=1)
            pairs[live, -1] = NEVER
            pairs[live, at] = self.joined(best, ids[live, at + 1])
            inner = at > 0
            live_in, at_in = live[inner], at[inner]
            pairs[live_in, at_in - 1] = self.joined(ids[live_in, at_in - 1], best[inner])
            sizes[live] -= 1
        rows, step = ids.astype("<u4").tobytes(), 4 * width
        return [rows[i * step : i * step + 4 * n] for i, n in enumerate(sizes.tolist())]

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: neighbours with the lowest rank, leftmost first, are merged until none is known."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        if len(word) >= LONG_WORD:
            return self.merge_long(word)
        cuts, never = list(range(len(word) + 1)), len(self.lengths)
        pairs = [ranks.get(word[i : i + 2], never) for i in range(len(word) - 1)]
        while pairs and (best := min(pairs)) < never:
            at = pairs.index(best)
            del cuts[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(word[cuts[at] : cuts[at + 2]], never)
            if at:
                pairs[at - 1] = ranks.get(word[cuts[at - 1] : cuts[at + 1]], never)
        return [ranks[word[a:b]] for a, b in pairwise(cuts)]

    def merge_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs (rank, start, end); a pair counts while its parts still meet."""
        n, get = len(word), self.ranks.get
        after, before, heap = list(range(1, n + 2)), list(range(-1, n)), []
        for i in range(n - 1):
            if (rank := get(word[i : i + 2])) is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, start, end = heapq.heappop(heap)
            middle = after[start]
            if middle < 0 or middle >= end or after[middle] != end:
                continue
            after[start], after[middle] = end, -1
            if end < n:
                before[end] = start
                if (rank := get(word[start : after[end]])) is not None:
                    heapq.heappush(heap, (rank, start, after[end]))
            if start and (rank := get(word[before[start] : end])) is not None:
                heapq.heappush(heap, (rank, before[start], end))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[word[at : after[at]]])
            at = after[at]
        return out

    def learn(self, words: set[bytes]) -> None:
        """Merge words that are not in memory; words of the older generation come back when asked for."""
        if len(self.memo) + len(words) > MEMO_WORDS and self.memo:
            self.memo, self.older = {}, self.memo
        groups: dict[int, list[bytes]] = {}
        for word in words.difference(self.memo):
            if (known := self.older.get(word)) is not None:
                self.memo[word] = known
            elif len(word) < LONG_WORD:
                groups.setdefault(len(word) >> 2, []).append(word)
            else:
                self.memo[word] = np.array(self.merge(word), "<u4").tobytes()
        for group in groups.values():
            if len(group) < FEW_WORDS:
                self.memo.update((w, np.array(self.merge(w), "<u4").tobytes()) for w in group)
                continue
            for i in range(0, len(group), BATCH_WORDS):
                part = group[i : i + BATCH_WORDS]
                self.memo.update(zip(part, self.merge_batch(part), strict=True))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit numbers."""
        found = scanner().words(texts)
        self.learn(set().union(*found))
        return [b"".join(map(self.memo.__getitem__, words)) for words in found]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_packed(texts)]

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets at which the tokens of ``ids`` end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray | None = None) -> bytes:
        """The bytes of ids, gathered at once; ``ends`` are their retained offsets."""
        ids = np.asarray(ids, np.int64)
        ends = self.ends(ids) if ends is None else np.asarray(ends, np.int64)
        if not len(ids):
            return b""
        lengths = np.diff(ends, prepend=0)
        return self.bytes[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()


@cache
def vocabulary(path: str) -> ByteBpe:
    """One vocabulary for each worker process and file."""
    return ByteBpe(read_ranks(path))


def portions(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values hold about ``most`` bytes or entries together, or one row."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    start = held = 0
    for i, size in enumerate(sizes.fill_null(0).to_pylist()):
        if held + size > most and i > start:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, ends, packed) of every row; one pass, no shuffle.

    ``ends`` are the byte offsets in the text at which tokens end, ``packed`` the ids as little-endian
    unsigned 32-bit numbers."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    empty = rows.select("id", F.lit(0).cast("long").alias("n_tokens"), F.expr("cast(array() as array<int>)").alias("ids"), F.expr("cast(array() as array<int>)").alias("ends"), F.lit(b"").alias("packed"))
    names = empty.columns

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(ranks_path)
        for batch in (part for whole in batches for part in portions(whole, "text", POINTS)):
            packed = held.encode_packed(batch.column("text").to_pylist())
            ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            stops = np.cumsum([len(x) // 4 for x in packed])
            starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
            counts, total = stops - starts, np.concatenate([[0], held.ends(ids)])
            ends = total[1:] - np.repeat(total[starts], counts)
            offsets = pa.array(np.concatenate([[0], stops]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (ids, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), *lists, pa.array(packed, pa.binary())], names)

    return rows.mapInArrow(coded, empty.schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", ends_col: str | None = "ends") -> DataFrame:
    """``rows`` with the bytes of their ids as ``decoded`` (a column of that name gives way)."""
    rows = rows.drop("decoded")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(ranks_path)
        for batch in (part for whole in batches for part in portions(whole, ids_col, POINTS)):
            ids, ends = batch.column(ids_col), batch.column(ends_col) if ends_col else [None] * batch.num_rows
            texts = [held.decode(np.asarray(x.values), None if y is None or not y.is_valid else np.asarray(y.values)) if x.is_valid else None for x, y in zip(ids, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(decoded, rows.withColumn("decoded", F.lit(None).cast("binary")).schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
