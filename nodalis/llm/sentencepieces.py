"""SentencePiece encoding by batched Viterbi, and decoding.

The distinct words of a batch of texts are encoded together: words of equal length form a matrix of
code points and advance through the lattice position by position. Rolling hashes give the hash of
every substring at once, which is probed in the sorted keys of all pieces; a vectorised maximum over
the piece lengths stores score and backpointer.

A unigram model adds piece scores. In a BPE model a segmentation is the one that merging yields just
if every piece merges to itself and every two neighbours, merged alone, stay apart: the first merge
over a boundary would happen in the pair as well. So each prefix has exactly one last piece that
fits the one before it, and the maximum over fitting pieces finds it. Whether two pieces stay apart
is decided by replaying both their merge sequences side by side; answers are kept.

Long words, and lengths that few words have, take the same steps one word at a time. Nothing is cut.
Supported are models whose normaliser is the identity; others are refused. Defined cases: a null
text is an empty one and has no pieces; characters no piece holds become byte pieces, or the unknown
piece where a model has none; repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodalis.llm.common import table, text_or_empty

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(44)
LONG_WORD, FEW_WORDS, BLOCK_WORDS = 96, 4, 1 << 14
MEMO_WORDS = 100_000  # words in each of the memory's two generations
DECODED_IDS = 1 << 17
ROWS = 1024  # rows that are encoded and sent on together
PAIR_BITS = 20  # 2 to this power pairs have their answers kept
UNKNOWN_PENALTY = 10.0
NEVER = np.int32(1 << 30)


def fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = message[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if kind == 5 else "<d", message[at : at + size])[0], at + size
        yield key >> 3, value


class PieceModel:
    """A SentencePiece model's pieces and the tables of its lattice."""

    def __init__(self, path: str):
        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(Path(path).read_bytes()):
            if number == 1:
                entry = dict(fields(value))
                pieces.append((entry[1].decode(), entry.get(2, 0.0), entry.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        if normaliser.get(2) or not normaliser.get(5, 1) or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with the identity normaliser are supported")
        self.build(pieces)

    def build(self, pieces: list[tuple[str, float, int]]) -> None:
        """Tables for pieces of (text, score, type). Tokens of the lattice are piece ids, then the
        characters that occur in pieces without being one, then one for all other characters."""
        self.pieces = pieces
        self.printed = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else b"" if kind == CONTROL else p.replace(SPACE, " ").encode("utf-8", "replace")
            for p, _, kind in pieces
        ]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        extra = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.tokens = self.ids | {c: len(pieces) + i for i, c in enumerate(extra)}
        self.inert = len(pieces) + len(extra)
        self.longest = max(map(len, self.tokens), default=1)
        self.whole_words = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        scores = [s for _, s, kind in pieces if kind in (NORMAL, USER)]
        self.score = np.full(self.inert + 1, min(scores, default=0.0) - UNKNOWN_PENALTY)
        for p, i in self.ids.items():
            self.score[i] = pieces[i][1]
        order = sorted(self.ids.values(), key=lambda i: (-pieces[i][1], i))
        self.rank = np.full(self.inert + 1, NEVER, np.int32)
        self.rank[order] = np.arange(len(order), dtype=np.int32)
        self.single = np.array([i for p, i in self.tokens.items() if len(p) == 1], np.int64)
        self.length = np.ones(self.inert + 1, np.int64)
        self.hash = np.zeros(self.inert + 1, np.uint64)
        for p, i in self.tokens.items():
            self.length[i], self.hash[i] = len(p), self.hashed(p)
        usable = [i for p, i in self.tokens.items() if self.kind != BPE or len(p) == 1 or self.replay(p)]
        keys = self.hash[list(self.tokens.values())]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.all_keys, self.usable_keys = self.sorted_keys(list(self.tokens.values())), self.sorted_keys(usable)
        chosen = set(usable)
        self.usable = {p for p, i in self.tokens.items() if i in chosen}
        self.sizes = self.length.tolist()
        self.printed_length = np.array(list(map(len, self.printed)), np.int32)
        self.printed_start = np.concatenate([[0], np.cumsum(self.printed_length, dtype=np.int64)])[:-1]
        self.printed_bytes = np.frombuffer(b"".join(self.printed), np.uint8)
        if self.kind == BPE:
            self.merge_tables()
        self.pair_codes, self.pair_apart = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def hashed(text: str) -> int:
        value = 0
        for c in text:
            value = (value * int(FACTOR) + ord(c) + 1) % (1 << 64)
        return value

    def sorted_keys(self, tokens: list[int]) -> tuple:
        """Sorted keys (hashes, spread), their tokens, which values a key's first bits take, where the keys
        of each value begin, and the most keys of one value."""
        tokens = np.array(tokens, np.int64)
        keys = self.hash[tokens] * SPREAD
        order = np.argsort(keys, kind="stable")
        keys, tokens = keys[order], tokens[order]
        slots, first, members = np.unique((keys >> SHIFT).astype(np.int64), return_index=True, return_counts=True)
        seen, starts = np.zeros(1 << (64 - int(SHIFT)), bool), np.zeros(1 << (64 - int(SHIFT)), np.int32)
        seen[slots], starts[slots] = True, first
        return keys, tokens, seen, starts, int(members.max(initial=0))

    def replay(self, piece: str) -> list[tuple[int, int, int]] | None:
        """The merges of a piece on its own as (rank, first token, last token after it); None if they
        do not end in the piece."""
        parts, steps = list(piece), []
        while len(parts) > 1:
            ranks = [int(self.rank[self.ids[a + b]]) if a + b in self.ids else int(NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == NEVER:
                return None
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, self.tokens[parts[0]], self.tokens[parts[-1]]))
        return steps

    def merge_tables(self) -> None:
        """For every token and step: the rank of its next merge, its first and its last part."""
        shape = (self.inert + 1, self.longest)
        self.next_rank, self.first, self.last = np.full(shape, NEVER, np.int32), np.full(shape, self.inert, np.int32), np.full(shape, self.inert, np.int32)
        for piece in self.usable:
            token = self.tokens[piece]
            steps = self.replay(piece) if len(piece) > 1 else []
            self.first[token, 0], self.last[token, 0] = self.tokens[piece[0]], self.tokens[piece[-1]]
            for i, (rank, first, last) in enumerate(steps):
                self.next_rank[token, i], self.first[token, i + 1], self.last[token, i + 1] = rank, first, last

    @staticmethod
    def lookup(hashes: np.ndarray, table: tuple) -> np.ndarray:
        """The tokens of hashes in sorted_keys(); -1 where there is none."""
        keys, tokens, seen, starts, most = table
        out = np.full(hashes.shape, -1, np.int64)
        spread = (hashes * SPREAD).ravel()
        likely = np.flatnonzero(seen[(spread >> SHIFT).astype(np.int64)])
        wanted = spread[likely]
        at = starts[(wanted >> SHIFT).astype(np.int64)]
        for step in range(most):
            place = np.minimum(at + step, len(keys) - 1)
            hit = keys[place] == wanted
            out.ravel()[likely[hit]] = tokens[place[hit]]
        return out

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging each pair of tokens alone leaves both as they are."""
        apart = np.ones(len(left), bool)
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.longest, FACTOR, np.uint64))])
        i, j, live = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64), np.flatnonzero((left != self.inert) & (right != self.inert))
        while live.size:
            a, b = self.last[left[live], i[live]], self.first[right[live], j[live]]
            joined = self.hash[a] * powers[self.length[b]] + self.hash[b]
            met = self.lookup(joined, self.all_keys)
            cross = np.where((met >= 0) & (self.length[a] + self.length[b] == self.length[met]), self.rank[met], NEVER)
            ours, theirs = self.next_rank[left[live], i[live]], self.next_rank[right[live], j[live]]
            crossed = (cross < ours) & (cross <= theirs) & (cross < NEVER)
            apart[live[crossed]] = False
            step_left = ~crossed & (ours <= theirs) & (ours < NEVER)
            step_right = ~crossed & ~step_left & (theirs < NEVER)
            i[live[step_left]] += 1
            j[live[step_right]] += 1
            live = live[step_left | step_right]
        return apart

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """stay_apart() with memory: every pair has one place in a table, which the newest pair holds."""
        codes = left * np.int64(self.inert + 1) + right
        place = ((codes.astype(np.uint64) * FACTOR) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, known = self.pair_apart[place], self.pair_codes[place] == codes
        if not known.all():
            open_ = np.flatnonzero(~known)
            new, first, back = np.unique(codes[open_], return_index=True, return_inverse=True)
            found = self.stay_apart(new // (self.inert + 1), new % (self.inert + 1))
            out[open_] = found[back]
            taken = place[open_[first]]
            self.pair_codes[taken] = new
            self.pair_apart[taken] = found
            own = self.pair_codes[taken] == new  # of two new pairs with one place the last code stays
            self.pair_apart[taken[own]] = found[own]
        return out

    def segment_batch(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of one length, all advancing together: rows filled from the right, and counts."""
        n, length = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).astype(np.uint64) + np.uint64(1)
        span = min(self.longest, length)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        last = np.full((length + 1, n), -1, np.int64)
        hashes = np.zeros((span, n), np.uint64)  # hashes[size - 1]: of the last size characters
        for end in range(1, length + 1):
            point = points[:, end - 1]
            hashes[1:] = hashes[:-1] * FACTOR + point
            hashes[0] = point
            width = min(span, end)
            tokens = self.lookup(hashes[:width], self.usable_keys)
            tokens[0][tokens[0] < 0] = self.inert
            before = last[end - width : end][::-1]
            if self.kind == BPE:
                sizes, rows = np.nonzero((tokens >= 0) & (before >= 0))
                token = tokens[sizes, rows]
                apart = self.fits(before[sizes, rows], token)
                last[end, rows[apart]] = token[apart]
                if width == end:  # a piece that begins the word has none before it
                    whole = np.flatnonzero(tokens[width - 1] >= 0)
                    last[end, whole] = tokens[width - 1, whole]
                continue
            scores = best[end - width : end][::-1] + self.score[tokens]
            scores[tokens < 0] = -np.inf
            size = scores.argmax(axis=0)
            best[end], last[end] = scores[size, np.arange(n)], tokens[size, np.arange(n)]
        found, counts = np.zeros((n, length), "<i4"), np.zeros(n, np.int64)
        live, at = np.arange(n), np.full(n, length)
        while live.size:
            token = last[at[live], live]
            counts[live] += 1
            found[live, length - counts[live]] = token
            at[live] -= self.length[token]
            live = live[at[live] > 0]
        return found, counts

    def fits_one(self, left: int, right: int) -> bool:
        code = left * (self.inert + 1) + right
        place = (code * int(FACTOR) % (1 << 64)) >> (64 - PAIR_BITS)
        if self.pair_codes[place] != code:
            self.pair_codes[place], self.pair_apart[place] = code, self.stay_apart(np.array([left]), np.array([right]))[0]
        return bool(self.pair_apart[place])

    def segment_word(self, word: str) -> list[int]:
        """Tokens of one word, by the same steps."""
        n = len(word)
        best, last, size_at = [0.0] + [-np.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for size in range(1, min(self.longest, end) + 1):
                piece = word[end - size : end]
                token = self.tokens[piece] if piece in self.usable else self.inert if size == 1 else -1
                if token < 0 or best[end - size] == -np.inf:
                    continue
                if self.kind == BPE and end > size and not self.fits_one(last[end - size], token):
                    continue
                score = best[end - size] + (float(self.score[token]) if self.kind == UNIGRAM else 0.0)
                if last[end] < 0 or score > best[end]:
                    best[end], last[end], size_at[end] = score, token, size
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= size_at[at]
        return out[::-1]

    def as_ids(self, word: str, tokens: list[int]) -> bytes:
        """Packed ids of a word's tokens; characters that no piece holds become bytes."""
        out, at = [], 0
        for token in tokens:
            size = self.sizes[token]
            if token < len(self.pieces):
                out.append(token)
            elif self.bytes:
                out += [self.bytes[b] for b in word[at : at + size].encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
            at += size
        return np.array(out, "<i4").tobytes()

    def words(self, text: str) -> list[str]:
        """The stretches of a normalised text that no piece reaches over."""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        text = (" " if self.prefix else "") + text
        text = text.replace(" ", SPACE)
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text) if self.whole_words else [text]

    def learn(self, words: set[str]) -> None:
        """Encode words that are not in memory. A full generation becomes the older one, and words of the
        older one come back when they are asked for, so frequent words are never learnt again."""
        if len(self.memo) + len(words) > MEMO_WORDS and self.memo:
            self.memo, self.older = {}, self.memo
        by_length: dict[int, list[str]] = {}
        for word in words:
            if word in self.memo:
                continue
            if (known := self.older.get(word)) is not None:
                self.memo[word] = known
            else:
                by_length.setdefault(len(word), []).append(word)
        for length, group in by_length.items():
            if length > LONG_WORD or len(group) < FEW_WORDS:
                self.memo.update((w, self.as_ids(w, self.segment_word(w))) for w in group)
                continue
            for i in range(0, len(group), BLOCK_WORDS):
                block = group[i : i + BLOCK_WORDS]
                found, counts = self.segment_batch(block)
                plain, rows = (found < len(self.pieces)).all(axis=1), found.tobytes()
                for row, (word, size, fine) in enumerate(zip(block, counts.tolist(), plain.tolist(), strict=True)):
                    end = 4 * length * (row + 1)
                    self.memo[word] = rows[end - 4 * size : end] if fine else self.as_ids(word, found[row, length - size :].tolist())

    def encode_packed(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of whole texts as little-endian 32-bit numbers.

        Texts are taken together until they hold enough new words for large blocks.
        """
        pending: list[list[str]] = []
        fresh: set[str] = set()
        for i, text in enumerate(texts):
            pending.append(self.words(text))
            fresh.update(pending[-1])
            if len(fresh) >= 2 * BLOCK_WORDS or i == len(texts) - 1:
                self.learn(fresh)
                for words in pending:
                    yield b"".join(map(self.memo.__getitem__, words))
                pending, fresh = [], set()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_packed(texts)]

    def decode_packed(self, packed: list[bytes]) -> list[bytes]:
        """The bytes that packed ids stand for. Control pieces vanish, and with them the space put before a
        text. Lists are taken together while they are short, so that memory stays that of a long one."""
        out, some, size = [], [], 0
        for one in packed:
            some.append(one)
            size += len(one)
            if size > 4 * DECODED_IDS:
                out += self.gathered(some)
                some, size = [], 0
        return out + self.gathered(some)

    def gathered(self, packed: list[bytes]) -> list[bytes]:
        """Lists of packed ids decoded in one gather from the pieces' bytes."""
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = np.frombuffer(b"".join(packed), "<i4")
        lengths = self.printed_length[ids]
        ends = np.cumsum(lengths, dtype=np.int64)
        shift = self.printed_start[ids] - (ends - lengths)
        whole = self.printed_bytes[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        out = [whole[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
        if not self.prefix:
            return out
        return [x[1:] if x.startswith(b" ") and self.spaced(y) else x for x, y in zip(out, packed, strict=True)]

    def spaced(self, packed: bytes) -> bool:
        """Whether the first piece that prints begins with the space of the text's beginning."""
        first = next((i for (i,) in struct.iter_unpack("<i", packed) if self.pieces[i][2] != CONTROL), None)
        return first is not None and self.pieces[first][0].startswith(SPACE)

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed([np.array(ids, "<i4").tobytes()])[0].decode("utf-8", "replace")


@cache
def model(path: str) -> PieceModel:
    """One model for each worker process and file."""
    return PieceModel(path)


def _coder(path: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = batch.column("text").to_pylist()
            packed = list(pieces.encode_packed(texts))
            counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            decoded = pieces.decode_packed(packed)
            same = [a.encode("utf-8", "replace") == b for a, b in zip(texts, decoded, strict=True)]
            decoded = [b if fine else b.decode("utf-8", "replace").encode() for b, fine in zip(decoded, same, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4"))),
                    pa.array(counts),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                    pa.array(same),
                ],
                ["id", "ids", "n_tokens", "decoded_sha256", "round_trip"],
            )

    return code


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, decoded_sha256, round_trip) of every row; one pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    empty = rows.select("id", F.expr("cast(array() as array<int>)").alias("ids"), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("decoded_sha256"), F.lit(True).alias("round_trip"))
    return rows.mapInArrow(_coder(model_path), empty.schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with the text of their ids as ``decoded`` (a column of that name gives way)."""
    rows = rows.drop("decoded")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path)
        for batch in batches:
            found = pa.array([None if x is None else pieces.decode(x) for x in batch.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(decoded, rows.withColumn("decoded", F.lit("").cast("string")).schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
