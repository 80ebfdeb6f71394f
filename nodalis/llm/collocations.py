"""Phrase collocations by level-wise counting with double-array tries.

Counts grow one word a level. The phrases of a level that reach the least count become a double-array
trie over word codes, with one root for each language, which is broadcast; in every task all positions
of a block of text start at their language's root and advance together, level by level, by look-ups.
A position that ends in an accepting state, and whose next one does too, is an Apriori-safe
candidate: the phrase and one more word, both of whose parts are frequent. A candidate's state is its
phrase's accepting state and that word; states are counted by ``bincount`` and the counts of all blocks
summed by Spark. Candidates are so never stored before they are seen, and no pair of frequent words that
never meet costs anything.

A trie holds at most ``most`` phrases. More phrases are dealt by hash into several tries, each of which
passes over the texts on its own; the second part of a candidate is then checked by a join instead. So
what is broadcast, and what a task holds, has a bound that does not grow with the corpus.

Only the letters A to Z are lower-cased. Defined cases: a null text is an empty one, a null language is
``und``; texts and words of any length are taken whole; repeated rows and rows without id count each;
further columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import batched, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodalis.llm.byte_bpe import portions
from nodalis.llm.common import staged, table, text_or_empty

LEAST, LONGEST, TOP = 100, 5, 2000
MOST_PHRASES = 1 << 18  # phrases of one trie
BLOCK_BYTES = 4 << 20  # texts whose positions advance together, unless one text is longer
BITS = 10  # of a word code's low digit
LOW = (1 << BITS) - 1
TRIES = 64  # gaps that a node's children are tried in before they go to the end of a double array
ROWS = 1 << 15  # rows of counts that are passed on together
MOST_WORDS = 1 << 17  # distinct words that a task counts before it passes them on
#: What ends a piece, and a byte that stands for it once the others are gone; what separates words.
STOPS, STOP, BLANKS = b".,;:!?\n\x0b\x0c\r", b".", b" \t"
_TABLE = bytes(STOP[0] if b in STOPS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_COUNTS = "lang string, phrase binary, f long"


def words_of(texts: Iterable[str]) -> list[bytes]:
    """The words of texts in order, with STOP between pieces and between texts."""
    joined = STOP.join(t.encode() for t in texts).translate(_TABLE)
    return joined.replace(STOP, b" . ").split()


class Trie:
    """A double array: the child of state s by symbol c is base[s] + c, if check there is s.

    A path begins with its language; a word's code is two symbols, its high and its low digit, so that a
    state's children lie close together and the array is hardly longer than it has states."""

    def __init__(self, phrases: list[tuple[str, bytes]]):
        self.langs = sorted({lang for lang, _ in phrases})
        number = {lang: i for i, lang in enumerate(self.langs, 1)}
        self.codes = {w: i for i, w in enumerate(sorted({w for _, p in phrases for w in p.split(b" ")}), 1)}
        width = max((len(self.codes) >> BITS) + 1, 1 << BITS, len(self.langs)) + 1
        edges: dict[int, int] = {}  # (node, symbol) as one number: the node it leads to
        ends = np.zeros(len(phrases), np.int64)
        for i, (lang, phrase) in enumerate(phrases):
            node = edges.setdefault(number[lang], len(edges) + 1)
            for code in map(self.codes.__getitem__, phrase.split(b" ")):
                node = edges.setdefault(node * width + (code >> BITS) + 1, len(edges) + 1)
                node = edges.setdefault(node * width + (code & LOW) + 1, len(edges) + 1)
            ends[i] = node
        state = self.place(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)), width)
        self.roots = {lang: int(state[edges[number[lang]]]) for lang in self.langs}
        self.accept = np.full(len(self.check), -1, np.int32)
        self.accept[state[ends]] = np.arange(len(phrases))

    def place(self, edges: np.ndarray, to: np.ndarray, width: int) -> np.ndarray:
        """Give every node a state, those of nodes with many children first. State 0 leads nowhere, 1 is the root."""
        order = np.argsort(edges)
        parents, symbols, to = edges[order] // width, edges[order] % width, to[order]
        nodes, begins, sizes = np.unique(parents, return_index=True, return_counts=True)
        size = 2 * width + 2 * len(edges)
        free, state, base_of = np.ones(size, bool), np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        free[:2] = False
        state[0] = 1
        lowest = beyond = width
        for i in np.argsort(-sizes, kind="stable").tolist():
            held = slice(begins[i], begins[i] + sizes[i])
            own = symbols[held]
            first, last = int(own[0]), int(own[-1])
            while not free[lowest]:
                lowest += 1
            at, tries = lowest, 0
            while True:
                base = at - first
                if base + last + 1 >= len(free):
                    free = np.concatenate([free, np.ones(width + len(free) // 2, bool)])
                if free[base + own].all():
                    break
                tries += 1
                at = at + 1 + int(np.argmax(free[at + 1 :])) if tries < TRIES else max(at + 1, beyond)
            free[base + own] = False
            beyond = max(beyond, base + last + 1)
            base_of[nodes[i]] = base
            state[to[held]] = base + own
        self.base, self.check = np.zeros(beyond + width, np.int32), np.full(beyond + width, -1, np.int32)
        self.base[state] = base_of
        self.check[state[to]] = state[parents]
        return state

    def advance(self, states: np.ndarray, codes: np.ndarray, depth: int) -> np.ndarray:
        """The states that positions reach with the next ``depth`` words; 0 where the trie has no such path."""
        alive = np.flatnonzero(states)
        now = states[alive]
        for level in range(depth):
            inside = alive + level < len(codes)
            alive, now = alive[inside], now[inside]
            for digit in (lambda c: c >> BITS, lambda c: c & LOW):
                to = self.base[now] + digit(codes[alive + level]) + 1
                held = self.check[to] == now
                alive, now = alive[held], to[held]
        out = np.zeros(len(states), np.int32)
        out[alive] = now
        return out


def _packed_trie(rows: pa.Table) -> pa.Table:
    """The trie of a shard's phrases, and the phrases in its order, as bytes."""
    phrases = sorted(zip(rows.column("lang").to_pylist(), rows.column("phrase").to_pylist(), strict=True))
    packed = zlib.compress(pickle.dumps((Trie(phrases), phrases)), 1)
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "trie": pa.array([packed], pa.binary())})


def _languages(batch: pa.RecordBatch) -> dict[str, list[str]]:
    """The texts of a batch by language."""
    found: dict[str, list[str]] = defaultdict(list)
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        found[lang].append(text)
    return found


def _rows(counts: Iterable[tuple[str, bytes, int]]) -> Iterator[pa.RecordBatch]:
    """Counts as batches of ``ROWS`` rows."""
    for part in batched(counts, ROWS):
        langs, phrases, times = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(times, pa.int64())], ["lang", "phrase", "f"])


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in (part for whole in batches for part in portions(whole, "text", BLOCK_BYTES)):
        for lang, texts in _languages(batch).items():
            counts[lang].update(words_of(texts))
            del counts[lang][STOP]
        if sum(map(len, counts.values())) > MOST_WORDS:
            yield from _rows((lang, w, n) for lang, c in counts.items() for w, n in c.items())
            counts.clear()
    yield from _rows((lang, w, n) for lang, c in counts.items() for w, n in c.items())


def _candidate_counter(trie, whole: bool, depth: int):
    """Counts of the candidates of ``depth`` + 1 words. ``whole``: the trie holds all phrases."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, phrases = pickle.loads(zlib.decompress(trie.value))
        for batch in (part for every in batches for part in portions(every, "text", BLOCK_BYTES)):
            number, parts, roots = defaultdict(count().__next__), [], []
            number[STOP]
            for lang, texts in _languages(batch).items():
                if root := held.roots.get(lang, 0):
                    words = [STOP, *words_of(texts)]
                    parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    roots.append(root)
                    del words
            if not parts:
                continue
            local = np.concatenate(parts)
            codes = np.fromiter(map(held.codes.get, number, repeat(0)), np.int32, len(number))[local]
            states = held.advance(np.repeat(np.array(roots, np.int32), list(map(len, parts))), codes, depth)
            reached = held.accept[states] >= 0
            reached &= states > 0
            at = np.flatnonzero(reached[:-1])
            at = at[at + depth < len(local)]
            at = at[reached[at + 1]] if whole else at[local[at + depth] > 0]
            # A candidate's accepting state: its phrase's and the next word, numbered in order of the pair.
            keys, state = np.unique(held.accept[states[at]] * np.int64(len(number)) + local[at + depth], return_inverse=True)
            times = np.bincount(state, minlength=len(keys))
            names = list(number)
            del parts, local, codes, states, reached, at, state
            for i in range(0, len(keys), ROWS):
                first, last = np.divmod(keys[i : i + ROWS], len(names))
                yield from _rows((phrases[p][0], phrases[p][1] + b" " + names[w], n) for p, w, n in zip(first.tolist(), last.tolist(), times[i : i + ROWS].tolist(), strict=True))

    return counted


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST_PHRASES, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of 1 to ``longest`` words that occur ``least`` times, and (lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    words = staged(texts.mapInArrow(_word_counter, _COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    totals = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "words-by-language")
    levels = [words.where(F.col("f") >= least)]
    for k in range(2, longest + 1):
        level = staged(levels[-1], "phrases")
        levels[-1] = level
        shards = -(-level.count() // most)
        if not shards:
            break
        dealt = level.withColumn("shard", F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)).cast("int"))
        tries = staged(dealt.groupBy("shard").applyInArrow(_packed_trie, "shard int, trie binary"), "tries")
        parts = []
        for shard in range(shards):
            for row in tries.where(F.col("shard") == shard).collect():  # one packed trie of about ``most`` phrases
                sent = spark.sparkContext.broadcast(bytes(row.trie))
                parts.append(texts.mapInArrow(_candidate_counter(sent, shards == 1, k - 1), _COUNTS))
        found = reduce(DataFrame.unionByName, parts).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        if shards > 1:
            found = found.withColumn("rest", F.substring_index(F.col("phrase").cast("string"), " ", 1 - k).cast("binary"))
            found = found.join(level.select("lang", F.col("phrase").alias("rest")), ["lang", "rest"], "left_semi").select("lang", "phrase", "f")
        levels.append(found)
    numbered = [x.select("lang", F.lit(k).alias("k"), F.col("phrase").cast("string").alias("phrase"), "f") for k, x in enumerate(levels, 1)]
    return staged(reduce(DataFrame.unionByName, numbered), "frequent"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, most: int = MOST_PHRASES, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase of a times is cut after its first k words into parts of l and r times, which scores
    floor(1000 a n / (l r)); the lowest cut counts. Phrases inside a longer one that is as frequent go."""
    known, totals = frequent_phrases(docs, least, longest, most, lang_col, text_col)
    phrases = known.where("k > 1")
    words = F.split("phrase", " ")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    joined = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cuts = cuts.select("*", joined(1, F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("f", "n", "l", "r")}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact["f"] * exact["n"], exact["l"] * exact["r"])
    lowest = scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"), F.first("f").alias("a"), F.first("n").alias("n"))
    longer = phrases.where("k > 2").select("lang", "f", F.explode(F.array(joined(1, F.col("k") - 1), joined(2, F.col("k") - 1))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same phrases, counted one by one.
OP11_SQL = """
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM starts, (VALUES (1), (2), (3), (4), (5)) AS sizes(k)
  WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
known AS (SELECT * FROM counts WHERE f >= 100),
candidates AS (SELECT * FROM known WHERE k > 1),
cuts AS (
  SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut
  FROM candidates),
scores AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, c.cut,
         ((1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c
  JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
  JOIN totals t ON t.lang = c.lang),
lowest AS (
  SELECT * FROM scores
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM lowest o
  WHERE NOT EXISTS (
    SELECT 1 FROM candidates c
    WHERE c.lang = o.lang AND c.k > len(string_split(o.phrase, ' ')) AND 100 * c.f >= 100 * o.a
      AND contains(' ' || c.phrase || ' ', ' ' || o.phrase || ' '))),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
         phrase, a, l, r, n, score
  FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""
