"""Spelling variants: words one edit apart, found by searches over FM-indexes of the delimited vocabulary.

One edit leaves one half of a word as it is. A search matches that half exactly and extends over the other half
allowing one error. A word stands between delimiters, so either search goes one way only: from the front over the index of
the reversed words, from the back over the index of the words. Both directions are built, each where its searches run.

Two words one edit apart share the first or the last half of the longer one, so words that share a half go to one shard: every word
is dealt with words of its own length and as the shorter one of words a letter longer, four rows a word. Shards are
bounded by letters; a half that more letters share is cut into blocks, every block of searches against every block of words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import LOWER, SLICE_BYTES, slices
from palaver.session import durable, ship

#: Letters of the words of a shard, and of one block of a half shared by more.
SHARD = 1 << 18
#: Different words a task counts before it hands them on.
HELD = 400_000
_STEP = 16
_LOWER = LOWER.tobytes()


class SuffixIndex:
    """Suffix ranks of the text w0 $ w1 $ ... of sorted distinct words, with counts of symbols before every place."""

    def __init__(self, words: list[str], letters: list[str]):
        """``words`` sorted and distinct; ``letters`` sorted, with all that words and searches hold."""
        self.words = len(words)
        self.code = np.zeros(max(map(ord, letters), default=0) + 1, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.sigma = len(letters) + 1
        text = self.encode("\0".join(words) + "\0")
        n = len(text)
        order = self._order(text)
        self.bwt = np.concatenate([text[order - 1], np.full(_STEP, -1, np.int32)])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))[:-1]])
        blocks = n // _STEP + 1
        cells = np.bincount((np.arange(n) // _STEP) * self.sigma + self.bwt[:n], minlength=blocks * self.sigma).reshape(blocks, self.sigma)
        self.before = np.zeros((blocks + 1, self.sigma), np.int64)
        np.cumsum(cells, axis=0, out=self.before[1:])

    def encode(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    @staticmethod
    def _order(text: np.ndarray) -> np.ndarray:
        """Places by the text from there to the next delimiter, equal ones by place: ranks of prefixes, doubled each round."""
        n = len(text)
        ends = np.flatnonzero(text == 0)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1  # symbols up to the delimiter
        rank, width = text.astype(np.int64), 1
        while width < left.max(initial=0):
            following = np.zeros(n, np.int64)
            inside = np.flatnonzero(left > width)
            following[inside] = rank[inside + width] + 1
            key = rank * (n + 2) + following
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank[order] = step
            width *= 2
        return np.argsort(rank, kind="stable")

    def count(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place in the last column."""
        block, rest = place // _STEP, place % _STEP
        near = self.bwt[(block * _STEP)[:, None] + np.arange(_STEP - 1)]
        inside = (near == symbol[:, None]) & (np.arange(_STEP - 1) < rest[:, None])
        return self.before[block, symbol] + inside.sum(axis=1)

    def counts(self, place: np.ndarray) -> np.ndarray:
        """The same for all symbols."""
        block, rest = place // _STEP, place % _STEP
        near = self.bwt[(block * _STEP)[:, None] + np.arange(_STEP - 1)]
        row, column = np.nonzero(np.arange(_STEP - 1) < rest[:, None])
        extra = np.bincount(row * self.sigma + near[row, column], minlength=len(place) * self.sigma)
        return self.before[block] + extra.reshape(len(place), self.sigma)

    def search(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, word, whether a symbol was left out) for all words one replaced or left out symbol away.

        Search s consumes ``symbols[start[s]:][:size[s]]``, the last letter of the stored words first; its first ``exact[s]`` symbols
        must match. All searches go on together, one symbol a round; an interval of suffix ranks is the state.
        """
        q = np.arange(len(size))
        state = [q, np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.words), np.zeros(len(q), np.int8)]
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(state[0]):
            q, pos, lo, hi, edit = state
            done = pos == size[q]
            if done.any():
                ended = np.flatnonzero(done & (edit > 0))
                zero = np.zeros(len(ended), np.int64)
                word = self.count(zero, lo[ended])
                whole = self.count(zero, hi[ended]) > word
                hits.append((q[ended][whole], word[whole], edit[ended][whole] == 2))
                q, pos, lo, hi, edit = (c[~done] for c in state)
            if not len(q):
                break
            c = symbols[start[q] + pos].astype(np.int64)
            new = [(q, pos + 1, self.first[c] + self.count(c, lo), self.first[c] + self.count(c, hi), edit)]
            free = np.flatnonzero((edit == 0) & (pos >= exact[q]))
            if len(free):
                low, high = self.counts(lo[free]), self.counts(hi[free])
                other = high > low
                other[:, 0] = False
                other[np.arange(len(free)), c[free]] = False
                i, s = np.nonzero(other)
                new.append((q[free][i], pos[free][i] + 1, self.first[s] + low[i, s], self.first[s] + high[i, s], np.full(len(i), 1, np.int8)))
                last = pos[free] + 1 == size[q[free]]
                following = symbols[np.where(last, start[q[free]], start[q[free]] + pos[free] + 1)]
                drop = free[last | (following != c[free])]  # of equal symbols in a row the last is left out
                new.append((q[drop], pos[drop] + 1, lo[drop], hi[drop], np.full(len(drop), 2, np.int8)))
            state = [np.concatenate(x) for x in zip(*new)]
            alive = state[3] > state[2]
            state = [x[alive] for x in state]
        if not hits:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(bool)
        return tuple(np.concatenate(x) for x in zip(*hits))


def near_in_shard(words: list[str], searches: list[str], front: bool) -> list[tuple[int, int, bool]]:
    """(search, word, left out) of all words that keep the front (or else the back) half of a search and are one edit away from it."""
    turned = [w[::-1] for w in words] if front else words
    order = sorted(range(len(words)), key=turned.__getitem__)
    index = SuffixIndex([turned[i] for i in order], sorted(set().union(*map(set, words), *map(set, searches))))
    consumed = searches if front else [w[::-1] for w in searches]
    size = np.fromiter(map(len, searches), np.int64, len(searches))
    exact = size // 2 if front else size - size // 2
    symbols = index.encode("".join(consumed))
    q, w, out = index.search(symbols, np.cumsum(size) - size, size, exact)
    return list(zip(q.tolist(), np.array(order, np.int64)[w].tolist(), out.tolist()))


_EDGES = "word string, near string, near_n bigint"


def _search_shard(table: pa.Table) -> pa.Table:
    front = bool(table["side"][0].as_py() == 0)
    count, index, search = {}, set(), set()
    for word, n, stored, sought in zip(*(table[c].to_pylist() for c in ("word", "n", "stored", "sought"))):
        count[word] = n
        if stored:
            index.add(word)
        if sought:
            search.add(word)
    words, searches = sorted(index), sorted(search)
    out: tuple[list, list, list] = ([], [], [])
    for s, w, left_out in near_in_shard(words, searches, front) if words and searches else ():
        a, b = searches[s], words[w]
        for x, y in ((a, b), (b, a)) if left_out else ((a, b),):  # of equal lengths, each finds the other
            out[0].append(x)
            out[1].append(y)
            out[2].append(count[y])
    return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """Both directions of every pair of words one inserted, deleted or replaced code point apart: word, near, near_n.

    ``words``: distinct, not null ``word`` of two code points or more, and ``n``. A pair may come out more than once.
    """
    size = F.length("word")

    def half(length: Column, side: int, sought: bool) -> Column:
        cut = (length / 2).cast("int")
        kept = F.left("word", cut) if side == 0 else F.right("word", length - cut)
        return F.struct(F.lit(side).alias("side"), F.xxhash64(length, F.lit(side), kept).alias("half"), F.lit(sought).alias("sought"))

    dealt = words.select("word", "n", F.inline(F.array(half(size, 0, True), half(size, 1, True), half(size + 1, 0, False), half(size + 1, 1, False))))
    letters = words.agg(F.sum(size + 1)).first()[0] or 0
    shards = max(1, -(-2 * letters // shard))
    hot = durable(dealt.groupBy("half").agg((F.floor(F.sum(size + 1) / shard) + 1).cast("int").alias("blocks")).where("blocks > 1"))
    if hot.isEmpty():
        placed = dealt.select("word", "n", "side", "sought", F.lit(True).alias("stored"), "half", F.lit(0).alias("b"), F.lit(0).alias("q"))
    else:
        cut = dealt.join(hot, "half", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("word", F.lit(7)), F.col("blocks")).cast("int")
        every = F.sequence(F.lit(0), F.col("blocks") - 1)
        stored = cut.select("word", "n", "side", F.lit(False).alias("sought"), F.lit(True).alias("stored"), "half", own.alias("b"), F.explode(every).alias("q"))
        sought = cut.where("sought").select("word", "n", "side", "sought", F.lit(False).alias("stored"), "half", F.explode(every).alias("b"), own.alias("q"))
        placed = stored.unionByName(sought)
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("half", "b", "q"), F.lit(shards)).cast("int"))
    ship(words.sparkSession)
    placed = placed.select("word", "n", "stored", "sought", "side", "shard").repartition(2 * shards, "side", "shard")  # little data, much work
    return placed.groupBy("side", "shard").applyInArrow(_search_shard, _EDGES)


def planted_words(documents: DataFrame, least: int = 5, times: int = 3, every: int = 97) -> DataFrame:
    """word, n: the letter runs of all texts, lower-cased in A-Z, of ``least`` code points and ``times`` occurrences or more.

    A run loses the code point h % length where ``every`` divides h, the crc32 of ``<doc_id>:<run>``. A null text has
    no runs, a null id reads as the empty text. Tasks count before they hand words on, ``HELD`` different ones at a time.
    """
    def run(batches):
        counts: Counter = Counter()

        def taken() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return made

        for whole in batches:
            for batch in slices(whole, SLICE_BYTES):
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                    low = text.lower() if text.isascii() else text.encode().translate(_LOWER).decode()
                    head = zlib.crc32(f"{key}:".encode())
                    for word, n in Counter(runs.findall(low)).items():
                        h = zlib.crc32(word.encode(), head)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        counts[word] += n
                if len(counts) > HELD:
                    yield taken()
        yield taken()

    runs = re.compile(f"[a-z\u00c0-\u00ff]{{{least},}}")
    ship(documents.sparkSession)
    texts = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").where("text is not null")
    counted = texts.mapInArrow(run, "word string, n bigint").where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= times)


def group_variants(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words and their counts.

    The form of a word is its near word of largest n (of equal ones the first in code-point order) if that n is at least twice
    the word's own, else null; the root is the last of the chain of forms, the word itself without a form. Counts grow along a
    chain, so chains end and have no circles; they are followed by doubling, as many rounds as the logarithm of the longest one.
    Null words are left out, repeated words add up, words of any length are searched whole; other columns are left aside.
    An empty table gives no rows.
    """
    words = durable(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    found = near_words(words.where(F.length("word") > 1), shard).groupBy("word").agg(  # at most letters x places near words
        F.collect_set(F.struct((-F.col("near_n")).alias("less"), "near")).alias("all"))
    best = F.array_min("all")
    found = found.select("word", F.size("all").cast("long").alias("n_near"), best["near"].alias("near"), (-best["less"]).alias("near_n"))
    strong = F.col("near_n") >= 2 * F.col("n")
    rows = durable(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")))
    links = durable(rows.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not links.where("moved").isEmpty():
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = durable(links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return rows.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
