"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Words, flags, held_out, labelled_sample, map_texts, mix
from palaver.session import durable

_LETTERS = flags(b"abcdefghijklmnopqrstuvwxyz0123456789'") | (np.arange(256) >= 0x80)
_BLOCK = 512
#: Share of the examples from which on a term's weights are a row over all examples instead of postings.
_OFTEN = 0.1
#: Texts whose frequent terms are multiplied at once.
_TOGETHER = 64
#: Lengths in bytes of the prefixes that count as terms besides whole words.
PREFIXES = (4, 5, 6, 7)
#: Length of the marked terms of a vector beside that of all its words, which is 1.
MARKED = 2.0


def _fold(texts: list[str]) -> list[bytes]:
    return [t.lower().encode() for t in texts]


@dataclass
class BlockMaxIndex:
    """Postings by term, cut into blocks of 512 examples with the greatest weight of each block.

    ``terms`` are the sorted hashes of all whole words of the examples, ``marked`` those of the marked words and prefixes
    (``names``); a marked term is a position of its own after the words. ``search`` returns the exact best examples:
    the block with the greatest upper bound gives a k-th best cosine, and the blocks whose bound is below it are left out.
    """

    terms: np.ndarray
    names: list[str]
    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    prior_empty: float = 0.0
    prior: float = 0.0
    marked: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    unseen: float = 1.0

    def build(self, rows: list[np.ndarray], weights: list[np.ndarray]) -> None:
        """Sort the postings by term; only they are sent to the tasks, ``unfold`` makes the rest of the index there."""
        size = len(self.terms) + len(self.marked)
        example = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        term = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        weight = np.concatenate(weights) if rows else np.zeros(0)
        order = np.argsort(term, kind="stable")  # the examples of a term stay in their order
        self.example, self.weight = example[order], weight[order]
        self.count, self.cut = np.bincount(term, minlength=size).astype(np.int32), None

    def unfold(self) -> None:
        """Blocks with their greatest weights, and the rows of the frequent terms."""
        n, size = len(self.labels), len(self.count)
        blocks = self.blocks = max(1, -(-n // _BLOCK))
        term = np.repeat(np.arange(size, dtype=np.int32), self.count)
        place = term.astype(np.int64) * blocks + self.example // _BLOCK
        first = np.flatnonzero(np.diff(place, prepend=-1))
        self.top = np.zeros((size, blocks), np.float32)
        if len(first):
            self.top.reshape(-1)[place[first]] = np.maximum.reduceat(self.weight, first) * (1 + 1e-6)  # never under the weight
        often = np.flatnonzero(self.count >= max(_BLOCK, n * _OFTEN))
        self.row = np.full(size, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n))
        frequent = self.row[term] >= 0
        self.dense[self.row[term[frequent]], self.example[frequent]] = self.weight[frequent]
        self.example, self.weight, place = self.example[~frequent], self.weight[~frequent], place[~frequent]
        del term, first, frequent
        first = np.flatnonzero(np.diff(place, prepend=-1))
        cut = np.zeros(size * blocks + 1, np.int32)
        cut[place[first] + 1] = np.diff(first, append=len(place))
        self.cut = np.cumsum(cut, out=cut)

    def vector(self, term: np.ndarray, count: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
        """The words' TF-IDF at length 1 (``others`` counts words that no example has) and, if there are any, the marked
        terms' at length MARKED; both together at length 1."""
        weight = (1 + np.log(count)) * self.idf[term]
        word = term < len(self.terms)
        rest = 0.0 if others is None else np.sum(((1 + np.log(others)) * self.unseen) ** 2)
        whole, strong = np.sqrt(np.sum(weight[word] ** 2) + rest), np.linalg.norm(weight[~word])
        if strong:
            weight[~word] *= MARKED / strong
        if whole:
            weight[word] /= whole
        return weight / np.sqrt((whole > 0) + (strong > 0) * MARKED ** 2)

    def search(self, term: np.ndarray, weight: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best (cosine, example); ties go to the lower example."""
        return self.search_all([(term, weight)], k)[0]

    def search_all(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """``search`` of many texts: one product of matrices gives what the frequent terms add to their cosines."""
        if self.cut is None:
            self.unfold()
        out: list[list[tuple[float, int]]] = []
        for at in range(0, len(texts), _TOGETHER):
            some = texts[at:at + _TOGETHER]
            rows = [self.row[term] for term, _ in some]
            often = np.zeros((len(some), len(self.dense)))
            for i, (row, (_, weight)) in enumerate(zip(rows, some)):
                often[i, row[row >= 0]] = weight[row >= 0]
            for row, (term, weight), total in zip(rows, some, often @ self.dense):
                out.append(self._search(term, weight, row < 0, total, k) if len(term) else [])
        return out

    def _search(self, term: np.ndarray, weight: np.ndarray, rare: np.ndarray, total: np.ndarray, k: int) -> list[tuple[float, int]]:
        bound = weight @ self.top[term]
        first = int(bound.argmax())
        term, weight = term[rare] * self.blocks, weight[rare]
        best = self._best(term, weight, total, first, first + 1, k)
        least = best[-1][0] if len(best) == k else 0.0
        still = np.flatnonzero((bound > 0) & (bound >= least - 1e-9))
        if not len(still) or still[0] == still[-1] == first:
            return best
        return self._best(term, weight, total, still[0], still[-1] + 1, k)

    def _best(self, place: np.ndarray, weight: np.ndarray, total: np.ndarray, start: int, end: int, k: int) -> list[tuple[float, int]]:
        """The k best among the examples of a span of blocks; ``total`` holds what the frequent terms add."""
        low = start * _BLOCK
        total = total[low:end * _BLOCK]
        a, b = self.cut[place + start], self.cut[place + end]
        length = b - a
        at = np.repeat(a - (np.cumsum(length) - length), length)
        if len(at):
            at += np.arange(len(at))
            total = total + np.bincount(self.example[at] - low, np.repeat(weight, length) * self.weight[at], len(total))
        least = np.partition(total, -k)[-k] if len(total) > k else 0.0
        found = np.flatnonzero((total > 0) & (total >= least - 1e-11))
        value = np.round(total[found], 12)
        best = np.lexsort((found, -value))[:k]
        return list(zip(value[best].tolist(), (found[best] + low).tolist()))


def _terms_of(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of all whole words, then of the prefixes of each length in bytes."""
    if not len(words.start):
        return []
    out = [(words.text, words.hash)]
    running = np.zeros(len(words.start), np.uint64)
    for at in range(max(PREFIXES)):
        inside = words.length > at
        byte = words.data[np.minimum(words.start + at, len(words.data) - 1)].astype(np.int64)
        running = running + np.where(inside, Words._TABLE[(at << 8) + byte], np.uint64(0))
        if at + 1 in PREFIXES:
            longer = words.length > at + 1
            out.append((words.text[longer], mix(running[longer] + np.uint64(at + 1))))
    return out


def term_hash(term: str) -> int:
    """The hash of a word, or of a prefix written with a star."""
    if not term.endswith("*"):
        return Words.hash_of(term.encode())
    raw = term[:-1].encode()
    return int(mix(np.array([Words.hash_of(raw) + len(raw) & (1 << 64) - 1], np.uint64))[0])


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Per text, the hashes of its words, each once."""
    words = Words(_fold(texts), _LETTERS)
    value, at = np.unique(words.hash, return_inverse=True)
    key = np.unique(words.text * len(value) + at)
    return np.split(value[key % max(1, len(value))], np.searchsorted(key, np.arange(1, len(texts)) * len(value)))


def term_counts(index: BlockMaxIndex, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text, the positions of its indexed terms, how often each occurs, and the counts of its words in no example."""
    words = Words(_fold(texts), _LETTERS)
    known, size = len(index.terms), len(index.terms) + len(index.marked)
    if not len(words.start):
        return [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * len(texts)
    at = np.minimum(np.searchsorted(index.terms, words.hash), max(0, known - 1))
    strange = index.terms[at] != words.hash if known else np.ones(len(at), bool)
    names, place = np.unique(words.hash[strange], return_inverse=True)
    at[strange] = size + place
    width = size + len(names)
    keys = [words.text * width + at]
    for text, value in _terms_of(words) if len(index.marked) else []:
        at = np.minimum(np.searchsorted(index.marked, value), len(index.marked) - 1)
        hit = index.marked[at] == value
        keys.append(text[hit] * width + known + at[hit])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    term, count = key % width, count.astype(float)
    ends = np.searchsorted(key, np.arange(len(texts) + 1) * width)
    cut = [a + np.searchsorted(term[a:b], size) for a, b in zip(ends, ends[1:])]
    return [(term[a:c], count[a:c], count[c:b]) for a, c, b in zip(ends, cut, ends[1:])]


def marked_terms(sample: DataFrame, bound: int, least: float, purity: float) -> DataFrame:
    """Words and prefixes that mark the label: at most ``bound``, with a likelihood ratio of ``least`` or more, and
    ``purity`` or more of their contexts labelled.

    A context is the word with the one before, or with the one after: the side with more of them counts, so the words of
    a fixed phrase are found at its ends. Counting contexts, not documents, keeps the words of a much copied text out.
    """
    token = r"[^a-z0-9'\x{80}-\x{10ffff}]+"
    words = F.filter(F.split(F.lower("text"), token), lambda w: w != "")
    none, rest = F.array(F.lit("")), F.greatest(F.size("w") - 1, F.lit(0))
    sides = F.arrays_zip(F.concat(none, F.slice("w", 1, rest)).alias("b"), F.col("w").alias("a"), F.concat(F.slice("w", 2, rest), none).alias("c"))
    pairs = (sample.select("label", words.alias("w"))
             .select("label", F.explode(sides).alias("p"))
             .where(F.col("p.a").isNotNull())
             .select("label", "p.a", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("p.b").alias("other")),
                                                       F.struct(F.lit(1).alias("side"), F.col("p.c").alias("other")))).alias("o"))
             .groupBy("o.side", "o.other", F.col("a").alias("word"))
             .agg(F.max("label").alias("hi"), F.min("label").alias("lo")))
    whole = F.octet_length("word")
    heads = F.transform(F.array(*[F.left("word", F.lit(k)) for k in range(3, max(PREFIXES) + 1)]), lambda h: F.concat(h, F.lit("*")))
    heads = F.filter(heads, lambda h: (F.octet_length(h) - 1).isin(*PREFIXES) & (F.octet_length(h) <= whole))
    terms = pairs.select(F.explode(F.concat(F.array("word"), heads)).alias("word"), "side", "hi", "lo")
    counts = terms.groupBy("word", "side").agg(F.sum("hi").cast("double").alias("pos"), F.sum(1 - F.col("lo")).cast("double").alias("neg"))
    both = counts.groupBy("word").agg(F.max(F.struct(F.col("pos") + F.col("neg"), "pos", "neg")).alias("m"))
    counts = both.select("word", "m.pos", "m.neg")
    total = sample.select(F.avg(F.col("label").cast("double")).alias("share")).first()
    share = total["share"]
    if not share or share >= 1:
        return counts.select("word", F.lit(0.0).alias("ratio")).where("false")
    n = F.col("pos") + F.col("neg")

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (part(F.col("pos"), n * share) + part(F.col("neg"), n * (1 - share)))
    return (counts.where((F.col("pos") >= 3) & (F.col("pos") >= purity * n))
            .withColumn("ratio", ratio).where(F.col("ratio") >= least)
            .orderBy(F.desc("ratio"), "word").limit(bound).select("word", "ratio"))


def fit_toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, rest: int = 0,
                 bound: int = 8000, max_terms: int = 4000, least: float = 30.0, purity: float = 0.95) -> BlockMaxIndex:
    """Index at most ``bound`` labelled rows whose id is not held out, by all their words; at most ``max_terms`` marked
    words and prefixes weigh more.

    Without labelled rows the index is empty and every text has the score 0. Examples without a word are only counted.
    """
    sample = durable(labelled_sample(documents, labels, label, ~held_out(modulus, rest), bound))
    words = sorted({r["word"] for r in marked_terms(sample, max_terms, least, purity).collect()})
    hashed = sorted((term_hash(w), w) for w in words)

    def hashes():
        return lambda texts: {"terms": [t.view(np.int64) for t in word_hashes(texts)]}

    seen = map_texts(sample, "terms array<bigint>", hashes, keep=["doc_id"])
    seen = seen.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    terms, df = seen["term"].to_numpy().view(np.uint64), seen["df"].to_numpy()
    order = np.argsort(terms)
    index = BlockMaxIndex(terms[order], [w for _, w in hashed], np.zeros(0), np.zeros(0), np.zeros(0, np.int64),
                          marked=np.array([h for h, _ in hashed], np.uint64))
    sent = documents.sparkSession.sparkContext.broadcast(index)  # the words of at most bound rows

    def make():
        def run(texts):
            found = term_counts(sent.value, texts)
            return {"terms": [t.astype(np.int32) for t, _, _ in found], "counts": [c.astype(np.int32) for _, c, _ in found]}
        return run

    rows = map_texts(sample, "terms array<int>, counts array<int>", make, keep=["doc_id", "label"]).toArrow().sort_by("doc_id")
    sent.destroy()
    y = rows["label"].to_numpy().astype(np.float64)
    found, counts = (_arrays(rows[name]) for name in ("terms", "counts"))
    strong = np.bincount(np.concatenate(found) if found else np.zeros(0, np.int64), minlength=len(terms) + len(hashed))[len(terms):]
    index.idf = np.log((len(y) + 1) / (np.concatenate([df[order], strong]) + 1)) + 1
    index.unseen = float(np.log(len(y) + 1) + 1)
    full = np.array([len(t) > 0 for t in found], bool)
    index.prior = float(y.mean()) if len(y) else 0.0
    index.prior_empty = float((y[~full].sum() + index.prior) / ((~full).sum() + 1)) if len(y) else 0.0
    index.labels, index.ids = y[full], rows["doc_id"].to_numpy()[full]
    counts = [index.vector(t, c) for t, c in zip(found, counts) if len(t)]
    index.build([t for t in found if len(t)], counts)
    del rows, found, counts
    pa.default_memory_pool().release_unused()
    return index


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x for chunk in column.chunks for x in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])] if len(column) else []


def score_toxicity(documents: DataFrame, index: BlockMaxIndex, neighbours: int = 16, threshold: float = 0.5,
                   keep: list[str] | None = None) -> DataFrame:
    """Every document with ``score``, ``predicted`` and ``evidence`` (marked words, then the nearest examples and cosines).

    A neighbour of cosine c has c / (1.02 - c) squared votes, so a copy of an example outweighs fifteen texts that only share
    everyday words. A text without words has the rate of labelled texts without any; a null text counts as empty; columns
    of these names give way.
    """
    sent = documents.sparkSession.sparkContext.broadcast(index)  # the words of at most bound rows

    def make():
        own = sent.value

        def run(texts):
            score, evidence = np.full(len(texts), own.prior_empty), [""] * len(texts)
            found = term_counts(own, texts)
            nearest = own.search_all([(term, own.vector(term, count, others)) for term, count, others in found], neighbours)
            for i, ((term, _, others), near) in enumerate(zip(found, nearest)):
                if not len(term) and not len(others):
                    continue
                cosine = np.array([c for c, _ in near])
                weight = (cosine / (1.02 - cosine)) ** 2
                votes = own.labels[[x for _, x in near]] if near else np.zeros(0)
                score[i] = (weight @ votes + 0.5 * own.prior) / (weight.sum() + 0.5)
                strong = term[term >= len(own.terms)][:8] - len(own.terms)
                evidence[i] = " ".join(own.names[t] for t in strong) + "; " + " ".join(f"{own.ids[x]}:{c:.3f}" for c, x in near[:3])
            score = np.clip(score, 0.0, 1.0)
            return {"score": score, "predicted": (score >= threshold).astype(np.int32), "evidence": evidence}
        return run

    return map_texts(documents, "score double, predicted int, evidence string", make, keep)
