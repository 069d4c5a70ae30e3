"""Language of code-switched text: a linear-chain conditional random field over words, by forward-backward."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Words, flags, held_out, map_texts, mix

_LETTERS = flags(b"abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0x80)
_BITS = 16


def _lower(text: str) -> str:
    """The text in small letters with as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text)])


class WordFeatures:
    """Hashed features of the words of some texts: n-grams of three bytes with the word's edges, affixes, the word itself."""

    def __init__(self, texts: list[str]):
        words = Words([_lower(t).encode() for t in texts], _LETTERS)
        self.words, self.count, self.length, self.text = words, words.count, words.length, words.text
        self.size = len(words.start)
        if not self.size:
            return
        data = np.where(words.inside, words.data, 0).astype(np.uint64)
        at = np.flatnonzero(words.inside)
        code = (data[np.maximum(at - 1, 0)] << np.uint64(16)) | (data[at] << np.uint64(8)) | data[np.minimum(at + 1, len(data) - 1)]
        self.gram = self._bucket(code)
        self.first = np.cumsum(words.length) - words.length
        reach = len(data) - 1

        def affix(positions, kind):
            value = np.zeros(self.size, np.uint64)
            for p in positions:
                value = (value << np.uint64(8)) | data[np.clip(p, 0, reach)]
            return self._bucket(value + np.uint64(kind << 40))

        s, e = words.start, words.end - 1
        self.single = [affix((s, s + 1, s + 2, np.minimum(s + 3, e)), 1), affix((e, e - 1, e - 2, np.maximum(e - 3, s)), 2),
                       self._bucket(words.hash)]

    @staticmethod
    def _bucket(code: np.ndarray) -> np.ndarray:
        return (mix(code) >> np.uint64(64 - _BITS)).astype(np.int64)

    def scores(self, weight: np.ndarray) -> np.ndarray:
        """One score per word and label: the mean over its n-grams, plus affixes and lexicon."""
        total = np.add.reduceat(weight[self.gram], self.first, axis=0) / self.length[:, None]
        for index in self.single:
            total = total + weight[index]
        return total

    def gradient(self, per_word: np.ndarray) -> np.ndarray:
        out = np.zeros((1 << _BITS, per_word.shape[1]))
        spread = np.repeat(per_word / self.length[:, None], self.length, axis=0)
        for label in range(per_word.shape[1]):
            out[:, label] = np.bincount(self.gram, spread[:, label], minlength=1 << _BITS)
            for index in self.single:
                out[:, label] += np.bincount(index, per_word[:, label], minlength=1 << _BITS)
        return out


def forward_backward(score: np.ndarray, step: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word, and the expected number of transitions, of chains laid out one after the other."""
    n, labels = score.shape
    emit = np.exp(score - score.max(axis=1, keepdims=True))
    move = np.exp(step - step.max())
    start = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    start, size = start[order], count[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    alpha, beta = np.empty((n, labels)), np.empty((n, labels))
    previous = None
    for t in range(longest):
        at = start[:active[t]] + t
        now = emit[at] if previous is None else (previous[:active[t]] @ move) * emit[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = previous = now
    following = np.zeros((0, labels))
    for t in range(longest - 1, -1, -1):
        at = start[:active[t]] + t
        now = np.full((len(at), labels), 1.0 / labels)
        if len(following):
            k = len(following)
            now[:k] = (following * emit[at[:k] + 1]) @ move.T
            now[:k] /= now[:k].sum(axis=1, keepdims=True)
        beta[at] = following = now
    posterior = alpha * beta
    posterior /= posterior.sum(axis=1, keepdims=True)
    has_next = np.ones(n, bool)
    has_next[(np.cumsum(count) - 1)[count > 0]] = False
    i = np.flatnonzero(has_next)
    if not len(i):
        return posterior, np.zeros((labels, labels))
    left, right = alpha[i], emit[i + 1] * beta[i + 1]
    norm = np.einsum("ni,ij,nj->n", left, move, right)
    return posterior, (left / norm[:, None]).T @ right * move


@dataclass
class LanguageModel:
    languages: list[str]
    weight: np.ndarray
    step: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language with the greatest share of posterior mass, words weighing their bytes; `und` without a letter."""
        return self._named(texts, self._shares(WordFeatures(texts), len(texts))[0])

    def predict_spans(self, texts: list[str]) -> tuple[list[str], list[float], list[list[dict]]]:
        """``predict`` and the language spans: runs of words whose likeliest language is the same, by characters."""
        features = WordFeatures(texts)
        shares, posterior = self._shares(features, len(texts))
        names, score = self._named(texts, shares)
        spans: list[list[dict]] = [[] for _ in texts]
        if posterior is not None:
            words, label = features.words, posterior.argmax(axis=1)
            chars = np.cumsum((words.raw & 0xC0) != 0x80)
            chars = np.concatenate([[0], chars])
            origin = chars[np.concatenate([[0], words.ends_of_texts])[words.text]]
            start, end = chars[words.start] - origin, chars[words.end] - origin
            first = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
            last = np.append(first[1:], len(label)) - 1
            sure = np.add.reduceat(posterior.max(axis=1), first) / (last - first + 1)
            for text, a, b, x, p in zip(words.text[first].tolist(), start[first].tolist(), end[last].tolist(), label[first].tolist(), sure.tolist()):
                if names[text] != "und":
                    spans[text].append({"start": a, "end": b, "lang": self.languages[x], "posterior": min(1.0, p)})
        return names, score, spans

    def _named(self, texts: list[str], shares: np.ndarray) -> tuple[list[str], list[float]]:
        out, score = [], []
        for text, share in zip(texts, shares):
            total = share.sum()
            if total <= 0 or (not text.isascii() and not any(map(str.isalpha, text))):
                out.append("und")
                score.append(0.0)
            else:
                best = int(share.argmax())
                out.append(self.languages[best])
                score.append(min(1.0, float(share[best] / total)))
        return out, score

    def _shares(self, features: WordFeatures, texts: int) -> tuple[np.ndarray, np.ndarray | None]:
        out = np.zeros((texts, max(1, len(self.languages))))
        if not features.size or not self.languages:
            return out, None
        posterior, _ = forward_backward(features.scores(self.weight), self.step, features.count)
        for label in range(len(self.languages)):
            out[:, label] = np.bincount(features.text, posterior[:, label] * features.length, minlength=texts)
        return out, posterior


def fit_language(documents: DataFrame, modulus: int = 4, rest: int = 2, bound: int = 800, max_chars: int = 32768,
                 rounds: int = 16, rate: float = 0.3, decay: float = 1e-3) -> LanguageModel:
    """Learn every language, from at most ``bound`` documents over the number of languages (one at least) of each whose id
    is not held out, the first by hash order; of longer texts the first ``max_chars`` characters.

    Every word has the label of its document, so the gold transitions never change the language. The driver holds the
    chosen texts and 2^16 weights a language. Without such documents the model only answers `und`.
    """
    from pyspark.sql import Window

    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus, rest))
    ids = usable.select("lang", "doc_id").distinct()
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((1 << _BITS, 0)), np.zeros((0, 0)))
    each = max(1, bound // len(names))
    # Only the least hashes are ranked: of a frequent language about 8 * each + 40 ids.
    share = documents.sparkSession.createDataFrame([(n, min(1.0, (8 * each + 40) / sizes[n])) for n in names], "lang string, _share double")
    least = ids.withColumn("_hash", F.xxhash64("doc_id")).join(F.broadcast(share), "lang")  # one row a language
    least = least.where(F.col("_hash").cast("double") / 2.0 ** 64 + 0.5 <= F.col("_share"))
    ranked = least.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_hash", "doc_id")))
    chosen = ranked.where(F.col("_rank") <= each).select("lang", "doc_id")
    texts = usable.select("doc_id", "lang", F.left("text", F.lit(max_chars)).alias("text"))
    texts = texts.join(F.broadcast(chosen), ["lang", "doc_id"])  # at most `bound` ids, or one a language
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect())
    place = {name: i for i, name in enumerate(names)}
    features = WordFeatures([text for _, _, text in rows])
    labels = len(names)
    weight, step = np.zeros((1 << _BITS, labels)), np.zeros((labels, labels))
    if not features.size:
        return LanguageModel(names, weight, step)
    truth = np.array([place[lang] for _, lang, _ in rows])[features.text]
    hot = np.eye(labels)[truth]
    same = features.text[1:] == features.text[:-1]
    moved = np.zeros((labels, labels))
    np.add.at(moved, (truth[:-1][same], truth[1:][same]), 1)
    share = 1 / np.maximum(np.bincount(truth, minlength=labels), 1)
    balance = (share / share.sum() * labels)[truth][:, None]
    seen, seen_step = np.full(weight.shape, 1e-8), np.full(step.shape, 1e-8)
    for _ in range(rounds):
        posterior, expected = forward_backward(features.scores(weight), step, features.count)
        g = features.gradient((hot - posterior) * balance) / len(rows) - decay * weight
        seen += g * g
        weight += rate * g / np.sqrt(seen)
        gs = (moved - expected) / features.size - 0.05 * step
        seen_step += gs * gs
        step += rate * gs / np.sqrt(seen_step)
    return LanguageModel(names, weight.astype(np.float32), step)


def detect_language(documents: DataFrame, model: LanguageModel, keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """Every document with ``lang_pred`` and ``score``; a null text or one without a letter has `und` and 0, columns of these names give way.

    With ``spans`` also ``lang_spans``: each run of words of one language with its characters (from 0, the end is outside)
    and the mean posterior of its words.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 2^16 buckets x languages

    def make():
        def run(texts):
            if not spans:
                names, score = sent.value.predict(texts)
                return {"lang_pred": names, "score": score}
            names, score, found = sent.value.predict_spans(texts)
            return {"lang_pred": names, "score": score, "lang_spans": found}
        return run

    added = "lang_pred string, score double"
    if spans:
        added += ", lang_spans array<struct<start: int, end: int, lang: string, posterior: double>>"
    # Chains of a slice advance together word by word, so larger slices take fewer steps.
    return map_texts(documents, added, make, keep, slice_bytes=4 << 20)
