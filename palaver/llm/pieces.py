"""SentencePiece encoding and decoding for merge-type vocabularies by a score-ordered agenda of adjacent symbols."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Collection
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palaver.llm.common import map_texts

#: Words of one generation of what a worker remembers; there are two, and a word that is met again moves to the younger one.
GENERATION = 150_000
#: Words up to this length are merged side by side by the least of each word's pairs, longer ones by a heap.
SHORT = 32
_LETTER, _NONE = 1 << 24, 1 << 30
#: Words merged side by side, and words that the library checks as one text.
_TOGETHER, _LINE = 4096, 100
_SPACE = "▁"
_MARK = _SPACE.encode()


class PieceModel:
    """A BPE vocabulary with byte fallback, identity normalisation and a blank before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        kinds = {piece.type for piece in model.pieces}
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix \
                or not spec.byte_fallback or spec.treat_whitespace_as_suffix or 4 in kinds or 5 in kinds:
            raise ValueError("only merge-type vocabularies with byte fallback and identity normalisation")
        self.library = SentencePieceProcessor(model_file=path)
        self.ids = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.piece = [p.piece for p in model.pieces]
        #: Pairs of characters that stand side by side in some piece: only they can ever be merged across.
        self.pairs = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(_SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("pieces with a blank inside are not covered")
        self.number = [str(i) for i in range(len(self.piece))]
        self.letter, self.keys, self.places, self.joined, self.shift = self._pairs()
        self.shown = [p.replace(_SPACE, " ") for p in self.piece]
        self._listed = pa.array([n + "," for n in self.number], pa.large_string())
        self._is_byte = np.isin(np.arange(len(self.piece)), list(self.of_byte))
        self._shown = pa.array(self.shown, pa.large_string())

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(id of every code point, pairs of ids as one number, the place of each pair's score, the merged ids, bits of a hash to drop).

        A code point without a piece has the id ``_LETTER`` + itself; with its neighbours it may still be a piece. The pairs stand in a
        table at the place of their hash or, where that is taken, at the next free one; the last entry is that of a pair not found.
        """
        letter = np.arange(0x110000, dtype=np.int32) + np.int32(_LETTER)
        for piece, (i, _) in self.ids.items():
            if len(piece) == 1:
                letter[ord(piece)] = i
        place = {score: k for k, score in enumerate(sorted({score for _, score in self.ids.values()}, reverse=True))}
        known = {piece: i for piece, (i, _) in self.ids.items()}
        pairs = {}
        for piece, (i, score) in self.ids.items():
            for k in range(1, len(piece)):
                ends = [known.get(p, int(letter[ord(p)]) if len(p) == 1 else None) for p in (piece[:k], piece[k:])]
                if None not in ends:
                    pairs[ends[0] << 26 | ends[1]] = (place[score], i)
        bits = (8 * len(pairs) + 8).bit_length()
        key = np.fromiter(pairs, np.int64, len(pairs))
        home = self._home(key, 64 - bits)
        order = np.argsort(home, kind="stable")
        step = np.arange(len(key))
        at = step + np.maximum.accumulate(home[order] - step)
        size = max(1 << bits, int(at.max(initial=0)) + 2)
        keys, places, joined = np.full(size + 1, -2), np.full(size + 1, _NONE, np.int32), np.zeros(size + 1, np.int32)
        keys[at] = key[order]
        places[at], joined[at] = np.array(list(pairs.values()), np.int32).reshape(-1, 2)[order].T
        return letter, keys, places, joined, 64 - bits

    @staticmethod
    def _home(key: np.ndarray, shift: int) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).view(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the score, merged id) of pairs; the place is ``_NONE`` where no piece is made."""
        key = left.astype(np.int64) << 26 | right
        at = self._home(key, self.shift)
        found = self.keys[at]
        flat, keys, held = at.reshape(-1), key.reshape(-1), found.reshape(-1)
        rest = np.flatnonzero((held != keys) & (held != -2))
        flat[held == -2] = len(self.keys) - 1
        while len(rest):
            flat[rest] += 1
            held = self.keys[flat[rest]]
            flat[rest[held == -2]] = len(self.keys) - 1
            rest = rest[(held != keys[rest]) & (held != -2)]
        return self.places[at], self.joined[at]

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """The ids of words of few letters: in every round each word merges its best pair, the leftmost of equals.

        Words of one length go together, so all that still merge have as many symbols as each other.
        """
        out: list[list[int]] = [[]] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        ends = np.searchsorted(size[order], np.arange(1, size.max(initial=0) + 2)).tolist()
        for letters, (first, end) in enumerate(zip(ends, ends[1:]), 1):
            for start in range(first, end, _TOGETHER):
                rows = order[start:min(start + _TOGETHER, end)]
                text = "".join([words[i] for i in rows.tolist()]).encode("utf-32-le", "surrogatepass")
                self._merge_rows(self.letter[np.frombuffer(text, np.uint32)].reshape(len(rows), letters), rows, out)
        return out

    def _merge_rows(self, ids: np.ndarray, rows: np.ndarray, out: list[list[int]]) -> None:
        places, made = self._look_up(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = places.argmin(axis=1) if places.shape[1] else np.zeros(len(rows), np.int64)
            more = places[np.arange(len(rows)), at] < _NONE if places.shape[1] else np.zeros(len(rows), bool)
            ready = ids[~more]
            for i, row, odd in zip(rows[~more].tolist(), ready.tolist(), (ready >= _LETTER).any(axis=1).tolist()):
                out[i] = self._plain(row) if odd else row
            ids, places, made, rows, at = ids[more], places[more], made[more], rows[more], at[more]
            if not len(rows):
                break
            each, width = np.arange(len(rows)), ids.shape[1] - 1
            ids[each, at] = made[each, at]
            ids = ids[np.arange(width + 1) != at[:, None] + 1].reshape(len(rows), width)
            others = np.arange(width) != at[:, None]
            places, made = places[others].reshape(len(rows), width - 1), made[others].reshape(len(rows), width - 1)
            for shift in (-1, 0):  # the pairs on both sides of the merged symbol
                side = np.flatnonzero((at + shift >= 0) & (at + shift < width - 1))
                pair = at[side] + shift
                places[side, pair], made[side, pair] = self._look_up(ids[side, pair], ids[side, pair + 1])

    def _plain(self, ids: list[int]) -> list[int]:
        """Code points without a piece as the ids of their bytes."""
        return [x for i in ids for x in ([self.bytes[b] for b in chr(i - _LETTER).encode()] if i >= _LETTER else (i,))]

    def runs(self, word: str) -> list[str]:
        """Parts of a word that no merge can join."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, run: str) -> list[str]:
        """Merge the best-scored adjacent pair, the leftmost among equals, until none is in the vocabulary."""
        symbols: list[str | None] = list(run)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            known = self.ids.get(symbols[a] + symbols[b])
            if known:
                heapq.heappush(agenda, (-known[1], a, b, symbols[a] + symbols[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, made = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or right[a] != b or symbols[a] + symbols[b] != made:
                continue
            symbols[a], symbols[b] = made, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
                offer(a, right[b])
            if left[a] >= 0:
                offer(left[a], a)
        return [s for s in symbols if s is not None]

    def spell(self, words: list[str]) -> list[list[int]]:
        """The ids of words: short ones together, long ones run by run."""
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        out: list[list[int]] = [[]] * len(words)
        for i, ids in zip(short, self.merge_all([words[i] for i in short])):
            out[i] = ids
        for i, word in enumerate(words):
            if len(word) > SHORT:
                out[i] = [x for run in self.runs(word) for symbol in self.merge(run) for x in (
                    (self.ids[symbol][0],) if symbol in self.ids else [self.bytes[b] for b in symbol.encode()])]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, with the blank put before the text not yet taken off."""
        if self.of_byte.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        return b"".join([bytes((self.of_byte[i],)) if i in self.of_byte else self.shown[i].encode() for i in ids]).decode("utf-8", "replace")

    def show(self, spelt: list[list[int]]) -> tuple[list[str], list[str]]:
        """(ids as text, decoded text) of words: all words of plain pieces at once, those with ids of bytes one by one."""
        flat = np.fromiter(chain.from_iterable(spelt), np.int32)
        ends = np.append(0, np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt))))
        made = []
        for texts in (self._listed, self._shown):
            _, places, data = texts.take(pa.array(flat)).buffers()
            places = np.frombuffer(places, np.int64)[ends] if len(flat) else ends
            made.append(pa.LargeStringArray.from_buffers(len(spelt), pa.py_buffer(places), data or pa.py_buffer(b"")).to_numpy(zero_copy_only=False).tolist())
        odd = np.append(0, np.cumsum(self._is_byte[flat]))[ends]
        for i in np.flatnonzero(np.diff(odd)).tolist():
            made[1][i] = self.decode(spelt[i])
        return [t[:-1] for t in made[0]], made[1]

    @staticmethod
    def words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(the words of all texts, where each text's words end, after a 0): the marked texts cut before every run of blanks.

        Merges never cross these places. The empty text has no words.
        """
        marked = [(_SPACE + text).replace(" ", _SPACE).encode() if text else b"" for text in texts]
        data = b"".join(marked)
        at = np.frombuffer(data + b"  ", np.uint8)
        blank = (at[:-2] == _MARK[0]) & (at[1:-1] == _MARK[1]) & (at[2:] == _MARK[2])
        start = blank.copy()
        start[3:] &= ~blank[:-3]
        ends = np.cumsum([0, *map(len, marked)])
        start[ends[:-1][np.diff(ends) > 0]] = True
        start = np.flatnonzero(start)
        offsets = np.append(start, len(data))
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))
        return words.dictionary_encode(), np.searchsorted(start, ends)


class PieceMemo:
    """What the words of the texts at hand give: (ids as text, their number, decoded text).

    New words are spelt here and then encoded and decoded by the library as one text; where a word differs, the
    library's result stands and the word is kept in ``differing``.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.differing: set[str] = set()

    def learn(self, words: Collection[str]) -> None:
        """Have all the words, different ones, in ``young``."""
        if len(self.young) > GENERATION:
            self.young, self.old = {}, self.young
        fresh = []
        for word in [w for w in words if w not in self.young]:
            known = self.old.pop(word, None)
            if known is None:
                fresh.append(word)
            else:
                self.young[word] = known
        spelt = self.model.spell(fresh)
        listed, shown = self.model.show(spelt)
        for i in self._differ(fresh, spelt, shown):
            self.differing.add(fresh[i])
            spelt[i], shown[i] = self._by_library(fresh[i])
            listed[i] = ",".join([self.model.number[x] for x in spelt[i]])
        self.young.update(zip(fresh, zip(listed, map(len, spelt), shown)))

    def _differ(self, words: list[str], spelt: list[list[int]], shown: list[str]) -> list[int]:
        """Positions of the words that the library encodes or decodes in another way.

        A word starts with the blanks before it, so words side by side are a text that is cut at the same places. Only words of
        nothing but blanks would join the next one; they are looked at alone, as is every word of a line that differs, behind one letter.
        """
        library = self.model.library
        at = [i for i, w in enumerate(words) if w[-1] != _SPACE]
        lines = [at[k:k + _LINE] for k in range(0, len(at), _LINE)]
        ids = library.encode(["".join([words[i] for i in line]).replace(_SPACE, " ")[1:] for line in lines], num_threads=1)
        at = [i for i, w in enumerate(words) if w[-1] == _SPACE]
        for line, x, text in zip(lines, ids, library.decode(ids, num_threads=1) if ids else []):
            if x != [y for i in line for y in spelt[i]] or text != "".join([shown[i] for i in line])[1:]:
                at += line
        return [i for i in at if self._by_library(words[i]) != (spelt[i], shown[i])]

    def _by_library(self, word: str) -> tuple[list[int], str]:
        """(ids, decoded text) of a word behind another one."""
        library, before = self.model.library, self.model.library.encode("a")
        ids = library.encode("a" + word.replace(_SPACE, " "))
        return ids[len(before):], library.decode(ids)[1:]


@lru_cache(maxsize=1)
def memo_of(path: str) -> PieceMemo:
    """One for a worker process, for all tasks that it runs one after the other."""
    return PieceMemo(PieceModel(path))


def _strung(values: pa.Array, indices: pa.Array, ends: np.ndarray) -> tuple[memoryview, list[tuple[int, int]]]:
    """(the bytes of the values at all indices one after the other, first and last place of each text's)."""
    taken = values.take(indices)
    _, offsets, data = taken.buffers()
    places = np.frombuffer(offsets, np.int64)[ends].tolist() if len(taken) else [0] * len(ends)
    return memoryview(data or b""), list(zip(places, places[1:]))


def encode_pieces(documents: DataFrame, path: str, keep: list[str] | None = None, ids: bool = False, decoded: bool = False) -> DataFrame:
    """Every document with n_tokens, ids_sha256, decoded_sha256, n_differing (and ``ids`` or ``decoded`` if asked for).

    A null text is the empty text, which has no ids and decodes to itself. ``path`` must exist on every executor.
    Every different word of a batch is looked up once. The words new to a worker are encoded and decoded with the library too, batch by batch; ``n_differing`` counts the words of
    a document for which the library's result took the place of another one here. A very long text, or a very
    long word, is encoded whole. Columns of the added names give way.
    """
    def make() -> Callable[[list], dict]:
        memo = memo_of(path)

        def run(texts: list) -> dict:
            words, ends = PieceModel.words(texts)
            different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
            memo.learn(different)
            made = [memo.young[w] for w in different]
            sizes = np.fromiter([m[1] for m in made], np.int64, len(made))
            spelt = [m[0] for m in made]
            joined, joined_ends = _strung(pa.array([t + "," for t in spelt], pa.large_string()), words.indices, ends)
            plain, plain_ends = _strung(pa.array([m[2] for m in made], pa.large_string()), words.indices, ends)
            back = [str(plain[a:b], "utf-8")[1:] for a, b in plain_ends]
            indices = words.indices.to_numpy()
            count = np.diff(np.append(0, np.cumsum(sizes[indices]))[ends])
            odd = np.fromiter([w in memo.differing for w in different], np.int64, len(made))
            out = {"n_tokens": pa.array(count), "decoded": back,
                   "ids_sha256": [hashlib.sha256(joined[a:b - 1] if b > a else b"").hexdigest() for a, b in joined_ends],
                   "decoded_sha256": [hashlib.sha256(text.encode()).hexdigest() for text in back],
                   "n_differing": pa.array(np.diff(np.append(0, np.cumsum(odd[indices]))[ends]))}
            if ids:
                numbers = np.fromstring(",".join(spelt), np.int32, sep=",") if made else np.zeros(0, np.int32)
                lists = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), numbers).take(words.indices)
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), lists.flatten())
            return out
        return run

    added = ("n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_differing bigint" + (", ids array<int>" if ids else "")
             + (", decoded string" if decoded else ""))
    return map_texts(documents, added, make, keep)
