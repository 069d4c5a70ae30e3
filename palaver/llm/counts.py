"""Token counts equal to the library's, with huge texts encoded in overlapping chunks that resynchronise."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from palaver.llm.common import map_texts

#: Characters from which a text is cut into overlapping chunks, and what a chunk adds and shares with the next.
CHUNK, OVERLAP = 65536, 256
#: Entries a task remembers before it starts anew.
MEMO = 400_000
_ODD_WHITE = re.compile(r"\s\s|^\s|\s$")
_BLANK = re.compile(r"(?<=\S) (?=\S)")


def load(path: str):
    """The tokenizer of a file; only byte-level vocabularies with the usual pattern have the places used here."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel":
        raise ValueError("only byte-level vocabularies without normalisation")
    return tokenizer


def stable_places(text: str, start: int, end: int) -> set[int]:
    """Places in [start, end) before a single blank between two other characters.

    The pattern of the vocabulary starts a token at such a blank whatever comes before or behind, so an encoding
    of the part on either side is the same as inside the whole text.
    """
    return {m.start() for m in _BLANK.finditer(text, max(start, 1), min(end + 2, len(text))) if m.start() < end}


def count_overlapping(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a long text from overlapping chunks.

    Two neighbours are spliced at a place that is a token start in both encodings, lies before a single blank, and is
    followed by equal tokens up to the end of the overlap. If there is none the overlap is doubled, at last to the
    whole rest, which then is one chunk.
    """
    total, start = 0, 0
    while True:
        end = start + chunk
        if end >= len(text):
            return total + len(tokenizer.encode(text[start:], add_special_tokens=False).ids)
        width = overlap
        while True:
            stop = min(len(text), end + width)
            here = tokenizer.encode(text[start:stop], add_special_tokens=False)
            if stop == len(text):
                return total + len(here.ids)
            there = tokenizer.encode(text[end:min(len(text), stop + overlap)], add_special_tokens=False)
            mine = {start + a: i for i, (a, _) in enumerate(here.offsets)}
            other = {end + a: i for i, (a, _) in enumerate(there.offsets)}
            at = _splice(here, there, mine, other, stable_places(text, end, stop))
            if at is not None:
                total += mine[at]
                start = at
                break
            width *= 2


def _splice(here, there, mine: dict[int, int], other: dict[int, int], places: set[int]) -> int | None:
    """The first common stable place behind which at least four tokens agree."""
    for place in sorted(places):
        a, b = mine.get(place), other.get(place)
        if a is not None and b is not None and here.ids[a:a + 4] == there.ids[b:b + 4] and len(here.ids) - a >= 8:
            return place
    return None


class CountMemo(dict):
    """Tokens of a stretch between stable places."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def prepare(self, stretches: set[str]) -> None:
        if len(self) > MEMO:
            self.clear()
        new = [s for s in stretches if s not in self]
        for s, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self[s] = len(e.ids)


def stretches(text: str) -> list[str]:
    """The text cut before every single blank between two other characters."""
    parts = text.split(" ") if not _ODD_WHITE.search(text) else _BLANK.split(text)
    return [parts[0], *(" " + p for p in parts[1:])] if parts[0] or len(parts) > 1 else []


def count_tokens(documents: DataFrame, path: str, limit: int = 1024, keep: list[str] | None = None,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every document with n_bytes, n_tokens and over_limit; a null text is the empty text, which has no tokens.

    A text of over ``chunk`` characters is encoded in overlapping chunks; a shorter one is cut at the same stable
    places, and each different stretch of a batch is encoded once. Columns of the added names give way.
    """
    def make() -> Callable[[list], dict]:
        tokenizer = load(path)
        memo = CountMemo(tokenizer)

        def run(texts: list) -> dict:
            cut = [stretches(t) if len(t) <= chunk else None for t in texts]
            memo.prepare({s for c in cut if c for s in c})
            counts = [count_overlapping(tokenizer, t, chunk, overlap) if c is None else sum(map(memo.__getitem__, c)) for t, c in zip(texts, cut)]
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}
        return run

    return map_texts(documents, "n_bytes bigint, n_tokens bigint, over_limit boolean", make, keep)
