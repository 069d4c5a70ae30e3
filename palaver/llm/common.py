"""Texts as Arrow batches of bounded size, words as numpy arrays, and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palaver.session import ship

#: Text bytes handled at once inside a task. A longer single text is handled alone.
SLICE_BYTES = 1 << 20


def held_out(modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves the given rest; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def slices(batch: pa.RecordBatch, size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``size`` bytes of text each, never an empty one."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(start, end - start)


def map_texts(df: DataFrame, added: str, make: Callable[[], Callable[[list], dict]], keep: list[str] | None = None,
              slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Add columns computed from the column ``text``, in Arrow batches.

    ``make`` runs once in every task and gives a function from a list of texts (null is the empty text) to a
    dict of columns; ``added`` is their schema as DDL. ``keep`` names the columns carried along (all by
    default); one with the name of an added column gives way to it.
    """
    extra = T._parse_datatype_string(added)
    names = {f.name for f in extra}
    carried = [f for f in df.schema if f.name not in names and (keep is None or f.name in keep)]
    fields = T.StructType([*carried, *extra])
    arrow = to_arrow_schema(fields)
    order = [f.name for f in carried]

    def run(batches):
        fn = make()
        for whole in batches:
            for batch in slices(whole, slice_bytes):
                new = fn([t or "" for t in batch.column("text").to_pylist()])
                columns = [batch.column(name).cast(arrow.field(name).type) for name in order]
                columns += [new[f.name] if isinstance(new[f.name], pa.Array) else pa.array(new[f.name], type=arrow.field(f.name).type) for f in extra]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    ship(df.sparkSession)
    wanted = [f.name for f in df.schema if f.name in order or f.name == "text"]
    return df.select(*wanted).mapInArrow(run, fields)


class Words:
    """The words of many texts: byte positions, lengths, the text each belongs to and 64-bit hashes.

    A word is a run of bytes that ``letters`` (a table of 256 flags) marks; the hash is the sum of random
    numbers by (position, byte), so equal words have equal hashes in every task.
    """

    _TABLE = np.random.default_rng(20).integers(0, 1 << 64, size=64 * 256, dtype=np.uint64)

    def __init__(self, texts: list[bytes], letters: np.ndarray, fold: np.ndarray | None = None):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.ends_of_texts = np.cumsum(sizes + 1)
        self.raw = data
        self.data = data = fold[data] if fold is not None else data
        inside = letters[data]
        step = np.diff(inside.astype(np.int8), prepend=0)
        if len(texts):
            inside[self.ends_of_texts - 1] = False
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.text = np.searchsorted(self.ends_of_texts, self.start, side="right")
        self.count = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.length = self.end - self.start
        self.inside = inside
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at = np.flatnonzero(self.inside)
        first = np.cumsum(self.length) - self.length
        pos = np.arange(len(at), dtype=np.int64) - np.repeat(first, self.length)
        value = self._TABLE[((pos & 63) << 8) + self.data[at]]
        if self.length.max() > 64:
            value = value * ((pos >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        return np.add.reduceat(value, first)

    @classmethod
    def hash_of(cls, word: bytes) -> int:
        """The hash of one word that is already folded."""
        every = np.ones(256, bool)
        every[10] = False
        return int(cls([word], every).hash[0])


def flags(chosen: bytes, invert: bool = False) -> np.ndarray:
    """A table of 256 flags that marks the given bytes, or all others."""
    table = np.zeros(256, bool)
    table[list(chosen)] = True
    return ~table if invert else table


WHITE = b" \t\n\x0b\f\r"
NOT_WHITE = flags(WHITE, invert=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, train: Column, bound: int,
                    max_chars: int = 65536) -> DataFrame:
    """At most ``bound`` labelled documents (doc_id, text, label), the ones with the least hash of the id.

    ``train`` says which ids may be learnt from. Null labels and null texts are left out, of contradicting labels
    of an id the greatest counts, repeated rows of an id count once, and texts of more than ``max_chars`` characters are not learnt from.
    """
    ids = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train)
           .groupBy("doc_id").agg(F.max(label).alias("_label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    joined = texts.join(F.broadcast(ids), "doc_id")  # at most `bound` pairs of numbers
    return joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("label"))
