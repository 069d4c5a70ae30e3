"""Near-duplicate texts: many universal hash minima, banding, signature and set verification, components by stars."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import LOWER, NOT_WHITE, Words, map_texts, mix
from palaver.llm.components import connected_components
from palaver.session import durable


@dataclass(frozen=True)
class MinHash:
    """Shingle width, threshold in hundredths, and the banding: ``bands`` times ``rows`` minima.

    A pair of similarity s shares no band with probability (1 - s^rows)^bands: 3e-6 at 0.80 and 7e-9 at 0.85 for
    32 bands of 5. ``slack`` is how far below the threshold a signature may estimate (five deviations).
    """

    width: int = 5
    threshold: int = 80
    bands: int = 32
    rows: int = 5
    slack: float = 0.18

    @property
    def size(self) -> int:
        return self.bands * self.rows


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, their number per text), each text's sorted and distinct. Fewer words than ``width`` make one shingle."""
    words = Words([t.encode() for t in texts], NOT_WHITE, LOWER)
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.cumsum(words.count) - words.count
    rank = np.arange(n) - np.repeat(first, words.count)
    short = words.count < width
    keep = (rank <= (words.count - width)[words.text]) | (short[words.text] & (rank == 0))
    start = np.flatnonzero(keep)
    text = words.text[start]
    value = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            inside = j < words.count[text]
            at = np.minimum(start + j, n - 1)
            value += np.where(inside, mix(words.hash[at] * np.uint64(2 * j + 3) + np.uint64(j)), np.uint64(j + 1))
    value = mix(value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.bincount(text[new], minlength=len(texts))


def _minima(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The least (a x + b mod 2^64) of every text under ``size`` functions; rows of empty texts are zero."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 64, size, np.uint64)
    out = np.zeros((len(counts), size), np.uint64)
    full = np.flatnonzero(counts)
    begin = np.concatenate([[0], np.cumsum(counts[full])])
    at = 0
    while at < len(full):  # blocks that stay in the cache; a longer text is a block of its own
        end = max(at + 1, int(np.searchsorted(begin, begin[at] + 32768, side="right")) - 1)
        block = values[begin[at]:begin[end]]
        cuts, made = begin[at:end] - begin[at], np.empty_like(block)
        for i in range(size):
            np.multiply(block, a[i], out=made)
            np.add(made, b[i], out=made)
            out[full[at:end], i] = np.minimum.reduceat(made, cuts)
        at = end
    return out


def _set_keys(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits for the set of every text, as two numbers; zero for empty ones."""
    text = np.repeat(np.arange(len(counts)), counts)
    keys = np.zeros((len(counts), 2), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(2):
            np.add.at(keys[:, j], text, mix(values + np.uint64(j + 1)))
    return keys


def fingerprints(documents: DataFrame, how: MinHash) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set), bands (64-bit keys) and signature (16 bits a minimum); empty ones null."""
    def make():
        def run(texts):
            values, counts = shingle_sets(texts, how.width)
            minima = _minima(values, counts, how.size)
            keys = _set_keys(values, counts)
            with np.errstate(over="ignore"):
                bands = np.zeros((len(texts), how.bands), np.uint64)
                for r in range(how.rows):
                    bands = mix(bands + minima[:, r::how.rows] + np.arange(how.bands, dtype=np.uint64))
            short = (minima >> np.uint64(48)).astype("<u2")
            full = counts > 0
            return {"n_shingles": counts, "set_key": [k.tobytes() if f else None for k, f in zip(keys, full)],
                    "bands": [x if f else None for x, f in zip(bands.view(np.int64), full)],
                    "signature": [x.tobytes() if f else None for x, f in zip(short, full)]}
        return run

    return map_texts(documents, "n_shingles bigint, set_key binary, bands array<bigint>, signature binary", make, keep=["doc_id"])


def shingle_rows(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set_key, shingles) of the documents named by ``ids``, a row each."""
    chosen = documents.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")

    def make():
        def run(texts):
            values, counts = shingle_sets(texts, width)
            ends = np.cumsum(counts)
            return {"set_key": [k.tobytes() for k in _set_keys(values, counts)],
                    "shingles": [values[e - c:e].view(np.int64) for e, c in zip(ends, counts)]}
        return run

    return map_texts(chosen, "set_key binary, shingles array<bigint>", make, keep=["id"])


def standing_sets(rows: DataFrame, stands: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, shingles): of ids that several rows have (``repeated``), each set that ``stands`` names, once; of the others the row.

    So rows that repeat an id and a text are compared as one.
    """
    single = rows.join(repeated, "id", "left_anti").select("id", "shingles")
    several = rows.join(repeated, "id", "left_semi").join(stands.select("id", "set_key"), ["id", "set_key"], "left_semi")
    return single.unionByName(several.groupBy("id", "set_key").agg(F.first("shingles").alias("shingles")).select("id", "shingles"))


def _agreeing(pairs: DataFrame, signatures: DataFrame, how: MinHash) -> DataFrame:
    """Pairs (a, b) whose signatures agree in about the threshold's share of places, ``slack`` allowed."""
    left = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    least = (how.threshold / 100 - how.slack) * how.size

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, how.size) for c in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                    pa.array((one == two).sum(axis=1) >= least))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    enough = 100 * both >= how.threshold * (F.size("xa") + F.size("xb") - both)
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def _links_in_block(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, group: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of all links between members of different groups, from exact products of the set incidence.

    ``side`` 2 marks members of both halves of a block pair (compared with all), 0 and 1 those compared across only.
    """
    size = np.array([len(s) for s in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), size)
    shared = np.bincount(code) > 1
    rank = np.cumsum(shared) - 1
    keep = shared[code]
    parent = list(range(len(ids)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    both = np.zeros((len(ids), len(ids)), np.float32)
    width = 16384
    for low in range(0, int(shared.sum()), width):  # slabs of columns bound the memory
        here = keep & (rank[code] >= low) & (rank[code] < low + width)
        part = np.zeros((len(ids), min(width, int(shared.sum()) - low)), np.float32)
        part[owner[here], rank[code[here]] - low] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    linked = 100 * both >= threshold * (size[:, None] + size[None, :] - both)
    linked &= (group[:, None] != group[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
    for i in range(len(ids)):  # members of one group are linked already
        first = np.flatnonzero(group == group[i])[0]
        parent[find(i)] = find(int(first))
    out = []
    for i, j in np.argwhere(np.triu(linked, 1)):
        a, b = find(int(i)), find(int(j))
        if a != b:
            parent[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


BLOCK = 128


def _block_links(members: DataFrame, sets: DataFrame, how: MinHash) -> DataFrame:
    """Links between members (bucket, id, group) of a bucket that are in different groups, as a forest per pair of blocks.

    A bucket is cut into blocks of about BLOCK members of its first group and of the others; every pair of blocks with a
    member outside the first group is one task-side product, so no bucket is ever gathered and no pair becomes a row.
    Buckets with the same members are taken once.
    """
    facts = members.groupBy("bucket").agg(F.min("group").alias("main"), F.max("group").alias("_last"), F.count("*").alias("n"),
                                          F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).where(F.col("main") < F.col("_last"))
    facts = facts.groupBy("n", "who").agg(F.min(F.struct("bucket", "main")).alias("one")).select("one.bucket", "one.main", "n")
    own = members.join(facts, "bucket").withColumn("minor", F.col("group") != F.col("main"))
    sizes = own.groupBy("bucket").agg(F.sum(F.col("minor").cast("long")).alias("_few"), F.sum((~F.col("minor")).cast("long")).alias("_many"))
    own = own.join(sizes.select("bucket", F.ceil(F.col("_many") / BLOCK).alias("_m"), F.ceil(F.col("_few") / BLOCK).alias("_f")), "bucket")
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("minor"), F.col("_f")).otherwise(F.greatest("_m", F.lit(1))))
    own = own.withColumn("block", F.when(F.col("minor"), F.col("_m") + place).otherwise(place))
    partners = F.when(F.col("minor"), F.sequence(F.lit(0).cast("long"), F.col("_m") + F.col("_f") - 1)).otherwise(
        F.sequence(F.col("_m"), F.col("_m") + F.col("_f") - 1))
    own = own.select("bucket", "id", "group", "block", F.explode(partners).alias("other"))
    own = own.select("bucket", "id", "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))
    own = own.join(sets, "id")
    threshold = how.threshold

    def run(frame):
        import pandas as pd
        found = _links_in_block(frame["id"].to_numpy(), [np.asarray(s) for s in frame["shingles"]], frame["side"].to_numpy(), frame["group"].to_numpy(), threshold)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return own.groupBy("bucket", "i", "j").applyInPandas(run, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, how: MinHash = MinHash()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Texts with equal sets are one class, whose least id stands for it. Classes that share a band are compared: first with
    the least id of the band's bucket, by signature and then by full sets; then the members of a bucket that are still in
    different components, in blocks, by full sets. So every pair that shares a band is decided, and none is emitted
    beyond its bucket's representative. A text without words (or null) has no shingles and stays alone; rows with a
    null id are linked with nothing, have no component and are kept. Rows of one id and set are compared once and share
    their verdict; an id that is the least one of several sets is one document with all of them.
    """
    prints = durable(fingerprints(documents, how))
    full = prints.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = durable(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")))
    repeated = durable(full.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("id"))
    stands = prints.select(F.col("doc_id").alias("id"), "set_key", "bands", "signature").join(
        classes, "set_key").where(F.col("id") == F.col("rep")).drop("rep")
    several = stands.join(repeated, "id", "left_semi").groupBy("id", "set_key").agg(
        F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    stands = durable(stands.join(repeated, "id", "left_anti").unionByName(several))
    banded = stands.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket", "low")
    members = durable(banded.join(buckets, "bucket").distinct())
    rows = durable(shingle_rows(documents, members.select("id").distinct(), how.width))
    sets = standing_sets(rows, stands, repeated)
    signatures = stands.select("id", "signature")
    pairs = members.where("id > low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    links = durable(_confirmed(_agreeing(pairs, signatures, how), sets, how))
    first = durable(connected_components(links))
    grouped = members.join(first, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("group"), "low")
    # Pairs with the representative are decided: a bucket of two needs no second look.
    more = durable(_block_links(grouped.where("id > low").drop("low"), sets, how))
    final = connected_components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.join(final, F.col("rep") == F.col("id"), "left").select("set_key", F.coalesce("component", "rep").alias("_component"))
    joined = prints.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
