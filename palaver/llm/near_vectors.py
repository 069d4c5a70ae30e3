"""Near-duplicate vectors: cross-polytope hashing after Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import mix
from palaver.llm.components import connected_components
from palaver.session import durable, ship


@dataclass(frozen=True)
class CrossPolytope:
    """``tables`` hash tables of ``functions`` cross-polytopes each; per function the runner-up vertex is probed too."""

    threshold: float = 0.98
    tables: int = 8
    functions: int = 2
    seed: int = 11


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        x = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, d) / np.sqrt(d)


def buckets(vectors: np.ndarray, salt: np.ndarray, how: CrossPolytope) -> np.ndarray:
    """64-bit bucket keys of unit vectors, one row each: per table the bucket itself, then one with one vertex, or all, replaced by the runner-up.

    ``salt`` is a number per vector; only equal salts can meet.
    """
    n, width = vectors.shape
    padded = np.zeros((n, 1 << max(1, (width - 1).bit_length())))
    padded[:, :width] = vectors
    rng = np.random.default_rng(how.seed)
    out = []
    for table in range(how.tables):
        best, second = [], []
        for _ in range(how.functions):
            x = padded
            for _ in range(3):
                x = _hadamard(x * rng.choice([-1.0, 1.0], padded.shape[1]))
            top = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
            value = np.take_along_axis(x, top, axis=1)
            order = np.argsort(-np.abs(value), axis=1, kind="stable")
            top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
            vertex = (2 * top + (value < 0)).astype(np.uint64)
            best.append(vertex[:, 0])
            second.append(vertex[:, 1])
        probes = [best, second, *([*best[:i], second[i], *best[i + 1:]] for i in range(how.functions))]
        for probe in probes:
            key = mix(salt + np.uint64(table + 1))
            for vertex in probe:
                key = mix(key + vertex + np.uint64(1))
            out.append(key)
    return np.stack(out, axis=1)


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _salt(labels: np.ndarray, width: int) -> np.ndarray:
    return mix(labels.astype(np.int64).view(np.uint64) * np.uint64(4096) + np.uint64(width))


def _keys(classes: DataFrame, how: CrossPolytope) -> DataFrame:
    """(id, bucket) for all buckets of all vectors."""
    ship(classes.sparkSession)

    def run(batches):
        for batch in batches:
            widths = np.asarray(pc.list_value_length(batch.column("vector")))
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                for start in range(0, part.num_rows, 2048):
                    few = part.slice(start, 2048)
                    keys = buckets(_unit(_matrix(few.column("vector"))), _salt(np.asarray(few.column("label")), int(width)), how)
                    ids = np.repeat(np.asarray(few.column("id")), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.view(np.int64).ravel())], names=["id", "bucket"])

    return classes.select("id", "label", "vector").mapInArrow(run, "id bigint, bucket bigint")


BLOCK = 256


def _counts_here(keys: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: int, tables: int) -> np.ndarray:
    """Whether this bucket is the first the two have in common: the least one of the first table where they meet."""
    probes, none = keys.shape[1] // tables, np.iinfo(np.int64).max
    out = np.zeros(len(i), bool)
    for start in range(0, len(i), 65536):
        open_ = np.arange(start, min(start + 65536, len(i)))
        for table in range(tables):
            own = keys[:, table * probes:(table + 1) * probes]
            a, b = own[i[open_]], own[j[open_]]
            common = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, none).min(axis=1)
            out[open_[common == bucket]] = True
            open_ = open_[common == none]
            if not len(open_):
                break
    return out


def _run_links(bucket: int, ids, copies, unit, side, keys, how: CrossPolytope, counts: dict, edges: list) -> None:
    """Links of one bucket or pair of blocks; each pair counts in one bucket."""
    cosine = unit @ unit.T
    linked = (cosine >= how.threshold) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
    i, j = np.nonzero(np.triu(linked, 1))
    if not len(i):
        return
    mine = _counts_here(keys, i, j, bucket, how.tables)
    i, j = i[mine], j[mine]
    for x, y in ((i, j), (j, i)):
        for a, n in zip(ids[x].tolist(), copies[y].tolist()):
            counts[a] = counts.get(a, 0) + n
    parent = {}

    def find(v):
        while parent.get(v, v) != v:
            v = parent[v]
        return v

    for a, b in zip(ids[i].tolist(), ids[j].tolist()):
        p, q = find(a), find(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
            edges.append((a, b))


def near_vectors(vectors: DataFrame, how: CrossPolytope = CrossPolytope()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept; vectors with equal labels are compared.

    Equal vectors of a label are one class with a count. Every bucket with two classes or more is multiplied out exactly in
    double precision, large ones in pairs of blocks of about BLOCK, so a pair is found if it shares one bucket
    and never is below the threshold. Null labels and vectors that are null, empty, zero or hold null or
    non-finite numbers link with nothing; so do vectors of different lengths. A null vec_id has no component and is kept.
    """
    own = vectors.select("vec_id", "label", "embedding")
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(
        F.exists("embedding", lambda x: x != 0), F.lit(False))
    own = own.withColumn("_fine", fine)
    good = own.where("_fine")
    grouped = good.groupBy("label", F.col("embedding").alias("vector")).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = durable(grouped.withColumn("label", F.xxhash64("label")))
    entries = durable(_keys(classes, how))
    facts = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK)
    placed = entries.join(facts, "bucket").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), "parts"))
    placed = placed.select("bucket", "id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    placed = placed.select("bucket", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                           F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))
    placed = durable(placed)
    # Runs of one bucket are small; some two thousand rows of them make one task-side group, however many rows there are.
    chunks = max(1, placed.count() // 2000)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(chunks))).join(classes.select("id", "label", "copies", "vector"), "id")

    def run(table):
        table = table.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending")])
        bucket, i, j, ids, copies, side, label = (np.asarray(table.column(c)) for c in ("bucket", "i", "j", "id", "copies", "side", "label"))
        widths = np.asarray(pc.list_value_length(table.column("vector")))
        counts, edges = {}, []
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            unit = _unit(_matrix(table.column("vector").combine_chunks().filter(pa.array(widths == width))))
            cut = np.flatnonzero(np.diff(bucket[at]) | np.diff(i[at]) | np.diff(j[at])) + 1
            runs = [(a, b) for a, b in zip([0, *cut], [*cut, len(at)]) if b - a > 1]
            close = [(a, b) for a, b in runs if (np.triu(unit[a:b] @ unit[a:b].T, 1) >= how.threshold).any()]
            if not close:
                continue
            chosen = np.concatenate([np.arange(a, b) for a, b in close])
            every = buckets(unit[chosen], _salt(label[at[chosen]], int(width)), how).view(np.int64)  # once for all runs of the group
            done = 0
            for a, b in close:
                rows, keys = at[a:b], every[done:done + b - a]
                done += b - a
                _run_links(int(bucket[rows[0]]), ids[rows], copies[rows], unit[a:b], side[rows], keys, how, counts, edges)
        return pa.table({"a": pa.array([*counts, *(e[0] for e in edges)], pa.int64()), "b": pa.array([None] * len(counts) + [e[1] for e in edges], pa.int64()),
                         "n": pa.array([*counts.values(), *([0] * len(edges))], pa.int64())})

    found = durable(placed.groupBy("chunk").applyInArrow(run, "a bigint, b bigint, n bigint"))
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    component = connected_components(found.where("b is not null").select("a", "b"))
    named = classes.join(links, "id", "left").join(component, "id", "left")
    # A vector finds its class by label and value again; the class counts one link to each other copy.
    named = named.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    keyed = own.withColumn("_label", F.xxhash64("label")).withColumn("_hash", F.when(F.col("_fine"), F.xxhash64("_label", "embedding")))
    named = named.withColumn("_key", F.xxhash64("label", "vector"))
    same = (F.col("_hash") == F.col("_key")) & (F.col("_label") == F.col("_other")) & (F.col("embedding") == F.col("vector"))
    joined = keyed.join(named.withColumnRenamed("label", "_other"), same, "left")
    component_id = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))
