"""Bounded samples and small linear models, fitted on the driver with numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """The bound rows with the smallest hashes of key: the same ones on every run.

    The rows are counted first and only about twice as many as are wanted go into the top-k, so that what its last task
    reads doesn't grow with the table.
    """
    h, parts = F.xxhash64(key, F.lit(seed)), 1 << 40
    share = min(parts, 2 * bound * parts // max(df.count(), 1) + 1)
    return df.where(F.pmod(h, F.lit(parts)) < share).orderBy(h, key).limit(bound)


def sample_ids(ids: DataFrame, bound: int, seed: int) -> DataFrame:
    """At most bound different ids, however often each is repeated."""
    h, parts = F.xxhash64("doc_id", F.lit(seed)), 1 << 40
    share = min(parts, 2 * bound * parts // max(ids.agg(F.approx_count_distinct("doc_id", 0.01)).first()[0], 1) + 1)
    return ids.select("doc_id").where(F.pmod(h, F.lit(parts)) < share).distinct().orderBy(h, "doc_id").limit(bound)


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each combination of keys, with the text of the least hash among the rows that share them: a sample of ids stays a sample of so many rows."""
    return rows.groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def sample_ids_by(ids: DataFrame, label: str, bound: int, seed: int) -> DataFrame:
    """At most bound ids for each label: hash slots keep their smallest member, so partial aggregation bounds every group."""
    h = F.xxhash64("doc_id", F.lit(seed))
    slots = ids.groupBy(label, F.pmod(h, F.lit(bound)).alias("slot")).agg(F.min(F.struct(h.alias("h"), F.col("doc_id").alias("doc_id"))).alias("m"))
    return slots.select(label, F.col("m.doc_id").alias("doc_id"))


def vectors_of(rows: DataFrame, text: str, features: Callable[[str | None], np.ndarray]) -> tuple[np.ndarray, DataFrame]:
    """The feature matrix of a bounded sample, made on executors and sent as float32, with the sample's other columns."""
    keep = [c for c in rows.columns if c != text]
    fields = [rows.schema[c] for c in keep]

    def run(batches):
        for b in batches:
            vec = [features(t).astype(np.float32).tobytes() for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(vec, pa.large_binary())], [*keep, "__v"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", __v binary"
    out = rows.mapInArrow(run, schema.lstrip(", ")).toArrow()
    vec = out.column("__v").to_pylist()
    x = np.frombuffer(b"".join(vec), np.float32).reshape(len(vec), -1) if vec else np.zeros((0, len(features(""))), np.float32)
    return x, {c: out.column(c).to_pylist() for c in keep}


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, w: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def map_text(df: DataFrame, text: str, out: list[tuple[str, pa.DataType, str]], fn: Callable[[list], list[list]]) -> DataFrame:
    """Append columns made from one text column, batch by batch; all other columns pass through untouched."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {ddl}" for n, _, ddl in out])

    def run(batches):
        for b in batches:
            made = fn(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, t) for v, (_, t, _) in zip(made, out, strict=True))], [*b.schema.names, *(n for n, _, _ in out)])

    return df.mapInArrow(run, schema)
