"""Locality-sensitive hash families: parameters, keys of vectors, and their text files.

A family holds its parameters as small arrays (their size is set by the configuration, not by the data) and gives each
vector one 32-bit key a table. Keys are computed in Arrow batches by matrix products; expression_keys states the same in
column expressions and is what the tests hold the fast form against.
"""

from __future__ import annotations

import abc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.config import Config
from simloom.functions import hashing, similarity, vectors


def scrambled(x: np.ndarray) -> np.ndarray:
    """The integer scramble over unsigned 32-bit values."""
    x = np.asarray(x, np.uint64) & np.uint64(hashing.MASK)
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(hashing.SCRAMBLE) & np.uint64(hashing.MASK)
    return ((x >> np.uint64(16)) ^ x).astype(np.int64)


def scrambled_planes(tables: int, chain: int, dim: int, scale: float = 1.0) -> np.ndarray:
    """Planes from a closed integer form: component d of function j of table t is (scramble((1000 t + j) 1000 + d + 1) mod 2003 - 1001) / 1001."""
    t, j, d = np.ogrid[:tables, :chain, :dim]
    return scale * ((scrambled((t * 1000 + j) * 1000 + d + 1) % 2003 - 1001) / 1001.0)


def _matrix(column: pa.Array) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class HashFamily(abc.ABC):
    """tables, dim, and the keys of dense vectors."""

    tables: int
    dim: int

    @abc.abstractmethod
    def keys(self, x: np.ndarray) -> np.ndarray:
        """Vectors x tables of signed 32-bit keys."""

    @abc.abstractmethod
    def key_expression(self, values: Column, table: int) -> Column:
        """The key of one table as a column expression."""

    @abc.abstractmethod
    def lines(self) -> list[str]:
        """The text file of the parameters, a function a line."""

    def with_keys(self, df: DataFrame, values: str = "values", out: str = "keys") -> DataFrame:
        """df with an array of one key a table. Rows without a vector, or of another dimension, have no keys."""
        at, dim, schema = df.columns.index(values), self.dim, df.schema

        def run(batches):
            for batch in batches:
                column = batch.column(at)
                sizes = np.diff(column.offsets.to_numpy()) if len(batch) else np.zeros(0, np.int64)
                good = (sizes == dim) & ~np.asarray(column.is_null())
                got = self.keys(_matrix(column.filter(pa.array(good)))) if good.any() else np.zeros((0, self.tables), np.int32)
                keys = np.empty(len(batch), object)
                keys[np.flatnonzero(good)] = list(got) if len(got) else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, out])

        return df.mapInArrow(run, _plus(schema, out))

    def expression_keys(self, values: Column, table: int = -1) -> Column:
        """The array of all keys, or the array of one table's key."""
        return F.array(*[self.key_expression(values, t) for t in (range(self.tables) if table < 0 else [table])])

    def exploded(self, df: DataFrame, vector_id: str = "vector_id", values: str = "values") -> DataFrame:
        """(vector_id, table_id, bucket_key), one row a vector and table."""
        keyed = self.with_keys(df.select(vector_id, values), values)
        return keyed.select(F.col(vector_id), F.posexplode("keys").alias("table_id", "bucket_key"))


def _plus(schema: T.StructType, name: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])


def _bits_to_keys(bits: np.ndarray) -> np.ndarray:
    """The last axis as bits, first highest, left-aligned in a signed 32-bit value."""
    weights = np.left_shift(np.int64(1), 31 - np.arange(bits.shape[-1], dtype=np.int64))
    return (bits @ weights).astype(np.uint32).view(np.int32)


def _vector_line(k: int, a: np.ndarray) -> str:
    return f"({k},{len(a)},[{','.join(map(str, range(len(a))))}],[{','.join(repr(float(x)) for x in a)}])"


def _dense(line: str, dim: int | None) -> np.ndarray:
    _, size, i, v = vectors.make_vector(0, line)
    out = np.zeros(dim or size)
    out[i] = v
    return out


class AngleFamily(HashFamily):
    """Signs of projections: bit 1 where the projection is positive; the chain fills the key from the highest bit."""

    def __init__(self, planes: np.ndarray):
        self.planes = np.asarray(planes, float)
        self.tables, self.chain, self.dim = self.planes.shape

    @classmethod
    def generate(cls, config: Config) -> AngleFamily:
        """Uniform directions of unit length; by pulling, drawn from a family of family_size functions."""
        rng = np.random.default_rng(config.seed)

        def draw(n):
            a = rng.uniform(-1, 1, (n, config.dim))
            return a / np.linalg.norm(a, axis=1, keepdims=True)

        n = config.tables * config.chain_length
        planes = draw(config.family_size)[rng.integers(0, config.family_size, n)] if config.by_pulling else draw(n)
        return cls(planes.reshape(config.tables, config.chain_length, config.dim))

    def keys(self, x):
        return _bits_to_keys(np.einsum("nd,tjd->ntj", x, self.planes, optimize=True) > 0)

    def key_expression(self, values, table):
        bits = F.lit(0).cast("long")
        for j, a in enumerate(self.planes[table]):
            bits = bits + F.when(similarity.dot(values, F.lit([float(c) for c in a])) > 0, F.lit(1 << (31 - j))).otherwise(F.lit(0)).cast("long")
        return hashing.signed32(bits)

    def lines(self):
        return [_vector_line(k, a) for k, a in enumerate(self.planes.reshape(-1, self.dim))]

    @classmethod
    def from_lines(cls, lines: list[str], chain: int, dim: int | None = None) -> AngleFamily:
        """Every chain lines are a table; a rest that is no full table is an error."""
        if not lines or len(lines) % chain:
            raise ValueError(f"{len(lines)} functions do not make tables of {chain}")
        planes = np.array([_dense(x, dim) for x in lines])
        return cls(planes.reshape(-1, chain, planes.shape[1]))


class PStableFamily(HashFamily):
    """Buckets of projections, (a x + b) / w cut to an integer; the key hashes the chain's integers as bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, rounding: str = "trunc"):
        self.a, self.b, self.w, self.rounding = np.asarray(a, float), np.asarray(b, float), np.asarray(w, float), rounding
        self.tables, self.chain, self.dim = self.a.shape
        if (self.w <= 0).any():
            raise ValueError("w must be positive")

    @classmethod
    def generate(cls, config: Config) -> PStableFamily:
        """A family of Gaussian directions and offsets under w; each table draws its chain from it with replacement."""
        rng = np.random.default_rng(config.seed)
        a = rng.normal(config.mu, config.sigma, (config.family_size, config.dim))
        b = rng.integers(0, config.w, config.family_size)
        at = rng.integers(0, config.family_size, (config.tables, config.chain_length))
        return cls(a[at], b[at], np.full(at.shape, config.w), config.rounding)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        cut = np.trunc if self.rounding == "trunc" else np.floor
        low, high = -(2**31), 2**31 - 1
        return np.clip(cut((np.einsum("nd,tjd->ntj", x, self.a, optimize=True) + self.b) / self.w), low, high).astype(np.int64)

    def keys(self, x):
        h = np.ones((len(x), self.tables), np.int64)
        index = self.buckets(x)
        for j in range(self.chain):
            for shift in (24, 16, 8, 0):
                byte = ((index[..., j] >> shift & 255) ^ 128) - 128
                h = h * 31 + byte & hashing.MASK
        return h.astype(np.uint32).view(np.int32)

    def key_expression(self, values, table):
        parts = []
        for a, b, w in zip(self.a[table], self.b[table], self.w[table], strict=True):
            x = (similarity.dot(values, F.lit([float(c) for c in a])) + F.lit(float(b))) / F.lit(float(w))
            x = F.floor(x) if self.rounding == "floor" else x
            parts.append(F.least(F.greatest(x, F.lit(-(2.0**31))), F.lit(2.0**31 - 1)).cast("int"))
        return hashing.ints_hash(F.array(*parts))

    def lines(self):
        flat = self.a.reshape(-1, self.dim)
        return [f"{_vector_line(k, a)};{float(b)!r};{int(w)}" for k, (a, b, w) in enumerate(zip(flat, self.b.ravel(), self.w.ravel(), strict=True))]

    @classmethod
    def from_lines(cls, lines: list[str], chain: int, dim: int | None = None, rounding: str = "trunc") -> PStableFamily:
        if not lines or len(lines) % chain:
            raise ValueError(f"{len(lines)} functions do not make tables of {chain}")
        parts = [x.split(";") for x in lines]
        a = np.array([_dense(p[0], dim) for p in parts])
        shape = (-1, chain)
        return cls(a.reshape(-1, chain, a.shape[1]), np.array([float(p[1]) for p in parts]).reshape(shape), np.array([float(p[2]) for p in parts]).reshape(shape), rounding)


class PrecalculatedFamily(HashFamily):
    """Keys put together from two of a few shared half chains, each computed once a vector."""

    def __init__(self, halves: AngleFamily, pairs: np.ndarray, legacy: bool = False):
        self.halves, self.pairs, self.legacy = halves, np.asarray(pairs, np.int64), legacy
        self.tables, self.dim, self.half = len(self.pairs), halves.dim, halves.chain
        if self.half > 16:
            raise ValueError("a half chain has 16 bits at most")

    @classmethod
    def generate(cls, config: Config) -> PrecalculatedFamily:
        from dataclasses import replace

        halves = AngleFamily.generate(replace(config, family="angle", tables=config.family_size, chain_length=config.chain_length // 2))
        return cls(halves, np.random.default_rng(config.seed + 1).integers(0, config.family_size, (config.tables, 2)))

    def keys(self, x):
        short = self.halves.keys(x).view(np.uint32).astype(np.int64)
        if self.legacy:
            joined = short[:, self.pairs[:, 0]] << 16 & hashing.MASK | short[:, self.pairs[:, 1]]
        else:
            short >>= 32 - self.half
            joined = (short[:, self.pairs[:, 0]] << self.half | short[:, self.pairs[:, 1]]) << 32 - 2 * self.half
        return joined.astype(np.uint32).view(np.int32)

    def key_expression(self, values, table):
        left, right = (hashing.unsigned32(self.halves.key_expression(values, int(k))) for k in self.pairs[table])
        if self.legacy:
            return hashing.signed32(F.shiftleft(left, 16).bitwiseAND(hashing.MASK).bitwiseOR(right))
        left, right = F.shiftright(left, 32 - self.half), F.shiftright(right, 32 - self.half)
        return hashing.signed32(F.shiftleft(F.shiftleft(left, self.half).bitwiseOR(right), 32 - 2 * self.half))

    def lines(self):
        return [f"{i};{j}" for i, j in self.pairs.tolist()]

    @classmethod
    def from_lines(cls, pair_lines: list[str], half_lines: list[str], half: int, tables: int | None = None, dim: int | None = None) -> PrecalculatedFamily:
        if tables is not None and len(pair_lines) != tables:
            raise ValueError(f"{len(pair_lines)} pairs for {tables} tables")
        return cls(AngleFamily.from_lines(half_lines, half, dim), np.array([[int(x) for x in p.split(";")] for p in pair_lines]))


REGISTRY = {"angle": AngleFamily, "pStable": PStableFamily, "precalculated": PrecalculatedFamily}


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a parameter file in their order; parameter files are small by nature."""
    return [x for x in "\n".join(r[1].decode() for r in sorted(spark.read.format("binaryFile").load(path).select("path", "content").collect())).splitlines() if x.strip()]


def make_family(config: Config, spark: SparkSession | None = None) -> HashFamily:
    """The family of a configuration, generated from its seed or read from its file."""
    kind = REGISTRY[config.family]
    if config.method == "default":
        return kind.generate(config)
    paths = config.family_file.split(",")
    lines = [read_lines(spark, p) for p in paths]
    if config.family == "precalculated":
        return kind.from_lines(lines[0], lines[1], config.chain_length // 2, config.tables, config.dim)
    family = kind.from_lines(lines[0], config.chain_length, config.dim)
    if family.tables != config.tables:
        raise ValueError(f"{family.tables} tables in the file, {config.tables} wanted")
    return family


def save_family(spark: SparkSession, family: HashFamily, path: str) -> None:
    """Write the parameter file, one text file of one function a line."""
    numbered = [(k, x) for k, x in enumerate(family.lines())]
    spark.createDataFrame(numbered, "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
