"""Shared pieces of the corpus operators: scratch tables, batches, words, hashes, components.

Words are maximal runs of characters other than ``\\x20`` and ``\\x09-\\x0D``
(``bytes.split`` splits on exactly those). Null text counts as empty text.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints"
#: Rows and bytes handed to a Python worker at once. A worker holds one batch, so this bounds its memory.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Bytes of text that one numpy pass works on.
BLOCK_BYTES = 1 << 20

WORD_SPLIT = r"[\x20\x09-\x0D]+"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to at most ``rows`` rows and about ``size`` bytes: texts can be very long.

    A batch has one row at least. The setting stays for the session; lower values of the user stand.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key, None))
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a folder under /tmp for a local master, which has one machine; an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return DEFAULT_CHECKPOINT_DIR


def materialise(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors. ``folders`` are columns by whose values files are kept apart."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/halocline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Delete the files of a table made by materialise() that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/halocline-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of DataFrames that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_crc32(column: Column) -> Column:
    """crc32 of the id written as text, unsigned; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def remainder(column: Column, modulus: int) -> Column:
    """id_crc32 modulo ``modulus``."""
    return id_crc32(column) % F.lit(modulus)


def same_document(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on (doc_id, _th), where a null doc_id equals a null doc_id."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_th"] == b["_th"])


def packed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``docs`` as one struct ``_row`` beside ``columns``: whatever a user's columns are called, they don't clash with an operator's own."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), *columns)


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row: a later filter is not pushed into its nested expressions and so not evaluated again for each use."""
    return df.select(F.explode(F.array(F.struct(*[df[c] for c in df.columns]))).alias("_row")).select("_row.*")


# ---- numpy helpers that run inside tasks


def byte_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of every value; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z; bytes.lower() leaves all bytes over 127 alone."""
    return text.lower()


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts joined by spaces; starts and ends of words in them; first word of each text (one more at the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.empty(len(data) + 1, dtype=np.int8)
    edge[0], edge[1:] = 1, space
    change = np.diff(edge)
    starts, ends = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    return data, starts, ends[: len(starts)], np.searchsorted(starts, at)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of spans of a sequence as sums of value times base to the position, modulo 2**64.

    The base is odd and so has an inverse: the sum of a span is a difference of
    two prefix sums, moved to the origin. Values are random 64-bit numbers.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(0, 1 << 61, dtype=np.uint64)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers = self._inverses = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self._powers) < n:
            k = len(self._powers)
            self._powers = np.concatenate((self._powers, self._powers * np.uint64(pow(self.base, k, 1 << 64))))
            self._inverses = np.concatenate((self._inverses, self._inverses * np.uint64(pow(self.inverse, k, 1 << 64))))
        return self._powers, self._inverses

    def sums(self, values: np.ndarray) -> np.ndarray:
        power, _ = self.powers(len(values) + 1)
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * power[: len(values)], out=total[1:])
        return total

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.between(self.sums(values), starts, ends)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each word, in runs of words of BLOCK_BYTES so that temporary arrays stay small."""
        out = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
            lo, hi = starts[i], ends[j - 1]
            out[i:j] = self.spans(self.table[data[lo:hi]], starts[i:j] - lo, ends[i:j] - lo)
            i = j
        return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same for starts[1] and so on."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes under undirected edges a-b, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


# ---- connected components over all edges, as DataFrame joins


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node in ``edges`` (a, b; any integer ids): the smallest id that it reaches.

    Alternates large-star and small-star steps, which take a number of rounds
    that grows with the logarithm of the longest path. Each round joins edges to
    the least neighbour of a node, a pre-aggregated minimum: no neighbour list is
    ever gathered. Rounds are written to the shared folder; the driver sees counts only.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    for _ in range(most_rounds):
        # Large star: neighbours over a node go to the least of its neighbours and itself.
        e = both(edges)
        least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = e.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its lesser neighbours go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("n").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialise(small, "edges")
        # A star forest that large-star leaves as it is: every a has one b, and no b is an a.
        ends = new.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(new.select("b", F.lit(0), F.lit(1)))
        unsettled = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        done = not unsettled.take(1)
        drop_materialised(edges)
        edges = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
