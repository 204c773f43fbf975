"""What the operators of this subpackage share: the shared folder, tables, byte-level text arrays."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the five bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


#: Folders made here, by session, so that release() can delete them.
_folders: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir.

    Where that is unset, it is set to a folder of this machine if driver and executors are one process;
    on a cluster that would lose data, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/evidentia-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again; this cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, upto: int | None = None) -> None:
    """Delete the stored folders from number `since` to before `upto`, as folders() counts them.

    Only for tables that no DataFrame still to be run reads.
    """
    made = _folders.get(spark.sparkContext.applicationId, [])
    for path in made[since:upto]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    made[since:upto] = []


def folders(spark: SparkSession) -> int:
    """How many stored folders there are."""
    return len(_folders.get(spark.sparkContext.applicationId, []))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that none of `taken` equals, whatever the case."""
    have, out = {x.lower() for x in taken}, []
    for x in names:
        while x.lower() in have:
            x += "_"
        have.add(x.lower())
        out.append(x)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text (null: empty), the only columns most operators read."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        inverse = pow(_P, -1, 2**64)
        up, down = np.full(m, _P, np.uint64), np.full(m, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def bounds(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words in these bytes."""
    starts, ends = bounds(~SPACE[data])
    return run_hashes(data, starts, ends), starts, ends


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs from starts to ends."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; of the whole sequence if it is shorter; none if there are no words."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for j in range(width):
        out = out * U64(0xD6E8FEB86659FD93) + mix(words[j : len(words) - width + 1 + j] + U64(j))
    return mix(out)


def chunks(batch: pa.RecordBatch, column: str, limit: int = 4_000_000):
    """Slices of a batch with about `limit` bytes of the column at most (one row at least)."""
    sizes = np.cumsum(lengths(batch.column(column)))
    lo = 0
    while lo < batch.num_rows:
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes; null: empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


_caches: dict[str, Callable[[], object]] = {}
_owner = ""


def own_worker(name: str, forget: Callable[[], object] | None = None) -> None:
    """Called where an operator's Python function begins: what other operators keep in this worker is forgotten.

    Spark hands a worker on from stage to stage, so its memory is that of one operator at a time.
    """
    global _owner
    if forget:
        _caches[name] = forget
    if _owner != name:
        others = [f for k, f in _caches.items() if k != name]
        for f in others:
            f()
        _owner = name
        if others:
            gc.collect()
            trim()


def trim() -> None:
    """Give freed memory back to the system: workers idle beside the tasks of the next stage."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if release:
        release(0)
