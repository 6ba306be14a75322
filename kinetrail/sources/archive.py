"""Archive containers: many small files packed into few large blocks with an index.

A block holds the bytes of many files behind one another, and with them the
directory of its files: path, offset, length and checksum, and what was left out of a
file because it stands in another one. Blocks are rows of a Parquet table, some to a
file, so that reading is parallel by block, the index is read without the bytes, and
one file is found through the index: only the blocks that hold wanted files are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kinetrail.functions.paths import base_name, project_path
from kinetrail.session import drop, materialize, scratch_path

ENTRY = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("crc32", T.LongType()),
        T.StructField("surplus", T.ArrayType(T.LongType())),
    ]
)
BLOCK = T.StructType(
    [
        T.StructField("block", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("entries", T.ArrayType(ENTRY)),
        T.StructField("payload", T.BinaryType()),
    ]
)


#: Blocks that a lookup reads by a broadcast list; for more the list is joined.
LOOKUP = 10_000


def pack_blocks(
    files: DataFrame, key: str, path: str, content: str, order: list[str], block_bytes: int = 8 << 20, file_bytes: int = 128 << 20, surplus: str | None = None
) -> DataFrame:
    """Blocks of the bytes in ``content``, in ``order``, each file whole in one block.

    A NULL content is stored as no bytes, an empty table gives no blocks, and a file
    larger than ``block_bytes`` gets a block of its own. ``surplus`` names a column of
    numbers that goes into the directory. Ranges of ``order`` go to tasks by
    size, about ``file_bytes`` each; a task holds one block at a time.
    """
    total = files.agg(F.coalesce(F.sum(F.coalesce(F.length(content), F.lit(0)) + 64), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(total / file_bytes))
    rows = files.select(*order, F.col(key).alias("__key"), F.col(path).alias("__path"), F.col(content).alias("__content"), (F.col(surplus) if surplus else F.lit(None)).cast("array<bigint>").alias("__surplus"))
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    width = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        entries: list[dict] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, entries, size, made
            block = {"block": f"{task:06d}-{made:06d}", "n_bytes": size, "entries": entries, "payload": b"".join(parts)}
            parts, entries, size, made = [], [], 0, made + 1
            return pa.RecordBatch.from_pylist([block], to_arrow(BLOCK))

        for batch in batches:
            for i, p, c, left in zip(*(batch.column(width + j).to_pylist() for j in range(4))):
                c = c or b""
                if entries and size + len(c) > block_bytes:
                    yield flush()
                entries.append({"key": i, "path": p, "offset": size, "length": len(c), "crc32": zlib.crc32(c), "surplus": left or []})
                parts.append(c)
                size += len(c)
        if entries:
            yield flush()

    return rows.mapInArrow(run, BLOCK)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def write_archive(blocks: DataFrame, path: str) -> None:
    """Store blocks; a block is a row group, so that a reader of one file reads little more."""
    blocks.write.option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary", "false").parquet(path)


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """``block`` and the entry of each stored file, without reading any file's bytes."""
    return spark.read.schema(BLOCK).parquet(path).select("block", F.explode("entries").alias("e")).select("block", "e.*")


def archive_files(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Stored files with their bytes as ``content``, all or those of ``keys``, each checked against its checksum.

    A file whose bytes do not have their checksum fails the job.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    if keys is None:
        found = blocks.select("block", "payload", F.explode("entries").alias("e"))
    else:
        wanted = archive_index(spark, path).join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_semi")
        entry = F.struct(*(F.col(f.name) for f in ENTRY))
        wanted = materialize(wanted.groupBy("block").agg(F.collect_list(entry).alias("wanted")))  # the files of a block are bounded by its size
        names = [r["block"] for r in wanted.select("block").limit(LOOKUP + 1).collect()]
        if len(names) <= LOOKUP:  # the list reaches the scan, which skips row groups; payload is not shuffled
            blocks, wanted = blocks.where(F.col("block").isin(names)), F.broadcast(wanted)
        found = blocks.select("block", "payload").join(wanted, "block").select("block", "payload", F.explode("wanted").alias("e"))
    content = F.expr("substring(payload, CAST(e.offset + 1 AS INT), CAST(e.length AS INT))")
    checked = F.when(F.crc32(F.col("content")) == F.col("e.crc32"), F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit("checksum differs: "), F.coalesce(F.col("e.path"), F.lit("?")))).cast("binary")
    )
    return found.select("block", "e", content.alias("content")).select(
        F.col("e.key").alias("key"), F.col("e.path").alias("path"), checked.alias("content")
    )


# --- files of frame records ---------------------------------------------------


def chunk_table(files: DataFrame) -> DataFrame:
    """One row a chunk file: ``chunk_id``, ``path``, ``frames``, ``potential``.

    Rows of one ``chunk_id`` are one file; of several the fullest counts. NULL arrays
    are empty ones. Rows without ``chunk_id`` are left out.
    """
    full = F.coalesce(F.size("frames"), F.lit(-1))
    return (
        files.where(F.col("chunk_id").isNotNull())
        .groupBy("chunk_id")
        .agg(F.max_by(F.struct(project_path(F.col("chunk_fn")).alias("path"), "frames", "potential"), full).alias("f"))
        .select(
            "chunk_id",
            "f.path",
            F.coalesce("f.frames", F.array().cast("array<bigint>")).alias("frames"),
            F.coalesce("f.potential", F.array().cast("array<double>")).alias("potential"),
        )
    )


def chunk_owners(trajectories: DataFrame) -> DataFrame:
    """``path`` of each listed chunk and the ``trajectory`` that lists it, each pair once."""
    pairs = trajectories.select(base_name(F.col("filename")).alias("trajectory"), F.explode("chunks").alias("c")).select("trajectory", project_path(F.col("c")).alias("path"))
    return pairs.distinct().where(F.col("trajectory").isNotNull() & F.col("path").isNotNull())


def surplus_records(chunks: DataFrame, owners: DataFrame) -> DataFrame:
    """``chunk_id``, ``pos`` and ``frame`` of each record that its trajectory holds in a chunk with a smaller ``chunk_id`` too.

    Same frame with another potential is another record. Chunks that no
    trajectory lists have none. The groups compared are those of one record.
    """
    records = chunks.join(owners, "path").select(
        "trajectory", "chunk_id", F.posexplode(F.arrays_zip("frames", "potential")).alias("pos", "r")
    )
    same = W.partitionBy("trajectory", "frame", "potential").orderBy("chunk_id")
    ranked = records.select("trajectory", "chunk_id", "pos", "r.frames", "r.potential").toDF("trajectory", "chunk_id", "pos", "frame", "potential")
    return ranked.withColumn("__rank", F.rank().over(same)).where(F.col("__rank") > 1).select("chunk_id", "pos", "frame").distinct()


RECORDS = T.StructType([T.StructField("frame", T.LongType()), T.StructField("potential", T.DoubleType())])


def encode_records(df: DataFrame, keep: list[str], without: str | None = None) -> DataFrame:
    """Columns ``keep`` and the bytes of ``frames`` and ``potential`` as ``content``: all frames, then all potentials, 8 bytes each, little-endian.

    Records at the positions in the column ``without`` are left out. A missing number in
    either array is stored by a bit map in front.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("content", T.BinaryType())])
    left = F.col(without) if without else F.lit(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, p, gone in zip(*(batch.column(len(keep) + i) for i in range(3))):
                f, p = f.values, p.values
                if gone.is_valid and len(gone.values):
                    stays = np.ones(len(f), bool)
                    stays[gone.values.to_numpy()] = False
                    f, p = f.filter(pa.array(stays)), p.filter(pa.array(stays))
                out.append(_bytes(f, p))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], schema.names)

    return df.select(*keep, "frames", "potential", left.cast("array<int>")).mapInArrow(run, schema)


def _bytes(frames: pa.Array, potential: pa.Array) -> bytes:
    missing = frames.null_count + potential.null_count
    flags = np.concatenate([np.asarray(x.is_null()) for x in (frames, potential)]) if missing else np.zeros(0, bool)
    a = frames.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    b = potential.fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8")
    return bytes([bool(missing)]) + a.tobytes() + b.tobytes() + np.packbits(flags).tobytes()


def decode_records(files: DataFrame, keep: list[str]) -> DataFrame:
    """A row a record: columns ``keep``, ``frame`` and ``potential``, from ``content``."""
    schema = T.StructType([*(files.schema[c] for c in keep), *RECORDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames, potential, counts = [], [], []
            for c in batch.column(len(keep)).to_pylist():
                n = (len(c) - 1) // 16
                if c[0]:  # the bit map makes up for less than one record more
                    n = next(k for k in range(n, -1, -1) if 1 + 16 * k + (2 * k + 7) // 8 == len(c))
                f = np.frombuffer(c, "<i8", n, 1)
                p = np.frombuffer(c, "<f8", n, 1 + 8 * n)
                gone = np.unpackbits(np.frombuffer(c, np.uint8, -1, 1 + 16 * n), count=2 * n).astype(bool) if c[0] else np.zeros(2 * n, bool)
                frames.append(pa.array(f, mask=gone[:n]))
                potential.append(pa.array(p, mask=gone[n:]))
                counts.append(n)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            if len(at):
                columns = [batch.column(i).take(at) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays(frames), pa.concat_arrays(potential)], schema.names)

    return files.select(*keep, "content").mapInArrow(run, schema)


def pack_chunks(files: DataFrame, trajectories: DataFrame, block_bytes: int = 8 << 20, path: str | None = None) -> str:
    """Write all frame records once into an archive and return its place.

    Chunks of a trajectory lie together, in the order of their ids; unlisted chunks come
    first and are kept whole, as are chunk files without records. Surplus records are
    left out and named in the directory, so that with those that stay every record is
    told. Keys of the archive are chunk ids. Without ``path`` the archive is scratch and
    goes when the driver ends.
    """
    spark = files.sparkSession
    chunks = materialize(chunk_table(files))
    owners = chunk_owners(trajectories)
    surplus = surplus_records(chunks, owners).groupBy("chunk_id").agg(F.collect_list(F.struct("pos", "frame")).alias("gone"))
    first = owners.groupBy("path").agg(F.min("trajectory").alias("trajectory"))
    rows = chunks.join(surplus, "chunk_id", "left").join(first, "path", "left")
    rows = rows.select("trajectory", "chunk_id", "path", "frames", "potential", F.col("gone.pos").alias("gone"), F.array_sort("gone.frame").alias("surplus"))
    content = materialize(encode_records(rows, ["trajectory", "chunk_id", "path", "surplus"], "gone"))
    blocks = pack_blocks(content, "chunk_id", "path", "content", ["trajectory", "chunk_id"], block_bytes, surplus="surplus")
    path = path or scratch_path(spark, "archive")
    write_archive(blocks, path)
    drop(content)
    drop(chunks)
    return path


def surplus_of(index: DataFrame) -> DataFrame:
    """``chunk_id`` and ``frame`` of the records that an archive left out, as its directories tell."""
    return index.select(F.col("key").alias("chunk_id"), F.explode("surplus").alias("frame")).distinct()


def packed_index(files: DataFrame, trajectories: DataFrame) -> DataFrame:
    """The index of the archive of all chunk files."""
    index = archive_index(files.sparkSession, pack_chunks(files, trajectories))
    return index.select("block", F.col("key").alias("chunk_id"), "path", "offset", "length", "crc32", F.size("surplus").alias("n_surplus"))


def packed_surplus(files: DataFrame, trajectories: DataFrame) -> DataFrame:
    """``chunk_id`` and ``frame`` of what the archive of all chunk files left out."""
    return surplus_of(archive_index(files.sparkSession, pack_chunks(files, trajectories)))


def packed_records(files: DataFrame, trajectories: DataFrame) -> DataFrame:
    """All frame records as they are read back from the archive: ``chunk_id``, ``frame``, ``potential``."""
    stored = archive_files(files.sparkSession, pack_chunks(files, trajectories))
    return decode_records(stored.select(F.col("key").alias("chunk_id"), "content"), ["chunk_id"])
