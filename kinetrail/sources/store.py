"""Datasets on disk: Parquet by trajectory with provenance, directories of NumPy arrays, models, metadata."""

from __future__ import annotations

import getpass
import io
import importlib
import json
import platform
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail import __version__

#: Buckets of trajectories into which a dataset is partitioned, so that a directory never holds one file a trajectory.
BUCKETS = 64


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target, fs = _path(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def backup(spark: SparkSession, path: str) -> str | None:
    """Move what stands at a path to ``.bak.N``, the first free number; the new place, or None."""
    if not exists(spark, path):
        return None
    n = next(i for i in range(10**6) if not exists(spark, f"{path}.bak.{i}"))
    target, fs = _path(spark, path)
    fs.rename(target, _path(spark, f"{path}.bak.{n}")[0])
    return f"{path}.bak.{n}"


class Dataset:
    """Frames as Parquet, partitioned by buckets of ``traj_id``, with a record of where they come from."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, df: DataFrame, path: str, mode: str = "errorifexists", parent: Dataset | None = None, command: str = "") -> Dataset:
        """``mode``: ``errorifexists``, ``append``, ``overwrite``, or ``backup``, which keeps what was there."""
        out = cls(df.sparkSession, path)
        if mode == "backup":
            backup(out.spark, out.path)
            mode = "errorifexists"
        bucket = F.pmod(F.xxhash64("traj_id"), F.lit(BUCKETS)).cast("int")
        rows = df.withColumn("bucket", bucket)
        # the salt keeps a hot bucket from being one task
        salt = F.pmod(F.xxhash64("frame"), F.lit(8)) if "frame" in df.columns else F.lit(0)
        rows.repartition("bucket", salt).sortWithinPartitions("traj_id", *(["frame"] if "frame" in df.columns else [])).write.mode(mode).partitionBy("bucket").parquet(f"{out.path}/data")
        record = {
            "version": __version__, "command": command, "user": _user(), "host": platform.node(),
            "date": datetime.now(UTC).isoformat(timespec="seconds"), "parents": [parent.provenance()] if parent else [],
        }
        write_text(out.spark, f"{out.path}/PROVENANCE.json", json.dumps(record, indent=1))
        return out

    def frames(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data").drop("bucket")

    def __getitem__(self, traj) -> DataFrame:
        """The frames of one trajectory: one bucket is read."""
        df = self.spark.read.parquet(f"{self.path}/data")
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(traj).cast(df.schema["traj_id"].dataType)), F.lit(BUCKETS)).cast("int")).first()[0]
        return df.where((F.col("bucket") == bucket) & (F.col("traj_id") == F.lit(traj))).drop("bucket")

    def keys(self) -> DataFrame:
        return natural_order(self.frames().select("traj_id").distinct(), "traj_id")

    def provenance(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/PROVENANCE.json"))

    def apply(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
        """A function of each trajectory, lazily."""
        return self.frames().groupBy("traj_id").applyInPandas(fn, schema)

    def fit_with(self, estimator):
        return estimator.fit(self.frames())

    def transform_with(self, model, path: str, mode: str = "errorifexists") -> Dataset:
        return Dataset.create(model.transform(self.frames()), path, mode, self, f"transform {type(model).__name__}")

    def fit_transform_with(self, estimator, path: str, mode: str = "errorifexists") -> Dataset:
        return self.transform_with(self.fit_with(estimator), path, mode)


def _user() -> str:
    try:
        return getpass.getuser()
    except (KeyError, OSError):
        return "unknown"


def natural_key(c: Column) -> Column:
    """An array that sorts text with numbers as people do: runs of digits are filled up with zeros."""
    parts = F.regexp_extract_all(c.cast("string"), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p))


def natural_order(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(natural_key(F.col(column)), column)


def open_dataset(spark: SparkSession, path: str, fmt: str | None = None):
    """A stored dataset by format, guessed from what lies there: ``parquet`` a :class:`Dataset`, else a DataFrame of frames.

    ``dir-npy``, ``pdb`` and ``xyz`` are read by their files. Formats joined by ``-union`` and
    those without a reader here, such as ``hdf5``, are refused.
    """
    from kinetrail.sources.coordinates import READERS, read_coordinates

    if fmt is None:
        fmt = "parquet" if exists(spark, f"{path}/data") else "dir-npy"
    if fmt == "parquet":
        return Dataset(spark, path)
    if fmt == "dir-npy":
        return read_npy(spark, path)
    if fmt in READERS:
        return read_coordinates(spark, path, fmt)
    raise ValueError(f"no reader for {fmt!r}")


# --- NumPy arrays ---

ARRAY_ROWS = "path string, frame bigint, features array<double>"


def read_npy(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """``path``, ``frame``, ``features`` of all arrays in a directory; vectors count as single columns."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"]):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                x = x.reshape(len(x), -1).astype(float)
                for a in range(0, len(x), 10_000):
                    yield pd.DataFrame({"path": p, "frame": np.arange(a, min(a + 10_000, len(x))), "features": list(x[a : a + 10_000])})

    return files.mapInPandas(load, ARRAY_ROWS)


def write_npy(df: DataFrame, path: str, name: Callable[[object], str] | None = None, allowed: str = r"[\w./-]+") -> list[str]:
    """One array a trajectory, named by a function of its key, which is checked; written by the tasks to a shared folder."""
    import os

    name = name or (lambda k: f"{int(k):08d}.npy")
    root = path.removeprefix("file://")
    kind = df.schema["traj_id"]

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["traj_id"].iloc[0]
        file = name(key)
        if not re.fullmatch(allowed, file) or ".." in file:
            raise ValueError(f"not a fit file name: {file!r}")
        target = os.path.join(root, file)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{os.getpid()}.part"
        with open(part, "wb") as out:
            np.save(out, np.stack(pdf.sort_values("frame")["features"].to_numpy()))
        os.replace(part, target)  # whole or not at all
        return pd.DataFrame({"traj_id": [key], "file": [file]})

    schema = T.StructType([kind, T.StructField("file", T.StringType())])
    return sorted(r["file"] for r in df.groupBy("traj_id").applyInPandas(save, schema).collect())


# --- metadata ---


def parsed_metadata(df: DataFrame, column: str, pattern: str, names: list[str], casts: dict[str, str] | None = None) -> DataFrame:
    """Groups of a pattern in file names as columns; a name that does not match has NULLs in them and ``parsed`` false."""
    out = df.withColumn("parsed", F.col(column).rlike(f"^(?:{pattern})$"))
    for i, n in enumerate(names):
        value = F.when(F.col("parsed"), F.regexp_extract(column, f"^(?:{pattern})$", i + 1))
        out = out.withColumn(n, value.try_cast((casts or {}).get(n, "string")))
    return out


def numbered_runs(df: DataFrame, column: str, template: str = "trajectory-{run}.dcd") -> DataFrame:
    """The number in the place of ``{run}``."""
    if template.count("{run}") != 1:
        raise ValueError("a template holds {run} once")
    a, b = template.split("{run}")
    return parsed_metadata(df, column, f"{re.escape(a)}([0-9]+){re.escape(b)}", ["run"], {"run": "int"})


def hierarchy(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Parts of a path as columns, from the first; a path of another depth has ``parsed`` false."""
    return parsed_metadata(df, column, "/".join(["([^/]+)"] * len(levels)), levels)


def gather_metadata(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``length``, ``modified`` of the files under a directory, without their bytes, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return natural_order(files.select("path", "length", F.col("modificationTime").alias("modified")), "path")


def save_meta(meta: DataFrame, path: str) -> None:
    backup(meta.sparkSession, path)
    meta.coalesce(1).write.parquet(path)


def load_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def render_meta(meta: DataFrame, most: int = 1000) -> str:
    """The first rows as an HTML table."""
    return meta.limit(most).toPandas().to_html(index=False)


def load_trajectories(meta: DataFrame, frames: DataFrame, stride: int = 1, key: str = "traj_id") -> DataFrame:
    """Frames of the trajectories in a metadata table with its columns, every ``stride``-th."""
    rows = frames if stride == 1 else frames.where(F.col("frame") % stride == 0)
    return rows.join(meta, key)


def join_chunks(frames: DataFrame, traj: str, chunk: str, frame: str, drop_first_duplicate: bool = True) -> DataFrame:
    """Frames of chunked trajectories numbered through: ``traj``, ``frame`` and the other columns.

    A chunk may begin with the last frame of the chunk before, which is then dropped.
    """
    from pyspark.sql import Window as W

    rows = frames
    if drop_first_duplicate:
        first = W.partitionBy(traj).orderBy(chunk)
        numbered = frames.select(traj, chunk).distinct().withColumn("__i", F.row_number().over(first))
        low = frames.groupBy(traj, chunk).agg(F.min(frame).alias("__low"))
        rows = frames.join(numbered, [traj, chunk]).join(low, [traj, chunk]).where((F.col("__i") == 1) | (F.col(frame) > F.col("__low"))).drop("__i", "__low")
    through = W.partitionBy(traj).orderBy(chunk, frame)
    return rows.withColumn("__n", (F.row_number().over(through) - 1).cast("bigint")).drop(frame).withColumnRenamed("__n", frame)


# --- models ---


def save_model(spark: SparkSession, model, path: str) -> None:
    """The numbers and parameters of a model as JSON, with models and tables of numbers within it: no code is stored.

    What cannot be written, such as a function or a table of the session, raises ``TypeError``.
    """
    state = {k: _plain(v, k) for k, v in vars(model).items() if not k.startswith("_")}
    backup(spark, path)
    write_text(spark, path, json.dumps({"class": type(model).__name__, "version": __version__, "state": state}))


def load_model(spark: SparkSession, kind: type, path: str):
    stored = json.loads(read_text(spark, path))
    if stored["class"] != kind.__name__:
        raise ValueError(f"the file holds a {stored['class']}, not a {kind.__name__}")
    out = kind.__new__(kind)
    out.__dict__.update({k: _real(v) for k, v in stored["state"].items()})
    return out


def _plain(v, name: str = ""):
    if isinstance(v, np.ndarray):
        return {"array": v.tolist(), "dtype": str(v.dtype)}
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, (str, int, float, bool)) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return [_plain(x, name) for x in v]
    if isinstance(v, dict):
        return {"items": [[_plain(k, name), _plain(x, name)] for k, x in v.items()]}
    if type(v).__module__.startswith("kinetrail.") and hasattr(v, "__dict__"):
        return {"class": f"{type(v).__module__}:{type(v).__qualname__}", "state": {k: _plain(x, f"{name}.{k}") for k, x in vars(v).items() if not k.startswith("_")}}
    raise TypeError(f"{name} of the model cannot be written: {type(v).__name__}")


def _real(v):
    if isinstance(v, list):
        return [_real(x) for x in v]
    if not isinstance(v, dict):
        return v
    if "array" in v:
        return np.array(v["array"], dtype=v["dtype"])
    if "items" in v:
        keys = ((tuple(k) if isinstance(k, list) else k, x) for k, x in v["items"])
        return {_real(k): _real(x) for k, x in keys}
    module, _, name = v["class"].partition(":")
    if not module.startswith("kinetrail."):
        raise ValueError(f"the file names a class from elsewhere: {v['class']}")
    kind = getattr(importlib.import_module(module), name)
    out = kind.__new__(kind)
    for k, x in v["state"].items():
        object.__setattr__(out, k, _real(x))
    return out
