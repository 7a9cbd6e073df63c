"""Saved campaigns as NumPy archives: a Python Data Source that reads slices of their arrays and writes archives of bounded size.

An archive holds, for the i-th arm, ``theta_i`` (n x d), ``margins_i`` (n) and, in newer files, ``seeds_i`` (n), and once
``labels`` (the arms' names) and ``param_names``. Object arrays are pickles; only arrays of text are let in.
"""

from __future__ import annotations

import io
import pickle
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, arm string, pos long, theta array<double>, margin double, seed long"
#: What a pickled array of text may name (fixed values).
SAFE = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar")}
#: Rows of a slice that a task reads, and of an archive that a task writes.
ROWS = 200_000


class TextOnly(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in SAFE:
            raise pickle.UnpicklingError(f"an archive's labels may not name {module}.{name}")
        return super().find_class(module, name)


def header(member: io.BufferedIOBase) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, order, type and start of the data of an array in an archive."""
    version = np.lib.format.read_magic(member)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)
    return shape, fortran, kind, member.tell()


def texts(archive: zipfile.ZipFile, name: str) -> list[str]:
    with archive.open(f"{name}.npy") as member:
        shape, _, kind, _ = header(member)
        if kind.hasobject:
            return [str(x) for x in TextOnly(member).load().ravel()]
        return [str(x) for x in np.frombuffer(member.read(), kind, int(np.prod(shape)))]


def part(archive: zipfile.ZipFile, name: str, start: int, stop: int) -> np.ndarray | None:
    """Rows start to stop of an array, without holding the others; None if the archive has no such array."""
    if f"{name}.npy" not in archive.namelist():
        return None
    with archive.open(f"{name}.npy") as member:
        shape, fortran, kind, data = header(member)
        width, size = int(np.prod(shape[1:])), kind.itemsize
        if not fortran or len(shape) == 1:
            member.seek(data + start * width * size)
            return np.frombuffer(member.read((stop - start) * width * size), kind).reshape(stop - start, *shape[1:])
        columns = []
        for j in range(width):
            member.seek(data + (j * shape[0] + start) * size)
            columns.append(np.frombuffer(member.read((stop - start) * size), kind))
        return np.stack(columns, 1)


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Slice(InputPartition):
    path: str
    number: int
    arm: str
    start: int
    stop: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def partitions(self) -> list[Slice]:
        """Slices from the arrays' headers alone."""
        system, path = located(self.path)
        info = system.get_file_info(path)
        files = [path] if info.type == fs.FileType.File else sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".npz"))
        out = []
        for file in files:
            with system.open_input_file(file) as raw, zipfile.ZipFile(raw) as archive:
                for i, arm in enumerate(texts(archive, "labels")):
                    sizes = []
                    for name in ("theta", "margins", "seeds"):
                        if f"{name}_{i}.npy" in archive.namelist():
                            with archive.open(f"{name}_{i}.npy") as member:
                                sizes.append(header(member)[0][0])
                    if len(set(sizes)) != 1 or len(sizes) < 2:
                        raise ValueError(f"{file}: the arrays of arm {arm} have lengths {sizes}")
                    out += [Slice(file, i, arm, at, min(at + self.rows, sizes[0])) for at in range(0, sizes[0], self.rows)]
        return out or [Slice("", 0, "", 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if partition.stop == partition.start:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as archive:
            theta, margins, seeds = (part(archive, f"{name}_{partition.number}", partition.start, partition.stop) for name in ("theta", "margins", "seeds"))
        theta = theta.reshape(len(margins), -1).astype(float)
        for k, margin in enumerate(margins.astype(float).tolist()):
            yield partition.path.rsplit("/", 1)[-1], partition.arm, partition.start + k, theta[k].tolist(), None if margin != margin else margin, None if seeds is None else int(seeds[k])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceWriter):
    """Each task writes archives of its own; they get their names when all tasks are done."""

    def __init__(self, path: str, rows: int, names: list[str]) -> None:
        self.path, self.rows, self.names = path, rows, names

    def write(self, iterator: Iterator[Row]) -> Written:
        files, held = [], []
        for row in iterator:
            held.append((row["arm"], row["theta"], row["margin"], row["seed"]))
            if len(held) == self.rows:
                files.append(self.archived(held))
                held = []
        return Written([*files, *([self.archived(held)] if held else [])])

    def archived(self, rows: list[tuple]) -> str:
        """One archive; points of an arm with and without seeds are two entries of that arm."""
        entries = {}
        for arm, theta, margin, seed in rows:
            entries.setdefault((arm, seed is None), []).append((theta, np.nan if margin is None else margin, seed))
        arrays = {"labels": np.array([arm for arm, _ in entries]), "param_names": np.array(self.names)}
        for i, ((_, blind), points) in enumerate(entries.items()):
            theta, margins, seeds = zip(*points, strict=True)
            arrays |= {f"theta_{i}": np.array(theta, float), f"margins_{i}": np.array(margins, float)}
            if not blind:
                arrays[f"seeds_{i}"] = np.array(seeds, np.int64)
        system, path = located(self.path)
        system.create_dir(path, recursive=True)
        out, file = io.BytesIO(), f"{path}/part-{uuid.uuid4().hex}.npz"
        np.savez_compressed(out, **arrays)
        with system.open_output_stream(f"{file}.tmp") as raw:
            raw.write(out.getbuffer())
        return file

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = located(self.path)
        for file in (f for m in messages if m for f in m.files):
            system.move(f"{file}.tmp", file)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = located(self.path)
        for file in (f for m in messages if m for f in m.files):
            system.delete_file(f"{file}.tmp")


class CampaignArchives(DataSource):
    """Format ``campaign_npz``. Options: path (a file, or a folder of archives that all executors reach), rows, names (comma-joined)."""

    @classmethod
    def name(cls) -> str:
        return "campaign_npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rows", ROWS)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        if overwrite:
            raise ValueError("archives are added, never replaced")
        return ArchiveWriter(self.options["path"], int(self.options.get("rows", ROWS)), [x for x in self.options.get("names", "").split(",") if x])


def read_archives(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """file, arm, pos, theta, margin (null where it is not a number), seed (null where the archive has none)."""
    spark.dataSource.register(CampaignArchives)
    return spark.read.format("campaign_npz").option("rows", rows).load(path)


def write_archives(points: DataFrame, path: str, names: list[str], rows: int = ROWS) -> None:
    """Points (arm, theta, margin, seed) as archives of at most ``rows`` points in the folder ``path``."""
    points.sparkSession.dataSource.register(CampaignArchives)
    held = points.selectExpr("'' AS file", "arm", "0L AS pos", "theta", "margin", "CAST(seed AS LONG) AS seed")
    held.write.format("campaign_npz").option("rows", rows).option("names", ",".join(names)).mode("append").save(path)
