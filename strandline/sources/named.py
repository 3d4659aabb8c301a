"""Files by name: a sink of one file a row with commit and abort, and trajectories read frame by frame.

Both reach a file system by its address (local, HDFS, S3 and others that
pyarrow knows); a path without a scheme is local, or a mount that all see.
"""

from __future__ import annotations

import struct
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of frames that one task reads, about.
PART = 32 << 20
#: Tasks to which smaller parts are dealt at least, and atoms of a batch of frames.
TASKS, ATOMS = 256, 1 << 16
FRAME_COLUMNS = {"file": "string", "frame": "int", "atom": "int", "x": "float", "y": "float", "z": "float"}


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}") if path.startswith("/") else fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    folder: str


class NamedFiles(DataSource):
    """Format `named_files`: rows (name string, content binary), each a file of the folder `path`."""

    @classmethod
    def name(cls):
        return "named_files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return NamedWriter(self.options["path"], overwrite)


class NamedWriter(DataSourceWriter):
    """Tasks write beside the folder's files, each into a folder of its own; only the commit moves files to their names.

    A task that is killed leaves nothing under a name, and its second attempt
    does not see what the first has left. With mode overwrite the folder holds
    this result alone afterwards; with append its files replace those of the
    same names. Two rows of one name, or a name with a slash, are an error, and
    then nothing changes.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, rows):
        system, root = place(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder)
        names = []
        for row in rows:
            if not row.name or "/" in row.name or row.name.startswith("_"):
                raise ValueError(f"not a name of a file: {row.name!r}")
            with system.open_output_stream(f"{folder}/{row.name}") as out:
                out.write(bytes(row.content or b""))
            names.append(row.name)
        return Written(names, folder)

    def commit(self, messages):
        system, root = place(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one name")
        for m in done:
            for name in m.names:
                target = f"{root}/{name}"
                if system.get_file_info(target).type != fs.FileType.NotFound:
                    system.delete_file(target)
                system.move(f"{m.folder}/{name}", target)
        if self.overwrite:
            kept = set(names)
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.File and old.base_name not in kept:
                    system.delete_file(old.path)
        self._clear(system, root)

    def abort(self, messages):
        self._clear(*place(self.path))

    def _clear(self, system, root):
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


def write_named(rows: DataFrame, path: str, overwrite: bool = True) -> None:
    """Rows (name, content) as files of a folder."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode("overwrite" if overwrite else "append").save(path)


# ---- trajectories


def frames_to_bytes(frames: np.ndarray, cell: bool = False, order: str = "<") -> bytes:
    """A trajectory file of frames (f, n, 3) in single precision: records with their length before and after, a header, then the three axes of each frame (and a unit cell before them)."""
    record = lambda b: struct.pack(f"{order}i", len(b)) + b + struct.pack(f"{order}i", len(b))
    control = [len(frames), 1, 1, len(frames)] + [0] * 16
    control[10], control[19] = int(cell), 24
    out = [record(b"CORD" + struct.pack(f"{order}20i", *control)), record(struct.pack(f"{order}i", 1) + b"frames".ljust(80)), record(struct.pack(f"{order}i", frames.shape[1]))]
    for f in frames.astype(f"{order}f4"):
        out += [record(bytes(48))] * int(cell) + [record(np.ascontiguousarray(f[:, a]).tobytes()) for a in range(3)]
    return b"".join(out)


@dataclass
class FrameRange(InputPartition):
    path: str
    file: str
    start: int
    first: int
    frames: int
    atoms: int
    cell: int
    order: str


def frame_ranges(path: str, part: int = PART) -> list[FrameRange]:
    """Ranges of whole frames of all files of a folder (or of one file), from their headers and sizes; frames cut off at a file's end are not there."""
    system, root = place(path)
    one = system.get_file_info(root)
    files = [one] if one.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and "/_" not in f.path), key=lambda f: f.path)

    def ranges(f):
        with system.open_input_file(f.path) as stream:
            head = stream.read(4096)
        order = "<" if head[:4] == struct.pack("<i", 84) else ">"
        if head[4:8] != b"CORD" or struct.unpack(f"{order}i", head[:4])[0] != 84:
            raise ValueError(f"not a trajectory: {f.path}")
        control = struct.unpack(f"{order}20i", head[8:88])
        if control[8]:
            raise ValueError(f"fixed atoms are not supported: {f.path}")
        title = 92
        atoms_at = title + struct.unpack(f"{order}i", head[title : title + 4])[0] + 8
        atoms = struct.unpack(f"{order}i", head[atoms_at + 4 : atoms_at + 8])[0]
        start, cell = atoms_at + 12, 56 if control[10] else 0
        size = cell + 3 * (4 * atoms + 8)
        total, step = (f.size - start) // size, max(1, part // size)
        return [FrameRange(f.path, f.base_name, start + a * size, a, min(step, total - a), atoms, cell, order) for a in range(0, total, step)]

    with ThreadPoolExecutor(16) as pool:
        return [r for own in pool.map(ranges, files) for r in own]


@dataclass
class Ranges(InputPartition):
    ranges: list[FrameRange]


def dealt(ranges: list[FrameRange]) -> list[Ranges]:
    """Ranges by task: one each, but neighbours go together where there are more than `TASKS`, up to `PART` bytes a task. So small parts do not make tasks without end."""
    size = [r.frames * (r.cell + 3 * (4 * r.atoms + 8)) for r in ranges]
    most = min(PART, sum(size) / TASKS)
    out: list[Ranges] = []
    held = 0
    for r, n in zip(ranges, size, strict=True):
        if len(ranges) <= TASKS or not out or held + n > most:
            out.append(Ranges([]))
            held = 0
        own = out[-1].ranges
        if own and own[-1].path == r.path:
            own[-1] = replace(own[-1], frames=own[-1].frames + r.frames)
        else:
            own.append(r)
        held += n
    return out


class Frames(DataSource):
    """Format `frames`: a row for each atom of each frame. Options: path; columns: those to read, in order; part: bytes a task reads."""

    @classmethod
    def name(cls):
        return "frames"

    def columns(self):
        return [c.strip() for c in self.options.get("columns", ",".join(FRAME_COLUMNS)).split(",")]

    def schema(self):
        return ", ".join(f"{c} {FRAME_COLUMNS[c]}" for c in self.columns())

    def reader(self, schema):
        return FrameReader(self.options["path"], self.columns(), int(self.options.get("part", PART)))


class FrameReader(DataSourceReader):
    def __init__(self, path, columns, part):
        self.path, self.columns, self.part = path, columns, part

    def partitions(self):
        return dealt(frame_ranges(self.path, self.part))

    def read(self, partition):
        system, _ = place(self.path)
        for p in partition.ranges:
            with system.open_input_file(p.path) as stream:
                yield from self._frames(stream, p)

    def _frames(self, stream, p):
        size = p.cell + 3 * (4 * p.atoms + 8)
        axes = {"x": 0, "y": 1, "z": 2}
        many = max(1, ATOMS // max(1, p.atoms))
        stream.seek(p.start)
        for k in range(0, p.frames, many):
            n = min(many, p.frames - k)
            raw = np.frombuffer(stream.read(n * size), np.uint8).reshape(n, size)
            values = {}
            for c in self.columns:
                if c in axes:
                    # Only the axes asked for are decoded.
                    at = p.cell + axes[c] * (4 * p.atoms + 8) + 4
                    values[c] = pa.array(np.ascontiguousarray(raw[:, at : at + 4 * p.atoms]).view(f"{p.order}f4").astype(np.float32).ravel())
                elif c == "file":
                    values[c] = pa.repeat(pa.scalar(p.file, pa.string()), n * p.atoms)
                else:
                    values[c] = pa.array(np.repeat(np.arange(p.first + k, p.first + k + n, dtype=np.int32), p.atoms) if c == "frame" else np.tile(np.arange(p.atoms, dtype=np.int32), n))
            yield pa.RecordBatch.from_arrays([values[c] for c in self.columns], names=self.columns)


def read_frames(spark: SparkSession, path: str, columns: list[str] | None = None, part: int = PART) -> DataFrame:
    """(file, frame, atom, x, y, z), frames and atoms from 0, of the trajectory files in a folder; `columns`: only these are decoded. A file's frames are read by several tasks."""
    spark.dataSource.register(Frames)
    return spark.read.format("frames").option("columns", ",".join(columns or FRAME_COLUMNS)).option("part", part).load(path)


def atoms_of(frames: DataFrame) -> DataFrame:
    """(pidc, atoms) of each file, as `trajectory_problems` compares them."""
    from pyspark.sql import functions as F

    return frames.groupBy(F.regexp_replace("file", r"\.[^.]*$", "").alias("pidc")).agg((F.max("atom") + 1).alias("atoms"))
