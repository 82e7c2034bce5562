"""npy and npz files as tables, and back; graph folders of such files.

A data source ``npy`` splits an array by ranges of rows: each task seeks to its bytes, so no task and no driver holds the array.
Members of an npz that were stored plainly are read the same way; deflated ones stream through one task, as a deflated stream can't
be entered in its middle.  ``path`` may be any that pyarrow's file systems open.
"""

from __future__ import annotations

import ast
import json
import math
import struct
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..graph import Graph
from ..operators.joins import ranked

#: Bytes of an array that one task reads, and that one Arrow batch holds, by default.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def _opened(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        scheme, rest = path.split(":", 1)
        if scheme == "file":
            return pa.OSFile("/" + rest.lstrip("/"), "rb")
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return pa.OSFile(path, "rb")


@dataclass(frozen=True)
class Layout:
    """Where an array lies: its type, its shape and the place of its first byte (None in a deflated member)."""

    dtype: str
    shape: tuple[int, ...]
    fortran: bool
    start: int | None

    @property
    def item(self) -> int:
        return np.dtype(self.dtype).itemsize


def _header(read) -> tuple[Layout, int]:
    """The layout told by the first bytes of an npy file, with ``start`` 0, and the header's length."""
    magic = read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("no npy file")
    size = 2 if magic[6] == 1 else 4
    (length,) = struct.unpack("<H" if size == 2 else "<I", read(size))
    told = ast.literal_eval(read(length).decode("latin1" if magic[6] < 3 else "utf8"))
    if np.dtype(told["descr"]).hasobject:
        raise ValueError("arrays of Python objects are not read: they are pickles, which may run code")
    return Layout(told["descr"], tuple(told["shape"]), told["fortran_order"], 0), 8 + size + length


def members(path: str) -> list[str]:
    """Names of the arrays of an npz file."""
    with _opened(path) as f, zipfile.ZipFile(f) as z:
        return [n.removesuffix(".npy") for n in z.namelist() if n.endswith(".npy")]


def layout(path: str, array: str | None = None) -> Layout:
    with _opened(path) as f:
        if array is None:
            found, length = _header(f.read)
            return Layout(found.dtype, found.shape, found.fortran, length)
        with zipfile.ZipFile(f) as z:
            info = z.getinfo(array + ".npy")
            with z.open(info) as m:
                found, length = _header(m.read)
        if info.compress_type != zipfile.ZIP_STORED:
            return Layout(found.dtype, found.shape, found.fortran, None)
        f.seek(info.header_offset)
        local = f.read(30)
        name, extra = struct.unpack("<HH", local[26:30])
        return Layout(found.dtype, found.shape, found.fortran, info.header_offset + 30 + name + extra + length)


def _types(dtype: str):
    """Spark's type and the numpy type of its Arrow form: unsigned numbers take the next wider type, half floats a float."""
    d = np.dtype(dtype)
    if d.kind in "US":
        return T.StringType(), None
    plain = {"b1": (T.BooleanType(), "?"), "i1": (T.ByteType(), "i1"), "i2": (T.ShortType(), "i2"), "i4": (T.IntegerType(), "i4"), "i8": (T.LongType(), "i8"),
             "u1": (T.ShortType(), "i2"), "u2": (T.IntegerType(), "i4"), "u4": (T.LongType(), "i8"), "f2": (T.FloatType(), "f4"), "f4": (T.FloatType(), "f4"), "f8": (T.DoubleType(), "f8")}
    try:
        return plain[f"{d.kind}{d.itemsize}"]
    except KeyError:
        raise ValueError(f"no column type for {d}") from None


def _values(flat: np.ndarray, as_: str | None) -> pa.Array:
    if as_ is None:
        return pa.array([v.decode("utf8") if isinstance(v, bytes) else str(v) for v in flat], pa.string())
    return pa.array(np.ascontiguousarray(flat).astype(as_))


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class NpyReader(DataSourceReader):
    """Rows of an array along ``axis`` (0, or 1 for arrays such as a 2 x m edge index)."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.array = options["path"], options.get("array")
        self.axis, self.part_bytes = int(options.get("axis", 0)), int(options.get("partbytes", PART_BYTES))
        self.names = [f.name for f in schema.fields]
        self.lines, self.beside = _lines(options, layout(self.path, self.array)), list(_beside(options).values())

    def partitions(self) -> list[Rows]:
        a = layout(self.path, self.array)
        n, width = _rows_width(a, self.axis)
        if a.start is None:
            return [Rows(0, n)]
        step = max(1, self.part_bytes // max(1, a.item * max(1, width)))
        return [Rows(k, min(n, k + step)) for k in range(0, n, step)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        a = layout(self.path, self.array)
        n, width = _rows_width(a, self.axis)
        _, as_ = _types(a.dtype)
        side_by_side = _contiguous(a, self.axis)
        step = max(1, BATCH_BYTES // max(1, a.item * max(1, width)))
        if a.start is None and not side_by_side:
            raise ValueError("a deflated array can only be read along its lines; save it plainly (np.savez) or transposed")
        with ExitStack() as files:
            f = files.enter_context(_opened(self.path))
            beside = [(files.enter_context(_opened(p)), layout(p)) for p in self.beside]
            source, member, archive = f, None, None
            if a.start is None:
                archive = zipfile.ZipFile(f)
                member = source = archive.open(self.array + ".npy")
                _header(member.read)
            for first in range(part.first, part.last, step):
                m = min(step, part.last - first)
                if side_by_side:
                    if a.start is not None:
                        source.seek(a.start + first * width * a.item)
                    block = np.frombuffer(_exactly(source, m * width * a.item), a.dtype).reshape(m, width)
                else:
                    wanted = range(width) if self.lines is None else self.lines
                    block = np.empty((m, width), a.dtype)
                    for line in wanted:
                        f.seek(a.start + (line * n + first) * a.item)
                        block[:, line] = np.frombuffer(_exactly(f, m * a.item), a.dtype)
                columns = [pa.array(np.arange(first, first + m))]
                if self.lines is not None:
                    columns += [_values(block[:, line], as_) for line in self.lines]
                elif len(a.shape) == 1:
                    columns.append(_values(block[:, 0], as_))
                else:
                    columns.append(pa.ListArray.from_arrays(np.arange(m + 1, dtype="i4") * width, _values(block.reshape(-1), as_)))
                for file, b in beside:
                    file.seek(b.start + first * b.item)
                    columns.append(_values(np.frombuffer(_exactly(file, m * b.item), b.dtype), _types(b.dtype)[1]))
                yield pa.RecordBatch.from_arrays(columns, self.names)
            if archive is not None:
                member.close()
                archive.close()


def _exactly(f, size: int) -> bytes:
    got = f.read(size)
    if len(got) != size:
        raise ValueError("the file is shorter than its header tells")
    return got


def _rows_width(a: Layout, axis: int) -> tuple[int, int]:
    if len(a.shape) == 0 or (axis == 1 and len(a.shape) != 2) or axis not in (0, 1):
        raise ValueError(f"no rows along axis {axis} of an array of shape {a.shape}")
    n = a.shape[axis]
    return n, math.prod(a.shape[1:]) if axis == 0 else a.shape[0]


def _contiguous(a: Layout, axis: int) -> bool:
    """Whether a row's numbers lie side by side."""
    if len(a.shape) > 2 and a.fortran:
        raise ValueError("arrays of over two axes are read in C order only")
    return len(a.shape) == 1 or a.fortran == (axis == 1)


def _lines(options: dict, a: Layout) -> list[int] | None:
    """The lines across the rows that are asked for as columns (``lines``: such as ``0,2``), or None for all as one array."""
    if "lines" not in options:
        return None
    return [int(x) for x in options["lines"].split(",")]


def _beside(options: dict) -> dict[str, str]:
    """The npy files of one axis that are read row by row beside the array (``beside``: a JSON object of column names and paths)."""
    return json.loads(options.get("beside", "{}"))


class NpySource(DataSource):
    """Options: path, array (an npz member's name), axis, lines and names (of columns of their own; other lines aren't read), partBytes, beside."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        a = layout(self.options["path"], self.options.get("array"))
        n, width = _rows_width(a, int(self.options.get("axis", 0)))
        kind, _ = _types(a.dtype)
        beside = []
        for name, path in _beside(self.options).items():
            b = layout(path)
            if b.shape != (n,):
                raise ValueError(f"{path} has the shape {b.shape} and not {(n,)}")
            beside.append(T.StructField(name, _types(b.dtype)[0]))
        lines = _lines(self.options, a)
        fields = [T.StructField("row", T.LongType())]
        if lines is not None:
            if any(not 0 <= x < width for x in lines):
                raise ValueError(f"lines {lines} of {width}")
            names = self.options["names"].split(",") if "names" in self.options else [f"c{x}" for x in lines]
            return T.StructType(fields + [T.StructField(x, kind) for x in names] + beside)
        return T.StructType([*fields, T.StructField("value", kind if len(a.shape) == 1 else T.ArrayType(kind)), *beside])

    def reader(self, schema: T.StructType) -> NpyReader:
        return NpyReader(self.options, schema)


def read_npy(spark: SparkSession, path: str, array: str | None = None, axis: int = 0, columns: dict[str, int] | None = None, part_bytes: int = PART_BYTES, beside: dict[str, str] | None = None) -> DataFrame:
    """(row, value) of an array: a number a row of one axis, an array a row of more; or (row, ...) with the lines that ``columns`` names.

    ``beside`` names columns from npy files of one axis and as many rows, which are read by the same ranges, so that no join puts them together.

    Null never occurs; an empty array is an empty table. Arrays without an axis, of objects or complex numbers raise an error.
    """
    spark.dataSource.register(NpySource)
    made = spark.read.format("npy").option("axis", axis).option("partBytes", part_bytes)
    if array is not None:
        made = made.option("array", array)
    if columns:
        made = made.option("lines", ",".join(map(str, columns.values()))).option("names", ",".join(columns))
    if beside:
        made = made.option("beside", json.dumps(beside))
    return made.load(path)


# ---- writing


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError("tasks write their own ranges of one file, which takes a mounted folder that all executors share")
    return path


def write_npy(rows: DataFrame, path: str, columns: str | list[str], dtype: str = "float64", row: str = "row", in_runs: bool = False) -> tuple[int, ...]:
    """``rows``, numbered 0..n-1 by ``row``, as one npy file; the shape.

    A scalar column makes an array of one axis, an array column an n x k one, a list of k columns a k x n one.
    The header is written first; then every task sorts its range of rows and writes it at its place, the same bytes whenever it is run again.
    Nulls, numbers that don't run from 0 to n-1 and vectors of several lengths raise an error.
    Rows as ``ranked`` returns them lie ``in_runs`` already, with numbers right by construction: each is written from where it lies.
    """
    import os

    path, several = _local(path), isinstance(columns, list)
    names = columns if several else [columns]
    vector = not several and isinstance(rows.schema[columns].dataType, T.ArrayType)
    size = F.size(columns) if vector else F.lit(1)
    null = F.lit(False)
    for c in [*names, row]:
        null = null | F.col(c).isNull()
    if vector:
        null = null | F.exists(columns, lambda x: x.isNull())
    facts = rows.agg(F.count("*").alias("n"), (F.count("*") if in_runs else F.count_distinct(row)).alias("distinct"), F.min(row).alias("least"), F.max(row).alias("most"), F.min(size).alias("short"), F.max(size).alias("long"), F.count_if(null).alias("nulls")).first()
    n = facts.n
    if facts.nulls or (n and (facts.distinct != n or facts.least != 0 or facts.most != n - 1 or facts.short != facts.long)):
        raise ValueError(f"rows 0..{n - 1} without nulls and with vectors of one length are needed: {facts}")
    width = (facts.long or 0) if vector else len(names)
    shape = (n, width) if vector else (width, n) if several else (n,)
    kind = np.dtype(dtype)
    with open(path, "wb") as f:
        np.lib.format.write_array_header_2_0(f, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": shape})
        start = f.tell()
        f.truncate(start + n * width * kind.itemsize)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = os.open(path, os.O_WRONLY)
        done = 0
        try:
            for batch in batches:
                at = batch.column(0).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
                for a, b in zip(cuts, cuts[1:]):
                    for line in range(1, batch.num_columns):
                        piece = batch.column(line).slice(a, b - a)
                        data = (piece.flatten() if vector else piece).to_numpy(zero_copy_only=False).astype(kind)
                        place = int(at[a]) * (width if vector else 1) + (line - 1) * n
                        view = memoryview(data.tobytes())
                        while view:
                            wrote = os.pwrite(handle, view, start + place * kind.itemsize + data.nbytes - len(view))
                            view = view[wrote:]
                done += len(at)
            os.fsync(handle)
        finally:
            os.close(handle)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    ordered = rows.select(F.col(row).cast("long"), *names)
    if not in_runs:
        ordered = ordered.repartitionByRange(row).sortWithinPartitions(row)
    (wrote,) = ordered.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()
    if wrote != n:
        raise RuntimeError(f"{wrote} of {n} rows written")
    return shape


# ---- graph folders


def save_graph(graph: Graph, path: str) -> None:
    """``edge_index`` (2 x m, by source and target), ``edge_attr``, ``adj_index`` (n + 1 offsets), ``node_feat`` (x), ``node_label`` (y) as npy files, and ``info.json``.

    Ids must be 0..n-1 (``subgraph`` relabels). Features and labels are written if the nodes have them; a node without label gets -1.
    """
    import os

    path = _local(path)
    os.makedirs(path, exist_ok=True)
    edges = ranked(graph.edges.select("src", "dst", "weight"), "row", "src", "dst", "weight")
    write_npy(edges, f"{path}/edge_index.npy", ["src", "dst"], "int64", in_runs=True)
    flags = graph.flags().first()
    if flags.weighted:
        write_npy(edges, f"{path}/edge_attr.npy", "weight", in_runs=True)
    ends = graph.offsets().select((F.col("id") + 1).alias("row"), F.col("end").alias("at"))
    zero = graph.edges.sparkSession.createDataFrame([(0, 0)], "row long, at long")
    (n_offsets,) = write_npy(ends.unionByName(zero), f"{path}/adj_index.npy", "at", "int64")
    if flags.n_features:
        write_npy(graph.nodes, f"{path}/node_feat.npy", "x", row="id")
    if flags.has_labels:
        write_npy(graph.nodes.withColumn("y", F.coalesce(F.col("y").cast("long"), F.lit(-1))), f"{path}/node_label.npy", "y", "int64", "id")
    with open(f"{path}/info.json", "w", encoding="utf-8") as f:
        json.dump({"num_nodes": n_offsets - 1, "undir": bool(graph.is_undirected().first()[0])}, f)


def _exists(path: str) -> bool:
    try:
        _opened(path).close()
        return True
    except FileNotFoundError:
        return False


def load_graph(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> Graph:
    """A graph folder's edges and nodes; nodes carry ``x`` and ``y`` if the folder has them. Without ``info.json`` the largest id tells the number of nodes."""
    weight = {"weight": f"{path}/edge_attr.npy"} if _exists(f"{path}/edge_attr.npy") else None
    edges = read_npy(spark, f"{path}/edge_index.npy", axis=1, columns={"src": 0, "dst": 1}, part_bytes=part_bytes, beside=weight)
    info = {}
    if _exists(f"{path}/info.json"):
        with _opened(f"{path}/info.json") as f:
            info = json.loads(f.read())
    n = info.get("num_nodes")
    if n is None:
        n = edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0))).first()[0]
    nodes = spark.range(n)
    for file, name in (("node_feat", "x"), ("node_label", "y")):
        if _exists(f"{path}/{file}.npy"):
            nodes = nodes.join(read_npy(spark, f"{path}/{file}.npy", part_bytes=part_bytes).select(F.col("row").alias("id"), F.col("value").alias(name)), "id", "left")
    return Graph.from_edges(edges, nodes)
