"""HDF5 and MAT 7.3 files as movies, read in pieces by Spark.

The driver reads only what describes an array: superblock, the root group and its arrays' headers. The chunk index is a tree in the
file; Spark walks it a level at a time, each task reading the nodes it was given, and then every chunk is a row that one task reads and
decodes. Arrays without chunks are cut into runs of cells. No task holds more than one chunk or run.

Bytes are read by range through ``pyarrow.fs``, so a path is local (or mounted), ``hdfs://``, ``s3://`` or ``gs://``.
Read: old and new superblocks and groups, fixed-point and floating types of either byte order, compact, contiguous and chunked layouts
(tree, single and implicit index), shuffle, deflate and checksum filters, fill values of chunks that were never written.
Anything else is a ``ValueError`` that names it.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Read = Callable[[int, int], bytes]

SIGNATURE = b"\x89HDF\r\n\x1a\n"
# Fixed values of the format: message types, filter numbers.
SPACE, LINK_INFO, TYPE, OLD_FILL, FILL, LINK, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
#: Bytes of one piece of an array without chunks.
RUN = 16 << 20


def opened(path: str) -> Read:
    """A function (offset, size) -> bytes over a file."""
    from pyarrow import fs

    where = re.sub(r"^file:/+", "/", path)
    system, inner = (fs.LocalFileSystem(), where) if where.startswith("/") else fs.FileSystem.from_uri(where)
    file = system.open_input_file(inner)

    def read(at: int, size: int) -> bytes:
        raw = file.read_at(size, at)
        if len(raw) < size:
            raise ValueError(f"{path} ends within what it describes")
        return raw

    read.size = file.size()
    return read


@dataclass
class Array:
    """What is known of an array before its values are read. Addresses count from ``base``."""

    shape: tuple[int, ...]
    kind: np.dtype
    base: int
    widths: tuple[int, int]
    layout: str = "contiguous"
    at: int | None = None
    raw: bytes = b""
    chunk: tuple[int, ...] = ()
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    single: tuple[int, int] | None = None
    fill: bytes = b""

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunk, strict=True))


class Layout:
    """The descriptive part of a file."""

    def __init__(self, read: Read):
        self.raw_read = read
        at = 0
        while True:
            if at + 16 > read.size:
                raise ValueError("not an HDF5 file")
            if read(at, 8) == SIGNATURE:
                break
            at = max(512, 2 * at)
        version = read(at + 8, 1)[0]
        if version > 3:
            raise ValueError(f"HDF5 superblock of version {version} isn't read")
        self.o, self.l = read(at + 13, 2) if version < 2 else read(at + 9, 2)
        if version < 2:
            first = at + (24 if version == 0 else 28)
            self.base = self._word(read(first, self.o))
            root = first + 4 * self.o + self.o
        else:
            self.base = self._word(read(at + 12, self.o))
            root = at + 12 + 3 * self.o
        self.root = self._word(read(root, self.o))

    @staticmethod
    def _word(raw: bytes) -> int:
        return int.from_bytes(raw, "little")

    def _known(self, at: int) -> int | None:
        return None if at == (1 << 8 * self.o) - 1 else at

    def read(self, at: int, size: int) -> bytes:
        return self.raw_read(self.base + at, size)

    def messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(type, data) of an object's header and its continuations."""
        new = self.read(at, 4) == b"OHDR"
        if new:
            flags = self.read(at + 5, 1)[0]
            skip = 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            wide = 1 << (flags & 3)
            blocks = [(at + skip + wide, self._word(self.read(at + skip, wide)))]
            head = 6 if flags & 0x04 else 4
        else:
            blocks, head = [(at + 16, self._word(self.read(at + 8, 4)))], 8
        for start, size in blocks:  # continuations are appended while this runs
            raw, k = self.read(start, size), 0
            while k + head <= size:
                kind, length = (raw[k], self._word(raw[k + 1 : k + 3])) if new else struct.unpack_from("<HH", raw, k)
                shared = raw[k + 3] & 2 if new else raw[k + 4] & 2
                data = raw[k + head : k + head + length]
                k += head + length
                if kind == CONTINUED:
                    to, n = self._word(data[: self.o]), self._word(data[self.o : self.o + self.l])
                    blocks.append((to + 4, n - 8) if new else (to, n))
                elif shared and kind in (SPACE, TYPE, LAYOUT, FILTERS):
                    raise ValueError("HDF5 arrays with shared header messages aren't read")
                else:
                    yield kind, data

    def members(self) -> dict[str, int]:
        """Names and header addresses of what the root group holds."""
        out: dict[str, int] = {}
        for kind, m in self.messages(self.root):
            if kind == SYMBOLS:
                heap = self._word(m[self.o : 2 * self.o])
                names = self._word(self.read(heap + 8 + 2 * self.l, self.o))
                out.update(self._symbols(self._word(m[: self.o]), names))
            elif kind == LINK:
                out.update(self._link(m))
            elif kind == LINK_INFO:
                heap = 2 + (8 if m[1] & 1 else 0)
                if self._known(self._word(m[heap : heap + self.o])) is not None:
                    raise ValueError("HDF5 groups with densely stored links aren't read")
        return out

    def _symbols(self, node: int, names: int) -> Iterator[tuple[str, int]]:
        if self.read(node, 4) == b"TREE":
            used, at = self._word(self.read(node + 6, 2)), node + 8 + 2 * self.o + self.l
            for k in range(used):
                yield from self._symbols(self._word(self.read(at + k * (self.o + self.l), self.o)), names)
            return
        used, entry = self._word(self.read(node + 6, 2)), 2 * self.o + 24
        raw = self.read(node + 8, used * entry)
        for k in range(0, used * entry, entry):
            yield self._text(names + self._word(raw[k : k + self.o])), self._word(raw[k + self.o : k + 2 * self.o])

    def _text(self, at: int) -> str:
        out = b""
        while b"\0" not in out:
            more = min(64, self.raw_read.size - self.base - at - len(out))
            if more <= 0:
                raise ValueError("a name in the HDF5 file has no end")
            out += self.read(at + len(out), more)
        return out.split(b"\0", 1)[0].decode("utf-8", "replace")

    def _link(self, m: bytes) -> dict[str, int]:
        flags, k = m[1], 2
        kind = m[k] if flags & 8 else 0
        k += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 0x10 else 0)
        wide = 1 << (flags & 3)
        n = self._word(m[k : k + wide])
        name = m[k + wide : k + wide + n].decode("utf-8", "replace")
        at = m[k + wide + n : k + wide + n + self.o]
        return {name: self._word(at)} if kind == 0 else {}

    def array(self, at: int) -> Array | None:
        """The array whose header is at ``at``; None for groups and for values that are no numbers."""
        got: dict[int, bytes] = {}
        for kind, m in self.messages(at):
            got.setdefault(kind, m)
        if not {SPACE, TYPE, LAYOUT} <= got.keys():
            return None
        kind = self._type(got[TYPE])
        if kind is None:
            return None
        m = got[SPACE]
        start = 8 if m[0] == 1 else 4
        shape = tuple(self._word(m[start + k * self.l : start + (k + 1) * self.l]) for k in range(m[1]))
        out = Array(shape, kind, self.base, (self.o, self.l), fill=self._fill(got))
        if FILTERS in got:
            out.filters = list(self._filters(got[FILTERS]))
        self._layout(out, got[LAYOUT])
        return out

    @staticmethod
    def _type(m: bytes) -> np.dtype | None:
        order, size = ">" if m[1] & 1 else "<", int.from_bytes(m[4:8], "little")
        if m[0] & 15 == 0 and size in (1, 2, 4, 8):
            return np.dtype(f"{order}{'i' if m[1] & 8 else 'u'}{size}")
        return np.dtype(f"{order}f{size}") if m[0] & 15 == 1 and size in (2, 4, 8) else None

    def _fill(self, got: dict[int, bytes]) -> bytes:
        if FILL in got:
            m = got[FILL]
            there, at = (m[1] & 0x20, 2) if m[0] == 3 else (m[3] if m[0] == 2 else 1, 4)
        elif OLD_FILL in got:
            m, there, at = got[OLD_FILL], 1, 0
        else:
            return b""
        return m[at + 4 : at + 4 + self._word(m[at : at + 4])] if there else b""

    @staticmethod
    def _filters(m: bytes) -> Iterator[tuple[int, tuple[int, ...]]]:
        k = 8 if m[0] == 1 else 2
        for _ in range(m[1]):
            kind = struct.unpack_from("<H", m, k)[0]
            k += 2
            name = 0
            if m[0] == 1 or kind >= 256:
                name = struct.unpack_from("<H", m, k)[0]
                k += 2
            n = struct.unpack_from("<H", m, k + 2)[0]
            k += 4 + (-(-name // 8) * 8 if m[0] == 1 else name)
            if kind not in (DEFLATE, SHUFFLE, CHECKSUM):
                raise ValueError(f"HDF5 filter {kind} isn't read")
            yield kind, struct.unpack_from(f"<{n}I", m, k)
            k += 4 * (n + (n % 2 if m[0] == 1 else 0))

    def _layout(self, out: Array, m: bytes) -> None:
        if m[0] not in (3, 4):
            raise ValueError(f"HDF5 layout messages of version {m[0]} aren't read")
        if m[1] == 0:
            n = struct.unpack_from("<H", m, 2)[0]
            out.layout, out.raw = "compact", m[4 : 4 + n]
            return
        if m[1] == 1:
            out.at = self._known(self._word(m[2 : 2 + self.o]))
            return
        if m[1] != 2:
            raise ValueError("virtual HDF5 arrays aren't read")
        if m[0] == 3:
            n, at = m[2], 3 + self.o
            out.layout, out.at = "tree", self._known(self._word(m[3 : 3 + self.o]))
            out.chunk = struct.unpack_from(f"<{n}I", m, at)[:-1]
            return
        n, wide, at = m[3], m[4], 5
        out.chunk = tuple(self._word(m[at + k * wide : at + (k + 1) * wide]) for k in range(n))[:-1]
        at += n * wide
        index, at = m[at], at + 1
        if index == 1:
            out.layout, size, mask = "single", math.prod(out.chunk) * out.kind.itemsize, 0
            if m[2] & 2:
                size, mask, at = self._word(m[at : at + self.l]), self._word(m[at + self.l : at + self.l + 4]), at + self.l + 4
            out.single = (size, mask)
        elif index == 2:
            out.layout = "implicit"
        else:
            raise ValueError("HDF5 arrays with fixed, extensible or second-version chunk indexes aren't read; write them for the earliest library version")
        out.at = self._known(self._word(m[at : at + self.o]))


def is_hdf5(path: str) -> bool:
    """Whether a single file has the format's signature where a MAT or HDF5 file has it; folders and patterns haven't."""
    try:
        read = opened(path)
    except OSError:
        return False
    return any(at + 8 <= read.size and read(at, 8) == SIGNATURE for at in (0, 512))


def largest(read: Read, matlab: bool) -> Array:
    """The root group's array with the most elements; MATLAB's own ``#`` groups don't count."""
    f = Layout(read)
    found = [f.array(at) for name, at in f.members().items() if not (matlab and name.startswith("#"))]
    arrays = [a for a in found if a is not None]
    if not arrays:
        raise ValueError("the file holds no array")
    return max(arrays, key=lambda a: a.size)


def decode(raw: bytes, a: Array, mask: int = 0) -> np.ndarray:
    """A chunk's values; bit k of the mask says that filter k was left out."""
    for k in range(len(a.filters) - 1, -1, -1):
        kind, values = a.filters[k]
        if mask >> k & 1:
            continue
        if kind == DEFLATE:
            raw = zlib.decompress(raw)
        elif kind == CHECKSUM:
            raw = raw[:-4]
        else:
            size = values[0] if values else a.kind.itemsize
            whole = len(raw) // size * size
            raw = np.frombuffer(raw, "u1", whole).reshape(size, -1).T.tobytes() + raw[whole:]
    return np.frombuffer(raw, a.kind, math.prod(a.chunk)).reshape(a.chunk)


def _children(read: Read, a: Array, node: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(address, stored bytes, filter mask, first cell) of what a node of the chunk tree lists."""
    o, rank = a.widths[0], len(a.shape)
    used = int.from_bytes(read(a.base + node + 6, 2), "little")
    key, at = 8 + 8 * (rank + 1), a.base + node + 8 + 2 * o
    raw = read(at, used * (key + o))
    for k in range(0, len(raw), key + o):
        size, mask = struct.unpack_from("<II", raw, k)
        yield int.from_bytes(raw[k + key : k + key + o], "little"), size, mask, list(struct.unpack_from(f"<{rank}Q", raw, k + 8))


CHUNKS = "id bigint, at bigint, size bigint, mask bigint"


def chunk_table(spark: SparkSession, path: str, a: Array, read: Read) -> DataFrame:
    """(id, at, size, mask): every chunk in row-major order; those that were never written have no address.

    The tree's levels are walked by Spark: a row is a node, its task lists the node's children."""
    grid = a.grid
    every = spark.range(math.prod(grid))
    if a.at is None:
        return every.select("id", *[F.lit(None).cast("bigint").alias(c) for c in ("at", "size", "mask")])
    if a.layout == "single":
        return spark.createDataFrame([(0, a.at, *a.single)], CHUNKS)
    if a.layout == "implicit":
        size = math.prod(a.chunk) * a.kind.itemsize
        return every.select("id", (F.col("id") * size + a.at).alias("at"), F.lit(size).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mask"))
    level = read(a.base + a.at + 5, 1)[0]
    nodes = spark.createDataFrame([(a.at,)], "node bigint")

    def below(it):
        source = opened(path)
        for p in it:
            for node in p["node"]:
                yield pd.DataFrame({"node": [c[0] for c in _children(source, a, node)]}, dtype="int64")

    def leaves(it):
        source = opened(path)
        for p in it:
            for node in p["node"]:
                rows = [(int(np.ravel_multi_index([x // c for x, c in zip(first, a.chunk, strict=True)], grid)), at, size, mask) for at, size, mask, first in _children(source, a, node)]
                yield pd.DataFrame(rows, columns=["id", "at", "size", "mask"], dtype="int64")

    for _ in range(level):
        nodes = nodes.mapInPandas(below, "node bigint").repartition(spark.sparkContext.defaultParallelism, "node")
    return every.join(nodes.mapInPandas(leaves, CHUNKS), "id", "left")


def _long(values: np.ndarray, first: list[int], names: list[str], most: int = 1 << 18) -> Iterator[pd.DataFrame]:
    for k in range(0, values.size, most):
        at = np.unravel_index(np.arange(k, min(k + most, values.size)), values.shape)
        yield pd.DataFrame({**{n: (i + b).astype("int32") for n, i, b in zip(names, at, first, strict=True)}, "v": values[at].astype(float)})


def _runs(spark: SparkSession, path: str, a: Array, axes: list[str], columns: list[str], schema: str, empty: np.generic) -> DataFrame:
    """An array without chunks, cut into runs of cells wherever they end."""
    width = a.kind.itemsize
    step = max(1, RUN // width)

    def run(it):
        source = opened(path)
        for p in it:
            for begin in p["id"].tolist():
                n = min(step, a.size - begin)
                if a.layout == "compact":
                    values = np.frombuffer(a.raw, a.kind, n, begin * width)
                elif a.at is None:
                    values = np.full(n, empty)
                else:
                    values = np.frombuffer(source(a.base + a.at + begin * width, n * width), a.kind)
                for k in range(0, n, 1 << 18):
                    piece = values[k : k + (1 << 18)]
                    at = np.unravel_index(np.arange(begin + k, begin + k + len(piece)), a.shape)
                    yield pd.DataFrame({**{c: i.astype("int32") for c, i in zip(axes, at, strict=True)}, "v": piece.astype(float)})[columns]

    count = -(-a.size // step)
    return spark.range(0, a.size, step).repartition(max(1, min(count, 10_000)), "id").mapInPandas(run, schema)


def read_movie(spark: SparkSession, path: str, names: list[str], matlab: bool = False) -> DataFrame:
    """(names..., v) of the file's largest array, whose axes are ``names`` in order; MATLAB stores axes the other way round."""
    read = opened(path)
    a = largest(read, matlab)
    if len(a.shape) != len(names):
        raise ValueError(f"a movie has {len(names)} axes, this file's largest array has {len(a.shape)}")
    axes, columns = names[::-1] if matlab else names, [*names, "v"]
    schema = ", ".join(f"{n} int" for n in names) + ", v double"
    empty = np.frombuffer(a.fill, a.kind)[0] if len(a.fill) == a.kind.itemsize else a.kind.type(0)
    if a.layout in ("contiguous", "compact"):
        return _runs(spark, path, a, axes, columns, schema, empty)
    grid = a.grid
    table = chunk_table(spark, path, a, read).repartition(max(1, min(math.prod(grid), 10_000)), "id")

    def chunks(it):
        source = opened(path)
        for p in it:
            for key, at, size, mask in p[["id", "at", "size", "mask"]].itertuples(index=False):
                first = [int(k) * c for k, c in zip(np.unravel_index(int(key), grid), a.chunk, strict=True)]
                inside = tuple(slice(0, min(c, n - b)) for c, n, b in zip(a.chunk, a.shape, first, strict=True))
                values = np.full(a.chunk, empty) if pd.isna(at) else decode(source(a.base + int(at), int(size)), a, int(mask))
                for q in _long(values[inside], first, axes):
                    yield q[columns]

    return table.mapInPandas(chunks, schema)
