"""HDF5 and MAT 7.3 files put together byte by byte after the published format, then read as movies."""

import struct
import zlib

import numpy as np
import pytest

from lumiframe.operators import movie
from lumiframe.sources import hdf5, readers

NONE = (1 << 64) - 1


class File:
    """Appends blocks and keeps their addresses, which count from the end of a user block."""

    def __init__(self, user: int = 0):
        self.user, self.raw = user, bytearray()

    def add(self, block: bytes) -> int:
        self.raw += b"\0" * (-len(self.raw) % 8)
        self.raw += block
        return len(self.raw) - len(block)

    def save(self, path) -> str:
        path.write_bytes(b"MATLAB 7.3".ljust(self.user, b" ") + bytes(self.raw) if self.user else bytes(self.raw))
        return str(path)


def space(shape) -> bytes:
    return struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)


def kind_of(kind: np.dtype) -> bytes:
    bits = (1 if kind.byteorder == ">" else 0) | (8 if kind.kind == "i" else 0)
    return struct.pack("<BBBBI", 0x10 | (1 if kind.kind == "f" else 0), bits, 0, 0, kind.itemsize) + b"\0" * 12


def old_header(f: File, messages) -> int:
    """The last message goes to a continuation block."""
    pack = lambda k, m: struct.pack("<HHB3x", k, len(m), 0) + m
    padded = [(k, m + b"\0" * (-len(m) % 8)) for k, m in messages]
    rest = pack(*padded[-1])
    at = f.add(rest)
    body = b"".join(pack(k, m) for k, m in padded[:-1]) + pack(hdf5.CONTINUED, struct.pack("<QQ", at, len(rest)))
    return f.add(struct.pack("<BxHII4x", 1, len(padded) + 1, 1, len(body)) + body)


def packed(values: np.ndarray, filters) -> bytes:
    raw = values.tobytes()
    for k in filters:
        if k == hdf5.SHUFFLE:
            raw = np.frombuffer(raw, "u1").reshape(-1, values.itemsize).T.tobytes()
        elif k == hdf5.DEFLATE:
            raw = zlib.compress(raw)
        else:
            raw += b"\1\2\3\4"
    return raw


def blocks(a: np.ndarray, chunk):
    """(first cell, values) of every chunk, filled up at the edges."""
    for at in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunk)]):
        first = [i * c for i, c in zip(at, chunk)]
        part = a[tuple(slice(b, b + c) for b, c in zip(first, chunk))]
        full = np.full(chunk, 77, a.dtype)
        full[tuple(slice(0, n) for n in part.shape)] = part
        yield first, full


def tree(f: File, a: np.ndarray, chunk, filters=(), fan: int = 3, without=(), masked=()) -> int:
    key = lambda size, mask, first: struct.pack("<II", size, mask) + struct.pack(f"<{a.ndim + 1}Q", *first, 0)
    entries = []
    for k, (first, full) in enumerate(blocks(a, chunk)):
        if k not in without:
            raw = packed(full, () if k in masked else filters)
            entries.append((key(len(raw), (1 << len(filters)) - 1 if k in masked else 0, first), f.add(raw)))
    level = 0
    while True:
        up = []
        for k in range(0, len(entries), fan):
            own = entries[k : k + fan]
            body = b"".join(q + struct.pack("<Q", at) for q, at in own) + key(0, 0, a.shape)
            up.append((own[0][0], f.add(b"TREE" + struct.pack("<BBHQQ", 1, level, len(own), NONE, NONE) + body)))
        entries, level = up, level + 1
        if len(entries) == 1:
            return entries[0][1]


def pipeline(filters, width) -> bytes:
    out = struct.pack("<BB6x", 1, len(filters))
    for k in filters:
        out += struct.pack("<HHHH", k, 8, 0, 1) + b"filter\0\0" + struct.pack("<I4x", width if k == hdf5.SHUFFLE else 6)
    return out


def chunked(f: File, a: np.ndarray, chunk, filters=(), **how) -> int:
    at = tree(f, a, chunk, filters, **how)
    layout = struct.pack("<BBBQ", 3, 2, a.ndim + 1, at) + struct.pack(f"<{a.ndim + 1}I", *chunk, a.itemsize)
    fill = struct.pack("<BBBBI", 2, 2, 0, 1, a.itemsize) + np.array(9, a.dtype).tobytes()
    return old_header(f, [(hdf5.SPACE, space(a.shape)), (hdf5.TYPE, kind_of(a.dtype)), (hdf5.FILL, fill), *([(hdf5.FILTERS, pipeline(filters, a.itemsize))] if filters else []), (hdf5.LAYOUT, layout)])


def plain(f: File, a: np.ndarray, compact: bool = False) -> int:
    layout = struct.pack("<BBH", 3, 0, a.nbytes) + a.tobytes() if compact else struct.pack("<BBQQ", 3, 1, f.add(a.tobytes()), a.nbytes)
    return old_header(f, [(hdf5.SPACE, space(a.shape)), (hdf5.TYPE, kind_of(a.dtype)), (hdf5.LAYOUT, layout)])


def old_file(path, members, user: int = 0) -> str:
    """A file with the first superblock; ``members`` gives a function of the file for each name."""
    f = File(user)
    f.add(b"\0" * 96)
    where = {n: make(f) for n, make in sorted(members.items())}
    names, offsets = b"\0" * 8, {}
    for n in where:
        offsets[n] = len(names)
        names += n.encode() + b"\0" * (8 - len(n) % 8)
    data = f.add(names)
    heap = f.add(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NONE, data))
    entry = lambda n: struct.pack("<QQI4x16x", offsets[n], where[n], 0)
    half = len(where) // 2
    leaves = [f.add(b"SNOD" + struct.pack("<BxH", 1, len(part)) + b"".join(map(entry, part))) for part in (list(where)[:half], list(where)[half:])]
    node = f.add(b"TREE" + struct.pack("<BBHQQ", 0, 0, 2, NONE, NONE) + b"".join(struct.pack("<QQ", 0, x) for x in leaves) + struct.pack("<Q", 0))
    root = old_header(f, [(0, b"\0" * 8), (hdf5.SYMBOLS, struct.pack("<QQ", node, heap))])
    head = hdf5.SIGNATURE + struct.pack("<BBBBBBBxHHI", 0, 0, 0, 0, 0, 8, 8, 4, 16, 0) + struct.pack("<QQQQ", user, NONE, len(f.raw), NONE) + struct.pack("<QQI4x16x", 0, root, 0)
    f.raw[: len(head)] = head
    return f.save(path)


def new_header(messages) -> bytes:
    body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
    return b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"sum!"


def new_file(path, a: np.ndarray, chunk, index: int, filters=()) -> str:
    """A file with the third superblock, links in the header and the fourth layout."""
    f = File()
    f.add(b"\0" * 48)
    parts = [packed(full, filters) for _, full in blocks(a, chunk)]
    at = f.add(b"".join(parts))
    own = struct.pack("<QI", len(parts[0]), 0) if index == 1 and filters else b""
    layout = struct.pack("<BBBBB", 4, 2, 2 if own else 0, a.ndim + 1, 2) + struct.pack(f"<{a.ndim + 1}H", *chunk, a.itemsize) + bytes([index]) + own + struct.pack("<Q", at)
    flt = bytes([2, len(filters)]) + b"".join(struct.pack("<HHHI", k, 0, 1, a.itemsize if k == hdf5.SHUFFLE else 6) for k in filters)
    dims = struct.pack("<BBBB", 2, a.ndim, 0, 1) + struct.pack(f"<{a.ndim}Q", *a.shape)
    array = f.add(new_header([(hdf5.SPACE, dims), (hdf5.TYPE, kind_of(a.dtype)), *([(hdf5.FILTERS, flt)] if filters else []), (hdf5.LAYOUT, layout)]))
    link = lambda n, to: (hdf5.LINK, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", to))
    soft = (hdf5.LINK, struct.pack("<BBBB", 1, 8, 1, 4) + b"soft" + struct.pack("<H", 2) + b"/m")
    root = f.add(new_header([(hdf5.LINK_INFO, struct.pack("<BBQQ", 0, 0, NONE, NONE)), soft, link("m", array)]))
    f.raw[:48] = hdf5.SIGNATURE + struct.pack("<BBBB", 3, 8, 8, 0) + struct.pack("<QQQQ", 0, NONE, len(f.raw), root) + b"sum!"
    return f.save(path)


RNG = np.random.default_rng(2)
A = RNG.normal(size=(7, 9, 11))
FILTERS = {"none": (), "deflate": (hdf5.DEFLATE,), "shuffled": (hdf5.SHUFFLE, hdf5.DEFLATE, hdf5.CHECKSUM)}


@pytest.mark.parametrize("how", FILTERS)
def test_chunks_in_a_tree_of_several_levels(spark, tmp_path, how):
    path = old_file(tmp_path / "m.h5", {"a rate": lambda f: plain(f, np.array([30.0]), True), "movie": lambda f: chunked(f, A, (3, 4, 4), FILTERS[how])})
    df = readers.read_movie(spark, path)
    assert np.array_equal(movie.to_array(df), A) and df.count() == A.size
    assert df.rdd.getNumPartitions() > 8


@pytest.mark.parametrize("kind", ["<f4", ">f8", "<u2", ">i2", "<i4", "u1"])
def test_plain_arrays_of_every_kind(spark, tmp_path, monkeypatch, kind):
    a = (A * 100).astype(kind) if kind != "u1" else np.abs(A * 50).astype(kind)
    whole = old_file(tmp_path / "m.hdf5", {"z": lambda f: plain(f, a), "b": lambda f: plain(f, np.arange(3.0))})
    monkeypatch.setattr(hdf5, "RUN", 100)
    assert np.array_equal(movie.to_array(readers.read_movie(spark, whole)), a.astype(float))


def test_chunks_never_written_and_filters_left_out(spark, tmp_path):
    path = old_file(tmp_path / "m.h5", {"m": lambda f: chunked(f, A, (4, 5, 6), (hdf5.DEFLATE,), without={1, 4}, masked={0}), "n": lambda f: plain(f, A[0, 0])})
    want = A.copy()
    want[:4, :5, 6:], want[4:, :5, :6] = 9, 9
    assert np.array_equal(movie.to_array(readers.read_movie(spark, "file:" + path)), want)


@pytest.mark.parametrize(("index", "chunk", "filters"), [(1, (7, 9, 11), ()), (1, (8, 9, 12), (hdf5.SHUFFLE, hdf5.DEFLATE)), (2, (3, 4, 4), ())])
def test_new_files(spark, tmp_path, index, chunk, filters):
    assert np.array_equal(movie.to_array(readers.read_movie(spark, new_file(tmp_path / "m.h5", A, chunk, index, filters))), A)


def test_matlab_axes_and_what_is_left_out(spark, tmp_path):
    path = old_file(tmp_path / "m.mat", {"#refs#": lambda f: plain(f, np.zeros((9, 30, 30))), "m": lambda f: chunked(f, A.T.copy(), (4, 4, 4), (hdf5.DEFLATE,)), "s": lambda f: plain(f, np.arange(5.0))}, user=512)
    assert np.array_equal(movie.to_array(readers.read_movie(spark, path)), A)


def test_errors_say_why(spark, tmp_path):
    with pytest.raises(ValueError, match="fixed, extensible"):
        readers.read_movie(spark, new_file(tmp_path / "a.h5", A, (3, 4, 4), 3))
    with pytest.raises(ValueError, match="3 axes"):
        readers.read_movie(spark, old_file(tmp_path / "b.h5", {"p": lambda f: plain(f, A[0]), "q": lambda f: plain(f, A[0, 0])}))
    with pytest.raises(ValueError, match="filter 32000"):
        readers.read_movie(spark, old_file(tmp_path / "c.h5", {"m": lambda f: old_header(f, [(hdf5.SPACE, space(A.shape)), (hdf5.TYPE, kind_of(A.dtype)), (hdf5.FILTERS, pipeline((32000,), 8)), (hdf5.LAYOUT, struct.pack("<BBQQ", 3, 1, NONE, 0))])}))
    (tmp_path / "d.h5").write_bytes(b"no such thing" * 100)
    with pytest.raises(ValueError, match="not an HDF5 file"):
        readers.read_movie(spark, str(tmp_path / "d.h5"))
