"""Movie files without third-party readers: NPY, baseline TIFF and FITS, as bytes -> numpy and back."""

from __future__ import annotations

import ast
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 2880
# FITS sample types that can be read and written.
BITPIX = {-32: ">f4", -64: ">f8", 8: "u1", 16: ">i2", 32: ">i4", 64: ">i8"}


def npy_header(raw: bytes) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """(dtype, Fortran order, shape, offset of the data)."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    n, at = (struct.unpack("<H", raw[8:10])[0], 10) if raw[6] == 1 else (struct.unpack("<I", raw[8:12])[0], 12)
    h = ast.literal_eval(raw[at : at + n].decode("latin1"))
    return np.dtype(h["descr"]), h["fortran_order"], tuple(h["shape"]), at + n


def read_npy(raw: bytes) -> np.ndarray:
    kind, fortran, shape, at = npy_header(raw)
    if kind.hasobject:
        raise ValueError("NPY files of objects aren't read")
    return np.frombuffer(raw, kind, int(np.prod(shape)), at).reshape(shape, order="F" if fortran else "C")


def read_tiff(raw: bytes) -> np.ndarray:
    """Pages x rows x columns of an uncompressed, single-channel, stripped TIFF; a file of one page has one frame."""
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if end is None or struct.unpack(end + "H", raw[2:4])[0] != 42:
        raise ValueError("not a baseline TIFF file")
    size = {1: "B", 3: "H", 4: "I"}
    pages, at = [], struct.unpack(end + "I", raw[4:8])[0]
    while at:
        n = struct.unpack(end + "H", raw[at : at + 2])[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack(end + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
            if kind in size:
                width = struct.calcsize(size[kind]) * count
                where = at + 10 + 12 * k if width <= 4 else struct.unpack(end + "I", raw[at + 10 + 12 * k : at + 14 + 12 * k])[0]
                tags[tag] = struct.unpack(f"{end}{count}{size[kind]}", raw[where : where + width])
        if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
            raise ValueError("compressed or multi-channel TIFF files aren't read")
        w, h, bits, fmt = tags[256][0], tags[257][0], tags.get(258, (8,))[0], tags.get(339, (1,))[0]
        kind = np.dtype({1: "u", 2: "i", 3: "f"}[fmt] + str(bits // 8)).newbyteorder(end)
        data = b"".join(raw[o : o + c] for o, c in zip(tags[273], tags[279], strict=True))
        pages.append(np.frombuffer(data, kind, w * h).reshape(h, w))
        at = struct.unpack(end + "I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return np.stack(pages)


def write_tiff(frames: np.ndarray) -> bytes:
    """Little-endian pages of one strip each."""
    frames = np.atleast_3d(frames) if frames.ndim == 3 else frames[None]
    kind = frames.dtype.newbyteorder("<")
    fmt = {"u": 1, "i": 2, "f": 3}[kind.kind]
    out, at = bytearray(b"II" + struct.pack("<HI", 42, 8)), 8
    for k, f in enumerate(frames):
        data = f.astype(kind).tobytes()
        start = at + 2 + 12 * 10 + 4
        tags = [(256, 4, f.shape[1]), (257, 4, f.shape[0]), (258, 3, kind.itemsize * 8), (259, 3, 1), (262, 3, 1), (273, 4, start), (277, 3, 1), (278, 4, f.shape[0]), (279, 4, len(data)), (339, 3, fmt)]
        at = start + len(data) + len(data) % 2
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, c, 1) + (struct.pack("<HH", v, 0) if c == 3 else struct.pack("<I", v)) for t, c, v in tags)
        out += struct.pack("<I", at if k + 1 < len(frames) else 0) + data + b"\0" * (len(data) % 2)
    return bytes(out)


def fits_header(raw: bytes) -> tuple[np.dtype, tuple[int, ...], int, dict]:
    cards, at = {}, 0
    while True:
        block = raw[at : at + BLOCK].decode("ascii", "replace")
        at += BLOCK
        if len(block) < BLOCK:
            raise ValueError("not a FITS file")
        for k in range(0, BLOCK, 80):
            card = block[k : k + 80]
            if card.startswith("END") and not card[3:].strip():
                shape = tuple(int(cards[f"NAXIS{i}"]) for i in range(int(cards["NAXIS"]), 0, -1))
                if int(cards["BITPIX"]) not in BITPIX:
                    raise ValueError(f"FITS samples of type {cards['BITPIX']} aren't read")
                return np.dtype(BITPIX[int(cards["BITPIX"])]), shape, at, cards
            if card[8:10] == "= ":
                cards[card[:8].strip()] = card[10:].split("/")[0].strip()


def read_fits(raw: bytes, dims: int | None = None) -> np.ndarray:
    """The primary array in native byte order; ``dims`` makes another rank an error."""
    kind, shape, at, cards = fits_header(raw)
    if dims is not None and len(shape) != dims:
        raise ValueError(f"a FITS array of {dims} axes was expected, this one has {len(shape)}")
    a = np.frombuffer(raw, kind, int(np.prod(shape)), at).reshape(shape)
    zero, scale = float(cards.get("BZERO", 0)), float(cards.get("BSCALE", 1))
    a = a.astype(kind.newbyteorder("="))
    return a * scale + zero if zero or scale != 1 else a


def write_fits(a: np.ndarray) -> bytes:
    code = {np.dtype(v).newbyteorder("="): k for k, v in BITPIX.items()}.get(a.dtype.newbyteorder("="))
    if code is None:
        raise ValueError(f"FITS can't hold {a.dtype}")
    cards = ["SIMPLE  =                    T", f"BITPIX  = {code:>20}", f"NAXIS   = {a.ndim:>20}", *[f"NAXIS{k + 1:<3}= {n:>20}" for k, n in enumerate(a.shape[::-1])], "END"]
    head = "".join(c.ljust(80) for c in cards).encode()
    data = a.astype(BITPIX[code]).tobytes()
    pad = lambda b, c: b + c * (-len(b) % BLOCK)
    return pad(head, b" ") + pad(data, b"\0")


# MAT 5 sample types, and the array classes that hold numbers.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
MAT_MATRIX, MAT_COMPRESSED, MAT_COMPLEX = 14, 15, 0x800


def _mat_elements(raw: bytes, end: str, padded: bool) -> Iterator[tuple[int, bytes]]:
    """(type, data) of the elements that follow each other in ``raw``; short ones hold both in eight bytes."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(end + "II", raw, at)
        if kind >> 16:
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, raw[at + 8 : at + 8 + size]
            at += 8 + size + (-size % 8 if padded and kind != MAT_COMPRESSED else 0)


def read_mat(raw: bytes) -> dict[str, np.ndarray]:
    """The real numeric arrays of a MAT 5 file, by name; compressed ones too. Cells, structures, text, sparse and complex arrays are passed over."""
    if raw[:8] == b"\x89HDF\r\n\x1a\n" or b"MATLAB 7.3" in raw[:128]:
        raise ValueError("MAT 7.3 files are read by their path, one at a time (sources.hdf5)")
    end = {b"IM": "<", b"MI": ">"}.get(raw[126:128])
    if end is None:
        raise ValueError("not a MAT 5 file")
    out = {}
    for kind, data in _mat_elements(raw[128:], end, True):
        if kind == MAT_COMPRESSED:
            kind, data = next(_mat_elements(zlib.decompress(data), end, False))
        if kind != MAT_MATRIX:
            continue
        parts = list(itertools.islice(_mat_elements(data, end, True), 4))
        flags = struct.unpack_from(end + "I", parts[0][1])[0]
        if flags & 0xFF not in MAT_CLASSES or flags & MAT_COMPLEX or len(parts) < 4:
            continue
        shape = np.frombuffer(parts[1][1], end + "i4")
        values = np.frombuffer(parts[3][1], end + MAT_TYPES[parts[3][0]]).astype(MAT_CLASSES[flags & 0xFF])
        out[parts[2][1].decode("latin1")] = values.reshape(shape, order="F")
    return out


def largest_variable(variables: dict[str, np.ndarray]) -> np.ndarray:
    """Of a file of several arrays, that with the most elements; names with a leading ``__`` or ``#`` don't count."""
    own = {k: v for k, v in variables.items() if not k.startswith(("__", "#"))}
    if not own:
        raise ValueError("the file holds no array")
    return max(own.values(), key=np.size)
