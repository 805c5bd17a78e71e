"""Vectorised text kernels over Arrow string columns.

Texts of a batch are laid end to end as one numpy array of code points, so that tokenising,
hashing and windowing are a handful of array passes instead of a Python loop per word.
Null texts read as empty. All hashes are 64-bit and the same in every process and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
CHUNK = 1 << 20  # code points that are worked on at once; a longer text is one chunk of its own

_rng = np.random.Generator(np.random.PCG64(20240611))
_CP = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if "b" not in _pow or len(_pow["b"]) <= n:
        size = max(n + 1, CHUNK + 4096)
        for key, base in (("b", _BASE), ("i", _INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["b"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit over the word."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def as_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.fill_null("") if col.null_count else col


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, start of each text and the end of the last)."""
    col = as_array(col)
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(data) or data.max() < 128:
        return data, off
    try:
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off, off[1:])]
        return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32), np.cumsum([0, *map(len, texts)])
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return cps, lead[off]


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most `limit` bytes together, or hold a single text."""
    col = as_array(col)
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b


def prefix(cps: np.ndarray) -> np.ndarray:
    """Prefix sums of the position-weighted random values, for `span_hash`."""
    low = _CP[(cps & 0xFFFF).astype(np.uint16)] if cps.dtype != np.uint8 else _CP[cps]
    if cps.dtype != np.uint8 and len(cps) and cps.max() > 0xFFFF:
        low = low + cps.astype(np.uint64) * U64(0xA24BAED4963EE407) * (cps > 0xFFFF)
    b, _ = _powers(len(cps))
    out = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(low * b[: len(cps)], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end): equal spans hash alike wherever they stand."""
    _, inv = _powers(len(p))
    return mix((p[end] - p[start]) * inv[start] + (end - start).astype(np.uint64))


def runs(kind: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of equal non-zero kind within a text."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    at = starts[:-1]
    new[at[at < n]] = True
    s = np.flatnonzero(new)
    e = np.append(s[1:], n)
    keep = kind[s] != 0
    return s[keep], e[keep]


def owner(pos: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row of each position."""
    return np.searchsorted(starts, pos, side="right") - 1


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w consecutive values (len(h) - w + 1 of them)."""
    if len(h) < w:
        return h[:0]
    m, span = h, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (w - span)], m[w - span :]) if span < w else m


def shingle(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent combination of each k consecutive hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for i in range(1, k):
        out = (out ^ (out >> U64(29))) * U64(0xBF58476D1CE4E5B9) + h[i : i + n]
    return mix(out)


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, byte position of each code point and the end, code points)."""
    col = as_array(col)
    cps, _ = code_points(col)
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    if cps.dtype == np.uint8:
        return data, np.arange(len(data) + 1), cps
    return data, np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)), cps


def _fold_table() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        if len(low) == 1 and ("a" <= low <= "z" or "0" <= low <= "9"):
            out[c] = ord(low)
    return out


_tables: dict[str, np.ndarray] = {}


def ascii_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a-z and 0-9 in the lower-cased texts: (folded characters, starts, ends, hashes, first word of each text and the end)."""
    if "fold" not in _tables:
        _tables["fold"] = _fold_table()
    cps, starts = code_points(col)
    if cps.dtype != np.uint8 and (cps == 0x130).any():  # its lower case is two characters
        cps, starts = code_points(pa.array([t.lower() for t in as_array(col).to_pylist()], pa.large_string()))
    if cps.dtype == np.uint8:
        low = _tables["fold"][cps]
    else:
        low = np.where(cps < 1 << 16, _tables["fold"][np.minimum(cps, 0xFFFF)], 0)
    s, e = runs((low > 0).astype(np.uint8), starts)
    h = span_hash(prefix(low), s, e)
    return low, s, e, h, np.searchsorted(s, starts)


def _letter_table() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint16)
    for c in range(1 << 16):
        ch = chr(c)
        if not 0xD800 <= c < 0xE000 and ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def lower(cps: np.ndarray) -> np.ndarray:
    """Lower-cased letters and digits of all scripts, 0 elsewhere (and beyond the first 65,536 code points)."""
    if "lower" not in _tables:
        _tables["lower"] = _letter_table()
    if cps.dtype == np.uint8:
        return _tables["lower"][cps]
    return np.where(cps < 1 << 16, _tables["lower"][np.minimum(cps, 0xFFFF)], 0).astype(np.uint16)


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits of all scripts, as `ascii_words`; a character of a script without spaces is a word of its own."""
    cps, starts = code_points(col)
    low = lower(cps)
    group = (low > 0).astype(np.int8)
    if len(low) and low.max() >= 0x2E80:
        group = np.where(low >= 0x2E80, 2 + (np.arange(len(low)) & 1), group)
    s, e = runs(group, starts)
    return low, s, e, span_hash(prefix(low), s, e), np.searchsorted(s, starts)
