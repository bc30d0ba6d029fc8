"""Vectorised hashes over byte buffers: every gram of a buffer, or every word of it, without a Python loop."""

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
SEGMENT = 1 << 18


def _powers(base, n):
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 2**64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


_tables = {}


def powers(n):
    """BASE**i and BASE**-i modulo 2**64 for i < n; the longest pair asked for is kept."""
    if n > _tables.get("size", 0):
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _tables.update(size=size, up=_powers(BASE, size), down=_powers(INVERSE, size))
    return _tables["up"][:n], _tables["down"][:n]


def mix(x):
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data):
    """s[i] is the polynomial hash of data[:i]; data has at most SEGMENT + a few thousand bytes a call."""
    up, _ = powers(len(data))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[data] * up, out=sums[1:])
    return sums


def span_hashes(data, starts, ends):
    """Hash of each data[start:end]: equal for equal bytes wherever they stand."""
    sums = prefix_sums(data)
    _, down = powers(len(data) + 1)
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))


def gram_hashes(data, size):
    """Hash of every gram of so many bytes, by start."""
    sums = prefix_sums(data)
    n = len(data) - size + 1
    _, down = powers(n)
    return mix((sums[size:] - sums[:n]) * down)


def string_hashes(data, starts, ends):
    """Hash of each range of a buffer, eight bytes a step through a mixing of all bits: no relation between strings shows in it,
    unlike in sums of powers, which hash a Thue-Morse word and its complement alike."""
    padded = np.append(data, np.zeros(8, dtype=np.uint8))
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1))
    live, done = np.flatnonzero(size > 0), 0
    while len(live):
        left = np.minimum(size[live] - done, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        out[live] = mix((out[live] ^ (words[starts[live] + done] & mask)) * np.uint64(0x9E3779B97F4A7C15))
        done += 8
        live = live[size[live] > done]
    return out


def parts(offsets, size=SEGMENT):
    """(first, end) of runs of whole texts of about so many bytes; a longer text is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end
        at = end


def string_column(column):
    """Bytes and row offsets of an Arrow string or binary column; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - (at[0] if len(at) else 0)
