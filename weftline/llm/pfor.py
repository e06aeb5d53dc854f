"""Patched frame-of-reference files of token ids.

A file is a row of sections, and a section holds whole documents, one after the other:

    magic "WFPFOR01" | n_docs u32 | n_ids u64 | block_len u32 | n_blocks u32 | payload bytes u64
    has_id u8[n_docs] | doc_id i64[n_docs] | doc_len u32[n_docs]
    block index: start u64[n_blocks] (in the payload), minimum u32[n_blocks], width u8[n_blocks], n_exceptions u16[n_blocks]
    payload: for each block the low `width` bits of (id - minimum), most significant bit first, then its exceptions:
             positions u16[], values (id - minimum) u32[]
    crc32 u32 of all that goes before

All numbers are little-endian. The width of a block is the bit length at one of a few percentiles of its values,
whichever makes the block smallest; values that don't fit are exceptions.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, BLOCK, HEAD = b"WFPFOR01", 512, struct.Struct("<8sIQIIQ")
PERCENTILES = (50, 75, 90, 95, 98, 100)


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def _widths(lengths: np.ndarray) -> np.ndarray:
    """The cheapest of the percentile widths for each block."""
    n, size = lengths.shape
    ordered = np.sort(lengths, axis=1)
    widths = np.stack([ordered[:, min(size - 1, -(-size * p // 100) - 1)] for p in PERCENTILES], axis=1)
    outside = np.stack([(lengths > widths[:, [k]]).sum(1) for k in range(len(PERCENTILES))], axis=1)
    best = np.argmin(widths * size / 8 + outside * 6, axis=1)
    return widths[np.arange(n), best]


def _pack(low: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) values of `width` bits each to (n, bytes)."""
    kind, bits = (">u2", 16) if width <= 16 else (">u4", 32)
    spread = np.unpackbits(low.astype(kind).view(np.uint8).reshape(-1, bits // 8), axis=1)[:, bits - width :]
    return np.packbits(spread.reshape(len(low), -1), axis=1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    kind, bits = (">u2", 16) if width <= 16 else (">u4", 32)
    spread = np.zeros((len(packed) * BLOCK, bits), np.uint8)
    spread[:, bits - width :] = np.unpackbits(packed, axis=1).reshape(-1, width)
    return np.packbits(spread, axis=1).view(kind).reshape(-1, BLOCK).astype(np.uint32)


def encode_section(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, step: int = 2048) -> bytes:
    n_blocks = -(-len(ids) // BLOCK)
    starts, minimums = np.zeros(n_blocks, "<u8"), np.zeros(n_blocks, "<u4")
    widths, n_exceptions = np.zeros(n_blocks, np.uint8), np.zeros(n_blocks, "<u2")
    payload, at = [], 0
    for a in range(0, n_blocks, step):
        part = ids[a * BLOCK : (a + step) * BLOCK].astype(np.uint32)
        if short := -len(part) % BLOCK:
            part = np.concatenate([part, np.full(short, part[-1], np.uint32)])
        part = part.reshape(-1, BLOCK)
        least = part.min(axis=1)
        rest = part - least[:, None]
        lengths_of = _bit_length(rest)
        width = _widths(lengths_of)
        packed: list[bytes] = [b""] * len(part)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                for r, x in zip(rows, _pack(rest[rows] & np.uint32((1 << int(w)) - 1), int(w))):
                    packed[r] = x.tobytes()
        row, position = np.nonzero(lengths_of > width[:, None])
        values, cuts = rest[row, position], np.searchsorted(row, np.arange(len(part) + 1))
        for r in range(len(part)):
            b = a + r
            starts[b], minimums[b], widths[b], n_exceptions[b] = at, least[r], width[r], cuts[r + 1] - cuts[r]
            span = slice(cuts[r], cuts[r + 1])
            block = packed[r] + position[span].astype("<u2").tobytes() + values[span].astype("<u4").tobytes()
            payload.append(block)
            at += len(block)
    has = np.array([d is not None for d in doc_ids], np.uint8)
    body = [HEAD.pack(MAGIC, len(doc_ids), len(ids), BLOCK, n_blocks, at), has.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(lengths).astype("<u4").tobytes(), starts.tobytes(), minimums.tobytes(), widths.tobytes(), n_exceptions.tobytes(), *payload]
    whole = b"".join(body)
    return whole + struct.pack("<I", zlib.crc32(whole))


def decode_section(data: memoryview, step: int = 2048) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths, ids, as encode_section() got them. Raises ValueError where the section isn't whole."""
    magic, n_docs, n_ids, block_len, n_blocks, size = HEAD.unpack_from(data)
    if magic != MAGIC or block_len != BLOCK or zlib.crc32(data[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise ValueError("not a whole section of token ids")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    has, doc_ids, lengths = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs)
    starts, minimums, widths, n_exceptions = take("<u8", n_blocks), take("<u4", n_blocks), take("u1", n_blocks), take("<u2", n_blocks)
    payload = np.frombuffer(data, np.uint8, size, at)
    out = np.zeros((n_blocks, BLOCK), np.uint32)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        for a in range(0, len(rows) if w else 0, step):
            some = rows[a : a + step]
            out[some] = _unpack(payload[starts[some].astype(np.int64)[:, None] + np.arange(BLOCK * int(w) // 8)], int(w))
    for b in np.flatnonzero(n_exceptions):
        k, p = int(n_exceptions[b]), int(starts[b]) + BLOCK * int(widths[b]) // 8
        where = payload[p : p + 2 * k].view("<u2")
        out[b, where] = payload[p + 2 * k : p + 6 * k].view("<u4")
    out += minimums[:, None]
    return [int(d) if h else None for h, d in zip(has, doc_ids)], lengths, out.reshape(-1)[:n_ids]


def decode_file(data: bytes):
    """The sections of a file, each decoded as it is asked for."""
    view, at = memoryview(data), 0
    while at < len(view):
        if len(view) - at < HEAD.size:
            raise ValueError("not a whole section of token ids")
        _, n_docs, _, _, n_blocks, size = HEAD.unpack_from(view, at)
        stop = at + HEAD.size + 13 * n_docs + 15 * n_blocks + size + 4
        if stop > len(view):
            raise ValueError("not a whole section of token ids")
        yield decode_section(view[at:stop])
        at = stop
