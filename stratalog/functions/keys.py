"""Order-preserving keys and CRC-32C."""
from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, functions as F

#: The reflected CRC-32C (Castagnoli) polynomial.
CRC32C_POLY = 0x82F63B78


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (CRC32C_POLY if b & 1 else 0)
        out.append(b)
    return out


_TABLE = _crc_table()


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C of ``data``, continuing from ``crc``."""
    crc ^= 0xFFFFFFFF
    t = _TABLE
    for b in data:
        crc = t[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def crc32c_many(rows: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings at once: one vector step for each byte position, not one Python step per byte."""
    n = len(rows)
    if not n:
        return np.zeros(0, np.uint32)
    t = np.array(_TABLE, np.uint32)
    lens = np.fromiter(map(len, rows), np.int64, n)
    order = np.argsort(-lens, kind="stable")
    flat = np.frombuffer(b"".join(rows), np.uint8)
    starts = (np.cumsum(lens) - lens)[order]
    slens, crc = lens[order], np.full(n, 0xFFFFFFFF, np.uint32)
    live = n
    for at in range(int(slens[0])):
        while live and slens[live - 1] <= at:
            live -= 1
        c = crc[:live]
        crc[:live] = t[(c ^ flat[starts[:live] + at]) & 0xFF] ^ (c >> np.uint32(8))
    out = np.empty(n, np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def succ(prefix: bytes) -> bytes | None:
    """The least byte string above every string with this prefix; None where there is none."""
    p = prefix.rstrip(b"\xff")
    return p[:-1] + bytes([p[-1] + 1]) if p else None


def succ_text(prefix: str) -> str | None:
    """As succ(), for text keys, whose UTF-8 order is the order of their code points."""
    p = prefix.rstrip(chr(0x10FFFF))
    if not p:
        return None
    n = ord(p[-1]) + 1
    return p[:-1] + chr(0xE000 if 0xD800 <= n < 0xE000 else n)


def prefix_range(key: Column, prefix: bytes | str) -> Column:
    """A range condition, which a scan can push down, that holds for the keys with ``prefix``."""
    top = succ(prefix) if isinstance(prefix, bytes) else succ_text(prefix)
    low = key >= F.lit(prefix)
    return low if top is None else low & (key < F.lit(top))


def encode_int(v: int, width: int = 8) -> bytes:
    """Big-endian with the sign bit flipped: byte order is number order."""
    return (v + (1 << (8 * width - 1))).to_bytes(width, "big")


def decode_int(b: bytes) -> int:
    return int.from_bytes(b, "big") - (1 << (8 * len(b) - 1))


def int_key(c: Column, width: int = 8) -> Column:
    """encode_int() as a column expression."""
    digits = 2 * width
    flipped = c.cast("long").bitwiseXOR(F.lit(-(1 << 63))) if width == 8 else c.cast("long") + F.lit(1 << (8 * width - 1))
    return F.unhex(F.lpad(F.hex(flipped), digits, "0"))


def table_prefix(table_id: int) -> bytes:
    return struct.pack(">I", table_id)


def common_prefix(a: Column, b: Column, cap: int = 255) -> Column:
    """Length of the longest common prefix of two strings or binaries, up to ``cap``.

    Prefixes agree up to some length and differ beyond it, so the lengths at which they agree only need counting.
    """
    n = F.least(F.length(a), F.length(b), F.lit(cap))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.when(n > 0, F.size(same)).otherwise(0)
