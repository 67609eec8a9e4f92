"""DuckDB expressions over bytes, for the oracles."""

from __future__ import annotations


def byte_list(blob: str) -> str:
    """The bytes of a blob as a list of integers."""
    return f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: ('0x' || x)::UBIGINT)"


#: One row, one list: the 256 remainders of the reflected CRC-32 polynomial.
CRC_TABLE = """(SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
  lambda a, z: xor(a >> 1, (a & 1) * 3988292384::UBIGINT))) AS crc_table)"""


def crc32(bytes_: str) -> str:
    """Unsigned CRC-32 of a list of bytes, beside CRC_TABLE."""
    folded = f"list_reduce(list_prepend(4294967295::UBIGINT, {bytes_}), lambda c, v: xor(c >> 8, crc_table[(xor(c & 255, v) + 1)::BIGINT]))"
    return f"xor({folded}, 4294967295::UBIGINT)::BIGINT"


def little_endian(n: str) -> str:
    """Hex digits of an unsigned 32-bit number, lowest byte first."""
    h = f"printf('%08X', {n})"
    return f"(substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))"
