"""Codecs over columns: gaps, variable-byte codes, skip steps; and their plain counterparts for files."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SkipConfig


def gaps(numbers: Column) -> Column:
    """The first number, then differences."""
    return F.transform(numbers, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(numbers, i - 1)))


def _summed(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: np.cumsum(x), na_action="ignore")


def ungaps(differences) -> Column:
    """Running sums (C2), linear in the list; folding an array in the JVM would copy it at every step."""
    return F.pandas_udf(_summed, "array<bigint>")(differences)


def vb_length(n: Column) -> Column:
    """Bytes of a number below 2**35."""
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5).cast("long")


def vb_hex(n: Column) -> Column:
    """Variable-byte code as hex digits: seven bits a byte, high first, 128 added to the last."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    high = [F.when(n >= 1 << (7 * k), byte(F.shiftright(n, 7 * k).bitwiseAND(127))).otherwise("") for k in (4, 3, 2, 1)]
    return F.concat(*high, byte(n.bitwiseAND(127) + 128))


def vb_hex_list(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, vb_hex), "")


def encode_vb(numbers: list[int]) -> bytes:
    out = bytearray()
    for n in numbers:
        code = [n % 128 + 128]
        while n >= 128:
            n //= 128
            code.append(n % 128)
        out += bytes(reversed(code))
    return bytes(out)


def decode_vb(data: bytes, count: int | None = None, at: int = 0) -> tuple[list[int], int]:
    """Numbers of a byte string, ``count`` at most, and the place after them (C4)."""
    out, n = [], 0
    while at < len(data) and (count is None or len(out) < count):
        byte = data[at]
        at += 1
        n = n * 128 + (byte & 127)
        if byte >= 128:
            out.append(n)
            n = 0
    return out, at


def _decoded(data: pd.Series) -> pd.Series:
    return data.map(lambda x: decode_vb(bytes(x))[0], na_action="ignore")


def vb_decode(data) -> Column:
    return F.pandas_udf(_decoded, "array<bigint>")(data)


def _cube_root(length: Column) -> Column:
    """The whole cube root, less one at the cubes of 4 and more.

    That is what a correctly rounded power with the double next below 1/3 gives, which steps are defined by: at the cube
    of c it is c (1 - 5.6e-17 ln c), which from c = 4 on is nearer to the double below c than to c. Platforms differ there.
    """
    near = F.round(F.cbrt(length)).cast("long")
    whole = near - F.when(near * near * near > length, 1).otherwise(0)
    return whole - F.when((whole >= 4) & (whole * whole * whole == length), 1).otherwise(0)


def skip_step(length: Column, config: SkipConfig) -> Column:
    """Documents between skip pointers for a list of ``length``."""
    by = {
        "sqrt": F.floor(F.sqrt(length)),
        "log": F.length(F.bin(length)) - 1,
        "linear": F.floor(length / config.linear_factor),
        "cbrt": _cube_root(length),
    }
    step = F.lit(config.step) if config.step is not None else by.get(config.strategy, by["sqrt"])
    return F.when(length < config.min_list_length, 1).otherwise(F.greatest(step, F.lit(1))).cast("long")


def skip_step_of(length: int, config: SkipConfig) -> int:
    """The same for a plain number."""
    if length < config.min_list_length:
        return 1
    if config.step is not None:
        return max(1, config.step)

    def cube_root() -> int:
        c = round(length ** (1 / 3))
        c -= c**3 > length
        return c - (c >= 4 and c**3 == length)

    step = {"log": lambda: length.bit_length() - 1, "linear": lambda: length // config.linear_factor, "cbrt": cube_root}.get(config.strategy, lambda: math.isqrt(length))()
    return max(1, step)
