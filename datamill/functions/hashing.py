"""Seeded choices and keys from hashes: the same row always gets the same draw."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw(key: Column | str, salt: str) -> Column:
    """A number in [0, 1) fixed by ``key`` and ``salt``; stands in for a random draw."""
    digest = F.md5(F.concat(_col(key).cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def drawn_from(key: Column | str, salt: str, least: float) -> Column:
    """Whether :func:`draw` is at least ``least``, read off the digest without making a number of it."""
    digest, bound = F.md5(F.concat(_col(key).cast("string"), F.lit(f":{salt}"))), max(0, math.ceil(least * 2**32))
    # A letter after f is above all digests.
    return digest >= F.lit(f"{bound:08x}" if bound < 2**32 else "g")


def pick(key: Column | str, salt: str, n: int) -> Column:
    """An integer in [0, n) fixed by ``key`` and ``salt``."""
    return F.floor(draw(key, salt) * F.lit(float(n))).cast("int")


def text_key(text: Column | str) -> Column:
    """Key of a text in the embedding cache. Long enough that two texts never share one."""
    return F.sha2(_col(text), 256)


def _row_number60(*cols: Column | str) -> Column:
    joined = F.concat_ws("\x1f", *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("decimal(20,0)")


def fingerprint(*cols: Column | str) -> Column:
    """Aggregate: a 60-bit hex fingerprint of a table that does not depend on row order.

    Per-row digests are added, so Spark combines them inside each map task and duplicates count.
    """
    total = F.sum(_row_number60(*cols)).cast("decimal(38,0)")
    low = F.pmod(total, F.lit(2**60).cast("decimal(38,0)")).cast("bigint")
    return F.lpad(F.lower(F.hex(F.coalesce(low, F.lit(0)))), 15, "0")


def hash_texts(texts: pa.BinaryArray) -> np.ndarray:
    """Spark's ``xxhash64`` of texts without nulls, given as their bytes."""
    one, two, three, four, five = (np.uint64(x) for x in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    if not len(texts):
        return np.empty(0, np.int64)
    begin = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    begin, sizes = begin[:-1], np.diff(begin)
    data = np.concatenate([np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    # Numbers of eight and four bytes that begin at any byte.
    longs = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    ints = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        seed, left, at = np.uint64(42), sizes.copy(), begin.copy()
        out = np.full(len(sizes), seed + five)
        big = np.flatnonzero(sizes >= 32)
        if len(big):
            big = big[np.argsort(-sizes[big], kind="stable")]
            lanes = [np.full(len(big), x) for x in (seed + one + two, seed + two, seed, seed - one)]
            rounds = sizes[big] // 32
            for i in range(rounds[0]):
                m = np.count_nonzero(rounds > i)
                for k, lane in enumerate(lanes):
                    lane[:m] = turn(lane[:m] + longs[at[big[:m]] + 32 * i + 8 * k] * two, 31) * one
            merged = turn(lanes[0], 1) + turn(lanes[1], 7) + turn(lanes[2], 12) + turn(lanes[3], 18)
            for lane in lanes:
                merged = (merged ^ (turn(lane * two, 31) * one)) * one + four
            out[big] = merged
            at[big] += rounds * 32
            left[big] -= rounds * 32
        out += sizes.astype(np.uint64)
        for _ in range(3):
            some = np.flatnonzero(left >= 8)
            out[some] = turn(out[some] ^ (turn(longs[at[some]] * two, 31) * one), 27) * one + four
            at[some] += 8
            left[some] -= 8
        some = np.flatnonzero(left >= 4)
        out[some] = turn(out[some] ^ (ints[at[some]].astype(np.uint64) * one), 23) * two + three
        at[some] += 4
        left[some] -= 4
        for _ in range(3):
            some = np.flatnonzero(left > 0)
            out[some] = turn(out[some] ^ (data[at[some]].astype(np.uint64) * five), 11) * one
            at[some] += 1
            left[some] -= 1
        out = (out ^ (out >> np.uint64(33))) * two
        out = (out ^ (out >> np.uint64(29))) * three
        return (out ^ (out >> np.uint64(32))).view(np.int64)
