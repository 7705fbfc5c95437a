"""Seeded random columns. Counter-based fills do not depend on how rows are dealt out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import fail

# Multipliers and key increments of Philox 4x32 (Salmon et al. 2011), constants of splitmix64, and the words with
# which the counter's upper half is set apart.
PHILOX_MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
PHILOX_INCREMENTS = (0x9E3779B9, 0xBB67AE85)
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
COUNTER_WORDS = (0xC0FFEE00, 0x9E3779B9)

_LOW, _WORD = (1 << 32) - 1, (1 << 64) - 1


def rng_seed(seed: int) -> int:
    """The seed, if it is an int of 64 bits without sign."""
    if isinstance(seed, bool) or not isinstance(seed, int) or not 0 <= seed <= _WORD:
        raise fail("rng_seed", f"seed is {seed!r}.", "use an int from 0 to 2**64 - 1.")
    return seed


def _key(seed: int, stream: int) -> tuple[int, int]:
    step, m1, m2 = SPLITMIX
    z = (seed + 2 * step + stream * m1) & _WORD
    z = ((z ^ z >> 30) * m1) & _WORD
    z = ((z ^ z >> 27) * m2) & _WORD
    z ^= z >> 31
    return z & _LOW, z >> 32


def philox(counters: np.ndarray, seed: int, stream: int = 0) -> np.ndarray:
    """Four 32-bit words for each 64-bit counter, after ten rounds; products of 32-bit words are taken in 64 bits."""
    u = np.uint64
    low, half = u(_LOW), u(32)
    c = counters.astype(u)
    x = [c & low, c >> half, np.full_like(c, (stream & _LOW) ^ COUNTER_WORDS[0]), np.full_like(c, (stream >> 32) ^ COUNTER_WORDS[1])]
    k = list(_key(seed, stream))
    for _ in range(10):
        left, right = (x[2 * i] * u(PHILOX_MULTIPLIERS[i]) for i in (0, 1))
        x = [(right >> half) ^ x[1] ^ u(k[0]), right & low, (left >> half) ^ x[3] ^ u(k[1]), left & low]
        k = [(a + b) & _LOW for a, b in zip(k, PHILOX_INCREMENTS)]
    return np.stack(x)


def _filled(spark: SparkSession, n: int, kind: str, values, column: str) -> DataFrame:
    arrow = pa.int32() if kind == "int" else pa.float64()

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(values(np.asarray(ids)), arrow)], names=["id", column])

    return spark.range(n).mapInArrow(run, f"id long, {column} {kind}")


def _checked(n: int, seed: int, stream: int, offset: int) -> None:
    rng_seed(seed)
    for name, v in (("n", n), ("stream", stream), ("offset", offset)):
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise fail("rng", f"{name} is {v!r}.", "use an int of 0 or more.")


def fill_i32(spark: SparkSession, n: int, seed: int, stream: int = 0, offset: int = 0, lo: int = 0, hi: int = 100, column: str = "value") -> DataFrame:
    """id, value: ``n`` ints from lo up to hi less 1; row i draws with counter offset + i."""
    _checked(n, seed, stream, offset)
    if not hi > lo:
        raise fail("rng_fill_i32", f"the range [{lo}, {hi}) is empty.", "use lo < hi.")

    def values(ids):
        words = philox(ids.astype(np.uint64) + np.uint64(offset), seed, stream)[0]
        return ((words * np.uint64(hi - lo) >> np.uint64(32)).astype(np.int64) + lo).astype(np.int32)

    return _filled(spark, n, "int", values, column)


def fill_f64(spark: SparkSession, n: int, seed: int, stream: int = 0, offset: int = 0, lo: float = 0.0, hi: float = 1.0, column: str = "value") -> DataFrame:
    """id, value: ``n`` doubles in [lo, hi), of 53 random bits each."""
    _checked(n, seed, stream, offset)
    if not (np.isfinite(lo) and np.isfinite(hi) and lo < hi):
        raise fail("rng_fill_f64", f"the range [{lo}, {hi}) is empty or not finite.", "use finite lo < hi.")

    def values(ids):
        a, b = philox(ids.astype(np.uint64) + np.uint64(offset), seed, stream)[:2]
        bits = (a >> np.uint64(5) << np.uint64(26)) | b >> np.uint64(6)
        return lo + bits.astype(np.float64) * 2.0**-53 * (hi - lo)

    return _filled(spark, n, "double", values, column)


def _one_task(spark: SparkSession, rows, kind: str) -> DataFrame:
    """Draws that depend on all before them: made in one task, in batches."""
    arrow = pa.int32() if kind == "int" else pa.float64()

    def run(batches):
        for _ in batches:
            pass
        drawn = rows()
        for at in range(0, len(drawn), 1 << 16):
            part = drawn[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)), pa.int64()), pa.array(part, arrow)], names=["id", "value"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, f"id long, value {kind}")


def _shuffled(n: int, k: int, seed: int, stream: int, offset: int) -> np.ndarray:
    draws = philox(np.arange(k, dtype=np.uint64) + np.uint64(offset), seed, stream)[0]
    at = np.arange(k) + (draws * (np.uint64(n) - np.arange(k, dtype=np.uint64)) >> np.uint64(32)).astype(np.int64)
    moved: dict[int, int] = {}  # what stands at a place, where that isn't its own number
    out = np.empty(k, np.int32)
    for i, j in enumerate(at.tolist()):
        out[i] = moved.get(j, j)
        moved[j] = moved.pop(i, i)
    return out


def sample(spark: SparkSession, n: int, k: int, seed: int, stream: int = 0, offset: int = 0) -> DataFrame:
    """id, value: ``k`` different ints below ``n``, in the order of a Fisher-Yates shuffle's draws."""
    _checked(n, seed, stream, offset)
    if not 0 <= k <= n or n > (1 << 31) - 1:
        raise fail("rng_sample", f"k is {k} of {n}.", "use k from 0 to n, and n below 2**31.")
    return _one_task(spark, lambda: _shuffled(n, k, seed, stream, offset), "int")


def permutation(spark: SparkSession, n: int, seed: int, stream: int = 0, offset: int = 0) -> DataFrame:
    """id, value: a permutation of the ints below ``n``."""
    return sample(spark, n, n, seed, stream, offset)


class _R:
    """R's default generator: a congruential start, the Mersenne twister, and rejection sampling by 16-bit pieces."""

    def __init__(self, seed: int):
        state, words = seed & _LOW, []
        for step in range(51 + 624):
            state = (69069 * state + 1) & _LOW
            if step >= 51:
                words.append(state)
        self.twister = np.random.MT19937()
        self.twister.state = {"bit_generator": "MT19937", "state": {"key": np.array(words, np.uint64), "pos": 624}}

    def unif(self) -> float:
        tiny = 2.3283064365386963e-10  # what a word is multiplied by
        x = int(self.twister.random_raw()) * tiny
        return 0.5 * tiny if x <= 0.0 else 1.0 - 0.5 * tiny if 1.0 - x <= 0.0 else x

    def index(self, n: int) -> int:
        bits = max(0, n - 1).bit_length()
        while True:
            v = 0
            for _ in range(bits // 16 + 1):
                v = (v << 16) + int(self.unif() * 65536.0)
            v &= (1 << bits) - 1
            if v < n:
                return v


def compat(spark: SparkSession, n: int, seed: int, kind: str = "runif", lo: float = 0.0, hi: float = 1.0, m: int | None = None) -> DataFrame:
    """id, value: what R draws after set.seed(seed): ``n`` uniform doubles, or ``m`` indexes below ``n``, counted from 0."""
    if kind == "runif":
        if not (np.isfinite(lo) and np.isfinite(hi) and lo < hi):
            raise fail("rng_compat", f"the range [{lo}, {hi}) is empty or not finite.", "use finite lo < hi.")

        def uniform():
            r = _R(seed)
            return np.array([lo + (hi - lo) * r.unif() for _ in range(n)])

        return _one_task(spark, uniform, "double")
    if kind != "sample" or n < 1:
        raise fail("rng_compat", f"kind is {kind!r}, n is {n}.", "use 'runif', or 'sample' with n of 1 or more.")

    def indexes():
        r = _R(seed)
        return np.array([r.index(n) for _ in range(n if m is None else m)], np.int32)

    return _one_task(spark, indexes, "int")
