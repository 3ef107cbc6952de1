"""Helpers shared by the operators: table reading, scratch tables, word and shingle hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansight.sources.scratch import Scratch

#: A word is a run of bytes other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; the ids' folds do not depend on their order."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % F.lit(parts)


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once a session, so that it need not be installed there."""
    context = spark.sparkContext
    if getattr(context, "_plansight_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="plansight-")) / "plansight.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._plansight_shipped = True


def trim() -> None:
    """Gives freed memory back to the system, as a Python worker stays for later tasks beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- hashing of words and shingles, over the bytes of many texts at once ---------------------

_MASK = (1 << 64) - 1
_JOIN = np.uint64(0xD1B54A32D192ED03)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_AS_IS = np.arange(256, dtype=np.uint64)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += 32


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end; the spans ascend and do not overlap.

    A hash is the sum of a mixed value for every byte and its place in the span, so it follows
    no polynomial that periodic or Thue-Morse texts would cancel in.
    """
    n = len(data)
    begin = np.zeros(n + 1, np.int64)
    begin[starts] = starts
    place = np.arange(n, dtype=np.int64) - np.maximum.accumulate(begin[:n]) if n else begin[:0]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64((place.astype(np.uint64) << np.uint64(8)) | (_LOWER if lower else _AS_IS)[data]), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) + (ends - starts).astype(np.uint64) * _JOIN)


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts that lie in ``data``, text i from bounds[i] to bounds[i+1].

    Returns the hashes, and each word's text, start and end. Equal words have equal hashes wherever they stand.
    """
    n = len(data)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return span_hashes(data, starts, ends, lower), np.searchsorted(bounds, starts, side="right") - 1, starts, ends


def window_hashes(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` neighbouring words within a text, and the text of each."""
    count = len(hashes) - size + 1
    if count <= 0:
        return hashes[:0], owner[:0]
    whole = owner[:count] == owner[size - 1 :]
    joined = np.zeros(count, np.uint64)
    for k in range(size):
        joined = joined * _JOIN + hashes[k : k + count]
    return mix64(joined[whole]), owner[:count][whole]


def packed(texts: Iterable[str | None], most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts as bytes, a few at a time: index of the first, the bytes and the bounds. Null is empty.

    Each pack holds one text or at most ``most`` bytes, which bounds the temporary arrays.
    """
    first, size, held = 0, 0, []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            yield first, *_pack(held)
            first, size, held = first + len(held), 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield first, *_pack(held)


def _pack(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(held) + 1, np.int64)
    np.cumsum([len(raw) for raw in held], out=bounds[1:])
    return np.frombuffer(b"".join(held), np.uint8), bounds


def shingle_sets(texts: Iterable[str | None], size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word shingles, A-Z taken as a-z.

    A text with fewer words is one shingle of all of them; a text without words has none.
    """
    for _, data, bounds in packed(texts):
        hashes, owner, _, _ = word_hashes(data, bounds, lower=True)
        counts = np.bincount(owner, minlength=len(bounds) - 1)
        shingles, of = window_hashes(hashes, owner, size)
        word_at = np.concatenate(([0], np.cumsum(counts)))
        shingle_at = np.searchsorted(of, np.arange(len(bounds)))
        for i, count in enumerate(counts):
            if count >= size:
                yield np.unique(shingles[shingle_at[i] : shingle_at[i + 1]])
            elif count:
                joined = 0
                for h in hashes[word_at[i] : word_at[i + 1]].tolist():
                    joined = (joined * int(_JOIN) + h) & _MASK
                yield mix64(np.array([joined ^ int(count)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
