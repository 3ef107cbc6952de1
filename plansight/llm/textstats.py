"""Counts of texts and of their lines, taken from the bytes of many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plansight.llm.common import _SPACE, mix64, span_hashes, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"


def _table(members: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_IS_SYMBOL, _IS_PIPE, _IS_BANG, _IS_DIGIT, _IS_STOP = (_table(x) for x in (SYMBOLS, b"|", b"!", range(48, 58), b".?:;\""))
_IS_UPPER, _IS_LOWER, _IS_LEAD, _CONTINUES = _table(range(65, 91)), _table(range(97, 123)), _table(range(0xC3, 0xF5)), _table(range(0x80, 0xC0))


@dataclass
class Lines:
    """The lines that hold a word: their text, and per line its counts."""

    owner: np.ndarray
    words: np.ndarray
    chars: np.ndarray
    symbols: np.ndarray
    pipes: np.ndarray
    bangs: np.ndarray
    upper: np.ndarray
    letters: np.ndarray
    digits: np.ndarray
    repeated: np.ndarray
    distinct: np.ndarray
    stopped: np.ndarray


@dataclass
class Texts:
    """Per text: words, code points in words, symbols, lines equal to an earlier one, words in repeated 3-word windows, distinct words."""

    words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    dup_lines: np.ndarray
    repeat_words: np.ndarray
    distinct: np.ndarray


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def measure(data: np.ndarray, bounds: np.ndarray) -> tuple[Texts, Lines]:
    """Counts for the texts that lie in ``data`` from each bound to the next."""
    count, n = len(bounds) - 1, len(data)
    hashes, owner, starts, ends = word_hashes(data, bounds)
    per_text = lambda of: np.bincount(of, minlength=count).astype(np.int64)
    text_of = np.repeat(np.arange(count), np.diff(bounds))

    # words that a repeated window of three holds; windows of different texts have different keys
    salt = mix64(np.arange(1, count + 1, dtype=np.uint64))
    covered = np.zeros(len(hashes), bool)
    windows, of = window_hashes(hashes, owner, 3)
    if len(windows):
        _, inverse, times = np.unique(windows ^ salt[of], return_inverse=True, return_counts=True)
        first = np.flatnonzero(owner[: len(owner) - 2] == owner[2:])[times[inverse] > 1]
        for k in range(3):
            covered[first + k] = True

    # lines: a text's first byte and every byte after a line feed begin one
    breaks = data == 10
    begins = np.zeros(n + 1, bool)
    begins[bounds[:-1]] = True
    begins[1:][breaks] = True
    line_starts = np.flatnonzero(begins[:n])
    line_of_byte = np.cumsum(begins[:n]) - 1
    line_of_word = line_of_byte[starts] if n else starts
    lines = len(line_starts)
    words_in = np.bincount(line_of_word, minlength=lines) if lines else np.zeros(0, np.int64)
    full = words_in > 0
    sums = lambda mask: (np.add.reduceat(mask.astype(np.int32), line_starts) if lines else np.zeros(0, np.int32))[full]
    line_owner = text_of[line_starts] if lines else np.zeros(0, np.int64)
    # a line's hash is over its bytes without the line feed
    line_ends = np.append(line_starts[1:], n)
    line_hash = span_hashes(data, line_starts, line_ends - breaks[line_ends - 1]) if lines else np.zeros(0, np.uint64)
    repeated = _again((line_hash ^ salt[line_owner])[full]) if lines else np.zeros(0, bool)

    latin_upper = np.zeros(n, bool)
    if n > 1:
        latin_upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper, lead = _IS_UPPER[data] | latin_upper, _IS_LEAD[data]
    new_word = ~_again(hashes ^ mix64(line_of_word.astype(np.uint64)))
    owner_full = line_owner[full]
    shape = Lines(
        owner=owner_full, words=words_in[full], chars=sums(~_CONTINUES[data] & ~_SPACE[data]), symbols=sums(_IS_SYMBOL[data]), pipes=sums(_IS_PIPE[data]),
        bangs=sums(_IS_BANG[data]), upper=sums(upper), letters=sums(_IS_UPPER[data] | _IS_LOWER[data] | lead), digits=sums(_IS_DIGIT[data]), repeated=repeated,
        distinct=(np.bincount(line_of_word[new_word], minlength=lines) if lines else words_in)[full], stopped=np.zeros(len(owner_full), bool),
    )
    if lines:
        last = np.zeros(lines, np.int64)
        last[line_of_word] = ends - 1  # words come in order, so the last one stays
        shape.stopped = _IS_STOP[data[last[full]]]
    new_in_text = ~_again(hashes ^ salt[owner])
    texts = Texts(
        words=per_text(owner), word_chars=per_text(text_of[~_CONTINUES[data] & ~_SPACE[data]]), symbols=per_text(text_of[_IS_SYMBOL[data]]),
        dup_lines=per_text(owner_full[repeated]), repeat_words=per_text(owner[covered]), distinct=per_text(owner[new_in_text]),
    )
    return texts, shape
