"""Words of many texts at once, by array operations over their bytes.

A text is first brought to one form of writing (``plain``); the words of a batch of texts are
then found, numbered and classed without a Python object per word.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
        "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l",
    }
)
_BLOCK_TAG = re.compile(r"</?(?:p|br|hr|li|ul|ol|div|td|tr|th|table|h[1-6]|section|article|blockquote|pre)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_BROKEN = re.compile(r"(?<=\w)[-‐‑][ \t]*\r?\n[ \t>|*#]*(?=\w)")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_MARKS = re.compile(r"[̀-ͯ]+")
_OTHER = re.compile(r"[^\w\x00-\x7f]+")


def plain(text: str) -> str:
    """One form of writing: no markup, no invisible characters, no breaks inside words, lower case, base letters."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "&" in text and ";" in text:
        text = html.unescape(text)
    odd = not text.isascii()
    if odd:
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "-\n" in text or "- \n" in text or "-\r" in text or odd:
        text = _BROKEN.sub("", text)
    if not odd:
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold()).translate(LOOKALIKES)
    return _OTHER.sub(" ", _MARKS.sub("", text))


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_rng = np.random.default_rng(20190101)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _BACK)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of a batch of texts, in order: the text each is in, its bytes' range in ``data``, and a 64-bit number for its spelling."""

    data: np.ndarray
    bounds: np.ndarray  # first byte of each text, and the end
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number per byte range that depends on its bytes only."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def words(texts: list[str]) -> Words:
    """Words (runs of letters and digits) of texts that are already in their form of writing."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    bounds = np.cumsum([0, *[len(p) + 1 for p in parts]])
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    return Words(data, bounds, np.searchsorted(bounds, start, side="right") - 1, start, end, codes(data, start, end))


def written_words(w: Words) -> np.ndarray:
    """Number of the word as written (between blanks) that each token belongs to; several tokens may share one."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    blank = np.concatenate([[0], np.cumsum((w.data == 32) | (w.data == 10) | (w.data == 9) | (w.data == 13))])
    return np.cumsum(np.r_[True, (blank[w.start[1:]] > blank[w.end[:-1]]) | (w.text[1:] != w.text[:-1])])


def chunks(ids: list, texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Whole texts in groups of about ``limit`` characters; a NULL text is empty."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield ids[a : i + 1], [x or "" for x in texts[a : i + 1]]
            a, size = i + 1, 0
    if a < len(texts):
        yield ids[a:], [x or "" for x in texts[a:]]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch[name].to_pylist()
