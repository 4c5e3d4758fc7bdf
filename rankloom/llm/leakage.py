"""Evaluation texts inside a training corpus.

The corpus is read once and never shuffled.  Each chunk of documents that a task reads is a shard: its words
are brought to one form of writing, words that no test item uses become separators, runs
shorter than a phrase drop out (no phrase fits in), and the rest is put into an FM-index.
Every phrase of ``PHRASE`` words of every item is searched backward in it, the
occurrences are located and, per document and item, chained to running stretches that
tolerate single words changed, added or dropped.  Where stretches of several items lie on the same words of a document, the item
that has more of these words keeps them; test items share turns of phrase, and what is only such a turn in one is the wording of
another.  A document leaks an item if the stretches left hold enough of the item's words; overlapping stretches are merged to spans for removal.

The items are the stated query set.  The driver reads them in blocks of at most ITEM_BYTES of text (or one item), one block at a
time, and hands the blocks to the executors as files; a task indexes a shard once and goes through the blocks, of which it holds one
at a time.  So neither the driver nor a task holds all items (only their distinct words), and the corpus is read once however many there are.
"""

from __future__ import annotations

import os
import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import text as tx
from rankloom.llm.fmindex import FMIndex
from rankloom.session import served_folder

PHRASE = 3
SEEDS = 6  # 20 words in runs of at least PHRASE words hold no fewer phrases
SLACK = 8  # tokens that may lie between two runs of a stretch
HOLE = 2  # words in a row that may be changed, added or dropped within a stretch
COST = 2  # words found that a lost one takes back
DROP = 10
DENSITY = 0.75  # share of a stretch's words that are found
ITEM_BYTES = 4 << 20  # characters of text in a block; with its phrases about ten times as much in a task


def body(item: str) -> str:
    """The passage and question: all paragraphs but the first, or all if there is one."""
    parts = re.split(r"\n\s*\n", item.strip())
    return "\n\n".join(parts[1:] if len(parts) > 1 else parts)


class Items:
    """A block of test items: their words as symbols, their phrases, and where each phrase occurs in them."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = tx.words([tx.plain(t) for t in texts])
        self.ids = np.array(ids, np.int64)
        self.vocab, symbol = np.unique(w.code, return_inverse=True)
        symbol = symbol + 1
        self.symbol = symbol
        self.word = tx.written_words(w)
        ok = np.flatnonzero(w.text[PHRASE - 1 :] == w.text[: len(w.text) - PHRASE + 1]) if len(w.text) >= PHRASE else np.zeros(0, np.int64)
        grams = np.stack([symbol[ok + j] for j in range(PHRASE)], axis=1) if len(ok) else np.zeros((0, PHRASE), np.int64)
        self.phrases, which = np.unique(grams, axis=0, return_inverse=True) if len(ok) else (grams, np.zeros(0, np.int64))
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        self.at = ok[order]  # token positions, grouped by phrase
        self.item = w.text[self.at]
        self.first = np.searchsorted(which[order], np.arange(len(self.phrases) + 1))

    def renumber(self, vocab: np.ndarray) -> None:
        """Symbols by the words of all blocks instead of the block's own."""
        to = np.r_[0, np.searchsorted(vocab, self.vocab) + 1]
        self.symbol, self.phrases, self.vocab = to[self.symbol], to[self.phrases], vocab


def symbols(vocab: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Number of each word among ``vocab``, from 1; 0 where it is not there."""
    if not len(vocab):
        return np.zeros(len(code), np.int64)
    i = np.minimum(np.searchsorted(vocab, code), len(vocab) - 1)
    return np.where(vocab[i] == code, i + 1, 0)


def _hole(doc: np.ndarray, item: np.ndarray, doc_word: np.ndarray, item_word: np.ndarray) -> tuple[int, int]:
    """Between two runs: the most words in a row that stay unmatched on either side, and all that do on the side with more."""
    n, m = len(doc), len(item)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for x in range(n - 1, -1, -1):
        for y in range(m - 1, -1, -1):
            best[x][y] = best[x + 1][y + 1] + 1 if doc[x] == item[y] and doc[x] else max(best[x + 1][y], best[x][y + 1])
    x = y = worst = 0
    left: tuple[set, set] = (set(), set())
    every: tuple[set, set] = (set(), set())
    while x < n or y < m:
        if x < n and y < m and doc[x] == item[y] and doc[x] and best[x][y] == best[x + 1][y + 1] + 1:
            left = (set(), set())
            x, y = x + 1, y + 1
        elif y >= m or (x < n and best[x + 1][y] >= best[x][y + 1]):
            left[0].add(int(doc_word[x]))
            every[0].add(int(doc_word[x]))
            x += 1
        else:
            left[1].add(int(item_word[y]))
            every[1].add(int(item_word[y]))
            y += 1
        worst = max(worst, len(left[0]), len(left[1]))
    return worst, max(len(every[0]), len(every[1]))


Stretch = tuple[int, int, int, np.ndarray]  # first token, last token, words, the tokens found


def _stretches(d: np.ndarray, i: np.ndarray, sym: np.ndarray, word: np.ndarray, items: Items, least: int, run: int) -> list[Stretch]:
    """The accepted stretches of one document and item, from the places d and i of their common phrases; none if they hold fewer than ``least`` words.

    sym and word are the symbols and word numbers of the shard's tokens.
    """
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(d - i) != 0) | (np.diff(d) > 1)])
    last = np.r_[cut[1:] - 1, len(d) - 1]
    runs = sorted(zip(d[cut].tolist(), (d[last] + PHRASE - 1).tolist(), i[cut].tolist(), (i[last] + PHRASE - 1).tolist()))
    chains: list[list] = []
    for s in runs:
        best = None
        for c in chains:
            e = c[-1]
            gd, gi = s[0] - e[1] - 1, s[2] - e[3] - 1
            if -PHRASE < gd <= SLACK and -PHRASE < gi <= SLACK and s[1] > e[1] and s[3] > e[3] and (best is None or abs(gd - gi) < best[0]):
                a, b = slice(e[1] + 1, s[0]), slice(e[3] + 1, s[2])
                worst, lost = _hole(sym[a], items.symbol[b], word[a], items.word[b])
                if worst <= HOLE:
                    best = (abs(gd - gi), c, lost)
        if best:
            best[1].append((*s, best[2]))
        else:
            chains.append([(*s, 0)])
    out, used = [], set()
    for c in chains:
        while c:
            # the best-scoring beginning: a word found counts 1, a word lost COST
            score = top = 0
            stop = 0
            for k, s in enumerate(c):
                score += len(set(items.word[s[2] : s[3] + 1].tolist())) - (COST * s[4] if k else 0)
                if score > top:
                    top, stop = score, k
                if score < top - DROP or score <= 0:
                    break
            part, c = c[: stop + 1], c[stop + 1 :]
            n = {int(items.word[t]) for s in part for t in range(s[2], s[3] + 1)}
            if len(n) >= run and len(n) >= DENSITY * (len(n) + sum(s[4] for s in part[1:])):
                out.append((part[0][0], part[-1][1], len(n), np.unique(np.concatenate([np.arange(x[0], x[1] + 1) for x in part]))))
                used |= n
    return out if len(used) >= least else []


def _contest(claims: list[tuple[int, list[Stretch]]], word: np.ndarray, least: int, run: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(item, words, spans) of those items of a document that keep enough words of their own; items equally good on the same words all keep them."""
    kept: list[list[Stretch]] = []
    for item, mine in sorted(claims, key=lambda c: -sum(x[2] for x in c[1])):
        left, changed = [], False
        for first, last, n, found in mine:
            own = found
            for a, b, _, theirs in (x for other in kept for x in other):
                if a > last or b < first:
                    continue
                lo, hi = max(a, first), min(b, last)
                inside = (found >= lo) & (found <= hi)
                if np.count_nonzero((theirs >= lo) & (theirs <= hi)) > np.count_nonzero(inside):
                    own = own[(own < lo) | (own > hi)]
            if len(own) < len(found):
                changed, n = True, len(np.unique(word[own]))
                if n < run:
                    continue
                first, last = int(own[0]), int(own[-1])
            left.append((first, last, n, own))
        if left and (not changed or sum(x[2] for x in left) >= least):
            kept.append(left)
            yield item, sum(x[2] for x in left), [(x[0], x[1]) for x in left]


def _shard(ids: list, texts: list[str], vocab: np.ndarray, blocks: Iterator[Items], least: int, run: int) -> Iterator[tuple]:
    """(document, item, words, spans) for the documents of one shard."""
    w = tx.words([tx.plain(t) for t in texts])
    sym = symbols(vocab, w.code)
    if not len(sym):
        return
    # runs of items' words within a text, at least a phrase long
    known = sym > 0
    head = np.r_[True, (w.text[1:] != w.text[:-1]) | ~known[1:] | ~known[:-1]]
    run_id = np.cumsum(head) - 1
    keep = known & (np.bincount(run_id)[run_id] >= PHRASE)
    at = np.flatnonzero(keep)
    if not len(at):
        return
    breaks = np.r_[True, run_id[at][1:] != run_id[at][:-1]]
    place = np.arange(len(at)) + np.cumsum(breaks)  # one separator before each run
    seq = np.zeros(int(place[-1]) + 1, np.int64)
    seq[place] = sym[at]
    token = np.full(len(seq), -1, np.int64)
    token[place] = at
    index = FMIndex(seq, len(vocab) + 1)
    written = tx.written_words(w)
    claims: dict[int, list[tuple[int, list[Stretch]]]] = {}
    for items in blocks:
        phrase, pos = index.locate(*index.search(items.phrases))
        if not len(pos):
            continue
        # every occurrence of a phrase in the shard with every place the items have it
        count = items.first[phrase + 1] - items.first[phrase]
        take = np.repeat(items.first[phrase], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        d = np.repeat(token[pos], count)
        i, item = items.at[take], items.item[take]
        pair = w.text[d].astype(np.int64) * (len(items.ids) + 1) + item
        order = np.argsort(pair, kind="stable")
        pair, d, i = pair[order], d[order], i[order]
        cuts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        ends = np.r_[cuts[1:], len(pair)]
        for a, b in zip(cuts[ends - cuts >= SEEDS], ends[ends - cuts >= SEEDS]):
            # cheap bound before chaining: the words of all common phrases together
            near = items.word[(i[a:b, None] + np.arange(PHRASE)).ravel()]
            if len(np.unique(near)) < least:
                continue
            got = _stretches(d[a:b], i[a:b], sym, written, items, least, run)
            if got:
                text, it = divmod(int(pair[a]), len(items.ids) + 1)
                claims.setdefault(text, []).append((int(items.ids[it]), got))
    for text, mine in sorted(claims.items()):
        base = int(np.searchsorted(w.text, text))
        for item, words, spans in _contest(mine, written, least, run):
            yield ids[text], item, words, sorted((x - base, y - base) for x, y in spans)


class Blocks:
    """The items as files that the driver hands to the executors: their distinct words, and a file per block."""

    def __init__(self, items: DataFrame, part: Callable[[str], str], limit: int):
        self.tag = f"items-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self._folder = served_folder(items.sparkSession, "items")
        self._context = items.sparkSession.sparkContext
        vocab = np.zeros(0, np.uint64)
        held: list = []
        size = 0
        for r in items.sort("i", "t").toLocalIterator():
            if held and size + len(r["t"]) > limit:
                vocab = np.union1d(vocab, self._block(held, part))
                held, size = [], 0
            held.append(r)
            size += len(r["t"])
        if held:
            vocab = np.union1d(vocab, self._block(held, part))
        self._hand("words", vocab)

    def _block(self, rows: list, part: Callable[[str], str]) -> np.ndarray:
        block = Items([r["i"] for r in rows], [part(r["t"]) for r in rows])
        self._hand(str(self.count), block)
        self.count += 1
        return block.vocab

    def _hand(self, name: str, content) -> None:
        path = os.path.join(self._folder, f"{self.tag}-{name}")
        with open(path, "wb") as f:
            pickle.dump(content, f, 5)
        self._context.addFile(path)


_held: dict[str, object] = {}


def _fetch(tag: str, name: str, vocab: np.ndarray | None = None):
    """A file of the blocks; the words and the last block read stay in the process."""
    if f"{tag}-{name}" not in _held:
        for key in [k for k in _held if not k.startswith(tag) or not k.endswith("-words")]:
            del _held[key]
        with open(SparkFiles.get(f"{tag}-{name}"), "rb") as f:
            content = pickle.load(f)
        if vocab is not None:
            content.renumber(vocab)
        _held[f"{tag}-{name}"] = content
    return _held[f"{tag}-{name}"]


def leaks(documents: DataFrame, items: DataFrame, doc: str, text: str, item: str, item_text: str, part: Callable[[str], str] = body, least: int = 20, run: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc, item, words, spans): the documents that hold at least ``least`` words of an item, in stretches of at least ``run`` words.

    ``part`` selects what of an item counts.  words is the number of words found, spans the
    merged ranges [from_word, to_word] of the document's words to remove.  Documents and
    items with a NULL id are left out, NULL and empty texts hold nothing; ids are BIGINT.  Repeated
    documents are all reported, each once if ids are distinct; items that have the same wording are reported all.  Other columns are ignored.
    """
    chosen = items.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    blocks = Blocks(chosen, part, item_bytes)
    tag, count = blocks.tag, blocks.count
    docs = documents.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in tx.chunks(tx.column(b, "d"), tx.column(b, "t")):
                vocab = _fetch(tag, "words")
                hits = list(_shard(ids, texts, vocab, (_fetch(tag, str(n), vocab) for n in range(count)), least, run))
                if hits:
                    spans = pa.array([[{"from_word": x, "to_word": y} for x, y in merge(h[3])] for h in hits], pa.list_(pa.struct([("from_word", pa.int32()), ("to_word", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32()), spans], names=["d", "i", "words", "spans"])

    got = docs.mapInArrow(find, "d long, i long, words int, spans array<struct<from_word: int, to_word: int>>")
    return got.select(F.col("d").alias(doc), F.col("i").alias(item), "words", "spans")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching word ranges as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
