"""Keyword-stuffed pages, link lists and tag lists, told by their perplexity under a model of prose.

A text is read as a sequence of word classes.  The words found in most documents (function words above all; they are
counted, not listed) are classes of their own; every other word is a content word, classed by its shape and by how often the
page has said it before within WINDOW words.  Links, #tags and signs are classes too; numbers, identifiers, single letters, words that touch a
bracket or an operator, and words in capitals that are not repeated (codes of all kinds) are one class, and of a row of equal signs or codes one is kept.

An interpolated trigram model of these classes is trained on the prose of the corpus itself: units with the build of a
sentence, on pages that do not say the same two words over and over.  Each word, link and tag of a text then has a surprise (negative log
probability), and the log perplexity around it is the mean over the SPAN tokens on both sides.  It is abnormal if it exceeds
what only the fraction ``RARE`` of the single tokens of the prose reaches; so the bar comes from all the prose and moves with it.
Keyword lists, stuffed sentences, links and tags are improbable for prose: repeated content words follow each other, links and tags have no
place in sentences.  Numbers, codes and signs are no words and bear no surprise, so tables, logs and code stay usual.
A page is spam if the words, links and tags of abnormal perplexity make up more than half of its characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import text as tx

LEARNED = 1000  # words with a class of their own
TRIPLES = 1 << 20  # triples that the model holds, the most frequent ones; what is rarer falls back to pairs
WINDOW = 4096  # words back to which a word counts as said before
SPAN = 8  # tokens on both sides over which surprise is averaged
PRIOR = 8  # tokens of usual surprise that are added to each mean, so that a few tokens alone prove nothing
RARE = 0.002
UNIT = 32
NEAR = 64  # words back to which two words count as an echo,
AGAIN = 2  # if said so often before;
ECHO = 0.4  # a page with more than this share of its words in echoes is no model of prose
SHAPE_LOWER, SHAPE_TITLE, SHAPE_UPPER = range(3)
# classes of tokens that are no words, of links and tags; then content words by shape and repetition; then learned words
CODE, BREAK, END, COMMA, SIGN, LINK, TAG = range(7)
LEVELS = np.array([1, 2, 4, 8])  # how often said before
CONTENT = 7
FIRST_WORD = CONTENT + 3 * (len(LEVELS) + 1)
_LINKS = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^\s<>\"'()\[\]]+|\bwww\.[^\s<>\"'()\[\]]+|\b[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}/[^\s<>\"'()\[\]]*")
_ANCHOR = re.compile(r"<a\b|<[^>]*\bhref\b", re.I)  # other tags are layout, not text
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>")

_KIND = np.zeros(256, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 underscore, 4 sign, 5 line break, 6 link or anchor
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[list(range(48, 58))] = 2
_KIND[95] = 3
_KIND[[b for b in range(33, 127) if not (chr(b).isalnum() or b == 95)]] = 4
_KIND[[10, 13]] = 5
_KIND[1] = 6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = np.full(256, SIGN, np.int32)
_SIGN[[ord(c) for c in ".?!"]] = END
_SIGN[[ord(c) for c in ",;:"]] = COMMA
_TOUCH = np.isin(np.arange(256), [ord(c) for c in "()[]{}=*+$\\"])  # a word that touches one of these is a name in code
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    text: np.ndarray  # text of each token
    kind: np.ndarray  # its class; content words by shape, without repetition
    word: np.ndarray  # whether it is one: letters, no digits or underscores
    size: np.ndarray  # its characters
    code: np.ndarray  # number of its spelling in lower case
    texts: int


def tokens(texts: list[str]) -> Tokens:
    """Classes of all tokens of some texts."""
    prepared = []
    for t in texts:
        if "\x01" in t:
            t = t.replace("\x01", " ")
        if not t.isascii():
            t = tx._OTHER.sub(lambda m: "\n" if m[0] in "  \x85" else " ", tx.unicodedata.normalize("NFC", t))
        if "/" in t or "www." in t:
            t = _LINKS.sub(lambda m: "\x01" * len(m[0]), t)
        if "<" in t:
            t = _TAGS.sub(lambda m: ("\x01" if _ANCHOR.match(m[0]) else " ") * len(m[0]), t)
        prepared.append(t.encode("utf-8", "replace"))
    data = np.frombuffer(b"\x00".join(prepared) + b"\x00", np.uint8)
    kind = _KIND[data]
    group = np.where((kind >= 1) & (kind <= 3), 1, kind)
    # a token is a run of one group; a sign is a run of the same sign
    change = np.r_[True, (group[1:] != group[:-1]) | ((group[1:] == 4) & (data[1:] != data[:-1]))]
    start = np.flatnonzero(change)
    end = np.r_[start[1:], len(data)]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    g = group[start]
    spelled = g == 1
    total = lambda m: np.concatenate([[0], np.cumsum(m, dtype=np.int32)])
    upper, odd = total((data >= 65) & (data <= 90)), total((kind == 2) | (kind == 3))
    lead = total((data & 0xC0) != 0x80)  # characters, not bytes
    n, up, digits = (x[end] - x[start] for x in (lead, upper, odd))
    cls = np.full(len(start), CODE, np.int32)
    word = spelled & (digits == 0)
    shape = np.where(up == 0, SHAPE_LOWER, np.where((up > 1) & (up == n), SHAPE_UPPER, SHAPE_TITLE))
    cls[word] = (CONTENT + shape * (len(LEVELS) + 1))[word]
    cls[g == 6], cls[g == 5] = LINK, BREAK
    sign = g == 4
    cls[sign] = _SIGN[data[start[sign]]]
    if len(start):
        cls[(cls == END) & np.r_[end[:-1] == start[1:], False] & (np.r_[kind[start[1:]], 5] < 4)] = SIGN  # inside a number or a name
    hashed = np.r_[False, (data[start[:-1]] == 35) & (end[:-1] == start[1:])] if len(start) else sign
    tag = spelled & hashed & (digits < n)
    cls[tag] = TAG
    named = word & (_TOUCH[data[np.maximum(start - 1, 0)]] | _TOUCH[data[np.minimum(end, len(data) - 1)]])
    cls[named] = CODE
    word &= ~tag & ~named
    return Tokens(total(data == 0)[start].astype(np.int64), cls, word, n.astype(np.int32), tx.codes(_LOWER[data], start, end), len(texts))


def _said_before(key: np.ndarray, window: int) -> np.ndarray:
    """How many equal keys there are among the ``window`` ones before each."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], at, 0)) if n else at
    count = at - first
    # only where the first of the equal keys lies further back is there anything to leave out
    far = np.flatnonzero(order - order[first] > window)
    if len(far):
        place = first * np.int64(n + window + 1) + order
        count[far] = far - np.searchsorted(place, place[far] - window)
    out = np.empty(n, np.int64)
    out[order] = count
    return out


def _echoes(key: np.ndarray, times: int, window: int) -> np.ndarray:
    """Whether at least ``times`` of the ``window`` keys before each are equal to it."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    out = np.zeros(len(key), bool)
    if len(key) > times:
        out[order[times:]] = (k[times:] == k[:-times]) & (order[times:] - order[:-times] <= window)
    return out


@dataclass
class Sequence:
    """What is left of the tokens: codes and signs once in a row, content words with their repetition, learned words by their number."""

    text: np.ndarray
    kind: np.ndarray
    size: np.ndarray
    code: np.ndarray
    scored: np.ndarray
    texts: int


def sequence(t: Tokens, learned: np.ndarray) -> Sequence:
    """learned: the sorted codes of the words with a class of their own."""
    cls = t.kind.copy()
    w = np.flatnonzero(t.word)
    before = np.zeros(len(cls), np.int64)
    before[w] = _said_before(t.code[w] ^ (t.text[w].astype(np.uint64) * _MIX), WINDOW)
    known = np.zeros(len(cls), bool)
    if len(learned):
        at = np.minimum(np.searchsorted(learned, t.code), len(learned) - 1)
        known = t.word & (learned[at] == t.code)
        cls[known] = FIRST_WORD + at[known]
    content = t.word & ~known
    codes = content & (((t.kind == CONTENT + SHAPE_UPPER * (len(LEVELS) + 1)) & (before == 0)) | (t.size == 1))
    cls[content] += np.searchsorted(LEVELS, before[content], side="right").astype(np.int32)
    cls[codes] = CODE
    scored = cls >= LINK
    again = np.r_[False, ~scored[1:] & (cls[1:] == cls[:-1]) & (t.text[1:] == t.text[:-1])] if len(cls) else scored
    keep = ~again
    size = np.bincount(np.cumsum(keep) - 1, t.size * (t.kind != BREAK)) if len(cls) else np.zeros(0)
    return Sequence(t.text[keep], cls[keep], size, t.code[keep], scored[keep], t.texts)


def _prose(s: Sequence) -> np.ndarray:
    """Tokens in units with the build of a sentence (5 words or more, a quarter of them learned, an end, no links and few codes) on pages without echoes."""
    k = s.kind
    if not len(k):
        return np.zeros(0, bool)
    fresh = np.r_[True, s.text[1:] != s.text[:-1]]
    head = fresh | np.r_[False, (k[:-1] == BREAK) | (k[:-1] == END)]
    since = np.arange(len(k)) - np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
    unit = np.cumsum(head | (since % UNIT == 0)) - 1
    count = lambda m: np.bincount(unit, m)[unit]
    words = count(k >= CONTENT)
    built = (words >= 5) & (count(k >= FIRST_WORD) >= 0.25 * words) & (count((k == LINK) | (k == TAG)) == 0) & (count(k == CODE) <= 0.4 * words) & (count(k == END) > 0)
    w = np.flatnonzero(k >= CONTENT)
    echo = np.zeros(len(k), bool)
    if len(w) > 1:
        c = s.code[w]
        two = (c[:-1] * np.uint64(31) + c[1:] * np.uint64(1009) + s.text[w[1:]].astype(np.uint64)) * _MIX
        often = _echoes(two, AGAIN, NEAR) & (s.text[w[1:]] == s.text[w[:-1]])
        echo[w[:-1][often]] = echo[w[1:][often]] = True
    share = np.bincount(s.text, echo, minlength=s.texts) / np.maximum(np.bincount(s.text, k >= CONTENT, minlength=s.texts), 1)
    return built & (share <= ECHO)[s.text]


def _triples(s: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = s.kind.astype(np.int64)
    one, two = np.full(len(k), BREAK, np.int64), np.full(len(k), BREAK, np.int64)
    one[1:] = np.where(s.text[1:] == s.text[:-1], k[:-1], BREAK)
    two[2:] = np.where(s.text[2:] == s.text[:-2], k[:-2], BREAK)
    return two, one, k


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, n, minlength=len(u)).astype(float)


class Model:
    """Interpolated trigram model over the classes; keys are triples, pairs and classes as numbers."""

    def __init__(self, learned: np.ndarray, key: np.ndarray, n: np.ndarray, level: float = RARE):
        self.learned = learned
        self.classes = c = FIRST_WORD + len(learned)
        order = np.argsort(key)
        self.tri, self.tri_n = key[order], n[order].astype(float)
        self.pair = np.bincount(self.tri % (c * c), self.tri_n, minlength=c * c)  # by the number of the pair: classes squared, 8 MB each
        self.front = np.bincount(self.tri // c, self.tri_n, minlength=c * c)
        self.one = np.bincount(self.tri % c, self.tri_n, minlength=c)
        self.lead = np.bincount(self.tri // c % c, self.tri_n, minlength=c)
        a, b, k = self.tri // (c * c), self.tri // c % c, self.tri % c
        surprise, seen = -self.log_prob(a, b, k)[k >= LINK], self.tri_n[k >= LINK]
        order = np.argsort(-surprise)
        tail = np.cumsum(seen[order])
        # what only the fraction ``level`` of the prose's tokens exceeds; without prose nothing is abnormal
        self.usual = float((surprise * seen).sum() / seen.sum()) if len(tail) else 0.0
        self.limit = float(surprise[order][np.searchsorted(tail, level * tail[-1])]) if len(tail) else np.inf

    def log_prob(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Natural log of the probability of class c after a and b."""
        p1 = (self.one[c] + 0.5) / (self.one.sum() + 0.5 * self.classes)
        p2 = (self.pair[b * self.classes + c] + 5 * p1) / (self.lead[b] + 5)
        p3 = _lookup(self.tri, self.tri_n, (a * self.classes + b) * self.classes + c)
        return np.log((p3 + 5 * p2) / (self.front[a * self.classes + b] + 5))

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(share of characters in words, links and tags of abnormal perplexity, log perplexity) per text; 0 for an empty text."""
        s = sequence(tokens(texts), self.learned)
        n = s.texts
        if not len(s.kind):
            return np.zeros(n), np.zeros(n)
        loss = np.where(s.scored, -self.log_prob(*_triples(s)), 0.0)
        some, many = np.concatenate([[0], np.cumsum(loss)]), np.concatenate([[0], np.cumsum(s.scored)])
        at = np.arange(len(s.kind))
        first = np.searchsorted(s.text, np.arange(n))[s.text]
        last = np.searchsorted(s.text, np.arange(n), side="right")[s.text]
        a, b = np.maximum(at - SPAN, first), np.minimum(at + SPAN + 1, last)
        around = (some[b] - some[a] + PRIOR * self.usual) / (many[b] - many[a] + PRIOR)
        per = lambda m: np.bincount(s.text, m, minlength=n)
        return per(s.size * (s.scored & (around > self.limit))) / np.maximum(per(s.size), 1), per(loss) / np.maximum(per(s.scored), 1)


def _counted(documents: DataFrame, text: str, count) -> DataFrame:
    """(x, n): the sums of what ``count`` yields for chunks of texts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for b in batches:
            for _, texts in tx.chunks([None] * b.num_rows, tx.column(b, "t")):
                k, n = count(texts)
                keys.append(k)
                sums.append(n)
                if sum(map(len, keys)) > 1 << 22:
                    k, n = _sums(np.concatenate(keys), np.concatenate(sums))
                    keys, sums = [k], [n]
        k, n = _sums(np.concatenate(keys), np.concatenate(sums))
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["x", "n"])

    rows = documents.select(F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(gather, "x long, n long").groupBy("x").agg(F.sum("n").alias("n"))


def _spellings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, texts): in how many texts each word without digits occurs."""
    w = tx.words([t.lower() if t.isascii() else tx.unicodedata.normalize("NFC", t) for t in texts])
    digits = np.concatenate([[0], np.cumsum(_KIND[w.data] == 2)])
    word = digits[w.end] == digits[w.start]
    code, text = w.code[word], w.text[word]
    own = np.unique(code ^ (text.astype(np.uint64) * _MIX), return_index=True)[1]
    code, n = np.unique(code[own], return_counts=True)
    return code.view(np.int64), n.astype(float)


def train(documents: DataFrame, text: str, learned: int = LEARNED, triples: int = TRIPLES) -> Model:
    """The model of all texts' prose.  The driver receives the ``learned`` most widespread words and the ``triples`` most frequent triples, whatever the corpus."""
    top = _counted(documents, text, _spellings).orderBy(F.desc("n"), "x").limit(learned).select("x").toPandas()
    words = np.sort(top["x"].to_numpy(np.int64).view(np.uint64))
    classes = FIRST_WORD + len(words)

    def count(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        s = sequence(tokens(texts), words)
        use = _prose(s)
        a, b, c = (x[use] for x in _triples(s))
        key, n = np.unique((a * classes + b) * classes + c, return_counts=True)
        return key, n.astype(float)

    got = _counted(documents, text, count).orderBy(F.desc("n"), "x").limit(triples).toPandas()
    return Model(words, got["x"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def spam_scores(documents: DataFrame, doc: str, text: str, model: Model | None = None) -> DataFrame:
    """(doc, spam_share, log_perplexity): per document the share of its characters in words, links and tags of abnormal perplexity, and its log perplexity under the prose model.

    NULL and empty texts have share 0.  Documents with a NULL id are left out; repeated documents are scored each.
    Other columns are ignored; an empty table gives an empty result.  Texts are read whole, whatever their length.
    """
    fitted = model or train(documents, text)
    kind = documents.schema[doc].dataType.simpleString()
    rows = documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).where("d is not null")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for ids, texts in tx.chunks([None] * b.num_rows, tx.column(b, "t")):
                share, loss = fitted.judge(texts)
                yield pa.RecordBatch.from_arrays([b["d"].slice(at, len(ids)), pa.array(share), pa.array(loss)], names=["d", "s", "p"])
                at += len(ids)

    return rows.mapInArrow(rate, f"d {kind}, s double, p double").select(F.col("d").alias(doc), F.col("s").alias("spam_share"), F.col("p").alias("log_perplexity"))


def spam_pages(documents: DataFrame, doc: str, text: str, share: float = 0.5) -> DataFrame:
    """(doc): documents with more than ``share`` of their characters in words, links and tags of abnormal perplexity."""
    return spam_scores(documents, doc, text).where(F.col("spam_share") > share).select(doc)
