"""Mixing sources to target weights by Poisson replication.

A document of a source is used k times, k being the inverse of a Poisson distribution at a
uniform number hashed from a seed and the document, cut off at the source's cap.  The mean
of the distribution is the source's repetition rate, corrected so that the size drawn from the source
meets its target: for fixed uniform numbers the size grows with the mean, so the mean is found
by bisection on the sizes per source and slice of the unit interval.  These sums have a fixed
size (sources in the targets x SLICES) whatever the corpus.

A source that cannot give its share even at its cap gives all it has; what is missing is
spread over the other sources in proportion to their targets, so that the mix keeps the size
of the corpus.  The documents are exploded by their count and shuffled once, by a hash.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import text as tx
from rankloom.session import written

SLICES = 4096
MOST_SOURCES = 10_000  # rows of the targets, which the driver holds
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # ranks of a byte-level BPE vocabulary; the driver hands the file to the executors
# fixed value: the published pattern that splits texts for this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict = {}


def _encoder(name: str):
    """From the file that the driver handed out under this name."""
    if name not in _encoders:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def clean_source(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")), r"[\s \-]+", "_")


def _uniform(doc: Column, seed: int) -> Column:
    """A number in [0, 1) per document."""
    return F.pmod(F.xxhash64(F.lit(seed), doc), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _steps(mean: float, cap: int) -> list[float]:
    """Cumulative Poisson probabilities of 0 .. cap - 1: the count is the number of them that the uniform number reaches."""
    if math.isinf(mean):
        return [0.0] * cap
    out, p, total = [], math.exp(-mean), 0.0
    for k in range(cap):
        total += p
        out.append(min(total, 1.0))
        p *= mean / (k + 1)
    return out


def sized(documents: DataFrame, doc: str, text: str, source: str, seed: int, tokenizer: str) -> DataFrame:
    """(source, u, tokens) per document; the texts stay where they are."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    rows = documents.select(clean_source(F.col(source)).alias("s"), _uniform(F.coalesce(F.col(doc).cast("string"), F.col(text)), seed).alias("u"), F.col(text).alias("t"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(name)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in tx.column(b, "t")]
            yield pa.RecordBatch.from_arrays([b["s"], b["u"], pa.array(n, pa.int64())], names=["s", "u", "n"])

    return rows.mapInArrow(measure, "s string, u double, n long")


class Mix:
    """The means per source, fitted to the sizes of a corpus."""

    def __init__(self, documents: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, tokenizer: str = TOKENIZER, refill: bool = True):
        self.documents, self.doc, self.text, self.source, self.seed = documents, doc, text, source, seed
        rows = targets.select(clean_source(F.col("source")).alias("s"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("c")).where("s is not null and w is not null and w >= 0").groupBy("s").agg(F.sum("w").alias("w"), F.min(F.coalesce("c", F.lit(1))).alias("c")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources in the targets")
        self.targets = {r["s"]: (r["w"], max(int(r["c"]), 0)) for r in rows}
        self.sizes = written(sized(documents, doc, text, source, seed, tokenizer), "mix-sizes")
        names = list(self.targets)
        part = self.sizes.select(F.when(F.col("s").isin(*names), F.col("s")).alias("s"), F.floor(F.col("u") * SLICES).cast("int").alias("b"), "n") if names else self.sizes.select(F.lit(None).cast("string").alias("s"), F.lit(0).alias("b"), "n")
        got = part.groupBy("s", F.when(F.col("s").isNotNull(), F.col("b")).alias("b")).agg(F.sum("n").alias("n")).collect()
        self.total = sum(r["n"] for r in got)
        self.slices = {s: np.zeros(SLICES) for s in names}
        for r in got:
            if r["s"] is not None:
                self.slices[r["s"]][r["b"]] += r["n"]
        self.means = self._fit(refill)

    def _fit(self, refill: bool) -> dict[str, float]:
        have = {s: float(x.sum()) for s, x in self.slices.items()}
        most = {s: have[s] * self.targets[s][1] for s in have}
        weight = sum(w for w, _ in self.targets.values())
        want = {s: self.targets[s][0] / weight * self.total if weight else 0.0 for s in have}
        if refill:
            full: set = set()
            while True:
                over = {s for s in want if s not in full and want[s] > most[s]}
                if not over:
                    break
                full |= over
                left = self.total - sum(most[s] for s in full)
                rest = sum(self.targets[s][0] for s in want if s not in full)
                want = {s: most[s] if s in full else (self.targets[s][0] / rest * left if rest else 0.0) for s in want}
        self.wanted = {s: min(want[s], most[s]) for s in want}
        return {s: self._mean(s, self.wanted[s], most[s]) for s in want}

    def _drawn(self, s: str, mean: float) -> float:
        u = (np.arange(SLICES) + 0.5) / SLICES
        return float(sum((self.slices[s] * (u >= p)).sum() for p in _steps(mean, self.targets[s][1])))

    def _mean(self, s: str, want: float, most: float) -> float:
        if want <= 0:
            return 0.0
        if want >= most:
            return math.inf
        lo, hi = 0.0, 1.0
        while self._drawn(s, hi) < want and hi < 700:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if self._drawn(s, mid) < want else (lo, mid)
        return hi

    def copies(self, source: Column, u: Column) -> Column:
        """How often a document is used."""
        out = F.lit(0)
        for s, mean in self.means.items():
            steps = _steps(mean, self.targets[s][1]) if mean > 0 else []
            if steps:
                reached = F.size(F.filter(F.array(*[F.lit(float(p)) for p in steps]), lambda p: u >= p))
                out = F.when(source == s, reached).otherwise(out)
        return out.cast("int")

    def drawn(self) -> DataFrame:
        """(source, doc, copy, text): the mix in a random order over all partitions."""
        s, u = clean_source(F.col(self.source)), _uniform(F.coalesce(F.col(self.doc).cast("string"), F.col(self.text)), self.seed)
        rows = self.documents.select(s.alias("source"), F.col(self.doc).alias("doc"), F.col(self.text).alias("text"), self.copies(s, u).alias("k")).where("k > 0")
        rows = rows.select("source", "doc", "text", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy"))
        rows = rows.withColumn("place", F.xxhash64(F.lit(self.seed + 1), "doc", "copy"))
        return rows.repartition("place").sortWithinPartitions("place").select("source", F.col("doc").alias(self.doc), "copy", "text")

    def checked(self, within: float = 0.02) -> DataFrame:
        """(source, documents, max_repeats, capped, reached): whether no document of a source is used more often than its cap, and whether the source gives what it should.

        It should give its share of the corpus' size (where others can't give theirs, more), or all it has at its cap; reached tells if it is off by less than ``within`` of that.
        """
        wanted = self.documents.sparkSession.createDataFrame([(s, float(v)) for s, v in sorted(self.wanted.items())], "source string, wanted double")
        r = self.report().join(F.broadcast(wanted), "source")
        return r.select("source", "documents", "max_repeats", (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"), (F.abs(F.col("tokens") - F.col("wanted")) <= within * F.col("wanted")).alias("reached"))

    def report(self) -> DataFrame:
        """(source, target_share, max_repeats, documents, tokens_available, used, most_repeats, tokens, share): what each target source gives to the mix."""
        k = self.copies(F.col("s"), F.col("u"))
        per = self.sizes.where(F.col("s").isin(*self.targets)).select("s", "n", k.alias("k")).groupBy("s").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens_available"), F.sum("k").alias("used"), F.max("k").alias("most_repeats"), F.sum(F.col("n") * F.col("k")).alias("tokens")) if self.targets else None
        spark = self.documents.sparkSession
        wanted = spark.createDataFrame([(s, w, c) for s, (w, c) in sorted(self.targets.items())], "s string, target_share double, max_repeats int")
        if per is None:
            return wanted.selectExpr("s as source", "target_share", "max_repeats", "0L as documents", "0L as tokens_available", "0L as used", "0 as most_repeats", "0L as tokens", "cast(null as double) as share")
        whole = per.agg(F.sum("tokens").alias("whole"))
        zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
        out = wanted.join(per, "s", "left").join(whole)  # one row
        return out.select(F.col("s").alias("source"), "target_share", "max_repeats", zero("documents", "long"), zero("tokens_available", "long"), zero("used", "long"), zero("most_repeats", "int"), zero("tokens", "long"), (F.coalesce(F.col("tokens"), F.lit(0)) / F.when(F.col("whole") > 0, F.col("whole"))).alias("share"))
