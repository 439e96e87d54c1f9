"""Evaluation texts leaking into training text.

Method: a BM25 inverted index of the test items, asked with every passage of the corpus. Passages are windows of 24 words,
12 apart, so any 12 words in a row lie within one. An item's threshold is the least score that 12 consecutive words of it
reach, so that no leak can score below it. Items stand in blocks; the largest impact of a term within a block bounds what
a passage can score there, and blocks that cannot reach a threshold are skipped (block-max WAND). What is retrieved is
verified word by word.

The index holds test items only. A part of at most ITEMS items and INDEX_BYTES is broadcast; what does not fit goes into
further parts, so the size of what is broadcast is checked whatever the test set. All parts are asked in one scan as long
as they fit together, so most test sets need one.

Cases: null or empty texts and items of fewer than 12 words match nothing; repeated rows give one result row; equal
items all match; null ids are dropped; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, BLOCK, ITEMS = 12, 16, 512
#: Bytes of an index's tables at most, and of all indexes that are asked in one scan of the documents.
INDEX_BYTES, SCAN_BYTES = 32 << 20, 256 << 20
K1, B = 1.2, 0.75

_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐][^\S\n]*\r?\n[^\S\n]*(?:(?:[#>*;%|!]+|//+|--+|/\*+|\"\"\"|'''|<!--|rem\b)[^\S\n]*)*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits after resolving entities, NFKC, lower-casing, dropping invisible format characters and
    joining words hyphenated over a line end."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if c.isascii() or unicodedata.category(c) != "Cf").lower()
        text = unicodedata.normalize("NFKC", text)
    else:
        text = text.lower()
    if "-" in text or "‐" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text)


class ItemIndex:
    """Postings of a bounded set of items as impact tables over (term, item) and (term, block)."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(i, words(t)) for i, t in items]
        texts = [(i, w) for i, w in texts if len(w) >= RUN]
        self.ids = np.array([i for i, _ in texts], np.int64)
        n = len(texts)
        df = Counter(t for _, w in texts for t in set(w))
        self.term = {t: k + 1 for k, t in enumerate(sorted(df))}  # 0: a word in no item
        mean = sum(len(w) for _, w in texts) / n if n else 1
        blocks = max(1, -(-n // BLOCK))
        self.impact = np.zeros((len(df) + 1, blocks * BLOCK), np.float32)
        self.runs: list[set[bytes]] = []
        least = np.full(blocks * BLOCK, np.inf, np.float32)
        for k, (_, w) in enumerate(texts):
            for t, tf in Counter(w).items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                self.impact[self.term[t], k] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            row = np.array([self.term[t] for t in w], np.int32)
            total = np.concatenate([[0], np.cumsum(self.impact[row, k].astype(np.float64))])
            least[k] = (total[RUN:] - total[:-RUN]).min() * (1 - 1e-4)
            self.runs.append({row[i : i + RUN].tobytes() for i in range(len(row) - RUN + 1)})
        self.least = least
        self.bound = self.impact.reshape(len(df) + 1, blocks, BLOCK).max(axis=2)
        self.block_least = least.reshape(blocks, BLOCK).min(axis=1)

    def search(self, text: list[str]) -> list[int]:
        """Item ids that share RUN consecutive words with the words of a text."""
        term = self.term.get
        row = np.array([term(w, 0) for w in text], np.int32)
        if len(row) < RUN or np.count_nonzero(row) < RUN:
            return []
        starts = np.arange(0, len(row) - RUN + 1, RUN)
        sums = lambda table: np.add.reduceat(table[row], starts, axis=0)
        half = sums(self.bound)
        upper = half.copy()
        upper[:-1] += half[1:]  # a passage reaches over two strides
        hot = np.flatnonzero((upper >= self.block_least).any(axis=0))
        found = []
        for block in hot:
            at = slice(block * BLOCK, (block + 1) * BLOCK)
            score = sums(self.impact[:, at])
            score[:-1] += score[1:].copy()
            passages, items = np.nonzero(score >= self.least[at])
            for item in np.unique(items):
                runs = self.runs[block * BLOCK + item]
                if any(row[i : i + RUN].tobytes() in runs for p in passages[items == item] for i in range(p * RUN, min(p * RUN + RUN, len(row) - RUN + 1))):
                    found.append(int(self.ids[block * BLOCK + item]))
        return found


def _indexes(items: list[tuple[int, str]]) -> list[ItemIndex]:
    """Indexes of parts of the items, each within INDEX_BYTES (a single item is never split)."""
    index = ItemIndex(items)
    if index.impact.nbytes + index.bound.nbytes <= INDEX_BYTES or len(items) < 2:
        return [index]
    half = len(items) // 2
    return _indexes(items[:half]) + _indexes(items[half:])


def leaks(items: DataFrame, documents: DataFrame, per_part: int = ITEMS) -> DataFrame:
    """item_id, doc_id of every document that holds RUN consecutive words of an item."""
    spark = documents.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter((F.length("text") > 0) & F.col("doc_id").isNotNull())
    parts = max(1, -(-items.count() // per_part))
    found = []

    def ask(indexes: list[ItemIndex]) -> None:
        shared = spark.sparkContext.broadcast(indexes)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(i, d) for d, t in zip(b["doc_id"], b["text"], strict=True) for row in (words(t),) if len(row) >= RUN for index in shared.value for i in index.search(row)]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id"]).astype("int64")

        found.append(texts.mapInPandas(work, "item_id long, doc_id long"))

    held, size = [], 0
    for k in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        for index in _indexes([(r.item_id, r.text) for r in part.collect()]):
            if held and size + index.impact.nbytes > SCAN_BYTES:
                ask(held)
                held, size = [], 0
            held.append(index)
            size += index.impact.nbytes
    ask(held)
    return reduce(DataFrame.unionByName, found).distinct()


def leaked_items(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Per item the number of documents it leaked into; items that did not leak have 0."""
    n = leaks(items, documents).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select(F.col("item_id").cast("long").alias("item_id"), "task").filter("item_id is not null").distinct().join(n, "item_id", "left").select("item_id", "task", F.coalesce("n", F.lit(0)).alias("n_documents"))
