"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark's items. A text's words are read
by their last block of two: the shift table says how far the search may skip,
a block with shift 0 selects a bucket by the suffix, its windows are narrowed
by their first block, and a direct comparison confirms an occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, text_or_empty, written

WINDOW = 10
#: Benchmark text (bytes) that is searched for at a time: what is broadcast at once, and what a worker's tables hold.
BLOCK_BYTES = 16_000_000
#: Text (bytes) of documents that a task holds while it goes through several blocks, so that a block's tables are built once for it.
HELD_BYTES = 64_000_000

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

HITS = "doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text in UTF-8: runs of ASCII letters and digits and of characters beyond ASCII."""
    return text.translate(_WORD).split()


class WuManber:
    """Finds patterns of one length, in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.m = m = len(next(iter(patterns)))
        self.b = b = min(2, m)
        self.skip = m - b + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(b, m + 1):
                block = p[end - b : end]
                self.shift[block] = min(m - end, self.shift.get(block, self.skip))
            self.bucket[p[m - b :]][p[:b]].append((list(p), items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Where patterns start, and whose they are."""
        m, b, skip, n, end = self.m, self.b, self.skip, len(words), self.m
        shift = self.shift.get
        while end <= n:
            block = (words[end - 2], words[end - 1]) if b == 2 else (words[end - 1],)
            by = shift(block, skip)
            if by:
                end += by
                continue
            start = end - m
            for p, items in self.bucket[block].get(tuple(words[start : start + b]), ()):
                if words[start:end] == p:
                    yield start, items
            end += 1


def matchers(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    """One matcher for each length of window; an item of fewer words than ``window``, but not none, is one window."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length[m][tuple(words[i : i + m])].add(item)
    return [WuManber(by_length[m]) for m in sorted(by_length)]


def search(words: list[bytes], found: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges covered by occurrences, merged, and the items they are of."""
    ranges, items = [], set()
    for matcher in found:
        for start, whose in matcher.find(words):
            ranges.append((start, start + matcher.m))
            items |= whose
    return _merged(ranges), items


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row of ``docs(doc_id, text)``, what it shares with ``benchmark(item_id, text)``.

    Columns: doc_id, n_words, hits (word ranges ``[start, end)`` in any
    occurrence of a window, merged), items (ids of items with an occurring
    window, as sorted strings). A benchmark of any size is searched for in
    blocks of about ``block_bytes``, of which one at a time is on the driver and
    in a worker's tables; a task goes through the blocks once for each
    ``HELD_BYTES`` of its texts. Null texts have no words; null item_ids count as the
    empty string; repeated items and rows count as they stand; an empty
    benchmark hits nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    blocks = -(-total // block_bytes) or 1
    sent = []
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        sent.append(spark.sparkContext.broadcast([(r.item, bytes(r.text)) for r in part.collect()]))
    typed = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def searched(held: list[pa.RecordBatch], ready: list[WuManber] | None) -> Iterator[pa.RecordBatch]:
        texts = [t for b in held for t in b.column(1)]
        n, hits, of = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
        for block in sent:
            found = ready if ready is not None else matchers(block.value, window)
            if ready is None:
                block.__dict__.pop("_value", None)  # else the worker would keep every block that it has seen
            for i, text in enumerate(texts):
                words = words_of(text.as_py() or b"")
                n[i] = len(words)
                ranges, whose = search(words, found)
                hits[i] = _merged(hits[i] + ranges) if hits[i] else ranges
                of[i] |= whose
        at = 0
        for b in held:
            part = slice(at, at := at + b.num_rows)
            cols = [n[part], [[{"start": s, "end": e} for s, e in h] for h in hits[part]], [sorted(x) for x in of[part]]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, typed.types[1:], strict=True)]], schema=typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = matchers(sent[0].value, window) if blocks == 1 else None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if ready is not None or sum(b.nbytes for b in held) >= HELD_BYTES:
                yield from searched(held, ready)
                held = []
        yield from searched(held, ready)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, HITS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns; rows without a doc_id stay."""
    gone = contamination(docs, benchmark, window).filter(F.size("hits") > 0).select("doc_id").distinct()
    return join_checked(docs, written(gone, "gone"), "doc_id", "left_anti")
