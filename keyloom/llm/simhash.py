"""SimHash fingerprints and their self-join over binary tries.

Distribution. Two 64-bit fingerprints that differ in at most k bits agree on at
least one of k + 1 blocks of bits. So each distinct fingerprint is dealt to
k + 1 buckets, one for each block; the bucket is the subtree of a binary trie
whose first bits are that block. In a bucket, the trie is joined with itself:
pairs of nodes go down together, differing bits add up, and a pair of nodes is
dropped as soon as it has more than k. A bucket of over ``max_bucket``
fingerprints is dealt again by blocks of its free bits, until about 20 of them
are left, so that no bucket is ever unbounded. Copies share a
fingerprint and count once, however many they are. For classes a bucket's links
are reduced to trees before they leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import overlap
from .common import join_checked, join_uneven, written
from .components import _roots, connected_components, unite

MAX_BITS = 3
MAX_BUCKET = 50_000
#: Node pairs of at most this many fingerprint pairs are leaves, compared at once.
LEAF = 16
#: Node pairs that are held at a time while a trie is joined.
FRONTIER = 1_000_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of one text (UTF-8) as an unsigned 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, n, 65_536):  # long texts, piece by piece
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(first[at : at + 65_536], last[at : at + 65_536], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (signed long) for every row of ``docs(doc_id, text)``.

    A text is lower-cased in A-Z, cut at ASCII white space into words, and
    hashed by runs of ``shingle`` words, repeats included; fewer words are one
    run. Null and empty texts have fingerprint 0. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _deal(rows: DataFrame, bits: int, parts: int) -> DataFrame:
    """Deal ``rows(key, rest, fp, node)``, of ``bits`` free bits, by each of ``parts`` blocks of them.

    ``key`` goes on with the block's number and value, so it names the bucket
    exactly; ``rest`` keeps the free bits outside the block.
    """
    width, number = bits // parts, (parts - 1).bit_length()
    made = []
    for j in range(parts):
        low = j * width
        block = F.shiftrightunsigned("rest", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        above = F.lit(0).cast("long") if low + width >= 64 else F.shiftleft(F.shiftrightunsigned("rest", low + width), low)
        rest = above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << low) - 1).cast("long")))
        key = F.shiftleft("key", number + width).bitwiseOR(F.lit(j << width).cast("long")).bitwiseOR(block)
        made.append(F.struct(key.alias("key"), rest.alias("rest")))
    return rows.withColumn("d", F.explode(F.array(*made))).select("d.key", "d.rest", "fp", "node")


def _widths(parts: int, deals: int) -> list[tuple[int, int]]:
    """Free bits before a deal, and the width of its blocks, for each deal."""
    out, bits = [], 64
    for _ in range(deals):
        out.append((bits, bits // parts))
        bits -= bits // parts
    return out


def _first_block(x: np.ndarray, key: np.ndarray, parts: int, deals: int) -> np.ndarray:
    """Whether ``key`` is the first bucket that holds the pair differing in ``x``, so that each pair is given once."""
    keep, x, number = np.ones(len(x), bool), x.copy(), (parts - 1).bit_length()
    widths = _widths(parts, deals)
    for n, (_, width) in enumerate(widths):
        later = sum(number + w for _, w in widths[n + 1 :])
        digit = (key >> (later + width)) & ((1 << number) - 1)
        mask = np.uint64((1 << width) - 1)
        for j in range(parts):
            keep &= (j >= digit) | ((x >> np.uint64(j * width)) & mask != 0)
        low = (digit * width).astype(np.uint64)
        x = (((x >> low) >> np.uint64(width)) << low) | (x & ((np.uint64(1) << low) - np.uint64(1)))
    return keep


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within tries whose values differ in at most ``budget`` bits.

    values: unsigned, sorted in each of the ranges [starts, ends); a range is a
    trie, a node at depth d the run of values that share d bits. Pairs of nodes
    descend together, all of a level at a time, in pieces of ``FRONTIER`` pairs.
    """
    several = ends - starts > 1
    zero = np.zeros(int(several.sum()), np.int8)
    stack = [(0, starts[several], ends[several], starts[several], ends[several], zero)]
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONTIER:
            for at in range(0, len(a0), FRONTIER):
                stack.append((depth, *(v[at : at + FRONTIER] for v in (a0, a1, b0, b1, diff))))
            continue
        leaf = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth == bits)
        if leaf.any():
            la, lb, nb = a0[leaf], b0[leaf], (b1 - b0)[leaf]
            n = (a1 - a0)[leaf] * nb
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(la, n) + k // np.repeat(nb, n), np.repeat(lb, n) + k % np.repeat(nb, n)
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        go = ~leaf
        if not go.any():
            continue
        a0, a1, b0, b1, diff = (v[go] for v in (a0, a1, b0, b1, diff))
        bit = np.uint64(bits - 1 - depth)
        ones = np.concatenate([[0], np.cumsum((values >> bit) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # sorted: zeros come first
        same = a0 == b0
        step = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
        other = ~same
        step.append(tuple(v[other] for v in (am, a1, b0, bm, diff + 1)))
        x0, x1, y0, y1, d = (np.concatenate([s[k] for s in step]) for k in range(5))
        live = (x1 > x0) & (y1 > y0) & (d <= budget) & ~((x0 == y0) & (x1 - x0 < 2))
        stack.append((depth + 1, *(v[live] for v in (x0, x1, y0, y1, d))))


def _joined(parts: int, deals: int, forest: bool):
    """What joins the tries of a partition of ``key, rest, fp, node``, sorted by key and rest.

    With ``forest`` links become trees as they are found: fewer rows than
    fingerprints leave a bucket, however many pairs are near in it.
    """
    last, width = _widths(parts, deals)[-1]
    bits = last - width

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node = table["key"].to_numpy(), table["node"].to_numpy()
        rest, fp = (table[c].to_numpy().view(np.uint64) for c in ("rest", "fp"))
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(key)]])
        root = np.arange(len(key))
        for i, j in trie_pairs(rest, starts, ends, bits, parts - 1):
            keep = _first_block(fp[i] ^ fp[j], key[i], parts, deals)
            if forest:
                unite(root, i[keep], j[keep])
            elif keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[i[keep]]), pa.array(node[j[keep]])], ["a", "b"])
        i = np.flatnonzero(root != np.arange(len(root)))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[_roots(root, i)])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 200_000:
                continue
            table = pa.Table.from_batches(held)
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last bucket may go on
            if cut:
                yield from of(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from of(pa.Table.from_batches(held))

    return run


def near_pairs(distinct: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET, forest: bool = False) -> DataFrame:
    """``a, b``: nodes of all pairs of ``distinct(fp, node)`` that differ in at most ``max_bits`` bits.

    ``fp`` must be distinct. Each pair comes once. No pair is lost: see the
    module's docstring. With ``forest`` the rows are trees with the same
    components in place of the pairs.
    """
    parts = max_bits + 1
    rows = distinct.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp", "node")
    found, deals = None, 0
    while True:
        bits, _ = _widths(parts, deals + 1)[-1]
        rows, deals = _deal(rows, bits, parts), deals + 1
        more = _widths(parts, deals + 1)
        can = more[-1][1] > 0 and more[-1][0] > 20 and sum(w + (parts - 1).bit_length() for _, w in more) < 63
        hot = written(rows.groupBy("key").count().filter(F.col("count") > max_bucket).select("key"), "hot") if can else None
        again = hot is not None and not hot.isEmpty()
        here = rows.join(hot, "key", "left_anti") if again else rows
        here = here.repartition("key").sortWithinPartitions("key", "rest")
        pairs = here.mapInArrow(_joined(parts, deals, forest), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        if not again:
            return found
        rows = written(rows.join(hot, "key", "left_semi"), "deal")


def near_duplicate_classes(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = 3, seed: int = 42, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits;
    the component is the least doc_id that links reach, itself included. Equal
    fingerprints always link, those of empty and null texts too. Rows that
    repeat a doc_id are one document, whatever their texts: each gives a row,
    and all their fingerprints link. A null doc_id never names a component, and
    a fingerprint that only such rows have gives a null component. An empty
    table gives no rows. Other columns of ``docs`` are not read.
    """
    fps = written(fingerprints(docs, shingle, seed), "fps")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    named = distinct.filter("node is not null")
    links = near_pairs(named.select("fp", "node"), max_bits, max_bucket, forest=True).unionByName(_same_document(fps, named))
    components = written(connected_components(links), "components")
    # null where rows without a doc_id alone have the fingerprint
    told = distinct.join(components, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    return join_uneven(fps, written(told, "told"), "fp", fps.count()).select("doc_id", "fp", "component_id")


def _same_document(fps: DataFrame, named: DataFrame) -> DataFrame:
    """``a, b``: links of doc_ids that stand at several fingerprints to the nodes of these."""
    several = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("doc_id")
    at = join_checked(fps.filter("doc_id is not null").distinct(), written(several, "several"), "doc_id", "left_semi")
    return at.join(named.select("fp", "node"), "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its near-duplicate class; all columns.

    Rows that repeat such a doc_id all stay, and so do rows without a doc_id.
    """
    gone = near_duplicate_classes(docs, **how).filter("doc_id <> component_id").select("doc_id").distinct()
    return join_checked(docs, written(gone, "gone"), "doc_id", "left_anti")


def near_copies(docs: DataFrame, tenths: int = overlap.TENTHS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class of near copies; all columns.

    Documents link when their sets of five-word shingles have a Jaccard
    similarity of at least ``tenths`` / 10. The trie self-join of the sets'
    SimHashes finds those within ``max_bits`` bits, which are confirmed by their
    sets; what is similar enough but further apart is found and confirmed by
    ``overlap``. Texts without words are near copies of each other. Rows that
    repeat a doc_id share its fate, rows without one stay, other columns are not
    read, an empty table gives no rows.
    """

    def reached(table: DataFrame) -> DataFrame:
        distinct = written(table.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "nodes")
        same = join_uneven(table.select(F.col("node").alias("b"), "fp"), distinct.withColumnRenamed("node", "a"), "fp", table.count())
        return near_pairs(distinct.select("fp", "node"), max_bits, forest=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same.filter("a <> b").select("a", "b"))

    return overlap.near_dedup(docs, tenths, reached)
