"""Near copies by exact Jaccard similarity of word shingles, for operator 10 beyond what its fingerprints reach.

Fingerprints of pairs at a similarity of 0.8 differ in about ten of 64 bits, a
budget at which a trie prunes next to nothing. So the trie's links, which
``simhash.near_copies`` gives, come first, and a set-similarity join completes
them: two sets of similarity t or more share at least ``ceil(t * n)`` of the n
shingles of either, so under any one order of all shingles, each has one of the
shared in its first ``n - ceil(t * n) + 1``. Documents meet in buckets of these,
and the pairs that meet are confirmed by the exact similarity: none is lost,
none is added. Shingles that are frequent in a sample come last in the order,
which keeps buckets small; what the sample holds changes the cost, never the
result.

Only classes are wanted. The trie's links make the first ones, and a bucket
of one class goes no further: what the trie has joined isn't joined again. In
the others, a bucket's documents are compared to its least one, if of another
class, which unites a group of near copies by as many pairs as it has members;
then, in the buckets of several classes, all pairs of different ones are
compared by their sketches. Of those that the sketches can't tell apart each
document's closest is compared by the sets, again and again, as long as that
unites enough classes: at most a pair for each document, so a group that links in
many ways does not give all of its pairs. What is still in different classes
then, and can't be told apart, is compared by the sets pair by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_checked, written
from .components import few_components

SHINGLE, TENTHS = 5, 8
#: Documents sampled for the order, and shingles that count as frequent, by at least so many of these documents.
SAMPLED, MOST_FREQUENT, FREQUENT = 16_000, 50_000, 4
#: Most words (of 64 bits) of a sketch in a bucket.
SHORT = 32
#: Keys before a row's own, of the same node, by which a pair that has met before is told.
BEFORE = 8
#: Pairs of a bucket that are held at a time.
PIECE = 1_000_000
#: Rounds of closest pairs go on while one in so many of them is a link; what is left over is compared all the same.
WORTH = 10


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, sorted, of a text's runs of ``shingle`` words; fewer words are one run."""
    words = text.lower().split()
    digest = xxhash.xxh64_digest
    runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    return np.unique(np.frombuffer(b"".join(map(digest, runs)), np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").cast("binary").alias("text")).filter("node is not null")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``node, have``: each named document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py() or b"") for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)])
                have = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), have], ["node", "have"])

    return _texts(docs).mapInArrow(run, "node long, have array<long>")


def _frequent(docs: DataFrame) -> np.ndarray:
    """``(hash, count)`` of the shingles that are frequent in a sample of the documents, sorted by hash."""
    named = docs.filter("doc_id is not null")
    every = max(1, named.count() // SAMPLED)
    some = shingle_sets(named.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), F.lit(every)) == 0))
    top = some.select(F.explode("have").alias("h")).groupBy("h").count().filter(F.col("count") >= FREQUENT).orderBy(F.col("count").desc(), "h").limit(MOST_FREQUENT)
    return np.array(sorted((r[0], r[1]) for r in top.collect()), np.int64).reshape(-1, 2)


def majority(have: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed long: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(have), 65_536):
        ones += np.unpackbits(have[at : at + 65_536].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(have)).tobytes(), "big", signed=True)


def drawn(docs: DataFrame, tenths: int) -> DataFrame:
    """``node, n, keys, bits, fp`` of each named document: its set's size, prefix, sketch and SimHash."""
    frequent = _frequent(docs)

    def prefix(have: np.ndarray) -> np.ndarray:
        n = len(have)
        rank = np.zeros(n, np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent[:, 0], have), len(frequent) - 1)
            rank = np.where(frequent[at, 0] == have, frequent[at, 1], 0)
        return have[np.lexsort((have, rank))[: n - -(-tenths * n // 10) + 1]]

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py() or b"") for t in part.column(1)]
                n, fp = pa.array([len(s) for s in sets], pa.int32()), pa.array([majority(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, lists([prefix(s) for s in sets]), lists([sketch(s) for s in sets]), fp], ["node", "n", "keys", "bits", "fp"])

    return _texts(docs).mapInArrow(run, "node long, n int, keys array<long>, bits array<long>, fp long")


def _buckets(of: Callable[[pa.Table, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]):
    """Apply ``of(table, starts, ends)`` to a partition's rows, sorted by key, whole buckets at a time."""

    def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key = table["key"].to_numpy()
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        yield from of(table, np.concatenate([[0], change]), np.concatenate([change, [len(key)]]))

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
                yield from each(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from each(pa.Table.from_batches(held))

    return run


def _shared(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    several = np.repeat(ends - starts > 1, ends - starts)
    if several.any():
        yield from table.filter(pa.array(several)).combine_chunks().to_batches()


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _near(x: np.ndarray, y: np.ndarray, tenths: int) -> np.ndarray:
    return 10 * np.minimum(x, y).astype(np.int64) >= tenths * np.maximum(x, y).astype(np.int64)


def _hubs(tenths: int):
    """Pairs of a bucket's least node and each of its others of other classes whose sizes allow the similarity."""

    def of(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, n, c = (table[x].to_numpy() for x in ("node", "n", "component"))
        hub = np.repeat(starts, ends - starts)  # rows are sorted by node within a bucket
        keep = (c != c[hub]) & _near(n, n[hub], tenths)
        yield from _pairs(node[hub][keep], node[keep])

    return of


def _mixed(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of buckets of several classes."""
    c = table["component"].to_numpy()
    mixed = np.repeat(np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts), ends - starts)
    if mixed.any():
        yield from table.filter(pa.array(mixed)).combine_chunks().to_batches()


def _candidates(table: pa.Table, starts: np.ndarray, ends: np.ndarray, tenths: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row i, the later rows j of its bucket of other classes whose sizes and sketches allow the similarity, and how far these differ, of the sizes.

    Sizes and sketches are the same in each bucket where a pair meets, so it is
    left to an earlier one if both nodes' rows name that: the first is never
    skipped, and of the others few are left.
    """
    key, n, c = (table[x].to_numpy() for x in ("key", "n", "component"))
    before = table["before"].combine_chunks()
    met = np.repeat(key[:, None], BEFORE, axis=1)  # the own key where there are fewer before
    met[np.arange(BEFORE) < before.value_lengths().to_numpy()[:, None]] = before.flatten().to_numpy()
    bits = table["bits"].combine_chunks()
    words, at = bits.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(bits.value_lengths().to_numpy())])
    most = (10 - tenths) / (10 + tenths)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        size = at[s + 1 : e + 1] - at[s:e]
        # sketches are put in one table for each length; pairs of other lengths are left to the next step
        by = {int(k): np.flatnonzero(size == k) for k in np.unique(size)}
        own = {k: words[(at[s + rows][:, None] + np.arange(k))] for k, rows in by.items()}
        for i in range(s, e - 1):
            k = int(size[i - s])
            near = (c[i + 1 : e] != c[i]) & _near(n[i + 1 : e], n[i], tenths)
            if not near.any():
                continue
            later = by[k][by[k] > i - s]
            differ = np.bitwise_count(own[k][len(by[k]) - len(later) :] ^ words[at[i] : at[i + 1]]).sum(axis=1, dtype=np.int64)
            both = n[s + later].astype(np.int64) + int(n[i])
            near[later - (i - s) - 1] &= (10 + tenths) * differ <= (10 - tenths) * both
            apart = np.full(len(near), most)
            apart[later - (i - s) - 1] = differ / both
            j = np.flatnonzero(near)
            j = j[~np.isin(met[i + 1 + j], met[i][met[i] != key[i]]).any(axis=1)]
            if len(j):
                yield i, i + 1 + j, apart[j]


def _nearest(tenths: int):
    """The rows that have candidates in their bucket, each with the node that differs least, ``best``, and how far: no more rows than come in."""

    def of(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = table["node"].to_numpy()
        best, least = np.full(len(node), -1), np.full(len(node), np.inf)
        for i, j, apart in _candidates(table, starts, ends, tenths):
            if apart.min() < least[i]:
                best[i], least[i] = j[apart.argmin()], apart.min()
            closer = apart < least[j]
            best[j[closer]], least[j[closer]] = i, apart[closer]
        has = np.flatnonzero(best >= 0)
        if len(has):
            yield from table.take(pa.array(has)).append_column("best", pa.array(node[best[has]])).append_column("apart", pa.array(least[has])).combine_chunks().to_batches()

    return of


def _apart(tenths: int):
    """All pairs of a bucket's candidates."""

    def of(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = table["node"].to_numpy()
        a, b, held = [], [], 0
        for i, j, _ in _candidates(table, starts, ends, tenths):
            a.append(np.full(len(j), node[i]))
            b.append(node[j])
            held += len(j)
            if held > PIECE:
                yield from _pairs(np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
        if held:
            yield from _pairs(np.concatenate(a), np.concatenate(b))

    return of


def sketch(have: np.ndarray) -> np.ndarray:
    """The parity of a set's hashes by each value of their low bits, at least two values for each hash, as longs."""
    bins = max(64, 1 << (2 * len(have) - 1).bit_length())
    odd = np.bincount(have & (bins - 1), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(bits: Column, size: Column) -> Column:
    """``bits``, or if they are longer than ``size`` their halves put together: the sketch by one bit less."""
    half = (F.size(bits) / 2).cast("int")
    return F.when(F.size(bits) > size, F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(bits)


def _confirmed(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, tenths: int) -> DataFrame:
    """The pairs ``a, b`` whose sets have a Jaccard similarity of at least ``tenths`` / 10.

    Sketches differ in no more bits than sets in shingles, so pairs whose
    sketches differ too much can't have it; sets are moved for the others only.
    """
    both = pairs.join(sketches.toDF("a", "m", "x"), "a").join(sketches.toDF("b", "n", "y"), "b")
    least = F.least(F.size("x"), F.size("y"))
    differ = F.aggregate(F.zip_with(_folded(F.col("x"), least), _folded(F.col("y"), least), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    may = written(both.filter((10 + tenths) * differ <= (10 - tenths) * (F.col("m") + F.col("n"))).select("a", "b").distinct(), "may")
    ids = written(may.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "met")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(shingle_sets(join_checked(named, ids, "doc_id", "left_semi")), "sets")
    both = may.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(10 * shared >= tenths * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def _short(bits: Column, n: Column) -> Column:
    """A sketch folded to the least length of at least n bits, or to ``SHORT`` words if that is less."""
    size = F.least(F.lit(SHORT), F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(n / 64))))).cast("int")
    return F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.aggregate(F.sequence(j, F.size(bits) - 1, size), F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.get(bits, i))))


def near_pair_classes(docs: DataFrame, tenths: int = TENTHS, reached: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node, component``: the documents of ``docs(doc_id, text)`` that have near copies, component the least doc_id that links reach.

    Documents link when their sets of five-word shingles, A-Z lower-cased, have
    a Jaccard similarity of at least ``tenths`` / 10. Sets are of 64-bit hashes.
    Texts without words have one and the same set. Repeated doc_ids are one
    document, rows without one have no part. Other columns are not read.
    ``reached`` may give pairs ``a, b`` of the table ``drawn`` that are likely to link, as trees; they are confirmed first, and only what they leave in different classes is joined.
    """
    table = written(drawn(docs, tenths), "drawn")
    rows = table.select(F.explode("keys").alias("key"), "node", "n").repartition("key").sortWithinPartitions("key", "node")
    shared = written(rows.mapInArrow(_buckets(_shared), "key long, node long, n int"), "shared")
    sketches = table.select("node", "n", "bits")

    def met(rows: DataFrame, of, schema: str = "a long, b long") -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_buckets(of), schema)

    def mixed_rows(rows: DataFrame, classes: DataFrame) -> DataFrame:
        marked = join_checked(rows.select("key", "node", "n"), classes, "node").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
        return written(met(marked, _mixed, "key long, node long, n int, component long"), "mixed")

    def united(links: DataFrame, classes: DataFrame) -> DataFrame:
        return written(few_components(written(classes.toDF("a", "b").unionByName(links), "links")), "classes")

    first = written(reached(table).distinct() if reached else table.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "reached")
    classes = united(_confirmed(first, docs, sketches, tenths), first.toDF("node", "component").limit(0))
    several = mixed_rows(shared, classes)
    hubs = written(met(several, _hubs(tenths)).distinct().join(first, ["a", "b"], "left_anti"), "hubs")
    classes = united(_confirmed(hubs, docs, sketches, tenths), classes)
    mixed = mixed_rows(several, classes)
    tried = first.unionByName(hubs)
    short = sketches.select("node", _short(F.col("bits"), F.col("n")).alias("bits"))
    # by size too: a doc_id may stand for several texts
    earlier = F.collect_list("key").over(Window.partitionBy("node", "n").orderBy("key").rowsBetween(-BEFORE, -1))
    columns = "key long, node long, n int, component long, before array<long>, bits array<long>"
    rows = mixed.join(short, "node").withColumn("before", earlier).select("key", "node", "n", "component", "before", "bits")
    while True:
        left = written(met(rows, _nearest(tenths), f"{columns}, best long, apart double"), "left")
        rows = left.drop("best", "apart")
        least = left.groupBy("node").agg(F.min_by("best", "apart").alias("best")).select(F.least("node", "best").alias("a"), F.greatest("node", "best").alias("b"))
        best = written(least.distinct().join(tried, ["a", "b"], "left_anti"), "best")
        if not (pairs := best.count()):
            break
        links = written(_confirmed(best, docs, sketches, tenths), "links")
        tried, classes = tried.unionByName(best), united(links, classes)
        rows = join_checked(rows.drop("component"), classes, "node").select("key", "node", "n", F.coalesce("component", "node").alias("component"), "before", "bits")
        if WORTH * links.count() < pairs:
            break
    rest = written(met(rows, _apart(tenths)).distinct().join(tried, ["a", "b"], "left_anti"), "apart")
    discard(shared, several, mixed)
    return classes if rest.isEmpty() else united(_confirmed(rest, docs, sketches, tenths), classes)


def near_dedup(docs: DataFrame, tenths: int = TENTHS, reached: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class; all columns.

    Rows that repeat such a doc_id all stay, and so do rows without a doc_id.
    """
    gone = near_pair_classes(docs, tenths, reached).filter("node <> component").select(F.col("node").alias("doc_id")).distinct()
    return join_checked(docs, written(gone, "gone"), "doc_id", "left_anti")
