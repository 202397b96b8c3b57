"""N-gram Jaccard self-join: T-occurrence search with DivideSkip, and the groups that its links form.

Two texts link when ``100 * |A n B| >= percent * |A u B|`` for their sets A, B of distinct word shingles. The join is
exact: nothing is sampled or capped.

1. Equal sets become one class, known by a 128-bit hash, so copies cost one row each from here on.
2. Blocking. The hash space is cut into ``m`` equal parts, where ``m`` depends on a size class [2^j, 2^(j+1)). If two sets
   link, at most K elements differ, K following from their sizes; each spoils one part, so at least ``m - K`` parts are
   equal in both. Ordering a set's parts by their number of elements, the strongest of the equal parts stands among the
   K + 1 strongest of either set. So K + 1 part hashes of each set (about 0.18 of its size) are posted, and linked sets
   meet in at least one list. Since a part must agree as a whole, passages and words that very many texts share make no
   long lists.
3. Sets that met form blocks (components of the meetings). Each block is searched by DivideSkip: of the inverted lists of
   a set's shingles the longest are put aside, the short ones are merged by a heap that skips (MergeSkip; long merges sort
   the joined runs), and what reaches the reduced threshold is completed by binary probes of the long lists. Candidates that
   are already in one group are not probed: they can add no connection.
4. A block over ``block_shingles`` is dealt into pieces by hash. Each is searched within itself; then its few texts with most
   links are asked of all pieces; then the texts outside the largest group, if any, are. Two texts inside that group need no
   comparison.

Defined results: a null text, or one without words, has an empty set and links with nothing; a text of fewer words than a
shingle is one shingle; repeated rows are copies; other columns are ignored; an empty table gives an empty result. Ids may be
whole numbers or text. A null id is no smallest id: a component or class of rows without ids has the id null.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import batches_of, components, durable, filtered, forest, forgotten, small, written
from ._text import byte_rows, mix, shingles, word_hashes

SHINGLE_WORDS, PERCENT, BLOCK_SHINGLES = 4, 85, 1_500_000
#: Texts of each piece of a large block that are asked of all pieces first.
HEADS = 4
#: Texts that a Python worker holds at once; equal sets of one batch are posted once.
TEXTS_A_BATCH = 2_000

_SCANNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("postings", T.BinaryType())])
_SET = T.StructType([*_SCANNED.fields[:4], T.StructField("shingles", T.BinaryType())])
_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def spoiled(a: int, b: int, percent: int) -> int:
    """The most elements by which linked sets of sizes a and b can differ."""
    return a + b - 2 * -(-percent * (a + b) // (100 + percent))


def most_spoiled(a: int, b: int, percent: int) -> int:
    """The most elements by which linked sets of sizes up to a and b can differ. ``spoiled`` has the parity of a + b and
    rises along each parity only, so the sum below may allow one more."""
    return max(0, spoiled(a, b, percent), spoiled(a, b - 1, percent))


def parts_of(level: int, percent: int) -> int:
    """The number of parts for sets of 2^level to 2^(level+1) - 1 elements: 1.5 times what can be spoiled, at least K + 1."""
    top = most_spoiled((2 << level) - 1, (2 << level) - 1, percent)
    return top + top // 2 + 1


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    k1 = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    k2 = (mix(s + np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xDA942042E4DD58B5)).sum(dtype=np.uint64)
    return int(k1.view(np.int64)), int(k2.view(np.int64))


def part_hashes(s: np.ndarray, percent: int) -> np.ndarray:
    """The hashes under which a set (ascending) is posted: for its own size class, and the next if a partner may be there."""
    n = len(s)
    level, most = n.bit_length() - 1, 100 * n // percent
    out = []
    for at in range(level, most.bit_length()):
        m = parts_of(at, percent)
        keep = most_spoiled(n, min(most, (2 << at) - 1), percent) + 1
        part = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        edge = np.searchsorted(part, np.arange(m + 1))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(s), out=total[1:])
        held = np.diff(edge)
        number = np.lexsort((np.arange(m), -held))[:keep]
        sums = total[edge[number + 1]] - total[edge[number]]
        out.append(mix(sums + mix((number + m * 1_000_003).astype(np.uint64))))
    return np.concatenate(out)


def _scan(size: int, percent: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bucket", pa.int32()), ("postings", pa.binary())])
        for batch in batches:
            rows, posted, keys, seen = [], [], [], set()
            for text in byte_rows(batch.column("text")):
                s = shingles(word_hashes(text), size) if text is not None else ()
                if not len(s):
                    rows.append((0, None, None))
                    continue
                key = set_key(s)
                rows.append((len(s), *key))
                if key not in seen:
                    seen.add(key)
                    posted.append(part_hashes(s, percent))
                    keys.append(np.full(len(posted[-1]), key[0], dtype=np.int64))
            n, k1, k2 = zip(*rows, strict=True) if rows else ((), (), ())
            none = pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), *none], schema=schema)
            if posted:
                pairs = np.stack([np.concatenate(posted).view(np.int64), np.concatenate(keys)], axis=1)
                of = (pairs[:, 0].view(np.uint64) >> np.uint64(40)).astype(np.int64) % buckets
                order = np.argsort(of, kind="stable")
                edge = np.searchsorted(of[order], np.arange(buckets + 1))
                pairs = pairs[order]
                full = np.flatnonzero(np.diff(edge))
                empty = [pa.nulls(len(full), pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*empty, pa.array(full, pa.int32()), pa.array([pairs[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary())], schema=schema)

    return run


def _meet(batch: pa.Table) -> pa.Table:
    """Of one bucket of postings: stars (least key, other key) over the classes that meet in its lists."""
    pairs = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, 2) for x in byte_rows(batch.column("postings"))])
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new_list = np.append(True, pairs[1:, 0] != pairs[:-1, 0])
    first = np.maximum.accumulate(np.where(new_list, np.arange(len(pairs)), 0))
    a, b = pairs[first, 1], pairs[:, 1]
    nodes, roots = forest(a[a != b], b[a != b])
    return pa.table({"a": roots, "b": nodes})


class Lists:
    """Inverted lists over sets that are ordered by size, and DivideSkip searches of them."""

    #: Merges of more elements than this join the runs and sort them instead of keeping a heap.
    HEAP_MOST = 2_000

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        joined = np.concatenate(sets)
        order = np.argsort(joined, kind="stable")
        new = np.append(True, joined[order][1:] != joined[order][:-1])
        self.start = np.append(np.flatnonzero(new), len(joined))
        self.owners = owner[order]
        self.flat = self.owners.tolist()
        number = np.empty(len(joined), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        self.lists = np.split(number, np.cumsum(self.sizes)[:-1])

    def merge_skip(self, runs: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
        """(set, occurrences) of sets that stand in ``least`` of the short lists or more."""
        flat = self.flat
        if sum(e - s for s, e in runs) > self.HEAP_MOST:
            merged = np.sort(np.concatenate([self.owners[s:e] for s, e in runs]), kind="stable")
            found, times = np.unique(merged, return_counts=True)
            yield from zip(found[times >= least].tolist(), times[times >= least].tolist(), strict=True)
            return
        heap = [(flat[s], s, e) for s, e in runs]
        heapq.heapify(heap)
        while len(heap) >= least:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
            if len(popped) >= least:
                yield top, len(popped)
                ahead = top + 1
            else:
                while heap and len(popped) < least - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    return
                ahead = max(top + 1, heap[0][0])
            for _, s, e in popped:
                if (s := bisect_left(flat, ahead, s, e)) < e:
                    heapq.heappush(heap, (flat[s], s, e))

    def partners(self, x: int, low: int, high: int, percent: int, skip) -> Iterator[int]:
        """The sets y in [low, high) that link with x, where ``skip(y)`` tells which need no answer."""
        n, flat = int(self.sizes[x]), self.flat
        need = lambda y: -(-percent * (n + int(self.sizes[y])) // (100 + percent))
        if low >= high:
            return
        runs = [(bisect_left(flat, low, self.start[k], self.start[k + 1]), self.start[k + 1]) for k in self.lists[x]]
        runs = [(s, bisect_left(flat, high, s, e)) for s, e in runs if s < e]
        runs = sorted((r for r in runs if r[0] < r[1]), key=lambda r: r[0] - r[1])
        least = need(low)
        if len(runs) < least:
            return
        aside = min(least - 1, int(least / (1 + 0.01 * np.log2(1 + runs[0][1] - runs[0][0]))))
        for y, times in self.merge_skip(runs[aside:], least - aside):
            if y == x or skip(y):
                continue
            left = need(y) - times
            for k in range(aside):
                if left <= 0 or left > aside - k:
                    break
                at = bisect_left(flat, y, *runs[k])
                left -= at < runs[k][1] and flat[at] == y
            if left <= 0:
                yield y


def search(sets: list[np.ndarray], percent: int, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets: a spanning forest of the link graph (of links that touch an asked set, if given)."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    lists, parent, links = Lists([sets[k] for k in order]), list(range(len(sets))), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for x in range(len(sets)):
        n = int(lists.sizes[x])
        high = int(np.searchsorted(lists.sizes, 100 * n // percent, side="right"))
        if asked is None:
            low = x + 1
        elif asked[order[x]]:
            low = int(np.searchsorted(lists.sizes, -(-percent * n // 100)))
        else:
            continue
        for y in lists.partners(x, low, high, percent, lambda y, x=x: root(y) == root(x)):
            parent[root(y)] = root(x)
            links.append((int(order[x]), int(order[y])))
    return links


def _search_blocks(percent: int):
    """Rows (block, id, asked or null, shingles) of one task, which may hold many blocks: the links of each block."""

    def run(batch: pa.Table) -> pa.Table:
        block, ids = batch.column("block").to_numpy(), batch.column("id").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in byte_rows(batch.column("shingles"))]
        asked = batch.column("asked").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(block, kind="stable")
        out = [np.zeros((0, 2), dtype=np.int64)]
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            some = asked[rows]
            links = search([sets[k] for k in rows], percent, None if some[0] < 0 else some > 0)
            if links:
                out.append(ids[rows][np.array(links)])
        out = np.concatenate(out)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in byte_rows(batch.column("text")):
                s = shingles(word_hashes(text), size) if text is not None else np.zeros(0, dtype=np.uint64)
                rows.append((len(s), *set_key(s), s.tobytes()))
            n, k1, k2, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(s, pa.binary())], names=_SET.names)

    return run


def _links(sets: DataFrame, percent: int, most: int, tasks: int) -> DataFrame:
    """Links (a, b) of class ids that connect what is linked, from rows (id, block, n_shingles, shingles)."""
    weight = sets.groupBy("block").agg(F.sum("n_shingles").alias("weight"))
    sets = sets.join(weight, "block")
    run = lambda df: df.groupBy("task").applyInArrow(_search_blocks(percent), _LINK)
    one = sets.where(F.col("weight") <= most)
    links = run(one.select(F.pmod(F.xxhash64("block"), F.lit(tasks)).alias("task"), "block", "id", F.lit(-1).alias("asked"), "shingles"))
    large = sets.where(F.col("weight") > most)
    if large.isEmpty():
        return links
    large = durable(large.withColumn("of", F.ceil(2 * F.col("weight") / most).cast("int")).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("of")).cast("int")))
    within = durable(run(large.select(F.xxhash64("block", "piece").alias("task"), F.xxhash64("block", "piece").alias("block"), "id", F.lit(-1).alias("asked"), "shingles")))
    # The texts with most links of each piece are asked of every piece. A text that many others were made from links them all,
    # though they may not link with one another.
    degree = within.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    first = F.row_number().over(W.partitionBy("block", "piece").orderBy(F.desc("links"), "id"))
    heads = large.select("block", "piece", "id").join(degree, "id").withColumn("place", first).where(F.col("place") <= HEADS)
    across = durable(run(_against(large, large.join(heads.select("id"), "id", "left_semi"), most)).union(within))
    group = large.select("block", "id").join(components(across), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    main = group.groupBy("block", "root").count().groupBy("block").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    rest = group.join(main, "block").where("root <> main").select("id")
    return links.union(across).union(run(_against(large, large.join(rest, "id", "left_semi"), most)))


def _against(all_sets: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """Tasks in which the asked sets of a block, half a task's worth at a time, meet each piece of the block."""
    share = asked.groupBy("block").agg(F.ceil(2 * F.sum("n_shingles") / most).cast("int").alias("shares"))
    share = share.select("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("by"), "shares")
    asked = asked.join(share, "block").where(F.pmod(F.xxhash64(F.lit(1), "id"), F.col("shares")) == F.col("by"))
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    task = F.xxhash64("block", "by", "piece")
    rows = all_sets.join(share, "block").select(task.alias("task"), "id", F.lit(0).alias("asked"), "shingles")
    rows = rows.union(asked.select(task.alias("task"), "id", F.lit(1).alias("asked"), "shingles"))
    return rows.select("task", F.col("task").alias("block"), "id", "asked", "shingles")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, class_id), one for each row of ``docs``.

    ``component_id`` is the smallest id that links reach, ``class_id`` the smallest id with an equal set.
    """
    whole = docs.schema[id_col].dataType in (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType())
    if not whole or not docs.where(F.col(id_col).isNull()).isEmpty():
        return _by_row(docs, id_col, text_col, shingle_words, percent, block_shingles)
    return _by_id(docs, id_col, text_col, shingle_words, percent, block_shingles)


def _by_row(docs: DataFrame, id_col: str, text_col: str, *options) -> DataFrame:
    """Components of rows whose ids are not whole numbers, or null: the rows are numbered and written first."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")))
    found = durable(_by_id(rows, "_row", "_text", *options).join(rows.select("_row", "_id"), F.col("doc_id") == F.col("_row")).drop("doc_id"))
    for c in ("component_id", "class_id"):
        least = durable(found.groupBy(F.col(c).alias("_of")).agg(F.min("_id").alias("_least")))
        found = found.join(small(least), F.col(c) == F.col("_of")).withColumn(c, F.col("_least")).drop("_of", "_least")
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "class_id")


def _by_id(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int, block_shingles: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    buckets = 4 * tasks
    with batches_of(spark, TEXTS_A_BATCH):
        scanned = durable(texts.mapInArrow(_scan(shingle_words, percent, buckets), _SCANNED))
    rows = durable(scanned.where("bucket is null").select("doc_id", "n_shingles", "k1", "k2"))
    classes = durable(rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id")))
    met = components(scanned.where("bucket is not null").select("bucket", "postings").groupBy("bucket").applyInArrow(_meet, _LINK))
    forgotten(scanned)
    found = durable(classes.join(met, F.col("k1") == F.col("node")).select("class_id", F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("root").alias("block")))
    n = found.count()
    asked = filtered(texts, "doc_id", found.select("class_id"), "left_semi").select("doc_id", "text")
    sets = asked.mapInArrow(_sets(shingle_words), _SET)
    sets = sets.join(small(found, n), (F.col("doc_id") == F.col("class_id")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    sets = sets.select(F.col("class_id").alias("id"), "block", "n_shingles", "shingles").dropDuplicates(["id"])
    with batches_of(spark, TEXTS_A_BATCH):
        sets = durable(sets)
    groups = components(_links(sets, percent, block_shingles, tasks))
    forgotten(sets)
    members = classes.join(groups, F.col("class_id") == F.col("node"), "left").select("k1", "k2", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    out = rows.join(members, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) with one document of each group: that of the smallest id, or of null
    if none has an id. Texts without words stay."""
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint") and docs.where("doc_id is null").isEmpty():
        verdict = durable(ngram_components(docs, **options))
        kept = filtered(docs, "doc_id", verdict.where("doc_id <> component_id").select("doc_id"), "left_anti")
        twice = verdict.where("n_shingles > 0 and doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
        if twice.isEmpty():
            return kept
        # Repeated rows share an id and a set: one of each stays.
        return filtered(kept, "doc_id", twice, "left_anti").unionByName(filtered(kept, "doc_id", twice, "left_semi").dropDuplicates(["doc_id"]))
    packed = written(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.monotonically_increasing_id().alias("_key")))
    verdict = _by_id(packed, "_key", "text", *({"shingle_words": SHINGLE_WORDS, "percent": PERCENT, "block_shingles": BLOCK_SHINGLES} | options).values())
    named = durable(verdict.select(F.col("doc_id").alias("_key"), "n_shingles", "component_id").join(packed.select("_key", "doc_id"), "_key"))
    first = named.where("n_shingles > 0").groupBy("component_id").agg(F.min_by("_key", F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("_key"))
    keys = durable(first.select("_key").union(named.where("n_shingles = 0").select("_key")))
    return filtered(packed, "_key", keys, "left_semi").select("_row.*")
