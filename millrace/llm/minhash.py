"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Documents become sets of word shingles; equal sets collapse to their smallest id.
2. *Forest*: TREES orders of the signature. Each order sorts all representatives by DEPTH hashes
   and is range-partitioned, so a region that holds a third of all rows is many partitions.
   Rows sharing at least BASE leading hashes are candidates: small regions in full; larger ones
   adaptively, each row with its neighbours of the longest common prefix and with the region's
   hub, and again one hash deeper until regions are small.
3. *Regions*: candidates whose signatures agree on LOOSE of the hashes are joined to coarse
   components. They only say which documents have to be compared.
4. *Exact links*: within a region, full shingle sets are compared - the document closest to the
   region's commonest hashes first, as it links most of a group of near copies at once - skipping
   only pairs already connected, or whose signatures differ far beyond chance. Regions larger
   than one task are dealt into blocks which share a hub; what the hub does not connect is
   compared with every block.
5. Components of the links give each document its class.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .bpe import texts
from .common import BLANKS, discard, saved
from .graph import components

TREES, BASE, DEPTH = 24, 4, 12
HASHES = TREES * BASE
#: Signature agreement that joins candidates to a region, and the least one that is compared exactly (0.8 less 4.9 standard errors).
LOOSE, SLACK = 0.5, 0.2
#: Regions up to this size give all their pairs as candidates.
SMALL = 8
#: Documents and shingles of a block, which one task holds.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 2_000_000
#: Bytes of text whose words are hashed in one go.
SLICE = 1 << 18
#: Rows of the sorted orders that are paired in one go.
CHUNK = 65_536

_RNG = np.random.default_rng(1)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_STEP = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(0, 1 << 61)) * 8 + 5
_UP, _DOWN = powers(_BASE, SLICE), powers(pow(_BASE, -1, 1 << 64), SLICE)


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the blank-separated words of UTF-8 bytes."""
    blank = np.concatenate([[True], _BLANK[raw], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """Of the blank-separated words of A-Z-lower-cased UTF-8 text: differences of running sums of byte values times powers, so one pass hashes all words.

    The sums start anew in slices of about SLICE bytes, cut between words; a longer word has a slice of its own.
    """
    raw = np.frombuffer(data.lower(), dtype=np.uint8)
    starts, ends = bounds(raw)
    out, done = np.zeros(len(starts), dtype=np.uint64), 0
    while done < len(starts):
        low = starts[done]
        last = max(done + 1, int(np.searchsorted(ends, low + SLICE, side="right")))
        part = raw[low : ends[last - 1]]
        up, down = (_UP, _DOWN) if len(part) <= SLICE else (powers(_BASE, len(part)), powers(pow(_BASE, -1, 1 << 64), len(part)))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[done:last] - low, ends[done:last] - low
        out[done:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        done = last
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words; of the whole sequence where it is shorter."""
    n = min(width, len(hashes))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = out + hashes[i : len(hashes) - n + 1 + i] * _STEP[i]
    return mix(out)


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(windows(word_hashes(data), width))


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima of 32 bits."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 1024):
        best = np.minimum(best, (_A[:, None] * s[None, i : i + 1024] + _B[:, None]).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32)


def short(sig: np.ndarray) -> np.ndarray:
    """A byte of each hash, for estimates."""
    return (sig & np.uint32(0xFF)).astype(np.uint8)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of short signatures, corrected for chance agreement of bytes."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, hash of the text, n, digest of the set (null without shingles), signature."""
    schema = StructType([StructField("id", LongType()), StructField("th", LongType()), StructField("n", LongType()), StructField("digest", BinaryType()), StructField("sig", BinaryType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, digests, sigs = [], [], []
            for data in texts(batch.column(2)):
                s = shingles(data, width)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "th", "n", "digest", "sig"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col)).mapInArrow(run, schema)


def order_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, TREES, DEPTH) big-endian: order t starts with its own BASE hashes and goes on around the signature."""
    at = (np.arange(TREES)[:, None] * BASE + np.arange(DEPTH)[None, :]) % HASHES
    return sigs[:, at].astype(">u4")


def trees(reps: DataFrame) -> DataFrame:
    """tree, key, id: every representative in every order."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for i in range(0, len(ids), 1000):
                part = ids[i : i + 1000]
                sigs = np.frombuffer(b"".join(batch.column(1)[i : i + 1000].to_pylist()), dtype=np.uint32).reshape(len(part), HASHES)
                keys = order_keys(sigs).reshape(len(part) * TREES, DEPTH)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(part))), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(np.repeat(part, TREES))], names=["tree", "key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "tree int, key binary, id long")


def region_pairs(tree: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (positions i, j) of rows sorted by tree and key, and the hub of each row's region.

    A region is a run of rows that share BASE hashes. All pairs of a region of up to SMALL rows; of
    a larger one each row with the next and with the hub, and so again for the regions one hash
    deeper. A region's hub is that of its largest part, so hubs of nested regions mostly agree.
    """
    n = len(tree)
    same = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    same[tree[1:] != tree[:-1]] = 0
    shared = np.concatenate([[0], same])  # hashes shared with the row before
    at = np.arange(n)
    beside = np.flatnonzero(shared >= BASE)
    found, paired, parts = [(beside, beside - 1)], np.full(n, -1), None
    for depth in range(DEPTH, BASE - 1, -1):
        start = shared < depth
        start[0] = True
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, n))
        region = np.cumsum(start) - 1
        if parts is None:
            hub = first
        else:
            above, most, its = parts  # first rows, sizes and hubs of the parts one hash deeper
            owner = region[above]
            by = np.lexsort((above, -most, owner))
            hub = its[by[np.searchsorted(owner[by], np.arange(len(first)))]]
        parts = first, size, hub
        hub, size = hub[region], size[region]
        large = (size > SMALL) & (hub != paired) & (hub != at)
        found.append((at[large], hub[large]))
        paired = np.where(size > SMALL, hub, paired)
        few = (size > 1) & (size <= SMALL)
        if depth > BASE:  # those in a region that is small itself come with it
            outer = np.concatenate([np.flatnonzero((shared < depth - 1) | (at == 0)), [n]])
            few &= np.repeat(np.diff(outer), np.diff(outer)) > SMALL
        for k in range(2, SMALL):
            i = np.flatnonzero(few[k:] & (region[k:] == region[:-k])) + k
            found.append((i, i - k))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found]), hub


def links_of_orders(rows: DataFrame) -> DataFrame:
    """kind 0: candidate (a, b). kind 1: (tree, key, a) where a region may go on in another partition."""
    schema = "kind int, tree int, key binary, a long, b long"

    def run(batches):
        import pyarrow as pa

        def out(kind, tree, keys, a, b):
            raw = [None] * len(a) if keys is None else [k.tobytes() for k in keys]
            none = [None] * len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(none if tree is None else tree, pa.int32()), pa.array(raw, pa.binary()),
                                               pa.array(a, pa.int64()), pa.array(none if b is None else b, pa.int64())], names=["kind", "tree", "key", "a", "b"])

        def edge(tree, keys, ids, hub, low, high):
            few = np.unique(np.concatenate([hub[low:low + 1], np.arange(low, min(low + SMALL, high)), np.arange(max(low, high - SMALL), high)]))
            return few, out(1, tree[few], keys[few], ids[few], None)

        def chunks():
            held, n = [], 0
            for batch in batches:
                if batch.num_rows:
                    keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u4").reshape(-1, DEPTH)
                    held.append((np.array(batch.column(0)), keys, np.array(batch.column(2))))
                    n += batch.num_rows
                if n >= CHUNK:
                    yield held
                    held, n = [], 0
            if held:
                yield held

        before = None  # of the region that goes on: its hub, first and last rows
        last = None
        for held in chunks():
            tree, keys, ids = (np.concatenate(x) for x in zip(*([before] if before else []), *held, strict=True))
            i, j, hub = region_pairs(tree, keys)
            yield out(0, None, None, np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j]))
            begins = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (keys[1:, :BASE] != keys[:-1, :BASE]).any(axis=1)]))
            ends = np.append(begins, len(tree))
            if before is None:
                yield edge(tree, keys, ids, hub, ends[0], ends[1])[1]
            few, last = edge(tree, keys, ids, hub, ends[-2], ends[-1])
            before = tree[few], keys[few], ids[few]
        if last is not None:
            yield last

    return rows.mapInArrow(run, schema)


def agreeing(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree on at least that share."""
    sig = reps.select("id", "sig8")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(agreement(x, y) >= least))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def resolve(sets: list[np.ndarray], classes: np.ndarray, probe: np.ndarray, percent: int) -> np.ndarray:
    """Classes after comparing every pair of different classes with a probing member, by number."""
    n = len(sets)
    sigs = np.array([short(signature(s)) for s in sets])
    sizes = np.array([len(s) for s in sets])
    commonest = np.array([np.bincount(c, minlength=256).argmax() for c in sigs.T])
    order = np.argsort(-(sigs == commonest).sum(axis=1), kind="stable")
    sigs, sizes, classes, probe = sigs[order], sizes[order], classes[order].copy(), probe[order]
    floor = max(0.0, percent / 100 - SLACK)
    for u in range(n - 1):
        later = np.flatnonzero((classes[u + 1 :] != classes[u]) & (probe[u + 1 :] | probe[u])) + u + 1
        if not len(later):
            continue
        fits = 100 * np.minimum(sizes[later], sizes[u]) >= percent * np.maximum(sizes[later], sizes[u])
        later = later[fits]
        near = agreement(sigs[later], sigs[u])
        later, near = later[near >= floor], near[near >= floor]
        for v in later[np.argsort(-near, kind="stable")]:
            if classes[v] != classes[u] and similar(sets[order[u]], sets[order[v]], percent):
                low, high = sorted((classes[u], classes[v]))
                classes[classes == high] = low
    back = np.empty(n, dtype=np.int64)
    back[order] = classes
    return back


def resolved(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """rows: region, block, id, cls, probe, text. Links (a, b) of each block's members to their class."""

    def run(key, table):
        import pyarrow as pa

        ids = np.array(table.column("id").to_pylist(), dtype=np.int64)
        cls = np.array(table.column("cls").to_pylist(), dtype=np.int64)
        probe = np.array(table.column("probe").to_pylist(), dtype=bool)
        sets = [shingles(data, width) for data in texts(table.column("text").combine_chunks())]
        out = resolve(sets, cls, probe, percent)
        return pa.table({"a": pa.array(ids), "b": pa.array(out)})

    return rows.select("region", "block", "id", "cls", "probe", "text").groupBy("region", "block").applyInArrow(run, "a long, b long")


def near_links(df: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame | None:
    """id, root over representatives that link with another; None without candidates."""
    rows = trees(reps).repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = saved(links_of_orders(rows), "orders")
    border = found.filter("kind = 1").select("tree", "key", F.col("a").alias("id")).distinct()
    # At most 2 * (2 * SMALL + 1) rows of each partition; regions cut by a partition's end meet again by their prefix.
    again = links_of_orders(border.repartition(F.col("tree"), F.substring("key", 1, 4 * BASE)).sortWithinPartitions("tree", "key", "id"))
    pairs = found.filter("kind = 0").select("a", "b").unionByName(again.filter("kind = 0").select("a", "b")).distinct()
    coarse = saved(agreeing(pairs, reps, LOOSE), "coarse")
    discard(found)
    if not coarse.limit(1).count():
        return None
    regions = components(coarse).select("id", F.col("root").alias("region"))
    degree = coarse.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    members = saved(regions.join(reps.select("id", "n", "th"), "id").join(degree, "id"), "members")
    sizes = members.groupBy("region").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub"))
    text = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    placed = members.select("id", "th", "region").join(sizes, "region")
    # Always by a shuffle: a broadcast of the members where they are few would not outlast growth.
    rows = saved(placed.hint("merge").join(text, ["id", "th"]).dropDuplicates(["id", "th"]).drop("th"), "region_texts")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    at = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    first = rows.withColumn("block", F.explode(at)).withColumns({"cls": F.col("id"), "probe": F.lit(True)})
    links = saved(resolved(first, width, percent), "links")
    large = rows.filter("blocks > 1")
    if not large.limit(1).count():
        return links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    # Blocks of a large region meet through its hub. What is not of its largest class is compared with all of it.
    classes = components(links)
    known = large.join(classes, "id", "left").withColumn("cls", F.coalesce("root", "id")).drop("root")
    known = saved(known, "known")
    biggest = known.groupBy("region", "cls").agg(F.count(F.lit(1)).alias("size")).groupBy("region").agg(F.max_by("cls", F.struct("size", -F.col("cls"))).alias("main"))
    known = known.join(biggest, "region").withColumn("probe", F.col("cls") != F.col("main"))
    outside = known.filter("probe").groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("chunks"))
    known = known.join(outside, "region").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(2)), F.col("chunks")).cast("int"))
    as_member = known.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("block", F.col("mine") * F.col("chunks") + F.col("c"))
    as_probe = known.filter("probe").withColumn("m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("block", F.col("m") * F.col("chunks") + F.col("chunk"))
    columns = ["region", "block", "id", "cls", "probe", "text"]
    grid = as_member.select(columns).unionByName(as_probe.select(columns)).dropDuplicates(["region", "block", "id"])
    more = saved(resolved(grid, width, percent), "more")
    return components(links.unionByName(more).unionByName(known.select(F.col("id").alias("a"), F.col("cls").alias("b"))))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are runs of non-blanks after lower-casing A-Z; a text of fewer than ``width`` words is
    one shingle; null or blank text has none, links with nothing and is kept. Documents link
    where the Jaccard similarity of their sets is percent/100 or more; component_id is the
    smallest id reachable. Repeated rows of one id are all kept if the id is; of different texts
    under one id one (by hash) is compared, and the others share its class. A null id links with nothing and its component is null. Ids must be
    integers. Other columns are not read. An empty table gives an empty result.
    """
    known = saved(sketches(df, id_col, text_col, width), "sketches")
    sets = known.filter("digest IS NOT NULL AND id IS NOT NULL")
    one = sets.groupBy("digest").agg(F.min("id").alias("rep"))
    # Copies collapse before anything else; from here on there is one row per distinct set.
    picked = sets.join(one.withColumnRenamed("rep", "id"), ["digest", "id"]).groupBy("id").agg(F.min(F.struct("th", "n", "digest", "sig")).alias("s")).select("id", "s.*")

    def shorten(batches):
        import pyarrow as pa

        for batch in batches:
            sigs = [short(np.frombuffer(s, dtype=np.uint32)).tobytes() for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs, pa.binary())], names=["id", "th", "n", "sig", "sig8"])

    reps = saved(picked.select("id", "th", "n", "sig").mapInArrow(shorten, "id long, th long, n long, sig binary, sig8 binary"), "reps")
    labels = near_links(df, reps, id_col, text_col, width, percent)
    classes = one.withColumn("component", F.col("rep"))
    if labels is not None:
        classes = one.join(labels.groupBy("id").agg(F.min("root").alias("root")).withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("root", "rep"))
    out = known.select("id", "n", "digest").join(classes.select("digest", "component"), "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component", "id"))
    by_id = out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id"),
                       F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return by_id


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of df whose id is kept, with df's columns whatever their names."""
    gone = near_dedup(df, id_col, text_col, **kwargs).filter(~F.col("kept")).select(F.col(id_col).alias("gone_id")).distinct()
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    return rows.join(gone.hint("merge"), F.col("id") == F.col("gone_id"), "left_anti").select("row.*")
