"""SimHash near-dedup with BK-trees over shards of the fingerprints.

Fingerprints: 3-word shingles of the ASCII-lower-cased text, XXH64 (seed 42) each; a bit of the
fingerprint is set if it is set in over half the shingles. Two fingerprints link when they
differ in at most ``RADIUS`` bits.

Search: the 64 bits are cut into ``RADIUS + 2`` blocks. Two fingerprints within the radius
agree in two blocks at least, so each fingerprint goes into one shard for every pair of
blocks, keyed by the blocks' values, and no link is lost. Within a shard the
fingerprints form a BK-tree (children keyed by their Hamming distance to the parent), and a
search follows only edges within the radius of its distance. A shard of more than ``TREE_NODES``
fingerprints is split by hash into trees of about that size, and its members are sent to all of
its trees, which search them a batch at a time and keep none of them. Trees reach their queries by shuffle, not by a driver-side broadcast: what
would be broadcast grows with the corpus. Only distinct fingerprints take part (copies
count once), and a tree gives star links to one member per connected group, not all pairs. Only fingerprints and ids move, so
texts of any length weigh the same.

Components: links are contracted by alternating min-label and pointer steps as Spark jobs, with a
checkpoint each round; nothing is collected.

Nulls and odd inputs: a null text has no words; texts without words share fingerprint zero and
link like any other; a null doc_id is kept with its fingerprint's component (ids that are not
null decide the smallest id); repeated rows stay repeated. The pipeline stage keeps one row of every
component, also where ids are null or different texts share an id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwarden.llm.common import nested, shared_folder, table

SHINGLE, RADIUS, SEED = 3, 3, 42
TREE_NODES = 4096
BATCH_TREE = 64  # shards from this size on are searched with all their queries at once


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space
    if not words:
        return 0
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        xx = xxhash.xxh64_intdigest
        hashes = [xx(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[size - 1:])]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):  # bounded unpacking of very long texts
        h = np.array(hashes[lo:lo + (1 << 14)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """The columns of ``df`` without ``text`` plus ``fp`` (the fingerprint's bits as a long)."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(text).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in keep}, "fp": pa.array(fps.view(np.int64))})

    return df.mapInArrow(run, T.StructType([*df.drop(text).schema.fields, T.StructField("fp", T.LongType())]))


# ---------------------------------------------------------------- BK-trees
class BKTree:
    """Integers under Hamming distance; children of a node are keyed by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Inserts ``value`` (equal values share a node); returns its node."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            nxt = self.children[at].get(d)
            if nxt is None:
                nxt = self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return nxt
            at = nxt

    def near(self, value: int, radius: int) -> list[int]:
        """Nodes within ``radius``: only edges whose key lies within it of the distance are followed."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if kids:
                for key in range(max(1, d - radius), d + radius + 1):
                    if key in kids:
                        stack.append(kids[key])
        return found

    def near_many(self, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """The same search for many values at once: ``(node, indices of the values near it)``."""
        stack = [(0, np.arange(len(values)))] if self.values else []
        while stack:
            at, who = stack.pop()
            d = np.bitwise_count(values[who] ^ np.uint64(self.values[at]))
            hit = who[d <= radius]
            if hit.size:
                yield at, hit
            d = d.astype(np.int16)
            for key, kid in self.children[at].items():
                go = who[np.abs(d - key) <= radius]
                if go.size:
                    stack.append((kid, go))


class Groups:
    """Union-find whose groups are named by their smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i < j:
            self.up[j] = i
        else:
            self.up[i] = j


class ShardSearch:
    """Star links ``(fingerprint, its group's first)`` of one tree: its own members are inserted at once, then guests
    (fingerprints of the same shard that live in its other trees) come in blocks, of which only the groups they join are kept."""

    def __init__(self, own: np.ndarray, radius: int):
        self.own, self.radius = own, radius
        self.tree, self.groups = BKTree(), Groups(own.size)
        tree, groups = self.tree, self.groups
        if own.size < BATCH_TREE:
            for i, v in enumerate(own.tolist()):
                for j in tree.near(v, radius):
                    groups.union(i, j)
                tree.add(v)
        else:
            for v in own.tolist():
                tree.add(v)
            for node, hit in tree.near_many(own, radius):
                for j in {groups.find(i) for i in hit.tolist()}:
                    groups.union(node, j)

    def guests(self, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The links of a block of guests, each to the first own member it met."""
        groups = self.groups
        seen = np.full(block.size, -1, np.int64)
        for node, hit in self.tree.near_many(block, self.radius):
            new = seen[hit] < 0
            seen[hit[new]] = node
            for j in {groups.find(int(i)) for i in np.unique(seen[hit[~new]])}:
                groups.union(node, j)
        at = np.flatnonzero(seen >= 0)
        if at.size:
            yield block[at], self.own[seen[at]]

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The links among the own members, after all guests."""
        root = np.fromiter((self.groups.find(i) for i in range(self.own.size)), np.int64, self.own.size)
        moved = np.flatnonzero(root != np.arange(self.own.size))
        if moved.size:
            yield self.own[moved], self.own[root[moved]]


def _shard_links(own: np.ndarray, guests: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links of one tree whose rows are at hand."""
    if own.size and own.size + guests.size > 1:
        search = ShardSearch(own, radius)
        if guests.size:
            yield from search.guests(guests)
        yield from search.close()


def _block_masks(radius: int) -> list[int]:
    """Masks of every pair of the ``radius + 2`` blocks of 64 bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [x | y for x, y in itertools.combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints (column ``fp``) that connect exactly those
    reachable by steps of at most ``radius`` differing bits."""
    shared_folder(distinct.sparkSession)
    masks = _block_masks(radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "bits"))
    sizes = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > tree_nodes)
    big = sizes.select("mask", "bits", F.ceil(F.col("n") / tree_nodes).cast("int").alias("trees")).checkpoint()
    home = lambda trees: F.pmod(F.xxhash64(F.lit("tree"), "fp"), trees).cast("int")
    if big.isEmpty():
        dealt = keyed.select("mask", "bits", F.lit(0).alias("tree"), F.lit(False).alias("guest"), "fp")
    else:
        j = keyed.join(big, ["mask", "bits"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
        j = j.select("mask", "bits", "fp", home(F.col("trees")).alias("home"),
                     F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
        dealt = j.select("mask", "bits", "tree", (F.col("home") != F.col("tree")).alias("guest"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "mask", "bits", "tree").sortWithinPartitions("mask", "bits", "tree", "guest", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts):
            if parts:
                a, b = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        # the tree that the last rows of a batch belong to may go on in the next: its own members so far,
        # or, once guests have come, the search, which keeps none of them
        now, own, search = None, [], None

        def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if search is not None:
                yield from search.close()
            elif own:
                yield from _shard_links(np.concatenate(own), np.zeros(0, np.uint64), radius)

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, bits, tree, guest, fp = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                                           for c in ("mask", "bits", "tree", "guest", "fp"))
            fp = fp.view(np.uint64)
            change = (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1]) | (tree[1:] != tree[:-1])
            cut = np.concatenate([[0], np.flatnonzero(change) + 1])
            ends = np.append(cut[1:], len(fp))
            size, last, out = ends - cut, len(cut) - 1, []
            size[[0, last]] = 2  # the first may go on from the batch before, the last in the next one
            for k in np.flatnonzero(size > 1):  # a shard of one fingerprint has no link
                lo, hi = cut[k], ends[k]
                g = lo + int(np.searchsorted(guest[lo:hi], 1))
                at = (mask[lo], bits[lo], tree[lo])
                if 0 < k < last:
                    out += _shard_links(fp[lo:g], fp[g:hi], radius)
                else:
                    if at != now:
                        if now is not None:
                            out += close()
                        now, own, search = at, [], None
                    if g > lo:
                        own.append(fp[lo:g].copy())
                    if hi > g and (search is not None or own):  # a tree without own members links nothing
                        if search is None:
                            search, own = ShardSearch(np.concatenate(own), radius), []
                        out += search.guests(fp[g:hi])
                if sum(len(a) for a, _ in out) > 1 << 18:
                    yield from emit(out)
                    out = []
            yield from emit(out)
        if search is not None or own:
            yield from emit(list(close()))

    return dealt.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges (a, b)``: the smallest vertex it is connected to.

    Each round points every vertex to its smallest neighbour's label and then halves the
    pointer chains; edges between vertices of equal label are dropped. Rounds grow with the logarithm
    of the longest chain. Every round is checkpointed to the shared folder.
    """
    shared_folder(edges.sparkSession)
    labels = None  # (v, root): final names so far
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("v"), F.least("a", "m").alias("root"))
        low = _shortcut(low.checkpoint())
        # contract: every edge goes between the roots of its ends
        e = (e.join(low.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a")
             .join(low.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
             .where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
             .distinct().checkpoint())
        if labels is None:
            labels = low
        else:
            nxt = low.select(F.col("v").alias("root"), F.col("root").alias("to"))
            labels = labels.join(nxt, "root", "left").select("v", F.coalesce("to", "root").alias("root")).checkpoint()
    return labels if labels is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root")).limit(0)


def _shortcut(low: DataFrame) -> DataFrame:
    """Follows ``root`` pointers (which only go down) until every vertex points to a root."""
    while True:
        up = low.select(F.col("v").alias("root"), F.col("root").alias("to"))
        nxt = low.join(up, "root", "left").select("v", F.coalesce("to", "root").alias("root"),
                                                  (F.coalesce("to", "root") != F.col("root")).alias("moved")).checkpoint()
        moved = not nxt.where("moved").isEmpty()
        low = nxt.drop("moved")
        if not moved:
            return low


def near_duplicates(fps: DataFrame, id_col: str, radius: int = RADIUS) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct fingerprint of ``fps (id_col, fp)``.

    ``root`` is the component's smallest fingerprint, ``component_id`` the smallest id of all rows whose
    fingerprints are connected (null if they have none).
    """
    shared_folder(fps.sparkSession)
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("low")).checkpoint()
    comp = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(comp, distinct["fp"] == comp["v"], "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # every vertex's smallest id, gathered per component by a partial aggregate and sent back to its members
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash_bktree(spark, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    fps = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).checkpoint()
    comp = near_duplicates(fps, "doc_id")
    return fps.join(comp, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every near-duplicate component the document with the smallest id stays.

    Only ids and fingerprints are shuffled for the search; the texts are shuffled once, for the
    join with the surviving ids. Where ids repeat (or several are null) an id does not name one
    document: then the survivor of a component is its row with the smallest (id, fingerprint, text
    hash), nulls last, and a component never loses its only document to another one of the same id.
    """
    shared_folder(spark)
    fps = fingerprints(docs.select("doc_id", "text")).checkpoint()
    comp = near_duplicates(fps, "doc_id")
    d = nested(docs, "text", _id="doc_id")
    if fps.groupBy("doc_id").count().where("count > 1").isEmpty():
        keep = comp.select(F.col("component_id").alias("_keep")).distinct()
        return d.drop("text").join(keep, F.col("_id").eqNullSafe(F.col("_keep")), "left_semi").select("row.*")
    first = (fps.join(comp, "fp").groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("s"))
             .select(F.col("s.doc_id").alias("_keep"), F.col("s.fp").alias("_fp")))
    kept = fingerprints(d).join(first, (F.col("fp") == F.col("_fp")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_semi")
    return kept.groupBy("fp").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row.*")
