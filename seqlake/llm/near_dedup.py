"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes)
   and a SuperMinHash signature (Ertl, "SuperMinHash - A New Minwise Hashing
   Algorithm for Jaccard Similarity Estimation", 2017): each shingle walks a
   random permutation of the slots, so that its ranks are correlated over the
   slots, and the walk stops once no later rank can lower any slot.
2. Equal sets form a class; only its smallest id goes on.
3. Signatures are cut into bands of rows; classes that share a band are
   candidates. A bucket isn't expanded into pairs: all its members are held
   against its smallest one and then, of buckets that still lie in several
   components, against the member with the fewest shingles of its own.
   Members with too many shingles that no other such member has can't be
   similar to any, and leave. What then still lies in different components is
   compared in blocks, a pair of blocks to a group, which returns the
   components it joins. No link between components is lost.
4. Candidates are verified on the full shingle sets of their whole texts.
5. Links become components by union-find forests on each partition, which are
   merged by hooking and pointer jumping over written tables.

With 32 bands of 4 rows, two sets at similarity 0.75 share no band with
probability (1 - 0.75**4)**32, about 5e-6.

Defined cases: a null or empty text, or one of white space only, has no
shingles and is its own component; a text with fewer than five words has one
shingle; repeated rows are one class; a null id gives a row with a null
component, unless an equal set has an id; where an id repeats with different
texts, the smallest text stands for it when links are verified; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import Scratch, documents, mix, only_ids, released, runs_by_bytes, shingle_hashes, spread, text_bytes

WIDTH = 5
BANDS, ROWS = 32, 4
#: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
BATCH_BYTES = 1 << 19
#: Members to a block, where what is left of a cluster is compared.
BLOCK_IDS = 128


# ---------------------------------------------------------------- signatures


def super_minhash(rows: np.ndarray, hashes: np.ndarray, n_rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures of n_rows sets given as (row, element hash), rows rising; n_rows x m float64.

    All elements take step j of their walks together: element e draws a
    fraction r and a place k in j..m-1, swaps places j and k of its own
    permutation, and lowers slot p[j] of its row to r + j. After step j only
    rows with a slot above j go on, which for long texts is none.
    """
    slots = np.full(n_rows * m, np.inf)
    if not len(rows):
        return slots.reshape(n_rows, m)
    live = np.arange(len(rows))
    perm = None  # permutations of the elements, held from the third step on
    places: list[np.ndarray] = []  # of the first two steps
    for j in range(m):
        draw = mix(hashes[live], 2 * j + 1)
        fraction = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        place = j + (mix(draw, 2 * j + 2) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            slot = place
        elif j == 1:
            slot = np.where(place == places[0], 0, place)
        else:
            every = np.arange(len(live))
            slot = perm[every, place].astype(np.int64)
            perm[every, place] = perm[every, j]
            perm[every, j] = slot
        np.minimum.at(slots, rows[live] * m + slot, fraction + j)
        go_on = slots.reshape(n_rows, m).max(axis=1)[rows[live]] > j + 1
        if not go_on.any():
            break
        live = live[go_on]
        if j < 2:
            places = [x[go_on] for x in (*places, place)]
        else:
            perm = perm[go_on]
        if j == 1:
            perm = np.tile(np.arange(m, dtype=np.int16), (len(live), 1))
            every = np.arange(len(live))
            for step, other in enumerate(places):
                held = perm[every, other]
                perm[every, other] = perm[:, step]
                perm[:, step] = held
    return slots.reshape(n_rows, m)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band, which the band's number is part of; n x bands."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    keys = np.tile(mix(np.arange(bands, dtype=np.uint64), 5), (len(signatures), 1))
    for i in range(rows):
        keys = mix(keys ^ bits[:, :, i], 17 + i)
    return keys.view(np.int64)


def signed(df: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Shingle count, 128-bit set digest and band keys of every row (no keys for an empty set)."""
    names = ["doc_id", "n_shingles", "set_a", "set_b", "bands"]

    def made(batches):
        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_bytes(texts)
            for a, b in runs_by_bytes(offsets, BATCH_BYTES):
                n = b - a
                owner, hashes = shingle_hashes(*text_bytes(texts.slice(a, n)), width)
                edges = np.searchsorted(owner, np.arange(n + 1))
                sizes = np.diff(edges)
                digests = []
                for seed in (101, 202):  # sums of mixed hashes don't depend on order
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes, seed))])
                    digests.append(mix(sums[edges[1:]] - sums[edges[:-1]], seed + 1).view(np.int64))
                keys = band_keys(super_minhash(owner, hashes, n, bands * rows), bands, rows)
                full = sizes > 0
                starts = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(keys[full].ravel()))
                columns = [batch.column(0).slice(a, n), pa.array(sizes.astype(np.int64)), *map(pa.array, digests), lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(texts).mapInArrow(released(made), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


# -------------------------------------------------------------- verification


def verified(pairs: DataFrame, texts: DataFrame, similarity: int = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(a, b, both, linked) of every pair: shared shingles of the whole texts, and whether they are enough.

    ``texts`` has (id, text) for each id of the pairs.
    """

    def similar(batches):
        known: dict = {}  # sets of the left ids, which come in runs
        for batch in batches:
            left = batch.column(0).to_pylist()
            _, offsets = text_bytes(batch.column(3))
            shared, linked = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=bool)
            for a, b in runs_by_bytes(offsets, BATCH_BYTES):
                owner, hashes = shingle_hashes(*text_bytes(batch.column(3).slice(a, b - a)), width)
                edges = np.searchsorted(owner, np.arange(b - a + 1))
                for i in range(a, b):
                    if left[i] not in known:
                        if len(known) > 64:
                            known.clear()
                        known[left[i]] = shingle_hashes(*text_bytes(batch.column(2).slice(i, 1)), width)[1]
                    x, y = known[left[i]], hashes[edges[i - a] : edges[i - a + 1]]
                    if len(x):
                        shared[i] = both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                        linked[i] = 100 * both >= similarity * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(linked)], names=["a", "b", "both", "linked"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(released(similar), "a long, b long, both long, linked boolean")


def shingle_rows(texts: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, n, shingle): a row for each shingle of the ids' texts."""

    def made(batches):
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for a, b in runs_by_bytes(offsets, BATCH_BYTES):
                owner, hashes = shingle_hashes(*text_bytes(batch.column(1).slice(a, b - a)), width)
                edges = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "shingles"])

    sets = texts.join(ids, "id", "left_semi").mapInArrow(released(made), "id long, shingles array<long>")
    return sets.select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))


def reaches(rows: DataFrame) -> DataFrame:
    """(id, n, c): shingles of each id, and how many of them another id has, too.

    Two ids can't share more than the smaller c, which bounds their
    similarity: copies with many changes of their own link with nothing.
    """
    single = rows.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("k"))
    own = single.filter("k = 1").groupBy("id").agg(F.count("*").alias("own"))
    sizes = rows.groupBy("id").agg(F.min("n").alias("n"))
    return sizes.join(own, "id", "left").select("id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("c"))


# ---------------------------------------------------------------- union-find


def forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: edges (node, root) of a forest with the same components."""

    def united(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.get(root, root) != root:
                root = parent[root]
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(x), find(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        for at in range(0, len(nodes), 50_000):
            some = [x for x in nodes[at : at + 50_000] if find(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["node", "root"])

    return edges.mapInArrow(released(united), "node long, root long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): the smallest id of each node's component; roots themselves have no row.

    Each round gives every node its smallest root, hooks the other roots onto
    that one, and jumps to the root's root, until no round changes anything.
    """
    edges = forest(links.toDF("x", "y"))
    turn = 0
    while True:
        edges = scratch.keep(edges, f"{name}-edges{turn}")
        best = scratch.keep(edges.groupBy("node").agg(F.min("root").alias("root")), f"{name}-best{turn}")
        other = edges.join(best.select("node", F.col("root").alias("least")), "node").filter("root <> least")
        hooks = scratch.keep(other.select(F.col("root").alias("node"), F.col("least").alias("root")).distinct(), f"{name}-hooks{turn}")
        roots = best.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = scratch.keep(best.join(roots, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), f"{name}-jump{turn}")
        done = hooks.isEmpty() and jumped.filter("moved").isEmpty()
        scratch.drop(f"{name}-edges{turn}", f"{name}-best{turn}")
        if done:
            return jumped.select("node", "root")
        edges = forest(jumped.select("node", "root").unionByName(hooks))
        turn += 1


# ------------------------------------------------------------------ operator


def _left(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, id, root): the members of buckets that lie in several components."""
    placed = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return placed.join(mixed.select("bucket"), "bucket", "left_semi")


def _rest(left: DataFrame, texts: DataFrame, scratch: Scratch, similarity: int, width: int) -> DataFrame:
    """Links (a, b) between components, of all pairs that still lie in different ones.

    Buckets that share members form clusters. A cluster's members are dealt
    to blocks of about BLOCK_IDS; each pair of blocks is one group, in which
    the sets are compared all at once, as a product of incidence matrices.
    No pair is a row: a group returns the components that it joins.
    """

    def joined(group: pa.Table) -> pa.Table:
        owner, hashes = shingle_hashes(*text_bytes(group.column("text")), width)
        n = group.num_rows
        sizes = np.bincount(owner, minlength=n)
        _, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        both = np.zeros((n, n), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for low in range(0, int(column.max(initial=-1)) + 1, 8192):
            a, b = np.searchsorted(column, (low, low + 8192))
            incidence = np.zeros((n, 8192), dtype=np.float32)
            incidence[owner[a:b], column[a:b] - low] = 1
            both += incidence @ incidence.T
        root, block = group.column("root").to_numpy(), group.column("block").to_numpy()
        linked = 100 * both.astype(np.int64) >= similarity * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
        linked &= (root[:, None] > root[None, :]) & (sizes[:, None] > 0)
        if group.column("low")[0].as_py() != group.column("high")[0].as_py():
            linked &= block[:, None] != block[None, :]
        i, j = np.nonzero(linked)
        pairs = np.unique(np.stack([root[i], root[j]], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    first = scratch.keep(left.groupBy("bucket").agg(F.min("id").alias("first")), "firsts")
    edges = left.join(first, "bucket").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    clusters = components(scratch.keep(edges, "cluster-edges"), scratch, "clusters").toDF("id", "cluster")
    members = left.select("id", "root").distinct().join(clusters, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    members = scratch.keep(members, "cluster-members")
    sizes = scratch.keep(members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_IDS).cast("int").alias("blocks")), "cluster-sizes")
    dealt = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "root", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    full = dealt.join(texts, "id").select("cluster", "low", "high", "block", "root", "text")
    return full.groupBy("cluster", "low", "high").applyInArrow(joined, "a long, b long")


def near_duplicates(df: DataFrame, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for every row."""
    scratch = Scratch(df.sparkSession, "near")
    made = scratch.keep(signed(df, width, bands, rows), "signed")
    full = made.filter("n_shingles > 0")
    # equal sets: one class, under its smallest id
    classes = scratch.keep(
        full.groupBy("set_a", "set_b").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep")), "classes"
    )
    members = classes.filter("rep IS NOT NULL").select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"))
    shared = scratch.keep(
        members.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "shared"
    )
    members = scratch.keep(members.join(shared.select("bucket"), "bucket"), "members")
    ids = scratch.keep(members.select("id").distinct(), "ids")
    texts = df.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = scratch.keep(only_ids(texts, "id", ids).groupBy("id").agg(F.min("text").alias("text")), "texts")

    # all members of a bucket against its smallest one
    pairs = members.join(shared, "bucket").filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    links = scratch.keep(verified(pairs.distinct(), texts, similarity, width), "tests0").filter("linked").select("a", "b")
    roots = components(links, scratch, "roots0")
    left = scratch.keep(_left(members, roots), "left0")
    if not left.isEmpty():
        # the same with the member that has the fewest shingles of its own, without members that can't link
        ids = left.select("id").distinct()
        reach = scratch.keep(reaches(scratch.keep(shingle_rows(texts, ids, width), "rows1")), "reach")
        left = scratch.keep(left.drop("root").join(reach.filter(F.col("c") * 100 >= F.col("n") * similarity), "id"), "left1")
        pivots = left.groupBy("bucket").agg(F.min(F.struct((1 - F.col("c") / F.col("n")).alias("own"), F.col("id").alias("pivot"))).alias("p"), F.count("*").alias("k"))
        pivots = scratch.keep(pivots.filter("k > 1").select("bucket", "p.pivot"), "pivots1")
        pairs = left.join(pivots, "bucket").filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
        tests = scratch.keep(verified(pairs, texts, similarity, width), "tests1")
        roots = components(roots.toDF("a", "b").unionByName(tests.filter("linked").select("a", "b")), scratch, "roots1")
        left = scratch.keep(_left(left.select("bucket", "id"), roots), "left2")
        if not left.isEmpty():
            fresh = scratch.keep(_rest(left, texts, scratch, similarity, width), "links2")
            roots = components(roots.toDF("a", "b").unionByName(fresh), scratch, "roots2")
    scratch.drop("members", "texts", "shared", "ids", "rows1")
    groups = classes.select("set_a", "set_b", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    groups = scratch.keep(groups.select("set_a", "set_b", F.coalesce("root", "rep").alias("root")), "groups")
    alone = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return (
        made.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(groups, ["set_a", "set_b"], "left")
        .select("doc_id", "n_shingles", alone.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def op5_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
