"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct shingles of ``width`` lower-cased words (fewer words:
the whole sequence); two documents link when ``100 * common >= percent * union``.  Equal sets
are one node.

Shingles are ordered by class, then by hash.  The class follows the number of documents
with a shingle, counted over the whole corpus in an array of fixed size (``sketch``):
class 1 is rare, classes 2 and 3 are frequent.  A prefix of a set is indexed: a rare
shingle by itself, frequent ones as combinations of 2 or 3 of the same class and bin.  A
linked document lacks at most ``missing = size - ceil(percent size / 100)`` shingles of the set,
and ``k`` shared members of a class and bin are needed for one shared combination, so the prefix is extended
until ``sum(members - k + 1)`` over classes and bins is greater than ``missing + spare``.  Of two linked
sets, the one whose prefix ends first shares more than its own ``spare`` signatures with the other, so each has more than
the ``spare`` of the smallest set that may link with it: documents that only have a passage in common drop out before any set is compared.  The number of bins depends on the size level, so that combinations stay linear in the size; levels are
spaced so that linked sets differ by one at most, and each set is indexed at its own
level and the next.  Small sets are indexed by single shingles only.

A signature also carries its cost, the sum of ``members - k + 1`` over the prefix before its last
member.  If it is the first that two sets share, both lack as many shingles as it costs,
which bounds the size of the partner; rows without a partner of such a size are dropped, so
a group of texts that are alike but not alike enough gives no pairs.

Each set has a sketch of ``SKETCH_BITS`` parity bits, one flipped by each member.  Two sets differ in at least as
many members as their sketches differ in bits, so pairs whose sketches differ in too many are no
candidates; that bound is exact and costs no link.

Signatures that meet give candidates, once nodes with too few of them are gone.  First every node is verified, in
``HUB_ROUNDS`` rounds, against one of the nodes that meet most others; then only pairs that are not yet in one component are
verified, so a large group of near copies costs no pair for every two of its members
and no link that matters is left out.  Verification compares whole sets.

Null and empty texts and texts without words have an empty set and link with nothing.
Rows with equal ids are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import kernels as K
from canlake.llm.common import components, partitions, table
from canlake.llm.sketch import counter_of, document_counts
from canlake.storage import settle

#: Sets below this size are indexed by single shingles.
SMALL = 12
#: Prefix members that a bin of a frequent class should hold.
IN_BIN = 4
#: Hundredths of a set by which its prefix is extended.
SPARE_PERCENT = 20
#: Rounds in which nodes are verified against central ones; results do not depend on it.
HUB_ROUNDS = 2
#: Bits of a set's sketch; results do not depend on it.
SKETCH_BITS = 1024


def spare(size: int) -> int:
    return 0 if size < 2 * SMALL else size * SPARE_PERCENT // 100


#: The same in SQL.
SPARE_SQL = f"if({{0}} < {2 * SMALL}, 0, {{0}} * {SPARE_PERCENT} div 100)"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted by hash, and the offsets."""
    words, at = K.word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.diff(at)
    made = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    rows = K.ragged(at[:-1], made)  # first word of each shingle
    left = np.repeat(at[1:], made) - rows
    total = np.zeros(len(rows), np.uint64)
    for i in range(width):
        more = left > i
        value = np.where(more, words[np.minimum(rows + i, max(len(words) - 1, 0))] if len(words) else 0, 0).astype(np.uint64)
        total = np.where(more, (total ^ value) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2 * i + 1), total)
    return K.sorted_distinct_by_row(K.mixed(total), np.concatenate([[0], np.cumsum(made)]))


def set_hash(members: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set, as a signed 64-bit number."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mixed(members), dtype=np.uint64)])
    return K.mixed(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def level_starts(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Smallest sizes of the levels; sizes that may link lie in one level or in neighbours."""
    starts = [1]
    while starts[-1] < most:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts)


def classes_of(counts: np.ndarray) -> np.ndarray:
    """The class of each counter: above chance, and eight times above that."""
    usual = float(np.median(counts)) if len(counts) else 0.0
    bound = usual + 6 * usual**0.5 + 16
    return (1 + (counts > bound) + (counts > 8 * bound)).astype(np.uint8)


def signatures(members: np.ndarray, kinds: np.ndarray, percent: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set and their costs; ``members`` ascend by (class, hash)."""
    n = len(members)
    wanted = n - -(-percent * n // 100) + 1 + spare(n)
    # Sets that may link with a small one are indexed like a small one too.
    small = [K.mixed(members[:wanted] ^ np.uint64(0x51))] if n < 2 * SMALL else []
    small_cost = [np.arange(len(k)) for k in small]
    if n < SMALL:
        return small[0], small_cost[0]
    rare = min(int(np.searchsorted(kinds, 2)), wanted)
    found, costs = [members[:rare], *small], [np.arange(rare), *small_cost]
    if rare == wanted:
        return np.concatenate(found), np.concatenate(costs)
    own = int(np.searchsorted(starts, n, side="right")) - 1
    for level in (own, own + 1):
        bins = max(1, int(starts[level]) * (100 - percent + SPARE_PERCENT) // 100 // IN_BIN)
        place = (K.mixed(members[rare:] + np.uint64(level)) % np.uint64(bins)).astype(np.int64)
        cell = place * 4 + kinds[rare:]
        order = np.argsort(cell, kind="stable")
        ranked = np.empty(len(order), np.int64)
        cells, first = np.unique(cell[order], return_index=True)
        ranked[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        # The i-th member of a cell adds one once the cell has enough for a combination.
        useful = np.cumsum(ranked >= kinds[rare:] - 1)
        end = int(np.searchsorted(useful, wanted - rare)) + 1
        used, kept = members[rare : rare + end], cell[:end]
        before = rare + np.concatenate([[0], useful])
        for c in np.unique(kept):
            places = np.flatnonzero(kept == c)
            group, cost = used[places], before[places]
            tag = np.uint64(level * 64 + int(c) % 4)
            i, j = np.triu_indices(len(group), 1)
            if c % 4 == 2:
                found.append(K.mixed(K.mixed(group[i] ^ tag) + group[j]))
                costs.append(cost[j])
            else:
                for m in range(2, len(group)):
                    below = j < m
                    found.append(K.mixed(K.mixed(K.mixed(group[i[below]] ^ tag) + group[j[below]]) ^ group[m]))
                    costs.append(np.full(int(below.sum()), cost[m]))
    return np.concatenate(found), np.concatenate(costs)


def sets_of(docs: DataFrame, key: str, width: int) -> DataFrame:
    """(key, n_shingles, node); node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("text"))
            for a, b in K.slices(data, offsets):
                members, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(a, b - a), pa.array(n), pa.array(set_hash(members, at), mask=n == 0)], names=[key, "n_shingles", "node"]
                )

    return docs.select(key, "text").mapInArrow(run, f"`{key}` long, n_shingles long, node long")


def index_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(signature, node, size, cost) of every set; a task gives each set once."""
    counts, _ = document_counts(docs, lambda data, offsets: shingle_sets(data, offsets, width))
    # One byte for each counter of the sketch, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(classes_of(counts))
    starts = level_starts(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, seen = shared.value, set()
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("text"))
            for a, b in K.slices(data, offsets):
                members, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                kinds = class_of[counter_of(members)]
                nodes = set_hash(members, at)
                found, prices, sizes = [], [], []
                for r in range(b - a):
                    sizes.append(0)
                    if at[r] == at[r + 1] or nodes[r] in seen:
                        continue
                    seen.add(nodes[r])
                    own, kind = members[at[r] : at[r + 1]], kinds[at[r] : at[r + 1]]
                    order = np.argsort(kind, kind="stable")
                    keys, cost = signatures(own[order], kind[order], percent, starts)
                    found.append(keys)
                    prices.append(cost)
                    sizes[-1] = len(keys)
                if not found:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(np.diff(at).astype(np.int32), sizes)),
                     pa.array(np.concatenate(prices).astype(np.int32))],
                    names=["signature", "node", "size", "cost"],
                )

    return docs.select("text").mapInArrow(run, "signature long, node long, size int, cost int")


def meetings(index: DataFrame) -> DataFrame:
    """The rows of the signatures that two or more nodes have, each (signature, node) once.

    Rows stream in the order (signature, node); one row is held back, never a list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, False  # the row before, and whether it has been given
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(4)]
            if last is not None:
                rows = [np.insert(column, 0, value) for column, value in zip(rows, last)]
            signature, node = rows[:2]
            fresh = np.ones(len(node), dtype=bool)
            fresh[1:] = (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])
            rows = [column[fresh] for column in rows]
            begin = np.ones(len(rows[0]), dtype=bool)
            begin[1:] = rows[0][1:] != rows[0][:-1]
            group = np.cumsum(begin) - 1
            give = (np.bincount(group) > 1)[group]
            given = give[-1] or (out and group[-1] == 0)
            if out:
                give[0] = False
            last, out = [column[-1] for column in rows], bool(given)
            yield pa.RecordBatch.from_arrays([pa.array(column[give]) for column in rows], names=["signature", "node", "size", "cost"])

    ordered = index.repartition(partitions(index), "signature").sortWithinPartitions("signature", "node")
    return ordered.mapInArrow(run, "signature long, node long, size int, cost int")


def enough(met: DataFrame, percent: int) -> DataFrame:
    """Drops the rows of nodes that meet others in too few signatures to be linked.

    The prefix that ends first may be the partner's, so the spare of the smallest set that may link counts.
    """
    nodes = met.groupBy("node").agg(F.count("*").alias("n"), ((percent * F.first("size") + 99) / 100).cast("int").alias("_least"))
    nodes = settle(nodes.where(f"n > {SPARE_SQL.format('_least')}").select("node"), "nodes-met")
    return met.join(nodes, "node", "left_semi")


def sketch_of(members: np.ndarray) -> np.ndarray:
    """The parity of the members that fall on each of ``SKETCH_BITS`` bits, as signed 64-bit numbers."""
    places = (K.mixed(members) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=SKETCH_BITS) % 2 == 1).view(np.int64)


def whole_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, members, sketch) for ``nodes``; texts are read again and pass a bitmap of fixed size first."""

    def as_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data.view(">u8").astype(np.uint64), offsets

    packed = nodes.select(F.unhex(F.lpad(F.hex("node"), 16, "0")).alias("text"))
    wanted, _ = document_counts(packed, as_terms)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.unpackbits(shared.value).astype(bool), set()
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("text"))
            for a, b in K.slices(data, offsets):
                members, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                found = set_hash(members, at)
                rows = []
                for r in np.flatnonzero((np.diff(at) > 0) & wanted[counter_of(found.view(np.uint64))]).tolist():
                    if found[r] not in seen:
                        seen.add(found[r])
                        rows.append(r)
                own = [members[at[r] : at[r + 1]] for r in rows]
                words = np.concatenate([np.zeros(0, np.int64), *map(sketch_of, own)])
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[rows]), pa.array([m.tobytes() for m in own], pa.binary()), sketches], names=["node", "members", "sketch"]
                )

    sets = docs.select("text").mapInArrow(run, "node long, members binary, sketch array<long>")
    return sets.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, x_at), (y, y_at) = K.text_buffers(batch.column("left")), K.text_buffers(batch.column("right"))
            n, m = np.diff(x_at) // 8, np.diff(y_at) // 8
            common = np.zeros(len(n), np.int64)
            for a, b in K.slices(x, x_at, K.BLOCK):
                rows = np.arange(b - a, dtype=np.uint64) << np.uint64(52)
                keys = np.concatenate([
                    np.repeat(rows, n[a:b]) | (x[x_at[a] : x_at[b]].view(np.uint64) >> np.uint64(12)),
                    np.repeat(rows, m[a:b]) | (y[y_at[a] : y_at[b]].view(np.uint64) >> np.uint64(12)),
                ])
                keys.sort()
                twice = keys[1:][keys[1:] == keys[:-1]]
                common[a:b] = np.bincount((twice >> np.uint64(52)).astype(np.int64), minlength=b - a)
            rows = pa.array(np.flatnonzero(100 * common >= percent * (n + m - common)))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def node_links(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different sets that give the components of all links."""

    def common(x: str, y: str) -> str:  # shingles that linked sets of these sizes share at least
        return f"-((-{percent} * ({x} + {y})) div {100 + percent})"

    def fits(x: str, y: str) -> str:
        return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"

    met = enough(settle(meetings(index_of(docs, width, percent)), "meetings"), percent)
    met = settle(met.where(f"100 * cost <= {100 - percent} * size"), "meetings-enough")
    least = met.groupBy("signature").agg(F.min("size").alias("least"))
    met = met.join(least, "signature").where(f"cost <= size - ({common('size', f'greatest(least, -((-{percent} * size) div 100))')})").drop("least")
    lists = settle(met, "meetings-possible")
    # A node's centrality: how often it meets others.  The text that others were edited from meets most.
    shared = lists.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1")
    met = settle(lists.join(shared, "signature"), "meetings-shared")
    central = settle(met.groupBy("node").agg(F.sum(F.col("n") - 1).alias("central")), "centralities")
    rows = settle(met.drop("n").join(central, "node"), "meetings-central")
    sets = settle(whole_sets(docs, central.select("node"), width), "sets")

    share = common("x_size", "y_size")
    possible = f"{fits('x_size', 'y_size')} and x_cost <= x_size - ({share}) and y_cost <= y_size - ({share})"
    rows = rows.withColumn("component", F.col("node"))
    hubs = links = tried = None
    for _ in range(HUB_ROUNDS):
        after = rows
        if hubs is not None:  # the next central node of each signature
            after = rows.join(hubs.select("signature", F.struct("y_central", "y_node").alias("_last")), "signature").where(F.struct("central", "node") < F.col("_last"))
        hubs = after.groupBy("signature").agg(F.max(F.struct("central", "node", "size", "cost", "component")).alias("hub"))
        hubs = settle(hubs.select("signature", *(F.col(f"hub.{c}").alias(f"y_{c}") for c in ("central", "node", "size", "cost", "component"))), "hubs")
        own = rows.select("signature", *(F.col(c).alias(f"x_{c}") for c in ("node", "size", "cost", "component")))
        close = own.join(hubs, "signature").where(f"x_component <> y_component and {possible}")
        close = close.groupBy(F.col("x_node").alias("node"), F.col("y_node").alias("hub")).agg(F.count("*").alias("n"))
        if tried is not None:
            close = close.join(tried, ["node", "hub"], "left_anti")
        best = settle(close.groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")).select("node", "hub"), "best-hubs")
        tried = best if tried is None else tried.union(best)
        found = settle(verified(best.select(F.col("hub").alias("a"), F.col("node").alias("b")), sets, percent), "links")
        links = found if links is None else links.union(found)
        # Within a signature, only rows outside its largest component look for partners from here on.
        group = components(links, "hub-rounds")
        labelled = rows.drop("component", "main").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
        labelled = settle(labelled, "meetings-labelled")
        parts = labelled.groupBy("signature", "component").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("signature").agg(F.max_by("component", "n").alias("main"), F.count("*").alias("groups")).where("groups > 1")
        rows = settle(labelled.join(mixed.select("signature", "main"), "signature"), "meetings-mixed")
    rows = rows.join(sets.select("node", "sketch"), "node")
    strays, others = (
        rows.select("signature", "main", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "size", "cost", "component", "sketch"))) for side in ("x", "y")
    )
    differing = " + ".join(f"bit_count(x_sketch[{i}] ^ y_sketch[{i}])" for i in range(SKETCH_BITS // 64))
    pairs = strays.where("x_component <> main").drop("main").join(others, "signature").where(
        f"x_component <> y_component and (y_component = main or x_node < y_node) and {possible} and {differing} <= x_size + y_size - 2 * ({share})"
    )
    pairs = pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    return links.union(settle(verified(pairs, sets, percent), "links"))


def near_duplicate_groups(docs: DataFrame, key: str, width: int, percent: int) -> DataFrame:
    """(key, n_shingles, component_id): component_id is the smallest key reachable by links."""
    rows = settle(sets_of(docs, key, width), "set-rows")
    nodes = settle(rows.where("node is not null").groupBy("node").agg(F.min(key).alias("first")), "nodes")
    labels = components(node_links(docs, width, percent), "document")
    named = nodes.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    named = settle(named, "node-labels")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = settle(named.join(smallest, "component").select("node", "component_id"), "node-groups")
    full = rows.where("node is not null").join(by_node, "node").select(key, "n_shingles", "component_id")
    return full.union(rows.where("node is null").select(key, "n_shingles", F.col(key).alias("component_id")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles and a Jaccard similarity of 0.85."""
    return near_duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", 4, 85)
