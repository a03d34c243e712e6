"""Near duplicates on word shingles by DartMinHash signatures and banding, every link verified.

Each shingle owns a region of the plane: its weight wide, all ranks high. Darts with a rate of one per unit of
area are thrown into the plane by the shingle's hash alone, so two texts that share a shingle share its
darts. A text keeps the darts inside its regions; the earliest dart of each of K coordinates is its signature,
and two signatures agree on a coordinate with a probability equal to the weighted Jaccard similarity. About
K ln K + 2K darts are needed, however many shingles a text has.

Texts that agree on a band of the signature are candidates. Each bucket compares its members with its first
member only, and the links found make components. Where a bucket still holds several components, a second member is
held against the texts of the others. What is left is held against each other by sketches, a byte for each coordinate
of the signature, in blocks of bounded size: components meet if two of their texts agree on as many coordinates as
five deviations below the similarity asked for (a similar pair falls short with a probability of about 1e-6). Single
texts that meet are compared with each other, and larger components (hubs) with the texts of the components they
meet, in blocks that give one link for each text at most. So no bucket lists its pairs. Equal texts are one node
throughout. Texts are read from the table by their digest, and only those of candidates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from datamill.llm.common import packed, text_of, unpacked, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5  # a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^24 < 8e-5
STAR = 100  # members of a star that one verification step holds against the centre
SKETCHES = 250  # sketches of a bucket in one block
DEVIATIONS = 5  # below the expected agreement of a similar pair that sketches may fall
BLOCK = 300  # texts of a hub, and texts it meets, in one block
MEMORY = 300_000  # words whose hash a worker remembers
BROADCAST_ROWS = 500_000  # rows of (digest, id) that may be sent to all executors
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: one 64-bit hash of another."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, computed once each."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


WORD_HASHES = Words()


def shingles(text: str | None, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of ``width`` words, sorted, and how often each occurs.

    Words are runs without ASCII white space. A shorter text is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    with np.errstate(over="ignore"):
        rolled = hashes[:len(hashes) - width + 1].copy()
        for i in range(1, width):
            rolled = rolled * GOLD + hashes[i:len(hashes) - width + 1 + i]
        return np.unique(mixed(rolled + np.uint64(width)), return_counts=True)


def _darts(items: np.ndarray, weights: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(rank, identity) of all darts below rank ``reach`` that fall into the items' regions.

    A region is cut into strips [0, 1), [1, 2), [2, 4) ... of weight; within a strip darts follow each other at
    exponential distances.
    """
    ranks, names = [], []
    low, high, strip = 0.0, 1.0, 0
    while True:
        inside = weights > low
        if not inside.any():
            break
        seeds, limits = items[inside], weights[inside]
        at = np.zeros(len(seeds))
        height, throws = high - low, max(1, math.ceil(reach * (high - low)))
        seeds = mixed(seeds + GOLD * np.uint64(strip + 1))
        start = 0
        while len(seeds):
            numbers = np.arange(start + 1, start + throws + 1, dtype=np.uint64) * MIX2
            throw = mixed(seeds[:, None] ^ numbers[None, :])
            gap = -np.log((np.float64(1) + (throw >> np.uint64(11))) * 2.0**-53) / height
            rank = at[:, None] + np.cumsum(gap, axis=1)
            name = mixed(throw + GOLD)
            hit = rank < reach
            if high > 1.0 or (limits < 1.0).any():
                place = (mixed(name ^ MIX1) >> np.uint64(11)) * 2.0**-53
                hit = hit & (low + place * height < limits[:, None])
            ranks.append(rank[hit])
            names.append(name[hit])
            at = rank[:, -1]
            more = at < reach
            seeds, limits, at = seeds[more], limits[more], at[more]
            start += throws
        low, high, strip = high, high * 2.0, strip + 1
    return np.concatenate(ranks), np.concatenate(names)


def signature(items: np.ndarray, weights: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray | None:
    """The name of the earliest dart of each of ``k`` coordinates; None without items of positive weight.

    Without weights each item weighs 1, and agreement estimates the plain Jaccard similarity.
    """
    weights = np.ones(len(items)) if weights is None else np.asarray(weights, np.float64)
    items, weights = items[weights > 0], weights[weights > 0]
    if not len(items):
        return None
    reach = (k * math.log(k) + 2 * k) / weights.sum()
    with np.errstate(over="ignore"):
        while True:
            ranks, names = _darts(items, weights, reach)
            order = np.argsort(ranks)[::-1]
            names = names[order]
            coordinate = (names % np.uint64(k)).astype(np.int64)
            found, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
            found[coordinate] = names  # of several darts the last, so the earliest, stays
            filled[coordinate] = True
            if filled.all():
                return found
            reach *= 2


def band_keys(sign: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    parts = sign.reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for i in range(rows):
            key = mixed(key * GOLD + parts[:, i])
    return key.view(np.int64)


def signed(docs: DataFrame, text: str, bands: int, rows: int, words: int, counted: bool) -> DataFrame:
    """(node, keys, sketch) of every distinct text with words; a node is the digest of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            nodes, keys, sketches = [], [], []
            for node, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node in seen:
                    continue
                if len(seen) >= MEMORY:
                    seen.clear()
                seen.add(node)
                items, counts = shingles(value.as_py(), words)
                sign = signature(items, counts if counted else None, bands * rows)
                if sign is not None:
                    nodes.append(node)
                    keys.append(band_keys(sign, bands, rows))
                    sketches.append((sign >> np.uint64(56)).astype(np.uint8).tobytes())
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), lists, pa.array(sketches, pa.binary())], ["node", "keys", "sketch"])

    rows_in = docs.select(F.unhex(F.md5(text_of(docs[text]))).alias("node"), text_of(docs[text]).alias("text"))
    return rows_in.mapInArrow(run, "node binary, keys array<long>, sketch binary").dropDuplicates(["node"])


def texts_of(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(_n, text) of the given nodes; ``docs`` is not shuffled while the nodes are few."""
    nodes = written(nodes.select(F.col("node").alias("_n")).distinct(), "ends")
    rows = docs.select(F.unhex(F.md5(text_of(docs[text]))).alias("_n"), text_of(docs[text]).alias("text"))
    small = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    return written(rows.join(small, "_n", "left_semi").dropDuplicates(["_n"]), "texts")


def verified(pairs: DataFrame, docs: DataFrame, text: str, words: int = WORDS, counted: bool = False) -> DataFrame:
    """(centre, node, distance): the exact Jaccard distance of pairs (centre, node) of text digests.

    Only texts of candidates are shuffled. A centre meets its members in steps of about STAR members, which
    a task reads one after the other.
    """
    pairs = written(pairs, "pairs")
    texts = texts_of(pairs.select("node").unionByName(pairs.select(F.col("centre").alias("node"))), docs, text)
    steps = pairs.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(STAR)).alias("steps"))
    placed = written(pairs.join(steps, "centre").withColumn("step", F.pmod(F.xxhash64("node"), F.col("steps"))).drop("steps"), "placed")
    members = placed.join(texts, placed["node"] == texts["_n"]).select("centre", "step", "node", "text")
    centres = placed.select("centre", "step").distinct().join(texts, F.col("centre") == texts["_n"])
    centres = centres.select("centre", "step", F.lit(None).cast("binary").alias("node"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_weight = None, None
        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for centre, node, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                items, counts = shingles(value.as_py(), words)
                weight = counts if counted else np.ones(len(items), np.int64)
                if node is None:
                    own, own_weight = items, weight
                    continue
                _, a, b = np.intersect1d(own, items, assume_unique=True, return_indices=True)
                both = int(np.minimum(own_weight[a], weight[b]).sum())
                either = int(own_weight.sum() + weight.sum()) - both
                for column, x in zip(out, (centre, node, 1.0 - both / either if either else 0.0)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.float64())], ["centre", "node", "distance"])

    both = members.unionByName(centres).repartition("centre", "step").sortWithinPartitions("centre", "step", F.col("node").asc_nulls_first())
    return written(both.mapInArrow(run, "centre binary, node binary, distance double"), "verified")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the smallest node it is connected to.

    Every round takes the smallest label among the neighbours and then the label of that label.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = written(near, "near")
        lower = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(lower.join(jump, "label").select("node", "before", F.least("label", "next").alias("label")), "labels")
        if new.where(F.col("before") != F.col("label")).isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


class Hub:
    """The shingles of a block's hub texts as posting lists, against which other texts are held."""

    def __init__(self, nodes: list[bytes], sets: list[tuple[np.ndarray, np.ndarray]], counted: bool):
        self.nodes, self.counted = nodes, counted
        items = np.concatenate([x for x, _ in sets])
        order = np.argsort(items, kind="stable")
        self.items = items[order]
        self.owner = np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets])[order]
        self.weight = (np.concatenate([c for _, c in sets]) if counted else np.ones(len(items), np.int64))[order]
        self.total = np.bincount(self.owner, self.weight, len(sets))

    def nearest(self, items: np.ndarray, counts: np.ndarray) -> tuple[bytes, float]:
        """The hub's text of the greatest similarity, and that similarity."""
        weight = counts if self.counted else np.ones(len(items), np.int64)
        left, right = np.searchsorted(self.items, items, "left"), np.searchsorted(self.items, items, "right")
        found = right - left
        places = np.arange(found.sum()) + np.repeat(left - np.concatenate([[0], np.cumsum(found)[:-1]]), found)
        both = np.bincount(self.owner[places], np.minimum(self.weight[places], np.repeat(weight, found)), len(self.total))
        similar = both / (self.total + weight.sum() - both)
        best = int(np.argmax(similar))
        return self.nodes[best], float(similar[best])


def hub_links(meets: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, similarity: float, words: int, counted: bool) -> DataFrame:
    """(a, b): for each node of a component that meets a hub its nearest node there, if it is similar enough.

    ``meets`` (hub, guest) are labels, ``nodes`` (node, label). A hub and its guests are cut into blocks of about
    BLOCK texts each, and every pair of blocks is one step of a task, which holds the hub's block in memory.
    """
    hubs = meets.select(F.col("hub").alias("label")).distinct()
    members = nodes.join(hubs, "label").select(F.col("label").alias("hub"), "node")
    guests = meets.join(nodes, meets["guest"] == nodes["label"]).select("hub", "node")
    rows = written(members.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))).distinct(), "hub_rows")
    blocks = rows.groupBy("hub").agg(
        F.ceil(F.sum((~F.col("guest")).cast("int")) / F.lit(BLOCK)).cast("int").alias("m"), F.ceil(F.sum(F.col("guest").cast("int")) / F.lit(BLOCK)).cast("int").alias("g"))
    blocks = written(blocks.select(F.col("hub").alias("_hub"), "m", "g"), "hub_blocks")
    rows = rows.join(blocks, rows["hub"] == blocks["_hub"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("g")).otherwise(F.col("m"))).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("guest"), F.col("m")).otherwise(F.col("g")) - 1)))
    rows = rows.select(
        "hub", F.when(F.col("guest"), F.col("other")).otherwise(F.col("own")).alias("block"),
        F.when(F.col("guest"), F.col("own")).otherwise(F.col("other")).alias("part"), "guest", "node")
    texts = texts_of(rows.select("node"), docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, nodes_held, sets, hub = None, [], [], None
        for batch in batches:
            out: tuple[list, list] = [], []
            for name, block, part, guest, node, value in zip(*[batch.column(i).to_pylist() for i in range(5)], batch.column(5)):
                if (name, block, part) != step:
                    step, nodes_held, sets, hub = (name, block, part), [], [], None
                found = shingles(value.as_py(), words)
                if not guest:
                    nodes_held.append(node)
                    sets.append(found)
                    continue
                if not sets:
                    continue
                hub = hub or Hub(nodes_held, sets, counted)
                near, similar = hub.nearest(*found)
                if similar >= similarity - 1e-12:
                    out[0].append(node)
                    out[1].append(near)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["a", "b"])

    steps = rows.join(texts, rows["node"] == texts["_n"]).select("hub", "block", "part", "guest", "node", "text")
    steps = steps.repartition("hub", "block", "part").sortWithinPartitions("hub", "block", "part", "guest", "node")
    return written(steps.mapInArrow(run, "a binary, b binary"), "hub_links")


def open_buckets(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label) of the buckets in ``held`` (key, node) that hold several components, with all their rows."""
    held = held.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    held = written(held, "held")
    several = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return written(held.join(several, "key", "left_semi"), "mixed")


def promising(held: DataFrame, signs: DataFrame, similarity: float, coordinates: int) -> DataFrame:
    """(label, label2), label < label2: components of a bucket two of whose texts have sketches that agree enough.

    A bucket is cut into blocks of about SKETCHES texts, and every pair of blocks is one step of a task.
    """
    least = coordinates * similarity - DEVIATIONS * math.sqrt(coordinates * similarity * (1 - similarity))
    blocks = held.groupBy("key").agg(F.ceil(F.count("*") / F.lit(SKETCHES)).cast("int").alias("m"))
    rows = held.join(signs.select("node", "sketch"), "node").join(blocks, "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "label", "sketch")

    def meeting(step: tuple, own: list[int], labels: list[bytes], sketches: list[bytes]) -> set[tuple[bytes, bytes]]:
        table = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), coordinates)
        number: dict[bytes, int] = {}
        of = np.array([number.setdefault(x, len(number)) for x in labels])
        left, right = (np.flatnonzero(np.array(own) == x) for x in step[1:])
        found = set()
        for i in left:
            there = right[of[right] != of[i]]
            if step[1] == step[2]:
                there = there[there > i]
            agree = there[(table[there] == table[i]).sum(axis=1) >= least]
            found.update((min(labels[i], labels[j]), max(labels[i], labels[j])) for j in agree)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held_rows = None, ([], [], [])
        out: set[tuple[bytes, bytes]] = set()

        def given() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["label", "label2"])

        for batch in batches:
            for key, low, high, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (key, low, high) != step:
                    if step:
                        out |= meeting(step, *held_rows)
                    step, held_rows = (key, low, high), ([], [], [])
                    if len(out) > MEMORY:
                        yield given()
                for column, x in zip(held_rows, row):
                    column.append(x)
        if step:
            out |= meeting(step, *held_rows)
        yield given()

    steps = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return steps.mapInArrow(run, "label binary, label2 binary").distinct()


def linked_nodes(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, counted: bool = False) -> DataFrame:
    """(node, label) of the texts that have a near duplicate of other text."""

    def links_of(pairs: DataFrame) -> DataFrame:
        found = verified(pairs, docs, text, words, counted).where(F.col("distance") <= 1.0 - similarity + 1e-12)
        return found.select(F.col("centre").alias("a"), F.col("node").alias("b"))

    signs = written(signed(docs, text, bands, rows, words, counted), "signatures")
    keys = signs.select("node", F.explode("keys").alias("key"))
    firsts = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = written(keys.join(firsts, "key"), "buckets")
    links = links_of(shared.where(F.col("node") != F.col("centre")).select("centre", "node").distinct())
    labels = written(components(links), "star_labels")
    held = open_buckets(shared.select("key", "node"), labels)
    if held.isEmpty():
        return labels
    seconds = held.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("centre"), F.col("label").alias("own"))).alias("c")).select("key", "c.centre", "c.own")
    others = held.join(seconds, "key").where(F.col("label") != F.col("own")).select("centre", "node").distinct()
    links = links.unionByName(links_of(others))
    held = open_buckets(held.select("key", "node"), written(components(links), "second_labels"))
    nodes = written(held.select("node", "label").distinct(), "open")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.col("node") != F.col("label")).alias("several"))
    meets = written(promising(held, signs, similarity, bands * rows), "meets")
    meets = meets.join(sizes.select("label", "n", "several"), "label")
    meets = written(meets.join(sizes.select(F.col("label").alias("label2"), F.col("n").alias("n2"), F.col("several").alias("several2")), "label2"), "sized")
    singles = meets.where(~F.col("several") & ~F.col("several2")).select(F.col("label").alias("centre"), F.col("label2").alias("node"))
    swap = F.struct("n2", "label2") > F.struct("n", "label")
    hubs = meets.where(F.col("several") | F.col("several2"))
    hubs = hubs.select(F.when(swap, F.col("label2")).otherwise(F.col("label")).alias("hub"), F.when(swap, F.col("label")).otherwise(F.col("label2")).alias("guest"))
    more = hub_links(hubs, nodes, docs, text, similarity, words, counted)
    return components(links.unionByName(links_of(singles)).unionByName(more))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(node, class_id, label, copies) of every distinct text; class_id is the smallest id of its class.

    Null ids count only where a class has no other. Null texts count as empty, and all empty texts are equal.
    """
    linked = written(linked_nodes(docs, text, **options), "linked")
    node = F.unhex(F.md5(text_of(docs[text])))
    nodes = docs.select(docs[key].alias("id"), node.alias("node")).groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = written(nodes.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node")), "nodes")
    smallest = written(nodes.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("members")), "classes")
    return written(nodes.join(smallest, "label").select("node", "label", "class_id", "members"), "members")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, class_id, members) of every row: the class of its text and the number of rows in it.

    Repeated rows are members like any other; an empty table gives no rows.
    """
    found = classes(docs, key, text, **options)
    rows = docs.select(docs[key].alias(key), F.unhex(F.md5(text_of(docs[text]))).alias("_node"))
    return rows.join(found, rows["_node"] == found["node"]).select(key, "class_id", "members")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class with all its columns: that of the smallest id, of repeated rows any one."""
    found = classes(docs, key, text, **options).where("members > 1").withColumnsRenamed({"node": "_node", "label": "_label", "class_id": "_class"}).drop("members")
    found = written(found, "groups")
    node = F.unhex(F.md5(text_of(docs[text])))
    ids = docs.select(docs[key].alias("_id"), node.alias("_n"))
    ids = written(ids.join(found, ids["_n"] == found["_node"]).select("_id", "_node", "_label", "_class"), "group_rows")
    wins = F.col("_id").eqNullSafe(F.col("_class"))
    winners = ids.where(wins).groupBy("_label").agg(F.count("*").alias("n"), F.min("_node").alias("_node"))
    again = written(winners.where("n > 1").select("_label"), "again")
    losers = ids.where(~wins).select("_node", "_id").distinct()
    # Several rows of the winning id: they leave the table here and come back once below.
    repeated = ids.where(wins).join(again, "_label", "left_semi").select("_node", "_id", "_label").distinct()
    out = written(losers.unionByName(repeated.select("_node", "_id")), "out")
    side = F.broadcast(out) if out.count() <= BROADCAST_ROWS else out
    kept = docs.join(side, (node == side["_node"]) & docs[key].eqNullSafe(side["_id"]), "left_anti")
    if again.isEmpty():
        return kept
    rows = packed(docs, node=node, id=docs[key])
    back = rows.join(repeated, (F.col("node") == repeated["_node"]) & F.col("id").eqNullSafe(repeated["_id"])).dropDuplicates(["_label"])
    return kept.unionByName(unpacked(back, docs.columns))
