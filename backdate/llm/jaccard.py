"""N-gram Jaccard join by MinHash banding, and the near-duplicate classes it makes.

Texts with equal shingle sets are one node, however many copies there are. The
bands of a node's MinHash signature are dealt by hash; nodes that meet in a band
are joined to the least node there, never to each other, and the connected
parts of that graph are the groups within which pairs are verified on the full
shingle sets. A group is cut into blocks of bounded size and every pair of
blocks is one task, which counts links per node and returns one edge per node,
so a large group costs time in many tasks but no rows per pair.

Band and row counts are chosen so that a pair at the threshold meets with the
target recall. Inside a group all pairs are verified, so none that met is lost.

Defined results: a text of fewer than n words has one shingle, all its words; a
NULL text or one without words is in a class of its own with no links; NULL ids
are kept. Repeated rows are copies like any other. Nodes are named by a 64-bit
hash of their set; the shingles of a set are compared by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backdate.llm.common import WORD, stored
from backdate.llm.components import components
from backdate.llm.fingerprints import chunks, mix, shingles, signed, words_of

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
MOST_HASHES = 128
BLOCK_BYTES, BLOCK_ROWS = 1 << 19, 256
PACK_BYTES = 1 << 22
CELLS = 1 << 24


def bands_for(threshold: float, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most rows, thus the fewest false meetings, that reach ``recall`` at ``threshold``."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        meet = threshold**rows
        bands = 1 if meet >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-meet)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def _signatures(n_words: int, bands: int, rows: int):
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, places in chunks(batch, "text"):
                owner, grams = shingles(words_of(raw, places), n_words)
                texts = part.num_rows
                size = np.bincount(owner, minlength=texts)
                full = np.flatnonzero(size)
                node, bits = np.zeros(texts, np.uint64), np.zeros((texts, bands), np.uint64)
                if len(full):
                    starts = np.searchsorted(owner, full)
                    node[full] = mix(np.add.reduceat(mix(grams), starts) + size[full].astype(np.uint64))
                    for b in range(bands):
                        band = np.zeros(len(full), np.uint64)
                        for r in range(rows):
                            least = np.minimum.reduceat(grams * factors[b * rows + r], starts)
                            band = mix(band * factors[r] + least)
                        bits[full, b] = band
                sets = pa.array(np.where(size > 0, signed(node), 0), pa.int64(), mask=size == 0)
                flat = pa.array(signed(bits.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, texts * bands + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_key"), sets, pa.array(size.astype(np.int64)), pa.array(np.diff(places)), lists],
                    ["doc_id", "row_key", "node", "n_shingles", "n_bytes", "bands"],
                )

    return sign


def row_key() -> Column:
    """Names a row by its id and text, so that ids need not be unique."""
    return F.xxhash64("doc_id", "text")


def signatures(docs: DataFrame, n_words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, row_key, node, n_shingles, n_bytes, bands`` of every row; node is NULL without words."""
    bands, rows = bands_for(threshold, recall)
    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(
        _signatures(n_words, bands, rows), "doc_id long, row_key long, node long, n_shingles long, n_bytes long, bands array<long>"
    )


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of ``nodes (node, bands)`` that meet another in some band."""
    dealt = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    # Minimum and maximum are combined before the shuffle, so a full bucket stays small.
    shared = stored(dealt.groupBy("band", "value").agg(F.min("node").alias("least"), F.max("node").alias("most"))
                    .where("least <> most").drop("most"))
    met = dealt.join(shared, ["band", "value"])
    return components(met.select(F.col("node").alias("u"), F.col("least").alias("v")))


def _verify(n_words: int, threshold: float):
    def labels(links: np.ndarray) -> np.ndarray:
        """The least index that each row is connected to."""
        n = len(links)
        label = np.arange(n)
        while True:
            near = np.where(links, label[None, :], n).min(axis=1)
            new = np.minimum(label, near)
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def one_group(node: np.ndarray, side: np.ndarray, copies: np.ndarray, owner: np.ndarray, grams: np.ndarray, crossed: bool):
        n = len(node)
        size = np.bincount(owner, minlength=n).astype(np.int64)
        _, which, often = np.unique(grams, return_inverse=True, return_counts=True)
        common = often[which] > 1
        owner, column = owner[common], which[common]
        used, column = np.unique(column, return_inverse=True)
        shared = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = max(1, CELLS // max(1, n))
        for low in range(0, len(used), width):
            a, b = np.searchsorted(column, [low, low + width])
            cells = np.zeros((n, min(width, len(used) - low)), np.float32)
            cells[owner[a:b], column[a:b] - low] = 1
            shared += cells @ cells.T
        shared = np.rint(shared).astype(np.int64)
        union = size[:, None] + size[None, :] - shared
        links = shared >= threshold * union - 1e-9
        np.fill_diagonal(links, False)
        if crossed:
            # Pairs within one block are the task of that block with itself.
            links &= side[:, None] != side[None, :]
        root = labels(links)
        keep = links.any(axis=1)
        return node[keep], node[root[keep]], links.sum(axis=1)[keep], (links @ copies)[keep]

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([("component", "ascending"), ("node", "ascending")])
        component = group["component"].to_numpy()
        node, side, copies = (group[c].to_numpy() for c in ("node", "block", "copies"))
        crossed = group["first"][0].as_py() != group["second"][0].as_py()
        text = pa.RecordBatch.from_arrays([group["text"].combine_chunks()], ["text"])
        owners, sets, at = [], [], 0
        for part, raw, places in chunks(text, "text"):
            owner, grams = shingles(words_of(raw, places), n_words)
            owners.append(owner + at)
            sets.append(grams)
            at += part.num_rows
        owner, grams = np.concatenate(owners), np.concatenate(sets)
        found = []
        edges = np.flatnonzero(np.diff(component)) + 1
        for a, b in zip([0, *edges], [*edges, len(component)], strict=True):
            x, y = np.searchsorted(owner, [a, b])
            if b - a > 1:
                found.append(one_group(node[a:b], side[a:b], copies[a:b], owner[x:y] - a, grams[x:y], crossed))
        cols = [np.concatenate([np.asarray(f[i], np.int64) for f in found] or [np.zeros(0, np.int64)]) for i in range(4)]
        return pa.table(cols, names=["node", "root", "links", "linked_rows"])

    return verify


def verified_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, n_words: int, threshold: float) -> DataFrame:
    """``node, root, links, linked_rows`` per node and pair of blocks, each pair of nodes compared once.

    ``root`` is a node connected to it. ``nodes`` has ``node, row_key, copies, n_bytes``;
    the row of that key has the node's text.
    """
    members = stored(nodes.join(groups, "node").select("node", "row_key", "copies", "n_bytes", "component"))
    sizes = stored(members.groupBy("component").agg(F.greatest(
        F.ceil(F.sum("n_bytes") / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)
    ).cast("int").alias("blocks")))
    total = members.agg(F.sum("n_bytes")).first()[0] or 0
    packs = max(1, -(-total // PACK_BYTES))
    cut = members.join(sizes, "component").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    # Equal rows have one key; they are dropped before the shuffle, so each node meets its own text once.
    texts = docs.select(row_key().alias("row_key"), "text").dropDuplicates(["row_key"])
    # A group of one block shares a task with others; else a task is a pair of blocks.
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.col("component"))
    placed = cut.join(texts, "row_key").select(
        task.alias("task"), (F.col("blocks") > 1).alias("large"), "component", "node", "block", "copies", "text",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    return placed.select("task", "large", "first", "second", "component", "node", "block", "copies", "text").groupBy(
        "task", "large", "first", "second"
    ).applyInArrow(_verify(n_words, threshold), "node long, root long, links long, linked_rows long")


def jaccard_classes(
    docs: DataFrame, n_words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """``doc_id, class_id, n_links, n_linked_texts, n_shingles, row_key, class_key`` of every row of ``docs (doc_id, text)``.

    ``class_id`` is the least id of the class, that is of all documents reached
    over links; classes may share it where ids are NULL or not unique.
    ``class_key`` tells all classes apart and is NULL without words. ``n_links`` counts the other documents similar to this one,
    copies of its own set included, ``n_linked_texts`` the different sets.
    """
    signed_docs = stored(signatures(docs, n_words, threshold, recall))
    known = signed_docs.where("node is not null")
    ids = known.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.count(F.lit(1)).alias("copies"),
        F.max("n_bytes").alias("n_bytes"),
    )
    nodes = stored(ids)
    banded = stored(known.select("node", "bands").dropDuplicates(["node"]))
    groups = stored(candidate_groups(banded))
    links = stored(verified_links(docs, nodes, groups, n_words, threshold))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("linked_rows").alias("linked_rows"))
    classes = stored(components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    named = stored(nodes.join(classes, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")))
    least = stored(named.groupBy("component").agg(F.min("doc_id").alias("class_id")))
    facts = stored(
        named.join(least, "component").join(counted, "node", "left").join(nodes.select("node", "copies"), "node")
        .select(F.col("node").alias("f_node"), F.col("component").alias("class_key"), "class_id", "copies",
                F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked_rows", F.lit(0)).alias("linked_rows"))
    )
    return signed_docs.join(facts, signed_docs["node"] == facts["f_node"], "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("linked_rows"), F.lit(0)).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_linked_texts"), "n_shingles", "row_key", "class_key",
    )


def one_per_class(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the least id, with its own columns; all documents without words."""
    classes = jaccard_classes(docs).where((F.col("n_shingles") == 0) | F.col("class_id").eqNullSafe(F.col("doc_id")))
    # Of rows that share the least id, the one of least key.
    least = classes.where("n_shingles > 0").groupBy("class_key").agg(F.min("row_key").alias("k_key"))
    empty = classes.where("n_shingles = 0").select(F.col("row_key").alias("k_key"))
    kept = stored(least.select("k_key").unionByName(empty).distinct())
    words = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("k_key"), words.alias("words"))
    found = rows.join(kept, "k_key")
    once = found.where("words").dropDuplicates(["k_key"])
    return once.unionByName(found.where("not words")).select("row.*")
