"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts are sets of five-word shingles. Texts with the same set are one class, counted but not
expanded. Each class has, for every tree of the forest, a label of ``DEPTH`` minimum hashes; equal
prefixes of the labels are the paths of a trie, and the texts below a path are its bucket. The forest is
climbed from whole labels up: at each length, texts of one bucket that are not yet settled, that is not
yet in one candidate group, are compared by all their hashes. What is clearly below the threshold is left,
the rest joins into candidate groups. Buckets whose texts are all settled are passed over. Prefixes are
shortened until a pair as little alike as the least alike one seen would have met with the target recall;
where few pairs were seen, a pair at the threshold.

Inside candidate groups every pair is verified on the exact shingle sets (64-bit hashes of them).
Groups beyond a block are dealt as pairs of blocks: each text goes to as many tasks as the group has
blocks, and a task hands on counts and stars over its linked texts, never the pairs.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import col, components, fresh, map_batches, map_rows, series, shingles, sorted_groups, staged, tiles, utf8, words_of

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.9997
#: Meetings of pairs in buckets after which the least alike pair tells how short prefixes must be.
ENOUGH_SEEN = 10_000
BUCKET_BLOCK = 512
VERIFY_BLOCK = 256
#: Standard errors that an estimate may lie below the threshold before a pair is left.
SLACK = 4.5

_MULTIPLIERS = (series(21, TREES * DEPTH) | np.uint64(1))[:, None]
_OWNERS = series(22, 2 * max(BUCKET_BLOCK, VERIFY_BLOCK) + 64)


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a link at the threshold is met with the wanted recall."""
    for depth in range(DEPTH, 1, -1):
        if 1 - (1 - threshold**depth) ** TREES >= recall:
            return depth
    return 1


def signature(grams: np.ndarray) -> bytes:
    """The labels of all trees: two bytes for each minimum hash, most significant first."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(grams), 2048):
            np.minimum(least, (_MULTIPLIERS * grams[None, k : k + 2048]).min(axis=1), out=least)
    return _spread(least).astype(">u2").tobytes()


def _spread(least: np.ndarray) -> np.ndarray:
    """Sixteen bits of each minimum; the high bits of a minimum are nearly all zero, so mix first."""
    with np.errstate(over="ignore"):
        return ((least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)


def _clusters(near: np.ndarray) -> np.ndarray:
    """The connected parts of a symmetric relation, by their first row."""
    cluster = np.full(len(near), -1)
    for root in range(len(near)):
        if cluster[root] >= 0:
            continue
        cluster[root], stack = root, [root]
        while stack:
            for other in np.flatnonzero(near[stack.pop()] & (cluster < 0)):
                cluster[other] = root
                stack.append(int(other))
    return cluster


def _stars(cluster: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least row of each cluster to its others. Different tasks that see parts of
    one large group mostly agree on the least row, so that their edges coincide."""
    order = np.lexsort((rid, cluster))
    cluster, rid = cluster[order], rid[order]
    starts = np.concatenate(([0], np.flatnonzero(cluster[1:] != cluster[:-1]) + 1))
    sizes = np.diff(np.append(starts, len(rid)))
    least = np.repeat(rid[starts], sizes)
    others = np.ones(len(rid), bool)
    others[starts] = False
    return least[others], rid[others]


def _ties(near: np.ndarray, node: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the nodes of a tile that ``near`` leads to. Of two blocks, each one's own ties are told
    by the tile of that block alone, so what it connects is one node here; a pair of blocks that is alike
    throughout gives one edge."""
    least = node
    if own.min() != own.max():
        part = _clusters(near & (own[:, None] == own[None, :]))
        least = np.full(len(node), np.iinfo(np.int64).max, np.int64)
        np.minimum.at(least, part, node)
        least = least[part]
    nodes, first = np.unique(least, return_index=True)
    whole = _clusters(near | (node[:, None] == node[None, :]))
    return _stars(whole[first], nodes)


def _alike(labels: np.ndarray) -> np.ndarray:
    """How many hashes each two of the signatures share."""
    out = np.zeros((len(labels), len(labels)), np.int32)
    for k in range(labels.shape[1]):
        out += labels[:, k, None] == labels[None, :, k]
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections. Shingles held by the same texts count as one column."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    counts = np.diff(np.append(starts, len(values)))
    with np.errstate(over="ignore"):
        pattern = np.add.reduceat(_OWNERS[owner], starts)
    shared = counts > 1
    starts, counts, pattern = starts[shared], counts[shared], pattern[shared]
    _, first, weight = np.unique(pattern, return_index=True, return_counts=True)
    out = np.zeros((n, n))
    for k in range(0, len(first), 4096):
        part = first[k : k + 4096]
        held = np.zeros((len(part), n), np.float32)
        row = np.repeat(np.arange(len(part)), counts[part])
        offset = np.arange(len(row)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
        held[row, owner[np.repeat(starts[part], counts[part]) + offset]] = 1
        out += (held.T * weight[k : k + 4096]) @ held
    return out


class Classes(NamedTuple):
    documents: DataFrame  # a row per document: doc_id, class_id, n_links, class_rows, copies
    winners: DataFrame  # a row per class: doc_id, text_key, n_rows of the document that stays


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
         recall: float = RECALL) -> Classes:
    """Near duplicates of whole texts: Jaccard similarity of ``threshold`` or more on word shingles.

    ``class_id`` is the least id of a document's class, the documents that links lead to;
    ``n_links`` counts the other documents linked to it, exact copies included; ``copies`` those
    with its shingle set, itself included. Texts of under five words are one shingle. A null, empty
    or wordless text has no shingle: it is alone, with no links. Null ids come last in rank; repeated
    rows are copies of each other. No documents give no rows. Extra columns are not read.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    id_field = rows.schema["doc_id"]
    schema = T.StructType([id_field, rows.schema["text_key"], T.StructField("digest", T.BinaryType()),
                           T.StructField("n", T.IntegerType()), T.StructField("label", T.BinaryType())])

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for value in utf8(batch.column(1)):
            grams = shingles(words_of(value), WORDS)
            out.append((hashlib.md5(grams.tobytes()).digest(), len(grams), signature(grams)) if len(grams) else (None, 0, None))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *(pa.array(list(v), k) for v, k in
                                                 zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.binary()), strict=True))],
            names=schema.names)

    signed = staged(map_rows(rows, schema, sign), "forest-signed")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    sets = signed.where("n > 0").groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(rank).alias("first"), F.first("label").alias("label"))
    sets = staged(sets.withColumn("rid", F.monotonically_increasing_id()), "forest-sets")

    found = _candidates(sets, threshold, recall)
    linked = staged(_verified(found, sets, rows, threshold), "forest-verified")
    classes = components(linked.where("b is not null").select("a", "b"), "forest-classes")
    links = linked.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    named = (sets.drop("label").join(classes.withColumnRenamed("node", "rid"), "rid", "left").join(links, "rid", "left")
             .withColumn("component", F.coalesce("component", "rid")))
    whole = named.groupBy("component").agg(F.min("first").alias("least"), F.sum("copies").alias("class_rows"))
    known = staged(named.join(whole, "component").select(
        "digest", "copies", "least", "class_rows", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "forest-known")
    documents = signed.select("doc_id", "digest").join(known, "digest", "left").select(
        "doc_id", F.coalesce("least.doc_id", F.when(F.col("digest").isNull(), F.col("doc_id"))).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_rows", F.lit(1)).alias("class_rows"),
        F.coalesce("copies", F.lit(1)).alias("copies"))
    least = known.select("least").distinct().select("least.doc_id", "least.text_key")
    same = signed.where("n > 0").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_rows"))
    winners = same.join(least.withColumnRenamed("doc_id", "i").withColumnRenamed("text_key", "k"),
                        F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left_semi")
    return Classes(documents, winners)


def _met(similarity: float, depth: int) -> float:
    """The chance that two texts so alike meet in a bucket of that length."""
    return 1 - (1 - similarity**depth) ** TREES


def _climbed(seen: DataFrame, depth: int, shortest: int, threshold: float, recall: float) -> bool:
    """Whether prefixes are short enough: ``seen`` tells, per number of shared hashes, the pairs met."""
    if depth <= shortest:
        return True
    row = seen.where(F.col("shared") >= threshold * TREES * DEPTH).agg(F.sum("n").alias("n"), F.min("shared").alias("least")).first()
    return (row["n"] or 0) >= ENOUGH_SEEN and _met(max(threshold, row["least"] / (TREES * DEPTH)), depth) >= recall


def _candidates(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``node`` and ``component``, the candidate groups of classes that the forest finds alike."""
    shortest = prefix_length(threshold, recall)
    groups = edges = seen = None
    for depth in range(DEPTH, shortest - 1, -1):
        found = staged(_bucket_pairs(sets, groups, depth, threshold), "forest-pairs")
        stars = found.where("b is not null").select("a", "b")
        counts = found.where("b is null").groupBy(F.col("a").alias("shared")).agg(F.sum("n").alias("n"))
        if groups is None:
            edges, seen = stars, counts
        else:
            edges, seen = groups.select(F.col("component").alias("a"), F.col("node").alias("b")).union(stars), seen.union(counts)
        if groups is None or not stars.isEmpty():
            groups = components(edges, "forest-candidates")
        if _climbed(seen, depth, shortest, threshold, recall):
            break
    return groups


def _bucket_pairs(sets: DataFrame, groups: DataFrame | None, depth: int, threshold: float) -> DataFrame:
    """Of the buckets of prefixes of that length: stars (a, b) over classes that seem alike and, with
    null ``b``, ``n`` pairs that share ``a`` hashes. Classes of one candidate group are settled."""
    step, width = 2 * DEPTH, TREES * DEPTH
    cut = threshold - SLACK * (threshold * (1 - threshold) / width) ** 0.5
    rows = sets.select("rid", "label")
    if groups is None:
        rows = rows.withColumn("settled", F.col("rid"))
    else:
        rows = rows.join(groups.withColumnRenamed("node", "rid"), "rid", "left").select(
            "rid", "label", F.coalesce("component", "rid").alias("settled"))
    paths = rows.select("rid", "settled", F.explode(F.expr(
        f"transform(sequence(0, {TREES - 1}), i -> xxhash64(i, substring(label, i * {step} + 1, {2 * depth})))")).alias("path"))
    shared = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("settled").alias("one"), F.max("settled").alias("other"))
    # written, so that the join below has shuffles of its own, in which a common path is split
    shared = staged(shared.where("one < other").select("path", "size"), "forest-paths")
    members = tiles(paths.join(shared, "path"), "path", "size", BUCKET_BLOCK, "rid")
    members = members.join(sets.select("rid", "label"), "rid")
    dealt = (members.select("path", "lo", "hi", "own", "rid", "settled", "label")
             .repartition("path", "lo", "hi").sortWithinPartitions("path", "lo", "hi"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "n")])

    def fn(batches):
        counts = np.zeros(width + 1, np.int64)
        for group in sorted_groups(batches, 3):
            if group.num_rows < 2:
                continue
            rid, settled, own = (group[c].to_numpy() for c in ("rid", "settled", "own"))
            labels = np.frombuffer(b"".join(group["label"].to_pylist()), ">u2").reshape(len(rid), width)
            if len(rid) == 2:
                alike = int((labels[0] == labels[1]).sum())
                if settled[0] != settled[1]:
                    counts[alike] += 1
                    if alike >= cut * width:
                        yield _stars_batch(np.array([settled.min()]), np.array([settled.max()]))
                continue
            alike = _alike(labels)
            same = settled[:, None] == settled[None, :]
            new = np.triu(~same, 1)
            if group["lo"][0].as_py() != group["hi"][0].as_py():
                new &= own[:, None] != own[None, :]
            counts += np.bincount(alike[new], minlength=width + 1)
            # one row stands for those of a candidate group, whose ties are known
            a, b = _ties(same | (alike >= cut * width), settled, own)
            if len(a):
                yield _stars_batch(a, b)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.nulls(len(held), pa.int64()), pa.array(counts[held], pa.int64())], names=["a", "b", "n"])

    return map_batches(dealt, schema, fn)


def _stars_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "n"])


def _verified(found: DataFrame, sets: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Stars (a, b) over linked texts and, with null ``b``, the copies linked to ``a``, tile by tile."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    wanted = (found.withColumnRenamed("node", "rid").join(sizes, "component").join(sets.select("rid", "copies", "first"), "rid")
              .select("rid", "component", "size", "copies", F.col("first.doc_id").alias("i"), F.col("first.text_key").alias("k")))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")))
    texts = texts.select("component", "size", "rid", "copies", "text").dropDuplicates(["rid"])
    dealt = tiles(texts, "component", "size", VERIFY_BLOCK, "rid")
    dealt = (dealt.select("component", "lo", "hi", "rid", "own", "copies", "text")
             .repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi"))

    def fn(batches):
        for group in sorted_groups(batches, 3):
            n = group.num_rows
            if n < 2:
                continue
            rid, own, copies = (group[c].to_numpy() for c in ("rid", "own", "copies"))
            grams = [shingles(words_of(t.encode()), WORDS) for t in group["text"].to_pylist()]
            sizes = np.array([len(g) for g in grams], np.float64)
            both = intersections(grams)
            linked = both >= (threshold - 1e-12) * (sizes[:, None] + sizes[None, :] - both)
            np.fill_diagonal(linked, False)
            roots, others = _ties(linked, rid, own)
            if group["lo"][0].as_py() != group["hi"][0].as_py():
                linked &= own[:, None] != own[None, :]
            counts = linked @ copies
            at = np.flatnonzero(counts)
            if len(at):
                empty = [None]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate((roots, rid[at])), pa.int64()),
                    pa.array([*others.tolist(), *empty * len(at)], pa.int64()),
                    pa.array([*empty * len(roots), *counts[at].astype(int).tolist()], pa.int64())], names=["a", "b", "links"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "links")])
    return map_batches(dealt, schema, fn)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: the one of least id. All columns stay; documents
    without words stay. Of rows that repeat the same id and text one stays."""
    winners = staged(join(docs, doc_id, text, threshold).winners, "forest-winners")
    key, i, k, n, bare = fresh(docs.columns, "text_key", "winner_id", "winner_key", "n_rows", "wordless")
    keyed = docs.withColumns({bare: wordless(col(text)), key: F.xxhash64(col(text))})
    named = winners.select(F.col("doc_id").alias(i), F.col("text_key").alias(k), F.col("n_rows").alias(n))
    hit = col(doc_id).eqNullSafe(F.col(i)) & (F.col(key) == F.col(k)) & ~F.col(bare)
    kept = keyed.join(named, hit, "left").where(F.col(bare) | F.col(n).isNotNull())
    if winners.where("n_rows > 1").isEmpty():
        return kept.select(*map(col, docs.columns))
    single = kept.where(F.col(bare) | (F.col(n) == 1))
    again = kept.where(~F.col(bare) & (F.col(n) > 1)).dropDuplicates([doc_id, key])
    return single.unionByName(again).select(*map(col, docs.columns))


def wordless(text: Column) -> Column:
    """Whether a text has no word: it is null, or nothing but what parts words."""
    return F.coalesce(~text.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(True))
