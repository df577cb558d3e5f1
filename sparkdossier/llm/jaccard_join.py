"""N-gram Jaccard join by a MinHash LSH forest.

Documents become sets of five-word runs (words are runs of ASCII letters and digits, in lower case, and of
characters beyond ASCII). Documents with equal sets form one node, told apart by a 128-bit BLAKE2b of the set. Each node has
a signature of 16 x 8 minimum hashes, that is 16 tries of depth 8. A trie's nodes are matched by prefix, which is shortened
from the whole path until a pair at the least similarity is met with the target probability, so recall does not depend on
the mix of duplicates; what lies below that depth is not computed. Grouping by a hash of the prefix finds the same groups as
neighbours in the sorted trie, without a global sort.

Nodes that share a prefix are candidates and verified exactly on their sets, in blocks of bounded rows and members; pairs
are counted, never emitted. Connected candidates form a component, and each component takes the cheaper of two ways: all of
it is compared at once (near copies of one text, who meet in most tries), or each prefix group by itself, where a pair counts
in the first trie in which it meets (chains of texts that only know their neighbours).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdossier.llm import _bytes as B
from sparkdossier.llm._rows import rows_of_keys
from sparkdossier.operators.graph import connected_components
from sparkdossier.session import cut

TREES, DEPTH = 16, 8
_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

#: Set members in one verification block, and its rows: a share of the cluster's, so that even a cluster of some hundred rows
#: is dealt to many tasks, within bounds. Two blocks meet in a task.
BLOCK_MEMBERS = 300_000
BLOCK_ROWS, MOST_ROWS, BLOCKS = 128, 4096, 11
#: Largest broadcast of candidate rows (of about 40 bytes each).
BROADCAST_ROWS = 200_000


def text_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word runs; a text with fewer than k words has one, without words none."""
    w = B.Words(data, offsets)
    return B.distinct_in_text(*w.grams(k, short=True), len(offsets) - 1)


def set_keys(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and 128-bit key, as two halves, of each sorted set."""
    at = B.rows_of(doc, n)
    raw, bounds = h.tobytes(), (8 * at).tolist()
    keys = b"".join(hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(bounds[:-1], bounds[1:], strict=True))
    both = np.frombuffer(keys, "<i8").reshape(n, 2)
    return np.diff(at), both[:, 0], both[:, 1]


def signatures(doc: np.ndarray, h: np.ndarray, n: int, depth: int = DEPTH) -> np.ndarray:
    """(n, 16 x depth) minima, cut to 16 bits: of each trie's path the first ``depth``; zeros for empty sets."""
    at = B.rows_of(doc, n)
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((n, TREES * depth), np.uint16)
    if len(full):
        low, starts = (h >> np.uint64(16)).astype(np.uint32), at[:-1][full]
        for j in range(TREES * depth):
            k = j // depth * DEPTH + j % depth
            out[full, j] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], starts).astype(np.uint16)
    return out


def _sign(k: int, depth: int):
    """Rows (doc_id, text_hash, text) to (doc_id, text_hash, hi, lo, size, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, data, offsets in B.pieces(*B.text_buffer(batch.column(2))):
                doc, h = text_sets(data, offsets, k)
                size, hi, lo = set_keys(doc, h, z - a)
                sig = signatures(doc, h, z - a, depth).tobytes()
                width = 2 * TREES * depth
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), pa.array(hi), pa.array(lo), pa.array(size.astype(np.int32)),
                     pa.array([sig[i : i + width] for i in range(0, len(sig), width)], pa.binary())],
                    ["doc_id", "text_hash", "hi", "lo", "size", "sig"],
                )

    return run


def _sets(k: int):
    """Rows (units, paths, nid, copies, hi, lo, text) to (units, paths, nid, copies, members), each node once for all rows here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, z, data, offsets in B.pieces(*B.text_buffer(batch.column("text"))):
                doc, h = text_sets(data, offsets, k)
                _, hi, lo = set_keys(doc, h, z - a)
                at, raw, part = B.rows_of(doc, z - a).tolist(), h.tobytes(), batch.slice(a, z - a)
                # The row's doc_id may stand on other texts too, and the row itself may be repeated.
                same = (hi == part.column("hi").to_numpy()) & (lo == part.column("lo").to_numpy())
                for i, nid in enumerate(part.column("nid").to_pylist()):
                    if same[i]:
                        same[i] = nid not in seen
                        seen.add(nid)
                part = part.append_column("members", pa.array([raw[8 * x : 8 * y] for x, y in zip(at, at[1:])], pa.binary()))
                yield part.select(["units", "paths", "nid", "copies", "members"]).filter(pa.array(same))

    return run


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, least: float) -> np.ndarray:
    """Which pairs have a Jaccard index of ``least`` or more; members found in one set only never enter the product."""
    both = left + (right or [])
    sizes = np.array([len(x) for x in both], np.int64)
    _, col, seen = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    n, m = len(left), len(right) if right is not None else len(left)
    common = np.zeros((n, m), np.float32)
    wide = 1024  # columns of a product, so that its sides stay small beside the counts
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        x, y = np.searchsorted(col, (c, c + wide))
        dense = np.zeros((len(both), wide), np.float32)
        dense[row[x:y], col[x:y] - c] = 1
        common += dense[:n] @ (dense[n:] if right is not None else dense).T
    total = sizes[:n, None] + (sizes[n:] if right is not None else sizes)[None, :] - common
    found = common >= np.float64(least) * total - 1e-6
    if right is None:
        np.fill_diagonal(found, False)
    return found


def _forest(n: int, found: np.ndarray, shift: int) -> np.ndarray:
    """Least row reachable from each row, for links between rows i and shift + j."""
    label = np.arange(n, dtype=np.int32)
    left = slice(0, found.shape[0])
    right = slice(shift, shift + found.shape[1])
    while True:
        old = label.copy()
        big = np.where(found, label[right][None, :], np.int32(n)).min(axis=1)
        label[left] = np.minimum(label[left], big)
        big = np.where(found, label[left][:, None], np.int32(n)).min(axis=0)
        label[right] = np.minimum(label[right], big)
        label = label[label]
        if (label == old).all():
            return label


def _met_before(left: list[list[int]], right: list[list[int]] | None, trie: int) -> np.ndarray:
    """Which pairs share a path of a trie before ``trie``."""
    a = np.array(left, np.int64)
    b = a if right is None else np.array(right, np.int64)
    out = np.zeros((len(a), len(b)), bool)
    for t in range(trie):
        out |= a[:, t, None] == b[None, :, t]
    return out


def _verify(least: float):
    """Sorted rows of (unit, trie, x, y, side, nid, copies, paths, members), x <= y, to per-row counts and a spanning label.

    ``trie`` is -1 for a component compared as a whole, else that of the prefix group.
    """

    def close(rows: list[tuple]) -> tuple[list, list, list, list]:
        left = [r for r in rows if r[4] == 0]
        right = [r for r in rows if r[4] == 1]
        both = left + right
        if rows[0][2] == rows[0][3]:
            found, shift, right = _links([r[8] for r in left], None, least), 0, []
        elif left and right:
            found, shift = _links([r[8] for r in left], [r[8] for r in right], least), len(left)
        else:
            return [], [], [], []
        if rows[0][1] > 0:
            found &= ~_met_before([r[7] for r in left], [r[7] for r in right] or None, rows[0][1])
        weight = np.array([r[6] for r in both])
        texts = np.zeros(len(both), np.int64)
        links = np.zeros(len(both), np.int64)
        texts[: len(left)] = found.sum(axis=1)
        links[: len(left)] = found @ weight[shift : shift + found.shape[1]]
        if right:
            texts[len(left) :] = found.sum(axis=0)
            links[len(left) :] = weight[: len(left)] @ found
        ids = np.array([r[5] for r in both])
        order = np.argsort(ids, kind="stable")  # so that the least row is the least id
        if right:
            label = _forest(len(both), found, shift)
            low = np.full(len(both), np.iinfo(np.int64).max)
            np.minimum.at(low, label, ids)
            head = low[label]
        else:
            label = _forest(len(both), found[np.ix_(order, order)], 0)
            head = np.empty(len(both), np.int64)
            head[order] = ids[order][label]
        use = np.flatnonzero((texts > 0) | (head != ids))
        return ids[use].tolist(), texts[use].tolist(), links[use].tolist(), head[use].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: tuple[list, ...] = ([], [], [], [])

        def give() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["nid", "texts", "links", "head"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(8)), map(lambda x: np.frombuffer(x, np.uint64), batch.column(8).to_pylist())):
                if rows and rows[0][:4] != r[:4]:
                    for x, y in zip(out, close(rows)):
                        x += y
                    rows = []
                    if len(out[0]) > 20_000:
                        yield give()
                if not rows or rows[-1][4:6] != r[4:6]:  # a repeated row is no second node
                    rows.append(r)
        if rows:
            for x, y in zip(out, close(rows)):
                x += y
        yield give()

    return run


def _paths(nodes: DataFrame, depth: int) -> DataFrame:
    """One row per node and trie: the trie's number and the hash of the path."""
    return nodes.select("nid", F.posexplode(_hashed_paths(depth)).alias("trie", "path"))


def _hashed_paths(depth: int) -> F.Column:
    return F.expr(f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(sig, t * {2 * depth} + 1, {2 * depth})))")


def path_depth(least: float, target: float, least_depth: int = 1) -> int:
    """Longest prefix at which a pair of similarity ``least`` shares a path of some trie with probability ``target`` or more.

    What meets at a longer prefix meets at this one too, and pairs above ``least`` meet more often, whatever else the table holds.
    """
    for depth in range(DEPTH, least_depth - 1, -1):
        if 1 - (1 - least**depth) ** TREES >= target:
            return depth
    raise ValueError(f"{TREES} tries cut at depth {least_depth} do not reach recall {target} at similarity {least}")


def _classes(docs: DataFrame, k: int, least: float, target: float, least_depth: int) -> DataFrame:
    """What ``jaccard_classes`` returns, with ``text_hash`` (of the row's text) and ``class_nid`` (null without a set or id)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    depth = path_depth(least, target, least_depth)
    signed = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
            _sign(k, depth), "doc_id long, text_hash long, hi long, lo long, size int, sig binary"
        )
    )
    ids = signed.where("doc_id is not null and size > 0")
    # A node's number is written with it, so it stays what it is when tasks are run again.
    grouped = ids.groupBy("hi", "lo").agg(F.min("doc_id").alias("rid"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.max("sig").alias("sig"))
    nodes = cut(grouped.withColumn("nid", F.monotonically_increasing_id()))

    paths = _paths(nodes, depth)
    groups = paths.groupBy("trie", "path").agg(F.min("nid").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(paths.join(groups, ["trie", "path"]).select("nid", "head", "trie", "path", "n"))
    clusters = connected_components(met.where("nid <> head").select("nid", "head").distinct(), "nid", "head").withColumnsRenamed({"node": "nid", "component": "cluster"})

    # What a component costs: all of its pairs at once, or those of its prefix groups one by one.
    square = F.col("n").cast("double") * F.col("n")
    by_groups = met.where("nid = head").join(clusters, "nid").groupBy("cluster").agg(F.sum(square).alias("cost"))
    whole = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(by_groups, "cluster").select("cluster", (square <= F.col("cost")).alias("whole"))
    placed = cut(clusters.join(whole, "cluster"))
    of_whole = placed.where("whole").select("nid", F.col("cluster").alias("unit"), F.lit(-1).alias("trie"))
    of_groups = met.join(placed.where("not whole"), "nid", "left_semi").select("nid", F.col("path").alias("unit"), "trie")
    units = of_whole.unionByName(of_groups)
    sized = units.join(nodes.select("nid", "size"), "nid").groupBy("unit", "trie").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("members"))
    most = F.least(F.greatest(F.ceil(F.col("n") / BLOCKS), F.lit(BLOCK_ROWS)), F.lit(MOST_ROWS))
    nb = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("n") / most)).cast("int")
    # Written, so that the join stands on two plain exchanges and a large unit's nodes can be split among tasks. A node is in
    # one unit, or in one for each trie.
    blocks = cut(sized.select("unit", "trie", nb.alias("nb")))
    of_node = units.join(blocks, ["unit", "trie"]).groupBy("nid").agg(F.collect_list(F.struct("unit", "trie", "nb")).alias("units"))
    paths_of = F.when(F.col("units")[0]["trie"] >= 0, _hashed_paths(depth))
    wanted = cut(of_node.join(nodes.select("nid", "rid", "hi", "lo", "copies", "sig"), "nid").select("units", paths_of.alias("paths"), "nid", "rid", "hi", "lo", "copies"))
    n_wanted = wanted.count()

    texts = docs.select(F.col("doc_id").cast("long").alias("rid"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(wanted) if n_wanted <= BROADCAST_ROWS else wanted, "rid")
    unit_type = "array<struct<unit: long, trie: int, nb: int>>"
    sets = found.select("units", "paths", "nid", "copies", "hi", "lo", "text").mapInArrow(_sets(k), f"units {unit_type}, paths array<long>, nid long, copies long, members binary")
    sets = sets.select("nid", "copies", "paths", "members", F.explode("units").alias("u")).select("u.unit", "u.trie", "u.nb", "nid", "copies", "paths", "members")
    # Block b meets blocks x < b as the right side, itself, and blocks y > b as the left side.
    sets = sets.withColumn("b", F.pmod(F.xxhash64("nid"), F.col("nb")).cast("int"))
    meets = F.expr("transform(sequence(0, nb - 1), o -> named_struct('x', least(b, o), 'y', greatest(b, o), 'side', if(o < b, 1, 0)))")
    tasks = sets.select("unit", "trie", "nid", "copies", "paths", "members", F.explode(meets).alias("t")).select("unit", "trie", "t.x", "t.y", "t.side", "nid", "copies", "paths", "members")
    # A unit's pairs of blocks go to one task after the other, not by chance.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.expr(f"CAST(pmod(xxhash64(unit) + CAST(y AS BIGINT) * (y + 1) div 2 + x, {parts}) AS INT)")
    tasks = tasks.repartitionById(parts, number).sortWithinPartitions("unit", "trie", "x", "y", "side", "nid")
    checked = cut(tasks.mapInArrow(_verify(least), "nid long, texts long, links long, head long"))

    counts = checked.groupBy("nid").agg(F.sum("texts").alias("texts"), F.sum("links").alias("links"))
    linked = connected_components(checked.where("nid <> head"), "nid", "head").withColumnsRenamed({"node": "nid", "component": "class_nid"})
    least_id = linked.join(nodes.select("nid", "rid"), "nid").groupBy("class_nid").agg(F.min("rid").alias("class"))
    known = nodes.select("hi", "lo", "nid", "rid", "copies").join(counts, "nid", "left").join(linked, "nid", "left").join(least_id, "class_nid", "left")
    return (
        signed.select("doc_id", "text_hash", "hi", "lo", "size").alias("d")
        .join(known.alias("n"), (F.col("d.hi") == F.col("n.hi")) & (F.col("d.lo") == F.col("n.lo")) & (F.col("d.size") > 0) & F.col("d.doc_id").isNotNull(), "left")
        .select(
            F.col("d.doc_id"),
            F.coalesce("n.class", "n.rid", "d.doc_id").alias("class_id"),
            F.coalesce("n.rid", "d.doc_id").alias("text_id"),
            F.coalesce("n.copies", F.lit(1)).cast("long").alias("copies"),
            F.coalesce("n.texts", F.lit(0)).cast("long").alias("n_text_links"),
            (F.coalesce("n.links", F.lit(0)) + F.coalesce("n.copies", F.lit(1)) - 1).cast("long").alias("n_links"),
            F.col("d.text_hash"),
            F.coalesce("n.class_nid", "n.nid").alias("class_nid"),
        )
    )


def jaccard_classes(docs: DataFrame, k: int = 5, least: float = 0.8, target: float = 0.999, least_depth: int = 1) -> DataFrame:
    """One row per document: ``doc_id, class_id, text_id, copies, n_text_links, n_links``.

    A pair at similarity ``least`` is a candidate with probability ``target`` or more; where that takes prefixes shorter than
    ``least_depth``, an error is raised.
    ``class_id`` is the least doc_id of all documents connected by links (similarity ``least`` or more),
    ``text_id`` the least doc_id of those with an equal set, ``copies`` their number, ``n_text_links`` the number of
    other sets linked to this one, and ``n_links`` the number of other documents linked, copies included.
    A null or wordless text has no set: it is its own class, with no links. A null doc_id takes no part: its other
    columns are null, its counts 0. Repeated rows count as copies. A doc_id that stands on several texts
    has a row for each, each with the class of its own text. Texts of fewer than k words have their whole word sequence as
    only member. Members are 64-bit hashes without structure; unlike runs share one by chance only.
    """
    return _classes(docs, k, least, target, least_depth).drop("text_hash", "class_nid")


def keep_one_per_class(docs: DataFrame, k: int = 5, least: float = 0.8, target: float = 0.999, least_depth: int = 1) -> DataFrame:
    """The rows of ``docs``, one for each class of near copies: that of the least doc_id, of equal ids that of the least hash.

    Texts without a set are a class for each doc_id and text. Rows with a null doc_id stay, all of them. Of rows that repeat
    a doc_id and a text one stays. A doc_id on texts of several classes may stay with each of them.
    """
    named = _classes(docs, k, least, target, least_depth).where("doc_id is not null")
    # Without a set, the text itself is the class.
    alone = F.when(F.col("class_nid").isNull(), F.struct("doc_id", "text_hash"))
    kept = named.groupBy("class_nid", alone.alias("alone")).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    rows = named.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    kept = kept.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")).join(rows, ["doc_id", "text_hash"])
    return rows_of_keys(docs, cut(kept)).unionByName(docs.where("doc_id is null"))
