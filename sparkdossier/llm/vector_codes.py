"""Vector codes: product quantisation whose codebooks are learned by filtering Lloyd rounds, in whole numbers.

A vector becomes integers floor(256 x) and is cut into 16 equal parts; each part position has a codebook of up to 64 entries.
Every task builds a forest over its rows, one kd-tree for each part position and block of rows: nodes cache their bounding
box and the sum and count of their parts. The forests are written to the shared folder once. A round sends the codebooks
down the trees: an entry leaves a node's candidates when no point of the box can be nearest to it, and a node with one
candidate left is assigned as a whole from its cached sum and count. Only leaves compare single parts, with the candidates
that are left. Tasks return sums and counts for each entry; what reaches the driver is a codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdossier.session import scratch

PARTS, ENTRIES, SCALE = 16, 64, 256
#: Rows of a block, whose trees are built and searched together, and parts of a leaf at most.
BLOCK, LEAF = 4096, 12


def largest(dims: int) -> int:
    """Components up to this size keep every squared distance and its sum over a vector within a long."""
    return int((2**61 / max(1, dims)) ** 0.5)


class Forest:
    """kd-trees, one per part position, over ``parts`` of shape (positions, rows, width), level by level.

    Nodes of a level are runs of ``order``. ``lo``, ``hi``, ``total`` and ``begin`` hold box, sum and run of each node, level
    after level; the children of node i of a level are nodes 2 i and 2 i + 1 of the next.
    """

    def __init__(self, rows: int, order: np.ndarray, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, total: np.ndarray):
        self.rows, self.order, self.points, self.lo, self.hi, self.total = rows, order, points, lo, hi, total

    @staticmethod
    def bounds(rows: int) -> list[np.ndarray]:
        """For each level the starts of the nodes of one tree, ending with ``rows``; halves until a leaf is small enough."""
        levels = [np.array([0, rows])]
        while np.diff(levels[-1]).max() > LEAF:
            b = levels[-1]
            levels.append(np.append(np.stack([b[:-1], (b[:-1] + b[1:]) // 2], 1).ravel(), rows))
        return levels

    @staticmethod
    def runs(rows: int, positions: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Starts and ends of the nodes of all trees, for each level."""
        shift = (np.arange(positions) * rows)[:, None]
        return [((b[:-1] + shift).ravel(), (b[1:] + shift).ravel()) for b in Forest.bounds(rows)]

    @classmethod
    def build(cls, parts: np.ndarray) -> Forest:
        positions, rows, width = parts.shape
        flat = parts.reshape(positions * rows, width)
        order, lo, hi, total = np.arange(positions * rows), [], [], []
        levels = cls.runs(rows, positions)
        for depth, (begin, end) in enumerate(levels):
            p = flat[order]
            lo.append(np.minimum.reduceat(p, begin))
            hi.append(np.maximum.reduceat(p, begin))
            total.append(np.add.reduceat(p, begin))
            if depth + 1 < len(levels):
                side = (hi[-1] - lo[-1]).argmax(1)
                node = np.repeat(np.arange(len(begin)), end - begin)
                order = order[np.lexsort((p[np.arange(len(p)), side[node]], node))]
        return cls(rows, order, flat[order], np.concatenate(lo), np.concatenate(hi), np.concatenate(total))

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of every part by position and row, and each entry's sum and count; ties go to the lower entry.

        ``books`` has the shape (positions, entries, width).
        """
        positions, k, width = books.shape
        flat = books.reshape(positions * k, width)
        code = np.empty(positions * self.rows, np.int64)
        sums, counts = np.zeros((positions * k, width), np.int64), np.zeros(positions * k, np.int64)
        node, entry = np.repeat(np.arange(positions), k), np.arange(positions * k)
        levels, first = self.runs(self.rows, positions), 0
        for depth, (begin, end) in enumerate(levels):
            node, entry = self._filter(first, node, entry, flat)
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            size = np.diff(np.append(starts, len(node)))
            whole = starts[size == 1]
            at, to = node[whole], entry[whole]
            _add(sums, to, self.total[first + at])
            counts += np.bincount(to, end[at] - begin[at], len(counts)).astype(np.int64)
            code[_ranges(begin[at], end[at])] = np.repeat(to, end[at] - begin[at])
            more = np.repeat(size > 1, size)
            node, entry = node[more], entry[more]
            if not len(node):
                break
            first += len(begin)
            if depth + 1 < len(levels):
                # Children stand beside each other, each with all candidates of its parent.
                starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
                size = np.diff(np.append(starts, len(node)))
                index = _ranges(np.repeat(starts, 2), np.repeat(starts + size, 2))
                node = np.repeat(np.stack([2 * node[starts], 2 * node[starts] + 1], 1).ravel(), np.repeat(size, 2))
                entry = entry[index]
        else:
            self._leaves(begin, end, node, entry, flat, code, sums, counts)
        back = np.empty_like(code)
        back[self.order] = code
        return back.reshape(positions, self.rows) - (np.arange(positions) * k)[:, None], sums, counts

    def _filter(self, first: int, node: np.ndarray, entry: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that some point of their node's box may be nearest to; pairs are sorted by node, then entry."""
        lo, hi = self.lo[first + node], self.hi[first + node]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(starts, len(node)))
        z = flat[entry]
        middle = ((2 * z - lo - hi).astype(np.float64) ** 2).sum(1)  # only chooses whom the others are held against
        best = np.minimum.reduceat(middle, starts)
        hits = np.flatnonzero(middle == np.repeat(best, size))
        own = np.searchsorted(starts, hits, "right") - 1
        chosen = hits[np.append(True, own[1:] != own[:-1])] if len(hits) else hits
        rival = np.repeat(entry[chosen], size)
        r = flat[rival]
        corner = np.where(z > r, hi, lo)
        lead = ((r - corner) ** 2).sum(1) - ((z - corner) ** 2).sum(1)  # greatest over the box of d(rival) - d(candidate)
        keep = (entry == rival) | (lead > 0) | ((lead == 0) & (entry < rival))
        return node[keep], entry[keep]

    def _leaves(self, begin, end, node, entry, flat, code, sums, counts) -> None:
        """Compares the parts of leaves with the candidates that are left to them."""
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(starts, len(node)))
        own, held = node[starts], end[node[starts]] - begin[node[starts]]
        point = _ranges(begin[own], end[own])
        many = np.repeat(size, held)
        pairs = _ranges(np.repeat(starts, held), np.repeat(starts + size, held))
        e = entry[pairs]
        gap = ((self.points[np.repeat(point, many)] - flat[e]) ** 2).sum(1)
        at = np.concatenate([[0], np.cumsum(many)[:-1]])
        least = np.minimum.reduceat(gap, at)
        hits = np.flatnonzero(gap == np.repeat(least, many))
        of = np.searchsorted(at, hits, "right") - 1
        to = e[hits[np.append(True, of[1:] != of[:-1])]]
        code[point] = to
        _add(sums, to, self.points[point])
        counts += np.bincount(to, minlength=len(counts))


def _add(sums: np.ndarray, to: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the sum it goes to, in whole numbers."""
    if len(to):
        by = np.argsort(to, kind="stable")
        to = to[by]
        starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        sums[to[starts]] += np.add.reduceat(rows[by], starts)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the runs, one run after another."""
    size = end - begin
    if not size.sum():
        return np.zeros(0, np.int64)
    return np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _plant(dims: int):
    """Blocks of rows with their forests, one row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                cells = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                parts = np.ascontiguousarray(cells.reshape(b.num_rows, PARTS, dims // PARTS).transpose(1, 0, 2))
                f = Forest.build(parts)
                small = [x.astype(t).tobytes() for x, t in ((f.order, "<i4"), (f.points, "<i4"), (f.lo, "<i4"), (f.hi, "<i4"), (f.total, "<i8"))]
                lists = [pa.ListArray.from_arrays([0, b.num_rows], b.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in small), *lists], ["places", *TREE, "ids", "labels"])

    return run


#: Columns of a block that hold its trees.
TREE = ("points", "lo", "hi", "total")


def _forests(batch: pa.RecordBatch, positions: int, width: int) -> Iterator[tuple[int, Forest]]:
    """Row numbers and forests of a batch of blocks, one after another."""
    for i in range(batch.num_rows):
        cells = [np.frombuffer(batch.column(c)[i].as_buffer(), "<i8" if c == "total" else "<i4").astype(np.int64).reshape(-1, width) for c in TREE]
        order = np.arange(len(cells[0]))
        if "places" in batch.schema.names:
            order = np.frombuffer(batch.column("places")[i].as_buffer(), "<i4").astype(np.int64)
        yield i, Forest(len(order) // positions, order, *cells)


def _round(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, k, width = books.shape
        sums, counts = np.zeros((positions * k, width), np.int64), np.zeros(positions * k, np.int64)
        for batch in batches:
            for _, f in _forests(batch, positions, width):
                _, s, c = f.assign(books)
                sums += s
                counts += c
        used = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * width, sums[used].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), lists], ["entry", "n", "sums"])

    return run


def _final(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, k, width = books.shape
        for batch in batches:
            for i, f in _forests(batch, positions, width):
                code, _, _ = f.assign(books)
                flat = np.empty_like(f.points)
                flat[f.order] = f.points
                near = books[np.arange(positions)[:, None], code].reshape(-1, width)
                error = ((flat - near) ** 2).sum(1).reshape(positions, -1).sum(0)
                text = np.ascontiguousarray(code.T.astype(np.uint8)).tobytes().hex()
                codes = [text[a : a + 2 * positions] for a in range(0, len(text), 2 * positions)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(codes), pa.array(error)], ["vec_id", "vq_label", "code", "error"])

    return run


def encode_vectors(embeddings: DataFrame, vector: str = "embedding", rounds: int = 2, entries: int = ENTRIES) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each kept row.

    Rows whose vector is null, empty or holds a null or a component that is not finite are dropped. The width is that of the
    row with the least vec_id whose vector is a multiple of 16 long; vectors of another length, and those with a component
    beyond ``largest(width)`` after scaling (their error would not fit a long), have a row with null code and error and take
    part in nothing else. Codebooks start with the rows of the least vec_ids, nulls last and equal ids by their components;
    fewer rows than ``entries`` give as many entries. Repeated rows each count. ``label_error`` sums the errors of equal
    labels, nulls together; a sum beyond a long is null. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    whole = lambda v: F.floor(v.cast("double") * SCALE)
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    got = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    got = got.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("vq_label"), F.col(vector).alias("vq_vector"))

    def fits(limit: F.Column) -> F.Column:
        return F.forall("vq_vector", lambda v: F.abs(whole(v)).cast("double") <= limit)

    def least(rows: DataFrame) -> list:
        return rows.orderBy(F.col("vec_id").asc_nulls_last(), "vq_vector").limit(entries).select(F.transform("vq_vector", whole).alias("cells")).collect()

    empty = got.select("vec_id", "vq_label", "vq_vector", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    seeds = least(got.where((F.size("vq_vector") % PARTS == 0) & fits(F.sqrt(F.lit(2.0**61) / F.size("vq_vector")))))
    if not seeds:
        return empty.select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    dims = len(seeds[0].cells)
    coded_rows = (F.size("vq_vector") == dims) & fits(F.lit(float(largest(dims))))
    kept = got.where(coded_rows).select("vec_id", "vq_label", F.transform("vq_vector", lambda v: whole(v).cast("int")).alias("vq_cells"))
    if any(len(r.cells) != dims for r in seeds):
        seeds = least(got.where(coded_rows))
    width = dims // PARTS
    books = np.array([r.cells for r in seeds], np.int64).reshape(len(seeds), PARTS, width).transpose(1, 0, 2).copy()

    path = scratch(spark, "vector-forests")
    label_type = got.schema["vq_label"].dataType.simpleString()
    block = f"places binary, {', '.join(f'{c} binary' for c in TREE)}, ids array<bigint>, labels array<{label_type}>"
    kept.mapInArrow(_plant(dims), block).write.parquet(path)
    forests = spark.read.parquet(path)
    for _ in range(rounds):
        part = forests.select(*TREE).mapInArrow(_round(books), "entry bigint, n bigint, sums array<bigint>")
        agg = [F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width))]
        new = books.reshape(-1, width).copy()
        for r in part.groupBy("entry").agg(*agg).collect():  # at most as many rows as the codebooks have entries
            new[r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
        books = new.reshape(books.shape)

    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = forests.mapInArrow(_final(books), f"vec_id bigint, vq_label {label_type}, code string, error bigint")
    out = scratch(spark, "vector-codes")
    coded.unionByName(empty.where(~coded_rows).drop("vq_vector")).write.parquet(out)
    rows = spark.read.parquet(out)
    return _with_label_error(rows).withColumn("codebooks_sha256", F.lit(digest))


def _with_label_error(rows: DataFrame, broadcast_labels: int = 100_000, salts: int = 32) -> DataFrame:
    """Adds each label's summed error: broadcast up to so many labels, else joined on the label and a salt of the row."""
    total = rows.groupBy("vq_label").agg(F.expr("try_cast(sum(cast(error AS decimal(19,0))) AS bigint)").alias("label_error")).withColumnRenamed("vq_label", "vq_of")
    if rows.select("vq_label").distinct().limit(broadcast_labels + 1).count() <= broadcast_labels:
        got = rows.join(F.broadcast(total), F.col("vq_label").eqNullSafe(F.col("vq_of")), "left")
    else:
        wide = total.withColumn("vq_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int")
        got = rows.join(wide, F.col("vq_label").eqNullSafe(F.col("vq_of")) & (salt == F.col("vq_salt")), "left")
    return got.select("vec_id", "code", "error", "label_error")


def codes_sql(rounds: int = 2, dims: int = 64) -> str:
    """The same results in DuckDB SQL, for vectors of ``dims`` components."""
    w = dims // PARTS
    gap = f"list_sum(list_transform(range(1, {w + 1}), lambda i: (a.x[i] - c.x[i]) * (a.x[i] - c.x[i])))"
    ctes = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * {w} + 1 : p * {w} + {w}] AS x FROM kept, range({PARTS}) r(p))",
        f"c0 AS MATERIALIZED (SELECT p, k, x FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x FROM parts) WHERE k < {ENTRIES})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT a.vec_id, a.label, a.p, a.x, c.k, CAST({gap} AS BIGINT) AS gap FROM parts a JOIN c{r} c USING (p))")
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, min(gap) AS gap, any_value(x) AS x, min(gap * {ENTRIES} + k) % {ENTRIES} AS k FROM d{r} GROUP BY vec_id, label, p)")
        if r < rounds:
            cell = f"list_transform(range(1, {w + 1}), lambda i: CAST(floor(list_sum(list_transform(g.xs, lambda x: x[i])) / g.n) AS BIGINT))"
            ctes.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, CASE WHEN g.n IS NULL THEN c.x ELSE {cell} END AS x FROM c{r} c"
                f" LEFT JOIN (SELECT p, k, count(*) AS n, list(x) AS xs FROM a{r} GROUP BY p, k) g USING (p, k))"
            )
    return (
        "WITH " + ",\n".join(ctes) + f",\ns AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(gap) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)\n"
        f"SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,"
        f" (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256 FROM s"
    )
