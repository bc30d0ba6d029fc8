"""Near-duplicate embeddings by lattice hashing: random projections to eight dimensions, decoded to points of E8.

Each table projects the unit vectors with its own Gaussian matrix and shift; a vector lives in the cell of its nearest E8
point and also visits the next nearest ones. Vectors of one label that meet in a cell, at least one of them at home, are
compared by cosine in double precision. A pair that meets in several cells counts in the first one only, which both sides
can tell from the cells they carry, so links are counted and components labelled inside the tasks and no pair is listed.

Equal vectors are one vector from the start. A cell with more than ``BLOCK`` vectors is cut into blocks, and each pair of
blocks is compared in a group of its own.
"""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from sentilake.llm.bytehash import mix
from sentilake.llm.common import small_batches, stage
from sentilake.llm.components import components

THRESHOLD = 0.93
TABLES = 8
SCALE = 1.4  # a cell in units of the projection: pairs at the threshold meet in 998 of 1000 cases, unrelated ones in about 1 of 100
BLOCK = 512


def projection(table, dimension):
    seed = int.from_bytes(hashlib.sha256(f"lattice {table} {dimension}".encode()).digest()[:8], "little")
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.standard_normal((dimension, 8)), rng.random(8)


def _nearest_d8(y):
    """Nearest points with integer coordinates of even sum, and the next best, which moves the two coordinates worst placed."""
    near = np.rint(y)
    gap = y - near
    step = np.where(gap >= 0, 1.0, -1.0)
    order = np.argsort(-np.abs(gap), axis=1)
    rows = np.arange(len(y))
    one, two = near.copy(), near.copy()
    a, b = order[:, 0], order[:, 1]
    one[rows, a] += step[rows, a]
    two[rows, a] += step[rows, a]
    two[rows, b] += step[rows, b]
    other = near.copy()
    other[rows, b] += step[rows, b]
    odd = (near.sum(axis=1) % 2 != 0)[:, None]
    return np.where(odd, one, near), np.where(odd, other, two)


def nearest_e8(y):
    """[probe, vector, coordinate]: the nearest E8 point first, then three near ones, as doubled integers."""
    whole, whole2 = _nearest_d8(y)
    half, half2 = (p + 0.5 for p in _nearest_d8(y - 0.5))
    points = np.stack([whole, half, whole2, half2])
    far = ((points - y) ** 2).sum(axis=2)
    order = np.argsort(far, axis=0, kind="stable")
    return np.rint(2 * np.take_along_axis(points, order[:, :, None], axis=0)).astype(np.int64)


def cells(unit, tables=TABLES, scale=SCALE):
    """[vector, table, probe] hashes of cells, the own one first."""
    out = np.zeros((len(unit), tables, 4), dtype=np.uint64)
    for t in range(tables):
        matrix, shift = projection(t, unit.shape[1])
        points = nearest_e8(unit @ matrix / scale + shift)
        key = np.full(points.shape[:2], t + 1, dtype=np.uint64)
        for j in range(8):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + points[:, :, j].astype(np.uint64))
        out[:, t, :] = key.T
    return out


def _cell_rows(tables, scale):
    """uid, label, v, copies to one row a cell that the vector lives in or visits."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(2).to_pylist()
            for size in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                x = np.array([vectors[i] for i in at], dtype=np.float64)
                unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
                found = cells(unit, tables, scale).view(np.int64)
                flat = found.reshape(len(at), -1)
                per = flat.shape[1]
                take = pa.array(np.repeat(at, per))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).take(take),
                        pa.array(np.full(len(at) * per, size, dtype=np.int32)),
                        pa.array(flat.ravel()),
                        pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 4), len(at))),
                        batch.column(0).take(take),
                        batch.column(3).take(take),
                        pa.array([r.tobytes() for r in np.repeat(unit, per, axis=0)], pa.binary()),
                        pa.array([r.tobytes() for r in np.repeat(flat, per, axis=0)], pa.binary()),
                    ],
                    names=["label", "size", "cell", "t", "uid", "copies", "unit", "cells"],
                )

    return rows


def _first_meeting(a, b):
    """(table, cell) in which pairs of vectors meet first; a, b: [pair, table, probe]."""
    a_home, b_home = a[:, :, 0], b[:, :, 0]
    at_a = (b == a_home[:, :, None]).any(axis=2)
    at_b = (a == b_home[:, :, None]).any(axis=2)
    top = np.iinfo(np.int64).max
    cell = np.minimum(np.where(at_a, a_home, top), np.where(at_b, b_home, top))
    t = (at_a | at_b).argmax(axis=1)
    return t, cell[np.arange(len(t)), t]


def _group_links(t, cell, blocks, pair, uids, copies, unit, found, threshold):
    """(uid, links counted here, least linked uid here) of one group of a cell."""
    i, j = pair
    home = found[:, t, 0] == cell
    first, second = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    near = unit[first] @ unit[second].T >= threshold
    near &= home[first][:, None] | home[second][None, :]
    if i == j:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = first[a], second[b]
    keep = np.zeros(len(a), dtype=bool)
    for s in range(0, len(a), 8192):
        met, where = _first_meeting(found[a[s : s + 8192]], found[b[s : s + 8192]])
        keep[s : s + 8192] = (met == t) & (where == cell)
    a, b = a[keep], b[keep]
    links = np.zeros(len(uids), dtype=np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    label = uids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        if (label == before).all():
            break
    hit = links > 0
    return uids[hit], links[hit], label[hit]


def _link_rows(tables, threshold):
    """Rows sorted by cell and pair of blocks to links; a group has two blocks at most."""

    def rows(batches):
        import pyarrow as pa

        held = []

        def groups(table):
            table = table.combine_chunks()
            columns = {c: table.column(c).to_numpy() for c in ("label", "size", "cell", "t", "i", "j", "block", "uid", "copies")}
            keys = np.stack([columns[c].astype(np.int64) for c in ("label", "size", "cell", "t", "i", "j")])
            new = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            out = [[], [], []]
            for s, e in zip(new.tolist(), np.append(new[1:], table.num_rows).tolist(), strict=True):
                if e - s < 2:
                    continue
                unit = np.frombuffer(b"".join(table.column("unit").slice(s, e - s).to_pylist()), dtype=np.float64).reshape(e - s, -1)
                found = np.frombuffer(b"".join(table.column("cells").slice(s, e - s).to_pylist()), dtype=np.int64).reshape(e - s, tables, 4)
                got = _group_links(
                    int(keys[3, s]), int(keys[2, s]), columns["block"][s:e], (int(keys[4, s]), int(keys[5, s])), columns["uid"][s:e], columns["copies"][s:e], unit, found, threshold
                )
                for to, x in zip(out, got, strict=True):
                    to.append(x)
            arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
            return pa.RecordBatch.from_arrays(arrays, names=["uid", "n", "least"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 4 * BLOCK:
                table = pa.Table.from_batches(held)
                last = np.ones(table.num_rows, dtype=bool)
                for c in ("label", "size", "cell", "t", "i", "j"):
                    column = table.column(c).to_numpy()
                    last &= column == column[-1]
                cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
                if cut:
                    yield groups(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield groups(pa.Table.from_batches(held))

    return rows


def link_vectors(vectors, id_col="vec_id", vector_col="embedding", label_col="label", threshold=THRESHOLD, tables=TABLES, scale=SCALE, block=BLOCK):
    """(id_col, n_links, component_id, kept) of each row of vectors.

    A vector that is null, zero or empty, holds null, NaN or an infinity, or has no label links with nothing; vectors of
    other lengths don't link with each other. Equal vectors of a label link, also those of repeated rows; a null id gets its
    component's least id and is never kept. Other columns are not read. An empty table gives none.
    """
    spark = vectors.sparkSession
    small_batches(spark, 1024)
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    v = F.col(vector_col).cast("array<double>")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    usable = F.coalesce(F.col(label_col).isNotNull() & F.forall(v, finite) & (F.size(v) > 0) & (square > 0), F.lit(False))
    key = F.when(usable, F.sha2(F.concat_ws(",", v.cast("array<string>")), 256))
    rows = stage(vectors.select(F.col(id_col).alias("id"), F.xxhash64(F.col(label_col)).alias("label"), key.alias("k"), F.when(usable, v).alias("v")), "vectors")
    distinct = rows.filter("k is not null").groupBy("label", "k").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("least"))
    distinct = stage(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct-vectors")

    schema = "label long, size int, cell long, t int, uid long, copies long, unit binary, cells binary"
    listed = distinct.select("uid", "label", "v", "copies").mapInArrow(_cell_rows(tables, scale), schema)
    place = ["label", "size", "cell", "t"]
    sizes = listed.groupBy(*place).agg(F.count("*").alias("n")).filter("n > 1")
    placed = listed.join(sizes, place).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("n")
    grouped = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grouped = grouped.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "parts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*place, "i", "j"]
    ordered = grouped.repartition(n, *by).sortWithinPartitions(*by).select(*by, "block", "uid", "copies", "unit", "cells")
    found = stage(ordered.mapInArrow(_link_rows(tables, threshold), "uid long, n long, least long"), "vector-links")

    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    labels = components(found.select("uid", "least"), "uid", "least")
    classes = distinct.join(counts, "uid", "left").join(labels, distinct["uid"] == labels["node"], "left")
    classes = classes.select("label", "k", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "uid").alias("c"), "copies")
    roots = classes.groupBy("c").agg(F.min("least").alias("root"))
    classes = classes.join(roots, "c").select("label", "k", (F.col("n") + F.col("copies") - 1).alias("n"), "root")
    out = rows.select("id", "label", "k").join(classes, ["label", "k"], "left")
    root = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("root"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(False)).alias("kept"))
