"""Similarity join of documents on the Jaccard similarity of their word shingles, with PartEnum signatures.

Two sets that link differ in at most (1 - t) / (1 + t) of their summed sizes. Sets go by size bands so wide that a link
stays within a band or two neighbouring ones; the instance of a band has one bound k on the differing elements. It cuts the
feature domain by hash into n1 = k / 2 + 1 first parts and each of these into three second parts. Of linked sets one first part
at least holds no more than one differing element, so the sets agree wholly on two of its second parts: the signatures are the
subsets of two second parts, hashed with first part and instance. Enough first parts are added that one such subset is not empty;
a set with too many empty subsets lists these too. Sets whose signature nobody shares link with nothing.

- Equal sets are one set from the start. Sets that cannot link are dropped before signatures are made: of a linked pair's
  features at least 85 % are shared, so among the features whose hash falls in a sixteenth of the domain many must be met
  elsewhere. How many is set so that a linked set fails with probability below 1e-12, the order of a hash collision.
  ``prefilter=False`` does without.
- Most signatures are met once. Which are met again is counted by signature alone; a Bloom filter of those, if its size allows,
  then lets only their sets into the shuffle by bucket.
- In a bucket only pairs with its first and its last set are listed, which is enough when they link. Of a set's pairs the one
  that shares most signatures is verified first, by its exact intersection, and the others only where they could still join
  two components. What then stays in several components is compared pair by pair, once for buckets of the same sets, in blocks
  of BLOCK sets against each other: pairs whose parity sketches, as wide as the sets are large, differ in more bits than elements
  may differ are not listed. Links become components by stars.
"""

import itertools
import math
from functools import cache

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sentilake.functions import bloom
from sentilake.llm.bytehash import mix
from sentilake.llm.common import discard, numbers, small_batches, stage
from sentilake.llm.components import components
from sentilake.llm.shingles import shingle_sets
from sentilake.llm.suffix_dedup import text_key

SHINGLE = 4
THRESHOLD = 85  # per cent
SAMPLE = 16
PARITY_WORDS = 8
WIDEST = 512  # words of the largest sketch in the comparison of whole buckets
BLOCK = 256  # sets of a bucket that are compared in one task at a time, with as many others
MISS = 1e-12
SECOND, DIFFER = 3, 1  # second parts of a first part, and how many of them a subset leaves out
FILTER_BLOCKS = 16_384  # of 4 KB: the largest filter of signatures that goes to every task
COUNTED_SETS = 2_000  # sets whose signatures are counted in one task, on average
FEW_SETS = 200_000  # sets whose keys, some 50 bytes each, may go to every task


@cache
def least_shared(samples, threshold=THRESHOLD):
    """Shared samples that a linked set has, but for the probability MISS."""
    p, total = threshold / 100, 0.0
    for i in range(samples + 1):
        total += math.comb(samples, i) * p**i * (1 - p) ** (samples - i)
        if total > MISS:
            return i
    return samples


@cache
def bands(threshold, up_to):
    """Largest size of each band; a partner of a band's set is in it or a neighbouring one."""
    tops = [1]
    while tops[-1] < up_to:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // threshold))
    return np.array(tops)


def difference(total, threshold):
    """Most elements in which linked sets of this summed size differ."""
    return (100 - threshold) * total // (100 + threshold)


def signatures(features, threshold=THRESHOLD):
    """Hashes of which two linked, different sets have one in common."""
    n = len(features)
    tops = bands(threshold, 1 << max(10, 2 * n.bit_length()))
    band = int(np.searchsorted(tops, n))
    out = []
    for instance in (band, band + 1):
        k = int(difference(2 * int(tops[instance]), threshold))
        if k == 0:
            continue  # such sets link only when equal
        spare = k // 50 + 1
        first = k // (DIFFER + 1) + 1 + spare
        seeded = mix(features ^ np.uint64(instance + 1))
        part = (seeded % np.uint64(first * SECOND)).astype(np.int64)
        sums = np.zeros(first * SECOND, dtype=np.uint64)
        np.add.at(sums, part, mix(seeded))
        full = np.bincount(part, minlength=first * SECOND).reshape(first, SECOND) > 0
        sums = sums.reshape(first, SECOND)
        place = mix((np.uint64(instance) << np.uint64(40)) + np.arange(first, dtype=np.uint64))
        subsets = list(itertools.combinations(range(SECOND), SECOND - DIFFER))
        held = np.stack([full[:, c].any(axis=1) for c in subsets])
        listed = held if (~held).any(axis=0).sum() <= spare else np.ones_like(held)
        for c, there in zip(subsets, listed, strict=True):
            h = place[there]
            for j in c:
                h = mix((h ^ sums[there, j]) * np.uint64(2 * j + 3))
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def parity(features, words=PARITY_WORDS):
    """Bit i is the parity of the features that fall on i: no two sets differ in more bits than elements."""
    bits = np.bincount((mix(features) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch_words(n):
    """Words of a large set's sketch: a power of two, with two bits an element if that is not too wide. Halves of a sketch
    that are xored make the sketch of half as many words."""
    return min(WIDEST, max(PARITY_WORDS, 1 << (2 * n // 64).bit_length()))


def _set_rows(shingle):
    """Text to its set's 128-bit key, size and sampled features."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            sets = shingle_sets(batch.column(2), shingle)
            with np.errstate(over="ignore"):
                keys = np.array([(mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).reshape(-1, 2)
            samples = [s[s % np.uint64(SAMPLE) == 0].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(keys[:, 0].view(np.int64)),
                    pa.array(keys[:, 1].view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(samples, pa.list_(pa.int64())),
                ],
                names=["id", "k", "k0", "k1", "n", "samples"],
            )

    return rows


def _detail_rows(shingle):
    """Text of a set to its sketch."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            sets = shingle_sets(batch.column(3), shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))],
                names=["k0", "k1", "n", "t", "parity"],
            )

    return rows


def _signature_rows(shingle, threshold):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            found = [signatures(s, threshold) for s in shingle_sets(batch.column(1), shingle)]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            sigs = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sigs), batch.column(0).take(pa.array(at))], names=["sig", "sid"])

    return rows


def _feature_rows(shingle):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            sets = shingle_sets(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "f"])

    return rows


def _sketch_rows(shingle):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            found = [parity(s, sketch_words(len(s))).tobytes() for s in shingle_sets(batch.column(2), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["sid", "n", "sketch"])

    return rows


def differing(sketches, i, j):
    """In how many bits sketches i[x] and j[x] differ, the wider one folded to the width of the other."""
    width = np.array([len(s) // 8 for s in sketches])
    place = np.zeros(len(sketches), dtype=np.int64)
    tables = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        tables[w] = np.frombuffer(b"".join(sketches[k] for k in at.tolist()), dtype=np.uint64).reshape(len(at), w)
    i, j = np.where(width[i] < width[j], i, j), np.where(width[i] < width[j], j, i)
    out = np.zeros(len(i), dtype=np.int64)
    for narrow in tables:
        for wide in tables:
            at = np.flatnonzero((width[i] == narrow) & (width[j] == wide)) if narrow <= wide else ()
            if not len(at):
                continue
            folded = np.bitwise_xor.reduce(tables[wide].reshape(len(tables[wide]), -1, narrow), axis=1)
            step = max(1, (1 << 18) // narrow)
            for a in range(0, len(at), step):
                some = at[a : a + step]
                out[some] = np.bitwise_count(tables[narrow][place[i[some]]] ^ folded[place[j[some]]]).sum(axis=1)
    return out


def _open_pair_rows(threshold):
    """Sets of a bucket, of one block or of two, to the pairs in different components that may link, without those with the
    bucket's first and last set."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten()
            side, sid, c, n, lo, hi = (flat.field(name).to_numpy() for name in ("side", "sid", "c", "n", "lo", "hi"))
            end = np.repeat(np.cumsum(size), size)
            alone = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size)
            i, found = np.arange(len(sid)), []
            for d in range(1, int(size.max(initial=1))):
                i = i[i + d < end[i]]
                j = i + d
                a, b = np.where(sid[i] < sid[j], i, j), np.where(sid[i] < sid[j], j, i)
                open_ = (c[a] != c[b]) & (sid[a] != lo[a]) & (sid[b] != hi[b]) & (alone[i] | (side[i] != side[j]))
                open_ &= (100 * n[a] >= threshold * n[b]) & (100 * n[b] >= threshold * n[a])
                found.append(np.stack([a[open_], b[open_]]))
            a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
            near = (100 + threshold) * differing(flat.field("sketch").to_pylist(), a, b) <= (100 - threshold) * (n[a] + n[b])
            _, once = np.unique(np.stack([sid[a[near]], sid[b[near]]]), axis=1, return_index=True)
            a, b = a[near][once], b[near][once]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sid[a], sid[b], n[a], n[b])], names=["a", "b", "na", "nb"])

    return rows


def _may_link(x, y, threshold):
    """By size and sketch."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = F.aggregate(
        F.zip_with(f"{x}.parity", f"{y}.parity", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v.cast("int")
    )
    sizes = (100 * n >= threshold * m) & (100 * m >= threshold * n)
    return sizes & ((100 + threshold) * apart <= (100 - threshold) * (n + m))


def _near(pairs, narrow, threshold):
    """The pairs (a, b) that may link, with the sizes of both sets."""
    both = pairs.alias("p").join(narrow.alias("x"), F.col("p.a") == F.col("x.sid")).join(narrow.alias("y"), F.col("p.b") == F.col("y.sid"))
    return both.filter(_may_link("x", "y", threshold)).select("p.*", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def _verified(near, features, threshold):
    """The pairs (a, b) of sets that link."""
    both = near.join(features.select(F.col("sid").alias("a"), F.col("f").alias("fa")), "a")
    both = both.join(features.select(F.col("sid").alias("b"), F.col("f").alias("fb")), "b")
    shared = F.size(F.array_intersect("fa", "fb"))
    return both.filter(100 * shared >= threshold * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _buckets(signed, n_sets):
    """(sig, sid, lo, hi) of the signatures that several sets have, with the first and the last of these."""
    spark = signed.sparkSession
    # Dealt out before they are counted: most are met once, so counting where they are made gains nothing and takes memory.
    dealt = signed.select("sig").repartition(max(1, n_sets // COUNTED_SETS), "sig")
    met = stage(dealt.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig"), "met-signatures")
    blocks = bloom.blocks_for(met.count())
    listed = signed
    if blocks <= FILTER_BLOCKS:
        few = bloom.build(met.withColumn("blocks", F.lit(blocks)), "sig").select("block", "bits")
        listed = signed.join(F.broadcast(few), (bloom.block_of("sig", F.lit(blocks)) == F.col("block")) & bloom.may_hold("bits", F.col("sig")), "left_semi")
    listed = stage(listed.join(met.hint("merge"), "sig", "left_semi"), "signed")
    ends = listed.groupBy("sig").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo <> hi")
    members = stage(listed.join(ends.hint("merge"), "sig"), "buckets")
    discard(spark, met, listed)
    return members


def _labels(first, more):
    """(node, component) of first's components, joined further by the edges more."""
    if more.isEmpty():
        return first
    label = first.select("node", "component")
    edges = more.join(label.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    edges = edges.join(label.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    edges = edges.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    then = components(edges, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("root"))
    ends = edges.select(F.col("a").alias("node"), F.col("ca").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("cb").alias("component")))
    nodes = first.unionByName(ends).distinct()
    return stage(nodes.join(then, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")


def _apart(pairs, labels):
    """The pairs whose ends are not in one component."""
    placed = pairs.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    placed = placed.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return placed.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "na", "nb")


def _alive(keys, threshold):
    """(k, k0, k1, n) of the sets of which enough samples are met in other sets."""
    spark = keys.sparkSession
    sampled = keys.select("k0", "k1", F.explode("samples").alias("f"))
    met = sampled.groupBy("f").agg(F.min("k0").alias("lo"), F.max("k0").alias("hi")).filter("lo <> hi").select("f")
    shared = sampled.join(met, "f").groupBy("k0", "k1").agg(F.count("*").alias("shared"))
    most = int(keys.agg(F.max(F.size("samples"))).first()[0] or 0)
    rule = numbers(spark, ("size", "least"), [(i, least_shared(i, threshold)) for i in range(min(most, 256) + 1)])
    needed = F.when(F.size("samples") > 256, least_shared(256, threshold)).otherwise(F.col("least"))
    return (
        keys.join(shared, ["k0", "k1"], "left")
        .join(F.broadcast(rule), F.size("samples") == F.col("size"), "left")
        .filter(F.coalesce("shared", F.lit(0)) >= needed)
        .select("k", "k0", "k1", "n")
    )


def link_sets(docs, id_col="doc_id", text_col="text", shingle=SHINGLE, threshold=THRESHOLD, prefilter=True):
    """(id_col, n_shingles, component_id) of each row of docs.

    component_id is the least id reachable by links. Null and blank text has no shingles and links with nothing, its
    component is its own id. Rows with equal sets, also repeated rows, are linked; a null id gets its component's least id.
    Other columns of docs are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"), text.alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    found = stage(rows.mapInArrow(_set_rows(shingle), f"id {kind}, k binary, k0 long, k1 long, n long, samples array<long>"), "sets")

    # One text for each set that may link.
    keys = found.filter("n > 1").groupBy("k0", "k1").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("samples").alias("samples"))
    keys = stage(keys, "distinct-sets")
    alive = stage(_alive(keys, threshold) if prefilter else keys.select("k", "k0", "k1", "n"), "alive-sets")
    n_sets = alive.count()
    chosen = F.broadcast(alive) if n_sets <= FEW_SETS else alive
    texts = rows.select("k", "t").join(chosen, "k").groupBy("k", "k0", "k1", "n").agg(F.first("t").alias("t"))
    sets = texts.select("k0", "k1", "n", "t").mapInArrow(_detail_rows(shingle), "k0 long, k1 long, n long, t string, parity array<long>")
    sets = stage(sets.withColumn("sid", F.monotonically_increasing_id()), "live-sets")
    discard(spark, keys, alive)

    # Pairs with the first and the last set of each bucket.
    members = _buckets(sets.select("sid", "t").mapInArrow(_signature_rows(shingle, threshold), "sig long, sid long"), n_sets)
    stars = members.filter("sid <> lo").select(F.col("lo").alias("a"), F.col("sid").alias("b"))
    stars = stars.unionByName(members.filter("sid <> lo and sid <> hi").select(F.col("sid").alias("a"), F.col("hi").alias("b")))
    narrow = sets.select("sid", "n", "parity")
    near = stage(_near(stars.groupBy("a", "b").agg(F.count("*").alias("met")), narrow, threshold), "near")
    features = sets.select("sid", "t").mapInArrow(_feature_rows(shingle), "sid long, f array<long>")
    best = F.row_number().over(W.partitionBy("b").orderBy(F.desc("met"), "a"))
    ranked = near.withColumn("best", best)
    links = stage(_verified(ranked.filter("best = 1"), features, threshold), "links")
    joined = stage(components(links), "labels")
    discard(spark, links)
    links = stage(_verified(_apart(near, joined), features, threshold), "links")
    joined = _labels(joined, links)
    discard(spark, near, links)

    # Sets of one bucket in different components: pair by pair, without those listed above. Buckets of the same sets count once.
    placed = members.join(joined.select(F.col("node").alias("sid"), "component"), "sid", "left")
    placed = placed.select("sig", "sid", "lo", "hi", F.coalesce("component", "sid").alias("c"))
    who = [F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"who{i}") for i in range(2)]
    mixed = placed.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size"), *who).filter("c0 <> c1 and size > 2")
    mixed = mixed.groupBy("who0", "who1", "size").agg(F.min("sig").alias("sig"))
    open_ = stage(placed.join(mixed.select("sig", "size"), "sig"), "open")
    texts = sets.select("sid", "n", "t").join(open_.select("sid").distinct(), "sid", "left_semi")
    sketched = open_.join(texts.mapInArrow(_sketch_rows(shingle), "sid long, n long, sketch binary"), "sid")
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = sketched.withColumn("side", F.pmod(F.xxhash64("sid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = dealt.groupBy("sig", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q")).agg(
        F.collect_list(F.struct("side", "sid", "c", "n", "lo", "hi", "sketch")).alias("sets")  # some 2 * BLOCK at most
    )
    rest = met.select((F.col("p") == F.col("q")).alias("alone"), "sets").mapInArrow(_open_pair_rows(threshold), "a long, b long, na long, nb long").distinct()
    more = stage(_verified(rest, features, threshold), "more-links")
    linked = _labels(joined, more)

    # Back to documents: the least id of each set, then of each component.
    classes = sets.join(linked, sets["sid"] == linked["node"]).select("k0", "k1", "component")
    ids = found.filter("n > 0").groupBy("k0", "k1").agg(F.min("id").alias("least"))
    ids = ids.join(classes, ["k0", "k1"], "left")
    roots = ids.filter("component is not null").groupBy("component").agg(F.min("least").alias("root"))
    ids = stage(ids.join(roots, "component", "left").select("k0", "k1", F.coalesce("root", "least").alias("root")), "roots")
    discard(spark, members, open_, more, sets)
    out = found.select("id", "k0", "k1", "n").join(ids, ["k0", "k1"], "left")
    root = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"))
