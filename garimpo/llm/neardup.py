"""Near-duplicate documents: MinHash with banding, signatures, a check on full sets, connected components.

1. Each text's set of word shingles; HASHES universal hash minima; BANDS hashes of ROWS minima each.
   A pair with similarity 0.8 misses all bands with a chance of (1 - 0.8^4)^32 = 5e-8.
2. Texts with equal sets become one class, stood for by its smallest doc_id.
3. Classes that share a bucket are compared with the bucket's smallest member, on full sets, in groups of bounded
   size. Then components: what is in one component by now needn't be compared.
4. Classes that shared buckets, directly or by others, make a cluster. Where it still has several components, all its
   members meet those outside its largest component, in blocks of bounded size: first by signatures, then, what may
   reach the threshold, on full sets. A block emits only links that join components. So no link that joins two
   components is lost, and no group's pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import Bitmap, checkpoint, mix64, rows_of, sliced, word_hashes
from garimpo.llm.components import components
from garimpo.llm.substring import _spans

WIDTH, PERCENT = 5, 80
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Members of a group that are compared with one leader, and of a block that is compared with another, in one go.
GROUP, BLOCK = 1024, 2048
#: Of the HASHES bytes of two signatures, those that must agree for a pair to be compared on full sets: the expected
#: number at the threshold, less 5 standard deviations.
SIGNATURE_LEAST = int(HASHES * PERCENT / 100 - 5 * (HASHES * PERCENT / 100 * (1 - PERCENT / 100)) ** 0.5)
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, HASHES, dtype=np.uint64)
_C = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the texts' sets, and the sets' hashes one after another, each set in ascending order."""
    offsets, h = word_hashes(pc.ascii_lower(text.fill_null("")))
    rows, n = rows_of(offsets), np.diff(offsets)
    if len(h) >= width:
        at = np.flatnonzero(rows[: len(h) - width + 1] == rows[width - 1 :])
        grams, owner = _spans(h, width)[at], rows[at]
    else:
        grams, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < width))
    for k in range(1, width):
        r = short[n[short] == k]
        if len(r):
            whole = h[offsets[r]]
            for j in range(1, k):
                whole = mix64(whole * _C + h[offsets[r] + j])
            grams, owner = np.concatenate([grams, mix64(whole + np.uint64(k))]), np.concatenate([owner, r])
    if len(short):
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    cut = np.searchsorted(owner, np.arange(len(n) + 1))
    sets = [np.unique(grams[cut[i] : cut[i + 1]]) for i in range(len(n))]
    return np.array([len(s) for s in sets], np.int64), np.concatenate(sets) if sets else np.empty(0, np.uint64)


def minima(size: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """HASHES minima of each set that isn't empty, a row for each."""
    first = np.cumsum(size[size > 0]) - size[size > 0]
    out = np.empty((len(first), HASHES), np.uint64)
    if len(first):
        for i in range(HASHES):
            out[:, i] = np.minimum.reduceat(grams * _MUL[i] + _ADD[i], first)
    return out


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            size, grams = shingle_sets(batch.column(1), width)
            full = size > 0
            low = minima(size, grams)
            key = np.zeros((len(low), BANDS), np.uint64)
            for r in range(ROWS):
                key = mix64(key * _C + low[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full * BANDS))), pa.int32()), pa.array(key.ravel().view(np.int64)))
            first = np.cumsum(size[full]) - size[full]
            whole = np.zeros((len(size), 2), np.uint64)
            if len(first):
                for j, salt in enumerate((_C, ~_C)):
                    whole[full, j] = np.add.reduceat(mix64(grams + salt), first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)), bands], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return run


def _send_sets(width: int):
    """A row for each place that a document's set is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            size, grams = shingle_sets(batch.column(1), width)
            first = np.cumsum(size) - size
            row = rows_of(batch.column(2).offsets.to_numpy().astype(np.int64))
            to = batch.column(2).flatten()
            n = size[row]
            pick = np.repeat(first[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(grams[pick].view(np.int64)))
            yield pa.RecordBatch.from_arrays([to.field(0), to.field(1), to.field(2), to.field(3), batch.column(0).take(pa.array(row)), sets], names=["leader", "salt", "role", "comp", "doc_id", "grams"])

    return run


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have PERCENT hundredths of their union in common."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large) or not len(small):
        return False
    where = np.searchsorted(large, small)
    both = int((large[np.minimum(where, len(large) - 1)] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """leader, salt, role, comp, doc_id and set of each row."""
    for batch in batches:
        at, flat = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy().view(np.uint64)
        for i, row in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
            yield *row, flat[at[i] : at[i + 1]]


def _links(us: list, vs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of leader, salt, role: the leader's sets (several if its doc_id is on several rows), then those that are compared with them."""
    place, leads, us, vs = None, [], [], []
    for leader, salt, role, _, doc, own in _sets(batches):
        if role == 0:
            if place != (leader, salt):
                place, leads = (leader, salt), []
            if not any(np.array_equal(own, x) for x in leads):
                leads.append(own.copy())
        elif place == (leader, salt) and any(similar(own, x) for x in leads):
            us.append(doc)
            vs.append(leader)
        if len(us) >= 10_000:
            yield _links(us, vs)
            us, vs = [], []
    yield _links(us, vs)


def joining_links(left: list[tuple], right: list[tuple]) -> tuple[list, list]:
    """Links between (comp, doc_id, set) of two sides that join components which no other of them has joined."""
    sign = lambda rows: (mix64(minima(np.array([len(r[2]) for r in rows]), np.concatenate([r[2] for r in rows]))) & np.uint64(255)).astype(np.uint8)
    a, b = sign(left), sign(right)
    names, root = np.unique(np.array([r[0] for r in left + right], np.int64), return_inverse=True)
    mine, theirs = root[: len(left)].copy(), root[len(left) :].copy()
    us, vs = [], []
    for i in range(len(left)):
        js = np.flatnonzero(theirs != mine[i])
        if not len(js):
            continue
        agree = (b[js] == a[i]).sum(1)
        for j in js[np.argsort(-agree, kind="stable")][: int((agree >= SIGNATURE_LEAST).sum())].tolist():
            if mine[i] != theirs[j] and similar(left[i][2], right[j][2]):
                us.append(left[i][1])
                vs.append(right[j][1])
                old, new = theirs[j], mine[i]
                mine[mine == old], theirs[theirs == old] = new, new
    return us, vs


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of cluster, pair of blocks, side: the sides of a pair, of about BLOCK members each, are held at once."""
    place, sides = None, ([], [])
    for leader, salt, role, comp, doc, own in _sets(batches):
        if place != (leader, salt):
            if sides[0] and sides[1]:
                yield _links(*joining_links(*sides))
            place, sides = (leader, salt), ([], [])
        sides[role].append((comp, doc, own.copy()))
    if sides[0] and sides[1]:
        yield _links(*joining_links(*sides))


def _sent(docs: DataFrame, sends: DataFrame, width: int) -> DataFrame:
    """The sets of the documents of sends(doc_id, leader, salt, role, comp), dealt by leader and salt, in order of role."""
    sends = checkpoint(sends.groupBy("doc_id").agg(F.collect_list(F.struct("leader", "salt", "role", "comp")).alias("sends")))
    sets = Bitmap(sends, "doc_id").some(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").join(sends, "doc_id").select("doc_id", "text", "sends")
    sent = sets.mapInArrow(_send_sets(width), "leader long, salt long, role int, comp long, doc_id long, grams array<long>")
    return sent.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role", "doc_id")


def _group(key: str, n: str) -> Column:
    return F.pmod(F.xxhash64(key), F.col(n))


def _up_to(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def confirmed(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Those of ``pairs(leader, member)`` whose full sets are similar enough, as u, v.

    A leader with many members meets them in groups of about GROUP, each with a copy of the leader's set.
    """
    groups = checkpoint(pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("groups")))
    none = F.lit(0).cast("long").alias("comp")
    members = pairs.join(groups, "leader").select(F.col("member").alias("doc_id"), "leader", _group("member", "groups").alias("salt"), F.lit(1).alias("role"), none)
    leaders = groups.select(F.col("leader").alias("doc_id"), "leader", _up_to("groups").alias("salt"), F.lit(0).alias("role"), none)
    return _sent(docs, members.unionByName(leaders), width).mapInArrow(_compare, "u long, v long")


def unsettled(placed: DataFrame) -> DataFrame:
    """Where the members of placed(rep, cluster, comp) are to meet, as doc_id, leader, salt, role, comp: in clusters of
    three or more with several components, those outside the largest one (role 0) and all (role 1), block by block."""
    comps = placed.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
    clusters = comps.groupBy("cluster").agg(F.sum("n").alias("total"), F.max(F.struct("n", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1 and total > 2")
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    clusters = clusters.select("cluster", F.col("most.comp").alias("largest"), blocks(F.col("total") - F.col("most.n")).alias("ko"), blocks(F.col("total")).alias("ka"))
    rows = placed.join(clusters, "cluster")
    outside = rows.where("comp != largest").withColumn("o", _group("rep", "ko")).withColumn("a", _up_to("ka"))
    everyone = rows.withColumn("a", _group("rep", "ka")).withColumn("o", _up_to("ko"))
    deal = lambda df, role: df.select(F.col("rep").alias("doc_id"), F.col("cluster").alias("leader"), (F.col("o") * F.col("ka") + F.col("a")).alias("salt"), F.lit(role).alias("role"), "comp")
    return deal(outside, 0).unionByName(deal(everyone, 1))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs``.

    Words are lower-cased (A-Z); a text of fewer than ``width`` words is one shingle; a NULL, empty or wordless text
    has an empty set and is linked with nothing. component_id is the smallest doc_id that links reach; kept says
    whether that is the document itself. A row without doc_id is linked with nothing and kept. Rows that repeat a
    doc_id are one document that has all their links. Extra columns are ignored.
    """
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    signed = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signatures(width), schema))
    usable = signed.where("doc_id is not null and n_shingles > 0")
    # what stands on a join's other side is written first: joins of two plain shuffles are those that Spark splits where a key is hot
    classes = checkpoint(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last"))
    placed = usable.join(classes, ["set_a", "set_b"], "left").where("rep is null or rep = doc_id")
    buckets = placed.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    shared = checkpoint(buckets.groupBy("band").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("band", "leader"))
    met = checkpoint(buckets.join(shared, "band").where("rep != leader").select("leader", F.col("rep").alias("member")).distinct())

    links = checkpoint(confirmed(docs, met, width))
    comps = components(links)
    clusters = components(met.select(F.col("leader").alias("u"), F.col("member").alias("v")))
    clusters = clusters.unionByName(clusters.select(F.col("v").alias("u"), "v").distinct())
    placed = clusters.join(comps.withColumnRenamed("v", "comp"), "u", "left").select(F.col("u").alias("rep"), F.col("v").alias("cluster"), F.coalesce("comp", "u").alias("comp"))
    left = checkpoint(unsettled(placed))
    if left.limit(1).count():
        comps = components(links.unionByName(_sent(docs, left, width).mapInArrow(_compare_blocks, "u long, v long")))

    found = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(comps.select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left")
    linked = F.col("n_shingles") > 0
    own = F.when(linked & F.col("doc_id").isNotNull(), F.coalesce("comp", "rep")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
