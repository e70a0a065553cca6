"""Near-duplicate documents by SetSketch registers (operator 3)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Registers in bands of ROWS. Sets at the threshold 0.8 share a band of 6 registers with probability 0.8^6 = 0.26, and
#: miss all of 36 with 2e-5.
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
#: Register values are floor(1 - log(x) / log(BASE)) of exponentially distributed minima x of rate RATE, within 0..TOP.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Candidates whose likeliest similarity is lower than the threshold by so many standard errors aren't read again.
MARGIN = 5.0
#: Classes of a bucket in one block, and partners of a class that are tried first.
BLOCK, NEAREST = 1_024, 4

_odd = np.random.Generator(np.random.PCG64(20240101)).integers(0, 1 << 63, REGISTERS + ROWS + 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIERS, BAND_MIX, PAIR_MIX = _odd[:REGISTERS, None], _odd[REGISTERS : REGISTERS + ROWS], _odd[-3:]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of x."""
    x = (x ^ (x >> np.uint64(31))) * PAIR_MIX[1]
    x = (x ^ (x >> np.uint64(29))) * PAIR_MIX[2]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of `width`-word shingles as sorted 64-bit hashes; of fewer words, the whole sequence is the one shingle."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    hashes = shared.kept("word hashes", WordHashes)
    ids = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = min(width, len(ids))
    h = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        h = mixed(h * PAIR_MIX[0] + ids[k : len(ids) - n + 1 + k])
    return np.unique(h)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS values of a set: for each register the minimum of an exponential hash of the members, on a log scale."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for a in range(0, len(hashes), 512):
        np.minimum(low, (MULTIPLIERS * hashes[None, a : a + 512]).min(axis=1), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP).astype("<u2")


def bands(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, for each row of registers."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * PAIR_MIX[0]
    for k in range(ROWS):
        h = mixed(h + r[:, :, k] * BAND_MIX[k])
    return h.view(np.int64)


def likeliest(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The similarity that makes the pairs of register rows likeliest, sizes being known.

    Of the registers of two sets, D+ are greater in the first, D- in the second, the rest are equal. With u and v the
    sets' shares of na + nb and p(x) = -log_BASE(1 - x (BASE - 1) / BASE), the first have probability p(u - v J) and
    the second p(v - u J). The likelihood is concave enough for a search by thirds.
    """
    greater, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal, u = REGISTERS - greater - less, na / (na + nb)
    v = 1 - u

    def likelihood(j):
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
        up, down = p(u - v * j), p(v - u * j)
        safe = lambda x: np.log(np.maximum(x, 1e-12))
        return greater * safe(up) + less * safe(down) + equal * safe(1 - up - down)

    low, high = np.zeros(len(a)), np.minimum(na, nb) / np.maximum(na, nb)
    for _ in range(16):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        better = likelihood(x) < likelihood(y)
        low, high = np.where(better, x, low), np.where(better, high, y)
    return (low + high) / 2


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_id (128 bits of the sorted set; null for an empty one) and registers of each row."""

    def run(batches):
        for batch in batches:
            for step in shared.row_steps(batch):
                n, keys, rows = [], [], []
                for t in step.column(1).to_pylist():
                    h = shingles(t, width)
                    n.append(len(h))
                    keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                    rows.append(sketch(h).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], names=["doc_id", "n_shingles", "set_id", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, registers binary")


def band_rows(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(ids), 4_096):
                raw = batch.column(1).slice(a, 4_096).to_pylist()
                keys = bands(np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), REGISTERS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids[a : a + 4_096], BANDS))], names=["band", "node"])

    return classes.select("node", "registers").mapInArrow(run, "band long, node long")


def plausible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose registers don't speak against the threshold."""
    one = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    two = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    bound = max(0.0, threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / REGISTERS))

    def run(batches):
        for batch in batches:
            if len(batch):
                na, nb = (batch.column(k).to_numpy().astype(float) for k in (2, 3))
                ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (4, 5))
                keep = np.flatnonzero(likeliest(ra, rb, na, nb) >= bound)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    # sets of too different size can't reach the threshold
    sized = pairs.join(two, "b").join(one, "a").filter(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets have percent in common: 100 * intersection >= percent * union."""
    texts = docs.select("doc_id", "text")

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            pairs_of_texts = (p for s in shared.row_steps(batch) for p in zip(s.column(2).to_pylist(), s.column(3).to_pylist()))
            for i, (ta, tb) in enumerate(pairs_of_texts):
                if last[0] != ta:
                    last = (ta, shingles(ta, width))
                one, two = last[1], shingles(tb, width)
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common):
                    keep.append(i)
            places = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(1).take(places)], names=["a", "b"])

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and the smallest node it can reach, for every node of the links (a, b): a table in the shared folder.

    Each round every node takes the smallest label among its neighbours', then its label's own label. Labels are only
    ever lowered to nodes of the same component, so that when a round changes none each has its component's smallest.
    """
    spark = links.sparkSession
    links = shared.materialize(links, f"{name}-links")
    both = links.select("a", "b").union(links.select("b", "a")).toDF("u", "w")
    labels, path = shared.materialize_at(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("w"), F.min("u")).alias("label")), name)
    while True:
        heard = both.join(labels, F.col("u") == F.col("node")).select(F.col("w").alias("node"), "label")
        lower = heard.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        lower = lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("_next", "label")).alias("label"))
        moved, new_path = shared.materialize_at(lower, name)
        changed = moved.withColumnRenamed("label", "_new").join(labels, "node").filter("_new < label").limit(1).count()
        shared.remove(spark, path)
        labels, path = moved, new_path
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; documents are linked at `percent` similarity of their sets.

    1. Rows with the same set are one class, whose smallest doc_id stands for it; only classes go on.
    2. In each band bucket one class, that which shares most buckets with others, is compared with every other one:
       likelihood estimates from registers pick the pairs that full sets then confirm. A bucket of n classes gives
       n - 1 pairs.
    3. Classes of a bucket outside its centre's component are estimated against the bucket's other components, block
       by block. First the NEAREST of each are confirmed, then, of those that are still apart, all plausible ones.
    4. Components of all links.

    A document without words or text has an empty set and is linked with nothing. Rows with a null doc_id take no part:
    they have component_id null and are kept. Rows that repeat a doc_id are one node and get one component: if their
    texts differ, that of all links of any of them, also where one of them has no words. An empty table gives an empty one. Other columns are not read.
    """
    signed = shared.materialize(signatures(docs, width), "signatures")
    named = signed.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    sets = named.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    sets = shared.materialize(sets, "classes")
    links = linked_classes(sets, docs.filter("doc_id IS NOT NULL"), width, percent)
    # the classes of a doc_id that several rows have are one component
    texts = named.groupBy("doc_id").agg(F.min("set_id").alias("one"), F.max("set_id").alias("two")).filter("one < two").select("doc_id")
    nodes = named.join(texts, "doc_id", "left_semi").select("doc_id", "set_id").distinct().join(sets.select("set_id", "node"), "set_id")
    same = nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a < node").select("a", F.col("node").alias("b"))
    labels = components(links.unionByName(same.distinct()))
    of_class = sets.join(labels, "node", "left").select("set_id", F.coalesce("label", "node").alias("_component"))
    # hot sets: AQE splits the side of many rows
    found = signed.join(of_class, "set_id", "left")
    # rows without words whose doc_id other rows have
    bare = signed.filter("set_id IS NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    other = named.join(bare, "doc_id", "left_semi").join(of_class, "set_id").groupBy("doc_id").agg(F.min("_component").alias("_other"))
    found = found.join(other, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "_other", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def linked_classes(sets: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes of classes: enough to join whatever links within buckets can join."""
    threshold = percent / 100
    rows = band_rows(sets)
    sizes = rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = shared.materialize(rows.join(sizes, "band").distinct(), "members")
    shares = members.groupBy("node").agg(F.sum("size").alias("shares"))
    best = F.max(F.struct("shares", (-F.col("node")).alias("least")))
    centres = members.join(shares, "node").groupBy("band").agg((-best["least"]).alias("centre"))
    centred = shared.materialize(members.join(centres, "band"), "centred")
    tested = shared.materialize(ordered_pairs(centred.filter("node <> centre"), "centre", "node"), "pairs")
    links = shared.materialize(verified(plausible(tested, sets, threshold), docs, width, percent), "links")
    for most in (NEAREST, None):
        labels = components(links, "labels")
        mine, theirs = F.coalesce("label", "node"), F.coalesce("centre_label", "centre")
        of_centre = labels.select(F.col("node").alias("centre"), F.col("label").alias("centre_label"))
        known = centred.join(labels, "node", "left").join(of_centre, "centre", "left")
        known = shared.materialize(known.select("band", "node", "size", mine.alias("label"), (mine != theirs).alias("apart")), "labelled")
        if not known.filter("apart").limit(1).count():
            return links
        near = neighbours(known, sets, docs, width, percent, most)
        fresh = shared.materialize(ordered_pairs(near, "node", "other").join(tested, ["a", "b"], "left_anti"), "pairs")
        links = shared.materialize(links.unionByName(verified(fresh, docs, width, percent)), "links")
        tested = tested.unionByName(fresh)
    return links


def ordered_pairs(pairs: DataFrame, one: str, two: str) -> DataFrame:
    return pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


def short_sets(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node and its set, each shingle by the upper half of its hash."""

    def run(batches):
        for batch in batches:
            found = [np.unique((shingles(t, width) >> np.uint64(32)).astype("<u4")).tobytes() for s in shared.row_steps(batch) for t in s.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "short"])

    texts = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi")
    return texts.mapInArrow(run, "node long, short binary")


def neighbours(known: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int, most: int | None) -> DataFrame:
    """node and other: for classes that are apart from their bucket's centre, plausible partners of other components.

    known: band, node, size, label, apart. Buckets are dealt in blocks of at most about BLOCK classes that are apart
    against BLOCK classes of the bucket; registers are compared within a block pair, each pair only in the first of the
    buckets that it shares. With `most` given, the likeliest partners of each class that is apart come out. Without, all
    plausible pairs are counted through there by sets of half hashes, which can only overrate them, and those that reach
    the threshold come out.
    """
    threshold = percent / 100
    registers = sets.select("node", "n_shingles", "registers")
    live = known.filter("apart").select("band").distinct()
    here = known.join(live, "band").join(registers, "node")
    short = F.lit(None).cast("binary").alias("short")
    if most is None:
        here = here.join(short_sets(here.select("node").distinct(), docs, width), "node")
        short = F.col("short")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    part = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")
    each = F.explode(F.sequence(F.lit(0), blocks - 1))
    columns = ["node", "label", "n_shingles", "registers", "apart", short]
    apart = here.filter("apart").select("band", part(1).alias("x"), each.alias("y"), *columns)
    others = here.select("band", part(2).alias("y"), each.alias("x"), *columns).toDF(*(f"r_{c}" for c in ("band", "y", "x", *columns[:-1], "short")))
    bound = max(0.0, threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / REGISTERS))

    def small(t, k):
        return np.frombuffer(t.column(8)[int(k)].as_py(), "<u4")

    def reaches(one, two, n_one, n_two):
        # shingles of one set whose half hashes are equal might all be common
        common = len(np.intersect1d(one, two, assume_unique=True)) + n_one - len(one) + n_two - len(two)
        return 100 * common >= percent * (n_one + n_two - common)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            (ia, la, na, ra, _), (ib, lb, nb, rb, outside) = (
                (t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(5).to_numpy().astype(float), np.frombuffer(b"".join(t.column(6).to_pylist()), "<u2").reshape(-1, REGISTERS), t.column(7).to_numpy(zero_copy_only=False))
                for t in (left, right)
            )
            here, mine, theirs = left.column(0)[0].as_py(), bands(ra), bands(rb)
            for k in range(len(ia)):
                shared_bands = theirs == mine[k]
                j = np.flatnonzero((lb != la[k]) & (theirs[np.arange(len(ib)), shared_bands.argmax(axis=1)] == here) & (np.minimum(nb, na[k]) >= threshold * np.maximum(nb, na[k])))
                if most is None:
                    j = j[~outside[j] | (ib[j] > ia[k])]
                # registers are equal at least as often as the similarity says
                j = j[(rb[j] == ra[k]).sum(axis=1) >= REGISTERS * bound]
                if len(j):
                    est = likeliest(np.broadcast_to(ra[k], (len(j), REGISTERS)), rb[j], np.full(len(j), na[k]), nb[j])
                    j, est = j[est >= bound], est[est >= bound]
                    if most is None:
                        j = j[[reaches(small(left, k), small(right, x), na[k], nb[x]) for x in j]] if len(j) else j
                    else:
                        j = j[np.lexsort((ib[j], -est))[:most]]
                    found += [(ia[k], x) for x in ib[j]]
        return pa.table({"node": pa.array([x for x, _ in found], pa.int64()), "other": pa.array([y for _, y in found], pa.int64())})

    return apart.groupBy("band", "x", "y").cogroup(others.groupBy("r_band", "r_x", "r_y")).applyInArrow(compare, "node long, other long")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents"), width=2, percent=80)
