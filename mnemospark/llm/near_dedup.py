"""Near-duplicate documents by b-bit MinHash, with every link confirmed on full shingle sets.

1. One pass over the texts: the set of five-word shingles (as 64-bit hashes), ``perms`` minima, band keys from the
   full minima, and a packed signature of the low ``bits`` of each minimum. Documents with one and the same set
   form a class (128-bit digest of the set) and go on as one node, so exact copies cost one row each.
2. Band candidates: nodes meet in the buckets of their band keys. Inside a bucket, packed signatures are compared by
   bit counts, corrected for chance agreement; nodes that look alike at ``loose`` (six standard deviations under the
   threshold) hang together, and a bucket emits one row for each member at most, not its pairs. Buckets above
   ``block`` members are worked on in blocks (``linked``).
3. Components of those rows are families: any two nodes that are truly linked and met in a band are in one family.
4. Sets are made again for members of families only (a fixed-size bitmap keeps other texts out before any shuffle).
   In each family, in blocks of bounded size, intersections are counted exactly; links
   100*|A and B| >= threshold*|A or B| are merged, again one row for each member at most. Work in a large group follows
   its blocks, and what is not connected after a first pass, not the pairs of its blocks.
5. Components of the confirmed links, with all copies of a class, give component_id.

Bands and rows follow from the threshold, so that the chance that two nodes at it never meet is below 1e-5
(``scheme_for``): (1 - 0.85^5)^20 = 8.1e-6 at 85, (1 - 0.8^4)^25 = 1.9e-6 at 80. Nothing is capped.

Defined results: null or empty text, or text without words, has an empty set, n_shingles 0, and is alone (its own
doc_id is its component). Rows that share a doc_id are separate rows; equal sets still link them. A null doc_id
is never a component's id unless all its rows have null. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import hold, join_by_size, text_of, texts_of, written
from mnemospark.operators.components import components

K = 5  # words in a shingle
CACHE_BOUND = 250_000
BITMAP_BITS = 1 << 24
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_WORDS: dict[bytes, int] = {}


def _use_words() -> None:
    """This worker's word hashes are the cache in use."""
    hold("near dedup", _WORDS.clear)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word; A-Z lower-cased, words split at the six ASCII white space bytes."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    try:
        return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_WORDS) > CACHE_BOUND:
            _WORDS.clear()
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(text: str, k: int = K) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words make one shingle; none make none."""
    w = word_hashes(text)
    n = len(w)
    if n == 0:
        return w
    m = min(n, k)
    h = np.full(n - m + 1, np.uint64(m), np.uint64)
    for j in range(m):
        h += w[j : n - m + 1 + j] * _ODD[j % 5]
        if k > 5:
            h = mix(h)
    return np.unique(mix(h))


class Scheme:
    """Permutations, bands and packing."""

    def __init__(self, bands: int = 20, rows: int = 5, bits: int = 4, seed: int = 5):
        self.bands, self.rows, self.bits = bands, rows, bits
        self.perms = bands * rows
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 31, self.perms, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, self.perms, dtype=np.uint32)[:, None]
        self.lanes = 64 // bits
        self.longs = -(-self.perms // self.lanes)
        self.low = np.uint64(sum(1 << (bits * k) for k in range(self.lanes)))

    def minima(self, sets: np.ndarray) -> np.ndarray:
        x = (sets >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.perms, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(out, (self.a * x[None, at : at + 2048] + self.b).min(axis=1), out=out)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(self.bands, self.rows).astype(np.uint64)
        h = np.arange(1, self.bands + 1, dtype=np.uint64) * _ODD[0]
        for j in range(self.rows):
            h = mix(h ^ (m[:, j] * _ODD[1] + np.uint64(j)))
        return h.view(np.int64)

    def pack(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of each minimum, in 64-bit words."""
        v = np.zeros(self.longs * self.lanes, np.uint64)
        v[: self.perms] = minima & np.uint32((1 << self.bits) - 1)
        shift = (np.arange(self.lanes, dtype=np.uint64) * np.uint64(self.bits))[None, :]
        return np.bitwise_or.reduce(v.reshape(self.longs, self.lanes) << shift, axis=1)

    def estimate(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Similarity of one packed signature to many, from the lanes that differ, corrected for chance."""
        x = many ^ one
        fold = 1
        while fold < self.bits:
            x |= x >> np.uint64(fold)
            fold *= 2
        differ = np.bitwise_count(x & self.low).sum(axis=1)
        chance = 0.5**self.bits
        return ((1 - differ / self.perms) - chance) / (1 - chance)


def scheme_for(percent: int, perms: int = 100, miss: float = 1e-5) -> Scheme:
    """The longest bands of about perms minima whose chance to miss a pair at percent is below miss."""
    p = percent / 100
    for rows in range(5, 0, -1):
        if (1 - p**rows) ** (perms // rows) < miss:
            return Scheme(perms // rows, rows)
    return Scheme(int(np.log(miss) / np.log(1 - p)) + 1, 1)


SIGNED = "doc_id long, n_shingles long, node binary, bands array<long>, sig array<long>"


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """One row a document; node, bands and sig are null without shingles."""

    def run(batches):
        import xxhash

        _use_words()
        for b in batches:
            n, node, bands, sig = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                n.append(len(s))
                if len(s):
                    m = scheme.minima(s)
                    node.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(scheme.band_keys(m))
                    sig.append(scheme.pack(m).view(np.int64))
                else:
                    node.append(None), bands.append(None), sig.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, longs), pa.array(sig, longs)], names=["doc_id", "n_shingles", "node", "bands", "sig"])

    return texts_of(docs).mapInArrow(run, SIGNED)


def merged(linked) -> np.ndarray:
    """Least member of each member's component; linked(i, js) tells which of js link with i."""
    n = linked.n
    root = np.arange(n)
    for i in range(n - 1):
        js = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(js):
            continue
        for r in np.unique(root[js[linked(i, js)]]):
            if r != root[i]:
                lo, hi = min(r, root[i]), max(r, root[i])
                root[root == hi] = lo
    return root


class _Alike:
    def __init__(self, scheme: Scheme, sig: np.ndarray, loose: float):
        self.n, self.scheme, self.sig, self.loose = len(sig), scheme, sig, loose

    def __call__(self, i: int, js: np.ndarray) -> np.ndarray:
        return self.scheme.estimate(self.sig[i], self.sig[js]) >= self.loose


class _Linked:
    """Exact links of sets: all intersections by products of 0/1 matrices over the shingles that two sets share."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.n, self.percent = len(sets), percent
        self.size = np.array([len(s) for s in sets], np.int64)
        if self.n == 2:
            both = len(np.intersect1d(*sets, assume_unique=True))
            self.inter = np.array([[self.size[0], both], [both, self.size[1]]])
            return
        owner = np.repeat(np.arange(self.n), self.size)
        _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = count[at] > 1
        column = np.cumsum(count > 1) - 1
        owner, at = owner[keep], column[at[keep]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        width = max(256, (1 << 23) // self.n)
        inter = np.zeros((self.n, self.n), np.float64)
        total = int((count > 1).sum())
        for c in range(0, total, width):
            lo, hi = np.searchsorted(at, [c, c + width])
            m = np.zeros((self.n, min(width, total - c)), np.float32)
            m[owner[lo:hi], at[lo:hi] - c] = 1
            inter += m @ m.T
        self.inter = inter.round().astype(np.int64)

    def __call__(self, i: int, js: np.ndarray) -> np.ndarray:
        both = self.inter[i, js]
        return 100 * both >= self.percent * (self.size[i] + self.size[js] - both)


def _runs(batches, keys: int):
    """Rows of sorted batches that agree in the first columns, as lists of the other columns' values."""
    held, held_key = None, None
    for b in batches:
        if not b.num_rows:
            continue
        head = [b.column(k).to_pylist() for k in range(keys)]
        head = list(zip(*head, strict=True))
        begin = 0
        for k in range(1, len(head) + 1):
            if k == len(head) or head[k] != head[begin]:
                part = b.slice(begin, k - begin)
                if held is not None and held_key == head[begin]:
                    held.append(part)
                else:
                    if held is not None:
                        yield held
                    held, held_key = [part], head[begin]
                begin = k
    if held is not None:
        yield held


def _in_groups(df: DataFrame, keys: list[str], merge, of: str) -> DataFrame:
    """(a, b) rows from each group of df: merge(columns) gives each member's root, members that are not roots emit one row."""
    n_keys = len(keys)

    def run(batches):
        a, b = [], []
        for parts in _runs(batches, n_keys):
            nodes = [x for p in parts for x in p.column(n_keys).to_pylist()]
            if len(nodes) > 1:
                values = [p.column(n_keys + 1) for p in parts]
                root = merge(values)
                for k, r in enumerate(root.tolist()):
                    if r != k:
                        a.append(nodes[r]), b.append(nodes[k])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return df.select(*keys, "node", of).repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")


def _blocks_of(n: str):
    """The numbers 0 .. n - 1 as rows."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def linked(df: DataFrame, keys: list[str], merge, of: str, large: bool) -> DataFrame:
    """(a, b) rows that connect the nodes of each group (keys) of df (keys, node, of, blocks) as their links do.

    A group of one block is merged as it is. Of a larger one (large: whether there is any), each block is merged together
    with the group's first block, so the work grows with the blocks and not with their pairs; that connects what is alike
    across them. What may be left are links between nodes that are still apart: all members outside a group's largest
    component, the leftovers, are compared with all members, block by block. Links inside the largest component would
    connect nothing. Only members of large groups are written for the second pass.
    """
    if not large:
        return _in_groups(df.drop("blocks"), keys, merge, of).distinct()
    many = written(df.filter("blocks > 1").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))), "large-groups")
    small = _in_groups(df.filter("blocks = 1").drop("blocks"), keys, merge, of)
    seats = F.when(F.col("own") > 0, F.array("own")).otherwise(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1))
    first = _in_groups(many.withColumn("seat", F.explode(seats)), [*keys, "seat"], merge, of)
    edges = written(small.unionByName(first).distinct(), "links")
    label = components(edges)
    apart = written(many.select(*keys, "node", "blocks").join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    sizes = apart.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.max("blocks").alias("blocks"))
    whole = sizes.groupBy(*keys).agg(F.max_by("label", "n").alias("largest"), F.sum("n").alias("members"), F.max("n").alias("most"), F.max("blocks").alias("blocks"))
    open_ = written(whole.filter("most < members").select(*keys, "largest", F.ceil(F.col("blocks") * (F.col("members") - F.col("most")) / F.col("members")).cast("long").alias("left_blocks"), "members"), "open-groups")
    if open_.isEmpty():
        return edges
    here = join_by_size(many, open_, keys, "members").join(apart.select(*keys, "node", "label"), [*keys, "node"])
    left = here.filter(F.col("label") != F.col("largest")).withColumn("lo", F.pmod(F.xxhash64("node", F.lit(1)), F.col("left_blocks"))).withColumn("hi", _blocks_of("blocks"))
    all_ = here.withColumn("hi", F.col("own")).withColumn("lo", _blocks_of("left_blocks"))
    columns = [*keys, "lo", "hi", "node", of]
    seated = left.select(*columns).unionByName(all_.select(*columns)).dropDuplicates([*keys, "lo", "hi", "node"])
    return edges.unionByName(_in_groups(seated, [*keys, "lo", "hi"], merge, of).distinct())


def families(nodes: DataFrame, scheme: Scheme, loose: float, block: int) -> DataFrame:
    """(a, b) rows that hang nodes (node, bands, sig) with alike signatures in a common bucket together."""
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = written(shared.withColumn("blocks", F.ceil(F.col("members") / block).cast("long")), "shared-buckets")
    met = join_by_size(buckets, shared, ["key"], "members").select("key", "node", "blocks")
    met = met.join(nodes.select("node", "sig"), "node")

    def merge(values) -> np.ndarray:
        sig = np.concatenate([np.asarray(v.flatten()) for v in values]).view(np.uint64).reshape(-1, scheme.longs)
        return merged(_Alike(scheme, sig, loose))

    return linked(met, ["key"], merge, "sig", not shared.filter("blocks > 1").isEmpty())


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of ids.h, in BITMAP_BITS bits whatever their number."""
    rows = ids.select(F.pmod("h", F.lit(BITMAP_BITS)).alias("at")).groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 AS int)))").alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 32, np.int64)
    for r in rows:
        out[r.word] = r.bits
    return out


def family_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(family, blocks, node, shingles) of members (node, digest, doc_key, family, blocks)."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(members.select(F.xxhash64("doc_key").alias("h"))))

    def run(batches):
        import xxhash

        _use_words()
        bits = wanted.value
        for b in batches:
            at = np.asarray(b.column(1)) % BITMAP_BITS
            keys, nodes, sets = [], [], []
            for k in np.flatnonzero((bits[at // 32] >> (at % 32)) & 1).tolist():
                s = shingles(b.column(2)[k].as_py())
                if len(s):
                    keys.append(b.column(0)[k].as_py()), nodes.append(xxhash.xxh3_128_digest(s.tobytes())), sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_key", "digest", "shingles"])

    made = docs.select(key.alias("doc_key"), F.xxhash64(key).alias("h"), text_of().alias("text")).mapInArrow(run, "doc_key long, digest binary, shingles array<long>")
    once = made.dropDuplicates(["doc_key", "digest"])  # repeated rows of a document are one set; they fold before the shuffle
    return once.join(members, ["doc_key", "digest"]).select("family", "blocks", "node", "shingles")


def confirmed(sets: DataFrame, percent: int, large: bool = True) -> DataFrame:
    """(a, b) rows that join the linked nodes of each family; large: whether one has several blocks."""

    def merge(values) -> np.ndarray:
        own = []
        for v in values:
            flat, at = np.asarray(v.values), np.asarray(v.offsets)
            own += [flat[p:q].view(np.uint64) for p, q in zip(at[:-1], at[1:], strict=True)]
        return merged(_Linked(own, percent))

    return linked(sets, ["family"], merge, "shingles", large)


def near_dedup(docs: DataFrame, percent: int = 80, scheme: Scheme | None = None, block: int = 2048, elements: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    percent: documents link when 100*|A and B| >= percent*|A or B|. elements: shingles in a block of a family.
    """
    scheme = scheme or scheme_for(percent)
    p = percent / 100
    agree = p + (1 - p) * 0.5**scheme.bits
    loose = p - 6 * (agree * (1 - agree) / scheme.perms) ** 0.5 / (1 - 0.5**scheme.bits)
    signed = written(signatures(docs, scheme), "signatures")
    some = signed.filter(F.col("node").isNotNull())
    least_id = F.min(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    made = some.groupBy(F.col("node").alias("digest")).agg(least_id.alias("doc_key"), F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    nodes = written(made.withColumn("node", F.monotonically_increasing_id()), "nodes")  # a short number for each set
    family = components(families(nodes, scheme, loose, block))
    about = written(nodes.select("node", "digest", "doc_key", "size").join(family, "node").withColumnRenamed("label", "family"), "family-members")
    load = about.groupBy("family").agg(F.greatest(F.ceil(F.sum("size") / elements), F.ceil(F.count(F.lit(1)) / 1024)).cast("long").alias("blocks"), F.count(F.lit(1)).alias("n"))
    members = written(join_by_size(about, load, ["family"], "n").select("node", "digest", "doc_key", "family", "blocks"), "members")
    links = components(confirmed(family_sets(docs, members), percent, not members.filter("blocks > 1").isEmpty()))
    joined = written(nodes.select("node", "first_id").join(links, "node"), "linked-nodes")
    least = joined.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_label = join_by_size(joined.select("node", "label"), least, ["label"], "n").select("node", "component_id")
    of_node = nodes.select("node", "digest", "first_id", "copies").join(of_label, "node", "left")
    of_node = written(of_node.select(F.col("digest").alias("node"), "copies", F.coalesce("component_id", "first_id").alias("component_id")), "node-components")
    rows = signed.select("doc_id", "n_shingles", "node")
    some = join_by_size(rows.filter(F.col("node").isNotNull()), of_node, ["node"], "copies")
    none = rows.filter(F.col("node").isNull()).withColumn("component_id", F.col("doc_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none.select("doc_id", "n_shingles", "component_id")).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.when(F.col("n_shingles") > 0, F.col("doc_id").eqNullSafe(F.col("component_id"))).otherwise(True).alias("kept"),
    )
