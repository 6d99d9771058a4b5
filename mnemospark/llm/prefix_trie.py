"""Conversation prefix trie by distributed MSD radix partitioning over turn codes, finished by multikey quicksort.

Turns become codes of a dictionary of distinct (role, text), so texts are read once. Conversations with one and the same
sequence fold into a class with its least id and its number of members. A radix round deals all classes of the open buckets by their
next code: a bucket is a node, and its numbers come from one aggregate, added up before the shuffle. A bucket of one class
is a tail: its nodes follow from its own turns and need no sorting. A bucket whose remaining turns are at most ``local``
is finished in one task by multikey quicksort (three parts by the code at the present place; the part of equal codes is the next
node). All others stay open for the next round. So no group in a task is unbounded, whatever many share: a first turn of a third of all
conversations is split by the second, and equal conversations are one class. Rounds number as many as the turns that a large
bucket shares.

Sums over subtrees go up along the path that each bucket carries (as long as the rounds), in one aggregate. The ids that end at a
node are hashed from blocks in ascending order, which one task streams: SHA-256 has an order, memory is one block.

Defined results: a null role or text is empty. Turns are ordered by turn (null first), then by the hash of role and text;
repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left out. An empty text is a turn; a very
long one is hashed and counted where it is read and not moved. An empty table has no node, not even a root. Other columns stay behind whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import join_by_size, written
from mnemospark.operators.segmented import prefix
from mnemospark.session import finished, mark

LOCAL = 4096  # turns of a bucket that one task finishes
BLOCK = 256  # ids of a block of those that end at a node
SHORT = 20_000  # ids that are hashed as one string
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_rep long, end_w long"


def kept_turns(base: int = 5, modulus: int = 9, conv: str = "conv_id") -> tuple[Column, Column]:
    """(base, h): the conversation that the first h turns come from, h = crc32 of the id in decimal, mod modulus."""
    c = F.col(conv)
    return c - c % base, F.crc32(c.cast("string").cast("binary")) % modulus


def coded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, code, n_bytes): every turn with its 0-based place and its code in the dictionary of (role, text)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    placed = written(prefix(written(turns, "turns"), ["conv_id"], ["turn", "digest"], position="place"), "placed")
    book = placed.groupBy("digest").agg(F.count(F.lit(1)).alias("uses")).withColumn("code", F.monotonically_increasing_id())
    book = written(book, "dictionary")  # codes hold from here on
    return join_by_size(placed.drop("turn"), book, ["digest"], "uses").select("conv_id", "place", "code", "n_bytes")


def rebuilt(turns: DataFrame, base: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, sequences): (conv_id, n) of each, and (conv_id, depth from 1, code, n_bytes) of its rebuilt turns.

    The first h turns come from the base conversation (as many as it has), the others are its own after the first h.
    """
    from_, h = kept_turns(base, modulus)
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("base", from_).withColumn("h", h)
    convs = written(convs, "conversations")
    heads = turns.filter(F.col("place") < modulus - 1).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "code", "n_bytes"))).alias("first"))  # at most modulus - 1 turns
    headed = convs.join(heads, "base", "left").withColumn("first", F.coalesce(F.expr(f"slice(first, 1, int(h))"), F.expr("cast(array() as array<struct<place: bigint, code: bigint, n_bytes: bigint>>)")))
    headed = written(headed.select("conv_id", "own", "h", F.size("first").cast("long").alias("m"), "first"), "headed")
    taken = headed.select("conv_id", F.explode("first").alias("t")).select("conv_id", (F.col("t.place") + 1).alias("depth"), "t.code", "t.n_bytes")
    rest = turns.withColumn("_h", kept_turns(base, modulus)[1]).filter(F.col("place") >= F.col("_h")).drop("_h")
    own = join_by_size(rest, headed.select("conv_id", "own", "m", "h"), ["conv_id"], "own")
    own = own.select("conv_id", (F.col("m") + F.col("place") - F.col("h") + 1).alias("depth"), "code", "n_bytes")
    convs = headed.select("conv_id", (F.col("m") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).cast("long").alias("n"))
    return convs, written(taken.unionByName(own), "sequences")


def _classes(convs: DataFrame, seqs: DataFrame) -> DataFrame:
    """(conv_id, n, rep, w): the least id and the number of conversations with the same sequence.

    A sequence is known by its length and the exclusive or of 128 bits of the SHA-256 of each (depth, code); chance
    would have to hit 128 bits for two to be taken for one.
    """
    part = F.sha2(F.concat_ws(":", "depth", "code").cast("binary"), 256)
    bits = lambda at: F.conv(F.substring(part, at, 15), 16, 10).cast("long")
    marks = seqs.select("conv_id", *[bits(1 + 15 * k).alias(f"x{k}") for k in range(3)]).groupBy("conv_id").agg(*[F.bit_xor(f"x{k}").alias(f"x{k}") for k in range(3)])
    marked = written(convs.join(marks, "conv_id", "left").na.fill(0, ["x0", "x1", "x2"]), "marks")
    keys = ["n", "x0", "x1", "x2"]
    sizes = marked.groupBy(*keys).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    return join_by_size(marked, sizes.withColumn("w", F.col("size")), keys, "size").select("conv_id", "n", "rep", "w")


def _ends(members: DataFrame) -> DataFrame:
    """(end_rep, ends_sha256) of classes of more than one conversation: ids ascending, joined by commas."""
    many = members.filter("w > 1").select("rep", "w", "conv_id")
    joined = lambda ids: F.array_join(F.transform(F.array_sort(ids), lambda c: c.cast("string")), ",")
    few = many.filter(F.col("w") <= SHORT).groupBy("rep").agg(F.sha2(joined(F.collect_list("conv_id")).cast("binary"), 256).alias("ends_sha256"))
    large = written(many.filter(F.col("w") > SHORT), "hot-ends")
    if large.isEmpty():
        return few.withColumnRenamed("rep", "end_rep")
    blocks = prefix(large, ["rep"], ["conv_id"]).groupBy("rep", F.floor(F.col("position") / BLOCK).alias("block")).agg(joined(F.collect_list("conv_id")).alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h = None, None
        for b in batches:
            for rep, ids in zip(b["rep"].tolist(), b["ids"].tolist(), strict=True):
                if rep != at:
                    if h is not None:
                        yield pd.DataFrame({"rep": [at], "ends_sha256": [h.hexdigest()]})
                    at, h = rep, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
        if h is not None:
            yield pd.DataFrame({"rep": [at], "ends_sha256": [h.hexdigest()]})

    hot = blocks.repartition("rep").sortWithinPartitions("rep", "block").select("rep", "ids").mapInPandas(digest, "rep long, ends_sha256 string")
    return few.unionByName(hot).withColumnRenamed("rep", "end_rep")


def quicksorted(seqs: list[list[int]], reps: list[int], weights: list[int], sizes: list[list[int]], depth: int) -> list[list]:
    """Nodes of a bucket of distinct sequences, whose first code (the turn of depth ``depth``) all share.

    Multikey quicksort with a stack: a range of sequences that agree on a prefix is split by the code at the next place into less, equal and
    greater; equal ones are a node and go on one place further. Rows as in _NODE, parents before children; the
    first row's parent is not known here.
    """
    order, nodes, up = list(range(len(seqs))), [], []

    def node(lo: int, hi: int, at: int, parent: int) -> int:
        mine = order[lo:hi]
        ended = next((i for i in mine if len(seqs[i]) == at), None)
        nodes.append([min(reps[i] for i in mine), depth + at - 1, None, sum(weights[i] for i in mine), 0, 0, 0, None if ended is None else reps[ended], 0 if ended is None else weights[ended]])
        nodes[-1][6] = (nodes[-1][3] - 1) * sizes[mine[0]][at - 1]
        up.append(parent)
        if parent >= 0:
            nodes[-1][2] = nodes[parent][0]
            nodes[parent][4] += 1
        return len(nodes) - 1

    todo = [(0, len(order), 1, node(0, len(order), 1, -1))]
    while todo:
        lo, hi, at, parent = todo.pop()
        if hi - lo == 1:  # a tail
            for k in range(at, len(seqs[order[lo]])):
                parent = node(lo, hi, k + 1, parent)
            continue
        codes = [seqs[i][at] if len(seqs[i]) > at else -1 for i in order[lo:hi]]
        pivot = codes[len(codes) // 2]
        less, equal, more = [], [], []
        for i, c in zip(order[lo:hi], codes, strict=True):
            (equal if c == pivot else less if c < pivot else more).append(i)
        order[lo:hi] = less + equal + more
        a, b = lo + len(less), lo + len(less) + len(equal)
        for x, y in ((lo, a), (b, hi)):
            if x < y:
                todo.append((x, y, at, parent))
        if pivot >= 0:
            todo.append((a, b, at + 1, node(a, b, at + 1, parent)))
    for k in range(len(nodes) - 1, -1, -1):
        if not nodes[k][4]:
            nodes[k][5] = 1
        if up[k] >= 0:
            nodes[up[k]][5] += nodes[k][5]
            nodes[up[k]][6] += nodes[k][6]
    return nodes


def _finish(rows: DataFrame) -> DataFrame:
    """Nodes of local buckets; rows (bucket, start, rep, w, depth, code, n_bytes) from each bucket's own depth start on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in _NODE.split(", ")]

        def nodes(b: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, bucket in b.groupby(["start", "bucket"], sort=False):
                reps, first = np.unique(bucket["rep"].to_numpy(), return_index=True)
                first = np.sort(first)
                cut = np.append(first, len(bucket))
                codes, sizes = bucket["code"].tolist(), bucket["n_bytes"].tolist()
                reps, weights = bucket["rep"].to_numpy()[first].tolist(), bucket["w"].to_numpy()[first].tolist()
                slices = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                out += quicksorted([codes[x:y] for x, y in slices], reps, weights, [sizes[x:y] for x, y in slices], int(bucket["start"].iloc[0]))
            frame = pd.DataFrame(out, columns=names, dtype=object)
            return frame.astype({n: "Int64" for n in names})

        left = None
        for b in batches:
            b = b if left is None or not len(left) else pd.concat([left, b], ignore_index=True)
            if not len(b):
                continue
            last = (b["start"] == b["start"].iloc[-1]) & (b["bucket"] == b["bucket"].iloc[-1])
            if not last.all():
                yield nodes(b[~last])
            left = b[last]  # its rows may go on in the next batch
        if left is not None and len(left):
            yield nodes(left)

    dealt = rows.repartition("bucket", "start").sortWithinPartitions("start", "bucket", "rep", "depth")
    return dealt.select("start", "bucket", "rep", "w", "code", "n_bytes").mapInPandas(run, _NODE)


def trie(convs: DataFrame, seqs: DataFrame, local: int = LOCAL, max_rounds: int = 10_000) -> DataFrame:
    """The nodes of all prefixes of the sequences; see the module's text."""
    members = written(_classes(convs, seqs), "members")
    root = members.agg(F.min("conv_id"), F.count(F.lit(1)), F.max(F.when(F.col("n") == 0, F.col("rep"))), F.max(F.when(F.col("n") == 0, F.col("w")))).first()
    spark = members.sparkSession
    if not root[1]:
        return spark.createDataFrame([], _NODE + ", ends_sha256 string").drop("end_rep", "end_w")
    classes = members.filter("conv_id = rep").select("rep", "n", "w")
    turns = written(join_by_size(seqs, classes.select(F.col("rep").alias("conv_id"), "w", F.col("n"), F.col("n").alias("size")), ["conv_id"], "size").withColumnRenamed("conv_id", "rep"), "class-turns")

    bytes_of = F.max("n_bytes")
    path = "array<bigint>"
    uppers = [spark.createDataFrame([(root[0], 0, None, root[1], 0, [root[0]], root[2], root[3] or 0)], f"conv_id long, depth long, parent_conv_id long, n_convs long, n_bytes long, path {path}, end_rep long, end_w long")]
    exits, entered = [], []
    open_ = classes.filter("n > 0").select("rep", "n", "w", F.lit(root[0]).cast("long").alias("bucket"), F.array(F.lit(root[0]).cast("long")).cast(path).alias("path"))
    for depth in range(1, max_rounds):
        at = turns.filter(F.col("depth") == depth).select("rep", "code", "n_bytes")
        now = written(open_.filter(F.col("n") >= depth).join(at, "rep"), "radix")
        if now.isEmpty():
            break
        buckets = now.groupBy("bucket", "code").agg(
            F.min("rep").alias("key"),
            F.sum("w").alias("n_convs"),
            F.count(F.lit(1)).alias("n_classes"),
            F.sum(F.col("n") - (depth - 1)).alias("left"),
            bytes_of.alias("last_bytes"),
            F.max(F.when(F.col("n") == depth, F.col("rep"))).alias("end_rep"),
            F.max(F.when(F.col("n") == depth, F.col("w"))).alias("end_w"),
            F.first("path").alias("path"),
        )
        buckets = written(buckets, "buckets")
        stays = (F.col("n_classes") > 1) & (F.col("left") > local)
        above = F.col("bucket").alias("parent_conv_id")
        uppers.append(buckets.filter(stays).select(F.col("key").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), above, "n_convs", F.col("last_bytes").alias("n_bytes"), F.concat("path", F.array("key")).alias("path"), "end_rep", F.coalesce("end_w", F.lit(0)).cast("long").alias("end_w")))
        exits.append(buckets.filter(~stays).select("key", F.lit(depth).cast("long").alias("start"), above, "n_classes", "path"))
        dealt = join_by_size(now.drop("n_bytes", "path"), buckets.select("bucket", "code", "key", "n_classes", "left", "path", F.col("n_classes").alias("size")), ["bucket", "code"], "size")
        entered.append(dealt.filter(~stays).select("rep", "n", "w", F.col("key").alias("bucket"), F.lit(depth).cast("long").alias("start"), "n_classes", F.col("bucket").alias("above")))
        open_ = dealt.filter(stays).select("rep", "n", "w", F.col("key").alias("bucket"), F.concat("path", F.array("key")).alias("path"))
    else:
        raise RuntimeError(f"buckets are still open after {max_rounds} rounds")

    union = lambda parts: _together(parts)
    parts = []
    if entered:
        inside = written(union(entered), "entered")
        rest = join_by_size(turns.drop("w", "n"), inside.withColumn("size", F.col("n")), ["rep"], "size").filter(F.col("depth") >= F.col("start"))
        rest = written(rest, "bucket-turns")
        parts += [_tails(rest.filter("n_classes = 1")), _finish(rest.filter("n_classes > 1"))]
        below = written(union(parts), "lower-nodes")
        gone = union(exits).withColumnRenamed("key", "conv_id")
        firsts = gone.join(below.select("conv_id", F.col("depth").alias("start"), "n_leaves", "saved_tokens"), ["conv_id", "start"])
        heads = gone.select("conv_id", F.col("start").alias("depth"), F.col("parent_conv_id").alias("above"))
        below = below.join(heads, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id")).drop("above")
        sums = firsts.select("path", "n_leaves", "saved_tokens")
    else:
        below = None
        sums = spark.createDataFrame([], f"path {path}, n_leaves long, saved_tokens long")

    upper = written(union(uppers), "upper-nodes")
    own = upper.select("path", F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    added = sums.unionByName(own).select(F.posexplode("path").alias("depth", "conv_id"), "n_leaves", "saved_tokens").groupBy(F.col("depth").cast("long").alias("depth"), "conv_id").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    links = upper.filter("depth > 0").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    if exits:
        links = links.unionByName(union(exits).select(F.col("parent_conv_id").alias("conv_id"), (F.col("start") - 1).alias("depth")))
    children = links.groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("n_children"))
    tops = upper.drop("path", "n_bytes").join(added, ["conv_id", "depth"], "left").join(children, ["conv_id", "depth"], "left")
    tops = tops.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))
    names = [x.split(" ")[0] for x in _NODE.split(", ")]
    nodes = tops.select(*names) if below is None else tops.select(*names).unionByName(below.select(*names))
    return _with_ends(nodes, _ends(members))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tails(rows: DataFrame) -> DataFrame:
    """Nodes of buckets of one class: a chain, whose sums need its turns' bytes only where it has several members."""
    chain = rows.select("rep", "w", "n", "start", "above", "depth", "n_bytes")
    shared = prefix(written(chain.filter("w > 1"), "shared-tails"), ["rep"], [F.desc("depth")], {"upto": F.col("n_bytes")}).drop("position")
    both = chain.filter("w = 1").withColumn("upto", F.lit(0).cast("long")).unionByName(shared)
    last = F.col("depth") == F.col("n")
    return both.select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("start"), F.col("above")).otherwise(F.col("rep")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * F.col("upto")).cast("long").alias("saved_tokens"),
        F.when(last, F.col("rep")).alias("end_rep"),
        F.when(last, F.col("w")).otherwise(0).cast("long").alias("end_w"),
    )


def _with_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    several = F.col("end_w") > 1
    alone = F.when(F.col("end_w") == 1, F.sha2(F.col("end_rep").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY))
    out = nodes.filter(~several).withColumn("ends_sha256", alone).unionByName(nodes.filter(several).join(ends, "end_rep").select(*nodes.columns, "ends_sha256"))
    return out.drop("end_rep", "end_w")


def conversation_trie(conversations: DataFrame, base: int = 5, modulus: int = 9, local: int = LOCAL) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the rebuilt conversations."""
    before = mark()
    convs, seqs = rebuilt(written(coded_turns(conversations), "coded"), base, modulus)
    return finished(trie(convs, seqs, local), "trie", before)
