"""Document fingerprints from closed syncmers, DataFrame functions only.

A text becomes a row of tokens: words, and each CJK character by itself. Of its k-token windows (after k-1 leading
pads, so short texts have windows too) those stay whose least s-token substring lies at the window's first or last
place: closed syncmers. The choice looks at nothing but the window itself, so an edit changes only the anchors that
touch it, and equal passages keep their anchors wherever they stand. The fingerprint of a text is the set of all its
anchors (32 bits each), printed ascending as 8 hexadecimal digits each. The likeness of two fingerprints is the number of anchors that
both have as a share of those that either has, so it follows from the printed forms alone; nothing is cut.

The next document by id comes from buckets of neighbouring rows in the order of (doc_id, hash of the text). Their bounds
are quantiles of the keys themselves, so outliers, null ids and ids that repeat make no bucket larger than others: a
sample of the keys gives cuts, and the least key of each bucket is its first row. One shuffle deals texts to buckets,
found by binary search in the sorted first keys (at most ``MOST_BUCKETS`` of two numbers each); the first row of each bucket goes to
the bucket before it as well, and lead() finds the neighbour inside the bucket. Each text is hashed once, after that
shuffle, so anchors are never shuffled.

Defined results: null counts as empty; an empty text has the empty fingerprint, likeness 1 to another empty one and
0 to any other. Null doc_ids come first. Rows that share a doc_id follow each other in the order of a hash of their
text. A single document is its own next. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import text_of, written

K, S = 5, 2
MOST_BUCKETS = 65_536
_CJK = r"[⺀-鿿가-힯豈-﫿]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over an array of one."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    apart = F.when(text.rlike(_CJK), F.regexp_replace(text, f"({_CJK})", " $1 ")).otherwise(text)
    return F.filter(F.split(apart, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The hash of each closed syncmer, null at the other windows, in the order of their places."""

    def of_parts(parts: Column) -> Column:
        # parts[i]: hash of the s tokens from i; a window holds parts i .. i+k-s.
        last = k - s

        def window(x: Column, i: Column) -> Column:
            end = F.get(parts, i + last)
            inner = [F.get(parts, i + j) for j in range(1, last)]
            least = F.least(x, *inner, end)
            spans = [x, *[F.get(parts, i + j) for j in sorted({*range(s, last, s), last})]]
            return F.when(end.isNotNull() & ((least == x) | (least == end)), F.xxhash64(*spans))

        return F.transform(parts, window)

    def of_hashes(h: Column) -> Column:
        padded = F.concat(F.array_repeat(F.lit(0).cast("long"), k - 1), h)
        return let(padded, lambda p: let(F.transform(p, lambda x, i: F.xxhash64(x, *[F.get(p, i + j) for j in range(1, s)])), of_parts))

    return let(F.transform(tokens(text), lambda w: F.xxhash64(w)), of_hashes)


def syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<place, hash>> of the closed syncmers, for matching by position."""
    numbered = F.transform(anchors(text, k, s), lambda h, i: F.struct(i.alias("place"), h.alias("hash")))
    return F.filter(numbered, lambda x: x["hash"].isNotNull())


def fingerprint(text: Column) -> Column:
    """All anchors of a text, 32 bits each, distinct and ascending."""
    short = F.transform(F.filter(anchors(text), lambda h: h.isNotNull()), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.array_sort(F.array_distinct(short))


def as_text(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the anchors of two fingerprints together that both have; 1 for two empty ones."""
    share = let(F.size(F.array_intersect(a, b)), lambda both: both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(share)


def place(key: Column, bounds: list, of: str) -> Column:
    """How many of the sorted bounds, rows of type of, are at most key: a binary search."""
    table = F.from_json(F.lit(json.dumps(bounds)), f"array<{of}>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))


KEY = "struct<doc_id: bigint, tie: bigint>"


def bucket_firsts(keys: DataFrame, per_bucket: int, draws: int = 4) -> list[dict]:
    """The least key of each bucket, ascending; keys has one column, key."""
    n = keys.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // per_bucket)))
    drawn = keys.filter(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(max(1, n // (draws * buckets)))) == 0).distinct()
    cuts = [r.key.asDict() for r in drawn.orderBy("key").collect()][draws - 1 :: draws]  # about as many as buckets
    firsts = keys.groupBy(place(F.col("key"), cuts, KEY).alias("at")).agg(F.min("key").alias("key"))
    return sorted((r.key.asDict() for r in firsts.collect()), key=lambda k: (k["doc_id"] is not None, k["doc_id"], k["tie"]))


def with_next(rows: DataFrame, columns: list[str], made: dict[str, Column], per_bucket: int = 512) -> DataFrame:
    """rows (doc_id, tie, ...) with next_<column> from the next row by ascending (doc_id, tie); after the last, the first.

    made: columns that are added to rows after the shuffle; columns may name them.
    """
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("tie"))
    firsts = bucket_firsts(written(rows.select(key.alias("key")), "fingerprint-keys"), per_bucket)
    at = rows.withColumn("bucket", place(key, firsts, KEY))
    is_first = F.get(F.from_json(F.lit(json.dumps(firsts)), f"array<{KEY}>"), F.col("bucket") - 1).eqNullSafe(key)
    own = F.struct("bucket", F.lit(False).alias("guest"))
    guest = F.struct(F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(F.lit(max(1, len(firsts)))).alias("bucket"), F.lit(True).alias("guest"))
    dealt = at.withColumn("seat", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own)))).drop("bucket")
    dealt = dealt.repartition("seat.bucket").withColumns(made)
    near = Window.partitionBy("seat.bucket").orderBy("seat.guest", F.col("doc_id").asc_nulls_first(), "tie")
    return dealt.select("*", *[F.lead(c).over(near).alias(f"next_{c}") for c in columns]).filter(~F.col("seat.guest")).drop("seat", "tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text."""
    return docs.select("doc_id", as_text(fingerprint(text_of())).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form (last quarter from the next document's beginning)."""
    text = text_of()
    rows = docs.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("tie"))
    near = with_next(rows, ["text", "anchors"], {"anchors": fingerprint(F.col("text"))})
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    edited = edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "anchors", "next_anchors", fingerprint(F.col("edited")).alias("edited_anchors"))
    return edited.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
