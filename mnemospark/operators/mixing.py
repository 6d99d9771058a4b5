"""Dataset mixing and sampling: interleaves, caps for each cluster, hard negatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import seeded_hash
from mnemospark.operators.joins import join_by_size
from mnemospark.operators.segmented import prefix
from mnemospark.session import written


def concatenate(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts with a subset column; missing columns become null."""
    tagged = [df.withColumn("subset", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def round_robin(df: DataFrame, source: str, order: list[str], stop: str = "all_exhausted") -> DataFrame:
    """Adds turn (place in its source) and seat (source number): sorted by both, sources alternate.

    first_exhausted: whole turns of the shortest source only. all_exhausted: every row once; sources that end drop out.
    ``interleave`` draws with repetition instead.
    """
    sizes = written(df.groupBy(source).agg(F.count(F.lit(1)).alias("_n")), "sources")
    seats = prefix(sizes, [], [source], position="_seat").select(source, F.col("_seat").cast("int").alias("seat"), "_n")
    out = join_by_size(prefix(df, [source], order, position="turn"), seats, [source], "_n")
    return out.filter(F.col("turn") < F.lit(sizes.agg(F.min("_n")).first()[0])) if stop == "first_exhausted" else out


def weighted_interleave(df: DataFrame, source: str, order: list[str], weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """Adds position_key: a source of weight w has rows at (turn + 1) / w, so a sort by it mixes by weight.

    Sources without a weight, null among them, have the default one.
    """
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    x = prefix(df, [source], order, position="_turn")
    return x.withColumn("position_key", (F.col("_turn") + 1) / F.coalesce(F.try_element_at(w, F.col(source)), F.lit(default))).drop("_turn")


def drawn_seat(position: Column, weights: list[float], seed: int, batch: int = 1) -> Column:
    """The source that a place is drawn from: a seeded categorical draw, one for each batch of places.

    The draw is the first 32 bits of the MD5 of ``seed:draw`` as a share of 2^32, so any engine can replay it.
    """
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.floor(position / batch).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    drawable = [i for i, w in enumerate(weights) if w > 0]
    seat = F.lit(drawable[-1])
    for i in reversed(drawable[:-1]):
        seat = F.when(share < F.lit(sum(weights[: i + 1]) / sum(weights)), F.lit(i)).otherwise(seat)
    return seat.cast("int")


def interleave(df: DataFrame, source: str, order: list[str], sources: list[str], weights: list[float] | None = None, stop: str = "first_exhausted", seed: int = 0, batch: int = 1) -> DataFrame:
    """One stream of several sources: adds position (place in the stream) and repeat (how often the row came before).

    Without weights the sources take turns; with them each place, or each batch of places, is drawn by weight (``drawn_seat``). A
    source that ends begins again. first_exhausted stops after the last row of the source that ends first, all_exhausted once every source has
    ended. A source without rows counts as ended when its turn first comes, and gives nothing.

    Draws are numbered by source with segmented prefix counts and meet the rows by (source, place), so neither a long source nor a
    short one that comes very often is one task's work. Only one row for each source reaches the driver.
    """
    if stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError(f"unknown stop rule {stop}")
    if weights is not None and (len(weights) != len(sources) or min(weights) < 0 or sum(weights) <= 0):
        raise ValueError("weights: one for each source, not negative, not all zero")
    if weights is not None and stop == "all_exhausted" and min(weights) == 0:
        raise ValueError("a source of weight 0 never ends")
    spark = df.sparkSession
    rows = written(prefix(df.filter(F.col(source).isin(sources)), [source], order, position="_turn"), "turns")
    sizes = {r[source]: r["n"] for r in rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one a source
    n = [sizes.get(s, 0) for s in sources]
    which = min if stop == "first_exhausted" else max
    if weights is None:
        length = which(i + max(0, size - 1) * len(sources) for i, size in enumerate(n)) + 1
        places = spark.range(length).select(F.col("id").alias("position"), (F.col("id") % len(sources)).cast("int").alias("_seat"), F.floor(F.col("id") / len(sources)).cast("long").alias("_nth"))
    else:
        total = sum(weights)
        reach = int(which(max(1, size) * total / w for size, w in zip(n, weights, strict=True) if w > 0) * 1.1) + 100 * batch
        while True:
            drawn = spark.range(reach).select(F.col("id").alias("position"), drawn_seat(F.col("id"), weights, seed, batch).alias("_seat"))
            places = written(prefix(drawn, ["_seat"], ["position"], position="_nth"), "draws")
            last = F.get(F.array(*[F.lit(max(1, size) - 1).cast("long") for size in n]), F.col("_seat"))
            ends = [r["position"] for r in places.filter(F.col("_nth") == last).select("position").collect()]  # one a source
            if ends and (stop == "first_exhausted" or len(ends) == len(sources)):
                break
            reach *= 2
        length = which(ends) + 1
        places = places.filter(F.col("position") < length)
    names, counts = F.array(*[F.lit(s) for s in sources]), F.array(*[F.lit(size).cast("long") for size in n])
    size = F.get(counts, F.col("_seat"))
    asked = places.filter(size > 0).select("position", F.get(names, F.col("_seat")).alias(source), (F.col("_nth") % size).alias("_turn"), F.floor(F.col("_nth") / size).cast("long").alias("repeat"))
    often = {s: -(-length // max(1, size)) for s, size in sizes.items()}  # a row of a short source may be most of the stream
    return join_by_size(asked, rows.withColumn("_often", F.element_at(F.create_map(*[F.lit(x) for kv in often.items() for x in kv]), F.col(source)).cast("long")), [source, "_turn"], "_often").drop("_turn") if often else asked.join(rows, [source, "_turn"]).drop("_turn")


def capped_by_cluster(df: DataFrame, cluster: str, key: str, cap: int, total: int, seed: int = 0) -> DataFrame:
    """At most cap rows of each cluster in a seeded order, then others in that order up to total rows (a sampling operator)."""
    h = seeded_hash(seed, F.col(key))
    ranked = prefix(df, [cluster], [h, key], position="_r").withColumn("_late", F.col("_r") >= cap)
    return ranked.orderBy("_late", h, key).limit(total).drop("_r", "_late")


def hard_negatives(negatives: Column, positive_score: Column, above: float | None = None, below: float | None = None, margin: float | None = None, ratio: float | None = None, ranks: tuple[int, int] | None = None) -> Column:
    """Filters array<struct<id, score>> in rank order: score bounds, margin and ratio to the positive, a slice of ranks."""
    tests = []
    if above is not None:
        tests.append(lambda n: n["score"] > above)
    if below is not None:
        tests.append(lambda n: n["score"] < below)
    if margin is not None:
        tests.append(lambda n: n["score"] < positive_score - margin)
    if ratio is not None:
        tests.append(lambda n: n["score"] < positive_score * ratio)
    picked = negatives if ranks is None else F.slice(negatives, ranks[0] + 1, ranks[1] - ranks[0])
    return reduce(F.filter, tests, picked)


def hard_negative_chain(
    rows: DataFrame,
    wanted: int,
    same_document: bool = False,
    positive_ranks: tuple[int, int] | None = None,
    positive_above: float | None = None,
    below: float | None = None,
    margin: float | None = None,
    ratio: float | None = None,
    ranks: tuple[int, int] | None = None,
) -> DataFrame:
    """Negatives of each query after all filters; queries left with fewer than 80 % of wanted go.

    rows: positive_id, positive_score, negatives and by_positive (array<struct<id, score>> in the rank order of the query and of its
    positive), earlier (the same, or null: what to use when no negative is left). In this order: negatives of the positive's document
    go (same_document; ids are ``document-part``), those in a range of the positive's ranks, and those that lead its ranking with a score above a
    limit; then the scores' bounds hold; then a slice of ranks is taken.
    """
    id_of = lambda x: x["id"]
    gone = F.array().cast("array<string>")
    if positive_ranks is not None:
        gone = F.concat(gone, F.transform(F.slice("by_positive", positive_ranks[0] + 1, positive_ranks[1] - positive_ranks[0]), id_of))
    if positive_above is not None:
        first_low = F.array_position(F.transform("by_positive", lambda x: ~(x["score"] > positive_above)), True)
        lead = F.when(first_low == 0, F.size("by_positive")).otherwise(first_low - 1).cast("int")
        gone = F.concat(gone, F.transform(F.slice("by_positive", F.lit(1), lead), id_of))
    left = rows.withColumn("_gone", gone)
    kept = F.filter("negatives", lambda n: ~F.array_contains("_gone", n["id"]))
    if same_document:
        document = F.regexp_replace("positive_id", "-[^-]*$", "")
        kept = F.filter(kept, lambda n: ~F.startswith(n["id"], document))
    kept = hard_negatives(kept, F.col("positive_score"), below=below, margin=margin, ratio=ratio)
    left = left.withColumn("_kept", kept).withColumn("_kept", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.coalesce("earlier", F.col("_kept"))))
    if ranks is not None:
        left = left.withColumn("_kept", F.slice("_kept", ranks[0] + 1, ranks[1] - ranks[0]))
    enough = left.filter((F.size("_kept") > 0) & (F.size("_kept") >= 0.8 * wanted))
    return enough.withColumn("negatives", F.col("_kept")).drop("_kept", "_gone")


def other_label_pools(df: DataFrame, label: str, key: str, per_label: int, seed: int = 0) -> DataFrame:
    """(label, pool): up to per_label seeded rows of every other label as negatives; per_label bounds the pools (sampling)."""
    w = Window.partitionBy(label).orderBy(seeded_hash(seed, F.col(key)), key)
    few = df.select(label, key).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_label)  # a limit of a rank: each task keeps per_label a label
    whole = few.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col(label).alias("label")))).alias("_all"))  # one row: per_label keys a label
    others = F.filter("_all", lambda e: ~e["label"].eqNullSafe(F.col(label)))
    return few.select(label).distinct().join(F.broadcast(whole)).select(label, F.transform(others, lambda e: e["key"]).alias("pool")).filter(F.size("pool") > 0)


def draw_share(seed: int, salt: Column, key: Column) -> Column:
    """A seeded draw from [0, 1): the first 32 bits of the MD5 of ``seed:salt:key``, so any engine can replay it."""
    return F.conv(F.substring(seeded_hash(seed, salt, key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def drawn_places(n: int, size: Column, seed: int, key: Column, salt: int = 0) -> Column:
    """array<long> of n places below size, one from each of n equal parts: none twice where size allows it; empty if size is 0."""
    if n < 1:
        return F.array().cast("array<long>")
    size = size.cast("long")
    border = lambda i: F.floor(i * size / F.lit(n))
    one = lambda i: (border(i) + F.floor(draw_share(seed, i + salt, key) * (border(i + 1) - border(i)))).cast("long")
    return F.when(size > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), one)).otherwise(F.array().cast("array<long>"))


def sampled(values: Column, n: int, seed: int, key: Column, salt: int = 0) -> Column:
    """n drawn elements of an array, none twice where it has as many; empty if it is."""
    return F.transform(drawn_places(n, F.coalesce(F.size(values), F.lit(0)), seed, key, salt), lambda i: F.get(values, i.cast("int")))


def label_contrasts(rows: DataFrame, label: str, text: str, order: list[str], n: int, seed: int = 0) -> DataFrame:
    """Adds same (a drawn text of the row's label), others (n drawn texts of other labels) and n_label (rows of the label).

    All rows of all labels are drawn from: rows are numbered by (label, order), a draw is a place among them (places of
    the own label are skipped), and drawn places meet their texts in one join. Until then only keys are sorted and joined; texts are
    written once, and shuffled once to that join and once from it, together with the row's own columns. No pool of texts is gathered for a label, so a label with
    most of the rows, or very many labels, cost no more than others; places that come often, because few rows have another label, are joined
    by size. others has none twice where there are n, repeats where there are fewer, and is empty where all rows have one label. Rows without a label go.
    """
    labelled = written(rows.filter(F.col(label).isNotNull()).withColumn("_id", F.monotonically_increasing_id()), "labelled")
    sizes = written(labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "labels")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    rest = F.lit(total) - F.col("_n")
    often = F.coalesce(F.try_divide(F.col("_n").cast("double"), rest.cast("double")), F.lit(0.0))
    every = sizes.agg(F.sum(often)).first()[0] or 0.0
    starts = prefix(sizes, [], [label], sums={"_upto": F.col("_n")}, position="_rank").select(label, "_n", F.col("_n").alias("n_label"), (F.col("_upto") - F.col("_n")).alias("_start"), F.ceil(2 + n * (F.lit(every) - often)).cast("long").alias("_often"))
    keys = labelled.select("_id", *dict.fromkeys([label, *order]))
    placed = join_by_size(prefix(keys, [label], order, position="_place"), starts, [label], "_n")
    base = written(placed.select("_id", "n_label", "_start", "_often", (F.col("_start") + F.col("_place")).alias("_at")), "places")
    same = F.col("_start") + F.floor(draw_share(seed, F.lit(0), F.col("_at")) * F.col("n_label"))
    places = drawn_places(n, F.lit(total) - F.col("n_label"), seed, F.col("_at"), salt=1)
    others = F.transform(places, lambda u: F.when(u < F.col("_start"), u).otherwise(u + F.col("n_label")))
    asks = base.select(F.col("_at").alias("_row"), F.posexplode(F.concat(F.array("_at", same.cast("long")), others)).alias("_slot", "_at"))
    found = written(join_by_size(asks, base.select("_at", "_id", "_often"), ["_at"], "_often").select("_row", "_slot", "_id"), "drawn")
    whole = labelled.join(base.select("_id", "_often", "n_label"), "_id")
    met = join_by_size(found, whole, ["_id"], "_often")
    own = F.when(F.col("_slot") == 0, F.struct(*rows.columns, "n_label"))
    drawn = F.when(F.col("_slot") > 0, F.struct("_slot", F.col(text).alias("_text")))
    got = met.select("_row", own.alias("_own"), drawn.alias("_drawn")).groupBy("_row").agg(F.first("_own", ignorenulls=True).alias("_own"), F.array_sort(F.collect_list("_drawn")).alias("_got"))  # n + 1 a row
    others = F.transform(F.slice("_got", 2, n), lambda g: g["_text"]) if n else F.array().cast("array<string>")
    return got.select(*[F.col("_own")[c].alias(c) for c in rows.columns], F.col("_got")[0]["_text"].alias("same"), others.alias("others"), F.col("_own")["n_label"].alias("n_label"))
