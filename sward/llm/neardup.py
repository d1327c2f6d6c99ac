"""Exact verification of banded candidates and connected components, on DataFrames.

Works on *classes*: distinct sets, named by the 16-byte digest of the set, so
exact copies cost one row however many there are.  A bucket is a group of
classes that share a band.  Within a
bucket no pairs are enumerated up front:

1. one class of a bucket is its hub and is compared with all its mates (linear);
2. confirmed links are merged into components; the classes of a bucket outside its
   hub's component get a second hub of their own (linear);
3. what is left are classes unlike the hub, in a large group of loose copies nearly
   all of them unlike each other too.  They are compared by what sets them apart
   from the hub: a similar pair must share one of the rarest differences
   (``_delta_candidates``), and only such pairs are tested on the full sets.

Two mates that both are like the hub are in its component; of any other similar pair
at least one is unlike the hub and found in step 3, so no link between components
is lost among bucket mates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sward.llm.common import Scratch

#: Differences that a pair must have in common in both prefixes: sets of few elements need one, as ``_sketch`` tells them apart.
PREFIX_MATCHES = 3
#: Longs of a sketch.
SKETCH_WORDS = 2


def control_files(spark) -> int:
    """Files (and last tasks) of the narrow link and label tables: they grow with the shuffle partitions."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)


def components(scratch: Scratch, edges: DataFrame, files: int = 8) -> DataFrame:
    """(node, comp) for every node of the edge list (u, v); comp = smallest node reachable.

    Alternating large-star / small-star rewriting; each half is a min-aggregate
    and an equi-join, so no node's neighbours meet in one row.  A NULL end or a
    self-loop names a node without linking it.
    """
    e = scratch.save(edges.where("u is not null and v is not null and u <> v")
                     .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc", files)
    mark = None
    while True:
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (sym.where("v > u").join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        nxt = scratch.save(small, "small", files)
        scratch.drop(e)
        e = nxt
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            break
        mark = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct())


def similar(threshold: float):
    """Exact test on full sets: 100 * |A and B| >= 100 * threshold * |A or B|."""
    pct = round(threshold * 100)
    inter = F.size(F.array_intersect("sa", "sb"))
    return inter * 100 >= (F.col("na") + F.col("nb") - inter) * pct


def _merge(scratch: Scratch, labels: DataFrame | None, links: DataFrame, files: int) -> DataFrame:
    """Labels (set_id, comp) after the links (a, b) between classes."""
    if labels is None:
        merged = components(scratch, links.select(F.col("a").alias("u"), F.col("b").alias("v")), files)
        return scratch.save(merged.select(F.col("node").alias("set_id"), "comp"), "labels", files)
    la = labels.select(F.col("set_id").alias("a"), F.col("comp").alias("ca"))
    lb = labels.select(F.col("set_id").alias("b"), F.col("comp").alias("cb"))
    edges = (links.join(la, "a", "left").join(lb, "b", "left")
             .select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v")))
    merged = components(scratch, edges, files)
    moved = merged.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    new = (labels.join(moved, "comp", "left")
           .select("set_id", F.coalesce("to", "comp").alias("comp"))
           .unionByName(merged.join(labels.select(F.col("comp").alias("node")), "node", "left_anti")
                        .select(F.col("node").alias("set_id"), "comp")))
    return scratch.save(new, "labels", files)


def _labelled(df: DataFrame, labels: DataFrame, of: str, name: str) -> DataFrame:
    """``df`` with the component of column ``of`` as ``name`` (a class without links is its own)."""
    mine = labels.select(F.col("set_id").alias(of), F.col("comp").alias("_c"))
    return df.join(mine, of, "left").withColumn(name, F.coalesce("_c", of)).drop("_c")


def _sketch(e: str, over: Window) -> list:
    """Odd sketch: of each of 64 * SKETCH_WORDS places whether an odd number of the elements falls on it.

    Two sketches differ in at most as many places as their sets do in elements.
    """
    place = f"pmod({e}, {64 * SKETCH_WORDS})"
    return [F.bit_xor(F.expr(f"if({place} div 64 = {w}, shiftleft(1L, int({place} % 64)), 0L)")).over(over).alias(f"o{w}")
            for w in range(SKETCH_WORDS)]


def _delta_candidates(scratch: Scratch, met: DataFrame, labels: DataFrame, pct: int, matches: int = PREFIX_MATCHES) -> DataFrame:
    """Pairs (a, b) in different components that may be similar, out of the classes met by one hub.

    met: (hub, set_id, n, hn, delta), delta = symmetric difference of the class and the hub.

    Similar x and y have deltas that overlap in at least o = (|delta x| + |delta y| -
    (n x + n y) * (100 - pct) / (100 + pct)) / 2 elements, and 2 o > |delta y| - (n y - n hub) *
    (100 - pct) / (100 + pct) where x is unlike the hub.  Ordered from the rarest of the hub's
    classes on, the first |delta| - o + m elements of both deltas then have at least m in
    common (m = ``matches``, or o if less).  Each prefix is mostly the class's own.

    The deltas differ from each other as x and y do, in at most (n x + n y) * (100 - pct) / (100 + pct)
    elements.  Of these are all that no other class has and as many of the rest as the sketches differ in
    at least, so most pairs that meet without being similar are left out by the join itself.
    """
    met = _labelled(_labelled(met, labels, "hub", "hc"), labels, "set_id", "c")
    met = scratch.save(met, "met-labelled")
    rows = met.withColumn("dn", F.size("delta")).withColumn("e", F.explode("delta")).drop("delta")
    shared = (rows.groupBy("hub", "e").agg(F.count("*").alias("f"), F.max(F.col("c") != F.col("hc")).alias("probed"))
              .where("f > 1 and probed").drop("probed"))
    shared = scratch.save(shared, "delta-shared")
    # an element left out can meet nothing; it counts as one of the rarest, in every class of the hub
    of_class = Window.partitionBy("hub", "set_id")
    own = (F.col("dn") - F.count("*").over(of_class)).alias("own")
    order = F.row_number().over(of_class.orderBy("f", "e"))
    words = [f"o{w}" for w in range(SKETCH_WORDS)]
    ranked = (rows.join(shared, ["hub", "e"]).select("*", own, order.alias("r"), *_sketch("e", of_class))
              .withColumn("r", F.col("own") + F.col("r")))
    # no x needs more of y than this, and no y more of x
    need = F.floor((F.col("dn") * (100 + pct) - (F.col("n") - F.col("hn")) * (100 - pct)) / (2 * (100 + pct))) + 1
    post = F.col("r") <= F.col("dn") - need + matches
    least = F.ceil((F.col("dn") * (100 + pct) - (F.col("n") + F.col("hn")) * (100 - pct)) / (2 * (100 + pct)))
    lead = (F.col("c") != F.col("hc")) & (F.col("r") <= F.col("dn") - F.greatest(F.lit(1), least) + matches)
    ranked = ranked.select("hub", "e", "set_id", "n", "c", "dn", "own", "r", *words, (F.col("c") != F.col("hc")).alias("probe"),
                           lead.alias("lead"), post.alias("post"))
    ranked = scratch.save(ranked.where("lead or post"), "delta")

    def side(flag: str, s: str) -> DataFrame:
        return ranked.where(flag).select(
            "hub", "e", *[F.col(k).alias(s + k) for k in ("set_id", "n", "c", "dn", "own", "r", "probe", *words)])

    x, y = side("lead", "x"), side("post", "y")
    both, size = F.col("xdn") + F.col("ydn"), F.col("xn") + F.col("yn")
    o = F.greatest(F.lit(1), F.ceil((both * (100 + pct) - size * (100 - pct)) / (2 * (100 + pct))))
    m = F.least(F.lit(matches), o)
    apart = F.col("xown") + F.col("yown")
    for w in words:
        apart = apart + F.bit_count(F.col("x" + w).bitwiseXOR(F.col("y" + w)))
    # two probes meet once, not in both orders
    meet = ((x["hub"] == y["hub"]) & (x["e"] == y["e"]) & (F.col("xc") != F.col("yc"))
            & (~F.col("yprobe") | (F.col("xset_id") < F.col("yset_id")))
            & (apart * (100 + pct) <= size * (100 - pct))
            & (F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * pct)
            & (F.col("xr") <= F.col("xdn") - o + m) & (F.col("yr") <= F.col("ydn") - o + m))
    return (x.drop("xprobe").join(y, meet).groupBy(x["hub"], "xset_id", "yset_id").agg(F.count("*").alias("k"), F.first(m).alias("m"))
            .where("k >= m").select(F.least("xset_id", "yset_id").alias("a"), F.greatest("xset_id", "yset_id").alias("b"))
            .distinct())


def link(scratch: Scratch, buckets: DataFrame, sets: DataFrame, threshold: float, files: int | None = None,
         matches: int = PREFIX_MATCHES) -> DataFrame:
    """Components of classes under ``similar`` among bucket mates.

    buckets: (key, set_id), only keys with at least two classes;
    sets: (set_id, n, s) for every class in a bucket; ``matches``: see ``_delta_candidates``, for the time only.
    Returns (set_id, comp) for classes that are linked to another one.
    """
    pct = round(threshold * 100)
    files = files or control_files(scratch.spark)
    weight = buckets.groupBy("set_id").agg(F.count("*").alias("w"))
    weighted = buckets.join(weight, "set_id")
    # the hub of a bucket: the member found in most buckets, ties to the larger digest
    best = F.max_by("set_id", F.struct("w", "set_id"))
    first = weighted.groupBy("key").agg(best.alias("hub"))
    state = scratch.save(weighted.join(first, "key"), "buckets")
    hub = sets.select(F.col("set_id").alias("hub"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    met = state.where("hub <> set_id").select("hub", "set_id").distinct().join(sets, "set_id").join(hub, "hub")
    inter = F.size(F.array_intersect("s", "hs"))
    met = scratch.save(met.select("hub", "set_id", "n", "hn",
                                  (inter * 100 >= (F.col("n") + F.col("hn") - inter) * pct).alias("like"),
                                  F.concat(F.array_except("s", "hs"), F.array_except("hs", "s")).alias("delta")), "met")
    labels = _merge(scratch, None, met.where("like").select(F.col("hub").alias("a"), F.col("set_id").alias("b")), files)

    a = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    b = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return scratch.save(pairs.join(a, "a").join(b, "b").where(similar(threshold)).select("a", "b"), "links")

    # a second hub for the classes of a bucket that are not yet with the first one
    rest = _labelled(_labelled(state, labels, "hub", "hc"), labels, "set_id", "c").where("c <> hc").drop("hub", "hc")
    rest = scratch.save(rest, "rest")
    second = rest.groupBy("key").agg(F.max_by(F.struct("set_id", "c"), F.struct("w", "set_id")).alias("h"))
    pairs = rest.join(second, "key").where("c <> h.c").select(
        F.least("set_id", "h.set_id").alias("a"), F.greatest("set_id", "h.set_id").alias("b")).distinct()
    links = confirmed(pairs)
    if not links.isEmpty():
        labels = _merge(scratch, labels, links, files)
    scratch.drop(state, rest)

    links = confirmed(_delta_candidates(scratch, met.drop("like"), labels, pct, matches))
    if not links.isEmpty():
        labels = _merge(scratch, labels, links, files)
    return labels


def shared_buckets(scratch: Scratch, classes: DataFrame) -> DataFrame:
    """(key, set_id) of every band key that at least two classes hold.  classes: (set_id, bands)."""
    rows = classes.select("set_id", F.explode("bands").alias("key"))
    often = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return scratch.save(rows.join(often, "key").select("key", "set_id"), "shared")
