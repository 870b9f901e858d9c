"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources get target sizes by weight (water-filling: no target exceeds ``max_repeat`` times its
source). Each source's documents are hashed into blocks of about ``BLOCK_ROWS`` documents, and
the mix takes whole passes over the source plus a prefix of its permuted blocks, so a source has
an exact quota of block takes. A tree over the output shards splits the vector of quotas: the
left half of a node's shards gets a multivariate-hypergeometric draw of the node's vector
(source by source, each a univariate draw by inversion), the right half the rest. At the
leaves, each shard takes the next disjoint run of every source's block sequence, and shuffles
its rows locally.

Everything is DataFrame expressions. What grows with documents is one grouped count a block;
the tree holds one row a shard and one number a source. The block that a source's target ends
in is cut by document: in hashed order, every document that still fits is taken, and the
smallest left out as well if that brings the sum nearer; of ``TRIES`` hashed orders the nearest
counts.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a
source without words has target 0 and gives nothing; null ids take part like any other (order is
hashed from id, source and text); rows that repeat all three are taken or left together, so a
target that ends among them may be missed by their words; a very long text is one document; other columns are not read by
``draws``; an empty table gives an empty mix. Reruns agree, as every choice is a hash of the
seed and the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilark.llm.common import let, saved, small, words

#: documents a block, on average
BLOCK_ROWS = 512
#: words an output shard, on average
SHARD_WORDS = 4_000_000
#: most block-plan rows that are broadcast; more are joined by shuffle
BROADCAST_BLOCKS = 500_000
#: partition keys a shard is dealt to
PIECES = 32
#: hashed orders that are tried to cut a block
TRIES = 16
WEIGHT_CYCLE = (1.0, 2.0, 3.0)


def order_of(id_col: str, source_col: str, text_col: str, seed: int) -> Column:
    """The hash that deals a document to its block."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit(seed), F.col(source_col), F.lit(seed), F.col(text_col))


def sizes_of(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size in words, and the two hashes that order a source's documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.size(words(F.col(text_col))).cast("long").alias("size"),
                       order_of(id_col, source_col, text_col, seed).alias("h"))
    return rows.withColumn("h2", F.xxhash64("h", F.lit(seed + 1)))


def targets(sources: DataFrame, weights: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """Water-filling in closed form: with sources in order of cap over weight, the first so many
    are capped and the rest share what is left by weight. ``sources``: source, source_size;
    ``weights``: source, weight. A window over the source table (one row a source)."""
    s = sources.alias("s").join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))).select(
        "s.source", "s.source_size", "w.weight", (F.lit(max_repeat) * F.col("s.source_size")).alias("cap"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({
        "all": F.sum("source_size").over(W.partitionBy()), "weights": F.sum("weight").over(W.partitionBy()),
        "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    level = (F.col("all") - F.col("spent")) / (F.col("weights") - F.col("gone"))
    s = s.withColumn("free", level * F.col("weight") <= F.col("cap"))
    s = s.withColumn("free_at", F.when(F.col("free"), F.struct(F.row_number().over(order).alias("i"), level.alias("level"))))
    s = s.withColumn("level", F.min("free_at").over(W.partitionBy())["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", target.alias("target"))


def cycle_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, .. over the sources by code point, null last."""
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source", F.get(F.array(*map(F.lit, WEIGHT_CYCLE)), (n - 1) % len(WEIGHT_CYCLE)).alias("weight"))


def _log_factorial(n: Column) -> Column:
    """Stirling's series, with its argument moved up where it is small. ``n``: a bound value, as it
    is named many times."""
    down = sum((F.log(n + float(i)) for i in range(2, 9)), F.log(n + 1.0))
    return let(n + F.lit(8.0), lambda x: (
        (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x))) - down


def _hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``good`` + ``bad`` are good, by inversion of uniform ``u``: the
    smallest k within 12 deviations of the mean whose cumulated probability reaches u. Every value
    that is named more than once is bound by ``let``: written out, a draw is an expression of
    thousands of nodes, which the driver analyses and copies anew for each plan."""

    def bounds(a: Column) -> Column:
        g, b, n = a["g"], a["b"], a["n"]

        def around(mean: Column) -> Column:
            low, high = F.greatest(F.lit(0.0), n - b), F.least(n, g)
            return let(F.ceil(12 * F.sqrt(mean * (b / (g + b)) + 1)) + 1, lambda reach: F.struct(
                F.greatest(low, F.floor(mean) - reach).cast("long").alias("low"),
                F.least(high, F.floor(mean) + reach).cast("long").alias("high")))

        return let(n * g / (g + b), around)

    def first(a: Column, lk: Column) -> Column:
        g, b, n = a["g"], a["b"], a["n"]
        picks = [(g, lk), (b, n - lk), (g + b, n)]
        facts = F.transform(F.array(*(x for of, k in picks for x in (of, k, of - k))), _log_factorial)
        choose = lambda f, i: f[3 * i] - f[3 * i + 1] - f[3 * i + 2]
        return let(facts, lambda f: F.exp(choose(f, 0) + choose(f, 1) - choose(f, 2)))

    def drawn(a: Column, k: Column) -> Column:
        g, b, n = a["g"], a["b"], a["n"]
        start = F.struct(F.lit(0.0).alias("sum"), first(a, k["low"].cast("double")).alias("p"), k["low"].alias("k"),
                         F.lit(False).alias("done"))

        def step(s: Column, at: Column) -> Column:
            total = s["sum"] + s["p"]
            kd = at.cast("double")
            after = s["p"] * (g - kd) * (n - kd) / ((kd + 1.0) * (b - n + kd + 1.0))
            done = s["done"] | (total >= a["u"]) | (at >= k["high"])
            return F.struct(total.alias("sum"), F.when(done, s["p"]).otherwise(after).alias("p"),
                            F.when(s["done"], s["k"]).otherwise(at).alias("k"), done.alias("done"))

        return F.aggregate(F.sequence(k["low"], k["high"]), start, step, lambda s: s["k"])

    def inverted(x: Column) -> Column:
        a = F.struct(*(x[c].cast("double").alias(c) for c in ("g", "b", "n")), x["u"].alias("u"))
        found = let(a, lambda a: let(bounds(a), lambda k: drawn(a, k)))
        return F.when(x["n"] <= 0, F.lit(0).cast("long")).when(x["b"] <= 0, x["n"]).when(
            x["g"] <= 0, F.lit(0).cast("long")).otherwise(found)

    return let(F.struct(good.alias("g"), bad.alias("b"), draws.alias("n"), u.alias("u")), inverted)


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``quotas``: one row, ``k`` = array of quotas by source. Returns shard, k: an array that
    sums over the shards to the root's. A node's left child draws its share without replacement."""
    nodes = quotas.select(F.lit(0).alias("first"), F.lit(shards).alias("width"), "k")
    depth = 0
    while shards > 1:
        half = F.floor(F.col("width") / 2).cast("int")

        def left(k: Column, first: Column, width: Column, half: Column = half) -> Column:
            total = F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x)
            begin = F.struct(total.alias("left"), F.floor(total * half / width).cast("long").alias("draws"),
                             F.array().cast("array<bigint>").alias("out"))

            def take(s: Column, x: Column) -> Column:
                u = (F.xxhash64(F.lit(seed), first, width, F.size(s["out"])) / F.lit(2.0 ** 64)) + 0.5
                got = _hypergeometric(x, s["left"] - x, s["draws"], u)
                return let(got, lambda d: F.struct((s["left"] - x).alias("left"), (s["draws"] - d).alias("draws"),
                                                   F.concat(s["out"], F.array(d)).alias("out")))

            return F.aggregate(k, begin, take, lambda s: s["out"])

        drawn = F.when(F.col("width") > 1, left(F.col("k"), F.col("first"), F.col("width"))).otherwise(F.col("k"))
        nodes = nodes.withColumn("l", drawn)
        rest = F.zip_with("k", "l", lambda a, b: a - b)
        kids = F.when(F.col("width") > 1, F.array(
            F.struct(F.col("first"), half.alias("width"), F.col("l").alias("k")),
            F.struct((F.col("first") + half).alias("first"), (F.col("width") - half).alias("width"), rest.alias("k")),
        )).otherwise(F.array(F.struct("first", "width", "k")))
        nodes, depth, shards = nodes.select(F.explode(kids).alias("x")).select("x.first", "x.width", "x.k"), depth + 1, (shards + 1) // 2
        if depth % 5 == 0 and shards > 1:  # nodes by now are many: spread the rest of the tree
            nodes = saved(nodes.repartition("first"))
    return nodes.select(F.col("first").alias("shard"), "k")


def fitting(entries: Column, need: Column) -> Column:
    """The h2 of the entries (h2, words) that are taken to come near ``need`` words."""
    none = F.lit(None).cast("struct<words:bigint,h2:bigint>")
    begin = F.struct(need.cast("double").alias("left"), F.array().cast("array<bigint>").alias("out"), none.alias("least"))

    def step(s: Column, x: Column) -> Column:
        fits = x["words"] <= s["left"]
        this = F.struct(x["words"].alias("words"), x["h2"].alias("h2"))
        return F.struct(F.when(fits, s["left"] - x["words"]).otherwise(s["left"]).alias("left"),
                        F.when(fits, F.array_append(s["out"], x["h2"])).otherwise(s["out"]).alias("out"),
                        F.when(fits, s["least"]).otherwise(F.least(s["least"], this)).alias("least"))

    def finish(s: Column) -> Column:
        more = s["least"]["words"] - s["left"]
        nearer = F.coalesce(more < s["left"], F.lit(False))
        return F.struct(F.when(nearer, more).otherwise(s["left"]).alias("miss"),
                        F.when(nearer, F.array_append(s["out"], s["least"]["h2"])).otherwise(s["out"]).alias("out"))

    def attempt(t: Column) -> Column:
        order = F.array_sort(F.transform(entries, lambda x: F.struct(
            F.xxhash64(x["h2"], t).alias("o"), x["h2"].alias("h2"), x["words"].alias("words"))))
        return F.aggregate(order, begin, step, finish)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), attempt))["out"]


def draws(docs: DataFrame, weights: DataFrame | None = None, max_repeat: float = 3.0, seed: int = 7,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row a document: doc_id, source, size, h, h2, block; the block plan; the number of
    blocks by source). The plan has a
    row a source and block: source_size, target, ``takes`` (array of pass and shard) and
    ``cut``: the last take holds only the documents whose h2 it lists (null: all of them)."""
    rows = sizes_of(docs, seed, id_col, text_col, source_col)
    stats = saved(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    goal = saved(targets(stats, weights if weights is not None else cycle_weights(stats), max_repeat))
    blocks_of = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1))
    per = small(saved(stats.select(F.col("source").alias("s"), blocks_of.cast("long").alias("blocks"))), BROADCAST_BLOCKS)
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "h", "h2", F.pmod("h", "blocks").alias("block"))
    rows = saved(rows)
    # whole passes, then blocks in order until the rest of the target is reached
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    goal = small(goal, BROADCAST_BLOCKS)
    by_block = W.partitionBy("source").orderBy("block")
    goal = goal.withColumnRenamed("source", "g_source")
    plan = sums.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).select(
        "source", "block", "words", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).alias("passes"),
        F.sum("words").over(by_block).alias("upto"), F.row_number().over(by_block).alias("i"),
        F.count("*").over(W.partitionBy("source")).alias("blocks"))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    before = F.col("upto") - F.col("words")
    part = (F.col("rest") > before) & (F.col("rest") < F.col("upto"))
    plan = saved(plan.withColumns({
        "part": part, "need": F.col("rest") - before,
        "n_takes": F.col("passes") + ((F.col("rest") > before) & (F.col("words") > 0)).cast("long")}))
    ends = small(plan.filter("part").select(F.col("source").alias("s"), F.col("block").alias("b"), "need"), BROADCAST_BLOCKS)
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    # one entry a distinct document of the block, about BLOCK_ROWS of them
    inside = inside.groupBy("source", "h2").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    entries = inside.groupBy(F.col("source").alias("c_source")).agg(
        F.sort_array(F.collect_list(F.struct("h2", "words"))).alias("entries"), F.first("need").alias("need"))
    cuts = entries.select("c_source", fitting(F.col("entries"), F.col("need")).alias("cut"))
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").withColumn(
        "cut", F.when(F.col("part"), F.coalesce(F.col("cut"), F.array().cast("array<bigint>"))))

    quota = plan.groupBy("source").agg(F.sum("n_takes").alias("k"), F.max("target").alias("t"))
    root = quota.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("z"), "source", "k"))).alias("q"),
                     F.sum("t").alias("words"))
    root = saved(root)
    total = root.first()["words"] or 0
    shards = max(1, round(total / SHARD_WORDS))
    leaves = split_tree(root.select(F.transform("q", lambda x: x["k"]).alias("k")), shards, seed)
    runs = leaves.select("shard", F.posexplode("k").alias("at", "k")).filter("k > 0").withColumn(
        "begin", F.sum("k").over(W.partitionBy("at").orderBy("shard")) - F.col("k"))
    names = root.select(F.posexplode("q").alias("at", "x")).select("at", F.col("x.source").alias("r_source"))
    places = runs.join(names, "at").select(
        "r_source", "shard", F.explode(F.sequence("begin", F.col("begin") + F.col("k") - 1)).alias("place"))
    # a source's block sequence: pass 0 in block order, pass 1, ..; only the last is partial
    seq = plan.filter("n_takes > 0").select("source", "block", "i", "blocks", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("n_takes") - 1)).alias("pass"))
    seq = seq.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy("pass", "i")).cast("long") - 1)
    taken = seq.alias("a").join(places.alias("p"), F.col("a.source").eqNullSafe(F.col("p.r_source"))
                                & (F.col("a.place") == F.col("p.place"))).groupBy(F.col("a.source").alias("t_source"), F.col("a.block").alias("t_block")).agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("takes"))
    plan = plan.join(taken, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("block") == F.col("t_block")), "left")
    none = F.array().cast("array<struct<pass:bigint,shard:int>>")
    plan = saved(plan.select("source", "block", "source_size", "target", "passes", "cut",
                             F.coalesce("takes", none).alias("takes")))
    return rows, plan, per


def with_draws(rows: DataFrame, plan: DataFrame, source: str = "source", block: str = "block",
               h2: str = "h2") -> DataFrame:
    """``rows`` joined to the plan by source and block, with the array ``draws`` of (pass, shard)."""
    p = small(plan, BROADCAST_BLOCKS).select(
        F.col("source").alias("__m_ps"), F.col("block").alias("__m_pb"), F.col("source_size").alias("__m_source_size"),
        F.col("target").alias("__m_target"), F.col("passes").alias("__m_passes"), F.col("cut").alias("__m_cut"),
        F.col("takes").alias("__m_takes"))
    out = F.col("__m_cut").isNotNull() & ~F.array_contains("__m_cut", F.col(h2))
    mine = F.when(out, F.filter("__m_takes", lambda t: t["pass"] < F.col("__m_passes"))).otherwise(F.col("__m_takes"))
    on = F.col(source).eqNullSafe(F.col("__m_ps")) & (F.col(block) == F.col("__m_pb"))
    return rows.join(p, on).withColumn("__m_draws", mine)


def mixture_report(docs: DataFrame, **opts) -> DataFrame:
    """One row a document: size, its source's size and target, words taken, and the shards."""
    rows, plan, _ = draws(docs, **opts)
    d = with_draws(rows, plan)
    return d.select("doc_id", "size", F.col("__m_source_size").alias("source_size"), F.col("__m_target").alias("target"),
                    (F.col("size") * F.size("__m_draws")).alias("taken"),
                    F.transform("__m_draws", lambda x: x["shard"]).alias("shards"))


def mixture(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source", **opts) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn, columns unchanged. A
    shard's rows lie in ``PIECES`` partition keys and are shuffled within each."""
    _, plan, per = draws(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **opts)
    h = order_of(id_col, source_col, text_col, seed)
    d = docs.withColumns({"__m_source": F.col(source_col), "__m_h": h, "__m_h2": F.xxhash64(h, F.lit(seed + 1))})
    d = d.join(per.select(F.col("s").alias("__m_s"), F.col("blocks").alias("__m_blocks")),
               F.col("__m_source").eqNullSafe(F.col("__m_s")))
    d = with_draws(d.withColumn("__m_block", F.pmod("__m_h", "__m_blocks")), plan, "__m_source", "__m_block", "__m_h2")
    d = d.withColumn("__m_draw", F.explode("__m_draws")).withColumn(
        "__m_order", F.xxhash64("__m_h2", F.col("__m_draw.pass"), F.lit(seed + 2)))
    d = d.repartition(F.col("__m_draw.shard"), F.pmod("__m_order", F.lit(PIECES)))
    return d.sortWithinPartitions("__m_draw.shard", "__m_order").select(*(F.col(f"`{c}`") for c in docs.columns))
