"""Products bought together.

Counting pairs is quadratic in the size of a basket.  Small baskets are enumerated, which is linear
in the data because their size is bounded.  Large ones never are: the exact top k is reached through
bounds instead.  With ``light(a, b)`` the number of small baskets holding both products, ``heavy(a,
b)`` the number of large ones, and ``h(p)`` the number of large baskets holding ``p``:

* ``heavy(a, b) <= min(h(a), h(b))``, and the k-th largest ``light`` count, the *floor*, is a lower
  bound of the k-th largest total.
* A pair found in a small basket can reach the top k only if ``light + min(h(a), h(b)) >= floor``.
* A pair found in large baskets only needs ``h >= floor`` on both sides.  Products that lie in exactly
  the same large baskets (by two 64-bit marks) are interchangeable apart from their ids, and ties are won by smaller ids,
  so the ``k + 1`` smallest ids of each such class suffice: any other pair is beaten by k pairs that
  count at least as much.  Only the remaining products, the chosen ones, are paired, which gives ``heavy`` for all of
  their pairs.

Large baskets are numbered, and the baskets of a product make a bitmap, in words of 64 baskets.  ``heavy`` of a pair
of the first kind whose products are not both chosen is the number of bits that the two bitmaps share.  Chosen products
are paired within a basket if it is of moderate size; in the others either within a basket or, where that makes fewer
pairs, within a word, whose shared bits then count as many baskets at once.  Both are done in blocks.

So one basket with a third of all lines costs a few passes over its lines, and no result is lost.
Tasks that form pairs, or add them up, are as many as the pairs ask for, so none holds more the larger the data is.
Before any of this, large data sets drop the products that are sold too rarely to matter, by the same
kind of bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import MOST_PARTITIONS, fine_stages, tasks_for
from ..sources.scratch import stored
from .lookup import BROADCAST_ROWS, only

SMALL_BASKET = 200
PRUNE_FROM_LINES = 50_000_000  # below, leaving out rare products costs more than it saves
PROBES = SMALL_BASKET  # products paired first; a basket then costs no more than a small one
FREQUENT_ROWS = 1_000_000


def _pairs_of_small(baskets: DataFrame) -> DataFrame:
    """``a, b`` for every pair within a sorted array ``products`` of bounded size."""
    firsts = baskets.where(F.size("products") > 1).select(
        "products", F.explode(F.sequence(F.lit(1), F.size("products") - 1)).alias("i")
    )
    return firsts.select(
        F.element_at("products", F.col("i")).alias("a"),
        F.explode(F.slice("products", F.col("i") + 1, F.size("products"))).alias("b"),
    )


def _dealt(lines: DataFrame, key: str, pairs: int) -> DataFrame:
    """The lines dealt out by basket, so that a task forms about as many pairs as it may hold; few are left alone.

    Adaptive execution would merge partitions by what they read, which says nothing of the pairs within.
    """
    tasks = min(tasks_for(pairs), MOST_PARTITIONS)
    if tasks <= 1:
        return lines
    return lines.repartition(max(tasks, lines.sparkSession.sparkContext.defaultParallelism), key)


def _small_and_large(
    lines: DataFrame, sizes: DataFrame, small: int, total: int, large: int
) -> tuple[DataFrame, DataFrame]:
    """The lines of small baskets, and the distinct products of the ``large`` larger ones with number and size.

    Large baskets are told apart by broadcasting their ids while there are at most BROADCAST_ROWS.
    Beyond that only the hugest are: fewer than BROADCAST_ROWS baskets can hold more than
    1 / BROADCAST_ROWS of all lines each.  What the join by transaction then shuffles has no hot key.
    """
    limit = small if large <= BROADCAST_ROWS else max(small, total // BROADCAST_ROWS)
    huge = F.broadcast(sizes.where(F.col("n") > limit))
    rest = lines.join(F.broadcast(huge.select("transaction_id")), "transaction_id", "left_anti")
    members = lines.join(huge, "transaction_id")
    if large > BROADCAST_ROWS:
        middling = sizes.where(F.col("n").between(small + 1, limit))
        members = members.unionByName(rest.join(middling, "transaction_id"))
        rest = rest.join(middling, "transaction_id", "left_anti")
    return rest, members.select("number", "n", "product_id").na.drop().distinct()


def _pairs_in_blocks(units: DataFrame, block: int) -> DataFrame:
    """``a, b, n`` for every pair of products within a ``unit`` that share bits, however many it has.

    The first side of the self join is split by product into blocks and the second repeated for each
    of them, so a task meets about ``block`` products of one unit at a time.
    """
    blocks = units.groupBy("unit").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sized = units.join(blocks, "unit")
    left = sized.select(
        "unit",
        F.pmod(F.xxhash64("product_id"), F.col("blocks")).cast("int").alias("block"),
        F.col("product_id").alias("a"),
        F.col("bits").alias("bits_a"),
    )
    right = sized.select(
        "unit",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.col("product_id").alias("b"),
        F.col("bits").alias("bits_b"),
    )
    shared = F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b"))).cast("bigint")
    pairs = left.join(right, ["unit", "block"]).where("a < b").select("a", "b", shared.alias("n"))
    return pairs.where("n > 0")


def _word() -> Column:
    return F.shiftright("number", 6).alias("word")


def _bitmaps(members: DataFrame) -> DataFrame:
    """``product_id, word, bits``: a bit for each large basket that holds the product, 64 to a word."""
    bit = F.expr("shiftleft(1L, cast(number & 63L as int))")
    return members.groupBy("product_id", _word()).agg(F.bit_or(bit).alias("bits"))


def _pairs_of_large(picked: DataFrame, moderate: int, largest: int) -> DataFrame:
    """``a, b, n`` for the products in large baskets, to be added up by pair.

    Baskets of up to ``moderate`` lines are enumerated.  The others go by words of 64 baskets or one by one,
    whichever pairs fewer products.
    """
    # A basket of n lines holds at most (n - 1) / 2 pairs for each of them.
    few = F.col("n") <= moderate
    most = picked.where(few).agg(F.expr("coalesce(sum(n - 1), 0L) as most")).first()["most"] // 2
    listed = _dealt(picked.where(few), "number", most).groupBy("number")
    enumerated = _pairs_of_small(listed.agg(F.array_sort(F.collect_list("product_id")).alias("products")))
    enumerated = enumerated.select("a", "b", F.lit(1).cast("bigint").alias("n"))
    if largest <= moderate:
        return enumerated
    many = picked.where(F.col("n") > moderate)
    bitmaps = _bitmaps(many)
    held = many.groupBy("number").agg(F.count("*").alias("held")).groupBy(_word())
    one_by_one = held.agg(F.sum(F.col("held") * F.col("held")).alias("one_by_one"))
    together = bitmaps.groupBy("word").agg((F.count("*") * F.count("*")).alias("together"))
    dense = together.join(one_by_one, "word").where("together < one_by_one").select("word")
    # Words and baskets are numbered apart.
    words = bitmaps.join(dense, "word", "left_semi").select((-1 - F.col("word")).alias("unit"), "product_id", "bits")
    singles = (
        many.select("number", _word(), "product_id")
        .join(dense, "word", "left_anti")
        .select(F.col("number").alias("unit"), "product_id", F.lit(1).cast("bigint").alias("bits"))
    )
    paired = _pairs_in_blocks(words.unionByName(singles), moderate)
    return enumerated.unionByName(paired)


def _shared_baskets(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``a, b, n``: how many large baskets hold both products of the given pairs, from their bitmaps."""
    # Start from the rarer product of each pair: fewer words to look the other one up in.
    from_a = F.col("h_a") <= F.col("h_b")
    probes = pairs.select(
        "a",
        "b",
        F.when(from_a, F.col("a")).otherwise(F.col("b")).alias("product_id"),
        F.when(from_a, F.col("b")).otherwise(F.col("a")).alias("other"),
    )
    bitmaps = _bitmaps(members)
    others = bitmaps.select(F.col("product_id").alias("other"), "word", F.col("bits").alias("other_bits"))
    shared = F.bit_count(F.col("bits").bitwiseAND(F.col("other_bits"))).cast("bigint")
    met = probes.join(bitmaps, "product_id").join(others, ["other", "word"])
    return met.select("a", "b", shared.alias("n"))


def _ranking(count: str) -> list[Column]:
    return [F.col(count).desc(), F.col("a"), F.col("b")]


def _light_counts(lines: DataFrame, pairs: int = 0) -> DataFrame:
    """``a, b, light`` over baskets of bounded size, which hold at most ``pairs`` pairs if that is known."""
    baskets = _dealt(lines, "transaction_id", pairs).groupBy("transaction_id").agg(
        F.array_sort(F.collect_set("product_id")).alias("products")
    )
    return _pairs_of_small(baskets).groupBy("a", "b").agg(F.count("*").alias("light"))


def _without_rare(lines: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Drop lines of products too rare for the top k, if that leaves few enough products.

    Pairs among the best selling products are counted first.  Their k-th largest count is one the
    winners must reach, and no pair is found more often than its rarer product.  That count is
    returned as well.  The products that remain are counted before they are broadcast; with more than
    FREQUENT_ROWS all lines stay.
    """
    sold = lines.groupBy("product_id").agg(F.count("*").alias("n"))
    support = stored(sold, "product-support")
    probes = support.orderBy(F.col("n").desc(), "product_id").limit(PROBES).select("product_id")
    # A basket holds at most PROBES of these products, whatever its size.
    probed = _light_counts(lines.join(F.broadcast(probes), "product_id", "left_semi"))
    kth = probed.orderBy(F.col("light").desc()).limit(k).agg(F.count("*"), F.min("light")).first()
    if kth[0] < k:
        return lines, 1
    frequent = support.where(F.col("n") >= kth[1]).select("product_id")
    if frequent.count() > FREQUENT_ROWS:
        return lines, kth[1]
    return lines.join(F.broadcast(frequent), "product_id", "left_semi"), kth[1]


def _shape(lines: DataFrame, small: int) -> tuple[DataFrame, int, int, int, int, int]:
    """Lines and number of each large transaction, stored; and some numbers on the driver.

    These are all lines, how many transactions are large, the largest, and the pairs of lines within small
    transactions and within large ones of up to SMALL_BASKET lines.

    One pass gives all three.  Lines without a product may be counted in: the sizes are upper bounds.
    """
    ids = lines.select("transaction_id").na.drop()
    sizes = ids.groupBy("transaction_id").agg(F.count("*").alias("n"))
    shape = Observation()
    measured = sizes.observe(
        shape,
        F.expr("coalesce(sum(n), 0L) as total"),
        F.expr(f"count_if(n > {small}) as large"),
        F.expr("coalesce(max(n), 0L) as largest"),
        F.expr(f"coalesce(sum(if(n <= {small}, n * (n - 1) div 2, 0L)), 0L) as pairs"),
        F.expr(f"coalesce(sum(if(n > {small} and n <= {SMALL_BASKET}, n * (n - 1) div 2, 0L)), 0L) as more"),
    )
    numbered = measured.where(F.col("n") > small).withColumn("number", F.monotonically_increasing_id())
    large_sizes = stored(numbered, "basket-sizes")
    found = shape.get
    return large_sizes, *(found[name] for name in ("total", "large", "largest", "pairs", "more"))


def _top_pairs(
    items: DataFrame,
    k: int,
    small: int,
    prune_from: int = PRUNE_FROM_LINES,
    expect: Callable[[int], None] = lambda rows: None,
) -> DataFrame:
    """``a, b, co_count`` of the k most frequent pairs, ties by ids.

    A few numbers about sizes come to the driver first.  Without large baskets, the usual case, the
    enumeration is the whole plan.  ``expect`` is told how many rows the stages to come may meet.
    """
    lines = items.select("transaction_id", "product_id").na.drop()
    floor = 1
    sizes, total, large, largest, pairs, more = _shape(items, small)
    expect(total)
    if total >= prune_from:
        lines, floor = _without_rare(lines, k)
        sizes, total, large, largest, pairs, more = _shape(lines, small)
    expect(max(total, pairs + more))
    if large == 0:
        light = _light_counts(lines, pairs).withColumnRenamed("light", "co_count")
        return light.orderBy(*_ranking("co_count")).limit(k)
    light_lines, members = _small_and_large(lines, sizes, small, total, large)
    return _top_with_large(_light_counts(light_lines, pairs), members, k, floor, largest)


def _top_with_large(
    light: DataFrame, members: DataFrame, k: int, known_floor: int, largest: int
) -> DataFrame:
    """The top pairs from the counts of small baskets and the products of large ones."""
    members = stored(members, "large-baskets")
    spans = members.groupBy("product_id").agg(
        F.count("*").alias("h"),
        F.bit_xor(F.xxhash64("number")).alias("mark"),
        F.bit_xor(F.xxhash64("number", F.lit(1))).alias("second_mark"),
    )
    most = spans.agg(F.coalesce(F.max("h"), F.lit(0).cast("bigint"))).scalar()

    def floor_of(counts: DataFrame) -> Column:
        best = counts.orderBy(F.col("light").desc()).limit(k)
        least = f"greatest({known_floor}L, if(count(*) >= {k}, min(light), 1L))"
        return best.agg(F.expr(least)).scalar()

    # Only pairs seen in small baskets that can still reach the floor are stored; the k best are among them.
    light = stored(light.where(F.col("light") + most >= floor_of(light)), "light-pairs")
    floor = floor_of(light)

    # Products that large baskets alone can lift to the floor.
    by_id = Window.partitionBy("h", "mark", "second_mark").orderBy("product_id")
    chosen = (
        spans.where(F.col("h") >= floor)
        .withColumn("place", F.row_number().over(by_id))
        .where(F.col("place") <= k + 1)
        .select("product_id", F.lit(True).alias("chosen"))
    )
    known = spans.select("product_id", "h").join(chosen, "product_id", "left")

    def side(name: str) -> DataFrame:
        return known.toDF(name, f"h_{name}", f"chosen_{name}")

    hopeful = (
        light
        .join(side("a"), "a", "left")
        .join(side("b"), "b", "left")
        .na.fill(0, ["h_a", "h_b"])
        .where(F.col("light") + F.least("h_a", "h_b") >= floor)
    )
    paired = F.coalesce(F.col("chosen_a") & F.col("chosen_b"), F.lit(False))
    apart = hopeful.where((F.least("h_a", "h_b") > 0) & ~paired)
    picked = stored(members.join(known.where("chosen"), "product_id", "left_semi"), "picked-lines")
    counts = (
        hopeful.select("a", "b", F.col("light").alias("n"))
        .unionByName(_shared_baskets(apart, members))
        .unionByName(_pairs_of_large(picked, SMALL_BASKET, largest))
    )
    # A pair that is not hopeful may lack its small baskets here: with them it would not reach the floor either.
    both = counts.groupBy("a", "b").agg(F.sum("n").alias("co_count"))
    return both.orderBy(*_ranking("co_count")).limit(k)


def also_bought(
    line_items: DataFrame,
    k: int = 10,
    products: DataFrame | None = None,
    small_basket: int = SMALL_BASKET,
    prune_from: int = PRUNE_FROM_LINES,
) -> DataFrame:
    """The k product pairs found together in most transactions.

    ``product_a, product_a_name, product_b, product_b_name, co_count`` with ``product_a < product_b``;
    a product counts once per transaction and ties are ordered by the ids.  Pairs are counted by id.
    The winners are computed when this is called; names are joined to them, from ``products`` or else
    from ``line_items``.
    ``small_basket`` only divides the work, and ``prune_from`` lines or more are pruned of rare products
    first; neither changes the result.
    """
    with fine_stages(line_items.sparkSession) as expect:
        best = stored(_top_pairs(line_items, k, small_basket, prune_from, expect), "top-pairs")
    if products is None:
        names = line_items.groupBy("product_id").agg(F.min("product_name").alias("name"))
    else:
        names = products.select("product_id", "name")
    ids = best.select(F.explode(F.array("a", "b")).alias("product_id"))
    wanted = only(names, ids, 2 * k)
    first, second = wanted.alias("first"), wanted.alias("second")
    return (
        best.join(first, F.col("a") == F.col("first.product_id"), "left")
        .join(second, F.col("b") == F.col("second.product_id"), "left")
        .orderBy(*_ranking("co_count"))
        .select(
            F.col("a").alias("product_a"),
            F.col("first.name").alias("product_a_name"),
            F.col("b").alias("product_b"),
            F.col("second.name").alias("product_b_name"),
            "co_count",
        )
    )


def copurchase_totals(pairs: DataFrame, k: int = 15) -> DataFrame:
    """Co-purchase counts added up per product name over both sides of the given pairs.

    ``product_name, co_purchases``, the k largest.
    """
    sides = F.array(F.col("product_a_name"), F.col("product_b_name"))
    return (
        pairs.select(F.explode(sides).alias("product_name"), "co_count")
        .groupBy("product_name")
        .agg(F.sum("co_count").alias("co_purchases"))
        .orderBy(F.col("co_purchases").desc(), "product_name")
        .limit(k)
    )
