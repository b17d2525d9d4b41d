"""Mixing sources to target weights by entropy balancing.

Every document has the same prior mass. Entropy balancing seeks document rates w that stay as close as possible to the
prior (relative entropy) while the words of each source meet their target and no rate exceeds ``max_rate``. The dual is
convex and has one multiplier a source; its rates are exponentially tilted by the documents' sizes:
``w = min(max_rate, exp(m * size))``, with ``sum(size * w) = target``. So where a source has to grow, longer documents are
repeated first; where it has to shrink, longer ones are left out first.

Newton's iterations are distributed: each round sums the dual's gradient and curvature over the table of
(source, size, documents), which documents are counted into once, and moves all sources' multipliers at once. A step that
leaves the bracket in which the multiplier is known to lie is replaced by its middle, so every source converges.

Rates become whole copies: every document gets its rate's whole part, and those whose hash of id and text is the
smallest against the rest of the rate get one copy more, up to the place in that order at which the source's words come
nearest to its target. The place is found level by level (sums by bits of the order, then the rows of the last cell), so
no task holds a source. Of rows that are alike in id, text and source, as many take the extra copy as are needed.

Edge cases: a null or wordless text has size 0, rate 1 (0 in a source without a target) and takes 0 words; a null source
is a source of its own, after all others; a target of 0 gives rates of 0, one of ``max_rate`` times the source's size
rates of ``max_rate``; an empty table gives an empty result; further columns are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import free_name, materialize, maybe_broadcast

#: Relative error of a source's words at which its multiplier is settled, and a bound that halving always keeps.
SETTLED, MAX_ROUNDS = 1e-9, 200
#: The order of documents has 2**ORDER_BITS places, looked at in levels of so many bits.
ORDER_BITS, LEVEL_BITS, LEVELS = 52, 10, 3
BROADCAST_ROWS = 100_000


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size, docs): docs documents of that size.

    Sources by code point, null last, get the weights in turn. All sizes are shared by weight; a target stops at
    max_rate times its source's size, and the excess is reshared by weight until none is above. A weight of 0 gets nothing.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    sources = sources.withColumn("weight", weight.cast("double"))
    # Sources reach their cap in the order of cap by weight. With the first k capped, the level of the others is
    # (total - their caps) / (the others' weights); a source is capped while its own cap is at or below that level.
    fill = Window.orderBy(F.try_divide("source_size", "weight").asc_nulls_last(), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    total = F.sum("source_size").over(everywhere)
    cap = F.col("source_size") * F.lit(max_rate)
    level = F.try_divide(
        total - F.coalesce(F.sum(cap).over(before), F.lit(0)), F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = sources.select("source", "source_size", "weight", cap.cast("double").alias("cap"), level.alias("level"))
    ranked = ranked.withColumn("share", F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(everywhere))
    target = F.when(F.col("cap") <= F.col("weight") * F.col("level"), F.col("cap")).otherwise(F.col("weight") * F.coalesce("share", F.lit(0.0)))
    return ranked.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def _by_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table of sources whose key is called ``of``."""
    return rows.join(maybe_broadcast(table, table.count(), BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("of")), how).drop("of")


def rate_of(size: Column, multiplier: Column, max_rate: int) -> Column:
    """A document's rate; multipliers of minus and plus infinity give 0 and max_rate to all documents with words."""
    tilted = F.least(F.lit(float(max_rate)), F.exp(F.least(multiplier * size, F.lit(50.0))))
    return F.when(size > 0, tilted).when(multiplier == float("-inf"), 0.0).otherwise(1.0)


def multipliers(sizes: DataFrame, targets: DataFrame, max_rate: int = 3) -> DataFrame:
    """targets with ``multiplier``, from (source, size, docs): damped Newton rounds on the dual, all sources at once."""
    shortest = sizes.filter("size > 0").groupBy(F.col("source").alias("of")).agg(F.min("size").alias("shortest"))
    full = F.col("target") >= max_rate * F.col("source_size") * (1 - 1e-12)
    fixed = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") <= 0, float("-inf")).when(full, float("inf"))
    # at these ends even the shortest document is at its least and its greatest rate
    low = F.least(F.lit(0.0), F.ln(F.col("target") / F.col("source_size")) / F.col("shortest"))
    high = F.lit(float(max_rate))
    state = _by_source(targets, shortest, "left").withColumn("fixed", fixed)
    state = state.select(
        "source", "source_size", "target", F.coalesce("fixed", F.lit(0.0)).alias("multiplier"), F.coalesce(low, F.lit(0.0)).alias("low"),
        F.coalesce(F.ln(high) / F.col("shortest"), F.lit(0.0)).alias("high"), F.col("fixed").isNotNull().alias("settled"),
    )
    state = materialize(state, "mix-multipliers")
    for _ in range(MAX_ROUNDS):
        if state.filter(~F.col("settled")).isEmpty():
            return state.select("source", "source_size", "target", "multiplier")
        moving = state.filter(~F.col("settled")).select(F.col("source").alias("of"), "multiplier")
        rate = rate_of(F.col("size"), F.col("multiplier"), max_rate)
        words = F.col("docs") * F.col("size") * rate
        sums = _by_source(sizes.filter("size > 0"), moving).groupBy(F.col("source").alias("of")).agg(
            F.sum(words).alias("words"), F.sum(F.when(rate < max_rate, words * F.col("size")).otherwise(0.0)).alias("curve")
        )
        moved = _by_source(state, sums, "left")
        over = F.col("words") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("multiplier")), F.when(over, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - (F.col("words") - F.col("target")) / F.nullif("curve", F.lit(0.0))
        there = F.abs(F.col("words") - F.col("target")) <= SETTLED * F.col("target")
        narrow = high - low <= 1e-14 * F.greatest(F.abs(low), F.abs(high))
        step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        state = materialize(
            moved.select(
                "source", "source_size", "target", F.when(F.col("settled") | there, F.col("multiplier")).otherwise(step).alias("multiplier"),
                F.when(F.col("settled"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("settled"), F.col("high")).otherwise(high).alias("high"),
                (F.col("settled") | there | narrow).alias("settled"),
            ),
            "mix-multipliers",
        )
    raise RuntimeError(f"multipliers did not settle in {MAX_ROUNDS} rounds, which halving alone would take")


def _whole(rate: Column) -> Column:
    return F.floor(rate + 1e-9).cast("int")


def place_of(rate: Column, turn: Column) -> Column:
    """A document's place in the order in which extra copies are given: its hash, against the rest of its rate; null without a rest."""
    rest = rate - _whole(rate)
    share = F.call_function("shiftrightunsigned", turn, F.lit(11)) / float(1 << 53)  # 0 to 1
    return F.when(rest > 1e-9, F.floor((share - rest + 1) * float(1 << (ORDER_BITS - 1))).cast("long"))


def cutoffs(places: DataFrame, rests: DataFrame) -> DataFrame:
    """(of, cutoff, take): up to places below ``cutoff`` documents get one copy more, and at it the first ``take`` rows.

    places: (source, size, place); rests: (of, rest), the words that are left for extra copies. Each level sums the words by
    the next bits of the place, inside the cell where the last level's sum ran out; only that cell's rows are ever ordered.
    """
    inside = places.filter(F.col("place").isNotNull() & (F.col("size") > 0))
    cell = materialize(rests.select("of", "rest", F.lit(0).cast("long").alias("prefix")), "mix-level")
    for level in range(1, LEVELS + 1):
        shift = ORDER_BITS - level * LEVEL_BITS
        here = _by_source(inside, cell).filter(F.shiftright("place", shift + LEVEL_BITS) == F.col("prefix"))
        sums = here.groupBy("source", F.shiftright("place", shift).alias("part")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("words").over(order)).filter(F.col("upto") > F.col("rest"))
        first = sums.groupBy(F.col("source").alias("of")).agg(F.min(F.struct("part", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))).alias("f"))
        cell = materialize(first.select("of", F.col("f.rest").alias("rest"), F.col("f.part").alias("prefix")), "mix-level")
    here = _by_source(inside, cell).filter(F.shiftright("place", shift) == F.col("prefix"))
    same = here.groupBy("source", "place", "size").agg(F.count(F.lit(1)).alias("rows"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("place", "size")
    before = F.coalesce(F.sum(F.col("size") * F.col("rows")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # of rows of one place, those are taken that bring the source nearer to its target
    take = F.floor((F.col("rest") - before) / F.col("size") + 0.5).cast("long")
    reached = same.withColumn("take", take).filter(F.col("take") < F.col("rows"))
    found = reached.groupBy(F.col("source").alias("of")).agg(F.min(F.struct("place", "size", F.greatest("take", F.lit(0).cast("long")).alias("take"))).alias("f"))
    # without a place where the words run out, all documents with a rest take their extra copy
    ended = cell.join(found.withColumnRenamed("of", "found_of"), F.col("of").eqNullSafe(F.col("found_of")), "left").select("of", F.coalesce("f.place", F.shiftleft(F.col("prefix") + 1, shift)).alias("cutoff"), F.coalesce("f.take", F.lit(0)).alias("take"))
    return materialize(ended, "mix-cutoffs")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3, keep: list[str] | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """(rows, names): the columns ``keep`` of docs (all of them) beside size, source_size, target, rate and copies.

    names gives what these five are called in rows: names that docs doesn't have.
    """
    keep = docs.columns if keep is None else keep
    names = {c: free_name(docs, c) for c in ("size", "source_size", "target", "rate", "copies", "source", "turn", "place")}
    inner = {c: free_name(docs, f"mix_{c}") for c in ("of", "multiplier", "cutoff", "take", "extra")}
    turn = F.xxhash64(F.lit("mix"), F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(
        *(F.col(f"`{c}`") for c in keep), F.col(source_col).cast("string").alias(names["source"]), size_of(F.col(text_col)).alias(names["size"]), turn.alias(names["turn"])
    )
    rows = materialize(rows, "mix-rows")  # texts are read and counted once
    plain = rows.select(F.col(names["source"]).alias("source"), F.col(names["size"]).alias("size"), F.col(names["turn"]).alias("turn"))
    sizes = materialize(plain.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, max_rate), "mix-targets")
    solved = multipliers(sizes, targets, max_rate)
    found = solved.select(F.col("source").alias("of"), "source_size", "target", "multiplier")
    rate = rate_of(F.col("size"), F.col("multiplier"), max_rate)
    given = _by_source(sizes, found).groupBy(F.col("source").alias("of")).agg(
        (F.first("target") - F.sum(_whole(rate) * F.col("size") * F.col("docs"))).alias("rest")
    )
    places = _by_source(plain, found).select("source", "size", place_of(rate, F.col("turn")).alias("place"))
    ends = cutoffs(places, materialize(given, "mix-rests"))
    plan = found.join(ends.withColumnRenamed("of", "ended"), F.col("of").eqNullSafe(F.col("ended")), "left").drop("ended")
    plan = materialize(plan, "mix-plan")
    n_plan = plan.count()
    named = plan.select(
        F.col("of").alias(inner["of"]), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]),
        F.col("multiplier").alias(inner["multiplier"]), F.col("cutoff").alias(inner["cutoff"]), F.col("take").alias(inner["take"]),
    )
    joined = rows.join(maybe_broadcast(named, n_plan, BROADCAST_ROWS), F.col(names["source"]).eqNullSafe(F.col(inner["of"])))
    joined = joined.withColumn(names["rate"], rate_of(F.col(names["size"]), F.col(inner["multiplier"]), max_rate))
    joined = joined.withColumn(names["place"], place_of(F.col(names["rate"]), F.col(names["turn"])))
    at_end = F.coalesce((F.col(names["place"]) == F.col(inner["cutoff"])) & (F.col(inner["take"]) > 0), F.lit(False))
    extra = F.coalesce(F.col(names["place"]) < F.coalesce(inner["cutoff"], F.lit(2**62).cast("long")), F.lit(False))
    # rows of the place where words run out: one document and its repeats, or by chance another of the same place
    turns = Window.partitionBy(names["source"]).orderBy(names["size"], names["turn"])
    last = joined.filter(at_end).withColumn(inner["extra"], F.row_number().over(turns) <= F.col(inner["take"]))
    both = joined.filter(~at_end).withColumn(inner["extra"], extra).unionByName(last)
    both = both.withColumn(names["copies"], _whole(F.col(names["rate"])) + F.col(inner["extra"]).cast("int"))
    out = [names[c] for c in ("size", "source_size", "target", "rate", "copies")]
    return both.select(*(F.col(f"`{c}`") for c in keep), *out), names


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as its copies say."""
    rows, names = mix(docs, **options)
    copies = F.col(names["copies"])
    rows = rows.filter(copies > 0).withColumn(free_name(rows, "copy"), F.explode(F.sequence(F.lit(1), copies)))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
