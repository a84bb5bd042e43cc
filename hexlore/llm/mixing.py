"""Mixing sources to target weights (operator 8): whole copies first, then Pareto order sampling.

Each source's target is some whole copies of all its documents, which are certain, and a share of one more. That share
is drawn by Pareto order sampling with unequal inclusion probabilities: proportional to a document's size class (the
power of two at or below its words), 1 at most, and set so that the expected words are those missing. A document's rank
is its random odds over its inclusion odds; those of probability 1 come first, then ranks are taken in order up to the
words that are missing. The cut in that order is found from sums over 1,024 intervals of the rank per source, then over
the 1,024 parts of the interval that the cut falls into; only the part with the cut, a millionth of a source, is put in
order, so no source, however large, goes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexlore.llm.common import cut_lineage, words
from hexlore.operators.shape import in_order

#: Ranks are numbers of RANK_BITS bits; intervals share the first LEVEL_BITS, parts of intervals twice as many.
RANK_BITS, LEVEL_BITS = 40, 10
#: Tables of sources, classes and repeated keys are broadcast up to so many rows (some 100 bytes each), else joined by shuffles.
MOST_BROADCAST = 10_000
#: The weights of the sources in order of their names.
WEIGHTS = (3, 1, 2)


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) that depends on nothing but the keys."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def targets(sizes: DataFrame, weights: tuple[int, ...], ratio: float, most_copies: int) -> DataFrame:
    """source, source_size, target from (source, source_size): ratio times all sizes shared by weight, under the caps.

    Sources are in order of name by code point, null last, and weigh as weights, repeated. Sharing what is over a cap
    among the others by weight until no target is over its cap comes to min(cap, level * weight) with one level, found
    from sums over all sources: the level of those that are not full rises until no more of them fill.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = in_order(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "place").withColumn("w", w).withColumn("cap", most_copies * F.col("source_size"))
    s = cut_lineage(s.withColumn("fill", F.col("cap") / F.col("w")).drop("place"))
    level, n_full = float("-inf"), -1
    while True:
        full = F.col("fill") <= F.lit(level)
        r = s.agg(
            F.sum("source_size").alias("all"), F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"),
            F.sum(F.when(~full, F.col("w"))).alias("w"),
        ).first()
        if r.w is None or r.n == n_full:
            break
        n_full, level = r.n, (ratio * r["all"] - (r.cap or 0)) / r.w
    target = F.when(F.col("fill") <= F.lit(level), F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def measure(size: Column) -> Column:
    """The size class of a document: the power of two at or below its words, 0 without words."""
    return F.when(size > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(size)) - 1)).otherwise(F.lit(0).cast("long"))


def sized(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, th (hash of the text), source, size and same (a hash of id, text and source), and carry as carry_*."""
    out = docs.select(
        F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(source_col).alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"), *[F.col(c).alias(f"carry_{c}") for c in carry]
    )
    return out.withColumn("same", F.xxhash64("id", F.lit("|"), "th", F.lit("|"), "source"))


def repeated(base: DataFrame) -> DataFrame:
    """same of rows that repeat each other in id, text and source."""
    return cut_lineage(base.groupBy("same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("same").alias("same_")))


def numbered(rows: DataFrame) -> DataFrame:
    """Materialised rows that repeat each other, with twin: 0, 1, ... among those of the same key.

    Each partition numbers its own rows and is shifted by what the others before it hold of the key, so a key of very
    many rows is in no task as a whole.
    """
    rows = cut_lineage(rows.withColumns({"part_": F.spark_partition_id(), "row_": F.monotonically_increasing_id()}))
    held = rows.groupBy("same", "part_").agg(F.count(F.lit(1)).alias("n"), F.min("row_").alias("first_"))
    before = held.select("same", "part_", (F.sum("n").over(Window.partitionBy("same").orderBy("part_")) - F.col("n")).alias("before_"))
    own = F.row_number().over(Window.partitionBy("same", "part_").orderBy("row_")) - 1
    return rows.withColumn("own_", own).join(before, ["same", "part_"]).withColumn("twin", F.col("before_") + F.col("own_")).drop("part_", "row_", "own_", "before_")


def drawn(base: DataFrame, twins: DataFrame, seed: int) -> DataFrame:
    """base with u, the random number of each row; rows that repeat each other have numbers of their own.

    twins holds the keys of such rows; only these are numbered (and shuffled), the others keep their place.
    """
    draw = lambda df, k: df.withColumn("u", uniform(F.col("id"), F.col("th"), F.lit(seed), k))
    if twins.isEmpty():
        return draw(base, F.lit(0))
    keys = small(twins)
    again = numbered(base.join(keys, F.col("same") == F.col("same_"), "left_semi"))
    return draw(base.join(keys, F.col("same") == F.col("same_"), "left_anti"), F.lit(0)).unionByName(draw(again, F.col("twin")).drop("twin"))


def ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the plan of their source and size class, the rank in [0, 1), its interval and the part of it."""
    rows = rows.join(small(plan), F.col("source").eqNullSafe(F.col("name")) & (measure(F.col("size")) == F.col("m"))).drop("name", "m")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.greatest("p", F.lit(1e-12)) / F.greatest(1 - F.col("p"), F.lit(1e-300)))
    # A monotone image of the odds; what is certain comes first.
    rank = F.when(F.col("p") >= 1, F.lit(0.0)).otherwise(odds / (1 + odds))
    rows = rows.withColumn("rank", rank).withColumn("whole_rank", F.least(F.floor(F.col("rank") * 2**RANK_BITS), F.lit(2**RANK_BITS - 1)))
    return rows.withColumns({"bin": F.shiftright("whole_rank", RANK_BITS - LEVEL_BITS), "part": F.shiftright("whole_rank", RANK_BITS - 2 * LEVEL_BITS)}).drop("whole_rank")


def cut(rows: DataFrame, by: str) -> DataFrame:
    """name_, cut, before: where the words so far (upto, at first base) first reach those missing, and those before it."""
    sums = rows.groupBy("source", by).agg(F.sum("size").alias("words"), F.any_value("missing").alias("missing"), F.any_value("base").alias("base"))
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy(by))
    first = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("missing")).groupBy("source").agg(F.min(F.struct(by, (F.col("upto") - F.col("words")).alias("before"))).alias("first"))
    return first.select(F.col("source").alias("name_"), F.col(f"first.{by}").alias("cut"), F.col("first.before").alias("before"))


def inclusion(aims: DataFrame, classes: DataFrame) -> DataFrame:
    """aims by size class (m) with p, the inclusion probability: min(1, factor * m), so that words expected are those missing.

    Classes are at most 64 a source. From the largest class down, a class is certain as long as the factor that the
    words then missing ask of it and the smaller ones makes it so.
    """
    rows = aims.join(classes, F.col("name").eqNullSafe(F.col("source"))).drop("source")
    down = Window.partitionBy("name").orderBy(F.col("m").desc())
    before = F.coalesce(F.sum("class_words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("m") * F.col("class_words").cast("double")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("factor", F.coalesce(F.try_divide((F.col("missing") - before).cast("double"), rest), F.lit(0.0)))
    rows = rows.withColumn("open", F.when(F.col("factor") * F.col("m") < 1, F.struct((-F.col("m")).alias("m"), "factor")))
    top = F.min("open").over(Window.partitionBy("name"))
    p = F.when(F.col("m") == 0, F.lit(0.0)).when(top.isNull() | (-F.col("m") < top["m"]), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), top["factor"]) * F.col("m"))
    return rows.withColumn("p", p).drop("class_words", "factor", "open")


def planned(base: DataFrame, *, weights: tuple[int, ...], ratio: float, most_copies: int) -> DataFrame:
    """For each source (name) and size class (m): source_size, target, whole copies, the inclusion probability p of one
    more, and where the draw of it is cut."""
    classes = cut_lineage(base.groupBy("source", measure(F.col("size")).alias("m")).agg(F.sum("size").alias("class_words")))
    sizes = classes.groupBy("source").agg(F.sum("class_words").alias("source_size"))
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    aims = targets(sizes, weights, ratio, most_copies).select(
        F.col("source").alias("name"), "source_size", "target", whole.alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("missing"),
    )
    aims = cut_lineage(inclusion(aims, classes))

    def added(aims: DataFrame, found: DataFrame, name: str) -> DataFrame:
        found = found.select("name_", F.col("cut").alias(name), "before")
        return cut_lineage(aims.drop("before").join(found, F.col("name").eqNullSafe(F.col("name_")), "left").drop("name_"))

    aims = added(aims, cut(ranked(base, aims).withColumn("base", F.lit(0).cast("long")), "bin"), "cut_bin")
    aims = added(aims, cut(ranked(base, aims).where("bin = cut_bin").withColumn("base", F.col("before")), "part"), "cut_part")
    edge = ranked(base, aims).where("part = cut_part").groupBy("source", "rank").agg(
        F.sum("size").alias("words"), F.any_value("missing").alias("missing"), F.any_value("before").alias("before"),
    )
    ahead = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = edge.withColumn("ahead", ahead).where(F.col("ahead") + F.col("words") / 2 <= F.col("missing")).groupBy("source").agg(F.max("rank").alias("cut_rank"))
    return cut_lineage(aims.join(last.withColumnRenamed("source", "name_"), F.col("name").eqNullSafe(F.col("name_")), "left").drop("name_", "before"))


def copies(most_copies: int) -> Column:
    # Without a cut all words are missing, or the source has none.
    inside = F.col("cut_part").isNull() | (F.col("part") < F.col("cut_part")) | ((F.col("part") == F.col("cut_part")) & (F.col("rank") <= F.coalesce("cut_rank", F.lit(-1.0))))
    return (F.col("whole") + F.when((F.col("whole") < most_copies) & (F.col("p") > 0) & inside, 1).otherwise(0)).cast("int")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    ratio: float = 1.5, most_copies: int = 2, seed: int = 42,
) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, copies, source.

    size is the number of words (null text: 0), copies the whole copies that the mix takes, most_copies at most, and
    taken their words. Within a source taken misses target by half a document at most. The draw depends on id, text,
    source and seed alone; rows that repeat these are drawn apart from each other, each with a random number of its own
    (which of such equal rows gets which is left open, their outcomes together are fixed). Null ids and null sources
    are values like others; a source without words has target 0, a document without words gets whole copies only; an
    empty table gives no rows. Of docs only the named columns are read.
    """
    base = cut_lineage(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    base = cut_lineage(drawn(base, repeated(base), seed))
    rows = ranked(base, planned(base, weights=weights, ratio=ratio, most_copies=most_copies)).withColumn("copies", copies(most_copies))
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies",
        F.col("source").alias(source_col),
    )


def mixed(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    ratio: float = 1.5, most_copies: int = 2, seed: int = 42,
) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as many times as mix() takes it.

    Texts are not shuffled, but for those of rows that repeat each other's id, text and source.
    """
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    key, body, origin = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    which = {"id_col": key, "text_col": body, "source_col": origin}
    base = cut_lineage(sized(named, **which))
    twins = repeated(base)
    plan = planned(cut_lineage(drawn(base, twins, seed)), weights=weights, ratio=ratio, most_copies=most_copies)
    rows = drawn(sized(named, **which, carry=tuple(named.columns)), twins, seed)
    rows = ranked(rows, plan).withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies(most_copies))))
    return rows.select(*[F.col(f"carry_c{k}").alias(c) for k, c in enumerate(docs.columns)])
