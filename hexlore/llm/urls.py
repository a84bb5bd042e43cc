"""URL filters (operator 6): fixed host rules, and association rules mined by FP-growth for what no rule decides.

DataFrame functions only. Labelled pages (those that a host rule decides, and those whose document has been rated) give
URL token combinations that go with blocking; rules of enough support and confidence, pruned to those that no shorter
rule implies, are matched by an inverted index from token to rule. Tokens that host rules name are no items, as these
would give the labels away.

FP-growth itself lists all combinations, whose number doubles with each token of a basket. So tokens that are rules by
themselves leave the baskets first (what contains one is implied), as do rare ones, and of the rest a basket keeps the
ITEMS with the highest share of blocked pages. Rules found there are counted anew on whole token sets. What is met in a
longer basket is mined level by level besides, on whole sets, so no rule is lost by that.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlore.llm.common import cut_lineage, join_hot, lower_ascii

#: Fixed values: (host, path, verdict).
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCKED = "#block"
#: Tokens of a basket that FP-growth sees; combinations that are met in longer ones are mined by levels.
ITEMS = 10
#: Blocked pages that a rule must have been met on, whatever share of the labelled pages they are.
LEAST_ROWS = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> Column:
    """The (rule, verdict) of the longest rule that fits, null if none does."""
    out = None
    for name, begin, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(begin)
        told = F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, told) if out is None else out.when(fits, told)
    return out


def terms(host: Column) -> Column:
    """The words of a host's labels, but for the last two labels."""
    labels = F.split(host, r"\.")
    own = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))
    return F.filter(F.split(F.array_join(own, "-"), "-"), lambda t: t != "")


def document_number(path: Column) -> Column:
    """The number at the end of a path (before an extension or a last slash), null if there is none."""
    return F.regexp_extract(path, r"/(\d{1,18})(?:\.\w+)?/?$", 1).try_cast("long")


def tokens(url: Column, host: Column, path: Column, rules=HOST_RULES) -> Column:
    """Sorted distinct tokens: host words, path words that are no numbers, names of query keys; none that a rule names."""
    in_path = F.filter(F.split(path, r"[/.]"), lambda t: (t != "") & ~t.rlike(r"^\d+$"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda kv: F.substring_index(kv, "=", 1)), lambda k: k != "")
    marked = lambda mark, xs: F.transform(xs, lambda t: F.concat(F.lit(mark), t))
    named = {f"h:{t}" for name, _, _ in rules for t in name.split(".")} | {f"p:{t}" for _, begin, _ in rules for t in begin.split("/") if t}
    every = F.array_distinct(F.concat(marked("h:", terms(host)), marked("p:", in_path), marked("q:", keys)))
    return F.array_sort(F.array_except(every, F.array(*[F.lit(t) for t in sorted(named)]).cast("array<string>")))


def matched(sets: DataFrame, index: DataFrame) -> DataFrame:
    """items, rule_id for each rule of the index of each of whose slots a token is among the items.

    A rule is looked up by the tokens of its slot that fewest rules share; the other slots are held against the items.
    """
    use = index.groupBy("token").agg(F.count(F.lit(1)).alias("use"))
    slots = index.join(use, "token").groupBy("rule_id", "slot").agg(F.sum("use").alias("use"), F.collect_list("token").alias("any_of"))
    rules = slots.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("use", "slot", "any_of"))).alias("slots"))
    rest = F.transform(F.slice("slots", 2, F.size("slots")), lambda x: x["any_of"])
    rules = rules.select("rule_id", F.explode(F.col("slots")[0]["any_of"]).alias("token"), rest.alias("rest"))
    met = sets.select("items", F.explode("items").alias("token")).join(rules, "token").where(F.forall("rest", lambda any_of: F.arrays_overlap(any_of, F.col("items"))))
    return met.select("items", "rule_id").distinct()


def pruned(index: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """The index without rules that a shorter one (of by, or of its own) implies, all of whose slots are met by their tokens."""
    small = (index if by is None else by).select(F.col("rule_id").alias("by"), "token", F.col("n").alias("least"), F.col("slot").alias("met"))
    implied = index.join(small, "token").where("least < n").groupBy("rule_id", "by", "least").agg(F.count_distinct("met").alias("both")).where("both = least")
    return index.join(implied.select("rule_id").distinct(), "rule_id", "left_anti")


def by_levels(sets: DataFrame, weak: DataFrame, least: int, least_confidence: float) -> DataFrame:
    """rule_id, token, n, slot: all least rules of weak tokens that are met in a blocked basket of more than ITEMS of them.

    Tokens that the same sets hold are one slot of a rule, which any of them fills. A combination grows by one token a
    level while enough blocked pages hold it, it is no rule and every part of it is met on more pages than it: what a
    part implies adds nothing. So copies of long URLs add few combinations. Counts are of whole sets.
    """
    spark = sets.sparkSession
    seen = cut_lineage(sets.select(F.xxhash64("items").alias("row"), "rows", "blocked", F.explode("items").alias("token")).join(weak.select("token"), "token"))
    alike = seen.groupBy("token").agg(F.bit_xor("row").alias("x"), F.count(F.lit(1)).alias("m")).groupBy("x", "m").agg(F.collect_list("token").alias("tokens"))
    slots = cut_lineage(alike.select(F.xxhash64(F.array_min("tokens")).alias("t"), F.explode("tokens").alias("token")))
    own = seen.join(slots, "token").groupBy("row", "rows", "blocked").agg(F.sort_array(F.collect_set("t")).alias("rest"), F.count(F.lit(1)).alias("many"))
    long = (F.col("many") > ITEMS) & (F.col("blocked") > 0)
    held = cut_lineage(own.select(F.lit(0).cast("long").alias("h"), "rows", "blocked", long.alias("long"), "rest"))
    alive = spark.createDataFrame([(0, 1 << 62, [])], "h long, rows long, toks array<long>")
    level, found = 0, []
    while True:
        level += 1
        grown = held.select("h", "rows", "blocked", "long", "rest", F.posexplode("rest").alias("p", "t"))
        grown = grown.select(F.col("h").alias("part"), "t", F.col("h").bitwiseXOR(F.col("t")).alias("h"), "rows", "blocked", "long", F.expr("slice(rest, p + 2, size(rest))").alias("rest"))
        # A combination grows from one part alone, by its last token.
        met = grown.groupBy("h").agg(F.max("part").alias("part"), F.max("t").alias("t"), F.sum("rows").alias("rows"), F.sum("blocked").alias("blocked"), F.bool_or("long").alias("long"))
        toks = alive.select(F.col("h").alias("part"), "toks")
        met = cut_lineage(met.where(F.col("long") & (F.col("blocked") >= least)).join(toks, "part").select("h", "rows", "blocked", F.array_append("toks", F.col("t")).alias("toks")))
        parts = met.select("h", "rows", F.explode("toks").alias("t")).select("h", "rows", F.col("h").bitwiseXOR(F.col("t")).alias("part"))
        more = alive.select(F.col("h").alias("part"), F.col("rows").alias("more"))
        whole = parts.join(more, "part").where("more > rows").groupBy("h").agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") == level)
        met = cut_lineage(met.join(whole.select("h"), "h"))
        sound = F.col("blocked") / F.col("rows") >= least_confidence
        found.append(met.where(sound).select("h", "toks"))
        alive = met.where(~sound).select("h", "rows", "toks")
        held = cut_lineage(grown.where(F.size("rest") > 0).join(alive.select("h"), "h", "left_semi").select("h", "rows", "blocked", "long", "rest"))
        if held.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = every.select(F.xxhash64(F.lit("levels"), "h").alias("rule_id"), F.size("toks").alias("n"), F.posexplode("toks").alias("slot", "t"))
    return every.join(slots, "t").select("rule_id", "token", "n", "slot")


def mine(labelled: DataFrame, *, least_support: float = 0.001, least_confidence: float = 0.9) -> DataFrame:
    """rule_id, token, n, slot: the pruned rules as an inverted index, from (items, block).

    A rule has n slots, each of one token or of several any of which fills it. A rule's tokens are met on at least LEAST_ROWS blocked pages, least_support of all labelled pages too, and
    least_confidence of the pages that they are met on are blocked.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, token string, n int, slot int")
    sets = cut_lineage(labelled.groupBy("items").agg(F.count(F.lit(1)).alias("rows"), F.count_if("block").alias("blocked")))
    n_rows = sets.agg(F.sum("rows")).first()[0] or 0
    least = max(LEAST_ROWS, math.ceil(least_support * n_rows))
    share = F.col("blocked") / F.col("rows")
    counted = sets.select(F.explode("items").alias("token"), "rows", "blocked").groupBy("token").agg(F.sum("rows").alias("rows"), F.sum("blocked").alias("blocked"))
    counted = cut_lineage(counted.where(F.col("blocked") >= least).withColumn("share", share))
    index_of = lambda rules: rules.select(F.xxhash64("tokens").alias("rule_id"), F.size("tokens").alias("n"), F.posexplode("tokens").alias("slot", "token")).select("rule_id", "token", "n", "slot")
    single = counted.where(F.col("share") >= least_confidence).select(F.array("token").alias("tokens"))
    weak = counted.where(F.col("share") < least_confidence).select("token", "share")
    found, levels = single, None
    if not weak.isEmpty():
        kept = sets.select("items", "rows", "blocked", F.explode("items").alias("token")).join(weak, "token")
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "token"))), 1, ITEMS)
        kept = cut_lineage(kept.groupBy("items", "rows", "blocked").agg(F.transform(best, lambda x: x["token"]).alias("own"), F.count(F.lit(1)).alias("many")))
        long = kept.where((F.col("many") > ITEMS) & (F.col("blocked") > 0)).select("items", F.lit(True).alias("long"))
        if not long.isEmpty():
            levels = cut_lineage(by_levels(sets, weak, least, least_confidence))
        copies = F.array_repeat(F.lit(1), (F.col("rows") - F.col("blocked")).cast("int"))
        clean = kept.select("own", F.explode(copies)).select(F.col("own").alias("items"))
        bad = kept.select("own", F.explode(F.array_repeat(F.lit(1), F.col("blocked").cast("int")))).select(F.array_append("own", F.lit(BLOCKED)).alias("items"))
        baskets = cut_lineage(bad.unionByName(clean))
        n_baskets = baskets.count()
        if n_baskets >= least:
            model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n_baskets, minConfidence=0.0).fit(baskets)
            joint = model.freqItemsets.where(F.array_contains("items", BLOCKED)).select(
                F.array_sort(F.array_remove("items", BLOCKED)).alias("tokens"), F.col("freq").alias("blocked"),
            )
            alone = model.freqItemsets.where(~F.array_contains("items", BLOCKED)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("rows"))
            # Whole sets can only hold more of both; what is met a little too seldom here is looked at again below.
            strong = joint.where(F.size("tokens") > 1).join(alone, "tokens").where(share >= least_confidence / 2)
            found = single.unionByName(strong.select("tokens"))
    index = cut_lineage(index_of(found))
    if index.isEmpty() and levels is None:
        return empty
    facts = matched(sets.select("items"), index).join(sets, "items")
    if levels is None:
        facts = facts.withColumn("long", F.lit(None).cast("boolean"))
    else:
        facts = facts.join(long, "items", "left")
    facts = facts.groupBy("rule_id").agg(F.sum("rows").alias("rows"), F.sum("blocked").alias("blocked"), F.max("long").alias("long"))
    sound = facts.where((F.col("blocked") >= least) & (share >= least_confidence)).select("rule_id", "long")
    index = cut_lineage(index.join(sound, "rule_id"))
    if levels is None:
        return cut_lineage(pruned(index.drop("long")))
    # Rules of several tokens that are met in a long basket are among those found by levels, and least there.
    every = cut_lineage(index.where("n = 1 or long is null").drop("long").unionByName(levels))
    own = every.join(levels.select("rule_id").distinct(), "rule_id", "left_anti")
    return cut_lineage(pruned(own, every).unionByName(levels))


def judge(
    pages: DataFrame, labels: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", rules=HOST_RULES,
    least_support: float = 0.001, least_confidence: float = 0.9,
) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    A host rule decides where one fits (the longest). labels rates documents (number, block); a page shows the document
    of the number that ends its path. A page is labelled by its rule's verdict, else by its document's rating (of
    several ratings one to block counts); other pages have no label and teach nothing. Pages without a rule are blocked
    if rated so or if a mined rule matches, else allowed. Null and malformed URLs have an empty host and path and are
    allowed; null and repeated ids are carried as they are; an empty table gives no rows, null ratings count as none.
    Matching is by distinct token sets, so a host of very many pages is matched once. Of pages only id_col and url_col
    are read.
    """
    spark, url = pages.sparkSession, F.col("url")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_and_path(url)
    base = base.select("id", "url", host.alias("host"), path.alias("path"))
    base = base.select(
        "id", "host", "path", host_rule(F.col("host"), F.col("path"), rules).alias("hit"),
        tokens(url, F.col("host"), F.col("path"), rules).alias("items"), document_number(F.col("path")).alias("number"),
    )
    if labels is None:
        labels = spark.createDataFrame([], "number long, block boolean")
    rated = labels.where("number is not null and block is not null").groupBy(F.col("number").alias("number_")).agg(F.bool_or("block").alias("bad"))
    # Pages without a number are spread, not gathered under one key.
    key = F.coalesce("number", -1 - F.pmod(F.xxhash64("host", "path"), F.lit(2**31)))
    base = cut_lineage(base.withColumn("number_", key).join(rated, "number_", "left").select("id", "host", "path", "hit", "items", "bad"))
    label = F.coalesce(F.col("hit.verdict") == "block", F.col("bad"))
    index = mine(
        base.select("items", label.alias("block")).where(F.col("block").isNotNull() & (F.size("items") > 0)), least_support=least_support,
        least_confidence=least_confidence,
    )
    sets = cut_lineage(base.groupBy("items").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("hit").isNull()).alias("open")))
    blocked = matched(sets.where("open > 0").select("items"), index).select("items").distinct().withColumn("mined", F.lit("block"))
    out = join_hot(base, cut_lineage(blocked.join(sets.select("items", "pages"), "items")), "items", "pages")
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("bad"), F.lit("block")), F.col("mined"), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))


def rated_documents(labels: DataFrame) -> DataFrame:
    """number, block from ratings of documents: poor or toxic ones are to be blocked, sound and clean ones are not."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return labels.select(F.col("doc_id").alias("number"), bad.alias("block"))
