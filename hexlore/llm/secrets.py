"""Secret scans (operator 4): fixed patterns, and Markov models of random strings against ordinary identifiers.

DataFrame functions only. Places of matches come from the pieces between them: text = piece, match, piece, match, ...
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, the group whose length counts, and the least length, by kind in the order of ties.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Runs of these characters, this long at least, are scored by the models.
LEAST = 12
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{6,}"
METHOD = "random"
KINDS = (*BASE, METHOD)
SPAN = "struct<s:bigint,k:int,e:bigint>"
CODES = 128


def matches(text: Column, pattern: str) -> Column:
    """gap (the characters since the last match), n, token of each match of a pattern; text is read twice in all."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # There is one piece more than matches.
    both = F.zip_with(found, pieces, lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("token")))
    return F.filter(both, lambda x: x["token"].isNotNull())


def places(text: Column, pattern: str, group: int, least: int) -> Column:
    """gap, n, ok of each match; ok says that the group is long enough."""
    if not group:
        return F.transform(matches(text, pattern), lambda x: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.lit(True).alias("ok")))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.zip_with(matches(text, pattern), values, lambda x, v: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), (F.length(v) >= least).alias("ok")))


def as_spans(found: Column, kind: int) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("s"), F.lit(kind).alias("k"), (begin + x["n"]).alias("e"))
        return F.struct((begin + x["n"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def open_parts(runs: Column, fixed: Column) -> Column:
    """s, e, token of the parts of candidate runs (s, e, token) that no fixed span (in order) covers, LEAST long at least."""
    def parts(run: Column) -> Column:
        met = F.filter(fixed, lambda y: (y["s"] < run["e"]) & (run["s"] < y["e"]))
        start = F.struct(run["s"].alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

        def step(acc: Column, y: Column) -> Column:
            gap = F.struct(acc["at"].alias("s"), y["s"].alias("e"))
            return F.struct(F.greatest(acc["at"], y["e"]).alias("at"), F.when(y["s"] - acc["at"] >= LEAST, F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).alias("out"))

        def end(acc: Column) -> Column:
            return F.when(run["e"] - acc["at"] >= LEAST, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), run["e"].alias("e"))))).otherwise(acc["out"])

        left = F.aggregate(met, start, step, end)
        return F.transform(
            left,
            lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.substr(run["token"], (p["s"] - run["s"] + 1).cast("int"), (p["e"] - p["s"]).cast("int")).alias("token")),
        )

    return F.flatten(F.transform(runs, parts))


def candidate_runs(text: Column) -> Column:
    """s, e, token of each candidate run."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint,token:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        run = F.struct(begin.alias("s"), (begin + x["n"]).alias("e"), x["token"].alias("token"))
        return F.struct((begin + x["n"]).alias("at"), F.concat(acc["out"], F.array(run)).alias("out"))

    return F.when(text.rlike(CANDIDATE), F.aggregate(matches(text, CANDIDATE), start, step, lambda acc: acc["out"]))


def base_found(text: Column, kind: str) -> Column:
    """The matches of a base kind with their places; null where the text has none that could count."""
    pattern, group, least = BASE[kind]
    if group:
        # A match too short is dropped only after it has used up its place.
        return F.when(text.rlike(pattern), places(text, pattern, group, least))
    # These are maximal runs, so the least length may be part of the pattern.
    head = "AKIA[A-Z0-9]" if kind == "access" else "[0-9a-f]"
    long_enough = f"{head}{{{least - 4 if kind == 'access' else least},}}"
    return F.when(text.rlike(long_enough), places(text, long_enough, 0, 0))


def pair_codes(token: Column) -> Column:
    """The adjacent character pairs of an ASCII string as numbers below CODES squared."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    return F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: a * CODES + b)


def labelled_samples(docs: DataFrame, *, id_col: str, text_col: str, most_rows: int, n_random: int) -> DataFrame:
    """token, random: values of base matches and random digests, against the other identifiers of the same documents.

    Documents are those of the least hashes of id and text, at most most_rows of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(text.alias("text"), F.xxhash64(F.col(id_col), text).alias("h"))
    last = hashed.select("h").orderBy("h").limit(most_rows).agg(F.max("h")).first()[0]  # numbers alone are sorted, no texts
    picked = hashed.where(F.col("h") <= F.lit(last)).select("text")
    hits = F.concat(F.regexp_extract_all("text", F.lit(BASE["assign"][0]), F.lit(2)), F.regexp_extract_all("text", F.lit(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}"), F.lit(0)))
    hits = picked.select(F.explode(F.filter(hits, lambda x: F.length(x) >= 12)).alias("token")).select("token", F.lit(True).alias("random"))
    bare = F.regexp_replace(F.regexp_replace("text", BASE["assign"][0], " "), r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", " ")
    plain = picked.select(F.explode(F.regexp_extract_all(bare, F.lit(IDENTIFIER), F.lit(0))).alias("token")).select("token", F.lit(False).alias("random"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = docs.sparkSession.range(n_random).select(
        F.explode(F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "[\r\n]", ""))).alias("token"), F.lit(True).alias("random"),
    )
    return hits.unionByName(plain).unionByName(made)


def train(samples: DataFrame) -> list[float]:
    """log P(b | a) under random strings less that under identifiers, for each pair of characters, add-one smoothed."""
    pairs = samples.select("random", F.explode(pair_codes(F.col("token"))).alias("pair")).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))
    counts = {True: [1.0] * CODES * CODES, False: [1.0] * CODES * CODES}
    for r in pairs.collect():  # at most two rows for each pair of ASCII characters
        counts[r.random][r.pair] += r.n
    total = {k: [sum(v[a * CODES : a * CODES + CODES]) for a in range(CODES)] for k, v in counts.items()}
    return [round(math.log(counts[True][p] / total[True][p // CODES]) - math.log(counts[False][p] / total[False][p // CODES]), 4) for p in range(CODES * CODES)]


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    """The sum over adjacent characters of the models' log-likelihood ratio."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    return F.aggregate(pair_codes(token), F.lit(0.0), lambda s, p: s + F.get(table, p))


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 2000, n_random: int = 2000, least_ratio: float = 12.0, model: list[float] | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of docs: id, spans (array of s, k, e by start and kind; k numbers KINDS), and the columns in carry.

    Base matches are all kept. The parts of candidate runs that none of them covers, LEAST characters long at least and
    with a log-likelihood ratio of at least least_ratio, are added as kind METHOD. Null texts are empty and have no spans; null and repeated ids are carried as
    they are; an empty table gives no rows. Whole texts are scanned; most_rows bounds the documents of the training
    sample. Places count code points, ends are exclusive.
    """
    model = model or train(labelled_samples(docs, id_col=id_col, text_col=text_col, most_rows=most_rows, n_random=n_random))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    rest = ["id", *[f"carry_{c}" for c in carry]]
    text = F.col("text")
    found = base.select(*rest, *[base_found(text, kind).alias(f"f_{kind}") for kind in BASE], candidate_runs(text).alias("runs"))
    none = F.array().cast(f"array<{SPAN}>")
    fixed = found.select(*rest, F.array_sort(F.concat(*[F.coalesce(as_spans(F.col(f"f_{kind}"), k), none) for k, kind in enumerate(BASE)])).alias("fixed"), "runs")
    random = F.filter(open_parts(F.col("runs"), F.col("fixed")), lambda p: likelihood_ratio(p["token"], model) >= least_ratio)
    more = F.coalesce(F.transform(random, lambda p: F.struct(p["s"].alias("s"), F.lit(len(BASE)).alias("k"), p["e"].alias("e"))), none)
    return fixed.select(F.col("id").alias(id_col), F.array_sort(F.concat("fixed", more)).alias("spans"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def digests(scanned: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    fixed = F.filter("spans", lambda x: x["k"] < len(BASE))
    of_kind = lambda k: F.filter("spans", lambda x: x["k"] == k)
    number = [F.size(of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return scanned.select(id_col, *number, F.sha2(written(fixed), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """docs with every span of its texts replaced by mark; columns and rows stay, null texts stay null."""
    columns = docs.columns
    # Numbered names keep any column of docs apart from the scan's own.
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    key, body = (f"c{columns.index(c)}" for c in (id_col, text_col))
    out = scan(named, id_col=key, text_col=body, carry=tuple(c for c in named.columns if c != key), **options)
    text, spans = F.col(body), F.col("spans")
    # Overlapping spans count as one: a span begins where none before it reaches.
    reach = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), lambda acc,
        x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(
                x["s"] >= acc["at"],
                F.concat(acc["out"], F.array(F.substr(text, acc["at"].cast("int") + 1, (x["s"] - acc["at"]).cast("int")), F.lit(mark))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"].cast("int") + 1)),
    )
    changed = F.when(F.size(spans) > 0, reach).otherwise(text)
    return out.withColumn(body, changed).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])

