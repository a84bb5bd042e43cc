"""Quality rules (operator 5): a threshold table compiled into Spark projections, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexlore.llm.common import words

#: Common words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are at from or an "
    "le la les de des du et un une en que qui dans pour par sur au "
    "der die das und zu den mit von ein eine im nicht auf ist für sich "
    "el los las del y una se con no su para es lo"
).split()
#: The symbols that count.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30


@dataclass(frozen=True)
class Rule:
    """A text passes if the ratio (an expression over the measures, in SQL) lies within the bounds; null passes."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None

    def sql(self) -> str:
        bounds = [f"{self.ratio} >= {self.low}"] * (self.low is not None) + [f"{self.ratio} <= {self.high}"] * (self.high is not None)
        return f"coalesce({' AND '.join(bounds)}, true)"


#: The production table. Its SQL is the same in Spark and DuckDB.
RULES = (
    Rule("mean_word_chars", "CAST(word_chars AS DOUBLE) / nullif(n_words, 0)", 2.0, 15.0),
    Rule("symbols_per_word", "CAST(n_symbols AS DOUBLE) / nullif(n_words, 0)", None, 0.25),
    Rule("capitals", "CAST(n_capitals AS DOUBLE) / nullif(word_chars, 0)", None, 0.4),
    Rule("shouts_per_word", "CAST(n_shouts AS DOUBLE) / nullif(n_words, 0)", None, 0.5),
    Rule("stop_words", "CASE WHEN n_words >= 50 THEN CAST(n_stop_words AS DOUBLE) / n_words END", 0.01, None),
    Rule("duplicate_lines", "CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0)", None, 0.5),
)


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id and the measures of each text: word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words and those of RULES.

    Windows of WINDOW words are compared by 64-bit hashes. Their repeats are found by sorting (hash, place) within the
    text, in time n log n, and only in texts that have any; the covered words follow from the gaps between places.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    kept = ["id", *[f"carry_{c}" for c in carry]]
    split = base.select(*kept, "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"))
    counts = {
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": count_chars(F.col("text"), SYMBOLS),
        "n_capitals": count_chars(F.col("text"), CAPITALS),
        "n_shouts": count_chars(F.col("text"), "!"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("w", lambda x: x.isin(STOP_WORDS))).cast("long"),
    }
    hashed = split.select(*kept, *[c.alias(n) for n, c in counts.items()], F.when(F.size("w") > WINDOW, F.transform("w", lambda x: F.xxhash64(x))).alias("h"))
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    hashed = hashed.select(*kept, *counts, windows.alias("g"))
    # Sorted only where some window repeats.
    marked = hashed.select(
        *kept, *counts,
        F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"),
    )
    twin = lambda x, k, step: F.coalesce(F.get("s", k + step)["x"] == x["x"], F.lit(False))
    places = F.sort_array(F.filter(F.transform("s", lambda x, k: F.when(twin(x, k, -1) | twin(x, k, 1), x["i"])), lambda i: i.isNotNull()))
    marked = marked.select(*kept, *counts, places.alias("p"))
    gaps = F.transform("p", lambda i, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), i - F.get("p", k - 1))))
    return marked.select(*kept, *counts, F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def judge(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED_PERCENT of them in repeated windows. kept:
    not base_failed and within all bounds of the rules. Null texts are empty, so they fail; null and repeated ids are
    carried as they are; an empty table gives no rows; of docs only the named columns are read.
    """
    m = measure(docs, id_col=id_col, text_col=text_col, carry=carry)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    passed = F.expr(" AND ".join(r.sql() for r in rules) or "true")
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return m.select(F.col("id").alias(id_col), *shown, failed.alias("base_failed"), (~failed & passed).alias("kept"), *[F.col(f"carry_{c}").alias(c) for c in carry])
