"""MinHash near-dedup (operator 7): banded MinHash, odd sketches for candidates, exact sets for links.

Steps, each a table in the shared checkpoint folder where it is used again:

1. One pass over the texts makes each document's set of word shingles, and of it a 128-bit fingerprint, 128 MinHash
   samples folded into 32 bands, and an odd sketch (a 512-bit parity bitmap of the samples).
2. Documents of equal sets become one class. Copies cost a count from here on.
3. The least class of a band's bucket is its pivot; classes pair with the pivots of their buckets, never with each
   other. XOR population counts of odd sketches estimate similarities; each class's best pivots are confirmed on full
   sets, which joins most classes of a group.
4. Classes that share a pivot but not yet a component are compared all the same, under one rule for groups of any
   size: a group is cut into blocks of bounded bytes, sketches are compared for each pair of blocks, and the members
   that have a candidate there are compared on full sets, read once for each pair of blocks (once in all where the
   group is one block). A task returns a spanning forest of what it links, never the pairs.

Two classes of similarity 0.8 share no band with probability (1 - 0.8**4)**32 = 5e-8, and the sketch filter at 0.6
loses such a pair with a probability of about 1e-8. Reported links are always exact on sets of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexlore.llm.common import SPACE_CHARS, cut_lineage, free_shuffles, join_hot
from hexlore.llm.components import connected_components
from hexlore.llm.hashing import ODD, hash_runs, mix64, slices

BANDS, ROWS, SKETCH_BITS = 32, 4, 512
SAMPLES = BANDS * ROWS
#: Estimates below this are not confirmed; about five standard deviations under the threshold of 0.8.
SKETCH_SLACK = 0.2
#: The pivots on which a class is confirmed before the exhaustive step.
FIRST_PIVOTS = 3
#: Bytes of a block of a group, a member counting as its set and MEMBER_BYTES; a task compares two blocks.
BLOCK_BYTES, MEMBER_BYTES = 2_000_000, 1_000
#: Bytes of rows that a task gathers before it looks for whole pairs of blocks among them.
STREAM_BYTES = 2_000_000

_SEEDS = np.random.default_rng(7).integers(0, 2**32, SAMPLES, np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE_CHARS]] = True


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct 64-bit hashes of its runs of width words, A-Z lower-cased.

    Fewer words than width make one run of all; no words make an empty set.
    """
    joined = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
    space = _IS_SPACE[joined]
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    last = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    word = hash_runs(_LOWER[joined], first, last)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    ends = np.searchsorted(first, np.cumsum(sizes))
    out, begin = [], 0
    for end in ends.tolist():
        own = word[begin:end]
        begin = end
        if not len(own):
            out.append(np.empty(0, np.uint64))
            continue
        run = min(width, len(own))
        value = np.full(len(own) - run + 1, np.uint64(run))
        for k in range(run):
            value = mix64(value * ODD + own[k : len(own) - run + 1 + k])
        out.append(np.unique(value))
    return out


def samples(values: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set of 64-bit hashes."""
    least = np.full(SAMPLES, 2**32 - 1, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        x = short[at : at + 1024, None] ^ _SEEDS
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * ODD + least[k::ROWS].astype(np.uint64))
    return key.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity bitmap: each sample flips one bit, so samples that two sets share cancel out in the XOR."""
    spot = mix64((np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)) + least) % np.uint64(SKETCH_BITS)
    odd = np.bincount(spot.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the sets behind two odd sketches."""
    ones = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    flips = F.log(F.greatest(F.lit(1.0) - F.lit(2.0) * ones / SKETCH_BITS, F.lit(1e-9))) / float(np.log(1 - 2 / SKETCH_BITS))
    return F.lit(1.0) - flips / (2.0 * SAMPLES)


def octets(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Slices of a column of texts as lists of UTF-8 bytes, with their places."""
    for at, part in slices(column):
        yield at, pc.cast(part, pa.binary()).to_pylist()


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, th (hash of the text), n, fp, bands, sketch for each row; without words n is 0 and the rest null."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["id"], source.schema["th"], T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            n, fp, bands, sketch = [], [], [], []
            for _, part in octets(batch.column(2)):
                for values in shingle_sets(part, width):
                    n.append(len(values))
                    if not len(values):
                        fp.append(None), bands.append(None), sketch.append(None)
                        continue
                    least = samples(values)
                    fp.append(xxhash.xxh3_128_digest(values.tobytes()))
                    bands.append(band_keys(least))
                    sketch.append(odd_sketch(least))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, longs), pa.array(sketch, longs)],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """fp, shingles (packed 64-bit hashes) of the wanted classes (fp, id, th), from the texts they were made of."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    need = wanted.select("fp", F.col("id").alias("id_"), F.col("th").alias("th_"))
    found = texts.join(need, (F.col("th") == F.col("th_")) & F.col("id").eqNullSafe(F.col("id_"))).select("fp", "text")

    def run(batches):
        for batch in batches:
            for at, part in octets(batch.column(1)):
                sets = [v.tobytes() for v in shingle_sets(part, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(sets, pa.binary())], names=["fp", "shingles"])

    return found.mapInArrow(run, "fp binary, shingles binary").dropDuplicates(["fp"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left, right = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            # A few sets at a time become Python objects.
            ok: list[bool] = []
            for at in range(0, batch.num_rows, 64):
                sa, sb = (batch.column(k).slice(at, 64).to_pylist() for k in (2, 3))
                ok += [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(sa, sb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "a binary, b binary")


def dealt(open_: DataFrame) -> DataFrame:
    """The rows of open groups (p, blocks, fp, ...), each once for every pair of blocks (i <= j) that its own is in."""
    rows = open_.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def by_block_pair(rows: DataFrame, each, schema: str) -> DataFrame:
    """each(table) of the rows of every (p, i, j), as one stream per partition: groups may be very many and very small."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def results(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            table = table.combine_chunks()
            keys = [table.column(c).to_numpy(zero_copy_only=False) for c in ("p", "i", "j")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            ends = [*cuts.tolist(), *([table.num_rows] if last else [])]
            out, at = [], 0
            for end in ends:
                out.append(each(table.slice(at, end - at)))
                at = end
            return [t for t in out if t.num_rows], table.slice(at)

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= STREAM_BYTES:
                done, rest = results(pa.Table.from_batches(held), False)
                # What is left of a run waits for more, so that it is looked at a few times only.
                held, size = (rest.to_batches(), 0) if rest.num_rows else ([], 0)
                for t in done:
                    yield from t.to_batches()
        if held:
            for t in results(pa.Table.from_batches(held), True)[0]:
                yield from t.to_batches()

    return rows.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(run, schema)


def fixed_width(column: pa.ChunkedArray) -> np.ndarray:
    """A column of 16-byte values."""
    return np.frombuffer(b"".join(column.to_pylist()), "V16")


def candidates(rows: DataFrame, least_est: float, percent: int) -> DataFrame:
    """Of the dealt rows (with sketch and root) those with a candidate in their pair of blocks: another component's
    member of a similar size and sketch."""
    columns = ["p", "i", "j", "own", "fp", "root"]
    # The estimate falls with the number of bits that differ: at most so many for the least estimate.
    most_bits = int(np.floor(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - least_est))) + 1e-9))

    def each(table: pa.Table) -> pa.Table:
        n, own = table.column("n").to_numpy(), table.column("own").to_numpy()
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), -1)
        root = np.unique(fixed_width(table.column("root")), return_inverse=True)[1]
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        found = np.zeros(len(n), bool)
        for x in range(len(n) - 1):
            y = np.arange(x + 1, len(n))
            y = y[(root[y] != root[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])) & (within | (own[y] != own[x]))]
            hit = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1) <= most_bits]
            found[hit] = True
            found[x] |= len(hit) > 0
        return table.select(columns).filter(pa.array(found))

    return by_block_pair(rows, each, "p binary, i int, j int, own int, fp binary, root binary")


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join different components inside a pair of blocks, from rows (p, i, j, own, fp, root) and their sets."""

    def each(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        fp, root = fixed_width(table.column("fp")), np.unique(fixed_width(table.column("root")), return_inverse=True)[1]
        values = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        size = np.array([len(v) for v in values])
        code = np.unique(np.concatenate(values), return_inverse=True)[1]
        top = np.arange(int(root.max()) + 1)
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        holders = np.repeat(np.arange(len(values)), size)
        order = np.argsort(code, kind="stable")
        holders, starts = holders[order], np.searchsorted(code[order], np.arange(int(code.max()) + 2))
        begin = np.r_[0, np.cumsum(size)]
        out = []
        for x in range(len(values) - 1):
            apart = top[root] != top[root[x]]
            apart[: x + 1] = False
            if not within:
                apart &= own != own[x]
            if not apart.any():
                continue
            # Every other member's intersection with x, by way of x's shingles.
            mine = code[begin[x] : begin[x + 1]]
            both = np.bincount(np.concatenate([holders[starts[c] : starts[c + 1]] for c in mine.tolist()]), minlength=len(values))
            hit = apart & (100 * both >= percent * (size + size[x] - both))
            for y in np.flatnonzero(hit).tolist():
                u, v = top[root[x]], top[root[y]]
                if u != v:
                    top[top == max(u, v)] = min(u, v)
                    out.append((fp[x].tobytes(), fp[y].tobytes()))
        return pa.table({"a": pa.array([o[0] for o in out], pa.binary()), "b": pa.array([o[1] for o in out], pa.binary())})

    return by_block_pair(rows.join(sets, "fp"), each, "a binary, b binary")


def resolved(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """id, th, n, fp (null without words) of each row; and of each class fp, copies (its rows), rep (the least of id and th,
    nulls first), label (the least id) and root.

    A class is the rows of equal sets; root is the fingerprint of a class that stands for the component.
    """
    if percent < 80:
        raise ValueError("bands and sketches are set for similarities of 0.8 or more")
    least_est = percent / 100 - SKETCH_SLACK
    sig = cut_lineage(signatures(docs, id_col, text_col, width))
    facts = [F.any_value(c).alias(c) for c in ("n", "bands", "sketch")]
    classes = sig.where("n > 0").groupBy("fp").agg(F.min(F.struct("id", "th")).alias("rep"), F.min("id").alias("label"), F.count(F.lit(1)).alias("copies"), *facts)
    classes = cut_lineage(classes)

    # Different sets this small can't be similar enough.
    banded = classes.where((100 - percent) * F.col("n") >= percent).select(F.explode("bands").alias("band"), "fp")
    pivots = banded.groupBy("band").agg(F.min("fp").alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "p")
    # A class and the pivots of its buckets, the pivot itself included once it has company.
    grouped = cut_lineage(banded.join(pivots, "band").select("p", "fp").distinct())
    free_shuffles(docs.sparkSession)
    known = classes.select("fp", "n", "sketch")
    pivot_facts = grouped.groupBy("p").agg(F.count(F.lit(1)).alias("members")).join(known.select(F.col("fp").alias("p"), F.col("n").alias("pn"), F.col("sketch").alias("ps")), "p")
    rows = join_hot(grouped, cut_lineage(pivot_facts), "p", "members").join(known, "fp")
    grouped = cut_lineage(rows.select("p", "fp", "n", "sketch", F.when(sized("n", "pn", percent), estimate(F.col("sketch"), F.col("ps"))).alias("est")))

    first = grouped.where((F.col("p") != F.col("fp")) & (F.col("est") >= least_est))
    first = cut_lineage(best_pivots(first))
    free_shuffles(docs.sparkSession)
    handles = classes.select("fp", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"))
    wanted = first.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sets = cut_lineage(sets_of(docs, wanted.join(handles, "fp"), id_col, text_col, width))
    free_shuffles(docs.sparkSession)
    links = cut_lineage(confirm(first, sets, percent))
    free_shuffles(docs.sparkSession)
    roots = connected_components(links)

    # What shares a pivot without sharing a component.
    rooted = cut_lineage(grouped.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("p", "fp", "n", "sketch", F.coalesce("root", "fp").alias("root")))
    blocks = F.ceil(F.sum(8 * F.col("n") + MEMBER_BYTES) / BLOCK_BYTES).cast("int")
    split = rooted.groupBy("p").agg(F.min("root").alias("low"), F.max("root").alias("high"), blocks.alias("blocks"), F.count(F.lit(1)).alias("members")).where("low <> high")
    open_ = join_hot(rooted, cut_lineage(split.select("p", "blocks", "members")), "p", "members").where("blocks is not null")
    close = cut_lineage(candidates(dealt(open_), least_est, percent))
    free_shuffles(docs.sparkSession)
    more = cut_lineage(sets_of(docs, close.select("fp").distinct().join(handles, "fp"), id_col, text_col, width))
    free_shuffles(docs.sparkSession)
    found = cut_lineage(links.unionByName(block_links(close, more, percent)))
    roots = connected_components(found)
    free_shuffles(docs.sparkSession)

    tops = roots.select(F.col("node").alias("fp"), F.col("root").alias("top"))
    rooted = classes.select("fp", "copies", "rep", "label").join(tops, "fp", "left").select("fp", "copies", "rep", "label", F.coalesce("top", "fp").alias("root"))
    return sig.select("id", "th", "n", "fp"), cut_lineage(rooted)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Rows link when 100 * |intersection| >= percent * |union| of their sets of width-word shingles; component_id is the
    least id that links reach, kept says that it is the row's own. Texts without words (null, empty, blank) link with
    nothing: component_id is their own id, kept true. Rows of a null id take part; if a whole component has no id, its
    component_id is null and all its rows are kept (nothing tells them apart). Rows that repeat an id are rows of
    their own and, as copies do, share a component. percent from 80 on; below, the bands would lose links. An empty
    table gives no rows; of docs only id_col and text_col are read.
    """
    rows, classes = resolved(docs, id_col, text_col, width, percent)
    least = cut_lineage(classes.groupBy("root").agg(F.min("label").alias("component_id"), F.count(F.lit(1)).alias("members")))
    named = cut_lineage(join_hot(classes.select("fp", "copies", "root"), least, "root", "members").select("fp", "copies", "component_id"))
    rows = join_hot(rows, named, "fp", "copies")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    rows = rows.select("id", "n", component.alias("component_id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row left of each component of near-duplicates: that of the least id (null first), then text hash.

    Rows without words all stay. Where rows repeat that id and text, one of them stays.
    """
    columns = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    key, body = (f"c{columns.index(c)}" for c in (id_col, text_col))
    rows, classes = resolved(named, key, body, width, percent)
    first = classes.groupBy("root").agg(F.min("rep").alias("first")).select(F.col("first.id").alias("id_"), F.col("first.th").alias("th_"))
    counts = rows.where("n > 0").groupBy("id", "th").agg(F.count(F.lit(1)).alias("rows"))
    chosen = first.join(counts, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_"))).select("id", "th", "rows")
    chosen = cut_lineage(chosen.unionByName(rows.where("n = 0").select("id", "th", F.lit(1).cast("long").alias("rows")).distinct()))
    kept = named.withColumn("th_", F.xxhash64(body)).join(chosen, F.col(key).eqNullSafe(F.col("id")) & (F.col("th_") == F.col("th")))
    once = kept.where("rows = 1").select(*named.columns)
    repeated = kept.where("rows > 1").dropDuplicates([key, body]).select(*named.columns)
    return once.unionByName(repeated).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


def sized(n: str, m: str, percent: int) -> Column:
    """Whether sets of n and m could be similar enough at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def best_pivots(pairs: DataFrame) -> DataFrame:
    """a, b: each class (b) with its FIRST_PIVOTS pivots (a) of highest estimates, of at most BANDS."""
    own = pairs.groupBy("fp").agg(F.collect_list(F.struct((-F.col("est")).alias("e"), "p")).alias("all"))
    own = own.select("fp", F.explode(F.slice(F.array_sort("all"), 1, FIRST_PIVOTS)).alias("top"))
    return own.select(F.col("top.p").alias("a"), F.col("fp").alias("b"))
