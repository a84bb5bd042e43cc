"""Quality classifier (operator 3): ordinal cumulative-link regression over hashed text.

Ratings are grades 0 < 1 < ... < K. One weight vector over hashed words and a few word-shape shares gives a document's
score s; ordered thresholds t_1 < ... < t_K turn it into P(grade < k) = sigmoid(t_k - s) for all grades at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexlore.llm.common import SPACE_CHARS
from hexlore.llm.hashing import hash_runs
from hexlore.llm.neardup import _IS_SPACE, _LOWER, octets

#: Hashed features; the first SHAPES * STEPS belong to word shapes.
FEATURES = 1 << 18
STEPS = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]~^=_\\/@+"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[ord("!"), ord("?")]] = True
SHAPES = 6
#: Bytes of a word's beginning that are features of their own, as stems are.
PREFIXES = (5, 7)
#: Bytes between the words that are hashed: all of ASCII but letters and digits.
_GAP = np.ones(256, bool)
_GAP[128:] = _GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the texts, flat, and how many each text has: its distinct words,
    those without ASCII signs, the beginnings of these, and one step per shape.

    Shapes are shares of words: with symbols, in capitals, with repeated shout marks, equal to the word before, met
    before, without letters. A text without words has only the steps for shares of zero.
    """
    joined = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
    low = _LOWER[joined]
    borders = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))

    def hashes(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (hash_runs(low, first, last) % np.uint64(FEATURES - SHAPES * STEPS)).astype(np.int64) + SHAPES * STEPS

    def runs(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.flatnonzero(~gap & np.r_[True, gap[:-1]]), np.flatnonzero(gap & np.r_[False, ~gap[:-1]])

    bare_first, bare_last = runs(_GAP[joined])
    stems = np.stack([hashes(bare_first, np.minimum(bare_last, bare_first + n)) for n in (*PREFIXES, len(joined))], axis=1)
    bare_ends = np.searchsorted(bare_first, borders)
    first, last = runs(_IS_SPACE[joined])
    word = hashes(first, last)

    def per_word(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag[joined])]
        return total[last] - total[first]

    n_upper, n_letter = per_word(_UPPER), per_word(_LETTER)
    marks = np.stack([per_word(_SYMBOL) > 0, (n_upper >= 2) & (n_upper * 2 > n_letter), per_word(_SHOUT) > 1, np.r_[False, word[1:] == word[:-1]][: len(word)], np.zeros(len(word), bool), n_letter == 0])
    ends = np.searchsorted(first, borders)
    counts = np.cumsum(marks, axis=1)
    flat, sizes, begin, bare_begin = [], [], 0, 0
    for end, bare_end in zip(ends.tolist(), bare_ends.tolist(), strict=True):
        own = np.unique(word[begin:end])
        n = max(1, end - begin)
        share = (counts[:, end - 1] - (counts[:, begin - 1] if begin else 0)) / n if end > begin else np.zeros(SHAPES)
        share[4] = 1 - len(own) / n if end > begin else 0
        step = np.minimum(STEPS - 1, np.ceil(np.sqrt(np.maximum(0, share)) * (STEPS - 1))).astype(np.int64)
        flat.append(np.r_[np.arange(SHAPES) * STEPS + step, np.unique(np.r_[own, stems[bare_begin:bare_end].ravel()])])
        sizes.append(len(flat[-1]))
        begin, bare_begin = end, bare_end
    return np.concatenate(flat) if flat else np.empty(0, np.int64), np.array(sizes, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(self.weights[flat], dtype=np.float64)]
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to K."""
        return 1 - sigmoid(self.thresholds[None, :] - scores[:, None])


def slopes(scores: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The derivatives of the sum of -log P(grade) by each row's score, and by each threshold."""
    k = len(thresholds)
    t = np.r_[-np.inf, thresholds, np.inf]
    pl, ph = sigmoid(t[grades] - scores), sigmoid(t[grades + 1] - scores)
    p = np.maximum(ph - pl, 1e-9)
    dl, dh = pl * (1 - pl) / p, ph * (1 - ph) / p
    return dh - dl, np.bincount(grades, weights=-dh, minlength=k + 1)[:k] + np.bincount(grades, weights=dl, minlength=k + 1)[1:]


def fit(
    flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int, *, epochs: int = 25, batch: int = 256, rate: float = 0.3,
    shrink: float = 5e-4, least_rows: int = 5, seed: int = 42,
) -> Ordinal:
    """Maximum likelihood with AdaGrad and soft thresholding of weights; a first threshold and positive steps keep the thresholds in order.

    Features of fewer than least_rows rows keep the weight zero, as one text would set them.

    Without rows every grade below the top has probability zero, so that nothing is rejected for want of ratings.
    """
    k = n_grades - 1
    model = Ordinal(np.zeros(FEATURES), np.full(k, -60.0))
    if not len(grades):
        return model
    below = np.array([(np.sum(grades < g) + 0.5) / (len(grades) + 1) for g in range(1, n_grades)])
    start = np.log(below / (1 - below))
    free = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    cuts = lambda f: np.cumsum(np.r_[f[0], np.exp(f[1:])])
    w, gw, gf = model.weights, np.full(FEATURES, 1e-3), np.full(k, 1e-3)
    common = np.bincount(flat, minlength=FEATURES)[flat] >= least_rows
    sizes = np.add.reduceat(common.astype(np.int64), np.cumsum(sizes) - sizes)  # every row has its shape features
    flat = flat[common]
    begins = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(grades))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            n = sizes[rows]
            index = flat[np.repeat(begins[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            total = np.r_[0.0, np.cumsum(w[index])]
            ds, dt = slopes(total[np.cumsum(n)] - total[np.cumsum(n) - n], cuts(free), grades[rows])
            ds = ds / len(rows)
            used, back = np.unique(index, return_inverse=True)
            g = np.bincount(back, weights=np.repeat(ds, n))
            gw[used] += g * g
            step = rate / np.sqrt(gw[used])
            moved = w[used] - step * g
            w[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * shrink)
            tail = np.cumsum(dt[::-1])[::-1] / len(rows)
            df = np.r_[tail[0], tail[1:] * np.exp(free[1:])]
            gf += df * df
            free -= rate * df / np.sqrt(gf)
    model.thresholds = cuts(free)
    return model


def train(docs: DataFrame, grades: DataFrame, n_grades: int, *, id_col: str, text_col: str, most_rows: int, most_bytes: int) -> Ordinal:
    """Fits on rated documents, at most most_rows of them and most_bytes of their texts, in order of hashes of their ids.

    grades has (id, grade). Which documents these are is told from ids, hashes and sizes alone; then only theirs are
    read for features. Rows that repeat both id and text count once, so what reaches the driver is bounded.
    """
    spark = docs.sparkSession
    picked = grades.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    facts = texts.select("id", F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    facts = facts.join(F.broadcast(picked), "id").groupBy("id", "grade", "th").agg(F.max("bytes").alias("bytes"))  # most_rows ids
    chosen, held = [], 0
    for r in facts.orderBy(F.xxhash64("id"), "id", "th").limit(most_rows).collect():
        held += r.bytes
        if chosen and held > most_bytes:
            break
        chosen.append((r.id, r.th, r.grade))
    if not chosen:
        return fit(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), n_grades)
    wanted = spark.createDataFrame(
        chosen,
        T.StructType([T.StructField("id_", facts.schema["id"].dataType), T.StructField("th_", T.LongType()), T.StructField("grade", T.IntegerType())]),
    )
    rated = texts.join(F.broadcast(wanted), (F.col("id") == F.col("id_")) & (F.xxhash64("text") == F.col("th_"))).select("id", "th_", "grade", "text")

    def run(batches):
        for batch in batches:
            for at, part in octets(batch.column(3)):
                flat, sizes = features(part)
                cut = np.split(flat.astype(np.int32), np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(at, len(part)) for k in range(3)), pa.array([c.tobytes() for c in cut], pa.binary())],
                    names=["id", "th_", "grade", "features"]
                )

    schema = T.StructType([rated.schema["id"], rated.schema["th_"], rated.schema["grade"], T.StructField("features", T.BinaryType())])
    rows = rated.mapInArrow(run, schema).groupBy("id", "th_", "grade").agg(F.any_value("features").alias("features")).collect()
    rows = sorted(rows, key=lambda r: (r.id, r.features))
    sizes, levels = np.array([len(r.features) // 4 for r in rows], np.int64), np.array([r.grade for r in rows], np.int64)
    flat = np.frombuffer(b"".join(r.features for r in rows), np.int32)
    rows.clear()
    return fit(flat, sizes, levels, n_grades)


def graded(labels: DataFrame) -> DataFrame:
    """id, grade of rated documents: 0 poor, 1 sound but toxic, 2 sound and clean; of several ratings the lowest counts."""
    grade: Column = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(F.col("doc_id").alias("id"), grade.alias("grade")).where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))


def rate(
    docs: DataFrame, grades: DataFrame, *, n_grades: int = 3, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 8000,
    most_bytes: int = 32_000_000, least_tail: float = 0.5, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: id, expected_grade, tail_probability (of the top grade), kept (and the columns in carry).

    kept is tail_probability >= least_tail. Null texts are empty; null and repeated ids are carried as they are; an
    empty table of documents gives no rows, an empty table of grades keeps all. Whole texts are read, in training and
    in scoring; most_rows and most_bytes bound the rated documents that are fitted. Further columns are not read.
    """
    model = train(docs, grades, n_grades, id_col=id_col, text_col=text_col, most_rows=most_rows, most_bytes=most_bytes)
    model.weights = model.weights.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES single-precision numbers: 1 MB
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    told = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *told, *[T.StructField(c, source.schema[f"carry_{c}"].dataType) for c in carry]])

    def run(batches):
        for batch in batches:
            tail, mean = [np.empty(0)], [np.empty(0)]
            for _, part in octets(batch.column(1)):
                p = shared.value.at_least(shared.value.scores(*features(part)))
                tail.append(p[:, -1])
                mean.append(p.sum(axis=1))
            tail, mean = np.concatenate(tail), np.concatenate(mean)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mean), pa.array(tail), pa.array(tail >= least_tail), *batch.columns[2:]], names=schema.names)

    return source.mapInArrow(run, schema)


assert len(SPACE_CHARS) == int(_IS_SPACE.sum())
