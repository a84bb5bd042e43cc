"""Each stage of the pipeline on its own input, and the whole against its stages."""

import pytest
from pyspark.sql import functions as F

from hexlore.llm import neardup, quality, secrets
from hexlore.llm.common import table
from tests.llm.test_neardup import brute
from tests.llm.test_secrets import base

pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The table that each stage is given and the last one's result."""
    out, docs = [], table(spark, D, "documents")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, D).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_decides(spark, stages):
    want = {r.doc_id for r in quality.rate(stages[0], quality.graded(table(spark, D, "labels"))).where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == want and len(want) < stages[0].count()
    assert stages[1].subtract(stages[0]).count() == 0


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    sets = brute_five(rows)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(k for k, kept in sets if kept)


def brute_five(rows):
    from tests.llm import test_neardup

    plain = test_neardup.word_set
    test_neardup.word_set = lambda text, width=5: plain(text, 5)
    try:
        return [(k, kept) for k, _, _, kept in brute(rows)]
    finally:
        test_neardup.word_set = plain


def test_secrets_are_masked(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        old = before.pop(r.doc_id)
        if not base(old) and "[secret]" not in r.text:
            assert r.text == old
        for s, _, e in base(old):
            assert old[s:e] not in r.text
        assert r.n_chars == len(r.text)
    assert not before


def test_mix_is_near_its_size(stages):
    n = lambda df: df.agg(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))).first()[0]
    assert abs(n(stages[4]) / n(stages[3]) - 1.5) < 0.1
    assert stages[4].distinct().subtract(stages[3]).count() == 0


def test_packing_holds_all(stages):
    pieces = stages[5]
    assert pieces.where("piece = 0").count() == stages[4].count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_gives_the_same(spark, stages):
    got = pipeline.run(spark, D).select("doc_id", "piece", "start", "length", "ids_crc32")
    want = stages[5].select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_an_empty_corpus(spark):
    docs = table(spark, D, "documents").limit(0)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, D)
        assert docs.count() == 0


def test_stages_take_odd_rows(spark):
    """Nulls in any column, repeated rows, ties, very long texts, and further columns with names that stages use."""
    long = " ".join(f"long{k}" for k in range(30_000))
    clean = next(r.text for r in table(spark, D, "documents").collect() if 300 < len(r.text) < 2000)
    rows = [(1, clean, "en", "a", 5), (1, clean, "en", "a", 5), (None, clean + " tail", None, None, None), (None, None, None, None, None), (None, None, None, None, None), (2, "", "en", "", 0), (3, long, "en", "a", 1), (4, "x token=abcdefgh1234 y", "en", "b", None), (4, " \n", "en", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = {"kept": F.lit("k"), "id": F.lit(1), "th": F.lit(None).cast("string"), "root": F.lit("r"), "u": F.lit(0.5), "spans": F.lit("s"), "copies": F.lit(9), "sequence_id": F.lit("q"), "same": F.lit(3)}
    docs = docs.withColumns(odd)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r.kept == "k" and r.sequence_id == "q" and r.same == 3 for r in got), name
        if name == "quality classifier":
            assert sum(r.text is None for r in got) in (0, 2) and sum(r.text == clean for r in got) in (0, 2)
        if name == "near-duplicates":
            # The copies are one, with or without their tail; what has no words all stays.
            assert sorted((r.text or "")[:5] for r in got) == sorted([clean[:5], "", "", "", "long0", "x tok", " \n"])
        if name == "secret scans":
            assert len(got) == len(rows) and "x [secret] y" in {r.text for r in got} and sum(r.text is None for r in got) == 2
        if name == "mixing":
            n = {}
            for r in got:
                n[r.doc_id, r.text, r.source] = n.get((r.doc_id, r.text, r.source), 0) + 1
            assert all(v <= 4 for v in n.values())
    packed = pipeline.STAGES[-1][1](spark, docs, D)
    assert packed.where("piece = 0").count() == len(rows) and packed.count() > len(rows)


def test_mixing_stage_by_brute_force(spark, stages):
    """The rows that the stage gives, source by source, against the plain draw of the operator's test."""
    from tests.llm.test_mixing import fill, plain_draw

    docs = [r for r in stages[3].collect()]
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    want = {}
    for source, target in fill(sizes).items():
        rows = [(r.doc_id, r.text) for r in docs if r.source == source]
        whole = int(target / max(sizes[source], 1))
        more = plain_draw(rows, target - whole * sizes[source], 42)[0] if whole < 2 else set()
        want |= {k: whole + (k in more) for k, _ in rows}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_planted_copies_and_secrets(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text), (2, text), (3, text + " more"), (4, " ".join(f"other{k}" for k in range(60))), (5, "my password=hunter2hunter2 ok")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in neardup.deduplicated(docs).collect()) == [1, 4, 5]
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()}[5] == "my [secret] ok"
