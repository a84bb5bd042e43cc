import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlore.llm import packing
from hexlore.llm.common import table
from hexlore.llm.queries import vocabulary


def check(out, docs, capacity=2048):
    """Pieces are the documents' ids in order, sequences have no gaps and no overlaps."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rows = out.collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        for r in own:
            cut = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(cut) == r.length and r.ids_crc32 == zlib.crc32(cut.tobytes())
        assert sum(r.length for r in own) == len(ids)
    assert not by_doc
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), sum(r.length for r in rows)


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    n, total = check(packing.pack(docs, vocabulary()), [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.02 * total / 2048 + 1


@pytest.mark.parametrize("parts", [1, 32, 211])
def test_few_sequences_over_many_tasks(spark, parts):
    """Part-filled ends of tasks are filled from one another: within 1 % of the least number for any partitioning."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    n, total = check(packing.pack(docs.repartition(parts), vocabulary()), [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.01 * total / 2048 + 1


def test_second_pass_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    n, total = check(packing.pack(docs, vocabulary(), open_bins=16), [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.05 * total / 2048 + 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 2047), (4, "word " * 2048), (5, "word " * 9000), (6, "<|endoftext|> a"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("x"), "offset": F.lit(1)})
    check(packing.pack(docs, vocabulary()), rows)
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0
    twice = spark.createDataFrame([(7, "a b"), (7, "a b")], "doc_id long, text string")
    assert [r.length for r in packing.pack(twice, vocabulary()).collect()] == [3, 3]


def test_ids_come_back(spark):
    docs = spark.createDataFrame([(1, "hello world " * 700)], "doc_id long, text string")
    rows = sorted(packing.pack(docs, vocabulary(), capacity=512, with_ids=True).collect(), key=lambda r: r.piece)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows) and rows[-1].ids[-1] == 0


def test_best_fit_rule():
    """The piece goes to the fullest bin that takes it, against a search over all open bins."""
    rng = random.Random(4)
    bins = packing.BestFit(100, 8)
    open_ = {}
    for _ in range(3000):
        size = rng.randint(1, 100)
        fits = [room for room in open_.values() if room >= size]
        got, offset = bins.place(size)
        if fits:
            assert open_[got] == min(fits) and offset == 100 - min(fits)
        else:
            assert got not in open_ and offset == 0
            if size < 100 and len(open_) >= 8:
                gone = [b for b in open_ if open_[b] == min(open_.values())]
                live = {b for stack in bins.by_room for b in stack}
                closed = [b for b in gone if b not in live]
                assert len(closed) == 1
                del open_[closed[0]]
        open_[got] = open_.get(got, 100) - size
        if not open_[got]:
            del open_[got]
        assert bins.n_open == len(open_) <= 8
