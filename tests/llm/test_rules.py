import re

from pyspark.sql import functions as F

from hexlore.llm import rules
from hexlore.llm.common import table


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {k + i for at in seen.values() if len(at) > 1 for k in at for i in range(8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def check(df, rows):
    got = df.collect()
    want = []
    for doc, text in rows:
        m = measures(text)
        want.append((doc, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got)
    return got


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = check(rules.judge(docs), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    kept = {r.doc_id: r.kept for r in got}
    good = [r.doc_id for r in table(spark, "/root/testdata/sf0.01", "labels").where("quality = 1").collect()]
    failed = {r.doc_id for r in got if r.base_failed}
    assert all(kept[k] for k in good if k not in failed)
    poor = [r.doc_id for r in table(spark, "/root/testdata/sf0.01", "labels").where("quality = 0").collect()]
    assert sum(kept[k] for k in poor) < 0.2 * len(poor)


def test_edges(spark):
    para = " ".join(f"w{k}" for k in range(40))
    texts = [None, "", " \n\t ", "one", para, f"{para} {para}", f"{para}\n{para}\n\n \n{para}", "a " * 30, "a b c d e f g h x a b c d e f g h", "z\x85y\u2028q \xa0 w", "#*$%&|<>" * 30, "l\r\nl\r\nl\n", "ab " * 40_000, " ".join(f"u{k}" for k in range(30_000)), "é\U0001f600 " * 9, "1 2 3 4 5 6 7 8"]
    rows = [*enumerate(texts), (None, para), (4, para), (4, para)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "w": F.lit(1), "g": F.lit(None), "kept": F.lit(True)})
    check(rules.judge(docs), rows)


def test_empty(spark):
    assert rules.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
