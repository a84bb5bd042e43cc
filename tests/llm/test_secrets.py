import base64
import hashlib
import math
import random as stdlib_random
import re

from pyspark.sql import functions as F

from hexlore.llm import secrets
from hexlore.llm.common import table

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def expected(rows):
    out = []
    for doc, text in rows:
        spans = base(text)
        told = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        out.append((doc, *[sum(x[1] == k for x in spans) for k in range(3)], hashlib.sha256(told.encode()).hexdigest(), told))
    return sorted(out, key=str)


def same(df, rows):
    got = df.collect()
    want = expected(rows)
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, ",".join(x for x in r.spans.split(",") if x and not x.startswith("random"))) for r in got), key=str) == want
    return {r.doc_id: r.spans for r in got}


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").where("doc_id < 4000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    spans = same(secrets.digests(secrets.scan(docs)), rows)
    assert sum(bool(base(t)) for _, t in rows) > 20
    assert sum("random" in s for s in spans.values()) < 0.02 * len(rows)


def test_edges(spark):
    blob = "q7Zr+9Xk/2LmVt0pQsWb8YdHgJcN4fRe"
    texts = [None, "", "password=abcdef", "PassWord = 'abcde", "token=token: abcdefgh", "secret=token: abcdefgh", "api_key:\"A.b=c-d/e_f\"", "apikey := x", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIA" + "AKIA" * 5, "f" * 24, "F" * 24, "0" * 23 + " " + "a" * 25, "\U0001f600é password=" + "0123456789abcdef" * 2, "token='" + "a1" * 30 + "' token=" + "b2" * 5, "x" * 100_000 + " secret: zzzzzz " + "y" * 100_000, f"see {blob} there", "Donaudampfschifffahrtsgesellschaft internationalization_of_identifiers", "ſecret=abcdefgh", "secret\t=abcdefg", "a\nb passwd=zzzzzz\n", "password=abcdef password=abcdef"]
    rows = [*enumerate(texts), (None, "token=123456"), (2, "token=123456"), (2, "token=123456")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "h": F.lit("x"), "s_hex": F.lit(None)})
    same(secrets.digests(secrets.scan(docs)), rows)  # with models of these few rows
    sample = secrets.labelled_samples(table(spark, "/root/testdata/sf0.01", "documents"), id_col="doc_id", text_col="text", most_rows=500, n_random=500)
    spans = same(secrets.digests(secrets.scan(docs, model=secrets.train(sample))), rows)
    k = texts.index(f"see {blob} there")
    assert spans[k] == f"random:4:{4 + len(blob)}" and spans[k + 1] == ""


def test_parts_beside_base_spans_are_scored(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = secrets.train(secrets.labelled_samples(docs, id_col="doc_id", text_col="text", most_rows=500, n_random=500))
    hexed, blob = "0123456789abcdef" * 2, "Qz7Zr+9Xk/2LmVt0pQsWb8YdHgJKNZQRTqMxUw5I"
    texts = [f"{hexed}-{blob}", f"see {blob}/{hexed}/{blob} there", f"{hexed}-{blob[:10]}", f"token={blob}", f"{hexed} {blob}"]
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model=model)).collect()}
    assert got == {0: "hex:0:32,random:32:73", 1: "random:4:45,hex:45:77,random:77:118", 2: "hex:0:32", 3: "assign:0:46", 4: "hex:0:32,random:33:73"}
    out = secrets.redact(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), model=model)
    assert out.first().text == "[secret][secret]"


def plain_pairs(tokens):
    """Counts of adjacent characters, one added to each."""
    counts = [1.0] * 128 * 128
    for t in tokens:
        for a, b in zip(t, t[1:]):
            counts[ord(a) * 128 + ord(b)] += 1
    return counts


def plain_scan(rows, least_ratio=12.0, n_random=300):
    """Spans of all kinds from plain Markov models of a few documents, all of which are in the training sample."""
    long_runs = re.compile("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    random, other = [], []
    for _, text in rows:
        random += [t for t in [m[2] for m in ASSIGN.finditer(text)] + long_runs.findall(text) if len(t) >= 12]
        other += re.findall("[A-Za-z0-9+/_=-]{6,}", long_runs.sub(" ", ASSIGN.sub(" ", text)))
    for k in range(n_random):
        digest = hashlib.sha256(str(k).encode()).hexdigest()
        random += [digest, base64.b64encode(bytes.fromhex(digest)).decode()]
    counts = [plain_pairs(x) for x in (random, other)]
    total = [[sum(c[a * 128 : a * 128 + 128]) for a in range(128)] for c in counts]
    model = [round(math.log(counts[0][p] / total[0][p // 128]) - math.log(counts[1][p] / total[1][p // 128]), 4) for p in range(128 * 128)]
    out = {}
    for k, text in rows:
        spans = base(text)
        covered = [False] * len(text)
        for s, _, e in spans:
            covered[s:e] = [True] * (e - s)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", text):
            at = m.start()
            while at < m.end():
                end = at
                while end < m.end() and not covered[end]:
                    end += 1
                token = text[at:end]
                if len(token) >= 12 and sum(model[ord(a) * 128 + ord(b)] for a, b in zip(token, token[1:])) >= least_ratio:
                    spans.append((at, 3, end))
                at = end + 1
        out[k] = ",".join(f"{secrets.KINDS[kind]}:{s}:{e}" for s, kind, e in sorted(spans))
    return out


def test_spans_equal_plain_models(spark):
    """All spans of a table with keys of 12 characters and more among its words, against plain Markov models."""
    rng = stdlib_random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 300").select("doc_id", "text")
    rows = []
    for r in docs.collect():
        words = r.text.split(" ")
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randrange(len(words) + 1), "".join(rng.choice(alphabet) for _ in range(rng.randint(8, 40))))
        if r.doc_id % 9 == 0:
            words.append("token=" + "".join(rng.choice(alphabet) for _ in range(20)) + ",0123456789abcdef0123456789abcdef")
        rows.append((r.doc_id, " ".join(words)))
    want = plain_scan(rows)
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), n_random=300)).collect()}
    assert got == want and sum("random" in s for s in want.values()) > 50


def test_models_tell_random_strings_apart(spark):
    """Held-out strings of other alphabets' mixes and other words."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = secrets.train(secrets.labelled_samples(docs, id_col="doc_id", text_col="text", most_rows=500, n_random=500))
    rnd = [base64.b64encode(hashlib.sha512(str(k).encode()).digest())[:32].decode() for k in range(300)]
    words = [w for (t,) in docs.select("text").where("doc_id >= 500").collect() for w in re.findall("[A-Za-z]{8,}", t)]
    plain = ["_".join(words[k : k + 4])[:60] for k in range(0, 1200, 4)]
    df = spark.createDataFrame([(t, True) for t in rnd] + [(t, False) for t in plain], "t string, random boolean")
    rate = {r.random: r.share for r in df.groupBy("random").agg(F.avg((secrets.likelihood_ratio(F.col("t"), model) >= 12).cast("double")).alias("share")).collect()}
    assert rate[True] > 0.99 and rate[False] < 0.01


def test_redact_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a password=abcdef b", "x"), (2, None, "y"), (3, "token=0123456789abcdef0123456789abcdef!", None), (4, "clean", "z")], "doc_id long, text string, spans string")
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a [secret] b", "x"), (2, None, "y"), (3, "[secret]!", None), (4, "clean", "z")]


def test_empty(spark):
    assert secrets.digests(secrets.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
