"""Quality rules with limits of their own: counts by plain loops, sketches that merge, fences."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from halyard.llm import adaptive_rules as R
from tests.llm.frames import no_documents, odd_documents

WHITE = " \t\n\x0b\x0c\r"


def plain(text):
    """The counts by loops over characters."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in WHITE:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    lines, seen, again = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated), lines


def test_counts_against_plain_loops():
    draw = random.Random(1)
    pieces = ["a", "b", "été", "漢字", "x#y", "\n", " ", "\t", " ", "$$", " ", "\x1c", "A"]
    texts = ["", " \n ", "a a a a", "a b a b a b", "a b c\na b c\n\na b c ", "   "]
    texts += ["".join(draw.choices(pieces, k=draw.randint(0, 200))) for _ in range(200)]
    for t in texts:
        assert R.measure(t.encode()) == plain(t), repr(t)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def clean(draw, n=80):
    return " ".join("".join(draw.choices("abcdefghij", k=draw.randint(3, 7))) for _ in range(n))


def test_sketches_are_the_same_however_rows_lie_and_merge(spark):
    draw = random.Random(2)
    rows = [(i, clean(draw) + "#" * draw.randint(0, 9), draw.choice(["en", "de", None]), draw.choice("ab")) for i in range(200)]
    one = R.measured(docs_of(spark, rows), "doc_id", "text", "lang", "source")
    sort = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole = sort(R.sketches(one))
    assert whole == sort(R.sketches(one.repartition(7, "id")))
    parts = [R.sketches(one.where(F.col("id") % 3 == k)) for k in range(3)]
    added = parts[0].union(parts[1]).union(parts[2])
    assert whole == sort(R.merged(added, ["lang", "source"]).select("lang", "source", "rate", "bucket", "n"))


def test_quantiles_are_near(spark):
    draw = random.Random(3)
    rows = [(i, clean(draw, draw.randint(60, 90)) + " " + "#" * draw.randint(0, 400), "en", "a") for i in range(400)]
    measures = R.measured(docs_of(spark, rows), "doc_id", "text", "lang", "source")
    symbols = R.RATES[0]
    found = R.fences(R.sketches(measures, [symbols]), ["lang"], [symbols], factor=1).first()
    values = np.array([r.v for r in measures.select(F.expr(symbols.sql).alias("v")).collect()])
    q1, q3 = np.percentile(values, [25, 75], method="inverted_cdf")
    assert found.rows == 400
    assert abs(found.limits["symbols"]["high"] - (q3 + max(q3 - q1, symbols.spread))) <= 3 * q3 / 64


def test_limits_follow_language_and_source(spark):
    draw = random.Random(4)
    marked = " ".join(["x#y"] * 12)
    rows = [(i, clean(draw), "en", "plain") for i in range(300)]
    rows += [(1000 + i, clean(draw) + " " + marked, "en", "code") for i in range(300)]
    rows += [(2000, clean(draw) + " " + marked, "en", "plain"), (2001, clean(draw) + " " + marked, "en", "code")]
    rows += [(3000, clean(draw) + " " + marked, "fr", None), (3001, clean(draw) + " ####" * 60, "fr", None)]
    kept = {r.id: r.kept for r in R.judged(docs_of(spark, rows), "doc_id", "text", "lang", "source").collect()}
    assert not kept[2000] and kept[2001]  # the same marks, another source
    assert kept[3000] and not kept[3001]  # a small group takes the limits of the corpus
    assert sum(kept[i] for i in range(300)) == 300


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = R.judged(docs, "doc_id", "text", "lang", "source").join(labels, F.col("id") == F.col("doc_id"))
    share = {r.quality: r for r in found.groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept"), F.avg((F.col("kept") | F.col("base_failed")).cast("int")).alias("spared")
    ).collect()}
    assert share[1].spared > 0.99 and share[0].kept < 0.02


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    found = R.judged(odd, "doc_id", "text", "lang", "source").collect()
    counts = sorted((r.id if r.id is not None else -1, *(r[c] for c in R.COUNTS)) for r in found)
    assert counts == sorted((r.doc_id if r.doc_id is not None else -1, *plain(r.text)) for r in odd.collect())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert not any(r.kept for r in found if r.base_failed)
    assert R.judged(no_documents(spark), "doc_id", "text", "lang", "source").count() == 0
