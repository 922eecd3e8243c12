"""op13 against a plain version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import middle


def plain_version(i, text, percent=100, pattern=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(pattern, text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (i, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    dealt = random.Random(1)
    made = [(i, "".join(dealt.choice("a\n b\U0001f600é\r<S") for _ in range(dealt.randrange(60)))) for i in range(200)]
    return [*made, (None, "a\nb"), (None, None), (500, None), (501, ""), (502, "x<P>y\nz"), (503, "\n" * 5000), (504, "line\n" * 30000), (505, "q" * 9000), (3, made[3][1]), (3, "other\ntext")]


@pytest.mark.parametrize("size", [3, 7, middle.CHUNK])
def test_lines(spark, size):
    rows = texts()
    docs = spark.createDataFrame([(*r, "clash", "kept") for r in rows], "doc_id long, text string, form string, source string")
    out = middle.fill_in_middle(docs, size=size).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out] == [plain_version(*r) for r in rows]
    assert all(r.back == (r.text or "") and r.source == "kept" for r in out)


def test_words_and_rate(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = middle.fill_in_middle(docs, unit="word", percent=40, size=11).collect()
    # a word takes the white space after it; white space at the start is a unit of its own
    pattern = r"(?s)[ \t-\r]+(?=[^ \t-\r])|[^ \t-\r]+[ \t-\r]*|[ \t-\r]+"
    assert [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out] == [plain_version(*r, 40, pattern) for r in rows]
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert middle.fill_in_middle(none).count() == 0
