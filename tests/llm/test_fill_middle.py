"""Fill-in-the-middle against a plain version: units, positions, forms, and the way back."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxloom.llm import fill_middle as fim

ALPHABET = ["a", "b", " ", "\n", "\t", "é", "𝒳", "😀", "́", "‍", "\r", "<", "P", "S", "M", ">", "$", "\\"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    short = ["".join(r.choices(ALPHABET, k=r.randint(0, 25))) for _ in range(500)]
    odd = [None, "", "\n", "\n\n", "x", "😀", "😀😀", "<P>", "a<S>b", "<M", "<<P", "<P >"]
    return odd + short + ["ab 𝒳\n" * 40_000]


def rows(spark, texts):
    """Documents with columns whose names clash with the operator's own."""
    held = [(i, t, "x", "y", 1, "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(held, "doc_id long, text string, pieces string, form string, n long, prefix string")


def plain_version(doc_id, text, plain_percent=10, spm_percent=20):
    t = text or ""
    n = len(t)
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_examples_equal_a_plain_version(spark, texts):
    found = fim.digests(fim.fill_in_middle(rows(spark, texts))).collect()
    assert len(found) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in found:
        n, form, p, m, out = plain_version(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r)[1:] == (n, form, p, m, sha(out), sha(texts[r["doc_id"]] or "")), texts[r["doc_id"]]
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(
    ("grammar", "pattern"),
    [(fim.CODE_POINTS, r"(?s)."), (fim.WORDS, r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), (fim.LINES, r"[^\n]*\n|[^\n]+")],
)
def test_pieces_are_the_grammar_s_units(spark, texts, grammar, pattern):
    found = rows(spark, texts).select("doc_id", fim.pieces(F.col("text"), grammar).alias("p")).collect()
    for r in found:
        assert r["p"] == re.findall(pattern, texts[r["doc_id"]] or "")


@pytest.mark.parametrize("grammar", [fim.WORDS, fim.LINES])
def test_other_grammars_keep_the_text(spark, texts, grammar):
    made = fim.fill_in_middle(rows(spark, texts), grammar, plain_percent=0, spm_percent=50)
    found = made.select("doc_id", "form", "middle", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert all(r["text"] == (texts[r["doc_id"]] or "") for r in found)
    assert len(Counter(r["form"] for r in found)) == 3


def test_null_ids_repeats_and_an_empty_table(spark):
    held = spark.createDataFrame([(None, "some text"), (None, "some text"), (4, "abc"), (4, "abc"), (4, "xyz")], "doc_id long, text string")
    found = list(map(tuple, fim.digests(fim.fill_in_middle(held)).collect()))
    nameless = [r for r in found if r[0] is None]
    assert len(found) == 5 and len(nameless) == 2 and nameless[0] == nameless[1]
    assert nameless[0][1:5] == plain_version(None, "some text")[:4]
    assert fim.digests(fim.fill_in_middle(held.limit(0))).collect() == []
