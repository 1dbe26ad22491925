"""The leak scan against a plain search of every term in every text."""

import random
import re

import pytest

from sluice.operators import audits as A

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def plain(texts, terms, benign=()):
    low = {t.lower() for t in terms if t and len(t) >= 4 and not t.isdigit()} - {b.lower() for b in benign}
    out = {(f, t, False) for f, text in texts for t in low if text and t in text.lower()}
    return out | {(f, None, True) for f, text in texts if text and EMAIL.search(text)}


@pytest.mark.parametrize("budget", [1 << 20, 60])
def test_terms_of_several_words_and_overlaps(spark, budget):
    rng = random.Random(budget)
    words = ["quux", "widget", "labs", "ab", "cde", "1234", "Straße", "é", "quuxwidget"]
    terms = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["abcd", "bcd ", "abcdabcd", None, "12345", "Applied"]
    texts = [(f"f{i % 9}", "".join(rng.choice([*words, " ", "  ", "abcd", "x@y.zz", "Applied", "QUUX widget"]) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [("n", None), ("f1", "")]
    found = A.leaks(spark.createDataFrame(texts, "file string, text string"), spark.createDataFrame([(t,) for t in terms], "term string"), ["applied"], budget=budget)
    assert {tuple(r) for r in found.collect()} == plain(texts, terms, ["applied"]) and found.count() == found.distinct().count()


def test_report(spark):
    texts = spark.createDataFrame([("a.json", '{"x": 1}'), ("b.json", "quuxwidget labs"), ("c.md", "ping someone@example.com"), ("d.md", "Applied LinkedIn")], "file string, text string")
    terms = spark.createDataFrame([("Quuxwidget Labs",), ("Applied",), ("LinkedIn",)], "term string")
    found = A.leak_report(A.leaks(texts, terms, ["Applied", "linkedin"]))
    assert {tuple(r) for r in found.collect()} == {("b.json", 1, False), ("c.md", 0, True)}
    assert A.leaks(texts, terms.limit(0)).collect() == [("c.md", None, True)]


def test_no_text_in_a_shuffle(spark):
    texts = spark.createDataFrame([("a", "some text")], "file string, text string")
    plan = A.leaks(texts, spark.createDataFrame([("text",)], "term string"))._jdf.queryExecution().toString()
    exchange = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "Exchange" in line]
    assert exchange and all("text" not in line for line in exchange)
