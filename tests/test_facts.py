"""Words that facts are matched by."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import facts
from tracewell.functions.text import NUMBER_NAMES
from tracewell.operators import reports

SMALL, TENS = NUMBER_NAMES[:20], dict(zip(range(20, 100, 10), NUMBER_NAMES[20:], strict=True))


def spelt(n, r):
    if n < 20:
        return SMALL[n]
    if n < 100:
        ten = TENS[n - n % 10]
        return ten if n % 10 == 0 else ten + r.choice(["-", " ", ""]) + SMALL[n % 10]
    unit, name = (1000, "thousand") if n >= 1000 else (100, "hundred")
    head = f"{spelt(n // unit, r)} {name}"
    return head if n % unit == 0 else head + r.choice([" ", " and "]) + spelt(n % unit, r)


def read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r["w"] for r in df.select("i", facts.fact_words(F.col("text")).alias("w")).orderBy("i").collect()]


def test_numbers_in_words(spark):
    cases = {
        "rises to twelve": "rises to 12", "zero": "0", "forty two": "42", "Forty-Two": "42", "one hundred": "100", "one hundred and twenty": "120", "eight hundred forty milliseconds": "840 ms",
        "two thousand and forty eight": "2048", "four thousand four hundred seven": "4407", "twelve thousand": "12000", "nine hundred ninety-nine thousand nine hundred ninety-nine": "999999",
        "10 32": "10 32", "one two three": "1 2 3", "twelve twelve": "12 12", "forty twelve": "40 12", "a hundred frames": "a hundred frames", "thousand": "thousand", "one hundred and": "100 and",
        "two hundred three hundred": "203 hundred", "fortyzero": "fortyzero", "twelve 12": "12 12", "zero hundred": "0 hundred", "one thousand two thousand": "1002 thousand", "one hundred and and two": "100 and and 2",
        "twenty and two": "20 and 2", "": "", "1,250.50 seconds": "1250.5 s", "E-409!": "e409", "one hundred thousand and one": "100001", "hundred one hundred": "hundred 100",
    }
    assert [" ".join(w) for w in read(spark, list(cases))] == list(cases.values())
    assert read(spark, [None]) == [None]


@pytest.mark.parametrize("seed", [1, 2])
def test_generated_numbers(spark, seed):
    r = random.Random(seed)
    numbers = [r.choice([r.randrange(1_000_000), r.randrange(1000), 1000 * r.randrange(1, 1000)]) for _ in range(700)]
    texts = [f"so {spelt(n, r)} it is" for n in numbers]
    assert read(spark, texts) == [["so", str(n), "it", "is"] for n in numbers]


def test_terms_and_clock_times(spark):
    yes = [("twelve", "the depth is 12"), ("840 milliseconds", "the line reaches eight hundred forty milliseconds"), ("120", "stays at one hundred and twenty"), ("10:32", "at 10.32"), ("10:32", "at 10:32:00"), ("10:30", "at 10.30")]
    no = [("twelve", "it is 120"), ("10:32", "10 and 32"), ("", "anything"), ("1:234", "1.234"), ("ratio 3:2", "ratio 3.2")]
    df = spark.createDataFrame([(*x, True) for x in yes] + [(*x, False) for x in no], "term string, text string, want boolean")
    assert [r["term"] for r in df.where(facts.states(F.col("text"), F.col("term")) != F.col("want")).collect()] == []
    times = spark.createDataFrame([("9:05 and 19:59:10",), ("123:45",), ("7:5",), ("a1:30",)], "t string").select(facts.time_alternative(F.col("t"))).collect()
    assert [r[0] for r in times] == ["9.05 and 19.59.10", None, None, None]


def test_facts_stated_in_words(spark):
    second = 1_000_000
    stated = spark.createDataFrame([(1, 1, "about one hundred and five frames", 0, second), (1, 2, "at 10.32 it stops", second, 2 * second), (1, 3, "one hundred five again", 0, second)], "task_id long, statement_no long, text string, start_us long, end_us long")
    known = spark.createDataFrame([(1, "a", "105", 0, second), (1, "b", "10:32", 0, 3 * second), (1, "c", "5", 0, second), (1, "d", "105", 5 * second, 6 * second)], "task_id long, fact_id string, words string, start_us long, end_us long")
    assert sorted(tuple(r) for r in reports.facts_stated(stated, known).collect()) == [(1, "a", 1), (1, "b", 2)]
