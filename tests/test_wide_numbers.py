from __future__ import annotations

import random
import re
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from conftest import plan_of

from agorametric.operators.profiles import exact_numbers
from agorametric.plans import audit

PATTERN = re.compile(r"-?[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?")


def plain(number: Decimal) -> str:
    text = format(number, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def exact(texts, digits=4):
    with localcontext(prec=200_000, Emax=10**6, Emin=-(10**6)) as context:
        context.rounding = ROUND_HALF_UP
        numbers = [Decimal(text) for text in texts if text and PATTERN.fullmatch(text)]
        if not numbers:
            return 0, None, None, None, None
        total = sum(numbers)
        average = (total / len(numbers)).quantize(Decimal(1).scaleb(-digits))
        average = average.copy_abs() if not average else average
        return len(numbers), min(numbers), max(numbers), plain(total), format(average, "f")


def found(frame, column="x"):
    row = exact_numbers(frame, [column]).head()
    with localcontext(prec=200_000, Emax=10**6, Emin=-(10**6)):
        ends = [None if row[name] is None else Decimal(row[name]) for name in ("least", "greatest")]
    return row["n_numbers"], *ends, row["total"], row["average"]


def drawn_number(drawn):
    digits = "".join(drawn.choice("0000123456789") for _ in range(drawn.choice([1, 2, 5, 6, 7, 12, 20, 45])))
    text = drawn.choice(["", "-"]) + digits
    if drawn.random() < 0.5:
        text += "." + "".join(drawn.choice("0123456789") for _ in range(drawn.randrange(0, 30)))
    if drawn.random() < 0.4:
        text += drawn.choice("eE") + drawn.choice(["", "+", "-"]) + str(drawn.choice([0, 1, 5, 6, 7, 30, 130]))
    return text


@pytest.mark.parametrize("seed", range(12))
def test_random_texts(spark, seed):
    drawn = random.Random(seed)
    texts = [drawn_number(drawn) for _ in range(drawn.choice([1, 2, 3, 40, 300]))] + [None, "", "x", ".5", "NaN"]
    if seed % 3 == 0:
        texts += [text[1:] if text[0] == "-" else f"-{text}" for text in texts if text and PATTERN.fullmatch(text)]
    frame = spark.createDataFrame([(text,) for text in texts], "x string").repartition(3)
    assert found(frame) == exact(texts)


@pytest.mark.parametrize(
    "texts",
    [
        ["0.00005"],
        ["-0.00005", "0"],
        ["0.00004999999999999999999999999999"],
        ["-0", "0.000", "0e5"],
        ["9" * 300, "1"],
        ["1e131071", "-1e-16000"],
        ["-12.0", "-12", "-1.2e1", "-12.00001"],
        ["999999", "1"],
        ["9007199254740993"] * 2,
    ],
)
def test_borders(spark, texts):
    assert found(spark.createDataFrame([(text,) for text in texts], "x string")) == exact(texts)


def test_columns_without_numbers_and_no_rows(spark):
    frame = spark.createDataFrame([("1", None), ("2", "x")], "x string, y string")
    rows = {row["col"]: tuple(row)[1:] for row in exact_numbers(frame, ["x", "y"]).collect()}
    assert rows == {"x": (2, "1", "2", "3", "1.5000"), "y": (0, None, None, None, None)}
    assert exact_numbers(frame.limit(0), ["x"]).collect() == []


def test_more_digits_than_the_source_holds(spark):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        exact_numbers(spark.createDataFrame([("1e131073",)], "x string"), ["x"]).collect()


@pytest.mark.parametrize(
    ("texts", "average"),
    [
        (["99999999999999"] * 2, "99999999999999.0000"),
        (["5e13"] * 3, "50000000000000.0000"),
        (["9007199254740993"] * 2, "9007199254740993.0000"),
        (["12345678901234567890", "-0.0002"], "6172839450617283944.9999"),
    ],
)
def test_audit_averages_do_not_overflow(raw_rows, texts, average):
    rows = raw_rows(*({"temperature_avg": text, "sentiment": text} for text in texts))
    assert audit.temperature(rows).head()["avg_temp"] == Decimal(average)
    assert audit.sentiment(rows).head()["avg_sentiment"] == Decimal(average)
    number = {row["col"]: row["least"] for row in audit.numbers(rows).collect()}
    assert Decimal(number["temperature_avg"]) == min(map(Decimal, texts))


def test_strict_scores(raw_rows):
    rows = raw_rows(*({"sentiment": text} for text in (" +.5", "5.", "1e-1 ", None)))
    assert audit.sentiment(rows).head()["avg_sentiment"] == Decimal("1.866667")


def test_limbs_combine_before_the_shuffle(sample):
    """One hash aggregate on limbs; what is shuffled is a few rows a task."""
    frame = audit.temperature(sample)
    plan = plan_of(frame)
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert plan.count("FileScan") == 1
