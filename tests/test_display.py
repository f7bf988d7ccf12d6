"""Display formats: sections, rounding, date tokens, literals."""

import pytest

from tessera.functions.display import format_number, format_text

CASES = [
    ("#,##0.00", 1234.5, "1,234.50"),
    ("#,##0.00", 1.005, "1.01"),
    ("0", -1234.5, "-1235"),
    ("0.0%", 0.1234, "12.3%"),
    ("0.00E+00", 12345.0, "1.23E+04"),
    ("0.0E+000", 1e-7, "1.0E-007"),
    ("0;(0)", -3.0, "(3)"),
    ('0;(0);"none"', 0.0, "none"),
    ('0";"', 5.0, "5;"),
    ("[Red]$0.00", 2.0, "$2.00"),
    ("\\x0", 1.0, "x1"),
    ("yyyy-mm-dd hh:mm:ss", 45123.75, "2023-07-16 18:00:00"),
    ("h:mm AM/PM", 45123.75, "6:00 PM"),
    ("d \"o'clock\" m", 45123.0, "16 o'clock 7"),
    ("0", None, None),
    ("0", float("inf"), ""),
]


def test_codes(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[format_number(F.lit(x).cast("double"), code).alias(f"c{i}") for i, (code, x, _) in enumerate(CASES)]).first()
    assert list(row) == [want for _, _, want in CASES]


@pytest.mark.parametrize("code,want", [("0;0;0;\"<\"@\">\"", "<a@b>"), ("0", "a@b")])
def test_text_section(spark, code, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(format_text(F.lit("a@b"), code)).first()[0] == want
