import pytest
from pyspark.sql import functions as F

from letterloom.operators import templates


@pytest.mark.parametrize(
    ("text", "values", "filled", "left"),
    [
        ("{{A}} and {{A}}", {"A": "x"}, "x and x", []),
        ("{{ A }}", {"A": "x"}, "{{ A }}", ["A"]),
        ("{{{A}}}", {"A": "x"}, "{x}", []),
        ("none", {"A": "x"}, "none", []),
        ("{{a.b}} {{axb}}", {"a.b": "x"}, "x {{axb}}", ["axb"]),
        ("{{A}}", {"{{A}}": r"$& \textbf $1"}, r"$& \textbf $1", []),
        ("{{A}} {{B}}", {"A": "[{{B}}]", "B": "y"}, "[y] y", []),
        ("{{B}} {{A}}", {"A": "[{{B}}]", "B": "y"}, "y [{{B}}]", ["B"]),
    ],
)
def test_inject(spark, text, values, filled, left):
    df = spark.createDataFrame([(text, values)], "text string, variables map<string,string>")
    row = templates.unfilled(templates.inject(df)).first()
    assert (row["filled"], row["unfilled_keys"]) == (filled, left)


def test_contract(spark):
    df = spark.createDataFrame(
        [("{{A}} {{ B }}", {"A": "x", "C": "y"})], "text string, variables map<string,string>"
    )
    row = templates.template_contract(df).first()
    assert (row["missing_keys"], row["extra_keys"]) == (["B"], ["C"])


def test_no_template_gives_no_text(spark):
    df = spark.createDataFrame([(None, {"A": "x"})], "text string, variables map<string,string>")
    assert templates.inject(df).select(F.col("filled")).first()[0] is None
