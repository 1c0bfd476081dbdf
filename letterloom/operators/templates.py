"""Templates with {{NAME}} holes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.functions.text import find_all, let, strip

HOLE = r"\{\{([^}]+)\}\}"


def hole_key(found: Column) -> Column:
    return strip(F.regexp_replace(found, "[{}]", ""))


def placeholders(text: Column) -> Column:
    """The keys of all holes, each once, by their first place in the text."""
    return F.array_distinct(F.transform(find_all(text, HOLE), hole_key))


def _variables(variables: Column) -> Column:
    """The variables with braces and outer spaces taken off their keys.

    Of keys that come out equal the first by its spelling fills the hole.
    """

    def first_each(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        values = F.transform(
            keys, lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"]
        )
        return F.map_from_arrays(keys, values)

    spelled = F.transform(
        F.map_entries(variables),
        lambda e: F.struct(
            hole_key(e["key"]).alias("key"), e["key"].alias("spelling"), e["value"].alias("value")
        ),
    )
    return let(F.array_sort(spelled), first_each)


def template_contract(df: DataFrame, text: str = "text", variables: str = "variables") -> DataFrame:
    """Add the keys that have no value and the values that have no hole."""
    wanted = placeholders(F.col(text))
    given = F.map_keys(_variables(F.col(variables)))
    return df.withColumn("missing_keys", F.array_except(wanted, given)).withColumn(
        "extra_keys", F.array_except(given, wanted)
    )


def injected(text: Column, variables: Column) -> Column:
    """The text with every hole {{KEY}} replaced by the literal value of its key.

    Keys go in the order of their first place in the text and then by name, so a value that itself
    holds a hole is filled by a later key.
    """

    def filled(cleaned: Column) -> Column:
        listed = placeholders(text)
        rest = F.array_sort(F.array_except(F.map_keys(cleaned), listed))
        order = F.filter(F.concat(listed, rest), lambda key: F.map_contains_key(cleaned, key))
        return F.aggregate(
            order,
            text,
            lambda acc, key: F.replace(
                acc, F.concat(F.lit("{{"), key, F.lit("}}")), F.try_element_at(cleaned, key)
            ),
        )

    return let(_variables(variables), filled)


def inject(
    df: DataFrame, text: str = "text", variables: str = "variables", filled: str = "filled"
) -> DataFrame:
    """Add the filled text, which is NULL where there is no template or there are no variables."""
    return df.withColumn(filled, injected(F.col(text), F.col(variables)))


def unfilled(df: DataFrame, filled: str = "filled") -> DataFrame:
    """Add the holes that are left after injection."""
    return df.withColumn("unfilled_keys", placeholders(F.col(filled)))
