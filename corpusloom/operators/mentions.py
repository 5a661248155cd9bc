"""Entity mention tagging and the filters and labels that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.ordering import factorize

# The default lexicon.
CHARACTERS = [
    "the ring", "frodo", "gandalf", "bilbo", "aragorn",
    "boromir", "legolas", "sauron", "galadriel", "gollum",
    "elrond", "gimli", "arwen",
]
PLACES = [
    "shire", "rivendell", "moria", "mordor", "gondor",
    "rohan", "eriador", "arnor", "minas tirith", "mirkwood",
]


def tag_mentions(
    df: DataFrame,
    text: str,
    characters: list[str] = CHARACTERS,
    places: list[str] = PLACES,
) -> DataFrame:
    """Add array columns ``characters`` and ``places``."""
    source = X.as_text(F.col(text))
    return df.withColumn("characters", X.mentions(source, characters)).withColumn(
        "places", X.mentions(source, places)
    )


def keep_mentioned(df: DataFrame) -> DataFrame:
    """Rows with at least one mention."""
    return df.filter(F.size("characters") + F.size("places") > 0)


def joined_mentions(df: DataFrame) -> DataFrame:
    """Replace the arrays by comma-joined ``character`` and ``place`` strings."""
    return (
        df.withColumn("character", F.array_join("characters", ", "))
        .withColumn("place", F.array_join("places", ", "))
        .drop("characters", "places")
    )


def label_first_character(df: DataFrame, position: str) -> DataFrame:
    """Keep rows with a first character and code it by first appearance."""
    labelled = df.withColumn("character", X.first_item(F.col("character"), "")).filter(
        F.col("character") != ""
    )
    return factorize(labelled, "character", position, "character_label")
