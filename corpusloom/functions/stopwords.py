"""Stop-word lists per language.

The lists start from the ones bundled with Spark ML and differ by the entries below.
Entries with an apostrophe can never match: punctuation is gone before the lookup.
"""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

import pyspark
from pyspark import SparkContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entries to add to / drop from the Spark list of each language.
EXTRA = {
    "english": (
        "ain aren couldn d didn doesn hadn hasn haven isn ll m ma mightn mustn needn o re "
        "shan shouldn ve wasn weren won wouldn y"
    ),
    "french": "ils",
    "german": "dass unsere unserem unseren unseres",
    "portuguese": "estar haver ser é",
    "spanish": "vosotras vosotros",
}
SURPLUS = {
    "english": "cannot could ought would",
    "german": "unse unsem unsen unses",
    "spanish": "vosostras vosostros",
}

# ISO codes of the languages Spark ships a list for.
LANGUAGE_OF_CODE = {
    "da": "danish",
    "nl": "dutch",
    "en": "english",
    "fi": "finnish",
    "fr": "french",
    "de": "german",
    "hu": "hungarian",
    "it": "italian",
    "no": "norwegian",
    "pt": "portuguese",
    "ru": "russian",
    "es": "spanish",
    "sv": "swedish",
    "tr": "turkish",
}


@lru_cache(maxsize=None)
def spark_stop_words(language: str) -> tuple[str, ...]:
    """The list ``StopWordsRemover.loadDefaultStopWords`` returns."""
    known = sorted(set(LANGUAGE_OF_CODE.values()))
    if language not in known:
        raise ValueError(
            f"no built-in stop words for {language!r}; pass a list (stop_words_from reads one "
            f"from a table) or use one of {', '.join(known)}"
        )
    if SparkContext._active_spark_context is not None:
        return tuple(StopWordsRemover.loadDefaultStopWords(language))
    # the SQL statements are also written without a session
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    with zipfile.ZipFile(jars[0]) as jar:
        text = jar.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8")
    return tuple(w for w in text.split("\n") if w)


def stop_words_from(table: DataFrame, language: str) -> list[str]:
    """Stop words of one language out of a table ``(language, word)`` such as a folder of lists.

    A list that names a language is a few hundred words; the longest ones are under 2,000.
    """
    rows = table.where(F.col("language") == language).select(F.lower("word").alias("word")).distinct().collect()
    if not rows:
        raise ValueError(f"the stop-word table has no list for {language!r}")
    return sorted(r["word"] for r in rows if r["word"] and "'" not in r["word"])


@lru_cache(maxsize=None)
def stop_words(language: str = "english") -> tuple[str, ...]:
    """Stop words of ``language`` (full English name) that can match a cleaned token."""
    language = LANGUAGE_OF_CODE.get(language, language)
    words = set(spark_stop_words(language)) - set(SURPLUS.get(language, "").split())
    words |= set(EXTRA.get(language, "").split())
    return tuple(sorted(w for w in words if "'" not in w))
