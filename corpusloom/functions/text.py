"""Text cleaning, splitting, tokenising and tagging as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.folding import lower_and_fold
from corpusloom.functions.stopwords import LANGUAGE_OF_CODE, stop_words

DEFAULT_HEADING = r"Chapter \d"

# English abbreviations after which a period does not end a sentence.
ABBREVIATIONS = """
a.a a.c a.d a.g a.h a.m a.m.e a.s a.t adm ala ariz aug ave b.f b.v bros c c.i.t c.o.m.b c.v
calif chg cie co col colo conn corp cos ct d d.c d.h d.w dec dr e e.f e.h e.l e.m f f.g f.j feb
fla fri ft g g.d g.f g.k ga gen h h.c h.f h.m i.m.s ill inc j.b j.c j.j j.k j.p j.r jan jr k kan
ky l l.a l.f l.p lt ltd m m.b.a m.d.c m.j maj messrs mg mich minn mr mrs ms n n.c n.d n.h n.j
n.m n.v n.y nev nov oct ok okla ore p p.a.m p.m pa ph.d prof r r.a r.h r.i r.j r.k r.t rep reps
s s.a s.a.y s.c s.g s.p.a s.s sen sep sept sr st sw t t.j tenn tues u.k u.n u.s u.s.a u.s.s.r v
va vs vt w w.c w.r w.va w.w wash wed wis yr
""".split()

# Words that do start a sentence even after an abbreviation.
SENTENCE_STARTERS = """
according although among both but despite even he however i if in indeed instead it many
meanwhile moreover most nevertheless nonetheless nor sales separately similarly since so some
the there these they this though thus under when while yet
""".split()

# Fused words the word tokenizer takes apart, as head|tail.
FUSED_WORDS = ["can|not", "gim|me", "gon|na", "got|ta", "lem|me", "wan|na"]

# Every character of the Unicode property White_Space, which is what ``\s`` means under ``(?U)``.
_WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_ASCII_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def _alternatives(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def strip_space(text: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.trim(text, F.lit(_WHITE_SPACE))


def one_line(text: Column) -> Column:
    """Replace newlines by spaces for display."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


# --- cleaning and tokens -------------------------------------------------------------


def clean_text(text: Column) -> Column:
    """Lower-case, fold to ASCII letters, drop everything else, collapse whitespace."""
    letters = F.regexp_replace(lower_and_fold(text), r"(?U)[^a-zA-Z\s]+", "")
    return F.trim(F.regexp_replace(letters, r"(?U)\s+", " "))


def word_tokens(cleaned: Column) -> Column:
    """Words of a cleaned text, fused words taken apart."""
    heads = "|".join("{}(?={}\\b)".format(*w.split("|")) for w in FUSED_WORDS)
    spaced = F.regexp_replace(cleaned, rf"(?i)\b(?:{heads})", "$0 ")
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def drop_stop_words(tokens: Column, language: str = "english") -> Column:
    """Remove the stop words of one language (a hash-set test per token)."""
    words = list(stop_words(language))
    return F.filter(tokens, lambda t: ~t.isin(words))


def drop_stop_words_by(tokens: Column, code: Column, codes: list[str]) -> Column:
    """Remove stop words by the language code of each row; unknown codes keep all tokens."""
    chosen = None
    for c in codes:
        kept = drop_stop_words(tokens, LANGUAGE_OF_CODE[c])
        chosen = F.when(code == c, kept) if chosen is None else chosen.when(code == c, kept)
    return chosen.otherwise(tokens)


def clean_tokens(text: Column, language: str = "english") -> Column:
    """Cleaned, tokenised and stop-word filtered text."""
    return drop_stop_words(word_tokens(clean_text(text)), language)


def search_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Tokens for lexical search: lower, split, strip outer ASCII punctuation, drop stop words."""
    punct = _ASCII_PUNCTUATION
    bare = F.regexp_replace(
        F.lower(text), rf"(?U)(?<=^|\s){punct}+|{punct}+(?=\s|\z)", ""
    )
    words = list(stop_words("english") if stop is None else stop)
    return F.filter(F.split(bare, r"(?U)\s+"), lambda t: (t != "") & ~t.isin(words))


# --- chapters and sentences ----------------------------------------------------------


def chapters(text: Column, heading: str = DEFAULT_HEADING) -> Column:
    """Array of ``(title, content)``: text before the first heading is dropped."""
    titles = F.regexp_extract_all(text, F.lit(heading), F.lit(0))
    bodies = F.split(text, heading)
    return F.transform(
        titles,
        lambda t, i: F.struct(
            strip_space(t).alias("title"),
            strip_space(F.get(bodies, i + 1)).alias("content"),
        ),
    )


def _sentence_boundary(abbreviations: list[str], starters: list[str]) -> str:
    edge = r"(?:^|[^\p{L}\p{N}_.])"
    abbreviation = rf"(?<!{edge}(?i:{_alternatives(abbreviations)})\.)"
    opens = _alternatives([s[0].upper() + s[1:] for s in starters])
    return (
        r"""(?<=[.!?]["')\]]{0,3})"""
        rf"(?:{abbreviation}|(?=\s+(?:{opens})(?!\p{{L}})))"
        rf"(?:(?<!{edge}\p{{Lu}}\.)|(?!\s+\p{{Lu}}))"
        r"""(?:(?<!\.\.)|(?=\s+["'(\[]{0,3}\p{Lu}))"""
        r"\s+"
    )


def sentences(
    text: Column,
    abbreviations: list[str] | None = None,
    starters: list[str] | None = None,
) -> Column:
    """Split after ``. ! ?`` (and closing quotes) followed by whitespace.

    A period after an abbreviation splits only before a known sentence starter; one after a
    capital initial does not split before a capital; an ellipsis splits only before a capital.
    """
    boundary = _sentence_boundary(abbreviations or ABBREVIATIONS, starters or SENTENCE_STARTERS)
    parts = F.transform(F.split(text, boundary), strip_space)
    return F.filter(parts, lambda s: s != "")


def naive_sentences(text: Column, min_length: int = 10) -> Column:
    """Split on every period, trim, keep parts longer than ``min_length``."""
    parts = F.transform(F.split(text, "[.]"), strip_space)
    return F.filter(parts, lambda s: F.length(s) > min_length)


# --- mentions and labels -------------------------------------------------------------


def mentions(text: Column, lexicon: list[str]) -> Column:
    """Names of ``lexicon`` that occur in ``text`` as whole words, in lexicon order.

    Every pattern is a literal, so it is compiled once per task; the substring test in
    front of it settles almost every row.
    """
    lowered = F.lower(text)
    found = []
    for name in lexicon:
        needle = name.lower()
        pattern = rf"(?U)\b{re.escape(needle)}\b"
        found.append(F.when(lowered.contains(needle) & lowered.rlike(pattern), F.lit(name)))
    return F.array_compact(F.array(*found))


def first_item(joined: Column, default: str = "unknown") -> Column:
    """First comma-separated item, trimmed; ``default`` when blank or null."""
    blank = joined.isNull() | (strip_space(joined) == "")
    return F.when(blank, F.lit(default)).otherwise(strip_space(F.split_part(joined, F.lit(","), F.lit(1))))


def shorten(text: Column, width: int = 100) -> Column:
    """First ``width`` characters plus ``...`` when longer."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def as_text(value: Column) -> Column:
    """Cast to string, null to empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def text_choice(df, use_cleaned: bool = True) -> Column:
    """The cleaned text column when asked for and present, else the raw sentence."""
    name = "cleaned_sentence" if use_cleaned and "cleaned_sentence" in df.columns else "sentence"
    if name not in df.columns:
        raise ValueError(f"no column '{name}'")
    return as_text(F.col(name))


# --- keywords ------------------------------------------------------------------------


def contains_all(text: Column, keywords: Column, case_sensitive: bool = False) -> Column:
    """True when every keyword is a substring of the text (an empty list matches)."""
    return F.forall(keywords, lambda k: _holds(text, k, case_sensitive))


def contained_keywords(text: Column, keywords: Column) -> Column:
    """The keywords that are substrings of the text, ignoring case."""
    return F.filter(keywords, lambda k: _holds(text, k, False))


def keyword_positions(text: Column, keywords: Column, case_sensitive: bool = False) -> Column:
    """Map of keyword to the 0-based position of its first occurrence."""
    hay = text if case_sensitive else F.lower(text)
    distinct = F.array_distinct(keywords)
    at = F.map_from_arrays(
        distinct,
        F.transform(
            distinct,
            lambda k: F.instr(hay, k if case_sensitive else F.lower(k)) - 1,
        ),
    )
    return F.map_filter(at, lambda _, p: p >= 0)


def _holds(text: Column, keyword: Column, case_sensitive: bool) -> Column:
    if case_sensitive:
        return F.contains(text, keyword)
    return F.contains(F.lower(text), F.lower(keyword))
