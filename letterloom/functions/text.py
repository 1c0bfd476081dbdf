"""Text expressions shared by the operators. All of them are built-in functions and run in the JVM."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# All spaces and line ends that are taken off the ends of a text
EDGE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Repeated groups are possessive: they need no stack and never go back over a long text.
WORD = r"\S+"
TOKEN = r"[\p{L}\p{N}]+"
SENTENCE = r"[^.!?]++[.!?]++"
SENTENCE_END = r"[.!?]+"
NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"
BLANK_LINE = r"\n\s*\n"
BULLET_LINE = r"(?:^|\n)[ \t]*[-*•] "
FIRST_PERSON = r"(?:^|[^\p{L}\p{N}])I(?:[^\p{L}\p{N}]|$)"


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores added until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Work out `value` once for all its uses in `body`, also inside array functions."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(EDGE_SPACE))


def or_default(text: Column, default: str = "") -> Column:
    """The literal that stands for an absent text: NULL and empty both become `default`."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def tokens(text: Column) -> Column:
    return find_all(F.lower(text), TOKEN)


def normalised(text: Column) -> Column:
    """Lower-case tokens joined by single spaces."""
    return F.array_join(tokens(text), " ")


def sentences(text: Column) -> Column:
    """Sentences with their end marks, for short texts; a last one without a mark does not count."""
    return find_all(text, SENTENCE)


def sentence_bodies(text: Column) -> Column:
    """Sentences without their end marks, in time linear in the text."""
    pieces = F.split(text, SENTENCE_END)
    return let(
        pieces, lambda p: F.filter(F.slice(p, F.lit(1), F.size(p) - 1), lambda s: F.length(s) > 0)
    )


def sentence_words(body: Column) -> Column:
    """Word count of a sentence; an end mark that stands alone is a word."""
    return word_count(F.concat(body, F.lit(".")))


def paragraphs(text: Column, separator: str = BLANK_LINE) -> Column:
    return F.filter(F.split(strip(text), separator), lambda p: F.length(strip(p)) > 0)


def _runs(words: Column, n: int) -> Column:
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
    )


def ngrams(words: Column, n: int) -> Column:
    """Every run of `n` neighbouring words, in order."""
    return let(words, lambda w: _runs(w, n))


def ngrams_up_to(words: Column, n: int) -> Column:
    return let(words, lambda w: F.concat(*[_runs(w, k) for k in range(1, n + 1)]))


def literal_texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def slug(text: Column) -> Column:
    """Lower-case ASCII slug with one underscore trimmed from each end."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def pretty_json(record: Column) -> Column:
    return F.to_json(record, {"pretty": "true", "ignoreNullFields": "true"})


def has_number(text: Column) -> Column:
    return text.rlike("[0-9]")
