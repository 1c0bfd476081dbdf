"""How a person writes, measured over their samples.

`samples(author_id, kind, doc_id, text)` holds one row per document. Everything that depends on one
text is worked out in the scan; only small numbers and short word lists are shuffled.
"""

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from letterloom.constants import (
    DEFAULT_SECTIONS,
    MAX_TRANSITIONS,
    MIN_TRANSITIONS,
    RELIABLE_DOCS,
)
from letterloom.functions.ranking import most_common, running_totals, top_rows
from letterloom.functions.text import (
    BLANK_LINE,
    BULLET_LINE,
    let,
    literal_texts,
    normalised,
    paragraphs,
    sentence_bodies,
    sentence_words,
    strip,
    tokens,
)
from letterloom.operators.phrases import each_with_all, phrase_hits, phrase_rows
from letterloom.session import materialise

SHORT_WORDS, LONG_WORDS = 8, 20
#: What is between the words of a text.
NO_TOKEN = r"[^\p{L}\p{N}]++"
#: Bytes of texts whose phrases are put together at a time, beside one text.
BYTES_AT_ONCE = 1 << 22
FIRST_TWO = r"^[^\p{L}\p{N}]*+([\p{L}\p{N}]++[^\p{L}\p{N}]++[\p{L}\p{N}]++)"


def input_inventory(samples: DataFrame) -> DataFrame:
    return samples.groupBy("author_id").agg(
        F.count_if(F.col("kind") == "resume").alias("n_resumes"),
        F.count_if(F.col("kind") == "cover_letter").alias("n_cover_letters"),
    )


def concat_samples(
    samples: DataFrame, name: str, order: str, max_chars: int = 1_000_000
) -> DataFrame:
    """The samples of an author one after the other, each under a line with its name.

    The whole is given in parts of about `max_chars` characters (a document is never cut), so that
    an author with any number of documents fits: the parts in order, with a blank line between, are
    the full text. `n_docs` counts the documents of a part. `order` is unique for an author and need
    not be dense: a time will do. Lengths alone are summed along an author; the texts then meet the
    numbers of their parts once.
    """
    headed = samples.withColumn(
        "entry", F.concat(F.lit("--- Sample: "), F.col(name), F.lit(" ---\n"), F.col("text"))
    ).select("author_id", order, "entry", F.length("entry").alias("n_chars"))
    lengths = headed.select("author_id", order, "n_chars")
    placed = running_totals(lengths, ["author_id"], order, "n_chars", "before")
    numbered = placed.select("author_id", order, F.expr(f"before div {max_chars}").alias("part_no")).alias("p")
    same = F.col("h.author_id").eqNullSafe(F.col("p.author_id")) & (F.col(f"h.{order}") == F.col(f"p.{order}"))
    parted = headed.alias("h").join(numbered, same).select("h.author_id", f"h.{order}", "entry", "part_no")
    return (
        parted.groupBy("author_id", "part_no")
        .agg(F.array_sort(F.collect_list(F.struct(order, "entry"))).alias("entries"))
        .select(
            "author_id",
            "part_no",
            F.size("entries").alias("n_docs"),
            F.array_join(F.col("entries.entry"), "\n\n").alias("text"),
        )
    )


def sentence_numbers(bodies: Column) -> Column:
    """Whole-number sums over the sentences of a text."""

    def sums(lengths: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.struct(
            F.size(lengths).alias("n"),
            F.aggregate(lengths, zero, lambda a, n: a + n).alias("words"),
            F.aggregate(lengths, zero, lambda a, n: a + n.cast("long") * n).alias("squares"),
            F.size(F.filter(lengths, lambda n: n <= SHORT_WORDS)).alias("short"),
            F.size(F.filter(lengths, lambda n: n >= LONG_WORDS)).alias("long"),
        )

    with_semicolon = F.size(F.filter(bodies, lambda s: s.contains(";")))
    return let(F.transform(bodies, sentence_words), sums).withField("semicolons", with_semicolon)


def sentence_profile(samples: DataFrame) -> DataFrame:
    """Length and make-up of the sentences of every author.

    Means and spreads come from whole-number sums, so the result does not depend on the order in
    which partial results arrive. An author without a finished sentence has 0 sentences and NULL means.
    """
    numbers = let(sentence_bodies(F.col("text")), sentence_numbers)
    per_doc = samples.select("author_id", numbers.alias("s"))
    sums = per_doc.groupBy("author_id").agg(
        *[F.coalesce(F.sum(f"s.{c}"), F.lit(0)).alias(c) for c in ("n", "words", "squares", "short", "long", "semicolons")]
    )
    return sums.select("author_id", *sentence_columns())


def sentence_columns() -> list[Column]:
    # an author without a finished sentence has no means
    n = F.col("n")
    some = F.nullif(n, F.lit(0))
    mean = F.col("words") / some
    spread = F.greatest(F.col("squares") / some - mean * mean, F.when(n > 0, 0.0))
    return [
        n.alias("n_sentences"),
        F.round(mean, 6).alias("mean_words"),
        F.round(F.sqrt(spread), 6).alias("sd_words"),
        F.round(F.col("short") / some, 6).alias("short_share"),
        F.round(F.col("long") / some, 6).alias("long_share"),
        F.round(F.col("semicolons") / some, 6).alias("semicolon_share"),
    ]


def habit_numbers(text: Column, bodies: Column, separator: str) -> dict[str, Column]:
    return {
        "exclamations": F.regexp_count(text, F.lit("!")),
        "dashes": F.regexp_count(text, F.lit("[—–]| - ")),
        "brackets": F.regexp_count(text, F.lit(r"\(")),
        "bullets": F.regexp_count(text, F.lit(BULLET_LINE)),
        "paragraphs": F.size(paragraphs(text, separator)),
        "sentences": F.size(bodies),
    }


def formatting_habits(samples: DataFrame, separator: str = BLANK_LINE) -> DataFrame:
    """What can be seen in the layout of an author's texts."""
    numbers = habit_numbers(F.col("text"), sentence_bodies(F.col("text")), separator)
    sums = samples.groupBy("author_id").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(c).alias(name) for name, c in numbers.items()],
    )
    return sums.select("author_id", "n_docs", *habit_columns())


def habit_columns() -> list[Column]:
    return [
        (F.col("exclamations") == 0).alias("never_exclaims"),
        (F.col("dashes") > F.col("brackets")).alias("prefers_dashes"),
        (F.col("bullets") == 0).alias("never_bullets"),
        F.col("paragraphs").alias("n_paragraphs"),
        F.round(F.col("sentences") / F.greatest(F.col("paragraphs"), F.lit(1)), 6).alias(
            "sentences_per_paragraph"
        ),
    ]


def opener(text: Column) -> Column:
    """The first two words of a text, "" if it has fewer."""
    return F.lower(
        F.regexp_replace(F.regexp_extract(text, FIRST_TWO, 1), r"[^\p{L}\p{N}]+", " ")
    )


def sign_off(text: Column) -> Column:
    """The last line of a text."""
    return strip(F.substring_index(strip(text), "\n", -1))


def usual_opener(samples: DataFrame) -> DataFrame:
    """The way most samples of an author begin."""
    return most_common(
        samples.select("author_id", opener(F.col("text")).alias("opener")), ["author_id"], "opener"
    )


def usual_sign_off(samples: DataFrame) -> DataFrame:
    """The last line that most samples of an author end with."""
    last = samples.select("author_id", sign_off(F.col("text")).alias("sign_off"))
    return most_common(last, ["author_id"], "sign_off")


def _phrases_by_document(n: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from (author_id, words) to (author_id, phrase, n_docs), for some rows at a time.

    `words` are the words of a document with single spaces between.
    """
    at_once = BYTES_AT_ONCE

    def counted(authors: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        lists = pc.split_pattern(texts, " ")
        ends = np.asarray(lists.offsets)
        words, sizes = lists.values.slice(ends[0], ends[-1] - ends[0]), np.diff(ends)
        row = np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(ends[1:] - ends[0], sizes) - np.arange(len(words))
        at = np.flatnonzero(left >= n)
        phrases = pc.binary_join_element_wise(*[words.take(pa.array(at + k)) for k in range(n)], " ").dictionary_encode()
        n_phrases = max(1, len(phrases.dictionary))
        # each phrase once a document, and then the documents of an author
        once = np.unique(row[at] * n_phrases + np.asarray(phrases.indices))
        author = authors.dictionary_encode(null_encoding="encode")
        both = np.asarray(author.indices).astype(np.int64)[once // n_phrases] * n_phrases + once % n_phrases
        found, n_docs = np.unique(both, return_counts=True)
        columns = [
            author.dictionary.take(pa.array(found // n_phrases)),
            phrases.dictionary.take(pa.array(found % n_phrases)),
            pa.array(n_docs.astype(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["author_id", "phrase", "n_docs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.fill_null(pc.binary_length(batch.column(1)), 0), 0))
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column(1))).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + at_once, side="right")))
                part = batch.slice(at, end - at)
                yield counted(part.column(0), part.column(1))
                at = end

    return run


def recurring_patterns(
    samples: DataFrame, n: int = 3, min_docs: int = RELIABLE_DOCS, keep_weak: bool = False
) -> DataFrame:
    """Phrases of `n` words and in how many documents of the author they are.

    A phrase counts once a document. Phrases are put together from the words in arrays and counted
    for some documents at a time in the scan, so that the counts are combined before the shuffle
    and no task holds a table of all its phrases there. Phrases of a single document are weak
    signals; they are given only on request.
    """
    author = samples.schema["author_id"]
    schema = T.StructType([author, T.StructField("phrase", T.StringType()), T.StructField("n_docs", T.LongType())])
    spaced = F.trim(F.regexp_replace(F.lower("text"), NO_TOKEN, " "))
    words = samples.select("author_id", spaced.alias("words"))
    phrases = words.mapInArrow(_phrases_by_document(n), schema)
    gathered = phrases.repartition("author_id", "phrase")
    counted = gathered.groupBy("author_id", "phrase").agg(F.sum("n_docs").alias("n_docs"))
    signal = F.when(F.col("n_docs") >= min_docs, "reliable").otherwise("weak")
    marked = counted.withColumn("signal", signal)
    return marked if keep_weak else marked.filter(F.col("n_docs") >= min_docs)


def majority_value(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """What most samples show where they differ."""
    return most_common(df, keys, value)


def word_choice(samples: DataFrame, pairs: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """Which word of each pair an author prefers: (author_id, word_a, word_b, n_a, n_b, preferred).

    `pairs(word_a, word_b)` is a table of any size or a short sequence. Every author has a row for
    every pair; authors without text count 0.
    """
    if not isinstance(pairs, DataFrame):
        pairs = samples.sparkSession.createDataFrame(list(pairs), "word_a string, word_b string")
    listed = pairs.select("word_a", "word_b").distinct()
    words = listed.select(F.explode(F.array("word_a", "word_b")).alias("phrase"))
    uses = materialise(phrase_hits(samples, words, ["author_id"]), "uses")
    counted = each_with_all(samples.select("author_id").distinct(), listed)
    for side in ("a", "b"):
        of_side = uses.select("author_id", F.col("phrase").alias(f"word_{side}"), F.col("n").alias(f"n_{side}"))
        counted = counted.join(of_side, ["author_id", f"word_{side}"], "left")
    counted = counted.withColumns({f"n_{side}": F.coalesce(f"n_{side}", F.lit(0)) for side in ("a", "b")})
    preferred = (
        F.when(F.col("n_a") > F.col("n_b"), F.col("word_a"))
        .when(F.col("n_b") > F.col("n_a"), F.col("word_b"))
        .otherwise("")
    )
    return counted.select("author_id", "word_a", "word_b", "n_a", "n_b", preferred.alias("preferred"))


def phrases_used(text: Column, phrases: Sequence[str]) -> Column:
    """Which of the phrases are in a text, as whole words in any case."""


    def spaced(words: Column) -> Column:
        return F.concat(F.lit(" "), normalised(words), F.lit(" "))

    def found(searched: Column) -> Column:
        return F.array(*[F.when(searched.contains(spaced(F.lit(p))), F.lit(p)) for p in phrases])

    return F.filter(let(spaced(text), found), lambda p: p.isNotNull())


def absent_words(
    samples: DataFrame,
    lexicon: DataFrame | Sequence[str],
    opportunities: DataFrame | dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(author_id, word): lexicon entries that an author never uses.

    `lexicon(word)` and `opportunities(word, hint)` are tables of any size, or short lists. A hint is a
    word that shows there was a chance to use the entry; an entry with hints counts only for authors
    who use one of them. The texts are read once, for entries and hints together.
    """
    spark = samples.sparkSession
    entries = phrase_rows(spark, lexicon, "word").select("word").filter(F.col("word").isNotNull()).distinct()
    if not isinstance(opportunities, DataFrame):
        rows = [(word, hint) for word, hints in (opportunities or {}).items() for hint in hints]
        opportunities = spark.createDataFrame(rows, "word string, hint string")
    hints = opportunities.select("word", "hint").distinct()
    wanted = entries.select(F.col("word").alias("phrase")).unionByName(hints.select(F.col("hint").alias("phrase")))
    used = materialise(phrase_hits(samples, wanted, ["author_id"]).select("author_id", "phrase"), "used")
    free = entries.join(hints.select("word").distinct(), "word", "left_anti")
    anyone = each_with_all(samples.select("author_id").distinct(), free)
    hinted = hints.join(entries, "word", "left_semi").join(used.withColumnRenamed("phrase", "hint"), "hint")
    candidates = anyone.select("author_id", "word").unionByName(hinted.select("author_id", "word").distinct())
    return candidates.join(used.withColumnRenamed("phrase", "word"), ["author_id", "word"], "left_anti")


def sentence_openings(bodies: Column) -> Column:
    """The distinct first two words of the sentences of a text."""
    first_two = F.transform(bodies, opener)
    return F.filter(F.array_distinct(first_two), lambda p: p != "")


def top_transitions(
    samples: DataFrame, k: int = MAX_TRANSITIONS, minimum: int = MIN_TRANSITIONS
) -> DataFrame:
    """The two-word sentence openings that an author uses in the most documents."""
    phrases = sentence_openings(sentence_bodies(F.col("text")))
    openings = samples.select("author_id", F.explode(phrases).alias("phrase"))
    counted = (
        openings.groupBy("author_id", "phrase")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
    order = [F.col("n_docs").desc(), F.col("phrase").asc()]
    best = top_rows(counted, ["author_id"], order, k, rank="position")
    n_phrases = F.count(F.lit(1)).over(Window.partitionBy("author_id"))  # over `k` rows at most
    return best.withColumn("enough", n_phrases >= minimum)


def section_order(
    samples: DataFrame, sections: Sequence[str], default: Sequence[str] = tuple(DEFAULT_SECTIONS)
) -> DataFrame:
    """The usual order of the named sections in an author's documents, else the default order."""
    text = F.concat(F.lit("\n"), F.col("text"))
    places = F.array(
        *[
            F.struct(
                F.locate(f"\n{name}:", text).alias("at"),
                F.lit(name).alias("name"),
            )
            for name in sections
        ]
    )
    present = F.array_sort(F.filter(places, lambda p: p["at"] > 0))
    counted = (
        samples.select("author_id", F.array_join(present["name"], ", ").alias("sections"))
        .groupBy("author_id", "sections")
        .agg(F.count(F.lit(1)).alias("support"))
    )
    none = F.col("sections") == ""
    order = [none.asc(), F.col("support").desc(), F.col("sections").asc()]
    return top_rows(counted, ["author_id"], order, 1).select(
        "author_id",
        F.when(none, ", ".join(default)).otherwise(F.col("sections")).alias("sections"),
        none.alias("is_default"),
    )


def sentence_variation(outputs: DataFrame) -> DataFrame:
    """Mean change of length from one sentence to the next; works on each text by itself."""
    lengths = F.transform(sentence_bodies(F.col("text")), sentence_words)
    with_lengths = outputs.withColumn("lengths", lengths)
    n = F.size("lengths")
    changes = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.abs(F.get("lengths", i) - F.get("lengths", i - 1)),
    )
    total = F.aggregate(changes, F.lit(0), lambda a, c: a + c)
    return with_lengths.select(
        *[c for c in outputs.columns if c != "text"],
        n.alias("n_sentences"),
        F.when(n > 1, F.round(total / (n - 1), 6)).otherwise(F.lit(0.0)).alias("mean_change"),
    )
