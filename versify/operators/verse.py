"""The verse view: every document laid out as 14-line poems of 6-word lines.

All words of every document are used (no prefix): word w (1-based) goes to
poem ``(w - 1) div 84 + 1`` and, inside it, to line ``((w - 1) mod 84) div 6 + 1``.
Inside a poem, blank lines separate stanzas after lines 4, 8 and 11 except
when ``doc_id % 5 = 0`` (those poems have no stanza breaks, so both branches
of the structure rules are exercised).

Everything is a per-row projection plus one ``explode`` (a narrow Generate),
so building the view never shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS_PER_LINE = 6
LINES_PER_POEM = 14
WORDS_PER_POEM = WORDS_PER_LINE * LINES_PER_POEM
STANZA_STARTS = (4, 8, 11)  # 0-based indexes of lines that open a new stanza


def layout_poems(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, lang) -> (doc_id, poem_no, lang, text)."""
    # a column of its own: inside the lambda below the text would be cut into words again for every poem
    documents = documents.select("doc_id", "lang", F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), 0).alias("_words"))
    words = F.col("_words")
    n = F.size(words)
    n_poems = ((n + (WORDS_PER_POEM - 1)) / WORDS_PER_POEM).cast("int")
    poems = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), n_poems - 1),
            lambda p: F.struct(
                (p + 1).alias("poem_no"),
                F.slice(words, p * WORDS_PER_POEM + 1, WORDS_PER_POEM).alias("pw"),
            ),
        ),
    )
    exploded = documents.select("doc_id", "lang", F.explode(poems).alias("p")).select(
        "doc_id", "lang", F.col("p.poem_no").alias("poem_no"), F.col("p.pw").alias("pw")
    )
    n_lines = ((F.size("pw") + (WORDS_PER_LINE - 1)) / WORDS_PER_LINE).cast("int")
    lines = F.transform(
        F.sequence(F.lit(0), n_lines - 1),
        lambda i: F.array_join(F.slice("pw", i * WORDS_PER_LINE + 1, WORDS_PER_LINE), " "),
    )
    breaks = (F.col("doc_id") % 5) != 0
    text = F.array_join(
        F.transform(
            lines,
            lambda line, i: F.when(i.isin(*STANZA_STARTS) & breaks, F.concat(F.lit("\n"), line)).otherwise(line),
        ),
        "\n",
    )
    return exploded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("poem_no").cast("int").alias("poem_no"),
        "lang",
        text.alias("text"),
    )


def verse_view(documents: DataFrame) -> DataFrame:
    return layout_poems(documents.select("doc_id", "lang", "text"))


def verse_lines(verse: DataFrame) -> DataFrame:
    """Exploded form: one row per physical line (blank lines included).

    (doc_id, poem_no, lang, line_no 1-based, line)."""
    return verse.select(
        "doc_id",
        "poem_no",
        "lang",
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"),
    ).select("doc_id", "poem_no", "lang", (F.col("pos") + 1).alias("line_no"), "line")
