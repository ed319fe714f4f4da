"""Licence scan by canonical digest, with DataFrame functions only.

A text is brought to a canonical form: lower case, no copyright lines, punctuation and white
space as single spaces, equivalent spellings as one. The SHA-256 of the whole canonical text is
hash-joined to the digests of known licences. Notices inside a document are found alike: the
digests of every line, and of every run of as many paragraphs as a known text has, are exploded
and hash-joined. Paragraphs end at a line without letters and digits, or at a copyright line.

The known texts are a fixed list (``license_texts.TEXTS``) or a table the caller gives; Spark
broadcasts it only when its size allows.

Defined results: null and empty texts, and texts of nothing but punctuation, have the digest of
the empty text and no licence; a text under several known ids takes the first by code point; a
notice that shares its line, or its paragraph over several lines, with other words is not found;
rows that repeat a document give repeated rows; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.license_texts import SPELLINGS, TEXTS

#: Lines that only say who holds the rights.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©]*(copyright *(\(c\)|©|[0-9])|\(c\) *[0-9]|©|all rights reserved)[^\n]*$"


LINE_END = r" *\n[ \n]*"
PARAGRAPH_END = r"\n *\n[ \n]*"
MARK = "¶"  # neither a letter nor a digit


def words_of(text: Column) -> Column:
    """Letters and digits in lower case with single spaces between them; line ends stay."""
    lower = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    return F.regexp_replace(lower, r"[^\p{L}\p{N}\n]+", " ")


def spelled(words: Column) -> Column:
    spaced = F.concat(F.lit(" "), words, F.lit(" "))
    return reduce(lambda x, pair: F.replace(x, F.lit(" " + pair[0]), F.lit(" " + pair[1])), SPELLINGS, spaced)


def canonical(text: Column) -> Column:
    return F.trim(spelled(F.regexp_replace(words_of(text), "[ \n]+", " ")))


def _pieces(marked: Column) -> Column:
    """What stands between line ends, without what is empty."""
    return F.filter(F.transform(F.split(spelled(marked), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def lines(text: Column) -> Column:
    """The canonical lines of a text."""
    return _pieces(F.regexp_replace(words_of(text), LINE_END, " \n "))


def paragraphs(text: Column) -> Column:
    """The canonical paragraphs of a text."""
    cut = F.regexp_replace(words_of(text), PARAGRAPH_END, MARK)
    return _pieces(F.regexp_replace(F.regexp_replace(cut, "[ \n]+", " "), MARK, " \n "))


def sha(words: Column) -> Column:
    return F.sha2(words.cast("binary"), 256)


def text_digest(text: Column) -> Column:
    return sha(canonical(text))


def known_digests(spark: SparkSession, texts=None) -> DataFrame:
    """(digest, license, paragraphs), one row per digest, of rows (license, text)."""
    given = texts if isinstance(texts, DataFrame) else spark.createDataFrame(texts or TEXTS, "license string, text string")
    cut = given.select("license", canonical(F.col("text")).alias("whole"), paragraphs(F.col("text")).alias("parts"))
    # a spelling of two words may stand on both sides of a paragraph's end
    forms = cut.select("license", F.size("parts").alias("paragraphs"), F.explode(F.array("whole", F.array_join("parts", " "))).alias("form"))
    return forms.filter("form <> ''").groupBy(sha(F.col("form")).alias("digest")).agg(F.min("license").alias("license"), F.max("paragraphs").alias("paragraphs"))


def notices(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text_key, notices): the known texts that stand in each different text as a line or as a run of paragraphs."""
    # a set of small whole numbers, one row
    sizes = known.agg(F.sort_array(F.collect_set("paragraphs")).alias("sizes")).withColumn("sizes", F.array_union("sizes", F.array(F.lit(1))))
    cut = docs.select(text_key("text"), lines(F.col("text")).alias("lines"), paragraphs(F.col("text")).alias("parts"), sizes.scalar().alias("sizes"))

    def runs(n: Column) -> Column:
        starts = F.when(F.size("parts") >= n, F.sequence(F.lit(1), F.size("parts") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: sha(F.array_join(F.slice("parts", k, n), " ")))

    found = F.array_distinct(F.concat(F.transform("lines", sha), F.flatten(F.transform("sizes", runs))))
    return (
        cut.select("text_key", F.explode(found).alias("digest"))
        .join(known, "digest")
        .groupBy("text_key")
        .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    )


def text_key(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256).alias("text_key")


def scan(docs: DataFrame, texts=None) -> DataFrame:
    """One row per document: digest and licence of the whole text, and the notices in it."""
    known = known_digests(docs.sparkSession, texts)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), text_key("text"))
    return (
        keyed.join(known.select("digest", "license"), "digest", "left")
        .join(notices(docs, known), "text_key", "left")
        .select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
    )


def _sql_words(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"


def _sql_spelled(words: str) -> str:
    out = f"(' ' || {words} || ' ')"
    for found, kept in SPELLINGS:
        out = f"replace({out}, ' {found}', ' {kept}')"
    return out


def _sql_canonical(words: str) -> str:
    return "trim(" + _sql_spelled(f"regexp_replace({words}, '[ \\n]+', ' ', 'g')") + ")"


def _sql_pieces(marked: str) -> str:
    return f"list_filter(list_transform(string_split({_sql_spelled(marked)}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _sql_lines(words: str) -> str:
    return _sql_pieces(f"regexp_replace({words}, '{LINE_END}', ' ' || chr(10) || ' ', 'g')")


def _sql_paragraphs(words: str) -> str:
    return _sql_pieces(f"replace(regexp_replace(regexp_replace({words}, '{PARAGRAPH_END}', '{MARK}', 'g'), '[ \\n]+', ' ', 'g'), '{MARK}', ' ' || chr(10) || ' ')")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = f"""
WITH texts(license, text) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in TEXTS)}),
known_words AS (SELECT license, {_sql_words("text")} AS words FROM texts),
known_parts AS (SELECT license, {_sql_canonical("words")} AS whole, {_sql_paragraphs("words")} AS parts FROM known_words),
known AS (
  SELECT sha256(form) AS digest, min(license) AS license, max(n) AS n
  FROM (SELECT license, len(parts) AS n, unnest([whole, array_to_string(parts, ' ')]) AS form FROM known_parts) WHERE form <> '' GROUP BY 1
),
sizes AS (SELECT n FROM known UNION SELECT 1),
worded AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words("text")} AS words FROM documents),
keyed AS (SELECT r, doc_id, sha256({_sql_canonical("words")}) AS digest, {_sql_lines("words")} AS lines, {_sql_paragraphs("words")} AS parts FROM worded),
pieces AS (
  SELECT r, unnest(lines) AS piece FROM keyed
  UNION ALL
  SELECT r, unnest(list_transform(range(1, len(parts) - n + 2), lambda k: array_to_string(parts[k : k + n - 1], ' '))) FROM keyed JOIN sizes ON n <= len(parts)
),
found AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM pieces JOIN known ON sha256(piece) = known.digest GROUP BY r)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices
FROM keyed LEFT JOIN known USING (digest) LEFT JOIN found USING (r)
"""
