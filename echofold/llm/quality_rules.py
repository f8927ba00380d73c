"""Quality rules with cross-document line frequency.

Per document: base counts (words, their characters, symbols, repeated lines and words) and a base
verdict. Across documents: every line with a word is normalised and hashed, and per host (`source`) the
distinct document texts that hold it are counted; lines held by more than `min_docs` are removed, whatever the
size of the host, and a document that keeps less than `min_left` of its words is rejected as depleted.
`without_frequent_lines` gives the documents without these lines, `judged` the counts and verdicts. Texts, not ids,
are counted: exact copies are a matter of de-duplication, and a copied clean document is no boilerplate.

Scale: the text is read once; the counts and 12 bytes a line are written and read again. What is shuffled is one
(host, 8-byte hash, 8-byte text hash) per distinct line of a document, pre-aggregated before the
shuffle, so one hot host is spread by line hash. Documents get their removed words back as one row each;
the text itself moves only where it is to be returned without lines.

Edge cases: a null text has no words and no lines; it and every blank text fail the base rule; null
hosts form one host; repeated rows with the same id and text give the same row each; very long lines are a hash
like others; an empty table gives an empty result. `judged` reads the id, text and host columns only, so other
columns cannot clash; `without_frequent_lines` carries them along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import SOLID, SPACE, n_words, stored, words

MIN_WORDS, MAX_REPEATED = 50, 50
MIN_DOCS, MIN_LEFT = 20, 0.3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def bound(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for the row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_list(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(SOLID))


def flat_blanks(line: Column) -> Column:
    """White space runs as one space, none at the ends; lines that are so already are not rewritten."""
    return F.when(line.rlike(r"[\x09-\x0D]|  |^ | $"), F.trim(F.regexp_replace(line, SPACE + "+", " "))).otherwise(line)


def normal(line: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.lower(flat_blanks(line))


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window which occurs at least twice. Windows are hashed, the
    (hash, place) pairs sorted, and each place counts the words up to the next repeated place, 3 at most."""

    def places(pairs: Column) -> Column:
        twice = F.filter(
            pairs,
            lambda p, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"])) | (F.get(pairs, i + 1)["h"].eqNullSafe(p["h"])),
        )
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def whole(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
        return bound(bound(F.sort_array(grams), places), covered)

    return bound(w, lambda x: F.when(F.size(x) < 4, F.lit(0)).otherwise(whole(x))).cast("long")


def base_counts(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    lines = line_list(text)
    return {
        "n_words": n_words(text),
        "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words(text)),
    }


def hashed_lines(text: Column) -> Column:
    """(line, n) of each line with a word: the hash of the normalised line, its words."""
    return F.transform(line_list(text), lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), F.size(words(x)).alias("n")))


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(o_host, o_line): lines more than `min_docs` distinct texts of a host hold, from rows (host, text_hash, line)."""
    held = lines.select("host", "text_hash", "line").groupBy("host", "line").agg(F.countDistinct("text_hash").alias("docs"))
    return held.filter(F.col("docs") > min_docs).select(F.col("host").alias("o_host"), F.col("line").alias("o_line"))


def _over(df: DataFrame) -> Column:
    return df["host"].eqNullSafe(F.col("o_host")) & (df["line"] == F.col("o_line"))


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """One row per document: the base counts, base_failed, removed_lines, removed_words, kept."""
    text = F.col(text_col)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        *[c.alias(k) for k, c in base_counts(text).items()],
        hashed_lines(text).alias("lines"),
    )
    rows = stored(rows, "line-hashes")  # numbers of rows are fixed here
    lines = rows.select("row", "host", "text_hash", F.inline("lines"))
    over = frequent_lines(lines, min_docs)
    gone = lines.join(over, _over(lines), "left_semi").groupBy(F.col("row").alias("g_row")).agg(F.count("*").alias("removed_lines"), F.sum("n").alias("removed_words"))
    both = rows.drop("lines").join(gone, F.col("row") == F.col("g_row"), "left")
    removed = {k: F.coalesce(F.col(k), F.lit(0)).cast("long") for k in ("removed_lines", "removed_words")}
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - removed["removed_words"]
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        *[c.alias(k) for k, c in removed.items()],
        base_failed.alias("base_failed"),
        (~base_failed & (left >= min_left * F.col("n_words"))).alias("kept"),
    )


def without_frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with the lines above the limit of their host taken out of the texts; every row and column stays."""
    text, at = F.coalesce(F.col("text"), F.lit("")), {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*at.values()).withColumns({"host": F.col(at[host_col]), "text": F.col(at[text_col])}).withColumn("text_hash", F.xxhash64(text))
    each = own.select("host", "text_hash", F.posexplode(F.split(text, "\n")).alias("place", "raw")).filter(F.col("raw").rlike(SOLID))
    lines = stored(each.select("host", "text_hash", "place", F.xxhash64(normal(F.col("raw"))).alias("line")), "line-places")
    gone = lines.join(frequent_lines(lines, min_docs), _over(lines), "left_semi")
    gone = gone.groupBy(F.col("host").alias("g_host"), F.col("text_hash").alias("g_hash")).agg(F.collect_set("place").alias("places"))  # at most the lines of one text
    both = own.join(gone, F.col("host").eqNullSafe(F.col("g_host")) & (F.col("text_hash") == F.col("g_hash")), "left")
    kept = bound(F.split("text", "\n"), lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("places")), lambda p: F.get(all_, p)), "\n"))
    out = F.when(F.col("places").isNull(), F.col("text")).otherwise(kept)
    return both.select(*[(out if c == text_col else F.col(v)).alias(c) for c, v in at.items()])


SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT rid, unnest(generate_series(1, len(w) - 2)) AS i, w FROM t WHERE len(w) >= 3
), grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS times FROM places
), repeated AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE times >= 2) GROUP BY rid
), lines AS (
  SELECT rid, source, text, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
  FROM (SELECT rid, source, text, unnest(lines) AS l FROM t)
), over AS (
  SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT text) > 20
), gone AS (
  SELECT rid, count(*) AS gone_lines, sum(n) AS gone_words FROM lines l JOIN over o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line GROUP BY rid
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone_lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(gone_words, 0) AS BIGINT) AS removed_words
  FROM t LEFT JOIN repeated USING (rid) LEFT JOIN gone USING (rid)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT *, NOT base_failed AND n_words - removed_words >= 0.3 * n_words AS kept FROM based
"""
