"""Line de-duplication with a log-template tree.

Every line with a word is normalised (lower case, single blanks) and its variable fields, the tokens
with a digit, become `<*>`. The tree has a fixed depth: first the number of tokens, then the first
`depth` tokens. Within a leaf a token is constant if `min_docs` documents have it at that place; every
other place is a variable field too. The line's template is what is constant (kept as the xor of the
hashes of its leaf, places and tokens); a template recurs if `min_docs` documents have a line of it and at
least `fixed` of its tokens are constant. Lines of recurring templates are dropped from every document but the
one with the lowest id, so nothing disappears from the corpus as a whole. Documents are distinct texts: exact
copies are one text and left to document de-duplication, and many lines of one text count once.
A short line ("Read more") is a leaf of its own and recurs as a whole line.

Scale: what is shuffled is one row of hashes per line; the normalised lines are written beside them and
read again for lines of leaves that can recur only, of which one occurrence each gives the words. Lines that
`min_docs` texts hold make their tokens constant and their template recurring by themselves; documents are
counted apart for lines of fewer texts, so no count expands a hot line. The text moves once, when the
dropped places come back to it. The one broadcast has at most `BUCKETS` small rows, whatever the input; it
only keeps rows out of a join, and a corpus that fills it shuffles each line once. No step collects a group.

Edge cases: null and blank texts have no lines and are left as they are; blank lines stay in place; a
null id sorts last when the keeper is chosen; repeated rows of one id and text get the same places
dropped; an empty table gives an empty result; other columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import SOLID, stored
from echofold.llm.quality_rules import bound, normal

MIN_DOCS, DEPTH, FIXED = 10, 4, 0.6
BUCKETS = 1 << 18
_LAST = 2**63 - 1


def masked(flat: Column) -> Column:
    """A normalised line with its variable fields as `<*>`; lines without a digit are not rewritten."""
    return F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, "(^| )[^ 0-9]*+[0-9][^ ]*", "$1<*>")).otherwise(flat)


def line_rows(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """(id, text_hash, place, masked, n, line, leaf): one row per line with a word; line and leaf are hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("place", "raw"))
    rows = rows.filter(F.col("raw").rlike(SOLID)).select("id", "text_hash", "place", normal(F.col("raw")).alias("flat"))
    rows = rows.select("id", "text_hash", "place", masked(F.col("flat")).alias("masked"))
    rows = rows.withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
    return rows.withColumns({"line": F.xxhash64("masked"), "leaf": F.xxhash64("n", F.substring_index("masked", " ", depth))})


def recurring_lines(lines: DataFrame, min_docs: int, fixed: float) -> DataFrame:
    """(line, keeper) of the lines whose template recurs, from `lines`, the stored rows of line_rows."""
    texts = stored(lines.groupBy("line", "text_hash").agg(F.max("leaf").alias("leaf"), F.max("n").alias("n"), F.min(F.coalesce("id", F.lit(_LAST))).alias("id")), "line-texts")
    held = texts.groupBy("line").agg(F.max("leaf").alias("leaf"), F.max("n").alias("n"), F.count("*").alias("texts"), F.min("id").alias("id"), F.min("text_hash").alias("in_text"))
    held = stored(held, "line-counts")
    hot = held.groupBy("leaf").agg(F.sum("texts").alias("in_leaf")).filter(F.col("in_leaf") >= min_docs).select(F.col("leaf").alias("hot_leaf"))
    hot_lines = stored(held.join(hot, F.col("leaf") == F.col("hot_leaf"), "left_semi"), "hot-lines")
    rare = hot_lines.filter(F.col("texts") < min_docs).select(F.col("line").alias("r_line"))
    holders = stored(texts.select("line", "text_hash").join(rare, F.col("line") == F.col("r_line"), "left_semi"), "rare-holders")

    def often(rows: DataFrame, key: list[str], extra: list) -> DataFrame:
        """The keys of rows (line, texts, key) that `min_docs` documents hold: by one line of so many texts, or by
        distinct texts of all their lines, which are counted only where the sum of both reaches it."""
        sums = rows.groupBy(*key).agg(F.sum("texts").alias("most"), F.max("texts").alias("one"), *extra).filter(F.col("most") >= min_docs)
        sums = stored(sums, "often")
        names = [F.col(k).alias(f"k_{k}") for k in key]
        same = lambda df: [df[k] == F.col(f"k_{k}") for k in key]
        open_ = sums.filter(F.col("one") < min_docs).select(*names)
        some = rows.join(open_, same(rows), "left_semi").select("line", *key)
        enough = some.join(holders, "line").groupBy(*key).agg(F.countDistinct("text_hash").alias("docs")).filter(F.col("docs") >= min_docs).select(*names)
        return sums.filter(F.col("one") >= min_docs).unionByName(sums.join(enough, same(sums), "left_semi")).drop("most", "one")

    # the words of hot lines only: a filter of at most BUCKETS rows keeps the others out of the shuffle
    bucket = F.pmod(F.col("line"), F.lit(BUCKETS)).cast("int")
    some = hot_lines.select(bucket.alias("bucket")).distinct()
    read = lines.select("line", "text_hash", "masked").withColumn("bucket", bucket).join(F.broadcast(some), "bucket", "left_semi").drop("bucket")
    asked = hot_lines.select(F.col("line").alias("h_line"), F.col("in_text").alias("h_text"), "leaf", "texts")
    words = read.join(asked, (F.col("line") == F.col("h_line")) & (F.col("text_hash") == F.col("h_text")))
    tokens = words.dropDuplicates(["line"]).select("line", "leaf", "texts", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    tokens = stored(tokens.filter(F.col("token") != "<*>").select("line", "texts", F.xxhash64("leaf", "place", "token").alias("spot")), "hot-tokens")
    constant = often(tokens, ["spot"], []).select(F.col("spot").alias("c_spot"))
    shape = tokens.join(constant, F.col("spot") == F.col("c_spot"), "left_semi").groupBy("line").agg(F.bit_xor("spot").alias("template"), F.count("*").alias("constants"))
    known = hot_lines.select("line", "leaf", "n", "texts", "id")
    shape = stored(shape.join(known, "line").filter(F.col("constants") >= F.col("n") * fixed), "line-shapes")
    key = ["leaf", "template", "constants"]
    found = often(shape, key, [F.min("id").alias("keeper")]).select(*[F.col(k).alias(f"o_{k}") for k in key], "keeper")
    return shape.join(found, [F.col(k) == F.col(f"o_{k}") for k in key]).select("line", "keeper")


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    depth: int = DEPTH,
    fixed: float = FIXED,
) -> DataFrame:
    """(row, n_lines, n_dropped, kept): every input row as a struct, and its text without the dropped lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = stored(line_rows(docs, id_col, text_col, depth), "lines")
    drop = recurring_lines(lines, min_docs, fixed).select(F.col("line").alias("d_line"), "keeper")
    gone = (
        lines.join(drop, (F.col("line") == F.col("d_line")) & (F.coalesce("id", F.lit(_LAST)) != F.col("keeper")))
        .groupBy(F.col("id").alias("g_id"), F.col("text_hash").alias("g_hash"))
        .agg(F.collect_set("place").alias("places"))  # at most the lines of one text
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"))
    own = F.col(f"row.`{text_col}`")
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("hash") == F.col("g_hash")), "left")
    parts = F.split(own, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), own).otherwise(F.array_join(bound(parts, lambda all_: F.transform(places, lambda p: F.get(all_, p))), "\n"))
    n_lines = F.size(F.filter(F.split(F.coalesce(own, F.lit("")), "\n"), lambda x: x.rlike(SOLID)))
    return both.select("row", "id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def without_recurring_lines(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """`docs` with the recurring lines taken out of the texts; every row and column stays."""
    done = deduplicated(docs, text_col=text_col, **options)
    return done.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_md5 (of the text that stays; null: empty)."""
    done = deduplicated(docs, **options)
    return done.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), raw AS (
  SELECT doc_id, rid, text, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(1, len(string_split(text, chr(10))))) AS place FROM t
), marked AS (
  SELECT *, regexp_matches(raw, '[^ 	-
]') AS holds,
         regexp_replace(lower(trim(regexp_replace(raw, '[ 	-
]+', ' ', 'g'))), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line
  FROM raw
), held AS (
  SELECT line, count(DISTINCT text) AS texts, min(coalesce(doc_id, 9223372036854775807)) AS keeper, string_split(line, ' ') AS tokens
  FROM marked WHERE holds GROUP BY line
), holders AS (
  SELECT DISTINCT line, text FROM marked WHERE holds
), leaves AS (
  SELECT *, concat_ws(' ', len(tokens), array_to_string(tokens[1:4], ' ')) AS leaf FROM held
), hot AS (
  SELECT * FROM leaves WHERE leaf IN (SELECT leaf FROM leaves GROUP BY leaf HAVING sum(texts) >= 10)
), places AS (
  SELECT leaf, line, keeper, len(tokens) AS n, unnest(tokens) AS token, unnest(generate_series(1, len(tokens))) AS place FROM hot
), constant AS (
  SELECT leaf, place, token FROM places JOIN holders USING (line) WHERE token <> '<*>' GROUP BY leaf, place, token HAVING count(DISTINCT text) >= 10
), shape AS (
  SELECT p.line, any_value(p.keeper) AS keeper,
         any_value(p.leaf) || ': ' || string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY p.place) AS template, count(c.token) AS constants, any_value(p.n) AS n
  FROM places p LEFT JOIN constant c USING (leaf, place, token) GROUP BY p.line
), often AS (
  SELECT template, min(keeper) AS keeper FROM shape JOIN holders USING (line) WHERE constants >= n * 0.6 GROUP BY template HAVING count(DISTINCT text) >= 10
), gone AS (
  SELECT line, often.keeper FROM shape JOIN often USING (template) WHERE constants >= n * 0.6
), judged AS (
  SELECT m.rid, m.doc_id, m.place, m.raw, m.holds, m.holds AND g.line IS NOT NULL AND coalesce(m.doc_id, 9223372036854775807) <> g.keeper AS dropped
  FROM marked m LEFT JOIN gone g ON m.holds AND m.line = g.line
)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (holds) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT coalesce(dropped, false)), '')) AS kept_md5
FROM judged GROUP BY rid
"""
