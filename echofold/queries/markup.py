"""Markup components of pages, and language-neutral signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions import markup as M
from echofold.operators import candidates
from echofold.queries.views import table


def html_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    h = F.col("html")
    a = M.attributes(h)
    return p.select("page_id", M.component_type(h).alias("component_type"), M.structure_hash(h).alias("structure_hash"), *[F.coalesce(a[k], F.lit("")).alias(k) for k in a], F.md5(M.text_content(h)).alias("text_md5"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation, heading and footer elements of pages with their signatures; equal elements are one row."""
    p = table(spark, sf_dir, "pages")
    e = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)(<nav>.*?</nav>|<h1>.*?</h1>|<footer>.*?</footer>)"), 1)).alias("html"))
    e = e.groupBy("html").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
    kind = F.regexp_extract("html", "^<(\\w+)", 1)
    none = F.create_map().cast("map<string,string>")
    return e.select(F.concat(F.col("page_id").cast("string"), F.lit("/"), kind).alias("key"), kind.alias("component_type"), M.structure_hash(F.col("html")).alias("structure_hash"), none.alias("attributes"), M.text_content(F.col("html")).alias("text_content"), none.alias("styles"), "n")


def component_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of element structures of one type. Elements of one structure are alike by definition and are
    one class, named after its least key, so pairs stand between structures only."""
    e = _elements(spark, sf_dir).withColumn("text_content", F.regexp_replace("text_content", "[^\\x00-\\x7F]", "?"))
    first = e.groupBy("component_type", "structure_hash").agg(F.min_by(F.struct("key", "text_content"), F.struct("key", "text_content")).alias("f"))
    none = F.create_map().cast("map<string,string>")
    return candidates.component_pairs(first.select("component_type", "structure_hash", "f.key", "f.text_content", none.alias("attributes"), none.alias("styles")), 0.7)


def component_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by tag sequence."""
    s = table(spark, sf_dir, "pages").select("page_id", M.structure_hash(F.col("html")).alias("structure_hash"))
    return s.groupBy("structure_hash").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")).filter("n_pages > 1")


def universal_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    found = M.patterns_found(t, "programming")
    return d.select("doc_id", F.coalesce(F.get(found, 0), F.lit("unknown")).alias("component_type"), F.array_join(found, ",").alias("patterns"), F.round(M.complexity(t), 6).alias("complexity"))


QUERIES = {f.__name__: f for f in (html_signature, component_pairs, component_groups, universal_signature)}
_KIND = """[^>]*type\\s*=\\s*["'']([^"'']+)["'']"""
_HASH = "substring(sha256(array_to_string(regexp_extract_all(html, '<(/?[A-Za-z0-9_]+)', 1), '')), 1, 16)"
_TEXT = "lower(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g')))"
SQL = {
    "html_signature": f"""SELECT page_id, {M.component_type_sql("html")} AS component_type, {_HASH} AS structure_hash,
        array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)input{_KIND}', 1))), ',') AS input_types, lower(regexp_extract(html, '(?i)form[^>]*method\\s*=\\s*["'']([^"'']+)["'']', 1)) AS form_method,
        array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)(?:button|input){_KIND}', 1))), ',') AS button_types, md5({_TEXT}) AS text_md5 FROM pages""",
    "component_groups": f"SELECT {_HASH} AS structure_hash, count(*) AS n_pages, min(page_id) AS first_page FROM pages GROUP BY 1 HAVING count(*) > 1",
    "component_pairs": f"""WITH e AS (SELECT min(page_id) AS page_id, html FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<nav>.*?</nav>|<h1>.*?</h1>|<footer>.*?</footer>')) AS html FROM pages) GROUP BY html),
        s AS (SELECT page_id || '/' || regexp_extract(html, '^<(\\w+)', 1) AS key, regexp_extract(html, '^<(\\w+)', 1) AS kind, {_HASH} AS h, regexp_replace({_TEXT}, '[^\\x00-\\x7F]', '?', 'g') AS t FROM e),
        f AS (SELECT *, row_number() OVER (PARTITION BY kind, h ORDER BY key, t) AS n FROM s),
        p AS (SELECT a.key AS l, b.key AS r, round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE * (1 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t))) + 0.1::DOUBLE), 6) AS similarity
          FROM f a JOIN f b ON a.kind = b.kind AND a.n = 1 AND b.n = 1 AND a.h <> b.h AND a.key < b.key) SELECT * FROM p WHERE similarity >= 0.7""",
    "universal_signature": f"""WITH f AS (SELECT doc_id, text, {M.patterns_sql("text", "programming")} AS found FROM documents)
        SELECT doc_id, coalesce(found[1], 'unknown') AS component_type, array_to_string(found, ',') AS patterns,
        round(least(1.0::DOUBLE, (len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) / 100.0::DOUBLE + len(regexp_extract_all(text, '(?i)\\b({M.CONTROL})\\b')) / 20.0::DOUBLE
          + (length(text) - length(regexp_replace(text, '[{{(\\[]', '', 'g'))) / 50.0::DOUBLE) / 3.0::DOUBLE), 6) AS complexity FROM f""",
}
