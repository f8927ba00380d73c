"""Normal forms and signatures, cached hashes, and matches across two corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.functions import markup as M
from echofold.functions import text as T
from echofold.functions.similarity import evidence, levenshtein_ratio, rounded
from echofold.operators import candidates, compare, grouping, metrics, state
from echofold.queries import changes, semantic, similar
from echofold.queries.views import BLOCKS, blocks, documents, file_name, masked_sql, norm_sql, table, url_blocks
from echofold.sources import files

#: Texts of four shapes whose names all differ.
CODE = ("def f{i}(a{i}):\n    return a{i} + {i}\n", "def f{i}(a{i}):\n    return a{i} * {i}\n", "def g{i}():\n    for x{i} in h{i}:\n        print(x{i}, 'v{i}')\n", "class C{i}:\n    v{i} = {i} < {i}\n")


def syntax_structural_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python texts made of document ids: equal in structure when they differ in names and values only."""
    text = F.element_at(F.array(*map(F.lit, CODE)), (F.col("doc_id") % len(CODE) + 1).cast("int"))
    d = documents(spark, sf_dir).select(file_name().alias("file"), F.replace(text, F.lit("{i}"), F.col("doc_id").cast("string")).alias("text"))
    one = F.lit(1)
    none = F.lit(None).cast("string")
    b = grouping.hashed(d.select("file", one.alias("line_start"), F.size(F.split("text", "\n")).alias("line_end"), "text", none.alias("function_name"), none.alias("class_name")), syntax=True)
    return grouping.members_of(b, "structural_hash", "structural").groupBy("group_id").agg(F.count("*").alias("occurrences"), F.min("file").alias("first_file")).drop("group_id")


def normalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(M.normalized_html(F.col("html"))).alias("normal_md5"))


def style_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of style values made of page ids."""
    n = F.col("page_id")
    css = F.concat(F.lit(".a { color: #"), n.cast("string"), F.lit("; margin: "), (n % 70).cast("string"), F.lit("px; padding: "), F.when(n % 3 == 0, "Auto").otherwise("3PX"), F.when(n % 5 == 0, "; font-size: 12px").otherwise(""), F.lit(" }"))
    got = table(spark, sf_dir, "pages").select("page_id", M.style_properties(css).alias("s"))
    return got.select("page_id", *[F.element_at("s", p).alias(p.replace("-", "_")) for p in M.STYLE_PROPERTIES])


_LANGUAGES = ("python", "c", "sql", "html")


def universal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.element_at(F.array(*map(F.lit, _LANGUAGES)), (F.col("doc_id") % 4 + 1).cast("int"))
    d = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("x_1 = 'a' /* b */ + 3 // c\n"), "text").alias("text"), language.alias("language"))
    return d.select("doc_id", F.md5(M.universal_normal(F.col("text"), F.col("language"))).alias("normal_md5"))


def universal_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.metadata(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", *[v.alias(k) for k, v in m.items()])


def universal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of page signatures; pages of one signature are one point."""
    h = F.col("html")
    found = M.patterns_found(h, "template")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.get(found, 0).alias("component_type"), F.lit("template").alias("family"), M.structure_hash(h).alias("structure_hash"), found.alias("patterns"), F.split(M.metadata(h)["tags"], ",").alias("metadata"))
    return candidates.universal_pairs(p)


def semantic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = similar.turns(spark, sf_dir)
    return c.select("key", F.md5(T.semantic_document(T.intent_profile(F.col("text"), F.col("name"), F.lit("")), F.col("text"))).alias("document_md5"))


def evidence_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why intent pairs were found: shared terms by field."""
    c = similar.turns(spark, sf_dir)
    p = c.select("key", *[v.alias(k) for k, v in T.intent_profile(F.col("text"), F.col("name"), F.lit("")).items()])
    names = [x for x in p.columns if x != "key"]
    side = lambda s: p.select(F.col("key").alias(s), *[F.col(x).alias(f"{s}_{x}") for x in names])
    both = similar.intent_candidate_pairs(spark, sf_dir).select("l", "r").join(side("l"), "l").join(side("r"), "r")
    e = evidence(*({x: F.col(f"{s}_{x}") for x in names} for s in "lr"))
    return both.select("l", "r", e.alias("e")).select("l", "r", "e.intent_similarity", *[F.array_join(f"e.shared.{x}", " ").alias(x) for x in ("purpose", "calls", "data", "domain", "operations")])


def cached_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose hashes an earlier scan left, and those to hash."""
    d = documents(spark, sf_dir).select("doc_id", file_name().alias("file_path"), F.sha2("text", 256).alias("file_hash"), F.lit(1).alias("block_start"), F.size(F.split("text", "\n")).alias("block_end"))
    old = d.filter("doc_id % 5 <> 0").withColumns({"file_hash": F.when(F.col("doc_id") % 7 == 0, F.lit("changed")).otherwise(F.col("file_hash")), "block_hash": F.md5("file_hash"), "structural_hash": F.lit("s")})
    known, left = state.with_cached_hashes(d, old)
    return known.select("file_path", F.lit("cached").alias("status")).unionByName(left.select("file_path", F.lit("to hash").alias("status")))


def identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each identity, which the text stands for here."""
    d = documents(spark, sf_dir).select(file_name().alias("path"), F.md5("text").alias("real_path"))
    return files.first_of_each(d.filter("path IS NOT NULL AND real_path IS NOT NULL"))


def reference_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of structural groups of page paths that are close to the first one."""
    b = url_blocks(spark, sf_dir)
    near = grouping.reference_matches(grouping.structural_members(b, grouping.exact_members(b)), levenshtein_ratio, 0.85)
    return near.select("group_id", "file", F.round("similarity", 6).alias("similarity"))


def flattened_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = semantic.semantic_pairs_cosine(spark, sf_dir)
    name = lambda c: F.concat(F.lit("v/"), F.col(c).cast("string"))
    return grouping.flattened(p.select(name("l").alias("l_file"), F.lit(1).alias("l_line"), name("r").alias("r_file"), F.lit(1).alias("r_line")))


def best_function_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest functions that even and odd sources share."""
    return compare.best_matches(compare.structural_matches(*changes.halves(spark, sf_dir)))


def cross_corpus_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even ids close to vectors of odd ids."""
    v = semantic.vectors(spark, sf_dir)
    found = candidates.cosine_pairs(v.filter("id % 2 = 0"), semantic.THRESHOLD, other=v.filter("id % 2 = 1"))
    return found.select(F.col("l").alias("id_a"), F.col("r").alias("id_b"), rounded(F.col("similarity")).alias("similarity"))


def cross_corpus_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash pairs between the signature classes of even and of odd sources."""
    s = similar.signatures(spark, sf_dir)
    even = "CAST(regexp_extract(file, '^src([0-9]+)/', 1) AS INT) % 2 = 0"
    a, b = (candidates.signature_classes(s.filter(c), "file", "signature")[0] for c in (even, f"NOT ({even})"))
    return candidates.minhash_pairs(a, 0.8, b).select("l", "r", F.round("similarity", 6).alias("similarity"))


def similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.similarity_histogram(similar.minhash_pairs(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        syntax_structural_groups, normalized_pages, style_signature, universal_documents, universal_metadata, universal_pairs, semantic_documents, evidence_of_pairs, cached_hashes,
        identity_dedup, reference_matches, flattened_matches, best_function_matches, cross_corpus_semantic, cross_corpus_lsh, similarity_histogram,
    )
}


def _chain(text: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return text


_HTML = _chain(
    "html",
    ("id\\s*=\\s*[\"'][^\"']+[\"']", ""),
    *[(f"(class\\s*=\\s*[\"'][^\"']*?)\\b{f}-[\\w-]+", f"\\1{f}-*") for f in M.CLASS_FAMILIES],
    (f"(class\\s*=\\s*[\"'](?:[^\"']*?\\s)?)(?:{'|'.join(M.VARIANTS)})([\\s\"'])", "\\1*-variant\\2"),
    (">\\s+<", "><"),
    ("(\\w+)\\s*=\\s*[\"']([^\"']*)[\"']", '\\1="\\2"'),
)
_NORMAL = _chain("t", ("\"[^\"]*\"|'[^']*'", "STRING_LITERAL"), ("\\b[0-9]+(\\.[0-9]+)?\\b", "NUMBER"))
_IDENT = f"CASE WHEN language IN ('python', 'c') THEN {_chain(_NORMAL, (chr(92) + 'b[a-z_][a-z0-9_]*(' + chr(92) + 's*=[^=])', 'IDENT' + chr(92) + '1'))} ELSE {_NORMAL} END"
_META = {"functions": M.LANGUAGE_NAMES, "classes": M.TYPE_NAMES, "selectors": "([.#]?[\\w-]+)\\s*\\{", "tags": "<(\\w+)", "keys": "[\"']?(\\w+)[\"']?\\s*:"}
_META = {k: "array_to_string(regexp_extract_all(html, '{}', 1)[1:5], ',')".format(p.replace("'", "''")) for k, p in _META.items()}
_BUCKET = """CASE WHEN v IS NULL OR v = '' THEN NULL WHEN v LIKE '#%' THEN 'color-hex' WHEN regexp_matches(v, '^[0-9]+px$') THEN 'size-' || CASE WHEN CAST(v[:-3] AS INT) < 5 THEN 'xs' WHEN CAST(v[:-3] AS INT) < 10 THEN 'sm'
    WHEN CAST(v[:-3] AS INT) < 20 THEN 'md' WHEN CAST(v[:-3] AS INT) < 50 THEN 'lg' ELSE 'xl' END ELSE lower(v) END"""
_STRUCTURE = "substring(sha256(array_to_string(regexp_extract_all(html, '<(/?[A-Za-z0-9_]+)', 1), '')), 1, 16)"
_FIELDS = ("purpose", "calls", "data", "domain", "operations")
_BOTH = "list_intersect(a.{0}, b.{0})"
SQL = {
    "syntax_structural_groups": "SELECT count(*) AS occurrences, min(source || '/' || doc_id || '.' || lang) AS first_file FROM documents GROUP BY doc_id % 4 HAVING count(*) > 1",
    "normalized_pages": f"SELECT page_id, md5(trim({_HTML})) AS normal_md5 FROM pages",
    "style_signature": "WITH s AS (SELECT page_id, unnest([{}]) AS p, unnest([{}]) AS v FROM pages) SELECT page_id, {} FROM s GROUP BY page_id".format(
        ", ".join(f"'{p}'" for p in M.STYLE_PROPERTIES),
        "'#' || page_id, NULL, CASE WHEN page_id % 5 = 0 THEN '12px' END, (page_id % 70) || 'px', CASE WHEN page_id % 3 = 0 THEN 'Auto' ELSE '3PX' END",
        ", ".join(f"max({_BUCKET}) FILTER (p = '{p}') AS {p.replace('-', '_')}" for p in M.STYLE_PROPERTIES),
    ),
    "universal_documents": "WITH d AS (SELECT doc_id, 'x_1 = ''a'' /* b */ + 3 // c' || chr(10) || text AS text, ['python', 'c', 'sql', 'html'][doc_id % 4 + 1] AS language FROM documents), "
    + "n AS (SELECT doc_id, language, CASE language {} END AS t FROM d)".format(" ".join(f"WHEN '{k}' THEN regexp_replace(text, '{p.replace(chr(92) * 2, chr(92))}', ' ', 'g')" for k, p in M.COMMENTS.items()))
    + f" SELECT doc_id, md5(trim(regexp_replace({_IDENT}, '\\s+', ' ', 'g'))) AS normal_md5 FROM n",
    "universal_metadata": f"SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _META.items())} FROM pages",
    "universal_pairs": f"""WITH s AS (SELECT page_id, {M.patterns_sql("html", "template")} AS patterns, {_STRUCTURE} AS h, string_split({_META["tags"]}, ',') AS m FROM pages),
        p AS (SELECT min(page_id) AS key, patterns[1] AS kind, h, patterns, m FROM s GROUP BY patterns, h, m),
        x AS (SELECT a.key AS l, b.key AS r, round(0.2::DOUBLE + CASE WHEN a.kind IS NOT DISTINCT FROM b.kind THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN a.h = b.h THEN 0.3::DOUBLE ELSE 0 END
          + 0.1::DOUBLE * coalesce(len(list_intersect(a.patterns, b.patterns)) / nullif(len(list_distinct(list_concat(a.patterns, b.patterns))), 0)::DOUBLE, 1)
          + 0.1::DOUBLE * len(list_intersect(a.m, b.m)) / len(list_distinct(list_concat(a.m, b.m))), 6) AS similarity FROM p a JOIN p b ON a.key < b.key) SELECT * FROM x WHERE similarity >= 0.7""",
    "semantic_documents": f"""WITH {similar.PROFILES}, c AS (SELECT key, text, regexp_extract_all(text, '(?:#|//)[ \\t]*([^\\n]{{3,160}})', 1)[1:3] AS said FROM turns)
        SELECT key, md5('language: unknown' || {' || '.join(f"chr(10) || '{k}: ' || array_to_string({k}, ' ')" for k in _FIELDS)} || CASE WHEN len(said) > 0 THEN chr(10) || 'description: ' || array_to_string(said, ' ') ELSE '' END
          || chr(10) || 'implementation:' || chr(10) || substring(text, 1, 6000)) AS document_md5 FROM profiles JOIN c USING (key)""",
    "evidence_of_pairs": similar.SQL["intent_candidate_pairs"].replace("SELECT l, r, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.30", "")
    + "SELECT l, r, round(similarity, 3) AS intent_similarity, {} FROM scored JOIN profiles a ON a.key = l JOIN profiles b ON b.key = r WHERE similarity >= 0.30".format(", ".join(f"array_to_string(list_sort({_BOTH.format(k)}), ' ') AS {k}" for k in _FIELDS)),
    "cached_hashes": "SELECT source || '/' || doc_id || '.' || lang AS file_path, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'cached' ELSE 'to hash' END AS status FROM documents",
    "identity_dedup": "SELECT min(source || '/' || doc_id || '.' || lang) AS path, md5(text) AS real_path FROM documents WHERE text IS NOT NULL AND source || '/' || doc_id || '.' || lang IS NOT NULL GROUP BY text",
    "reference_matches": f"""WITH u AS (SELECT 'page/' || page_id AS file, {norm_sql("regexp_replace(url, '^[a-z]+://[^/]*', '')")} AS norm FROM pages),
        h AS (SELECT file, norm, substring(sha256({masked_sql("norm")}), 1, 16) AS sh FROM u), m AS (SELECT *, count(*) OVER (PARTITION BY sh) AS n, first_value(norm) OVER (PARTITION BY sh ORDER BY file) AS first FROM h
          WHERE norm NOT IN (SELECT norm FROM h GROUP BY norm HAVING count(*) > 1)), r AS (SELECT 'S' || sh AS group_id, file, CASE WHEN norm = first THEN 1.0::DOUBLE ELSE 1 - levenshtein(first, norm)::DOUBLE / greatest(length(first), length(norm)) END AS s FROM m WHERE n > 1)
        SELECT group_id, file, round(s, 6) AS similarity FROM r WHERE s >= 0.85""",
    "flattened_matches": f"WITH {semantic.PAIRS} SELECT DISTINCT 'v/' || unnest([l, r]) AS file, 1 AS line_start FROM pairs",
    "best_function_matches": f"""WITH {changes.HALVES}, m AS (SELECT a.function_name AS function_a, b.function_name AS function_b, a.file AS file_a, b.file AS file_b, CAST(greatest(a.line_end - a.line_start, b.line_end - b.line_start) AS INTEGER) AS loc
          FROM halves a JOIN halves b ON a.structural_hash = b.structural_hash AND a.even AND NOT b.even) SELECT function_a, function_b, file_a, file_b, 1.0::DOUBLE AS similarity, max(loc) AS loc FROM m GROUP BY ALL HAVING max(loc) > 2""",
    "cross_corpus_semantic": f"WITH {semantic.PAIRS} SELECT CASE WHEN l % 2 = 0 THEN l ELSE r END AS id_a, CASE WHEN l % 2 = 0 THEN r ELSE l END AS id_b, round(round(s, 6), 4) AS similarity FROM pairs WHERE (l + r) % 2 = 1",
    "cross_corpus_lsh": f"""WITH {similar.CLASSES}, side AS (SELECT min(file) AS key, CAST(regexp_extract(file, '^src([0-9]+)/', 1) AS INT) % 2 = 0 AS even, signature FROM signed GROUP BY even, signature),
        places AS (SELECT key, even, unnest(signature) AS h, unnest(generate_series(1, 128)) AS p FROM side)
        SELECT a.key AS l, b.key AS r, round(count(*) / 128.0::DOUBLE, 6) AS similarity FROM places a JOIN places b ON a.p = b.p AND a.h = b.h AND a.even AND NOT b.even GROUP BY 1, 2 HAVING count(*) >= 103""",
    "similarity_histogram": f"""WITH p AS ({similar.SQL["minhash_pairs"]}) SELECT CASE WHEN similarity >= 0.95 THEN '95-100' WHEN similarity >= 0.90 THEN '90-95' WHEN similarity >= 0.85 THEN '85-90' WHEN similarity >= 0.80 THEN '80-85' ELSE 'below 80' END AS bucket, count(*) AS n FROM p GROUP BY 1""",
}
