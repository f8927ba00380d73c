"""Text functions as Column expressions: normalising, masking, hashing, tokens, MinHash and SimHash."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
PERMUTATIONS = 128
KEPT_WORDS = (
    "if else case switch match for foreach while do break continue try catch except finally raise throw return yield pass "
    "import from class def function new let var const async await with as and or not in true false none null"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalized(text: Column) -> Column:
    """Lines without comments, blank ends, docstring quotes and empty lines."""
    lines = F.filter(F.split(text, LINE_END), lambda x: ~x.rlike("^\\s*(\"\"\"|''')"))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, "#.*$", ""), "(?U)^\\s+|\\s+$", ""))
    return F.array_join(F.filter(bare, lambda x: x != ""), "\n")


def masked(norm: Column) -> Column:
    """Normalised text with string and number literals replaced."""
    out = F.regexp_replace(norm, '"[^"]*"', '"__STR__"')
    out = F.regexp_replace(out, "'[^']*'", "'__STR__'")
    return F.regexp_replace(out, "\\b\\d+\\.?\\d*\\b", "__NUM__")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, "\\s+"), lambda x: x != "")


def minhash_features(words: Column) -> Column:
    """At most ten: the first five words, up to five of the leading pairs, and triples while there is room."""

    def grams(w: Column, n: int) -> Column:
        some = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(some, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    def made(w: Column) -> Column:
        two = F.slice(grams(F.slice(w, 1, 6), 2), 1, 5)
        return F.slice(F.concat(F.slice(w, 1, 5), two, grams(F.slice(w, 1, 12), 3)), 1, 10)

    return let(words, made)


def minhash(n: int = PERMUTATIONS):
    """Arrow UDF: array of features -> the first 8 bytes of the least MD5 of `feature_seed` for the seeds 1 to n, in
    a row; null for a text without features."""

    @F.pandas_udf("binary")
    def run(features: pd.Series) -> pd.Series:
        from hashlib import md5

        seeds = [f"_{s}".encode() for s in range(1, n + 1)]

        def one(words: list[bytes]) -> bytes:
            raw = np.frombuffer(b"".join(md5(w + s).digest()[:8] for w in words for s in seeds), ">u8")
            return raw.reshape(len(words), n).min(0).astype(">u8").tobytes()

        return pd.Series([one([w.encode() for w in f]) if f is not None and len(f) else None for f in features], dtype="object")

    return run


def _constants(name: str, n: int) -> list[int]:
    from hashlib import md5

    return [int.from_bytes(md5(f"{name}_{s}".encode()).digest()[:8], "big") for s in range(1, n + 1)]


#: Permutation s takes a feature's hash x to FACTORS[s] * x + ADDENDS[s] modulo 2 ** 64; factors are odd.
FACTORS, ADDENDS = [a | 1 for a in _constants("factor", PERMUTATIONS)], _constants("addend", PERMUTATIONS)


def whole_minhash(text: str | None) -> bytes | None:
    """MinHash over every word, pair and triple of a text: of each permutation the least value (8 bytes, high byte
    first) over the features, a feature being the first 8 bytes of its MD5. Null for a text without words. A feature
    is hashed once, not once for each permutation, so that whole texts can be afforded."""
    from hashlib import md5

    words = (text or "").encode().split()
    if not words:
        return None
    features = {*words, *map(b" ".join, zip(words, words[1:])), *map(b" ".join, zip(words, words[1:], words[2:]))}
    x = np.frombuffer(b"".join([md5(f).digest()[:8] for f in features]), ">u8").astype(np.uint64)[:, None]
    a, b = np.array(FACTORS, np.uint64), np.array(ADDENDS, np.uint64)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i : i + 512] * a + b).min(0), out=least)
    return least.astype(">u8").tobytes()


def code_tokens(text: Column) -> Column:
    """Tokens of source text: comments dropped, strings STR, numbers NUM, other names ID, marks as they are."""
    bare = F.regexp_replace(text, "(?s)/\\*.*?\\*/", " ")
    bare = F.regexp_replace(bare, "//[^\\n]*|#[^\\n]*", " ")
    bare = F.regexp_replace(bare, "\"([^\"\\\\]|\\\\.)*\"|'([^'\\\\]|\\\\.)*'", " STR ")
    bare = F.regexp_replace(bare, "\\b[0-9]+(\\.[0-9]+)?\\b", " NUM ")
    found = F.regexp_extract_all(bare, F.lit("([A-Za-z_$][A-Za-z0-9_$]*|====?|!==?|<=|>=|=>|\\+\\+|--|&&|\\|\\||\\?\\?|[^ \\t\\n\\r\\x0b\\x0c])"), 1)
    return F.transform(found, lambda t: F.when(t.rlike("^[A-Za-z_$]") & ~F.lower(t).isin(*KEPT_WORDS), F.lit("ID")).otherwise(F.lower(t)))


def trigrams(tokens_: Column) -> Column:
    """Runs of three tokens, or the tokens themselves where there are fewer."""

    def made(w: Column) -> Column:
        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))).otherwise(w)

    return let(tokens_, made)


def portable_simhash(features: Column, bits: int = 32) -> Column:
    """SimHash from the first MD5 digits, high bit first, as a bit string; built-in functions only."""

    def one(h: Column) -> Column:
        votes = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.aggregate(h, F.lit(0), lambda s, v: s + F.when(F.substring(v, b + 1, 1) == "1", 1).otherwise(-1)))
        return F.array_join(F.transform(votes, lambda v: F.when(v >= 0, "1").otherwise("0")), "")

    digest = lambda f: F.lpad(F.conv(F.substring(F.md5(f), 1, bits // 4), 16, 2), bits, "0")
    return let(F.transform(features, digest), one)


def simhash(features: list[str] | None, bits: int = 64) -> str:
    """SimHash as a bit string, high bit first; equal to `portable_simhash`, but the votes of all bits are added
    up in NumPy."""
    from hashlib import md5

    if features is None or not len(features):
        return "1" * bits
    often = Counter(features)
    raw = np.frombuffer(b"".join([md5(x.encode()).digest()[: bits // 8] for x in often]), np.uint8)
    ones = np.array([*often.values()], np.int64) @ np.unpackbits(raw.reshape(len(often), -1), axis=1)
    return "".join("1" if v else "0" for v in (2 * ones >= len(features)))


def runs_of(words: list[str] | None, n: int) -> list[str] | None:
    return [*map(" ".join, zip(*[words[i:] for i in range(n)]))] if words and len(words) >= n > 1 else words


def simhashed(rows: DataFrame, features: str = "features", bits: int = 64, runs: int = 1) -> DataFrame:
    """Rows with `fp` in place of their features, which go from the JVM to the votes and are never written; with
    `runs`, the features are the runs of so many tokens (all tokens of shorter texts). Python holds the features of
    one row at a time, so its memory follows the longest text and not the length of a batch."""
    keep = [c for c in rows.columns if c != features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([simhash(runs_of(f.as_py(), runs), bits) for f in b.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], prints], [*keep, "fp"])

    kept = rows.select(*keep, features)
    return kept.mapInArrow(run, StructType([*(kept.schema[c] for c in keep), StructField("fp", StringType())]))


SYNONYMS = {
    "aggregate": "aggregate calculate compute sum", "total": "amount total", "cart": "basket", "create": "build create generate make",
    "validate": "check validate verify", "parse": "convert deserialize", "write": "emit post send", "read": "fetch get load read",
    "format": "format render serialize", "start": "launch", "delete": "remove", "stop": "stop terminate", "list": "list",
}
ALIASES = {w: k for k, ws in SYNONYMS.items() for w in ws.split()}
GENERIC = set("self this args main init initializer impl method function def class let var const if else for while in return true false none null async await handler callback arrow run".split())


def identifier_words(value: Column) -> Column:
    """Words of a camelCase, snake_case or kebab-case name, lower case, synonyms made one."""
    spaced = F.translate(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), "_-", "  ")
    found = F.regexp_extract_all(spaced, F.lit("([A-Za-z][A-Za-z0-9]*)"), 1)
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.transform(found, lambda w: F.coalesce(F.element_at(alias, F.lower(w)), F.lower(w)))


def ordered_unique(words: Column, limit: int = 24) -> Column:
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*sorted(GENERIC)))), 1, limit)


OPERATIONS = {
    "iterate": "\\b({})\\b".format("|".join("for foreach map reduce filter while".split())),
    "branch": "\\b({})\\b".format("|".join("if else switch case match".split())),
    "error_handling": "\\b({})\\b".format("|".join("try except catch raise throw".split())),
    "async": "\\b({})\\b".format("|".join("async await promise".split())),
    "return": "\\breturn\\b",
    "arithmetic": "(^|[^+*])[+*/%]($|[^+*])",
    "comparison": "==|!=|<|>",
}


def intent_profile(text: Column, function_name: Column, suffix: Column) -> dict[str, Column]:
    """Columns purpose, calls, data, domain, operations, comments, language."""

    def words_of(found: Column, last: bool = False) -> Column:
        return ordered_unique(F.flatten(F.transform(found, lambda n: identifier_words(F.element_at(F.split(n, "\\."), -1) if last else n))))

    quoted = F.transform(F.regexp_extract_all(text, F.lit("(\"[^\"\\n]{1,80}\"|'[^'\\n]{1,80}')"), 1), lambda q: F.substring(q, 2, F.length(q) - 2))
    low = F.lower(text)
    return {
        "purpose": ordered_unique(identifier_words(F.coalesce(function_name, F.lit(""))), 10),
        "calls": words_of(F.regexp_extract_all(text, F.lit("\\b([A-Za-z_$][A-Za-z0-9_$.]*)\\s*\\("), 1), last=True),
        "data": words_of(quoted),
        "domain": words_of(F.regexp_extract_all(text, F.lit("\\b([A-Za-z_$][A-Za-z0-9_$]*)\\b"), 1)),
        "operations": F.filter(F.array(*[F.when(low.rlike(p), k) for k, p in OPERATIONS.items()]), lambda x: x.isNotNull()),
        "comments": F.slice(F.regexp_extract_all(text, F.lit("(?:#|//)[ \\t]*([^\\n]{3,160})"), 1), 1, 3),
        "language": F.when(suffix == "", "unknown").otherwise(F.lower(suffix)),
    }


def semantic_document(profile: dict[str, Column], text: Column) -> Column:
    """Labelled fields and the first 6000 characters, as an encoder would read them."""
    parts = [F.concat(F.lit(f"{k}: "), profile[k] if k == "language" else F.array_join(profile[k], " ")) for k in ("language", "purpose", "calls", "data", "domain", "operations")]
    said = F.when(F.size(profile["comments"]) > 0, F.concat(F.lit("description: "), F.array_join(profile["comments"], " ")))
    return F.concat_ws("\n", *parts, said, F.concat(F.lit("implementation:\n"), F.substring(text, 1, 6000)))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))


def component_root(parts: Column) -> Column:
    """The first part, or the first two below `examples`."""
    return F.when((F.size(parts) > 1) & (F.get(parts, 0) == "examples"), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.coalesce(F.get(parts, 0), F.lit("")))


def common_prefix(names: Column) -> Column:
    """Longest common prefix of the non-empty strings of an array: that of its least and greatest."""

    def made(s: Column) -> Column:
        a, b = F.array_min(s), F.array_max(s)
        lengths = F.transform(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: F.when(F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n), n).otherwise(0))
        return F.when(F.size(s) > 0, F.substring(a, F.lit(1), F.array_max(lengths))).otherwise("")

    return let(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != ""), made)
