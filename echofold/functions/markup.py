"""Component signatures of markup and styles, and language-neutral signatures of any text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _then(first: str, later: str) -> str:
    return f"{first}.*?(?:{_any(later)})"


def _any(words: str) -> str:
    return "|".join(words.split())


#: In order: the first that is found names the component. Written so that RE2 and Java agree.
COMPONENTS = [
    ("form", _then("form", "input button textarea select")),
    ("button", "button|" + "|".join(f"input.*type.*=.*[\"']{k}[\"']" for k in ("submit", "button"))),
    ("card", f"(?:{_then('(?:card|panel|tile|section)', 'header body footer')}|div.*class.*(?:{_any('card panel tile')}))"),
    ("navigation", f"{_any('nav navigation navbar')}|{_then('menu', 'ul li a')}"),
    ("table", _then("table", "tr td th thead tbody")),
    ("list", "ul|ol.*li"),
    ("modal", f"{_any('modal dialog')}|{_then('popup', 'overlay backdrop')}"),
    ("header", f"header|{_then('head', 'nav logo menu')}"),
    ("footer", _then("footer", "link copyright contact")),
]
CLASS_FAMILIES = ("btn", "form", "card", "nav")
VARIANTS = "primary secondary success danger warning info".split()


def component_type(html: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(COMPONENTS):
        out = F.when(html.rlike("(?is)" + pattern), name).otherwise(out)
    return out


def component_type_sql(html: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({html}, '(?is){p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in COMPONENTS)
    return f"CASE {whens} END"


def normalized_html(html: Column) -> Column:
    """Without ids, classes reduced to families, no blanks between tags, attributes quoted alike."""
    out = F.regexp_replace(html, "id\\s*=\\s*[\"'][^\"']+[\"']", "")
    for family in CLASS_FAMILIES:
        out = F.regexp_replace(out, f"(class\\s*=\\s*[\"'][^\"']*?)\\b{family}-[\\w-]+", f"$1{family}-*")
    out = F.regexp_replace(out, f"(class\\s*=\\s*[\"'](?:[^\"']*?\\s)?)(?:{'|'.join(VARIANTS)})([\\s\"'])", "$1*-variant$2")
    out = F.regexp_replace(out, ">\\s+<", "><")
    return F.trim(F.regexp_replace(out, "(\\w+)\\s*=\\s*[\"']([^\"']*)[\"']", '$1="$2"'))


def _distinct_join(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.array_join(F.array_sort(F.array_distinct(found)), ","))


def attributes(html: Column) -> dict[str, Column]:
    kind = "[^>]*type\\s*=\\s*[\"']([^\"']+)[\"']"
    return {
        "input_types": _distinct_join(F.regexp_extract_all(html, F.lit("(?i)input" + kind), 1)),
        "form_method": F.nullif(F.lower(F.regexp_extract(html, "(?i)form[^>]*method\\s*=\\s*[\"']([^\"']+)[\"']", 1)), F.lit("")),
        "button_types": _distinct_join(F.regexp_extract_all(html, F.lit("(?i)(?:button|input)" + kind), 1)),
    }


def text_content(html: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "[ \\t\\n\\r\\x0b\\x0c]+", " ")))


def structure_hash(html: Column) -> Column:
    tags = F.regexp_extract_all(html, F.lit("<(/?[A-Za-z0-9_]+)"), 1)
    return F.substring(F.sha2(F.array_join(tags, ""), 256), 1, 16)


STYLE_PROPERTIES = "color background font-size margin padding".split()


def style_properties(css: Column) -> Column:
    """Map of the five properties to value buckets."""

    def bucket(v: Column) -> Column:
        px = F.regexp_extract(v, "^([0-9]+)px$", 1).try_cast("int")
        size = F.when(px < 5, "xs").when(px < 10, "sm").when(px < 20, "md").when(px < 50, "lg").otherwise("xl")
        return F.when(v.startswith("#"), "color-hex").when(px.isNotNull(), F.concat(F.lit("size-"), size)).otherwise(F.lower(v))

    found = [F.trim(F.regexp_extract(css, f"(?i)(?:^|[;{{\\s]){p}\\s*:\\s*([^;}}]+)", 1)) for p in STYLE_PROPERTIES]
    pairs = F.filter(F.array(*[F.struct(F.lit(p).alias("k"), f.alias("v")) for p, f in zip(STYLE_PROPERTIES, found, strict=True)]), lambda s: s["v"] != "")
    return F.map_from_entries(F.transform(pairs, lambda s: F.struct(s["k"].alias("key"), bucket(s["v"]).alias("value"))))


#: Families of patterns; all that are found are the text's patterns, the first is its type.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "programming": [
        ("function", f"({_any('function def func fn method sub')})\\s+\\w+"),
        ("class", f"({_any('class struct interface trait type')})\\s+\\w+"),
        ("api_endpoint", f"({_any('get post put delete patch')})\\s*[(/]"),
        ("database_query", f"({_any('select insert update delete create drop')})\\s+"),
        ("validation", _any("validate check verify ensure assert")),
        ("error_handling", _any("try catch except error throw raise")),
        ("authentication", _any("auth login signin logout signout token jwt")),
        ("logging", _any("log print debug info warn error")),
    ],
    "template": [
        ("form", _then("form", "input button textarea select")),
        ("table", _then("table", "tr td th thead tbody")),
        ("navigation", f"nav|menu|{_then('header', 'ul li a')}"),
        ("card", _any("card panel tile section")),
        ("modal", _any("modal dialog popup")),
    ],
    "styling": [(n, f"(?:{_any(w)}).*\\{{") for n, w in (("button", "btn button"), ("form", "form input field"), ("layout", "flex grid display"), ("animation", "animation transition transform"))],
    "data": [(n, f"(?:{_any(w)}).*\\{{") for n, w in (("schema", "schema model type"), ("config", "config settings options"), ("metadata", "meta info description"))],
    "query": [(f"{a}_query", f"{a}.*{b}") for a, b in (("select", "from"), ("insert", "into"), ("update", "set"), ("delete", "from"))],
    "infrastructure": [("service", _any("service container server")), ("network", _any("network port expose")), ("volume", _any("volume mount path")), ("environment", _any("env environment arg"))],
    "build": [("target", _any("target build compile")), ("dependency", _any("require import include")), ("rule", _any("rule recipe command"))],
    "configuration": [("setting", _any("set let option config")), ("mapping", _any("map keybind shortcut")), ("plugin", _any("plugin extension package"))],
    "pattern": [("email", "[\\w.%+-]+@[\\w.-]+\\.[A-Za-z]{2,}"), ("url", "https?://\\S+"), ("phone", "\\+?[0-9][0-9() -]{6,}"), ("date", "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}")],
    "documentation": [("heading", "(?m)^#+\\s+"), ("code_block", "```"), ("list", "(?m)^\\s*[*+-]\\s+"), ("link", "\\[.*?\\]\\(.*?\\)")],
}
CONTROL = _any("if else for while switch case try catch except return")


def patterns_found(text: Column, family: str) -> Column:
    return F.filter(F.array(*[F.when(text.rlike("(?i)" + p), n) for n, p in PATTERNS[family]]), lambda x: x.isNotNull())


def patterns_sql(text: str, family: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){p}') THEN '{n}' END" for n, p in PATTERNS[family])
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def complexity(text: Column) -> Column:
    """In 0..1 from lines, control words and opening brackets."""
    lines = F.size(F.split(F.regexp_replace(text, "\\n$", ""), "\n"))
    control = F.size(F.regexp_extract_all(text, F.lit(f"(?i)\\b({CONTROL})\\b"), 1))
    nesting = F.length(text) - F.length(F.translate(text, "{([", ""))
    return F.least(F.lit(1.0), (lines / 100.0 + control / 20.0 + nesting / 50.0) / 3.0)


LANGUAGE_NAMES = r"(?i)(?:function|def|func|fn)\s+(\w+)"
TYPE_NAMES = "(?i)(?:{})\\s+(\\w+)".format(_any("class struct interface trait"))


def metadata(text: Column) -> dict[str, Column]:
    """First names of functions, types, selectors, tags and keys."""
    some = lambda pattern: F.array_join(F.slice(F.regexp_extract_all(text, F.lit(pattern), 1), 1, 5), ",")
    return {"functions": some(LANGUAGE_NAMES), "classes": some(TYPE_NAMES), "selectors": some("([.#]?[\\w-]+)\\s*\\{"), "tags": some("<(\\w+)"), "keys": some("[\"']?(\\w+)[\"']?\\s*:")}


COMMENTS = {"python": "#[^\\n]*", "c": "(?s)/\\*.*?\\*/|//[^\\n]*", "sql": "--[^\\n]*", "html": "(?s)<!--.*?-->"}


def universal_normal(text: Column, language: Column) -> Column:
    """Comments out, blanks single, literals and identifiers masked, by language."""
    out = text
    for name, pattern in COMMENTS.items():
        out = F.when(language == name, F.regexp_replace(text, pattern, " ")).otherwise(out)
    out = F.regexp_replace(out, "\"[^\"]*\"|'[^']*'", "STRING_LITERAL")
    out = F.regexp_replace(out, "\\b[0-9]+(\\.[0-9]+)?\\b", "NUMBER")
    out = F.when(language.isin("python", "c"), F.regexp_replace(out, "\\b[a-z_][a-z0-9_]*(\\s*=[^=])", "IDENT$1")).otherwise(out)
    return F.trim(F.regexp_replace(out, "\\s+", " "))
