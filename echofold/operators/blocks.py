"""From texts to blocks: (file, line_start, line_end, text, function_name, class_name, line_count)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["file", "line_start", "line_end", "text", "function_name", "class_name"]
SCHEMA = "line_start int, line_end int, text string, function_name string, class_name string"


def with_count(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("line_count", F.col("line_end") - F.col("line_start") + 1)


def whole_files(files: DataFrame, file: Column, text: Column) -> DataFrame:
    """One block per text, named after its first identifier."""
    return with_count(
        files.select(
            file.alias("file"),
            F.lit(1).alias("line_start"),
            F.size(F.split(text, "\n")).alias("line_end"),
            text.alias("text"),
            F.regexp_extract(text, "[A-Za-z_][A-Za-z0-9_]*", 0).alias("function_name"),
            F.lit(None).cast("string").alias("class_name"),
        )
    )


def line_windows(files: DataFrame, file: Column, text: Column, n: int = 3) -> DataFrame:
    """Every run of n lines that holds more than blanks."""
    lines = files.select(file.alias("file"), F.split(text, "\n").alias("lines")).filter(F.size("lines") >= n)
    windows = F.transform(F.sequence(F.lit(1), F.size("lines") - (n - 1)), lambda i: F.struct(i.alias("line_start"), F.array_join(F.slice("lines", i, n), "\n").alias("text")))
    out = lines.select("file", F.inline(windows)).filter(F.col("text").rlike("[^ \\t\\n\\r\\x0b\\x0c]"))
    none = F.lit(None).cast("string")
    return with_count(out.select("file", "line_start", (F.col("line_start") + n - 1).alias("line_end"), "text", none.alias("function_name"), none.alias("class_name")))


class _Python:
    """Every function of a Python text, nested ones too; none if it does not parse."""

    def eval(self, content: str) -> Iterator[tuple]:
        import ast

        try:
            tree = ast.parse(content or "")
        except (SyntaxError, ValueError, RecursionError):
            return
        lines = content.splitlines()
        owner = {id(f): c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body}
        for node in ast.walk(tree):
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                yield node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno]), node.name, owner.get(id(node))


#: Opening lines of functions by family; the body is what the braces (or `end`) enclose.
HEADS = {
    "braces": re.compile(r"(?m)(?:\bfunction\s+|\bfunc\s+(?:\([^)]*\)\s*)?|\bfn\s+|\bfun\s+|\bdef\s+)(?P<a>\w+)|(?P<b>\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>|^\s*(?:[\w<>\[\],*&]+\s+)+(?P<c>\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{|^\s*(?P<d>\w+)\s*\([^;{}]*\)\s*(?::\s*[\w<>\[\], |]+)?\{"),
    "end": re.compile(r"\bdef\s+(?:self\.)?(?P<a>[\w?!]+)|\bfunction\s+(?P<b>[\w.:]+)"),
}
_CONTROL = {"if", "for", "while", "switch", "catch", "else", "return", "foreach"}


#: Comments and strings of languages with braces; what they hold is no code.
_NO_CODE = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'", re.S)
_CLASS = re.compile(r"\b(?:class|struct|interface|trait|impl|enum)\s+(\w+)[^;{}()]*\{")


def code_only(text: str) -> str:
    """The text with comments and strings blank, every character in its place."""
    return _NO_CODE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def brace_end(code: str, opening: int) -> int:
    """Place behind the brace that closes the one at `opening`; -1 if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, opening):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return -1


class _Braces:
    """Functions and methods of languages with braces, by matching them outside of strings and comments. A
    method has the innermost class around it as its class."""

    def eval(self, content: str) -> Iterator[tuple]:
        text = content or ""
        code, lines = code_only(text), text.split("\n")
        starts = [0]
        for line in lines:
            starts.append(starts[-1] + len(line) + 1)
        owners = [(m.start(), brace_end(code, m.end() - 1), m.group(1)) for m in _CLASS.finditer(code)]
        for i in range(len(lines)):
            m = HEADS["braces"].search(code, starts[i], starts[i + 1] - 1)
            name = next((g for g in m.groups() if g), None) if m else None
            if not name or name in _CONTROL:
                continue
            opening, stop = code.find("{", m.start()), code.find(";", m.start())
            if opening < 0 or 0 <= stop < opening or code.count("\n", m.start(), opening) > 2:
                continue
            end = brace_end(code, opening)
            if end < 0:
                continue
            last = text.count("\n", 0, end)
            inside = [(a, n) for a, b, n in owners if a < m.start() < b]
            yield i + 1, last + 1, "\n".join(lines[i : last + 1]), name, max(inside)[1] if inside else None


class _Ends:
    """Functions closed by `end`, by indentation."""

    def eval(self, content: str) -> Iterator[tuple]:
        lines = (content or "").split("\n")
        for i, line in enumerate(lines):
            m = HEADS["end"].search(line)
            if not m:
                continue
            indent = len(line) - len(line.lstrip())
            for j in range(i + 1, len(lines)):
                if lines[j].strip() == "end" and len(lines[j]) - len(lines[j].lstrip()) <= indent:
                    yield i + 1, j + 1, "\n".join(lines[i : j + 1]), next(g for g in m.groups() if g), None
                    break


class _Tags:
    """Elements of markup that span lines, by a stack of open tags."""

    def eval(self, content: str) -> Iterator[tuple]:
        text, stack = content or "", []
        lines = text.split("\n")
        line_at = lambda p: text.count("\n", 0, p) + 1
        for m in re.finditer(r"<(/?)([A-Za-z][\w:-]*)[^>]*?(/?)>", text):
            closing, name, alone = m.groups()
            if alone:
                continue
            if not closing:
                stack.append((name, m.start()))
                continue
            while stack:
                top, start = stack.pop()
                if top == name:
                    a, b = line_at(start), line_at(m.end())
                    if b > a:
                        yield a, b, "\n".join(lines[a - 1 : b]), f"<{name}>", None
                    break


class _Rules:
    """Style rules and at-rules that span lines, nested ones too."""

    def eval(self, content: str) -> Iterator[tuple]:
        text = content or ""
        code = code_only(text)
        for m in re.finditer(r"[^{};]+\{", code):
            end = brace_end(code, m.end() - 1)
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            a, b = text.count("\n", 0, start) + 1, text.count("\n", 0, end) + 1
            if end > 0 and b > a:
                yield a, b, text[start:end], text[start : m.end() - 1].strip()[:50], None


class _Sections:
    """Parts of documents and data files that span lines: from a heading, a table's name or a key of the outer
    level to the next one."""

    HEAD = re.compile(r"#{1,6}\s+(?P<a>\S.*)|\[+(?P<b>[^\]]+)\]+\s*$|(?P<c>[\w.-]+):(?:\s|$)|(?:  |\t)\"(?P<d>[^\"]+)\"\s*:")

    def eval(self, content: str) -> Iterator[tuple]:
        lines = (content or "").split("\n")
        heads = [(i, next(g for g in m.groups() if g)) for i, x in enumerate(lines) if (m := self.HEAD.match(x))]
        for (i, name), (j, _) in zip(heads, [*heads[1:], (len(lines), "")], strict=True):
            while j > i + 1 and not lines[j - 1].strip():
                j -= 1
            if j > i + 1:
                yield i + 1, j, "\n".join(lines[i:j]), name.strip()[:50], None


class _Statements:
    """Statements of query and build languages that span lines, up to a semicolon or a blank line."""

    def eval(self, content: str) -> Iterator[tuple]:
        at, held = 0, []
        for i, line in enumerate([*(content or "").split("\n"), ""], 1):
            if not held and line.strip():
                at = i
            if line.strip():
                held.append(line)
            if held and (not line.strip() or line.rstrip().endswith(";")):
                if len(held) > 1:
                    yield at, at + len(held) - 1, "\n".join(held), held[0].split()[0].lower(), None
                held = []


_BRACED = ("javascript", "typescript", "java", "c", "cpp", "csharp", "php", "go", "rust", "kotlin", "swift", "scala", "objc", "bash")
EXTRACTORS: dict[str, type] = {"python": _Python, **dict.fromkeys(_BRACED, _Braces), "ruby": _Ends, "lua": _Ends, **dict.fromkeys(("html", "xml", "svelte", "vue"), _Tags), "css": _Rules, **dict.fromkeys(("json", "yaml", "toml", "markdown"), _Sections), **dict.fromkeys(("sql", "graphql", "dockerfile", "make", "nginx", "vim"), _Statements)}


def register_extractor(language: str, handler: type) -> None:
    """Adds or replaces the extractor of a language: a class whose eval(content) yields block tuples."""
    EXTRACTORS[language] = handler


def functions(files: DataFrame, languages: Column | None = None) -> DataFrame:
    """Blocks of (path, content) files by table functions, each language by its own extractor."""
    from echofold.sources.files import language

    spark = files.sparkSession
    named = files.withColumn("_language", languages if languages is not None else language(F.col("path")))
    parts = []
    for handler in dict.fromkeys(EXTRACTORS.values()):
        mine = [k for k, v in EXTRACTORS.items() if v is handler]
        table = F.udtf(handler, returnType=SCHEMA)
        name = f"echofold_{handler.__name__.strip('_').lower()}_blocks"
        spark.udtf.register(name, table)
        view = f"_echofold_files_{handler.__name__.strip('_').lower()}"
        named.filter(F.col("_language").isin(*mine)).createOrReplaceTempView(view)
        parts.append(spark.sql(f"SELECT f.path AS file, t.* FROM {view} f, LATERAL {name}(f.content) t"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_count(out)


def extract(files: DataFrame, functions_only: bool = True, min_lines: int = 3) -> DataFrame:
    """All blocks of a scan: functions, and unless they are all that is wanted, line windows too."""
    out = functions(files)
    if not functions_only:
        out = out.unionByName(line_windows(files, F.col("path"), F.col("content"), min_lines))
    return out.filter(F.col("line_count") >= min_lines)
