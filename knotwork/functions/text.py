"""Scalar functions over names, paths and texts, as Column expressions that stay inside Spark's own code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that a question's terms leave out.
STOPWORDS = tuple(
    """a an and are as at be by can could do does did for from has have how i if in into is it its me my of on or our should so
    than that the their then there these this those to was we what when where which while who why will with would you your
    does work works working function functions class classes method methods implemented implement implementation find show
    explain happen happens use used using get set make repo repository""".split()
)
# Which extension is which language, and which paths hold tests or side matter.
EXTENSIONS = {".py": "python", ".md": "markdown", ".mdx": "markdown"}
TEST_PATH = r"(^|/)(tests?|__tests__|spec|specs|testing|t)/|(^|/)test_[^/]*$|_test\.py$|(^|/)conftest\.py$"
SIDE_PATH = r"(^|/)(examples?|samples?|demos?|benchmarks?|scripts|docs?|fixtures|migrations)/"
#: Characters that count as one token.
CHARS_PER_TOKEN = 3.3


def language_for(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    return reduce(lambda c, kv: c.when(ext == kv[0], F.lit(kv[1])), EXTENSIONS.items(), F.when(F.lit(False), F.lit("")))


def is_test_path(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(TEST_PATH)


def is_side_path(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(SIDE_PATH)


def is_public(name: Column) -> Column:
    return ~name.startswith("_") | (name.startswith("__") & name.endswith("__"))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether an ignore pattern hits: `dir/` any folder above the file, else a glob over the name or the whole path."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    out = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            out = out | F.array_contains(folders, p.rstrip("/"))
        else:
            glob = "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/-[]!" else "\\" + c for c in p).replace("[!", "[^") + "$"
            out = out | F.element_at(parts, -1).rlike(glob) | path.rlike(glob)
    return out


def split_identifier(name: Column) -> Column:
    """WorkerManager.scale_up -> [worker, manager, scale, up]"""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")


def identifier_tokens(*names: Column) -> Column:
    """All names in lower case and their parts, each once, in order, joined by blanks."""
    lists = [F.when(F.length(n) > 0, F.concat(F.array(F.lower(n)), split_identifier(n))).otherwise(F.array().cast("array<string>")) for n in (F.coalesce(c, F.lit("")) for c in names)]
    return F.array_join(F.array_distinct(F.flatten(F.array(*lists))), " ")


def query_terms(text: Column) -> Column:
    """The terms of a question: its words and their parts, without short and common ones, each once."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z][A-Za-z0-9]*)"), 1)
    each = F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lower(w)), split_identifier(w))))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(each, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def _let(value: Column, then) -> Column:
    """then(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def truncate(text: Column, n: int) -> Column:
    return _let(text, lambda t: F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t))


def first_sentence(text: Column, n: int = 200) -> Column:
    paragraph = F.element_at(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), "\n\n"), 1)
    flat = F.trim(F.regexp_replace(paragraph, r"\s+", " "))
    sentence = _let(flat, lambda p: F.when(p.rlike(r"[.!?] "), F.regexp_extract(p, r"^(.*?[.!?]) ", 1)).otherwise(p))
    return _let(sentence, lambda t: F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(t))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def module_name_for(path: Column) -> Column:
    """The dotted module name of a Python file."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.py$", ""), "/"), lambda x: x != "")
    parts = F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    parts = F.when((F.size(parts) > 1) & (F.element_at(parts, 1) == "src"), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    name = F.array_join(parts, ".")
    return F.when(name == "", F.lit("__root__")).otherwise(name)


def slug(title: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def _owner(qualname: Column) -> Column:
    parts = F.split(qualname, r"\.")
    return F.when(F.size(parts) >= 2, F.element_at(F.slice(parts, F.size(parts) - 1, 1), 1))


def _capital(word: Column) -> Column:
    return F.coalesce(word.rlike(r"^\p{Lu}"), F.lit(False))


def short_name(kind: Column, name: Column, qualname: Column, path: Column) -> Column:
    last = F.element_at(F.split(qualname, r"\."), -1)
    owner = _owner(qualname)
    return (
        F.when(kind.isin("method", "test") & owner.isNotNull(), F.when((kind == "method") | _capital(owner), F.concat(owner, F.lit("."), last)).otherwise(last))
        .when(kind == "documentation", F.concat(name, F.lit(" ("), path, F.lit(")")))
        .when(kind == "module", qualname)
        .otherwise(name)
    )


def summary_label(kind: Column, name: Column, qualname: Column) -> Column:
    owner = _owner(qualname)
    return F.when(kind.isin("method", "test") & _capital(owner), F.concat(owner, F.lit("."), F.element_at(F.split(qualname, r"\."), -1))).otherwise(name)


def location(path: Column, start: Column) -> Column:
    return F.concat_ws(":", path, start.cast("string"))


def span(path: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNull() | end.isNull() | (start == end), location(path, start)).otherwise(F.concat(location(path, start), F.lit("-"), end.cast("string")))


def format_memory(uid: Column, topic: Column, content: Column, stale: Column, note: str = " [may be outdated]") -> Column:
    return F.concat(F.lit("("), uid, F.lit(") "), F.when(F.length(topic) > 0, F.concat(topic, F.lit(": "))).otherwise(F.lit("")), F.coalesce(content, F.lit("")), F.when(F.coalesce(stale, F.lit(False)), F.lit(note)).otherwise(F.lit("")))


def embedding_text(kind: Column, name: Column, qualname: Column, path: Column, signature: Column, docstring: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    code = F.concat_ws("\n", F.concat(kind, F.lit(" "), qualname), blank(path), blank(signature), blank(docstring))
    return (
        F.when(kind == "memory", F.concat(F.lit("memory "), name, F.lit("\n"), blank(docstring)))
        .when(kind == "documentation", F.concat_ws("\n", F.concat(F.lit("documentation "), name), blank(path), blank(docstring)))
        .otherwise(F.regexp_replace(code, r"^\s+|\s+$", ""))
    )


def should_embed(kind: Column, name: Column, public: Column, docstring: Column, start: Column, end: Column) -> Column:
    bare = F.coalesce(F.length(docstring), F.lit(0)) == 0
    dunder = name.startswith("__") & name.endswith("__") & (kind == "method") & bare
    hidden = kind.isin("function", "method") & ~F.coalesce(public, F.lit(True)) & bare & (F.coalesce(end, F.lit(0)) - F.coalesce(start, F.lit(0)) < 8)
    return kind.isin("module", "class", "function", "method", "documentation", "memory") & ~dunder & ~hidden
