"""Functions paired with their documentation.

Method: island grammars. Per language only documentation, annotations, signatures and balanced bodies are parsed; all else
is water and skipped. A body is balanced by brackets and indentation in Python, by braces in JavaScript, and its strings and
comments do not count; functions inside it are islands of their own. The same grammar of signatures and documentation reads the columns of nodes and the pairs cut
from whole source files. A pair is dropped where the documentation says nothing beyond the name and the parameters.

Cases: null or blank signature or documentation, or another type than function or method, gives no pair; signatures and
bodies cut short are read as far as they go; a bracket left open ends at the next definition; identical rows give one pair; empty tables and files give nothing; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that carry nothing alone, in documentation that only points elsewhere or fills a template.
EMPTY_WORDS = frozenset(
    """a an the this that these those it its is are be will shall does do to of for from in on at with and or by as
    function method func procedure helper routine class constructor property getter setter test util utility wrapper callback
    docstring doc docs documentation documented undocumented description describe comment placeholder none null nil na n
    tbd wip todo fixme xxx hack no not yet missing empty auto autogenerated generated here goes add write
    param params parameter parameters arg args argument arguments return returns rtype type types raises raise yields keyword
    inherited inherit inheritdoc inherits see also base parent super superclass baseclass overrides overridden override
    der die das diese dieser dieses ein eine ist funktion methode siehe basisklasse oberklasse keine beschreibung
    le la les l un une de des du cette ce est fonction méthode voir classe mère parente sans aucune
    el los las una esta este es función método ver clase sin descripción documentación""".split()
)
_DIRECTIVE = re.compile(r"^\s*#?\s*(?:noqa\b.*|type:\s*ignore.*|pylint:.*|mypy:.*|pyright:.*|flake8:.*|ruff:.*|isort:.*|fmt:\s*(?:on|off|skip).*|yapf:.*|pragma:.*|nosec\b.*|noinspection\b.*|eslint.*|@ts-\w+.*|prettier-ignore.*|istanbul ignore.*|coverage:.*|@?nolint\b.*|-\*-.*-\*-)\s*$", re.I | re.M)
_TODO = re.compile(r"(?:^|(?<=[.!?\n]))[ \t]*[@#*(\[]*\b(?:todo|fixme|xxx|tbd|wip|hack)\b(?:\([^)\n]*\))?[^\n]*?(?:[.!?](?=\s|$)|(?=\n)|$)", re.I)
_BLANK = re.compile(r"\b_[A-Za-z]+_\b|\[[A-Za-z_ ]*\]|<[A-Za-z_ -]*>|\{\{?[A-Za-z_ -]*\}?\}|\.\.\.|…")
_POINTER = re.compile(r"^\s*(?:inherited|overrides?|overridden|implements?)?\W*(?:please\s+)?(?:see|see also|refer to|same as|cf|like|siehe|vgl|voir|ver|véase|@see|@link|@inheritdoc|:\w+:)\b[^.\n]{0,80}\.?\s*$", re.I)
_FIELD = re.compile(r"^\s*(?:[:@]\s*(?P<tag>param|parameter|arg|argument|key|keyword|type|raises?|throws?|exception|returns?|rtype|yields?|vartype|var|ivar)\b\s*(?:\{[^}]*\})?\s*(?P<who>[^:\n]*?)(?::|\s-\s|$)|(?P<name>\*{0,2}\w+)\s*(?:\([^)\n]*\))?\s*:)\s*(?P<text>[^\n]*)$", re.I)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|other parameters|keyword args|keyword arguments|returns?|yields?|raises|attributes|notes?|examples?)\s*:?\s*$", re.I)
_RULE = re.compile(r"^\s*[-=~^*#]{2,}\s*$")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


_ENDING = re.compile(r"(?:ies|ing|es|ed|er|s|e|y)$")


@lru_cache(100_000)
def stem(word: str) -> str:
    """A word without its endings, taken off as long as three letters stay, so that all its forms agree."""
    w = word.lower()
    while (m := _ENDING.search(w)) and m.start() >= 3:
        w = w[: m.start()]
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


_EMPTY_STEMS = frozenset(stem(w) for w in EMPTY_WORDS)


def _words(text: str) -> set[str]:
    return {stem(w) for part in _WORD.findall(text) for w in _CAMEL.split(part)} | {stem(w) for w in _WORD.findall(text)}


def balanced(text: str, start: int) -> int:
    """Index behind the bracket that closes the one at start; the text's end where it was cut before."""
    depth, quote, i = 0, "", start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth <= 0:
                return i + 1
        i += 1
    return len(text)


_NAME = re.compile(r"(?:\bdef\s+|\bfunction\b\s*\*?\s*)([\w$]+)|([\w$#]+)\s*(?=\()|([\w$]+)\s*=\s*(?:async\b\s*)?(?=\()")


def read_signature(signature: str) -> tuple[str, str]:
    """The name and the text of the parameters; decorators before it are islands of their own."""
    i = 0
    while m := re.compile(r"\s*@[\w.]+").match(signature, i):
        i = m.end()
        if i < len(signature) and signature[i] == "(":
            i = balanced(signature, i)
    m = _NAME.search(signature, i)
    if not m:
        return signature[i:].strip(), ""
    at = signature.find("(", m.end())
    return next(g for g in m.groups() if g), signature[at : balanced(signature, at)] if at >= 0 else ""


def says_something(docstring: str | None, name: str, parameters: str = "") -> bool:
    """Whether any sentence or field of the documentation has a word beyond the name, the parameters and templates."""
    if not docstring or not docstring.strip():
        return False
    known = _words(name) | _words(parameters)
    empty = known | _EMPTY_STEMS
    text = _TODO.sub(" ", _DIRECTIVE.sub(" ", docstring))
    for line in text.split("\n"):
        line = re.sub(r"^\s*(?:/\*\*+|\*/|\*(?!\*))|\*/\s*$", " ", line)
        if _RULE.match(line) or _SECTION.match(line) or _POINTER.match(line):
            continue
        field = _FIELD.match(line)
        said = field["text"] if field and (field["tag"] or stem(field["name"] or "") in known) else line
        said = _BLANK.sub(" ", said)
        for sentence in re.split(r"(?<=[.!?])\s+", said):
            if not _POINTER.match(sentence) and _words(sentence) - empty:
                return True
    return False


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        good = [says_something(d, *read_signature(s)) for s, d in zip(b["signature"], b["docstring"], strict=True)]
        yield b[good]


def node_pairs(nodes: DataFrame) -> DataFrame:
    """id, signature, docstring of the functions and methods whose documentation says something."""
    some = nodes.filter(F.col("type").isin("function", "method") & F.col("id").isNotNull() & (F.length(F.trim("signature")) > 0) & (F.length(F.trim("docstring")) > 0)).select(F.col("id").cast("long").alias("id"), "signature", "docstring")
    return some.mapInPandas(_judge, "id long, signature string, docstring string").distinct()


# --- pairs from whole source files -----------------------------------------------------------------------------------

_STRING = r"(?P<string>(?P<pre>[rRbBuUfF]{0,2})(?P<q>\"\"\"|''')(?P<body>(?:\\.|(?!(?P=q)).)*)(?P=q)|[rRbBuUfF]{0,2}\"(?:\\.|[^\"\\\n])*\"|[rRbBuUfF]{0,2}'(?:\\.|[^'\\\n])*')"
_PY = re.compile(r"(?P<comment>\#[^\n]*)|" + _STRING + r"|(?P<joined>\\\r?\n)|(?P<line>\n\s*)|(?P<deco>@[\w.]+)|(?P<def>\b(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\])?\()|(?P<open>[(\[{])|(?P<close>[)\]}])", re.S)
_PY_TAIL = re.compile(r"[^:\n\[]*(?:\[[^\n]*?\])?[^:\n]*:[^\S\n]*(?:#[^\n]*)?")
_PY_BLANK = re.compile(r"(?:\s|#[^\n]*\n)*")
_PY_DEFINES = re.compile(r"@|(?:async[ \t]+)?def\b")
_PY_ANEW = re.compile(r"(?:@[^\n]*\n[ \t]*)*(?:(?:async[ \t]+)?def|class)\b")
_JS = re.compile(r"(?P<doc>/\*\*(?!/).*?\*/)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<def>\b(?:async\s+)?function\b\s*\*?\s*(?P<name>[\w$]+)\s*\(|\b(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*=\s*(?:async\s*)?(?=\([^()]*\)\s*=>)\(|(?<=[\n;{}])[ \t]*(?:static\s+|async\s+|get\s+|set\s+)*(?P<method>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|with\b)[\w$#]+)\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*\{))", re.S)
_JS_BODY = re.compile(r"(?P<water>//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|(?<=[(,=:\[!&|?{};\n>])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/|\breturn\s*/(?![*/])(?:\\.|[^/\\\n])+/)|(?P<tick>`)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<end>;|\n)", re.S)
_JS_TEMPLATE = re.compile(r"\\.|\$\{|`", re.S)


def _column(source: str, at: int) -> int:
    return len(source[source.rfind("\n", 0, at) + 1 : at].expandtabs(8))


def python_pairs(source: str) -> Iterator[tuple[str, int, str, str, str]]:
    """name, line, signature, documentation, body of every def with a string as its first statement.

    A body goes on to the first line outside of brackets that is not deeper than its def."""
    found: list[tuple[int, str, int, str, str | None, int, int]] = []  # start, name, line, signature, documentation, begin and end of the body
    within: list[tuple[int, int]] = []  # the bodies that are open: column of the def, place in found
    decos: list[str] = []
    depth = i = 0
    fresh, last = _PY_BLANK.match(source).end(), 0  # begin of the line of code, end of the last word of code

    def close_to(column: int, end: int) -> None:
        while within and within[-1][0] >= column:
            k = within.pop()[1]
            found[k] = (*found[k][:6], max(end, found[k][5]))

    while m := _PY.search(source, i):
        if source[i : m.start()].strip():
            last = i + len(source[i : m.start()].rstrip())
        i = m.end()
        if m["line"]:
            if source[i : i + 1] in ("#", ""):
                continue
            if depth and _PY_ANEW.match(source, i):
                depth = 0  # no expression holds a definition: what is open was cut
            if not depth:
                fresh = i
                close_to(_column(source, i), last)
                if not _PY_DEFINES.match(source, i):
                    decos = []
        elif m["deco"] and not depth and m.start() == fresh:
            end = balanced(source, i) if source[i : i + 1] == "(" else i
            decos.append(source[m.start() : end].strip())
            i = last = end
        elif m["def"]:
            close = balanced(source, i - 1)
            tail = _PY_TAIL.match(source, close)
            i = last = tail.end() if tail else close
            signature = " ".join([*decos, re.sub(r"\s+", " ", source[m.start() : i].split("#")[0]).strip().rstrip(":")])
            close_to(column := _column(source, m.start()), m.start())
            decos, depth, text = [], 0, None
            s = _PY.match(source, _PY_BLANK.match(source, i).end())
            if s and s["string"] and "b" not in (s["pre"] or "").lower() and "f" not in (s["pre"] or "").lower():
                text = s["body"] if s["q"] else re.sub(r"^\w*.|.$", "", s["string"], flags=re.S)
                i = last = s.end()
            within.append((column, len(found)))
            found.append((m.start(), m["name"], source.count("\n", 0, m.start()) + 1, signature, text, i, i))
        elif not m["comment"] and not m["joined"]:
            depth = depth + 1 if m["open"] else max(0, depth - 1) if m["close"] else depth
            last = i
    close_to(0, i + len(source[i:].rstrip()) if source[i:].strip() else last)
    for _, name, line, signature, text, begin, end in found:
        if text is not None:
            yield name, line, signature, re.sub(r"\n[ \t]+", "\n", text).strip(), source[begin:end].lstrip(" \t;").lstrip("\r\n")


def _braced(source: str, start: int, expression: bool = False) -> int:
    """Index behind the bracket that closes the one at start, or behind the expression that begins there."""
    depth, i = 0, start
    held: list[int] = []  # the depths at which ${} in a template literal goes back to its text
    while m := _JS_BODY.search(source, i):
        i = m.end()
        text = bool(m["tick"])
        if m["open"]:
            depth += 1
        elif m["close"]:
            text = bool(held) and held[-1] == depth
            depth -= 1
            if text:
                held.pop()
            elif depth < 0:
                return m.start()
            elif not depth and not expression:
                return i
        elif m["end"] and expression and not depth and source[start : m.start()].strip():
            return m.start()
        while text and (t := _JS_TEMPLATE.search(source, i)):
            i = t.end()
            if t[0] == "${":
                depth += 1
                held.append(depth)
            text = t[0][0] == "\\"
        if text:
            return len(source)
    return len(source)


def javascript_pairs(source: str) -> Iterator[tuple[str, int, str, str, str]]:
    """name, line, signature, documentation, body of every function or method with a documentation comment right before it."""
    doc, doc_end, i = "", -1, 0
    while m := _JS.search(source, i):
        i = m.end()
        if m["doc"]:
            doc, doc_end = m["doc"], m.end()
        elif m["def"]:
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            close = balanced(source, i - 1)
            between = source[doc_end:start] if doc_end >= 0 else "x"
            if re.fullmatch(r"(?:\s|export\b|default\b|static\b|async\b|@[\w.]+(?:\([^)]*\))?)*", between):
                text = re.sub(r"(?m)^\s*\*?[ \t]?", "", doc[3:-2]).strip()
                signature = re.sub(r"\s+", " ", source[start:close])
                begin = re.compile(r"\s*(?:=>\s*)?").match(source, close)
                end = _braced(source, begin.end()) if source[begin.end() : begin.end() + 1] == "{" else _braced(source, begin.end(), True) if "=>" in begin[0] else close
                yield m["name"] or m["arrow"] or m["method"], source.count("\n", 0, start) + 1, signature, text, source[begin.end() : end].strip() if end > close else ""
            doc_end, i = -1, close


READERS = {"py": python_pairs, "pyi": python_pairs, "js": javascript_pairs, "mjs": javascript_pairs, "cjs": javascript_pairs}


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(f, *p) for f, e, text in zip(b["file_id"], b["ext"], b["content"], strict=True) for p in READERS[e](text) if says_something(p[3], *read_signature(p[2]))]
        yield pd.DataFrame(rows, columns=["file_id", "name", "line", "signature", "docstring", "body"])


def file_pairs(files: DataFrame) -> DataFrame:
    """file_id, name, line, signature, docstring, body of all documented functions in the files' whole contents."""
    ext = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    some = files.select(F.col("file_id").cast("long").alias("file_id"), ext.alias("ext"), "content").filter(F.col("ext").isin(*READERS) & (F.length("content") > 0))
    return some.mapInPandas(_cut, "file_id long, name string, line int, signature string, docstring string, body string").distinct()
