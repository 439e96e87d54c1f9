"""Lexers and grammars of the supported languages: Python 3.12, JSON, TOML 1.0, JavaScript scripts and modules."""

from __future__ import annotations

import io
import keyword
import re
import tokenize
from collections.abc import Callable
from functools import lru_cache

from knotwork.llm.gll import Grammar, accepts


class Malformed(ValueError):
    """A text that has no tokens in the language."""


# --- JSON ------------------------------------------------------------------------------------------------------------

JSON = Grammar(
    """
    Text : Value END ;
    Value : Object | Array | STRING | NUMBER | WORD ;
    Object : '{' ( Member ( ',' Member )* )? '}' ;
    Member : STRING ':' Value ;
    Array : '[' ( Value ( ',' Value )* )? ']' ;
    """,
    ("Text",),
)
_JSON = re.compile(r'[ \t\n\r]*(?:(?P<STRING>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<NUMBER>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<WORD>true|false|null)(?!\w)|(?P<OP>[{}\[\]:,])|(?P<END>\Z))', re.A)


def json_tokens(text: str) -> list[int]:
    out, at, bit = [], 0, JSON.bit
    while m := _JSON.match(text, at):
        out.append(bit[m["OP"]] if m["OP"] else bit[m.lastgroup])
        at = m.end()
        if m.lastgroup == "END":
            return out
    raise Malformed


# --- TOML ------------------------------------------------------------------------------------------------------------

TOML = Grammar(
    """
    Document : Line ( NL Line )* END ;
    Line : ( Pair | Table | Tables )? ;
    Table : '[' Key ']' ;
    Tables : '[[' Key ']]' | '[' '[' Key ']' ']' ;
    Pair : Key '=' Value ;
    Key : Part ( '.' Part )* ;
    Part : BARE | STRING | DOTTED ;
    Value : STRING | MULTI | SCALAR | Array | Inline ;
    Array : ( '[' | '[[' ) Skip ( Value Skip ( ',' Skip Value Skip )* ( ',' Skip )? )? ']' | '[[' Skip ( Value Skip ( ',' Skip Value Skip )* ( ',' Skip )? )? ']' More ( ']' | ']]' ) | '[' Skip Nested ']]' ;
    More : Skip ( ',' Skip Value Skip )* ( ',' Skip )? ;
    Nested : ( Value Skip ',' Skip )* '[' Skip ( Value Skip ( ',' Skip Value Skip )* ( ',' Skip )? )? ;
    Skip : NL* ;
    Inline : '{' ( Pair ( ',' Pair )* )? '}' ;
    """,
    ("Document",),
)
_TOML_ESC = r'\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})'
_TOML = re.compile(
    r"[ \t]*(?:\#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*)?(?:(?P<MULTI>\"\"\"(?:[^\"\\]|" + _TOML_ESC + r"|\\[ \t]*\r?\n|\"{1,2}(?!\"))*\"{3,5}|'''(?:[^']|'{1,2}(?!'))*'{3,5})"
    r'|(?P<STRING>"(?:[^"\\\n\x00-\x08\x0b-\x1f\x7f]|' + _TOML_ESC + r")*\"|'[^'\n\x00-\x08\x0b-\x1f\x7f]*')"
    r"|(?P<WORD>[+-]?[\w][\w+:.-]*(?: \d\d:\d\d:\d\d[\d.+:Zz-]*)?|[+-]\w+)|(?P<NL>\r?\n)|(?P<OP>[\[\]{}=,.])|(?P<END>\Z))",
    re.A,
)
_TOML_SCALAR = re.compile(
    r"(?:true|false|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?\d)*)|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?"
    r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?)",
    re.A,
)


def toml_tokens(text: str) -> list[int]:
    out, at, bit = [], 0, TOML.bit
    while m := _TOML.match(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "WORD":
            w = m["WORD"]
            mask = bit["SCALAR"] if _TOML_SCALAR.fullmatch(w) else 0
            if re.fullmatch(r"[A-Za-z0-9_-]+", w):
                mask |= bit["BARE"]
            elif re.fullmatch(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.?", w):
                mask |= bit["DOTTED"]
            if w.endswith(".") and mask == bit["DOTTED"]:  # a dot before a quoted or spaced part
                out += [bit["DOTTED"] | bit["BARE"], bit["."]]
                continue
            out.append(mask)
        elif kind == "OP":
            out.append(bit[m["OP"]])
        else:
            out.append(bit[kind])
            if kind == "END":
                return out
    raise Malformed


# --- JavaScript ------------------------------------------------------------------------------------------------------

JAVASCRIPT = Grammar(
    """
    Script : Item* END ;
    Module : ( Item | Import | Export )* END ;
    Import : 'import' ( STRING | Names 'from' STRING ) ( 'with' Object )? Semi ;
    Names : Id ( ',' ( Star | Braces ) )? | Star | Braces ;
    Star : '*' 'as' Id ;
    Braces : '{' ( Name ( ',' Name )* ','? )? '}' ;
    Name : ( Word | STRING ) ( 'as' ( Word | STRING ) )? ;
    Export : 'export' ( '*' ( 'as' ( Word | STRING ) )? 'from' STRING Semi | Braces ( 'from' STRING )? Semi | Var | Function | Class | 'default' ( Function | Class | <plain> Assign Semi ) ) ;
    Semi : ';' | <newline> | <closing> ;
    Item : Function | Class | Statement ;
    Block : '{' Item* '}' ;
    Function : 'async'? 'function' '*'? Id? Params Block ;
    Params : '(' ( Param ( ',' Param )* ','? )? ')' ;
    Param : '...'? Target ( '=' Assign )? ;
    Target : Id | Object | Array ;
    Class : 'class' Id? ( 'extends' Access )? '{' ( Member | ';' )* '}' ;
    Member : 'static'? ( Method | Key ( '=' Assign )? Semi ) | 'static' Block ;
    Method : ( 'async' | 'get' | 'set' )? '*'? Key Params Block ;
    Key : Word | STRING | NUMBER | PRIVATE | '[' Assign ']' ;
    Var : ( 'var' | 'let' | 'const' ) Binding ( ',' Binding )* Semi ;
    Binding : Target ( '=' Assign )? ;
    Statement : Block | Var | ';' | If | For | While | Do | Switch | Try | Throw | Return | Jump | Label | With | 'debugger' Semi | <plain> Expression Semi ;
    If : 'if' '(' Expression ')' Body ( 'else' Body )? ;
    Body : Statement | Function ;
    For : 'for' 'await'? '(' ( ( 'var' | 'let' | 'const' ) Target ( 'of' | 'in' ) Expression | Access ( 'of' | 'in' ) Expression | ( ( 'var' | 'let' | 'const' ) Binding ( ',' Binding )* | Expression )? ';' Expression? ';' Expression? ) ')' Body ;
    While : 'while' '(' Expression ')' Body ;
    Do : 'do' Body 'while' '(' Expression ')' ';'? ;
    Switch : 'switch' '(' Expression ')' '{' ( ( 'case' Expression | 'default' ) ':' Item* )* '}' ;
    Try : 'try' Block ( 'catch' ( '(' Target ')' )? Block ( 'finally' Block )? | 'finally' Block ) ;
    Throw : 'throw' Expression Semi ;
    Return : 'return' Expression? Semi ;
    Jump : ( 'break' | 'continue' ) Id? Semi ;
    Label : Id ':' Body ;
    With : 'with' '(' Expression ')' Body ;
    Expression : Assign ( ',' Assign )* ;
    Assign : Arrow | 'yield' ( '*'? Assign )? | Access ASSIGN Assign | Access '=' Assign | Choice ;
    Arrow : 'async'? ( Id | Params ) '=>' ( <nobrace> Assign | Block ) ;
    Choice : Unary ( ( BINARY | '*' | 'in' ) Unary )* ( '?' Assign ':' Assign )? ;
    Unary : ( UNARY | SIGN | 'await' | STEP ) Unary | Access STEP? ;
    Access : 'new' ( Access | '.' Word ) | Primary Suffix* ;
    Suffix : '.' ( Word | PRIVATE ) | '?.' ( Word | PRIVATE | '[' Expression ']' | Arguments ) | '[' Expression ']' | Arguments | Template ;
    Arguments : '(' ( Spread ( ',' Spread )* ','? )? ')' ;
    Spread : '...'? Assign ;
    Primary : Id | STRING | NUMBER | REGEX | 'this' | 'super' | VALUE | PRIVATE | 'import' ( '.' Word | Arguments ) | Array | Object | Function | Class | Template | '(' Expression ')' ;
    Array : '[' Spread? ( ',' Spread? )* ']' ;
    Object : '{' ( Property ( ',' Property )* ','? )? '}' ;
    Property : '...' Assign | Key ':' Assign | Id ( '=' Assign )? | Method ;
    Template : TEMPLATE | HEAD Expression ( MIDDLE Expression )* TAIL ;
    Id : IDENT ;
    Word : WORD ;
    """,
    ("Script", "Module"),
)
# The words of the language.
_JS_RESERVED = frozenset("break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split())
_JS_CONTEXT = frozenset("as async await from get let of set static yield".split())
_JS_REGEX_AFTER = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
_JS = re.compile(
    r"(?P<space>(?:[^\S\n\u2028\u2029]|\ufeff|//[^\n]*|/\*(?:[^*\n]|\*(?!/))*\*/)+)|(?P<line>[\n\u2028\u2029]|/\*.*?\*/)|(?P<word>#?(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    r"|(?P<number>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|(?:\d(?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?|\.\d(?:_?\d)*(?:[eE][+-]?\d+)?)n?(?![\w$]))"
    r"|(?P<string>\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*')"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])",
    re.S,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{)", re.S)
_BINARY = frozenset("== != === !== < > <= >= << >> >>> / % & | ^ && || ?? ** instanceof".split())
_ASSIGN = frozenset("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


def javascript_tokens(text: str) -> list[int]:
    bit = JAVASCRIPT.bit
    out: list[int] = []
    brackets: list[tuple[str, bool]] = []  # what is open, and whether a regular expression may follow its end
    at, newline, last, operand, after = 0, False, "", False, False
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else len(text)

    def put(mask: int, nobrace: bool = True, plain: bool = True) -> None:
        nonlocal newline
        out.append(mask | (bit["<nobrace>"] if nobrace else 0) | (bit["<plain>"] if plain and nobrace else 0) | (bit["<newline>"] if newline else 0))
        newline = False

    def template(start: int, first: bool) -> int:
        m = _JS_TEMPLATE.match(text, start)
        if not m:
            raise Malformed
        whole = m[1] == "`"
        put(bit["TEMPLATE" if first and whole else "HEAD" if first else "TAIL" if whole else "MIDDLE"])
        if not whole:
            brackets.append(("`", False))
        return m.end()

    while at < len(text):
        c = text[at]
        if c == "`":
            at, last, operand = template(at + 1, True), "`", True
            continue
        if c == "/" and not operand and (m := _JS_REGEX.match(text, at)):
            put(bit["REGEX"])
            at, last, operand = m.end(), "/r/", True
            continue
        m = _JS.match(text, at)
        if not m:
            raise Malformed
        kind, s, at = m.lastgroup, m[0], m.end()
        if kind in ("space", "line"):
            newline |= kind == "line" and "\n" in s.replace("\u2028", "\n").replace("\u2029", "\n")
            continue
        if kind == "word":
            if s[0] == "#":
                put(bit["PRIVATE"])
            else:
                mask = bit["WORD"] | bit.get(s, 0)
                if s not in _JS_RESERVED:
                    mask |= bit["IDENT"]
                elif s in ("null", "true", "false"):
                    mask |= bit["VALUE"]
                elif s == "instanceof":
                    mask |= bit["BINARY"]
                elif s in ("typeof", "void", "delete"):
                    mask |= bit["UNARY"]
                put(mask, plain=s not in ("function", "class"))
            operand = s not in _JS_REGEX_AFTER or last == "."
        elif kind in ("number", "string"):
            put(bit[kind.upper()])
            operand = True
        else:
            if s in "([{":
                brackets.append((s, s == "(" and last in ("if", "while", "for", "with")))
                put(bit[s], nobrace=s != "{")
                operand = False
            elif s in ")]}":
                if not brackets:
                    raise Malformed
                opened, after = brackets.pop()
                if opened == "`":
                    if s != "}":
                        raise Malformed
                    at, last, operand = template(at, False), "`", True
                    continue
                if opened + s not in ("()", "[]", "{}"):
                    raise Malformed
                put(bit[s] | (bit["<closing>"] if s == "}" else 0))
                operand = not after and s != "}"
            else:
                mask = bit.get(s, 0)
                mask |= bit["BINARY"] if s in _BINARY else bit["ASSIGN"] if s in _ASSIGN else 0
                mask |= bit["STEP"] if s in ("++", "--") else bit["UNARY"] if s in "!~" else bit["SIGN"] | bit["BINARY"] if s in "+-" else 0
                put(mask)
                operand = s in ("++", "--") and operand
        last = s
    if brackets:
        raise Malformed
    out.append(bit["END"] | bit["<closing>"])
    return out


# --- Python ----------------------------------------------------------------------------------------------------------

PYTHON = Grammar(
    """
    File : ( NEWLINE | Statement )* END ;
    Statement : Simple | If | While | For | Try | With | Function | Class | Match | 'async' ( For | With | Function ) | Decorator+ ( Function | Class | 'async' Function ) ;
    Decorator : '@' Named NEWLINE ;
    Simple : LINE | Small ( ';' Small )* ';'? NEWLINE ;
    Small : Assignment | 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' ( Test ( 'from' Test )? )? | 'del' Stars | ( 'global' | 'nonlocal' ) NAME ( ',' NAME )* | 'assert' Test ( ',' Test )? | Import | 'type' NAME Types? '=' Test ;
    Import : 'import' Dotted ( 'as' NAME )? ( ',' Dotted ( 'as' NAME )? )* | 'from' ( ( '.' | '...' )* Dotted | ( '.' | '...' )+ ) 'import' ( '*' | '(' Imported ( ',' Imported )* ','? ')' | Imported ( ',' Imported )* ) ;
    Dotted : NAME ( '.' NAME )* ;
    Imported : NAME ( 'as' NAME )? ;
    Assignment : Stars ( ':' Test ( '=' ( Yield | Stars ) )? | AUGMENTED ( Yield | Stars ) | ( '=' ( Yield | Stars ) )* ) | Yield ;
    Yield : 'yield' ( 'from' Test | Stars )? ;
    Suite : Simple | NEWLINE INDENT Statement+ DEDENT ;
    If : 'if' Named ':' Suite ( 'elif' Named ':' Suite )* ( 'else' ':' Suite )? ;
    While : 'while' Named ':' Suite ( 'else' ':' Suite )? ;
    For : 'for' Targets 'in' Stars ':' Suite ( 'else' ':' Suite )? ;
    Targets : Target ( ',' Target )* ','? ;
    Target : '*'? Primary ;
    Try : 'try' ':' Suite ( Except+ ( 'else' ':' Suite )? ( 'finally' ':' Suite )? | 'finally' ':' Suite ) ;
    Except : 'except' ( '*'? Test ( 'as' NAME )? )? ':' Suite ;
    With : 'with' ( Item ( ',' Item )* | '(' Item ( ',' Item )* ','? ')' ) ':' Suite ;
    Item : Test ( 'as' Target )? ;
    Function : 'def' NAME Types? '(' Parameters? ')' ( '->' Test )? ':' Suite ;
    Types : '[' TypeName ( ',' TypeName )* ','? ']' ;
    TypeName : ( '*' | '**' )? NAME ( ':' Test )? ;
    Parameters : Parameter ( ',' Parameter )* ','? ;
    Parameter : '/' | '*' ( NAME ( ':' '*'? Test )? )? | '**' NAME ( ':' Test )? | NAME ( ':' Test )? ( '=' Test )? ;
    Class : 'class' NAME Types? Arguments? ':' Suite ;
    Match : 'match' Stars ':' NEWLINE INDENT Case+ DEDENT ;
    Case : 'case' Patterns ( 'if' Named )? ':' Suite ;
    Patterns : Pattern ( ',' Pattern )* ','? ;
    Pattern : Either ( 'as' NAME )? | '*' NAME ;
    Either : Closed ( '|' Closed )* ;
    Closed : '-'? NUMBER ( ( '+' | '-' ) NUMBER )? | Strings | 'None' | 'True' | 'False' | Dotted ( '(' ( Labelled ( ',' Labelled )* ','? )? ')' )? | '(' Patterns? ')' | '[' Patterns? ']' | '{' ( Pair ( ',' Pair )* ','? )? '}' ;
    Labelled : ( NAME '=' )? Pattern ;
    Pair : '**' NAME | ( '-'? NUMBER ( ( '+' | '-' ) NUMBER )? | Strings | Dotted | 'None' | 'True' | 'False' ) ':' Pattern ;
    Stars : Star ( ',' Star )* ','? ;
    Star : '*' Operation | Named ;
    Named : NAME ':=' Test | Test ;
    Test : 'lambda' Bare? ':' Test | Operation ( 'if' Operation 'else' Test )? ;
    Bare : BareOne ( ',' BareOne )* ','? ;
    BareOne : '/' | '*' NAME? | '**' NAME | NAME ( '=' Test )? ;
    Operation : Operand ( Operator Operand )* ;
    Operator : BINARY | '*' | '**' | '-' | '+' | '@' | '/' | '|' | 'in' | 'not' 'in' | 'is' 'not'? ;
    Operand : ( 'not' | '-' | '+' | '~' )* 'await'? Primary ;
    Primary : Atom ( '.' NAME | Arguments | '[' Slice ( ',' Slice )* ','? ']' )* ;
    Slice : Star | Test? ':' Test? ( ':' Test? )? ;
    Arguments : '(' ( Argument ( ',' Argument )* ','? )? ')' ;
    Argument : NAME '=' Test | ( '*' | '**' ) Test | Named Comprehension? ;
    Comprehension : ( 'async'? 'for' Targets 'in' Operation ( 'if' Condition )* )+ ;
    Condition : NAME ':=' Operation | Operation | 'lambda' Bare? ':' Condition ;
    Atom : NAME | NUMBER | Strings | 'None' | 'True' | 'False' | '...' | '(' ( Yield | Star Comprehension | Stars )? ')' | '[' ( Star Comprehension | Stars )? ']' | '{' ( Entry ( ',' Entry )* ','? | Entry Comprehension | Star Comprehension | Stars )? '}' ;
    Entry : '**' Operation | Test ':' Test ;
    Strings : ( STRING | Formatted )+ ;
    Formatted : FSTART ( FMIDDLE | Field )* FEND ;
    Field : '{' ( Yield | Stars ) '='? ( '!' NAME )? ( ':' ( FMIDDLE | Field )* )? '}' ;
    """,
    ("File",),
)
_PY_SOFT = frozenset(("match", "case", "type", "_"))
_PY_BINARY = frozenset("and or < > == >= <= != // % << >> & ^".split())
_PY_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())


def python_tokens(text: str) -> list[int]:
    bit, out = PYTHON.bit, []
    kinds = {
        tokenize.NUMBER: bit["NUMBER"], tokenize.STRING: bit["STRING"], tokenize.NEWLINE: bit["NEWLINE"], tokenize.INDENT: bit["INDENT"], tokenize.DEDENT: bit["DEDENT"], tokenize.ENDMARKER: bit["END"],
        tokenize.FSTRING_START: bit["FSTART"], tokenize.FSTRING_MIDDLE: bit["FMIDDLE"], tokenize.FSTRING_END: bit["FEND"],
    }
    if "\x00" in text:
        raise Malformed
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            kind, s = t.type, t.string
            if kind in (tokenize.COMMENT, tokenize.NL):
                continue
            if kind in kinds:
                out.append(kinds[kind])
            elif kind == tokenize.NAME and not (keyword.iskeyword(s) and s not in _PY_SOFT):
                out.append(bit["NAME"] | bit.get(s, 0))
            else:
                out.append(bit.get(s, 0) | (bit["BINARY"] if s in _PY_BINARY else bit["AUGMENTED"] if s in _PY_AUGMENTED else 0))
    except (tokenize.TokenError, SyntaxError, ValueError) as e:
        raise Malformed from e
    return out


# --- Parts that are parsed once -----------------------------------------------------------------------------------------
#
# What stands between two line ends or two brackets derives from one symbol, whatever is around it, so the parse of such a
# part is a stretch of its own. Many parts have the same tokens: a stretch is parsed once and remembered by its tokens.

#: Stretches remembered by a worker; longer ones than STRETCH tokens are parsed each time.
REMEMBERED, STRETCH = 1 << 16, 96


@lru_cache(REMEMBERED)
def _remembered(language: str, symbol: str, tokens: tuple[int, ...]) -> bool:
    return bool(accepts(_STRETCHES[language], tokens, (symbol,)))


def _derives(language: str, symbol: str, tokens: list[int]) -> bool:
    if len(tokens) > STRETCH:
        return bool(accepts(_STRETCHES[language], tokens, (symbol,)))
    return _remembered(language, symbol, tuple(tokens))


def json_parts(tokens: list[int]) -> list[int]:
    """The tokens with every object and array, the inner ones first, parsed and replaced by a value."""
    bit = JSON.bit
    opening, closing = {bit["{"]: "Object", bit["["]: "Array"}, (bit["}"], bit["]"])
    open_: list[list[int]] = [[]]
    for t in tokens:
        if t in opening:
            open_.append([t])
        elif t in closing:
            if len(open_) == 1 or not _derives("json", opening[open_[-1][0]], [*open_[-1], t]):
                raise Malformed
            open_.pop()
            open_[-1].append(bit["WORD"])
        else:
            open_[-1].append(t)
    if len(open_) > 1:
        raise Malformed
    return open_[0]


def toml_parts(tokens: list[int]) -> list[int]:
    """The tokens with every line outside brackets parsed and left empty."""
    bit = TOML.bit
    up, down, end = (bit["["], bit["{"]), (bit["]"], bit["}"]), bit["END"]
    out, line, depth = [], [], 0
    for t in tokens:
        if t == end or (t == bit["NL"] and depth == 0):
            if line and not _derives("toml", "Line", line):
                raise Malformed
            out.append(t)
            line = []
            continue
        depth += (t in up) - (t in down)
        line.append(t)
    return out


def python_parts(tokens: list[int]) -> list[int]:
    """The tokens with every line that begins no compound statement parsed and replaced by one token."""
    bit = PYTHON.bit
    compound = sum(bit[w] for w in ("if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class", "async", "match", "case", "@"))
    newline, frame = bit["NEWLINE"], bit["INDENT"] | bit["DEDENT"] | bit["END"] | bit["NEWLINE"]
    out, line = [], []
    for t in tokens:
        if not line and t & frame:
            out.append(t)
            continue
        line.append(t)
        if t == newline:
            if line[0] & compound:
                out += line
            elif _derives("py", "Simple", line):
                out.append(bit["LINE"])
            else:
                raise Malformed
            line = []
    return out + line


def _in_parts(lexer: Callable[[str], list[int]], parts: Callable[[list[int]], list[int]]) -> Callable[[str], list[int]]:
    return lambda text: parts(lexer(text))


_STRETCHES = {"json": JSON, "toml": TOML, "py": PYTHON}
_python = _in_parts(python_tokens, python_parts)

#: Per extension: the lexer and the grammar, whose start symbols are the dialects.
LANGUAGES: dict[str, tuple[Callable[[str], list[int]], Grammar]] = {
    "json": (_in_parts(json_tokens, json_parts), JSON), "toml": (_in_parts(toml_tokens, toml_parts), TOML), "py": (_python, PYTHON), "pyi": (_python, PYTHON),
    "js": (javascript_tokens, JAVASCRIPT), "mjs": (javascript_tokens, JAVASCRIPT), "cjs": (javascript_tokens, JAVASCRIPT),
}
