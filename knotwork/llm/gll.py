"""Generalised LL recognition over a graph-structured stack.

A grammar is given in EBNF; several start symbols (dialects) are recognised in one run over shared stack nodes. A token is
an int with one bit for every terminal that it may stand for, so that a lexeme can be a keyword and a name at once.
Terminals in angle brackets look at a token without taking it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

_META = re.compile(r"'([^']+)'|(<\w+>)|(\w+)|([:|;()*?+])")


class Grammar:
    def __init__(self, text: str, starts: tuple[str, ...]):
        self.bit: dict[str, int] = {}
        self.rules: dict[str, list[list]] = {}
        tokens = [m.groups() for m in _META.finditer(text)]
        names = {tokens[i][2] for i in range(len(tokens) - 1) if tokens[i][2] and tokens[i + 1][3] == ":"}
        self._tokens, self._names, self._at = tokens, names, 0
        while self._at < len(tokens):
            name = tokens[self._at][2]
            self._at += 2
            self.rules[name] = self._alternatives(name)
            self._at += 1
        self.peeks = sum(b for t, b in self.bit.items() if t[0] == "<")
        self._number(starts)

    def terminal(self, name: str) -> int:
        return self.bit.setdefault(name, 1 << len(self.bit))

    def _alternatives(self, name: str) -> list[list]:
        out, alt = [], []
        while self._at < len(self._tokens):
            quoted, peek, word, meta = self._tokens[self._at]
            if meta in (";", ")"):
                break
            self._at += 1
            if meta == "|":
                out.append(alt)
                alt = []
                continue
            if meta == "(":
                item = f"{name}~{len(self.rules)}"
                self.rules[item] = []
                self.rules[item] = self._alternatives(item)
                self._at += 1
            else:
                item = word if word in self._names else self.terminal(quoted or peek or word)
            follow = self._tokens[self._at][3] if self._at < len(self._tokens) else None
            if follow in ("*", "?", "+"):
                self._at += 1
                loop = f"{name}~{len(self.rules)}"
                self.rules[loop] = [[item], []] if follow == "?" else [[item, loop], []]
                alt += [item, loop] if follow == "+" else [loop]
            else:
                alt.append(item)
        return [*out, alt]

    def _number(self, starts: tuple[str, ...]) -> None:
        """Nonterminals become negative numbers; every alternative gets the set of tokens with which it is chosen."""
        number = {n: -k - 1 for k, n in enumerate(self.rules)}
        rules = {number[n]: [tuple(number[s] if isinstance(s, str) else s for s in alt) for alt in alts] for n, alts in self.rules.items()}
        first, follow, empty = dict.fromkeys(rules, 0), dict.fromkeys(rules, 0), dict.fromkeys(rules, False)

        def of(symbols: tuple) -> tuple[int, bool]:
            mask = 0
            for s in symbols:
                mask |= s if s > 0 else first[s]
                if s > 0 or not empty[s]:
                    return mask, False
            return mask, True

        changed = True
        while changed:
            changed = False
            for n, alts in rules.items():
                for alt in alts:
                    mask, null = of(alt)
                    if mask & ~first[n] or null > empty[n]:
                        first[n], empty[n], changed = first[n] | mask, empty[n] or null, True
                    for i, s in enumerate(alt):
                        if s < 0:
                            mask, null = of(alt[i + 1 :])
                            mask |= follow[n] if null else 0
                            if mask & ~follow[s]:
                                follow[s], changed = follow[s] | mask, True
        #: Alternatives by nonterminal, token and the token after it, filled as they are met.
        self.viable: dict[tuple[int, int, int], tuple] = {}
        self.number, self.starts = number, {s: number[s] for s in starts}
        self.first, self.empty = first, empty
        self.alternatives = {n: [(of(alt)[0] | (follow[n] if of(alt)[1] else 0), alt) for alt in alts] for n, alts in rules.items()}


    def choices(self, symbol: int, token: int, after: int) -> tuple:
        """The alternatives of a nonterminal that the next two tokens leave."""
        if not self.first[symbol] & token:
            return ()
        takes = lambda s: s > 0 and not s & self.peeks
        return tuple(a for mask, a in self.alternatives[symbol] if mask & token and not (len(a) > 1 and takes(a[0]) and takes(a[1]) and not a[1] & after))


def accepts(grammar: Grammar, tokens: Sequence[int], starts: tuple[str, ...] = ()) -> set[str]:
    """The start symbols, of the grammar or as given, that derive all of the tokens.

    A nonterminal of which the next token leaves one alternative is expanded where it stands, as an LL(1) parser would; a
    node of the shared stack is made only where several remain. A node meets each of its ways on with each of its ends."""
    empty, peeks, viable, end = grammar.empty, grammar.peeks, grammar.viable, len(tokens)
    nodes: dict[tuple[int, int], tuple[list, list]] = {}  # (nonterminal, position): (ways on, ends)
    todo: list = []
    roots = {}
    for name, s in ({n: grammar.number[n] for n in starts} if starts else grammar.starts).items():
        node = nodes[(s, 0)] = ([], [])
        roots[name] = node
        todo += [(alt, 0, None, node, 0) for mask, alt in grammar.alternatives[s] if tokens and mask & tokens[0]]
    while todo:
        # rest: what follows this alternative within the node, as (alternative, dot, rest)
        alt, dot, rest, node, at = todo.pop()
        token = tokens[at] if at < end else 0
        n = len(alt)
        while True:
            if dot == n:
                if rest is not None:
                    alt, dot, rest = rest
                    n = len(alt)
                    continue
                ways, ends = node
                if at not in ends:
                    ends.append(at)
                    todo += [(*way, at) for way in ways]
                break
            symbol = alt[dot]
            dot += 1
            if symbol > 0:
                if not symbol & token:
                    break
                if not symbol & peeks:
                    at += 1
                    token = tokens[at] if at < end else 0
                continue
            after = tokens[at + 1] if at + 1 < end else 0
            some = viable.get((symbol, token, after))
            if some is None:
                some = viable[(symbol, token, after)] = grammar.choices(symbol, token, after)
            if not some:
                if empty[symbol]:
                    continue
                break
            if len(some) == 1:
                if dot < n:
                    rest = (alt, dot, rest)
                alt, dot = some[0], 0
                n = len(alt)
                continue
            way = (alt, dot, rest, node)
            child = nodes.get((symbol, at))
            if child is None:
                child = nodes[(symbol, at)] = ([way], [])
                todo += [(a, 0, None, child, at) for a in some]
            else:
                child[0].append(way)
                todo += [(*way, stop) for stop in child[1]]
            break
    return {name for name, node in roots.items() if end in node[1]}
