"""Syntax check of source files: a table-driven pushdown automaton, built from bundled grammars.

A lexer turns a file into one symbol per token. Nesting is by brackets (and indented blocks), so
the automaton pushes where one opens and pops where it closes: what it reads in between is a
span, and on closing it the span becomes one symbol, the set of nonterminals that derive it.
Within a span a transition table tells the next state from state and symbol. The tables come
from the rules of the grammar: networks that call each other, one set of positions in them a
state, worked out when a state is first met and kept. Equal spans are read once. The first
token for which the table has no transition is an error that nothing after it can repair. The
grammars are text files beside this module.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.sources.tables import current_wide, norm_path

FOLDER = Path(__file__).parent / "grammars"
LANGUAGES = {"ts": "ts", "js": "js", "mjs": "js", "php": "php", "py": "py", "go": "go"}
NAMES = {"ts": "typescript", "js": "javascript", "php": "php", "py": "python", "go": "go"}
MEMO_CELLS = 100_000
MEMO_LENGTH = 400

_BASE = {"P": 0xF0000, "S": 0xF4000, "B": 0xF8000, "I": 0xFC000}
_OPEN, _CLOSE = {"(": "P", "[": "S", "{": "B", "\x02": "I"}, {")": "P", "]": "S", "}": "B", "\x03": "I"}
_ITEM = re.compile(r"'(?P<op>[^']+)'|(?P<cell>[PSBI]\.\w+)|%(?P<macro>\w+)|(?P<meta>(?:[!<=]\(|[()|*+?])+)|(?P<sym>\w+)")


class Network:
    """Rules as networks of nodes: edges over symbols, calls of other rules, and tests of the symbols around a position."""

    def __init__(self):
        self.edges: list[list[tuple]] = []  # of a node: ("eps", to), ("sym", chars, to), ("call", name, to), ("next", test, to), ("prev", chars, to)
        self.rules: dict[str, tuple[int, int]] = {}
        self.tests: list[tuple[bool, frozenset]] = []  # whether the next symbol must be one of these, or none of them

    def node(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def test(self, wanted: bool, chars: frozenset) -> int:
        self.tests.append((wanted, chars))
        return len(self.tests) - 1


class Table:
    """Transition table over sets of positions in a network; states are worked out when first met."""

    def __init__(self, net: Network, starts: dict[str, int]):
        self.net, self.finals = net, {net.rules[n][1]: bit for n, bit in starts.items()}
        self.ids: dict[frozenset, int] = {}
        self.sets: list[list[tuple]] = []
        self.next: list[dict[str, int]] = []
        self.ends: list[list[tuple]] = []
        self.start = self._state([(net.rules[n][0], (), frozenset()) for n in starts], "")

    def _state(self, positions: list[tuple], prev: str) -> int:
        """The state of all positions that these lead to without reading: (node, nodes to return to, pending tests)."""
        edges, todo, seen = self.net.edges, list(positions), set(positions)
        reads, ends = [], []
        while todo:
            at = node, back, pending = todo.pop()
            if node in self.finals and not back:
                ends.append((self.finals[node], pending))
            reading = False
            for e in edges[node]:
                if e[0] == "sym":
                    reading = True
                    continue
                if e[0] == "eps":
                    to = (e[1], back, pending)
                elif e[0] == "call":
                    to = (self.net.rules[e[1]][0], (e[2], back), pending)
                elif e[0] == "return":
                    if not back:
                        continue
                    to = (back[0], back[1], pending)
                elif e[0] == "next":
                    to = (e[2], back, pending | {e[1]})
                elif prev in e[1]:
                    to = (e[2], back, pending)
                else:
                    continue
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
            if reading:
                reads.append(at)
        key = frozenset(reads), frozenset(ends)
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.sets)
            self.sets.append(reads)
            self.ends.append(ends)
            self.next.append({})
        return got

    def _holds(self, pending: frozenset, symbol: str | None) -> bool:
        return all((symbol in chars) == wanted for wanted, chars in (self.net.tests[t] for t in pending))

    def step(self, state: int, symbol: str) -> int:
        """The next state, or -1 if nothing can go on with this symbol."""
        to = [(e[2], back, frozenset()) for node, back, pending in self.sets[state] for e in self.net.edges[node] if e[0] == "sym" and symbol in e[1] and self._holds(pending, symbol)]
        got = self._state(to, symbol) if to else -1
        self.next[state][symbol] = got
        return got

    def accepted(self, state: int, symbol: str | None) -> int:
        """Bits of the rules that may end here before this symbol (None: the end of the span)."""
        mask = 0
        for bit, pending in self.ends[state]:
            if self._holds(pending, symbol):
                mask |= bit
        return mask

    def read(self, content: str) -> tuple[int, int]:
        """(bits of the rules that derive the content, index of the first symbol that none can read, or its length)."""
        state, table = self.start, self.next
        for i, c in enumerate(content):
            to = table[state].get(c)
            if to is None:
                to = self.step(state, c)
            if to < 0:
                return 0, i
            state = to
        return self.accepted(state, None), len(content)


class Grammar:
    """Symbols and tables of one language: per bracket kind, for runs that are reduced first, and for the file."""

    def __init__(self, text: str, flavour: str = ""):
        self.symbols: dict[str, str] = {}
        macros: dict[str, str] = {}
        cells: dict[str, dict[str, str]] = {k: {} for k in _BASE}
        top = ""
        joins: set[str] = set()
        reduce: dict[str, str] = {}
        for line in text.splitlines():
            line = line.strip()
            if not line or line[0] == "#":
                continue
            if line[:3] in ("TS ", "JS "):
                if line[:2] != flavour:
                    continue
                line = line[3:]
            if " ~= " in line:
                head, rule = line.split(" ~= ", 1)
                joins.add(head.strip()[1:])
            else:
                head, rule = line.split(" := ", 1)
            head, rule = head.strip(), rule.strip()
            if head.startswith("%"):
                macros[head[1:]] = rule
            elif head.startswith("REDUCE "):
                reduce[head[7:]] = rule
            elif head == "file":
                top = rule
            else:
                kind, name = head.split()
                cells[kind][name] = rule
        self.bits = {k: {n: 1 << i for i, n in enumerate(v)} for k, v in cells.items()}
        self.net, self._source = Network(), macros
        for name, rule in macros.items():
            self._rule(name, rule, name in joins)
        for kind, rules in cells.items():
            for name, rule in rules.items():
                self._rule(f"{kind} {name}", rule)
        for name, rule in reduce.items():
            self._rule(f"REDUCE {name}", rule)
        self._rule("file", top)
        self.cells = {k: Table(self.net, {f"{k} {n}": b for n, b in v.items()}) for k, v in self.bits.items()}
        self.reduces = [(Table(self.net, {f"REDUCE {n}": 1}), self.symbol(n)) for n in reduce]
        self.top = Table(self.net, {"file": 1})
        self.opens, self.closes = self.symbol("<"), self.symbol(">")
        self.question, self.colon = self.symbol("?") if flavour else "\x01", self.symbol(":")
        self.optional = "".join(map(self.symbol, (",", ";", "Z", "=", ":"))) if flavour == "TS" else ""
        self.memo: dict[tuple[str, str], str] = {}

    def symbol(self, name: str) -> str:
        """The character of a token kind, keyword or operator."""
        if name not in self.symbols:
            self.symbols[name] = ";" if name == ";" else chr(0xE000 + len(self.symbols))
        return self.symbols[name]

    # -- rules to networks

    def _rule(self, name: str, rule: str, joined: bool = False) -> None:
        a, z = self.net.node(), self.net.node()
        self.net.rules[name] = a, z
        self.net.edges[z].append(("return",))
        self._join(rule, a, z) if joined else self._any(self._tokens(rule), a, z)

    @staticmethod
    def _tokens(rule: str) -> list[str]:
        out: list[str] = []
        for m in _ITEM.finditer(rule):
            out += re.findall(r"[!<=]?\(|[)|]|[*+?]+", m["meta"]) if m["meta"] else [m[0]]
        return out[::-1]

    def _any(self, toks: list[str], a: int, z: int) -> None:
        """Alternatives up to a closing parenthesis or the end, from node ``a`` to ``z``."""
        at = self.net.node()
        self.net.edges[a].append(("eps", at))
        while toks and toks[-1] != ")":
            t = toks.pop()
            if t == "|":
                self.net.edges[at].append(("eps", z))
                at = self.net.node()
                self.net.edges[a].append(("eps", at))
                continue
            to, fro = self.net.node(), at
            begin = self.net.node()
            self.net.edges[fro].append(("eps", begin))
            self._item(t, toks, begin, to)
            if toks and toks[-1][0] in "*+?":
                q = toks.pop()[0]
                if q in "*?":
                    self.net.edges[begin].append(("eps", to))
                if q in "*+":
                    self.net.edges[to].append(("eps", begin))
            at = self.net.node()
            self.net.edges[to].append(("eps", at))
        self.net.edges[at].append(("eps", z))

    def _item(self, t: str, toks: list[str], a: int, z: int) -> None:
        edges = self.net.edges
        if t == "(":
            self._any(toks, a, z)
            toks.pop()
        elif t in ("!(", "=(", "<("):
            inside = []
            while toks[-1] != ")":
                inside.append(toks.pop())
            toks.pop()
            chars = self._firsts(" ".join(inside))
            edges[a].append(("prev", chars, z) if t == "<(" else ("next", self.net.test(t == "=(", chars), z))
        elif t == "END":
            edges[a].append(("next", self.net.test(True, frozenset([None])), z))
        elif t != "NEVER":
            if t[0] == "%":
                edges[a].append(("call", t[1:], z))
            else:
                edges[a].append(("sym", self._chars(t), z))

    def _chars(self, t: str) -> frozenset:
        """All symbols that stand for a token or for a span of a nonterminal."""
        if t[0] == "'":
            return frozenset([self.symbol(t[1:-1])])
        if t[1:2] == "." and t[0] in _BASE:
            bit, n = self.bits[t[0]].get(t[2:], 0), len(self.bits[t[0]])
            return _Span(_BASE[t[0]], 1 << n, bit)
        return frozenset([self.symbol(t)])

    def _firsts(self, rule: str) -> frozenset:
        """Symbols of a list of alternatives of one symbol each, other lists included."""
        out: list = []
        for t in self._tokens(rule)[::-1]:
            if t[0] == "%":
                out.append(self._firsts(self._source[t[1:]]))
            elif t not in ("|", "(", ")", "NEVER"):
                out.append(self._chars(t))
        return _Either(out)

    def _join(self, rule: str, a: int, z: int) -> None:
        """X ( SEP X )*: go on after SEP if START follows, end where STOP (or START) does not."""
        x, sep, start, *stop = rule.removesuffix(" ?").split(" ~ ")
        begin, mid, after, out = (self.net.node() for _ in range(4))
        edges = self.net.edges
        edges[a].append(("eps", begin))
        self._any(self._tokens(x), begin, mid)
        self._any(self._tokens(sep), mid, after)
        edges[after].append(("next", self.net.test(True, self._firsts(start)), begin))
        edges[mid].append(("next", self.net.test(False, self._firsts(stop[0] if stop else start)), out))
        edges[out] += [("eps", z), ("eps", begin)]

    # -- spans

    def reduced(self, content: str) -> str:
        """Bracket-like runs without brackets of their own, innermost first, as one symbol each."""
        for table, symbol in self.reduces:
            at = content.rfind(self.opens)
            while at >= 0:
                state, i = table.start, at
                while i < len(content):
                    to = table.next[state].get(content[i])
                    state = table.step(state, content[i]) if to is None else to
                    if state < 0:
                        break
                    i += 1
                    if content[i - 1] == self.closes and table.accepted(state, content[i] if i < len(content) else None):
                        content = content[:at] + symbol + content[i:]
                        break
                at = content.rfind(self.opens, 0, at) if at else -1
        return content

    def unpaired(self, content: str) -> bool:
        """Whether a conditional in the span lacks its second branch (``?`` marks of optional members aside)."""
        if self.question not in content:
            return False
        waiting = 0
        for i, c in enumerate(content):
            if c == self.question:
                after = content[i + 1 : i + 2]
                waiting += not (self.optional and (after in self.optional or 0xF0000 <= ord(after or " ") < 0xF4000 and self.colon not in content[i:]))
            elif c == self.colon and waiting:
                waiting -= 1
        return waiting > 0

    def cell(self, kind: str, content: str) -> str:
        """The symbol for a span of this content; bit mask 0 if no rule derives it."""
        key = (kind, content)
        got = self.memo.get(key)
        if got is None:
            short = self.reduced(content)
            mask = self.cells[kind].read(short)[0]
            if mask and self.unpaired(short):
                mask = 0
            got = chr(_BASE[kind] + mask)
            if len(content) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO_CELLS:
                    self.memo.clear()
                self.memo[key] = got
        return got


class _Span(frozenset):
    """All symbols for spans that a nonterminal derives, by its bit."""

    def __new__(cls, base: int, size: int, bit: int):
        return super().__new__(cls)

    def __init__(self, base: int, size: int, bit: int):
        self.base, self.size, self.bit = base, size, bit

    def __contains__(self, symbol) -> bool:
        n = ord(symbol) - self.base if symbol else -1
        return 0 <= n < self.size and bool(n & self.bit)


class _Either(frozenset):
    """A union of sets of symbols."""

    def __new__(cls, parts: list):
        return super().__new__(cls)

    def __init__(self, parts: list):
        self.plain = frozenset().union(*(p for p in parts if type(p) is frozenset), *(p.plain for p in parts if type(p) is _Either))
        self.spans = [p for p in parts if type(p) is _Span] + [x for p in parts if type(p) is _Either for x in p.spans]

    def __contains__(self, symbol) -> bool:
        return symbol in self.plain or any(symbol in p for p in self.spans)


def parse(grammar: Grammar, tokens: str, soft: str = "") -> int | None:
    """Index of the first token that cannot be part of a valid file, or None.

    ``tokens`` has one symbol a token; ``soft`` is a symbol that counts only directly inside
    braces and at the top.
    """
    broken = tokens.find("\x00")  # no token of the language starts there
    if broken >= 0:
        return broken
    frames: list[list[str]] = [[]]
    opened: list[tuple[str, int]] = []
    last = 0
    for m in _BRACKET.finditer(tokens):
        at, b = m.start(), m[0]
        frames[-1].append(tokens[last:at])
        last = at + 1
        if b in _OPEN:
            opened.append((b, at))
            frames.append([])
            continue
        if not opened or _OPEN[opened[-1][0]] != _CLOSE[b]:
            return at
        b0, start = opened.pop()
        content = "".join(frames.pop())
        kind = _OPEN[b0]
        if soft and kind in "PS" and soft in content:
            content = content.replace(soft, "")
        c = grammar.cell(kind, content)
        if ord(c) == _BASE[kind]:
            return _place(tokens, start + 1, at, grammar.cells[kind].read(grammar.reduced(content))[1])
        frames[-1].append(c)
    if opened:
        return len(tokens) - 1 if tokens else 0
    frames[-1].append(tokens[last:])
    content = grammar.reduced("".join(frames[0]))
    got, end = grammar.top.read(content)
    if got and not grammar.unpaired(content):
        return None
    return _place(tokens, 0, len(tokens), end)


_BRACKET = re.compile("[()\\[\\]{}\x02\x03]")


def _place(tokens: str, start: int, end: int, skip: int) -> int:
    """Token of the symbol numbered ``skip`` of a span: whole spans in it are one symbol each."""
    depth, at = 0, start
    while at < end and (skip > 0 or depth):
        if tokens[at] in _OPEN:
            depth += 1
        elif tokens[at] in _CLOSE:
            depth -= 1
            skip -= depth == 0
        elif depth == 0:
            skip -= 1
        at += 1
    return min(at, max(start, end - 1))


# -- lexers: each gives the token symbols and, if asked, where the tokens start -----------------


class Lexer:
    """Splits a text by one pattern; ``kinds`` maps known token texts, ``other`` names the rest."""

    def __init__(self, grammar: Grammar, pattern: str, keywords: str, flags: int = 0, fold: bool = False):
        self.g = grammar
        self.scan = re.compile(pattern, re.S | flags)
        self.fold = fold
        self.fixed = {k: grammar.symbol(k) for k in keywords.split()}
        self.err = "\x00"
        self.memo: dict[str, str] = {}

    def classify(self, t: str) -> str:
        raise NotImplementedError

    def kind(self, t: str) -> str:
        k = self.memo.get(t)
        if k is None:
            k = self.classify(t)
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[t] = k
        return k

    def symbols(self, text: str) -> tuple[str, list[int]]:
        raise NotImplementedError

    def plain(self, text: str) -> str:
        kind = self.kind
        return "".join([kind(t) for t in self.scan.findall(text)])

    def located(self, text: str) -> tuple[str, list[int]]:
        """Symbols and the text offset of each."""
        out, at = [], []
        for m in self.scan.finditer(text):
            k = self.kind(m[0])
            out.append(k)
            at.extend([m.start()] * len(k))
        return "".join(out), at


_OPS_C = r"\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*"
_NUM_C = r"(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)(?:[A-Za-z_]\w*)?"


def _closing(text: str, i: int) -> int:
    """Index of the brace that closes the one before ``i``, strings inside aside, or -1."""
    depth = 1
    while i < len(text):
        c = text[i]
        if c in "\"'":
            end = _QUOTED.match(text, i)
            i = end.end() if end else i + 1
            continue
        depth += (c in "{[(") - (c in "}])")
        if not depth:
            return i
        i += 1
    return -1


_QUOTED = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)


class JsLexer(Lexer):
    WORDS = "async await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield get set of type as satisfies from static declare abstract readonly namespace public private protected override keyof infer is asserts unique module interface let implements accessor enum"
    NAMES = "ID NUM STR REGEX TPL PRIV"

    def __init__(self, flavour: str):
        g = Grammar((FOLDER / "js.txt").read_text(), flavour)
        regex = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
        pattern = (
            r"\n|/\*.*?\*/|//[^\n]*|/\*|"
            rf"(?:(?<=[(,=:\[!&|?{{}};+\-*%~^<>\n])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|\A)[ \t\r]*{regex}|"
            rf"[A-Za-z_$\u0080-￿][\w$]*|{_NUM_C}|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[A-Za-z_$][\w$]*|\x01|{_OPS_C}|\S"
        )
        super().__init__(g, pattern, self.WORDS)
        s = g.symbol
        kw = "".join(s(w) for w in "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await enum".split())
        self.kw = s("KW")
        soft_words = "".join(s(w) for w in "async get set of type as satisfies from static declare abstract readonly namespace public private protected override keyof infer is asserts unique module interface let implements accessor".split())
        ends = "".join(s(k) for k in "ID NUM STR REGEX TPL PRIV this super true false null return break continue debugger".split()) + soft_words + "".join(map(s, ("++", "--"))) + ")]}"
        begins = "".join(s(k) for k in "ID NUM STR REGEX PRIV break case class const continue debugger default delete do export false for function if import new null return super switch this throw true try typeof var void while with yield await enum".split()) + soft_words + "".join(map(s, ("!", "~", "@", "++", "--", "TPL", "..."))) + "[*{"
        as_name = re.escape(kw)
        self.z = s("Z")
        self.break_ = re.compile(f"(?<=[{re.escape(ends)}])\n+(?=[{re.escape(begins)}])")
        # a keyword is a name after a dot, before a colon in an object, or as a key or member name before "("
        self.member = re.compile(f"(?<=[{re.escape(s('.') + s('?.'))}])\n*[{as_name}]")
        self.key = re.compile(f"(?<=[{{;{re.escape(s('Z') + s(','))}])([{as_name}])(?=[{re.escape(s(':'))}])")
        self.case_default = s("default")
        self.star = s("*")

    def classify(self, t: str) -> str:
        c = t[0]
        s = self.g.symbol
        if c == "\n":
            return "\n"
        if t.startswith(("/*", "//")):
            return self.err if t == "/*" else ("\n" if "\n" in t else "")
        if t in self.fixed:
            return self.fixed[t]
        if c.isalpha() or c in "_$" or ord(c) > 127:
            return s("ID") if c.isidentifier() or c == "$" else ("" if c.isspace() or c == "﻿" else self.err)
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return s("NUM") if re.fullmatch(r"0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|(?:0|[1-9](?:_?\d)*)n", t) else self.err
        if c in "\"'":
            return s("STR") if len(t) > 1 else self.err
        if c == "#":
            return s("PRIV") if len(t) > 1 else self.err
        if c == "\x01":
            return s("TPL")
        if c in " \t\r" or (c == "/" and len(t) > 2 and t[1] not in "*/="):
            return s("REGEX")
        if t in "()[]{};":
            return t
        if t in self.g.symbols:
            return s(t)
        return self.err

    @staticmethod
    def templates(text: str) -> str:
        """Template literals become one mark and their expressions in parentheses."""
        if "`" not in text:
            return text
        start = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`", re.S)

        def literal(i: int) -> tuple[str, int]:
            out = "\x01"
            while i < len(text):
                c = text[i]
                if c == "\\":
                    i += 2
                elif c == "`":
                    return out, i + 1
                elif text.startswith("${", i):
                    depth, j, part = 1, i + 2, ""
                    while j < len(text) and depth:
                        if text[j] == "`":
                            sub, j = literal(j + 1)
                            part += sub
                            continue
                        if text[j] in "\"'":
                            m = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'").match(text, j)
                            if m:
                                part += m[0]
                                j = m.end()
                                continue
                        depth += (text[j] == "{") - (text[j] == "}")
                        part += text[j] if depth else ""
                        j += 1
                    out += "(" + part + ")"
                    i = j
                else:
                    i += 1
            return out + "\x00", i

        out, i = [], 0
        while m := start.search(text, i):
            if m[0] != "`":
                out.append(text[i : m.end()])
                i = m.end()
                continue
            out.append(text[i : m.start()])
            sub, i = literal(m.end())
            out.append(sub)
        return "".join(out) + text[i:]

    def finish(self, k: str) -> str:
        k = self.member.sub(self.kw, k) if "\n" not in k else self.member.sub(lambda m: self.kw, k)
        k = self.break_.sub(self.z, k).replace("\n", "")
        return self.key.sub(lambda m: m[1] if m[1] == self.case_default else self.kw, k)

    def symbols(self, text: str) -> tuple[str, list[int]]:
        return self.finish(self.plain(self.templates(text))), []

    def soft(self) -> str:
        return self.z


class GoLexer(Lexer):
    WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"

    def __init__(self):
        g = Grammar((FOLDER / "go.txt").read_text())
        super().__init__(g, r"\n|/\*.*?\*/|//[^\n]*|/\*|[A-Za-z_\u0080-\U0010ffff]\w*|(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)\w*|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n][^'\n]*)'|\.\.\.|<<=|>>=|&\^=|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|\S", self.WORDS)
        s = g.symbol
        ends = "".join(s(k) for k in ("ID", "NUM", "STR", "RUNE", "break", "continue", "fallthrough", "return", "++", "--")) + ")]}"
        self.semi = re.compile(f"(?<=[{re.escape(ends)}])\n+")

    def classify(self, t: str) -> str:
        c, s = t[0], self.g.symbol
        if c == "\n":
            return "\n"
        if t.startswith(("/*", "//")):
            return self.err if t == "/*" else ("\n" if "\n" in t else "")
        if t in self.fixed:
            return self.fixed[t]
        if c.isalpha() or c == "_" or ord(c) > 127:
            return s("ID") if t.isidentifier() else ("" if c == "﻿" else self.err)
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return s("NUM") if re.fullmatch(r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]*|[1-9][\d_]*|(?:\d[\d_]*\.[\d_]*|\.\d[\d_]*|\d[\d_]*)(?:[eE][+-]?\d+)?|\d[\d_]*\.[\d_]*)i?|0[\d_]+i", t) else self.err
        if c == '"' or c == "`":
            return s("STR") if len(t) > 1 else self.err
        if c == "'":
            return s("RUNE") if len(t) > 2 else self.err
        if t in "()[]{};":
            return t
        return s(t) if t in self.g.symbols else self.err

    def symbols(self, text: str) -> tuple[str, list[int]]:
        return self.semi.sub(";", self.plain(text + "\n")).replace("\n", ""), []

    def soft(self) -> str:
        return ""


class PhpLexer(Lexer):
    WORDS = "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum extends final finally fn for foreach from function global goto if implements include instanceof insteadof interface isset list match namespace new or print private protected public readonly return static switch throw trait try unset use var while xor yield exit"
    ALIAS = {"die": "exit", "include_once": "include", "require": "include", "require_once": "include", "eval": "empty"}

    def __init__(self):
        g = Grammar((FOLDER / "php.txt").read_text())
        pattern = (
            r"/\*.*?\*/|(?://|#(?!\[))(?:(?!\?>)[^\n])*|/\*|\?>.*?(?:<\?php\b|<\?=|\Z)|#\[|"
            r"<<<[ \t]*([\"']?)(\w+)\1\n(?:.*?\n)??[ \t]*\2\b|\$[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*|\\?[A-Za-z_\u0080-\U0010ffff]\w*(?:\\\w+)*\\?|"
            r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)\w*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|"
            r"\([ \t]*(?:int|integer|float|double|string|bool|boolean|array|object|binary)[ \t]*\)|"
            r"\.\.\.|<=>|===|!==|\*\*=|\?\?=|<<=|>>=|\?->|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\|>|\?\?|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|\S"
        )
        super().__init__(g, pattern, self.WORDS)
        s = g.symbol
        kw = "".join(self.fixed.values())
        self.member = re.compile(f"(?<=[{re.escape(s('->') + s('?->') + s('::'))}])[{re.escape(kw.replace(s('class'), ''))}]")
        self.called = re.compile(f"(?<=[{s('function')}{s('const')}])[{re.escape(kw.replace(s('array'), ''))}](?=[({re.escape(s('='))}])")
        # a constant on the left of an assignment, other than as a member or in a declaration
        ops = "".join(map(s, ("-", "+", "*", "/", "%", ".", "<", ">", "==", "!=", "===", "!==", "<=", ">=", "&&", "||", "??", "=", "!", "return", "echo")))
        gets = "".join(map(s, ("=", "+=", "-=", "*=", "/=", ".=", "%=", "**=", "??=", "&=", "|=", "^=", "<<=", ">>=")))
        self.constant_set = re.compile(f"(?<=[{re.escape(ops)}])[{s('ID')}{s('N')}{s('NUM')}{s('STR')}](?=[{re.escape(gets)}])")
        self.named = re.compile(f"(?<=[(,])[{re.escape(kw)}](?={re.escape(s(':'))}(?!{re.escape(s(':'))}))")

    def classify(self, t: str) -> str:
        c, s = t[0], self.g.symbol
        if t.startswith("/*") or t.startswith("//") or (c == "#" and t != "#["):
            return self.err if t == "/*" else ""
        if t == "#[":
            return s("ATTR") + "["
        if t.startswith("?>"):
            return ";" + s("H") if t[2:].strip() else ";"
        if t.startswith("<<<"):
            return s("STR") if t[3:].lstrip()[:1] == "'" or self.filled(t) else self.err
        if c == "$" and len(t) > 1:
            return s("V")
        low = t.lower()
        if c.isalpha() or c in "_\\" or ord(c) > 127:
            low = self.ALIAS.get(low, low)
            if low in self.fixed:
                return self.fixed[low]
            if "\\" in t:
                return self.err if t == "\\" else s("NB") if t.endswith("\\") else s("N")
            return s("ID") if t.isidentifier() else self.err
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return s("NUM") if re.fullmatch(r"0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]*|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?", t) else self.err
        if c in "\"'`":
            return s("STR") if len(t) > 1 and (c == "'" or self.filled(t)) else self.err
        if c == "(" and len(t) > 1:
            return s("CAST")
        if t in "()[]{};":
            return t
        return s(t) if t in self.g.symbols else self.err

    def filled(self, t: str) -> bool:
        """Whether the expressions in braces of an interpolated string are valid."""
        i = t.find("{$")
        while i >= 0:
            end = _closing(t, i + 1)
            back = len(t[:i]) - len(t[:i].rstrip("\\"))
            if back % 2 == 0:
                if end < 0 or parse(self.g, self.symbols("<?php (" + t[i + 1 : end] + ");")[0]) is not None:
                    return False
                i = end
            i = t.find("{$", i + 1)
        return True

    def symbols(self, text: str) -> tuple[str, list[int]]:
        m = re.search(r"<\?(?:php\b|=)", text, re.I)
        if not m:
            return self.g.symbol("H"), []
        head = self.g.symbol("H") if text[: m.start()].strip("﻿ \n\r\t") else ""
        body = text[m.end() :]
        halt = re.search(r"\b__halt_compiler\s*\(\s*\)\s*;", body)
        body = body[: halt.start()] if halt else body
        kind = self.kind
        k = "".join([kind(t[0]) for t in self.scan.finditer(body)])
        word = self.g.symbol("ID")
        return self.constant_set.sub(self.err, head + self.named.sub(word, self.called.sub(word, self.member.sub(word, k)))), []

    def soft(self) -> str:
        return ""


class PyLexer(Lexer):
    WORDS = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False match case type"

    def __init__(self):
        g = Grammar((FOLDER / "py.txt").read_text())
        strings = r"(?:[rRbBuUfFtT]{0,3})(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"\"\"|'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
        super().__init__(g, rf"\n[ \t\f]*(?:#[^\n]*)?|\\\n|#[^\n]*|{strings}|[A-Za-z_\u0080-\U0010ffff]\w*|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?)\w*|\.\.\.|:=|->|\*\*=|//=|<<=|>>=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|<<|>>|\*\*|//|\S", self.WORDS)
        self.nl = g.symbol("NL")

    def classify(self, t: str) -> str:
        c, s = t[0], self.g.symbol
        if c == "#" or t == "\\\n":
            return ""
        if t in self.fixed:
            return self.fixed[t]
        if t[-1] in "\"'":
            bare = t.lstrip("rRbBuUfFtT")
            if len(t) == 1 or bare in ('"""', "'''"):
                return self.err
            kind = t[: len(t) - len(bare)].lower()
            marks = 3 if bare[:3] in ('"""', "'''") and len(bare) > 5 else 1
            return s("STR") if not set(kind) & set("ft") or self.filled(bare[marks:-marks], "r" in kind) else self.err
        if c.isalpha() or c == "_" or ord(c) > 127:
            return s("ID") if t.isidentifier() else self.err
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return s("NUM") if re.fullmatch(r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*)|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]", t) else self.err
        if t in "()[]{};":
            return t
        return s(t) if t in self.g.symbols else self.err

    def filled(self, t: str, raw: bool = False, spec: bool = False) -> bool:
        """Whether the replacement fields of a formatted string, and those in their format specifications, are valid."""
        t = t if raw else re.sub(r"\\N\{[^}]*\}", "", t)
        i = 0
        while i < len(t):
            c = t[i]
            if c in "{}" and t[i + 1 : i + 2] == c and not spec:
                i += 2
            elif c == "}":
                return False
            elif c == "{":
                end = _closing(t, i + 1)
                if end < 0 or not self.field(t[i + 1 : end], raw):
                    return False
                i = end + 1
            else:
                i += 1
        return True

    def field(self, t: str, raw: bool) -> bool:
        """``expression [=] [!conversion] [:specification]``."""
        depth = i = 0
        while i < len(t):
            c = t[i]
            quoted = _QUOTED.match(t, i) if c in "\"'" else None
            if quoted:
                i = quoted.end()
                continue
            depth += (c in "([{") - (c in ")]}")
            if not depth and (c == ":" or c == "!" and t[i + 1 : i + 2] != "="):
                break
            i += 1
        own, rest = t[:i].rstrip(), t[i:]
        own = own[:-1] if own.endswith("=") and own[-2:-1] not in ("=", "!", "<", ">") else own
        tail = re.match(r"(?:!\s*[a-zA-Z_]\w*\s*)?(?::(.*))?\Z", rest, re.S)
        if not own.strip() or not tail or not self.filled(tail[1] or "", raw, True):
            return False
        return parse(self.g, self.symbols("(" + own + "\n)\n")[0]) is None

    def symbols(self, text: str) -> tuple[str, list[int]]:
        out: list[str] = []
        depth, levels, fresh = 0, [0], True
        kind, nl = self.kind, self.nl
        for t in self.scan.findall("\n" + text):
            if t[0] == "\n":
                if depth:
                    continue
                if not fresh:
                    out.append(nl)
                    fresh = True
                width = len(t[1:].split("#")[0].expandtabs(8)) if "#" not in t else -1
                continue
            k = kind(t)
            if not k:
                continue
            if fresh:
                fresh = False
                if width < 0:
                    width = 0
                if width > levels[-1]:
                    levels.append(width)
                    out.append("\x02")
                else:
                    while width < levels[-1]:
                        levels.pop()
                        out.append("\x03")
                    if width != levels[-1]:
                        out.append(self.err)
            if k in "([{":
                depth += 1
            elif k in ")]}" and depth:
                depth -= 1
            out.append(k)
        if not fresh:
            out.append(nl)
        return "".join(out) + "\x03" * (len(levels) - 1), []

    def soft(self) -> str:
        return ""


_MAKE: dict[str, Callable[[], Lexer]] = {"go": GoLexer, "php": PhpLexer, "py": PyLexer, "ts": lambda: JsLexer("TS"), "js": lambda: JsLexer("JS")}


@lru_cache(maxsize=None)
def lexer(language: str) -> Lexer:
    return _MAKE[language]()


def language_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def check(language: str, text: str) -> bool:
    """Whether the text is a valid file of the language."""
    text = (text[1:] if text.startswith("﻿") else text).replace("\r\n", "\n").replace("\r", "\n")
    lx = lexer(language)
    if language != "php" and "\x01" in text:
        return False
    if language in ("js", "ts") and text.startswith("#!"):
        text = text[text.find("\n") :] if "\n" in text else ""
    return parse(lx.g, lx.symbols(text)[0], lx.soft()) is None


def error_line(language: str, text: str) -> int:
    """Line of the first unrecoverable error of an invalid file: the end of its longest valid beginning.

    The beginning is extended statement by statement along the token stream, so the line is
    that of the statement in which parsing breaks down.
    """
    text = (text[1:] if text.startswith("﻿") else text).replace("\r\n", "\n").replace("\r", "\n")
    lx = lexer(language)
    lines = text.split("\n")
    total = lx.symbols(text)[0]
    at = parse(lx.g, total, lx.soft()) or 0
    lengths = list(range(1, len(lines) + 1))
    return min(len(lines), bisect.bisect_left(lengths, at + 1, key=lambda n: len(lx.symbols("\n".join(lines[:n]))[0].rstrip("\x03"))) + 1)


def confirmed(language: str, text: str) -> bool:
    """Exact check behind the parser where the running interpreter is the language itself."""
    if language != "py":
        return True
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(text[1:] if text.startswith("﻿") else text, "file", "exec", dont_inherit=True)
        except (SyntaxError, ValueError):
            return True
        except (RecursionError, MemoryError):
            return False
    return False


def _check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if not len(f):
            continue
        valid, line = [], []
        for path, text in zip(f["path"], f["content"]):
            lang = language_of(path)
            text = text or ""
            bad = lang is not None and not check(lang, text) and confirmed(lang, text)
            valid.append(not bad)
            line.append(error_line(lang, text) if bad else None)
        yield pd.DataFrame({"path": f["path"], "repo": f["repo"], "language": [NAMES.get(language_of(p) or "") for p in f["path"]], "valid": valid, "error_line": pd.array(line, dtype="Int32")})


def checked_files(source_files: DataFrame) -> DataFrame:
    """(path, repo, language, valid, error_line) of the current content of every file.

    Files of other extensions are valid by definition and have a null language; null content
    counts as an empty file, which every language accepts. Null paths are left out. Text
    outside ``<?php`` is valid PHP.
    """
    cur = current_wide(source_files, "path", ["repo", "content"])
    return cur.select("path", "repo", "content").mapInPandas(_check, "path string, repo string, language string, valid boolean, error_line int")


def rates(checked: DataFrame, index_results: DataFrame) -> DataFrame:
    """Per repo and language: files, invalid ones, their rate, and how many of each the index runs report."""
    said = index_results.select(F.explode("errors").alias("e")).select(norm_path("e.file").alias("path")).where("path is not null").distinct().withColumn("said", F.lit(True))
    j = checked.where("language is not null").join(said, "path", "left").withColumn("said", F.coalesce("said", F.lit(False)))
    bad = ~F.col("valid")
    return j.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(bad).alias("n_invalid"), F.count_if("said").alias("n_reported"), F.count_if(bad & F.col("said")).alias("n_invalid_reported")
    ).withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
