"""Generalised LL recognition with a graph-structured stack.

A grammar is EBNF text, one rule `name: alternatives` a line; further lines of a rule are indented. Quoted words and words in capitals are
kinds of tokens, other words are rules; `( ) * + ? |` are as usual. An alternative that begins with `<d>` belongs to dialect d only.
Rules are compiled to instructions of a small nondeterministic machine. A recogniser keeps descriptors
(instruction, stack node, position), each taken up once; stack nodes are shared by rule and position, so that the stack is a graph, left
recursion and ambiguity are no trouble, and the work is at most cubic. Branches are pruned by one kind of lookahead.

All dialects run together: a rule that no dialect's own alternative can change is compiled once and shared, and one run
tells which of the dialects accept. A rule without an alternative for a dialect matches nothing there.

Two things save work on whole files without deciding anything. A call whose rule, by the next two kinds, can only match one token moves on at once;
that is found by running the rule on the two kinds, and kept. And rules may be declared to be kept: where such a rule begins
at a place whose extent is known (a bracket with its partner, a statement with its end), it can't go beyond, so that the places where it
can end depend on these tokens alone, and are the same in every file.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

_TERM, _CALL, _SPLIT, _JUMP, _RETURN = range(5)
_WORD = re.compile(r"\s*(?:(<[\w.+-]+>)|'([^']+)'|([A-Za-z_]\w*)|([()*+?|]))")
END = "\x00"


class Kinds:
    """One character for each kind of token."""

    def __init__(self) -> None:
        self.of: dict[str, str] = {}

    def __getitem__(self, name: str) -> str:
        if name not in self.of:
            self.of[name] = chr(0xE000 + len(self.of))
        return self.of[name]


class Grammar:
    def __init__(self, text: str, dialects: tuple[str, ...], kinds: Kinds, sets: dict[str, tuple[str, ...]] | None = None, kept: dict[str, int] | None = None, memory: int = 48 << 20) -> None:
        """sets: names in capitals for several kinds. kept: rules whose results are kept, with the number of the extents they go by. memory: bytes of
        results that are kept, about; beyond it all are forgotten."""
        self.kinds, self.dialects = kinds, dialects
        self.sets = {k: frozenset(kinds[x] for x in v) for k, v in (sets or {}).items()}
        self.rules: dict[str, list] = {}
        name = ""
        for line in text.splitlines():
            if m := re.match(r"(\w+):(.*)", line):
                name = m[1]
                self.rules[name] = []
                line = m[2]
            if line.strip():
                self.rules[name].append(line)
        self.trees = {n: self._alternatives(_tokens("\n".join(x))) for n, x in self.rules.items()}
        own = {n for n, t in self.trees.items() if _has_dialect(t)}
        uses = {n: _names(t) for n, t in self.trees.items()}
        while more := {n for n, u in uses.items() if n not in own and u & own}:
            own |= more
        self.own, self.kept = own, kept or {}
        self.memory, self.used, self.known = memory, 0, {}
        self.code: list[tuple] = []
        self.entry: dict[str, int] = {}
        for n in self.trees:
            for d in dialects if n in own else ("",):
                self._compile_rule(n, d)
        self._link()

    # -- reading

    def _alternatives(self, tokens: list) -> tuple:
        out = [self._sequence(tokens)]
        while tokens and tokens[0] == ("op", "|"):
            tokens.pop(0)
            out.append(self._sequence(tokens))
        return ("alt", out)

    def _sequence(self, tokens: list) -> tuple:
        out: list = []
        dialect = tokens.pop(0)[1] if tokens and tokens[0][0] == "dialect" else ""
        while tokens and tokens[0] not in (("op", "|"), ("op", ")")):
            kind, x = tokens.pop(0)
            if (kind, x) == ("op", "("):
                item = self._alternatives(tokens)
                tokens.pop(0)
            elif kind == "op":
                item = ("many" if x == "*" else "some" if x == "+" else "maybe", out.pop())
            elif kind == "kind" or x.isupper():
                item = ("term", self.sets.get(x) or frozenset((self.kinds[x],)))
            else:
                item = ("rule", x)
            out.append(item)
        return ("seq", out, dialect)

    # -- compiling

    def _key(self, rule: str, dialect: str) -> str:
        return f"{rule}@{dialect}" if rule in self.own else rule

    def _compile_rule(self, rule: str, dialect: str) -> None:
        key = self._key(rule, dialect)
        self.entry[key] = len(self.code)
        self._emit(self.trees[rule], dialect)
        self.code.append((_RETURN, key))

    def _emit(self, tree: tuple, d: str) -> None:
        kind = tree[0]
        if kind == "term":
            self.code.append((_TERM, tree[1]))
        elif kind == "rule":
            if tree[1] not in self.trees:
                raise ValueError(f"no rule {tree[1]}")
            self.code.append((_CALL, self._key(tree[1], d)))
        elif kind == "seq":
            for x in tree[1]:
                self._emit(x, d)
        elif kind == "alt":
            choices = [x for x in tree[1] if x[2] in ("", d)]
            if not choices:
                self.code.append((_TERM, frozenset()))
                return None
            if len(choices) == 1:
                return self._emit(choices[0], d)
            at = len(self.code)
            self.code.append(())
            starts, ends = [], []
            for x in choices:
                starts.append(len(self.code))
                self._emit(x, d)
                ends.append(len(self.code))
                self.code.append(())
            self.code[at] = (_SPLIT, starts)
            for e in ends:
                self.code[e] = (_JUMP, len(self.code))
        else:
            at = len(self.code)
            if kind == "some":
                self._emit(tree[1], d)
                self.code.append((_SPLIT, [at, len(self.code) + 1]))
            else:
                self.code.append(())
                self._emit(tree[1], d)
                if kind == "many":
                    self.code.append((_JUMP, at))
                self.code[at] = (_SPLIT, [at + 1, len(self.code)])

    def _link(self) -> None:
        """Lookahead sets by iteration; then a table from kind to targets for each branch and call."""
        self.single: dict[int, dict[str, bool]] = {}
        n = len(self.code)
        ahead: list[set] = [set() for _ in range(n)]
        follow = {k: {END} for k in self.entry}
        moved = True
        while moved:
            moved = False
            for ip in range(n - 1, -1, -1):
                op, x = self.code[ip]
                if op == _TERM:
                    new = x
                elif op == _CALL:
                    new = ahead[self.entry[x]]
                    if not ahead[ip + 1] <= follow[x]:
                        follow[x] |= ahead[ip + 1]
                        moved = True
                elif op == _SPLIT:
                    new = set().union(*(ahead[t] for t in x))
                elif op == _JUMP:
                    new = ahead[x]
                else:
                    new = follow[x]
                if not new <= ahead[ip]:
                    ahead[ip] |= new
                    moved = True
        for ip, (op, x) in enumerate(self.code):
            if op == _SPLIT:
                table: dict[str, list] = {}
                for t in x:
                    for c in ahead[t]:
                        table.setdefault(c, []).append(t)
                self.code[ip] = (_SPLIT, table)
            elif op == _CALL:
                self.code[ip] = (_CALL, (self.entry[x], frozenset(ahead[self.entry[x]]), self.kept.get(x.split("@")[0], -1), self.single.setdefault(self.entry[x], {})))

    # -- recognising

    def accepts(self, rule: str, tokens: str, *extents: Sequence[int]) -> frozenset[str]:
        """The dialects under which all of `tokens`, a string of kinds, derives from the rule. Each of `extents` gives for a place the end of what
        begins there, or 0."""
        if self.used > self.memory:
            self.known.clear()
            self.used = 0
        entries = {self.entry[self._key(rule, d)]: (d if rule in self.own else "") for d in self.dialects}
        found = self._run(entries, tokens + END, extents, 0, 0)
        out = {entries[e] for e, ends in found.items() if len(tokens) in ends}
        return frozenset(self.dialects) if "" in out else frozenset(out)

    def _kept_ends(self, entry: int, tokens: str, extents: tuple, base: int, depth: int) -> tuple[int, ...]:
        """Where the rule at `entry` can end, from the beginning of `tokens`."""
        key = (entry, tokens)
        ends = self.known.get(key)
        if ends is None:
            ends = tuple(self._run({entry: ""}, tokens + END, extents, base, depth)[entry])
            self.known[key] = ends
            self.used += 250 + 2 * len(tokens)
        return ends

    def _is_single(self, entry: int, pair: str, single: dict[str, bool]) -> bool:
        """Whether the rule, before these two kinds, matches the first of them and can match no more."""
        found = self._run({entry: ""}, pair if pair[1] == END else pair + END, (), 0, 0, probe=True)
        single[pair] = out = found is not None and found[entry] == [1]
        return out

    def _run(self, entries: dict[int, str], s: str, extents: tuple, base: int, depth: int, probe: bool = False) -> dict[int, list[int]] | None:
        """The places where each of the rules at `entries` can end, for an input that begins at place `base` of the extents; None if, for
        a `probe`, a second token can be taken."""
        code = self.code
        # a node: [edges, positions where it returned]; an edge: (instruction, node)
        nodes: dict[tuple[int, int], tuple[list, list]] = {}
        todo: list[tuple[int, tuple, int]] = []
        seen: set[tuple[int, int, int]] = set()
        for entry in entries:
            node = nodes[entry, 0] = ([], [])
            todo.append((entry, node, 0))
        while todo:
            ip, node, at = todo.pop()
            while True:
                op, x = code[ip]
                if op == _TERM:
                    if s[at] not in x:
                        break
                    if probe and at:
                        return None
                    at += 1
                    ip += 1
                elif op == _SPLIT:
                    targets = x.get(s[at])
                    if targets is None:
                        break
                    for t in targets[1:]:
                        key = (t, id(node), at)
                        if key not in seen:
                            seen.add(key)
                            todo.append((t, node, at))
                    ip = targets[0]
                    if len(targets) > 1:
                        key = (ip, id(node), at)
                        if key in seen:
                            break
                        seen.add(key)
                elif op == _JUMP:
                    ip = x
                elif op == _CALL:
                    entry, first, kept, single = x
                    if s[at] not in first:
                        break
                    ip += 1
                    if not probe:
                        pair = s[at : at + 2]
                        one = single.get(pair)
                        if one is None and len(pair) == 2:
                            one = self._is_single(entry, pair, single)
                        if one:
                            at += 1
                            continue
                    below = nodes.get((entry, at))
                    if below is None:
                        if kept >= 0 and extents and depth < _DEEPEST and 1 < (size := extents[kept][base + at] - base - at) <= _LONGEST and (at or depth == 0 or entry not in entries):
                            ends = [at + k for k in self._kept_ends(entry, s[at : at + size], extents, base + at, depth + 1)]
                            nodes[entry, at] = ([], ends)
                            if not ends:
                                break
                            todo += [(ip, node, p) for p in ends[1:]]
                            at = ends[0]
                            continue
                        below = nodes[entry, at] = ([(ip, node)], [])
                        ip, node = entry, below
                        continue
                    edges = below[0]
                    if any(a == ip and b is node for a, b in edges):
                        break
                    edges.append((ip, node))
                    for p in below[1]:
                        key = (ip, id(node), p)
                        if key not in seen:
                            seen.add(key)
                            todo.append((ip, node, p))
                    break
                else:
                    ends = node[1]
                    if at in ends:
                        break
                    ends.append(at)
                    edges = node[0]
                    for a, b in edges[1:]:
                        key = (a, id(b), at)
                        if key not in seen:
                            seen.add(key)
                            todo.append((a, b, at))
                    if not edges:
                        break
                    ip, node = edges[0]
                    key = (ip, id(node), at)
                    if key in seen:
                        break
                    seen.add(key)
        return {entry: nodes[entry, 0][1] for entry in entries}


#: Kinds of a kept stretch at most, and how deep kept stretches lie in one another; others are read where they stand.
_LONGEST, _DEEPEST = 2048, 60


def brackets(tokens: str, pairs: dict[str, str]) -> list[int]:
    """For each opening bracket that has a partner the place behind it; 0 elsewhere, and everywhere behind the first wrong one."""
    out, stack = [0] * (len(tokens) + 1), []
    closing = set(pairs.values())
    for k, c in enumerate(tokens):
        if c in pairs:
            stack.append((pairs[c], k))
        elif c in closing:
            if not stack or stack[-1][0] != c:
                break
            out[stack.pop()[1]] = k + 1
    return out


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _WORD.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at:at + 20]!r}")
        out.append(("dialect", m[1][1:-1]) if m[1] else ("kind", m[2]) if m[2] else ("name", m[3]) if m[3] else ("op", m[4]))
        at = m.end()
    return out


def _has_dialect(tree: tuple) -> bool:
    if tree[0] == "seq":
        return bool(tree[2]) or any(map(_has_dialect, tree[1]))
    if tree[0] == "alt":
        return any(map(_has_dialect, tree[1]))
    return tree[0] in ("many", "some", "maybe") and _has_dialect(tree[1])


def _names(tree: tuple) -> set[str]:
    if tree[0] == "rule":
        return {tree[1]}
    if tree[0] in ("seq", "alt"):
        return set().union(*map(_names, tree[1])) if tree[1] else set()
    return _names(tree[1]) if tree[0] in ("many", "some", "maybe") else set()
