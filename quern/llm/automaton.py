"""Regular expressions to one minimal deterministic automaton over bytes, and its vectorised scan.

The dialect: literals, escapes (\\d \\w \\s \\t \\n \\r and escaped signs), classes with ranges and ^, '.',
groups, |, ?, *, +, {m}, {m,}, {m,n}. Everything is over bytes; matching is longest, without anchors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_D = frozenset(b"0123456789")
_W = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_S = frozenset(b" \t\n\r\f\v")
_ALL = frozenset(range(256))
_ESCAPES = {"d": _D, "w": _W, "s": _S, "D": _ALL - _D, "W": _ALL - _W, "S": _ALL - _S, "t": frozenset(b"\t"), "n": frozenset(b"\n"), "r": frozenset(b"\r")}
SEPARATOR = 255  # never occurs in UTF-8; ends every match


class _Parser:
    """Syntax trees: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most or None)."""

    def __init__(self, pattern: str, fold_case: bool):
        self.p, self.i, self.fold = pattern, 0, fold_case

    def parse(self):
        tree = self.choice()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("cat", parts)

    def repeat(self):
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                end = self.p.index("}", self.i)
                a, comma, b = self.p[self.i : end].partition(",")
                least, most, self.i = int(a), (int(b) if b else None) if comma else int(a), end + 1
            tree = ("rep", tree, least, most)
        return tree

    def one(self, chars: frozenset):
        if self.fold:
            chars = chars | {x ^ 32 for x in chars if chr(x).isalpha() and x < 128}
        return ("set", frozenset(chars) - {SEPARATOR})

    def atom(self):
        c = self.peek()
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            tree = self.choice()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            return tree
        if c == "[":
            return self.one(self.klass())
        if c == ".":
            return self.one(_ALL - {10})
        if c == "\\":
            e = self.peek()
            self.i += 1
            if e in _ESCAPES:
                return self.one(_ESCAPES[e])
            if e.isalnum():
                raise ValueError(f"unknown escape \\{e}")
            c = e
        elif c in "^$*+?{)":
            raise ValueError(f"unsupported {c!r} in {self.p!r}")
        return ("cat", [self.one(frozenset({b})) for b in c.encode()])

    def klass(self) -> frozenset:
        out: set[int] = set()
        negated = self.peek() == "^"
        self.i += negated
        begin = self.i
        while (c := self.peek()) != "]" or self.i == begin:
            self.i += 1
            if c == "\\":
                e = self.peek()
                self.i += 1
                if e in _ESCAPES:
                    out |= _ESCAPES[e]
                    continue
                c = e
            if not c or ord(c) > 127:
                raise ValueError(f"bad class in {self.p!r}")
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                high = self.p[self.i + 1]
                self.i += 2
                out |= set(range(ord(c), ord(high) + 1))
            else:
                out.add(ord(c))
        self.i += 1
        return frozenset(_ALL - out if negated else out)


def _reverse(tree):
    if tree[0] == "cat":
        return ("cat", [_reverse(t) for t in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [_reverse(t) for t in tree[1]])
    if tree[0] == "rep":
        return ("rep", _reverse(tree[1]), *tree[2:])
    return tree


def closed(tree):
    """(the tree with the open run of a set that it ends in at its least length, that set or None)."""
    if tree[0] == "rep" and tree[1][0] == "set" and tree[3] is None:
        return ("rep", tree[1], tree[2], tree[2]), tree[1][1]
    if tree[0] == "rep" and tree[3] is None and tree[1][0] == "cat" and len(tree[1][1]) == 1 and tree[1][1][0][0] == "set":
        return ("rep", tree[1][1][0], tree[2], tree[2]), tree[1][1][0][1]
    if tree[0] == "cat" and tree[1]:
        last, run = closed(tree[1][-1])
        return ("cat", [*tree[1][:-1], last]), run
    return tree, None


@dataclass
class _Nfa:
    empty: list[list[int]] = field(default_factory=list)
    step: list[tuple[frozenset, int] | None] = field(default_factory=list)
    run: dict[int, tuple[int, int]] = field(default_factory=dict)  # state -> (open-ended repeat of one set, how far in it)
    runs: int = 0

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, tree, begin: int) -> int:
        """Adds the tree after `begin`; its last state."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            if self.step[begin] is not None:
                middle = self.state()
                self.empty[begin].append(middle)
                begin = middle
            self.step[begin] = (tree[1], end)
            return end
        if kind == "cat":
            for t in tree[1]:
                begin = self.add(t, begin)
            return begin
        end = self.state()
        if kind == "or":
            for t in tree[1]:
                s = self.state()
                self.empty[begin].append(s)
                self.empty[self.add(t, s)].append(end)
            return end
        _, part, least, most = tree
        own, self.runs = self.runs, self.runs + 1
        for i in range(least):
            begin = self.add(part, begin)
            if most is None and part[0] == "set":
                self.run[begin] = own, i
        if most is None:
            loop = self.state()
            self.empty[begin].append(loop)
            s = self.state()
            if part[0] == "set":
                self.run[s] = own, least
            self.empty[loop] += [s, end]
            self.empty[self.add(part, s)].append(loop)
            return end
        for _ in range(most - least):
            self.empty[begin].append(end)
            s = self.state()
            self.empty[begin].append(s)
            begin = self.add(part, s)
        self.empty[begin].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    """table: next state times `width`, flat, by state * width + class; states from `first_accepting` accept;
    rules: per state a bit mask of the rules it accepts; dead: the state that nothing leaves, or -1."""

    table: np.ndarray
    classes: np.ndarray
    rules: np.ndarray
    first_accepting: int
    start: int
    dead: int

    @property
    def width(self) -> int:
        return int(self.classes.max()) + 1


def compile_dfa(trees: list, search: bool, left: list[bool] | None = None) -> Dfa:
    """Subset construction over all trees at once, then minimisation. search: a match may begin anywhere,
    for the trees with `left` only where no letter, digit or _ is before."""
    nfa = _Nfa()
    begin, inner = nfa.state(), nfa.state()
    finals = {}
    for k, tree in enumerate(trees):
        s = nfa.state()
        nfa.empty[begin].append(s)
        if not (left and left[k]):
            nfa.empty[inner].append(s)
        finals[nfa.add(tree, s)] = k
    closure = []
    for s in range(len(nfa.empty)):
        seen, todo = {s}, [s]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        closure.append(frozenset(t for t in seen if nfa.step[t] is not None or t in finals))
    sets = sorted({frozenset(x[0]) for x in nfa.step if x}, key=sorted)
    marks = np.zeros((256, len(sets) + 2), bool)
    marks[list(_W), -2] = True
    for i, x in enumerate(sets):
        marks[list(x), i] = True
    marks[SEPARATOR, -1] = True
    _, first, classes = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    classes = classes.reshape(-1)
    members = {x: [k for k, b in enumerate(first) if int(b) in x] for x in sets}
    separator = int(classes[SEPARATOR])
    width = len(first)
    initial = closure[begin]
    extra = [closure[inner] if int(b) in _W else initial for b in first] if search else [frozenset()] * width

    def lean(states: set) -> frozenset:
        """Without states that another one makes needless: further on in {m,} of one set accepts all that less far does."""
        most: dict[int, int] = {}
        for s in states:
            if s in nfa.run:
                r, i = nfa.run[s]
                most[r] = max(i, most.get(r, -1))
        return frozenset(s for s in states if s not in nfa.run or most[nfa.run[s][0]] == nfa.run[s][1]) if most else frozenset(states)

    index, order, rows = {initial: 0}, [initial], []
    for state in order:
        to: list[set] = [set() for _ in range(width)]
        for s in state:
            if nfa.step[s]:
                reach = closure[nfa.step[s][1]]
                for k in members[nfa.step[s][0]]:
                    to[k] |= reach
        row = []
        for k in range(width):
            t = initial if search and k == separator else lean(to[k] | extra[k])
            if t not in index:
                index[t] = len(order)
                order.append(t)
            row.append(index[t])
        rows.append(row)
    table = np.array(rows)
    accepts = np.array([sum(1 << finals[s] for s in state if s in finals) for state in order], np.int64)
    return _minimal(table, accepts, classes)


def _minimal(table: np.ndarray, accepts: np.ndarray, classes: np.ndarray) -> Dfa:
    """Partition refinement: states stay together while they accept the same and lead to the same parts."""
    _, part = np.unique(accepts, return_inverse=True)
    weights = np.random.default_rng(1).integers(1, 1 << 62, (2, table.shape[1] + 1), np.int64)
    while True:
        rows = np.concatenate([part[:, None], part[table]], axis=1)
        keys = np.stack([(rows * w).sum(axis=1) for w in weights], axis=1)
        _, new = np.unique(keys, axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == part.max():
            break
        part = new
    n = int(part.max()) + 1
    some = np.zeros(n, np.int64)
    some[part[::-1]] = np.arange(len(part))[::-1]
    masks, small = accepts[some], part[table[some]]
    rank = np.argsort(masks != 0, kind="stable")
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    small, masks = place[small[rank]], masks[rank]
    dead = [s for s in range(n) if masks[s] == 0 and (small[s] == s).all()]
    width = table.shape[1]
    return Dfa((small * width).astype(np.int32).ravel(), classes.astype(np.uint8), masks, int((masks == 0).sum()), int(place[part[0]]), dead[0] if dead else -1)


def scan(dfa: Dfa, data: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(positions, states) where the search automaton accepts after that byte. The bytes are cut into
    equal lanes that advance together; lanes that began in the wrong state run again until all agree."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = max(1, min(lanes, n // 64))
    length = -(-n // wide)
    padded = np.full(wide * length, SEPARATOR, np.uint8)
    padded[:n] = data
    columns = np.ascontiguousarray(dfa.classes[padded].reshape(wide, length).T)
    start, accept = dfa.start * dfa.width, dfa.first_accepting * dfa.width
    begun, ended = np.full(wide, start, np.int32), np.zeros(wide, np.int32)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    todo = np.arange(wide)
    while len(todo):
        if hits:
            hits = [(p[k], s[k]) for p, s in hits for k in [~np.isin(p // length, todo)]]
        if len(todo) <= 8 and wide > 8:  # a run that keeps its state over lanes is followed through them one by one
            _follow(dfa, columns, begun, ended, todo.tolist(), hits)
            break
        state = begun[todo].copy()
        at = np.empty(len(todo), np.int32)
        part = columns if len(todo) == wide else np.ascontiguousarray(columns[:, todo])
        for j in range(length):
            np.add(state, part[j], out=at)
            np.take(dfa.table, at, out=state, mode="clip")
            if state.max() >= accept:
                k = np.flatnonzero(state >= accept)
                hits.append((todo[k] * length + j, state[k].astype(np.int64) // dfa.width))
        ended[todo] = state
        want = np.concatenate([[start], ended[:-1]]).astype(np.int32)
        todo = np.flatnonzero(want != begun)
        begun = want
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, s = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
    order = np.argsort(p)
    return p[order], s[order]


def _follow(dfa: Dfa, columns: np.ndarray, begun: np.ndarray, ended: np.ndarray, todo: list[int], hits: list) -> None:
    """Lanes that began in the wrong state, in order, each with those behind it for as long as what it ends in is new."""
    length, wide = columns.shape
    table, accept, width = dfa.table, dfa.first_accepting * dfa.width, dfa.width
    table = table.tolist() if length * len(todo) > 1 << 12 else table
    waiting = sorted(todo, reverse=True)
    while waiting:
        lane = waiting.pop()
        old = [(p[k], s[k]) for p, s in hits for k in [p // length != lane]]
        hits[:] = old
        state, at, into = int(begun[lane]), [], []
        for j, c in enumerate(columns[:, lane].tolist()):
            state = int(table[state + c])
            if state >= accept:
                at.append(lane * length + j)
                into.append(state // width)
        if at:
            hits.append((np.array(at), np.array(into, np.int64)))
        ended[lane] = state
        if lane + 1 < wide and begun[lane + 1] != state:
            begun[lane + 1] = state
            if not waiting or waiting[-1] != lane + 1:
                waiting.append(lane + 1)


def begins(dfa: Dfa, data: bytes, end: int, low: int = 0) -> list[int]:
    """All starts of matches that end before `end`, nearest first, by an automaton of the reversed rule."""
    out, state, width = [], dfa.start, dfa.width
    for i in range(end - 1, low - 1, -1):
        state = int(dfa.table[state * width + int(dfa.classes[data[i]])]) // width
        if state == dfa.dead:
            break
        if dfa.rules[state]:
            out.append(i)
    return out


def parse(pattern: str, fold_case: bool = False):
    return _Parser(pattern, fold_case).parse()


def reverse(tree):
    return _reverse(tree)
