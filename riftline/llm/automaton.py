"""Regular expressions over bytes as minimal deterministic automata with flat transition arrays.

Supported: literals, escapes (\\xHH and escaped punctuation), classes, groups, alternation, ? * + {n} {n,} {n,m}.
An expression becomes a nondeterministic automaton, subset construction makes it deterministic and partition
refinement minimises it.  Bytes that no expression tells apart share a column of the transition array.
"""

from __future__ import annotations

from dataclasses import dataclass, field

Node = tuple


def parse(pattern: str, fold: bool = False) -> Node:
    """Syntax tree of a pattern: ("set", bytes), ("cat", a, b), ("alt", a, b), ("rep", a, least, most), ("empty",)."""
    at = 0

    def chars(values: set[int]) -> Node:
        if fold:
            values = values | {v ^ 32 for v in values if chr(v).isalpha()}
        return ("set", frozenset(values))

    def escaped() -> int:
        nonlocal at
        at += 1
        c = pattern[at]
        if c == "x":
            at += 3
            return int(pattern[at - 2 : at], 16)
        at += 1
        return ord(c)

    def one() -> int:
        nonlocal at
        if pattern[at] == "\\":
            return escaped()
        at += 1
        return ord(pattern[at - 1])

    def bracket() -> Node:
        nonlocal at
        at += 1
        if negated := pattern[at] == "^":
            at += 1
        values: set[int] = set()
        while pattern[at] != "]":
            low = one()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                values |= set(range(low, one() + 1))
            else:
                values.add(low)
        at += 1
        return ("set", frozenset(range(256)) - frozenset(values)) if negated else chars(values)

    def atom() -> Node:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = alternatives()
            at += 1
            return inner
        if pattern[at] == "[":
            return bracket()
        return chars({one()})

    def repeated() -> Node:
        nonlocal at
        node = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                at = end + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def sequence() -> Node:
        node: Node = ("empty",)
        while at < len(pattern) and pattern[at] not in "|)":
            node = ("cat", node, repeated())
        return node

    def alternatives() -> Node:
        nonlocal at
        node = sequence()
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            node = ("alt", node, sequence())
        return node

    return alternatives()


def mirrored(node: Node) -> Node:
    """The tree that matches the same strings read backwards."""
    kind = node[0]
    if kind == "cat":
        return ("cat", mirrored(node[2]), mirrored(node[1]))
    if kind == "alt":
        return ("alt", mirrored(node[1]), mirrored(node[2]))
    return ("rep", mirrored(node[1]), *node[2:]) if kind == "rep" else node


@dataclass
class Graph:
    """Nondeterministic automaton: moves on byte sets and moves on nothing."""

    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, node: Node, start: int) -> int:
        """Adds the tree from ``start`` on; returns where it ends."""
        kind = node[0]
        if kind == "empty":
            return start
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            return self.build(node[2], self.build(node[1], start))
        if kind == "alt":
            end = self.state()
            for branch in node[1:]:
                entry = self.state()
                self.free[start].append(entry)
                self.free[self.build(branch, entry)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            start = self.build(inner, start)
        end = self.state()
        self.free[start].append(end)
        if most is None:
            entry = self.state()
            self.free[start].append(entry)
            self.free[self.build(inner, entry)] += [entry, end]
        else:
            for _ in range(most - least):
                start = self.build(inner, start)
                self.free[start].append(end)
        return end

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass
class Automaton:
    """Minimal deterministic automaton.

    classes: 256 bytes, the column of each byte.  table: next state times width, by state times width plus column.
    Accepting states are numbered last, from ``accepting`` on (times width); labels[state] says what they accept.
    """

    classes: bytes
    width: int
    table: list[int]
    start: int
    accepting: int
    dead: int
    labels: list[frozenset[int]]


def compile_rules(trees: list[Node], search: bool) -> Automaton:
    """One automaton for all trees; search lets a match begin anywhere, else it begins at the first byte."""
    g, accepts = Graph(), {}
    start = g.state()
    for k, tree in enumerate(trees):
        entry = g.state()
        g.free[start].append(entry)
        accepts[g.build(tree, entry)] = k
    sets = list({s for moves in g.moves for s, _ in moves})
    signature: dict[tuple[bool, ...], int] = {}
    classes = bytes(signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256))
    examples = [classes.index(c) for c in range(len(signature))]

    first = g.closure(frozenset([start]))
    numbers, order, rows = {first: 0}, [first], []
    for states in order:
        row = []
        for b in examples:
            reached = {t for s in states for on, t in g.moves[s] if b in on}
            target = g.closure(frozenset(reached))
            if search:
                target |= first
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
        rows.append(row)
    labels = [frozenset(accepts[s] for s in states if s in accepts) for states in order]

    block: list = [tuple(sorted(x)) for x in labels]
    while True:  # states stay together while they accept alike and lead to states that are together
        keys = [(block[s], *(block[t] for t in rows[s])) for s in range(len(order))]
        index = {key: k for k, key in enumerate(dict.fromkeys(keys))}
        done = len(index) == len(set(block))
        block = [index[key] for key in keys]
        if done:
            break
    members = {b: s for s, b in enumerate(block)}
    ranked = sorted(members, key=lambda b: (bool(labels[members[b]]), b))
    place, width = {b: k for k, b in enumerate(ranked)}, len(signature)
    table = [place[block[t]] * width for b in ranked for t in rows[members[b]]]
    kept = [labels[members[b]] for b in ranked]
    stuck = next((k for k in range(len(ranked)) if not kept[k] and set(table[k * width : (k + 1) * width]) == {k * width}), -1)
    return Automaton(classes, width, table, place[block[0]] * width, next((k for k, x in enumerate(kept) if x), len(kept)) * width, stuck * width, kept)


class Scan:
    """Leftmost-longest, non-overlapping matches of each of several rules, all found together.

    One pass backwards over the bytes, through an automaton of all rules read backwards, gives every place where a match of some
    rule starts.  From the first such place on that no match of the rule covers, an automaton of all rules runs ahead to the
    match's end; a text without matches costs the one pass.
    """

    def __init__(self, trees: list[Node]):
        self.back = compile_rules([mirrored(t) for t in trees], search=True)
        self.ahead = compile_rules(trees, search=False)

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """Places where matches start, from the last, with the state that tells of which rules."""
        a, found, at = self.back, [], len(data)
        state, table, accepting = a.start, a.table, a.accepting
        for c in reversed(data.translate(a.classes)):
            state = table[state + c]
            at -= 1
            if state >= accepting:
                found.append((at, state))
        return found

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches."""
        found = self.starts(data)
        if not found:
            return []
        a, out, free = self.ahead, [], {}
        table, accepting, dead, columns = a.table, a.accepting, a.dead, data.translate(a.classes)
        rules = {state: sorted(self.back.labels[state // self.back.width]) for state in {s for _, s in found}}
        for start, told in reversed(found):
            wanted = [k for k in rules[told] if start >= free.get(k, 0)]
            if not wanted:
                continue
            state, ends = a.start, {}
            for at in range(start, len(columns)):
                state = table[state + columns[at]]
                if state == dead:
                    break
                if state >= accepting:
                    for k in a.labels[state // a.width]:
                        ends[k] = at + 1
            for k in wanted:
                out.append((start, k, ends[k]))
                free[k] = ends[k]
        return out
