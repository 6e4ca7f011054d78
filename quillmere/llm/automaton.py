"""Regular expressions compiled to deterministic automata over bytes: parsing, subset construction, minimisation."""

from __future__ import annotations

import numpy as np

ANY = frozenset(range(256))


def parse(pattern: str, ignore_case: bool = False):
    """A tree of ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most).

    Knows literals, escapes, classes, groups, alternation and the quantifiers ?, *, + and {m,n}; ASCII only.
    """
    at = 0

    def fold(chars: set[int]) -> frozenset[int]:
        if ignore_case:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(chars)

    def escape() -> int:
        nonlocal at
        at += 2
        if pattern[at - 1] == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(pattern[at - 1], ord(pattern[at - 1]))

    def one() -> int:
        nonlocal at
        if pattern[at] == "\\":
            return escape()
        at += 1
        return ord(pattern[at - 1])

    def bracket():
        nonlocal at
        at += 1
        negated = pattern[at] == "^"
        at += negated
        chars: set[int] = set()
        while pattern[at] != "]":
            low = one()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                chars |= set(range(low, one() + 1))
            else:
                chars.add(low)
        at += 1
        return ("set", ANY - fold(chars) if negated else fold(chars))

    def atom():
        nonlocal at
        c = pattern[at]
        if c == "(":
            at += 3 if pattern.startswith("(?:", at) else 1
            inner = alternatives()
            at += 1
            return inner
        if c == "[":
            return bracket()
        if c == ".":
            at += 1
            return ("set", ANY - {10})
        return ("set", fold({one()}))

    def quantified():
        nonlocal at
        node = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at + 1 : end].partition(",")
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
                at = end + 1
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
                at += 1
        return node

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(quantified())
        return ("cat", parts)

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return ("alt", parts)

    return alternatives()


def reverse(node):
    """The tree of the reversed texts."""
    kind = node[0]
    if kind == "cat":
        return ("cat", [reverse(p) for p in reversed(node[1])])
    if kind == "alt":
        return ("alt", [reverse(p) for p in node[1]])
    return ("rep", reverse(node[1]), *node[2:]) if kind == "rep" else node


class Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Adds a tree from a state on; the state in which it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            middle = self.state()
            self.empty[start].append(middle)
            self.moves[middle] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                head = self.state()
                self.empty[start].append(head)
                self.empty[self.add(part, head)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            head = self.state()
            self.empty[start].append(head)
            self.empty[self.add(part, head)].append(head)
            start = head
        else:
            end = self.state()
            self.empty[start].append(end)
            for _ in range(most - least):
                start = self.add(part, start)
                self.empty[start].append(end)
            start = end
        return start

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


class Automaton:
    """A minimal deterministic automaton: table[state, byte] and the mask of the rules that accept in each state."""

    def __init__(self, trees: list, anchored: bool):
        """Rule k sets bit k. Unanchored: a match may begin at every byte."""
        nfa = Nfa()
        root = nfa.state()
        for k, tree in enumerate(trees):
            head = nfa.state()
            nfa.empty[root].append(head)
            nfa.accept[nfa.add(tree, head)] = 1 << k
        kinds = sorted({m[0] for m in nfa.moves if m}, key=sorted)
        signature = [tuple(b in kind for kind in kinds) for b in range(256)]
        classes = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        of_byte = np.array([classes[s] for s in signature])
        samples = [signature.index(s) for s in classes]
        first = nfa.closure([root])
        known, order, table = {first: 0}, [first], []
        for states in order:
            row = []
            for byte in samples:
                reached = {m[1] for s in states if (m := nfa.moves[s]) and byte in m[0]}
                target = nfa.closure(reached | (set() if anchored else {root}))
                if target not in known:
                    known[target] = len(order)
                    order.append(target)
                row.append(known[target])
            table.append(row)
        steps = np.array(table)
        masks = np.array([sum({nfa.accept[s] for s in states if s in nfa.accept}) for states in order])
        self.table, self.masks = self._minimal(steps, masks, of_byte)
        dead = [i for i in range(len(self.masks)) if self.masks[i] == 0 and (self.table[i] == i).all()]
        self.dead = dead[0] if dead else -1

    @staticmethod
    def _minimal(steps, masks, of_byte):
        """Splits the states by what they accept, then by where their moves lead, until nothing splits."""
        group = np.unique(masks, return_inverse=True)[1].ravel()
        while True:
            seen = np.column_stack([group, group[steps]])
            split = np.unique(seen, axis=0, return_inverse=True)[1].ravel()
            if split.max() == group.max():
                break
            group = split
        firsts = {}
        names = {}
        for state, g in enumerate(group.tolist()):
            names.setdefault(g, len(names))
            firsts.setdefault(names[g], state)
        renamed = np.array([names[g] for g in group.tolist()])
        rows = np.array([firsts[k] for k in range(len(firsts))])
        return renamed[steps[rows]][:, of_byte], masks[rows]

    def rows(self) -> tuple[list[list], list[int]]:
        """The table as linked rows: row[byte] is the next row, row[256] a code of its mask; and the masks by code."""
        masks = [0, *sorted({m for m in self.masks.tolist() if m})]
        rows = [[None] * 257 for _ in self.masks]
        for row, targets, mask in zip(rows, self.table.tolist(), self.masks.tolist(), strict=True):
            row[:256] = [rows[t] for t in targets]
            row[256] = masks.index(mask)
        return rows, masks

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match from start; -1 if there is none."""
        state, end, table, masks = 0, -1, self._lists(), self._accepts
        for at in range(start, len(data)):
            state = table[state][data[at]]
            if state == self.dead:
                break
            if masks[state]:
                end = at + 1
        return end

    def _lists(self):
        if not hasattr(self, "_tables"):
            self._tables, self._accepts = self.table.tolist(), self.masks.tolist()
        return self._tables
