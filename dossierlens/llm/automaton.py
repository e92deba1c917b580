"""Rule regexes to one minimal deterministic automaton over bytes, by subset construction and partition refinement.

The rule language: literal characters, ``\\xHH`` and escaped punctuation, classes ``[...]`` and ``[^...]`` with ranges, groups,
``|``, and the repetitions ``? * + {m} {m,} {m,n}``. Letters are ASCII; ``fold`` makes them match in either case.
"""

ALL = frozenset(range(256))


class _Parser:
    """Recursive descent into nested tuples: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def peek(self):
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self):
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.atom()
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                stop = self.text.index("}", self.at)
                least, _, most = self.text[self.at: stop].partition(",")
                exact = "," not in self.text[self.at: stop]
                self.at = stop + 1
                part = ("rep", part, int(least), int(least) if exact else int(most) if most else None)
            else:
                part = ("rep", part, int(sign == "+"), 1 if sign == "?" else None)
        return part

    def byte(self):
        char = self.take()
        if char == "\\":
            char = self.take()
            if char == "x":
                self.at += 2
                return int(self.text[self.at - 2: self.at], 16)
            if char.isalnum():
                raise ValueError(f"unknown escape \\{char}")
        if ord(char) > 127:
            raise ValueError("rules are written in ASCII")
        return ord(char)

    def either(self, values: set):
        if self.fold:
            values |= {v ^ 32 for v in values if chr(v).isascii() and chr(v).isalpha()}
        return ("set", frozenset(values))

    def atom(self):
        if self.peek() == "(":
            self.take()
            inner = self.alternatives()
            if self.take() != ")":
                raise ValueError("group is not closed")
            return inner
        if self.peek() != "[":
            return self.either({self.byte()})
        self.take()
        negative = self.peek() == "^"
        self.at += negative
        values = set()
        while self.peek() != "]":
            first = last = self.byte()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                last = self.byte()
            values |= set(range(first, last + 1))
        self.take()
        found = self.either(values)
        return ("set", ALL - found[1]) if negative else found


def parse(pattern: str, fold: bool = False):
    parser = _Parser(pattern, fold)
    tree = parser.alternatives()
    if parser.peek():
        raise ValueError(f"unexpected {parser.peek()!r} in {pattern!r}")
    return tree


def reverse(tree):
    """The tree that matches the mirrored strings."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(p) for p in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [reverse(p) for p in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.empty, self.moves = [], []

    def state(self):
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Builds ``tree`` from ``start`` on and returns its last state."""
        kind = tree[0]
        if kind == "set":
            end, mid = self.state(), self.state()
            self.empty[start].append(mid)
            self.moves[mid] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end


class Automaton:
    """``table[state * 256 + byte]`` is the next state times 256; ``accepts[state]`` has the numbers of the rules that end here.

    States are ordered so that accepting ones come last: ``first_accepting`` is the smallest of them, times 256. ``dead`` is
    the state without way out (times 256) or -1. With ``anywhere`` a rule may begin at every byte.
    """

    def __init__(self, trees: list, anywhere: bool):
        nfa = _Nfa()
        root = nfa.state()
        ends = {}
        for number, tree in enumerate(trees):
            start = nfa.state()
            nfa.empty[root].append(start)
            ends[nfa.add(tree, start)] = number
        classes, of_byte = _byte_classes([m[0] for m in nfa.moves if m])

        def closure(states):
            seen, todo = set(states), list(states)
            while todo:
                for s in nfa.empty[todo.pop()]:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
            return frozenset(s for s in seen if nfa.moves[s] or s in ends)

        first = closure([root])
        number_of, order, rows = {first: 0}, [first], []
        while len(rows) < len(order):
            row = []
            for byte in classes:
                target = {nfa.moves[s][1] for s in order[len(rows)] if nfa.moves[s] and byte in nfa.moves[s][0]}
                target = closure(target) | (first if anywhere else frozenset())
                if target not in number_of:
                    number_of[target] = len(order)
                    order.append(target)
                row.append(number_of[target])
            rows.append(row)
        labels = [tuple(sorted(ends[s] for s in states if s in ends)) for states in order]
        self._minimise(rows, labels, of_byte)

    def _minimise(self, rows, labels, of_byte):
        block = {label: k for k, label in enumerate(sorted(set(labels)))}
        of = [block[label] for label in labels]
        while True:
            signs = [(of[s], *(of[t] for t in row)) for s, row in enumerate(rows)]
            names = {sign: k for k, sign in enumerate(sorted(set(signs)))}
            fresh = [names[sign] for sign in signs]
            if len(names) == len(set(of)):
                break
            of = fresh
        sample = {}
        for s, b in enumerate(of):
            sample.setdefault(b, s)
        ordered = sorted(sample, key=lambda b: (bool(labels[sample[b]]), b != of[0], b))
        place = {b: k for k, b in enumerate(ordered)}
        self.states, self.start = len(ordered), place[of[0]] * 256
        self.accepts = [labels[sample[b]] for b in ordered]
        self.first_accepting = 256 * sum(not a for a in self.accepts)
        self.table = []
        for b in ordered:
            targets = [place[of[t]] * 256 for t in rows[sample[b]]]
            self.table += [targets[c] for c in of_byte]
        self.dead = next((k * 256 for k, b in enumerate(ordered) if not labels[sample[b]] and
                          all(of[t] == b for t in rows[sample[b]])), -1)

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that begins at ``at``, or -1."""
        state, found = self.start, at if self.accepts[self.start >> 8] else -1
        for k in range(at, len(data)):
            state = self.table[state + data[k]]
            if state == self.dead:
                break
            if state >= self.first_accepting:
                found = k + 1
        return found

    def longest_back(self, data: bytes, end: int, floor: int) -> int:
        """For an automaton of mirrored rules: the leftmost begin, at ``floor`` or later, of a match that ends at ``end``, or -1."""
        state, found = self.start, -1
        for k in range(end - 1, floor - 1, -1):
            state = self.table[state + data[k]]
            if state == self.dead:
                break
            if state >= self.first_accepting:
                found = k
        return found


def _byte_classes(sets: list):
    """One byte of each class of bytes that no set tells apart, and the class of every byte."""
    kinds, of_byte, distinct = {}, [], list(set(sets))
    for byte in range(256):
        of_byte.append(kinds.setdefault(tuple(byte in s for s in distinct), len(kinds)))
    return [of_byte.index(k) for k in range(len(kinds))], of_byte
