"""Table-driven generalised LR recognisers.

A grammar's text is compiled into an LR automaton with SLR(1) lookaheads. Where a table entry has one
action the recogniser runs like any LR parser; where it has several it follows all of them on shared
stacks and drops those that fail, so a grammar may be written as the language is, not as a table wants it.
"""

from __future__ import annotations


class Grammar:
    """Rules as text: `name: a b? c* d+ e%sep | ...`, one rule a line or continued by lines that begin with |.

    x? is optional, x* and x+ are lists, x%s is a list of x separated by the symbol s; symbols that no
    rule defines are terminals. The first rule is the start.
    """

    def __init__(self, text: str, fallback: dict[str, str] | None = None):
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        self.fallback = fallback or {}
        made: set[str] = set()
        joined: list[str] = []
        for line in text.strip().split("\n"):
            line = line.strip()
            if not line or line.startswith("--"):
                continue
            if line.startswith("| "):
                joined[-1] += " " + line
            else:
                joined.append(line)
        for line in joined:
            name, _, body = line.partition(": ")
            for alternative in body.split(" | "):
                self._add(name.strip(), alternative.split(), made)
        self.start = joined[0].partition(": ")[0].strip()
        self._build()

    def _add(self, name: str, parts: list[str], made: set[str]) -> None:
        done: list[list[str]] = [[]]
        for part in parts:
            if part == "EMPTY":
                continue
            if len(part) > 1 and part[-1] in "*+?" and part[0].isalpha():
                base = part[:-1]
                if part[-1] == "?":
                    done = [d + extra for d in done for extra in ([base], [])]
                    continue
                many = f"{base}+"
                if many not in made:
                    made.add(many)
                    self.rules += [(many, (base,)), (many, (many, base))]
                done = [d + extra for d in done for extra in ([[many], []] if part[-1] == "*" else [[many]])]
            elif "%" in part and len(part) > 2 and part[0].isalpha():
                base, _, sep = part.partition("%")
                if part not in made:
                    made.add(part)
                    self.rules += [(part, (base,)), (part, (part, sep, base))]
                done = [d + [part] for d in done]
            else:
                done = [d + [part] for d in done]
        for d in done:
            if (name, tuple(d)) not in self.rules:
                self.rules.append((name, tuple(d)))

    def _build(self) -> None:
        rules = [("START'", (self.start,)), *self.rules]
        by: dict[str, list[int]] = {}
        for i, (lhs, _) in enumerate(rules):
            by.setdefault(lhs, []).append(i)
        empty: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in by}
        changed = True
        while changed:
            changed = False
            for lhs, rhs in rules:
                before = len(first[lhs]), lhs in empty
                for s in rhs:
                    first[lhs] |= first[s] if s in by else {s}
                    if s not in empty:
                        break
                else:
                    empty.add(lhs)
                changed = changed or before != (len(first[lhs]), lhs in empty)
        follow: dict[str, set[str]] = {n: set() for n in by}
        follow["START'"].add("END")
        changed = True
        while changed:
            changed = False
            for lhs, rhs in rules:
                trailer = follow[lhs]
                for s in reversed(rhs):
                    if s in by:
                        if not trailer <= follow[s]:
                            follow[s] |= trailer
                            changed = True
                        trailer = trailer | first[s] if s in empty else first[s]
                    else:
                        trailer = {s}

        def closure(kernel: frozenset) -> list[tuple[int, int]]:
            out, seen, todo = list(kernel), set(kernel), list(kernel)
            while todo:
                r, dot = todo.pop()
                rhs = rules[r][1]
                if dot < len(rhs) and rhs[dot] in by:
                    for i in by[rhs[dot]]:
                        if (i, 0) not in seen:
                            seen.add((i, 0))
                            out.append((i, 0))
                            todo.append((i, 0))
            return out

        start = frozenset([(0, 0)])
        number, todo = {start: 0}, [start]
        self.shift: list[dict[str, int]] = []
        actions: list[dict[str, list]] = []
        while todo:
            kernel = todo.pop(0)
            moves: dict[str, set] = {}
            table: dict[str, list] = {}
            for r, dot in closure(kernel):
                lhs, rhs = rules[r]
                if dot < len(rhs):
                    moves.setdefault(rhs[dot], set()).add((r, dot + 1))
                else:
                    for t in follow[lhs]:
                        table.setdefault(t, []).append(("accept",) if r == 0 else (len(rhs), lhs))
            gotos = {}
            for s, items in moves.items():
                target = frozenset(items)
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                gotos[s] = number[target]
            actions.append(table)
            self.shift.append(gotos)
        #: per state: terminal -> (state to shift to or -1, reductions)
        self.table: list[dict[str, tuple[int, tuple]]] = []
        for state, table in enumerate(actions):
            row: dict[str, tuple[int, tuple]] = {}
            for t in {*table, *(s for s in self.shift[state] if s not in by)}:
                row[t] = (self.shift[state].get(t, -1), tuple(dict.fromkeys(table.get(t, ()))))
            for t, other in self.fallback.items():
                if t not in row and other in row:
                    row[t] = row[other]
            self.table.append(row)
        self.goto = [{s: n for s, n in gotos.items() if s in by} for gotos in self.shift]
        del self.shift
        #: token -> (state, symbol) -> state, filled while reading: see _settle
        self.settled: dict[str, dict[tuple[int, str], int]] = {}

    def _settle(self, base: int, lhs: str, token: str) -> int:
        """The state that follows from base by lhs and by all reductions of single symbols that come before the token."""
        while True:
            state = self.goto[base][lhs]
            target, reductions = self.table[state].get(token, (0, ()))
            if target >= 0 or len(reductions) != 1 or len(reductions[0]) != 2 or reductions[0][0] != 1:
                return state
            lhs = reductions[0][1]

    def begin(self) -> list:
        return [(0, None)]

    def step(self, stacks: list, token: str) -> list:
        """The stacks after the token; none if no stack can take it."""
        table, goto = self.table, self.goto
        if len(stacks) == 1:
            # one stack and one action: plain LR
            node = stacks[0]
            settled = self.settled.get(token)
            if settled is None:
                settled = self.settled[token] = {}
            while True:
                entry = table[node[0]].get(token)
                if entry is None:
                    return []
                target, reductions = entry
                if not reductions:
                    return [(target, node)]
                if target >= 0 or len(reductions) > 1:
                    stacks = [node]
                    break
                reduction = reductions[0]
                if len(reduction) == 1:
                    return [node]
                n, lhs = reduction
                while n:
                    node = node[1]
                    n -= 1
                state = settled.get((node[0], lhs))
                if state is None:
                    state = settled[node[0], lhs] = self._settle(node[0], lhs, token)
                node = (state, node)
        out, seen, todo = {}, {}, []
        for node in stacks:
            if (node[0], id(node[1])) not in seen:
                seen[node[0], id(node[1])] = node
                todo.append(node)
        while todo:
            node = todo.pop()
            entry = table[node[0]].get(token)
            if entry is None:
                continue
            target, reductions = entry
            if target >= 0:
                out[target, id(node)] = (target, node)
            for reduction in reductions:
                if len(reduction) == 1:
                    out["END", id(node)] = node
                    continue
                n, lhs = reduction
                base = node
                while n:
                    base = base[1]
                    n -= 1
                key = goto[base[0]][lhs], id(base)
                if key not in seen:
                    seen[key] = made = (key[0], base)
                    todo.append(made)
        return list(out.values())
