"""Control flow of a body of statements as rows: nodes and edges.

Statements are nodes; the walk keeps the loose ends of each way in which control may
leave a block and ties them to what follows. A finally block is laid out once for every
way that passes through it, so that no way runs on into another's destination.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

#: Words in a condition that look like a person's approval. A label only;
#: no analysis treats such a condition as a check.
GATE_WORDS = ("human", "approve", "approval", "confirm", "review", "authorize", "consent")


@dataclass
class Graph:
    #: (node, kind, line, human gate)
    nodes: list[tuple[int, str, int, bool]] = field(default_factory=list)
    edges: set[tuple[int, int]] = field(default_factory=set)

    def node(self, kind: str, line: int, gate: bool = False) -> int:
        self.nodes.append((len(self.nodes), kind, line, gate))
        return len(self.nodes) - 1

    def tie(self, ends: set[int], to: int) -> None:
        self.edges |= {(e, to) for e in ends}

    def order(self) -> list[int]:
        """Reverse postorder from the entry: before its successors but for back edges."""
        after: dict[int, list[int]] = {}
        for a, b in sorted(self.edges):
            after.setdefault(a, []).append(b)
        seen, out, todo = {0}, [], [(0, iter(after.get(0, [])))]
        while todo:
            at, rest = todo[-1]
            nxt = next((n for n in rest if n not in seen), None)
            if nxt is None:
                out.append(at)
                todo.pop()
            else:
                seen.add(nxt)
                todo.append((nxt, iter(after.get(nxt, []))))
        return out[::-1]


Ends = dict[str, set[int]]  # by way: next, break, continue, exit


def is_gate(test: ast.expr) -> bool:
    words = [n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(test) if isinstance(n, (ast.Name, ast.Attribute))]
    return any(w in name.lower() for name in words for w in GATE_WORDS)


def build(body: list[ast.stmt]) -> Graph:
    g = Graph()
    entry = g.node("entry", 0)
    ends = _block(g, body, {entry}, None)
    out = g.node("exit", 0)
    g.tie(ends["next"] | ends["exit"] | ends["break"] | ends["continue"], out)
    return g


def _block(g: Graph, body: list[ast.stmt], into: set[int], seen: set[int] | None) -> Ends:
    ends: Ends = {"next": set(into), "break": set(), "continue": set(), "exit": set()}
    for s in body:
        if not ends["next"]:
            break
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        own = _statement(g, s, ends["next"], seen)
        ends["next"] = own["next"]
        for way in ("break", "continue", "exit"):
            ends[way] |= own[way]
    return ends


def _plain(g: Graph, s: ast.AST, kind: str, into: set[int], seen: set[int] | None, gate: bool = False) -> int:
    n = g.node(kind, s.lineno, gate)
    g.tie(into, n)
    if seen is not None:
        seen.add(n)
    return n


def _statement(g: Graph, s: ast.stmt, into: set[int], seen: set[int] | None) -> Ends:
    none: Ends = {"next": set(), "break": set(), "continue": set(), "exit": set()}
    if isinstance(s, ast.If):
        test = _plain(g, s.test, "if", into, seen, is_gate(s.test))
        yes, no = _block(g, s.body, {test}, seen), _block(g, s.orelse, {test}, seen)
        return {w: yes[w] | no[w] for w in none}
    if isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
        head = _plain(g, s, "loop", into, seen)
        inner, rest = _block(g, s.body, {head}, seen), _block(g, s.orelse, {head}, seen)
        g.tie(inner["next"] | inner["continue"], head)
        return {"next": rest["next"] | inner["break"], "break": rest["break"], "continue": rest["continue"], "exit": rest["exit"] | inner["exit"]}
    if isinstance(s, (ast.With, ast.AsyncWith)):
        return _block(g, s.body, {_plain(g, s, "with", into, seen)}, seen)
    if isinstance(s, (ast.Try, ast.TryStar)):
        start = _plain(g, s, "try", into, seen)
        raised = {start}
        ends = _block(g, s.body, {start}, raised)
        if seen is not None:
            seen |= raised
        if s.orelse and ends["next"]:
            more = _block(g, s.orelse, ends["next"], seen)
            ends = {w: more[w] if w == "next" else ends[w] | more[w] for w in none}
        for h in s.handlers:
            own = _block(g, h.body, {_plain(g, h, "except", raised, seen)}, seen)
            ends = {w: ends[w] | own[w] for w in none}
        if not s.finalbody:
            return ends
        out: Ends = {w: set() for w in none}
        for way in none:
            if ends[way]:
                own = _block(g, s.finalbody, ends[way], seen)
                for w in none:
                    out[way if w == "next" else w] |= own[w]
        return out
    n = _plain(g, s, type(s).__name__.lower(), into, seen)
    way = {ast.Return: "exit", ast.Raise: "exit", ast.Break: "break", ast.Continue: "continue"}.get(type(s), "next")
    return {**none, way: {n}}


def graphs(tree: ast.Module) -> list[tuple[str, Graph]]:
    """Of every function, nested ones too, and of the module."""
    return [(n.name, build(n.body)) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] + [("<module>", build(tree.body))]
