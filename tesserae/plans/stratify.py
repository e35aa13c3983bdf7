"""Dependencies between rules: reachability, strongly connected components, and what may stand in a cycle."""

from __future__ import annotations

from tesserae.functions.aggregates import is_meet
from tesserae.plans import ir
from tesserae.plans.ir import EngineError
from tesserae.plans.normalize import dnf


def dependencies(rules: dict[str, list]) -> dict[str, dict[str, bool]]:
    """For each rule: the rules it uses, and whether a use forbids a cycle."""
    out: dict[str, dict[str, bool]] = {}
    for name, bodies in rules.items():
        found = out.setdefault(name, {})
        for r in bodies:
            if isinstance(r, ir.FixedRule):
                for x in r.inputs:
                    if not x.stored:
                        found[x.name] = True
            elif isinstance(r, ir.Rule):
                plain = not any(h.aggr for h in r.head)
                meet = not plain and is_meet(r.head)
                for body in dnf(r.body):
                    for a in body:
                        hard = isinstance(a, ir.Not)
                        a = a.atom if hard else a
                        if isinstance(a, ir.RuleAtom):
                            strict = hard or not plain and not (meet and a.name == name)
                            found[a.name] = found.get(a.name, False) or strict
    return out


def components(graph: dict[str, dict[str, bool]], start: str) -> list[list[str]]:
    """Components reachable from start, each after those it needs (Tarjan, without recursion)."""
    index, low, stack, on, out, work = {}, {}, [], set(), [], [(start, None)]
    while work:
        node, it = work.pop()
        if it is None:
            if node in index:
                continue
            index[node] = low[node] = len(index)
            stack.append(node)
            on.add(node)
            it = iter(graph.get(node, {}))
        for nxt in it:
            if nxt not in graph:
                continue
            if nxt not in index:
                work += [(node, it), (nxt, None)]
                break
            if nxt in on:
                low[node] = min(low[node], index[nxt])
        else:
            if low[node] == index[node]:
                group = []
                while True:
                    x = stack.pop()
                    on.discard(x)
                    group.append(x)
                    if x == node:
                        break
                out.append(group)
            if work and work[-1][0] in on:
                parent = work[-1][0]
                low[parent] = min(low[parent], low[node])
    return out


def strata(rules: dict[str, list], start: str = "?") -> list[tuple[list[str], bool]]:
    """(rules of a component, whether it is recursive) in order of evaluation."""
    graph = dependencies(rules)
    out = []
    for group in components(graph, start):
        inside = set(group)
        cyclic = any(d in inside for n in group for d in graph[n])
        for n in group:
            if any(d in inside and strict for d, strict in graph[n].items()):
                raise EngineError("eval::unstratifiable", f"rule {n} uses {sorted(inside)} through negation, aggregation or a fixed rule in a cycle")
        out.append((sorted(group), cyclic))
    return out
