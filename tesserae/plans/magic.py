"""Bound arguments of recursive rules: where every use of a linear rule fixes the same argument to a
constant, the recursion starts from that constant alone.

A rule r is rewritten when it is used outside itself once, positively, with a constant in some
place; all its recursive bodies are linear (one use of r) and pass the variable of that place from
head to that use unchanged. The constant then filters the base bodies, and each epoch only extends
rows that the query asked for. Rules with aggregates are left alone.
"""

from __future__ import annotations

from tesserae.plans import ir
from tesserae.plans.normalize import dnf


def uses(rules: dict[str, list], name: str) -> list[tuple[str, ir.RuleAtom, bool]]:
    found = []
    for owner, bodies in rules.items():
        for r in bodies:
            if isinstance(r, ir.FixedRule):
                found += [(owner, None, True) for x in r.inputs if not x.stored and x.name == name]
            elif isinstance(r, ir.Rule):
                for body in dnf(r.body):
                    for a in body:
                        negated = isinstance(a, ir.Not)
                        a = a.atom if negated else a
                        if isinstance(a, ir.RuleAtom) and a.name == name:
                            found.append((owner, a, negated))
    return found


def constant_places(rule: ir.Rule, atom: ir.RuleAtom) -> dict[int, ir.Expr]:
    """Arguments of the atom that are constants, or variables that the rule's body sets to one."""
    if len(dnf(rule.body)) != 1:
        return {i: a for i, a in enumerate(atom.args) if isinstance(a, ir.Lit)}
    known = {a.var: a.expr for a in dnf(rule.body)[0] if isinstance(a, ir.Unify) and isinstance(a.expr, ir.Lit)}
    out = {}
    for i, a in enumerate(atom.args):
        if isinstance(a, ir.Lit):
            out[i] = a
        elif isinstance(a, ir.Var) and a.name in known:
            out[i] = known[a.name]
    return out


def carried(rules: list, name: str, place: int) -> bool:
    """Whether recursion keeps the place's value."""
    for r in rules:
        if not isinstance(r, ir.Rule) or any(h.aggr for h in r.head):
            return False
        var = r.head[place].var
        for body in dnf(r.body):
            own = [a for a in body if isinstance(a, ir.RuleAtom) and a.name == name]
            if any(isinstance(a, ir.Not) and isinstance(a.atom, ir.RuleAtom) and a.atom.name == name for a in body):
                return False
            if len(own) > 1 or own and own[0].args[place] != ir.Var(var):
                return False
    return True


def rewritten(rules: dict[str, list]) -> dict[str, list]:
    out = dict(rules)
    for name, bodies in rules.items():
        if name == "?" or not all(isinstance(r, ir.Rule) for r in bodies):
            continue
        found = uses(out, name)
        outside = [(o, a, n) for o, a, n in found if o != name]
        if len(outside) == len(found) or len(outside) != 1 or outside[0][2] or outside[0][1] is None:
            continue
        owner, atom, _ = outside[0]
        places = {}
        for r in out[owner]:
            if isinstance(r, ir.Rule) and any(atom in body for body in dnf(r.body)):
                places = constant_places(r, atom)
        for place, value in places.items():
            if place < len(bodies[0].head) and carried(bodies, name, place):
                out[name] = [ir.Rule(r.name, r.head, restricted(r, name, place, value)) for r in bodies]
                break
    return out


def restricted(rule: ir.Rule, name: str, place: int, value: ir.Expr):
    parts = []
    for body in dnf(rule.body):
        recursive = any(isinstance(a, ir.RuleAtom) and a.name == name for a in body)
        test = ir.Unify(rule.head[place].var, value)
        parts.append(ir.And(tuple(body if recursive else [test, *body])))
    return parts[0] if len(parts) == 1 else ir.Or(tuple(parts))
