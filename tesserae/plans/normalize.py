"""Bodies to disjunctive normal form, and atoms into an order in which each can run."""

from __future__ import annotations

from tesserae.plans import ir
from tesserae.plans.ir import EngineError


def dnf(node, negated: bool = False) -> list[list]:
    """Lists of atoms, negation pushed down to atoms."""
    if isinstance(node, ir.Not):
        return dnf(node.atom, not negated)
    if isinstance(node, (ir.And, ir.Or)):
        parts = [dnf(a, negated) for a in node.atoms]
        if isinstance(node, ir.And) != negated:
            out = [[]]
            for p in parts:
                out = [x + y for x in out for y in p]
            return out
        return [x for p in parts for x in p]
    if not negated:
        return [[node]]
    if isinstance(node, ir.Pred):
        return [[ir.Pred(ir.Call("negate", (node.expr,)))]]
    if isinstance(node, ir.Unify):
        return [[ir.Pred(ir.Call("neq", (ir.Var(node.var), node.expr)))]]
    if isinstance(node, ir.UnifyIn):
        return [[ir.Pred(ir.Call("negate", (ir.Call("is_in", (ir.Var(node.var), node.expr)),)))]]
    if isinstance(node, ir.SearchAtom):
        raise EngineError("query::negated_search", "a search can't be negated")
    return [[ir.Not(node)]]


def atom_args(atom) -> list[ir.Expr]:
    if isinstance(atom, ir.RuleAtom):
        return list(atom.args)
    if isinstance(atom, ir.RelAtom):
        return list(atom.args) if atom.args is not None else [e for _, e in atom.named]
    if isinstance(atom, ir.SearchAtom):
        return [e for _, e in atom.named]
    if isinstance(atom, ir.Not):
        return atom_args(atom.atom)
    return []


def used(atom) -> set[str]:
    """Variables that an atom mentions, without wildcards."""
    if isinstance(atom, ir.Pred):
        return ir.variables(atom.expr)
    if isinstance(atom, (ir.Unify, ir.UnifyIn)):
        return ir.variables(atom.expr) | {atom.var}
    if isinstance(atom, ir.Not):
        return used(atom.atom)
    found = set().union(*[ir.variables(a) for a in atom_args(atom)]) if atom_args(atom) else set()
    if isinstance(atom, ir.SearchAtom):
        found |= set().union(*[ir.variables(e) for k, e in atom.options if not k.startswith("bind_") and k != "filter"], set())
    return {v for v in found if v != "_"}


def binds(atom) -> set[str]:
    if isinstance(atom, (ir.RuleAtom, ir.RelAtom)):
        return {a.name for a in atom_args(atom) if isinstance(a, ir.Var) and a.name != "_"}
    if isinstance(atom, ir.SearchAtom):
        return {a.name for a in atom_args(atom) if isinstance(a, ir.Var) and a.name != "_"} | {e.name for k, e in atom.options if k.startswith("bind_") and isinstance(e, ir.Var)}
    if isinstance(atom, (ir.Unify, ir.UnifyIn)):
        return {atom.var}
    return set()


def needs(atom) -> set[str]:
    """Variables that must be bound before the atom runs."""
    if isinstance(atom, ir.Pred):
        return ir.variables(atom.expr)
    if isinstance(atom, (ir.Unify, ir.UnifyIn)):
        return ir.variables(atom.expr)
    if isinstance(atom, ir.SearchAtom):
        return set().union(*[ir.variables(e) for k, e in atom.options if not k.startswith("bind_") and k != "filter"], set())
    return set().union(*[ir.variables(a) for a in atom_args(atom) if not isinstance(a, ir.Var)], set())


def ordered(atoms: list) -> list:
    """Positive atoms keep their order; tests and assignments run as soon as they can."""
    left, out, bound = list(atoms), [], set()
    everywhere = {v for a in atoms if not isinstance(a, ir.Not) for v in binds(a)}
    while left:
        for i, a in enumerate(left):
            if isinstance(a, ir.Not):
                ready = (used(a) & everywhere) <= bound and needs(a.atom) <= bound
                if ready and used(a) and not used(a) & bound:
                    raise EngineError("query::unsafe_negation", f"a negated atom has no bound variable: {a.atom}")
            elif isinstance(a, (ir.Pred, ir.Unify, ir.UnifyIn)):
                ready = needs(a) <= bound
                if not ready and isinstance(a, ir.Unify) and isinstance(a.expr, ir.Var) and a.var in bound:
                    a, ready = ir.Unify(a.expr.name, ir.Var(a.var)), True
            else:
                ready = False
            if ready:
                break
        else:
            i, a = next(((i, a) for i, a in enumerate(left) if isinstance(a, (ir.RuleAtom, ir.RelAtom, ir.SearchAtom)) and needs(a) <= bound), (None, None))
            if a is None:
                raise EngineError("eval::unbound", f"unbound variables {sorted(set().union(*[needs(x) | (used(x) if isinstance(x, ir.Not) else set()) for x in left]) - bound)}")
        left.pop(i)
        out.append(a)
        bound |= binds(a)
    return out
