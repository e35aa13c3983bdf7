"""The parsed form of programs: expressions, atoms, rules, options."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class EngineError(ValueError):
    """A program that can't be run; `code` names the kind of fault."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"[{code}] {message}")
        self.code = code


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Items:
    """A list literal."""

    args: tuple


@dataclass(frozen=True)
class Obj:
    """A JSON object literal."""

    pairs: tuple


Expr = Lit | Var | Call | Items | Obj


def variables(e: Expr) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, (Call, Items)):
        return set().union(*map(variables, e.args)) if e.args else set()
    if isinstance(e, Obj):
        return set().union(*[variables(x) for p in e.pairs for x in p]) if e.pairs else set()
    return set()


@dataclass(frozen=True)
class RuleAtom:
    name: str
    args: tuple


@dataclass(frozen=True)
class RelAtom:
    name: str
    args: tuple | None = None  # positional
    named: tuple | None = None  # (column, expression)
    at: Expr | None = None


@dataclass(frozen=True)
class SearchAtom:
    relation: str
    index: str
    named: tuple
    options: tuple


@dataclass(frozen=True)
class Pred:
    expr: Expr


@dataclass(frozen=True)
class Unify:
    var: str
    expr: Expr


@dataclass(frozen=True)
class UnifyIn:
    var: str
    expr: Expr


@dataclass(frozen=True)
class Not:
    atom: Any


@dataclass(frozen=True)
class And:
    atoms: tuple


@dataclass(frozen=True)
class Or:
    atoms: tuple


@dataclass(frozen=True)
class HeadArg:
    var: str
    aggr: str | None = None
    args: tuple = ()

    @property
    def label(self) -> str:
        return f"{self.aggr}({self.var})" if self.aggr else self.var


@dataclass
class Rule:
    name: str
    head: tuple
    body: Any


@dataclass
class ConstRule:
    name: str
    head: tuple
    value: Expr


@dataclass
class FixedRel:
    """An input of a fixed rule: a rule, or a stored relation (positional or named)."""

    name: str
    stored: bool
    columns: tuple = ()
    named: tuple | None = None
    at: Expr | None = None


@dataclass
class FixedRule:
    name: str
    head: tuple
    call: str
    inputs: list
    options: dict


@dataclass
class Column:
    name: str
    type: str = "Any?"
    default: Expr | None = None
    binding: str | None = None


@dataclass
class RelationOp:
    op: str
    name: str
    keys: list | None = None
    values: list | None = None


@dataclass
class Program:
    rules: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    order: list = field(default_factory=list)  # (label, descending)
    relation: RelationOp | None = None
    assertion: str | None = None
    timeout: float | None = None
    sleep: float | None = None
    returning: bool = False
    magic: bool = True
    text: str = ""
