"""The text front end: scripts to programs, system operations and imperative blocks."""

from __future__ import annotations

import re
from typing import Any

from tesserae.plans import ir
from tesserae.plans.ir import EngineError

TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)
  | (?P<raw>(?P<fence>_+)"(?:.|\n)*?"(?P=fence))
  | (?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
  | (?P<number>0x[0-9a-fA-F][0-9a-fA-F_]*|0o[0-7][0-7_]*|0b[01][01_]*|[0-9][0-9_]*(?:\.(?!\.)[0-9_]*)?(?:[eE][+-]?[0-9_]+)?)
  | (?P<param>\$[\w.]+)
  | (?P<name>[^\W\d](?:\w|\.(?=\w))*)
  | (?P<op>::|:=|=>|->|\+\+|&&|\|\||==|!=|<=|>=|[-+*/%^~!<>=?\[\](){},;:|@])""",
    re.X,
)
#: Binary operators from loosest to tightest; functions they stand for.
LEVELS = [{"||": "or"}, {"&&": "and"}, {">": "gt", "<": "lt", ">=": "ge", "<=": "le"}, {"==": "eq", "!=": "neq"}, {"%": "mod"}, {"+": "add", "-": "sub", "++": "concat"}, {"*": "mul", "/": "div"}, {"^": "pow"}, {"~": "coalesce"}]
POWER = {op: (i + 1, name) for i, level in enumerate(LEVELS) for op, name in level.items()}
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
MUTATIONS = ("create", "replace", "insert", "put", "update", "rm", "delete", "ensure_not", "ensure")


class Token:
    __slots__ = ("kind", "text", "start", "end")

    def __init__(self, kind: str, text: str, start: int, end: int) -> None:
        self.kind, self.text, self.start, self.end = kind, text, start, end


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        if text.startswith("/*", at):
            depth, at = 1, at + 2
            while depth:
                m = re.compile(r"/\*|\*/").search(text, at)
                if not m:
                    raise EngineError("parser", "a comment does not end")
                depth += 1 if m.group() == "/*" else -1
                at = m.end()
            continue
        m = TOKEN.match(text, at)
        if not m:
            raise EngineError("parser", f"unexpected {text[at:at + 20]!r} at {at}")
        kind = next(k for k in ("space", "raw", "string", "number", "param", "name", "op") if m.group(k) is not None)
        if kind != "space":
            out.append(Token(kind, m.group(), at, m.end()))
        at = m.end()
    out.append(Token("end", "", at, at))
    return out


def unquote(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m.group(1)
        return chr(int(c[1:], 16)) if c[0] == "u" else ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", one, text[1:-1])


class Parser:
    def __init__(self, text: str, params: dict[str, Any] | None = None) -> None:
        self.text, self.t, self.i, self.params, self.fresh = text, tokens(text), 0, params or {}, 0

    # --- tokens

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.t[min(self.i + n, len(self.t) - 1)]

    def at(self, *texts: str) -> bool:
        return self.now.kind in ("op", "name") and self.now.text in texts

    def joined(self, n: int = 0) -> bool:
        """Whether the n-th token from here touches the one after."""
        return self.peek(n).end == self.peek(n + 1).start

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.fail(f"expected {text!r}")

    def fail(self, why: str) -> None:
        raise EngineError("parser", f"{why}, found {self.now.text or 'the end'!r} at {self.now.start}")

    def name(self) -> str:
        if self.now.kind != "name":
            self.fail("expected a name")
        self.i += 1
        return self.t[self.i - 1].text

    def listed(self, close: str, one, stop: tuple = ()) -> list:
        out = []
        while not self.at(close, *stop):
            out.append(one())
            if not self.take(","):
                break
        if not self.at(*stop):
            self.need(close)
        return out

    # --- expressions

    def expr(self, power: int = 0) -> ir.Expr:
        left = self.unary()
        while self.now.kind == "op" and self.now.text in POWER and POWER[self.now.text][0] > power:
            level, fn = POWER[self.now.text]
            self.i += 1
            right = self.expr(level - 1 if fn == "pow" else level)
            left = ir.Call(fn, (left, right))
        return left

    def unary(self) -> ir.Expr:
        if self.take("-"):
            inner = self.unary()
            return ir.Lit(-inner.value) if isinstance(inner, ir.Lit) and isinstance(inner.value, (int, float)) and not isinstance(inner.value, bool) else ir.Call("minus", (inner,))
        if self.take("!"):
            return ir.Call("negate", (self.unary(),))
        left = self.term()
        while self.at("->"):
            self.i += 1
            left = ir.Call("maybe_get", (left, self.term()))
        return left

    def term(self) -> ir.Expr:
        t = self.now
        self.i += 1
        if t.kind == "string":
            return ir.Lit(unquote(t.text))
        if t.kind == "raw":
            k = t.text.index('"')
            return ir.Lit(t.text[k + 1 : -k - 1])
        if t.kind == "number":
            plain = t.text.replace("_", "")
            if plain[:2] in ("0x", "0o", "0b"):
                return ir.Lit(int(plain, 0))
            return ir.Lit(float(plain) if re.search("[.eE]", plain) else int(plain))
        if t.kind == "param":
            if t.text[1:] not in self.params:
                raise EngineError("parser", f"parameter {t.text} is not given")
            return as_literal(self.params[t.text[1:]])
        if t.kind == "name":
            if t.text in ("true", "false", "null"):
                return ir.Lit({"true": True, "false": False, "null": None}[t.text])
            if self.at("("):
                self.i += 1
                return ir.Call(t.text, tuple(self.listed(")", self.expr)))
            return ir.Var(t.text)
        if t.text == "(":
            inner = self.expr()
            self.need(")")
            return inner
        if t.text == "[":
            return ir.Items(tuple(self.listed("]", self.expr)))
        if t.text == "{":
            return ir.Obj(tuple(self.listed("}", self.pair)))
        self.i -= 1
        self.fail("expected an expression")

    def pair(self):
        key = self.expr()
        self.need(":")
        return key, self.expr()

    # --- atoms

    def index_name(self) -> str:
        out = self.name()
        while self.at(":") and self.joined(-1) and self.joined() and self.peek().kind == "name":
            self.i += 1
            out += ":" + self.name()
        return out

    def named_arg(self):
        column = self.name()
        return column, self.expr() if self.take(":") else ir.Var(column)

    def validity(self) -> ir.Expr | None:
        return self.expr() if self.take("@") else None

    def relation(self):
        name = self.index_name()
        if self.take("{"):
            named = tuple(self.listed("}", self.named_arg, ("@",)))
            at = self.validity()
            if at is not None:
                self.need("}")
            return ir.RelAtom(name, named=named, at=at)
        self.need("[")
        args = tuple(self.listed("]", self.expr, ("@",)))
        at = self.validity()
        if at is not None:
            self.need("]")
        return ir.RelAtom(name, args=args, at=at)

    def option(self):
        name = self.name()
        self.need(":")
        return name, self.expr()

    def atom(self):
        if self.at("not") and self.peek().text != "(" or self.at("not") and self.peek().text == "(":
            self.i += 1
            return ir.Not(self.atom())
        if self.at("*"):
            self.i += 1
            return self.relation()
        if self.at("~"):
            self.i += 1
            relation, _, index = self.index_name().rpartition(":")
            self.need("{")
            named = tuple(self.listed("}", self.named_arg, ("|",)))
            options = ()
            if self.take("|"):
                options = tuple(self.listed("}", self.option))
            return ir.SearchAtom(relation, index, named, options)
        if self.now.kind == "name" and self.peek().text == "[" and self.now.text not in ("true", "false", "null"):
            name = self.name()
            self.need("[")
            return ir.RuleAtom(name, tuple(self.listed("]", self.expr)))
        if self.now.kind == "name" and self.peek().text == "=":
            name = self.name()
            self.need("=")
            return ir.Unify(name, self.expr())
        if self.now.kind == "name" and self.peek().kind == "name" and self.peek().text == "in":
            name = self.name()
            self.i += 1
            return ir.UnifyIn(name, self.expr())
        if self.at("("):
            # a group of atoms, or an expression in brackets
            start = self.i
            try:
                self.i += 1
                group = self.body(")")
                self.need(")")
                if not (self.now.kind == "op" and self.now.text in POWER or self.at("->")) and not (len(group.atoms) == 1 and isinstance(group.atoms[0], ir.Pred)):
                    return group
            except EngineError:
                pass
            self.i = start
        return ir.Pred(self.expr())

    def disjunction(self):
        atoms = [self.atom()]
        while self.at("or"):
            self.i += 1
            atoms.append(self.atom())
        return atoms[0] if len(atoms) == 1 else ir.Or(tuple(atoms))

    def body(self, close: str | None = None) -> ir.And:
        atoms = []
        while not self.rule_ends() and not (close and self.at(close)):
            atoms.append(self.disjunction())
            if not (self.take(",") or self.take("and")):
                break
        return ir.And(tuple(atoms))

    def rule_ends(self) -> bool:
        t = self.now
        return t.kind == "end" or t.text in (";", "}", "?") or t.text == ":" and self.peek().kind == "name"

    # --- rules and options

    def head_arg(self) -> ir.HeadArg:
        name = self.name()
        if self.take("("):
            var = self.name()
            args = []
            while self.take(","):
                args.append(self.expr())
            self.need(")")
            return ir.HeadArg(var, name, tuple(args))
        return ir.HeadArg(name)

    def rule(self):
        if self.take("?"):
            name = "?"
        else:
            name = self.name()
        self.need("[")
        head = tuple(self.listed("]", self.head_arg))
        if self.take(":="):
            out = ir.Rule(name, head, self.body())
        elif self.at("<") and self.joined() and self.peek().text == "-":
            self.i += 2
            out = ir.ConstRule(name, head, self.expr())
        elif self.at("<") and self.joined() and self.peek().text == "~":
            self.i += 2
            call = self.name()
            self.need("(")
            inputs, options = [], {}
            for x in self.listed(")", self.fixed_arg):
                if isinstance(x, ir.FixedRel):
                    inputs.append(x)
                else:
                    options[x[0]] = x[1]
            out = ir.FixedRule(name, head, call, inputs, options)
        else:
            self.fail("expected :=, <- or <~")
        self.take(";")
        return out

    def fixed_arg(self):
        if self.take("*"):
            name = self.index_name()
            if self.take("{"):
                named = []
                while not self.at("}", "@"):
                    column = self.name()
                    named.append((column, self.name() if self.take(":") else column))
                    if not self.take(","):
                        break
                at = self.validity()
                self.need("}")
                return ir.FixedRel(name, True, named=tuple(named), at=at)
            self.need("[")
            columns = self.listed("]", self.name, ("@",))
            at = self.validity()
            if at is not None:
                self.need("]")
            return ir.FixedRel(name, True, tuple(columns), at=at)
        if self.peek().text == "[":
            name = self.name()
            self.need("[")
            return ir.FixedRel(name, False, tuple(self.listed("]", self.name)))
        return self.option()

    def out_arg(self) -> str:
        name = self.name()
        if self.take("("):
            name += f"({self.name()})"
            self.need(")")
        return name

    def type(self) -> str:
        start = self.now.start
        if self.take("["):
            self.type()
            if self.take(";"):
                self.expr()
            self.need("]")
        elif self.take("("):
            self.listed(")", self.type)
        elif self.take("<"):
            self.name()
            self.need(";")
            self.i += 1
            self.need(">")
        else:
            self.name()
        self.take("?")
        return re.sub(r"\s", "", self.text[start : self.t[self.i - 1].end])

    def column(self) -> ir.Column:
        c = ir.Column(self.name())
        if self.take(":"):
            c.type = self.type()
        if self.take("default"):
            c.default = self.expr()
        elif self.take("="):
            c.binding = self.out_arg()
        return c

    def program_option(self, p: ir.Program) -> None:
        self.need(":")
        word = self.name()
        if word in ("limit", "offset", "timeout", "sleep"):
            value = constant(self.expr())
            if not isinstance(value, (int, float)) or isinstance(value, bool) or value < 0 or word in ("limit", "offset") and int(value) != value:
                raise EngineError("parser", f":{word} takes a number that is not negative")
            setattr(p, word, int(value) if word in ("limit", "offset") else float(value))
        elif word in ("order", "sort"):
            while True:
                down = self.take("-")
                if not down:
                    self.take("+")
                p.order.append((self.out_arg(), down))
                if not self.take(","):
                    break
        elif word == "returning":
            p.returning = True
        elif word == "assert":
            p.assertion = self.name()
            if p.assertion not in ("none", "some"):
                self.fail("expected none or some")
        elif word == "disable_magic_rewrite":
            p.magic = not constant(self.expr())
        elif word in MUTATIONS:
            if p.relation:
                raise EngineError("parser", "a program changes one relation at most")
            p.relation = ir.RelationOp(word, self.name())
            if self.take("{"):
                p.relation.keys, p.relation.values = self.listed("}", self.column, ("=>",)), []
                if self.take("=>"):
                    p.relation.values = self.listed("}", self.column)
        else:
            self.fail(f"unknown option :{word}")
        self.take(";")

    def program(self, close: str | None = None) -> ir.Program:
        p, start = ir.Program(), self.now.start
        while self.now.kind != "end" and not (close and self.at(close)):
            if self.at(":"):
                self.program_option(p)
            else:
                p.rules.append(self.rule())
        p.text = self.text[start : self.now.start]
        if not p.rules and not p.relation:
            self.fail("a program has a rule")
        return p

    # --- system operations: (name, arguments)

    def options(self) -> dict[str, ir.Expr]:
        self.need("{")
        return dict(self.listed("}", self.option))

    def system(self, close: str | None = None):
        self.need("::")
        word = self.name()
        if word in ("relations", "running", "fixed_rules", "compact"):
            out = (word,)
        elif word in ("columns", "indices", "show_triggers"):
            out = (word, self.index_name())
        elif word == "remove":
            names = [self.name()]
            while self.take(","):
                names.append(self.name())
            out = (word, names)
        elif word == "rename":
            pairs = []
            while True:
                old = self.name()
                self.need("->")
                pairs.append((old, self.name()))
                if not self.take(","):
                    break
            out = (word, pairs)
        elif word == "access_level":
            level, names = self.name(), [self.name()]
            while self.take(","):
                names.append(self.name())
            out = (word, level, names)
        elif word == "kill":
            out = (word, self.expr())
        elif word == "explain":
            self.need("{")
            out = (word, self.program("}"))
            self.need("}")
        elif word == "set_triggers":
            name, clauses = self.name(), []
            while self.take("on"):
                event = self.name()
                if event not in ("put", "rm", "replace"):
                    self.fail("expected put, rm or replace")
                self.need("{")
                clauses.append((event, self.program("}").text))
                self.need("}")
            out = (word, name, clauses)
        elif word in ("index", "hnsw", "fts", "lsh"):
            verb = self.name()
            relation, _, index = self.index_name().rpartition(":")
            if verb == "drop":
                out = (word, "drop", relation, index)
            else:
                if verb != "create":
                    self.fail("expected create or drop")
                if word == "index":
                    self.need("{")
                    out = (word, "create", relation, index, self.listed("}", self.name))
                else:
                    out = (word, "create", relation, index, self.options())
        else:
            self.fail(f"unknown operation ::{word}")
        return out

    # --- imperative scripts: nested tuples

    def block_item(self):
        self.need("{")
        inner = ("sys", self.system()) if self.at("::") else ("query", self.program("}"))
        self.need("}")
        name = self.name() if self.take("as") else None
        return (*inner, name)

    def condition(self):
        return self.block_item() if self.at("{") else ("relation", self.name())

    def statement(self):
        if self.at("{"):
            return self.block_item()
        self.need("%")
        word = self.name()
        if word in ("if", "if_not"):
            cond = self.condition()
            if self.at("%") and self.peek().text == "then":
                self.i += 2
            yes, no = self.block("else", "end"), []
            self.need("%")
            if self.name() == "else":
                no = self.block("end")
                self.need("%")
                self.need("end")
            return ("if", cond, word == "if_not", yes, no)
        if word == "mark":
            label = self.name()
            self.need("%")
            self.need("loop")
            word = "loop"
        else:
            label = None
        if word == "loop":
            inner = self.block("end")
            self.need("%")
            self.need("end")
            return ("loop", label, inner)
        if word in ("break", "continue"):
            return (word, self.name() if self.now.kind == "name" else None)
        if word == "return":
            out = []
            while self.now.kind == "name" or self.at("{"):
                out.append(self.condition())
                if not self.take(","):
                    break
            return ("return", out)
        if word == "swap":
            return ("swap", self.name(), self.name())
        if word == "debug":
            return ("debug", self.name())
        if word == "ignore_error":
            return ("ignore_error", self.block_item())
        self.fail(f"unknown statement %{word}")

    def block(self, *ends: str) -> list:
        out = []
        while not (self.at("%") and self.peek().text in ends) and self.now.kind != "end":
            out.append(self.statement())
        return out

    def script(self):
        """("sys", operation), ("imperative", statements) or ("query", program)."""
        if self.at("::"):
            out = ("sys", self.system())
        elif self.at("{", "%"):
            out = ("imperative", self.block())
        else:
            out = ("query", self.program())
        if self.now.kind != "end":
            self.fail("expected the end")
        return out


def as_literal(value: Any) -> ir.Expr:
    """A Python value as an expression; lists stay lists."""
    if isinstance(value, (list, tuple)):
        return ir.Items(tuple(as_literal(v) for v in value))
    if isinstance(value, dict):
        return ir.Obj(tuple((ir.Lit(str(k)), as_literal(v)) for k, v in value.items()))
    return ir.Lit(value)


def constant(e: ir.Expr) -> Any:
    """The value of an expression without variables, as far as programs need one before they run."""
    if isinstance(e, ir.Lit):
        return e.value
    if isinstance(e, ir.Items):
        return [constant(x) for x in e.args]
    if isinstance(e, ir.Obj):
        return {constant(k): constant(v) for k, v in e.pairs}
    if isinstance(e, ir.Call):
        args = [constant(x) for x in e.args]
        simple = {"add": lambda *a: sum(a), "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "minus": lambda a: -a, "concat": lambda *a: "".join(a) if a and isinstance(a[0], str) else [x for y in a for x in y], "pow": lambda a, b: float(a) ** b, "mod": lambda a, b: a % b, "negate": lambda a: not a}
        if e.name in simple:
            return simple[e.name](*args)
    raise EngineError("eval", f"not a constant: {e}")


def parse(text: str, params: dict[str, Any] | None = None):
    return Parser(text, params).script()


def parse_expression(text: str, params: dict[str, Any] | None = None) -> ir.Expr:
    p = Parser(text, params)
    out = p.expr()
    if p.now.kind != "end":
        p.fail("expected the end")
    return out
