"""Lexer and recursive-descent parser of the dialect.

Keywords ignore case.  Quoted text keeps its type; a doubled quote stands for one.
Besides the dialect's single conditions, AND, OR, NOT and parentheses combine
ordinary ones (IN lists, LIKE and IS NULL among them), INSERT takes several rows,
and SELECT takes COUNT(*), ORDER BY, LIMIT and OFFSET.
"""

from __future__ import annotations

import re
from typing import Any

from quarry.functions.wkt import bounds
from quarry.plans import ast
from quarry.types import QuarryError, index_kind, parse_type

_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<number>[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?)|(?P<word>[^\W\d][\w.+-]*)|(?P<op><>|!=|<=|>=|[<>=(),;*]))""")
_WKT = ("POINT", "POLYGON", "LINESTRING", "MULTIPOINT", "MULTIPOLYGON", "MULTILINESTRING")


class _Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, at = sql, [], 0
        end = len(sql.rstrip())
        while at < end:
            m = _TOKEN.match(sql, at)
            if not m:
                raise QuarryError(f"not recognised at: {sql[at : at + 30]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.at = 0

    # tokens
    def peek(self, ahead: int = 0) -> tuple[str, str, int]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "", len(self.sql))

    def take(self) -> tuple[str, str, int]:
        out = self.peek()
        self.at += 1
        return out

    def see(self, *words: str) -> bool:
        """Takes the words if they come next."""
        for i, w in enumerate(words):
            kind, text, _ = self.peek(i)
            if kind == "text" or text.upper() != w:
                return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.see(*words):
            raise QuarryError(f"expected {' '.join(words)} at: {self.sql[self.peek()[2] :][:30]!r}")

    def name(self) -> str:
        kind, text, _ = self.take()
        if kind == "text":
            return text[1:-1]
        if kind != "word":
            raise QuarryError(f"expected a name, found {text!r}")
        return text

    def text(self) -> str:
        kind, text, _ = self.take()
        if kind != "text":
            raise QuarryError(f"expected quoted text, found {text!r}")
        return text[1:-1].replace(text[0] * 2, text[0])

    def integer(self) -> int:
        kind, text, _ = self.take()
        if kind != "number" or not re.fullmatch(r"\d+", text):
            raise QuarryError(f"expected a whole number, found {text!r}")
        return int(text)

    def number(self) -> float:
        kind, text, _ = self.take()
        if kind != "number":
            raise QuarryError(f"expected a number, found {text!r}")
        return float(text)

    def limit(self, default: int | None) -> int | None:
        return self.integer() if self.see("LIMIT") else default

    # values
    def wkt(self) -> str | None:
        """A bare geometry such as POINT(1 2), as text."""
        kind, word, start = self.peek()
        if kind != "word" or word.upper() not in _WKT or self.peek(1)[1] != "(":
            return None
        self.take()
        depth = 0
        while True:
            kind, text, at = self.take()
            if kind == "end":
                raise QuarryError("unclosed geometry")
            depth += (text == "(") - (text == ")")
            if not depth:
                return self.sql[start : at + 1]

    def value(self) -> Any:
        if (geometry := self.wkt()) is not None:
            return geometry
        kind, text, _ = self.peek()
        if kind == "text":
            return self.text()
        if kind == "number":
            self.take()
            return int(text) if re.fullmatch(r"[-+]?\d+", text) else float(text)
        if text == "(":
            x, y = self.point()
            return f"POINT({x:g} {y:g})"
        word = self.name()
        return {"null": None, "true": True, "false": False}.get(word.lower(), word)

    def values(self) -> tuple[Any, ...]:
        """Values in parentheses."""
        self.need("(")
        out = [self.value()]
        while self.see(","):
            out.append(self.value())
        self.need(")")
        return tuple(out)

    def is_radius(self) -> bool:
        """Whether IN is followed by a point and a radius, rather than by plain values."""
        return self.peek(1)[1] == "(" and (self.peek(2)[1] == "(" or (self.peek(2)[0] == "word" and self.peek(2)[1].upper() in _WKT) or (self.peek(2)[0] == "text" and re.match(r".\s*POINT\s*\(", self.peek(2)[1], re.I) is not None))

    def point(self) -> tuple[float, float]:
        geometry = self.wkt() or (self.text() if self.peek()[0] == "text" else None)
        if geometry:
            x0, y0, x1, y1 = bounds(geometry)
            if (x0, y0) != (x1, y1):
                raise QuarryError(f"not a point: {geometry}")
            return x0, y0
        if self.see("("):
            x = self.number()
            self.see(",")
            y = self.number()
            self.need(")")
            return x, y
        return self.number(), self.number()

    def box(self) -> tuple[float, float, float, float]:
        geometry = self.wkt() or (self.text() if self.peek()[0] == "text" else None)
        if geometry:
            return bounds(geometry)
        self.need("(")
        xs = [self.number()]
        while self.see(","):
            xs.append(self.number())
        self.need(")")
        if len(xs) == 2:
            xs *= 2
        if len(xs) != 4:
            raise QuarryError("a box has four numbers")
        return min(xs[0], xs[2]), min(xs[1], xs[3]), max(xs[0], xs[2]), max(xs[1], xs[3])

    # predicates
    def either(self) -> Any:
        left = self.both()
        while self.see("OR"):
            left = ast.Or(left, self.both())
        return left

    def both(self) -> Any:
        left = self.one()
        while self.see("AND"):
            left = ast.And(left, self.one())
        return left

    def one(self) -> Any:
        if self.see("NOT"):
            return ast.Not(self.one())
        if self.see("("):
            inner = self.either()
            self.need(")")
            return inner
        column = self.name()
        if self.see("SIMILAR", "TO"):
            return ast.SimilarTo(column, self.text(), self.limit(5))
        if self.see("CONTAINS"):
            return ast.Contains(column, self.text(), self.limit(None))
        if self.see("PHRASE"):
            return ast.Phrase(column, self.text())
        if self.see("RANKED", "BY"):
            return ast.RankedBy(column, self.text(), self.limit(5))
        if self.see("IS", "NULL"):
            return ast.IsNull(column)
        if self.see("IS", "NOT", "NULL"):
            return ast.Not(ast.IsNull(column))
        if self.see("NOT", "IN"):
            return ast.Not(ast.IsIn(column, self.values()))
        if self.see("NOT", "LIKE"):
            return ast.Not(ast.Like(column, self.text()))
        if self.see("LIKE"):
            return ast.Like(column, self.text())
        if self.peek()[1].upper() == "IN" and not self.is_radius():
            self.need("IN")
            return ast.IsIn(column, self.values())
        if self.see("WITHIN") or self.see("IN"):
            self.need("(")
            point = self.point()
            self.need(",")
            radius = self.number()
            self.need(")")
            return ast.Within(column, point, radius)
        if self.see("INTERSECTS"):
            return ast.Intersects(column, self.box())
        if self.see("NEAREST"):
            return ast.Nearest(column, self.point(), self.limit(1))
        if self.see("IN_RANGE"):
            self.need("(")
            a = self.point()
            self.need(",")
            b = self.point()
            self.need(")")
            return ast.InRange(column, (min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])))
        if self.see("BETWEEN"):
            low = self.value()
            self.need("AND")
            return ast.Between(column, low, self.value())
        op = self.take()[1]
        if op not in ("=", "!=", "<>", "<", ">", "<=", ">="):
            raise QuarryError(f"unknown condition on {column}: {op!r}")
        return ast.Compare(column, "!=" if op == "<>" else op, self.value())

    # statements
    def statement(self) -> Any:
        out = self._statement()
        self.see(";")
        if self.peek()[0] != "end":
            raise QuarryError(f"not recognised at: {self.sql[self.peek()[2] :][:30]!r}")
        return out

    def _statement(self) -> Any:
        if self.see("GET_LEN"):
            self.need("(")
            table = self.name()
            self.need(")")
            return ast.Count(table)
        if self.see("DROP", "TABLE"):
            return ast.DropTable(self.name())
        if self.see("CREATE", "TABLE"):
            return self.create()
        for kind in ("INVERTED", "SPATIAL", "MULTIMEDIA"):
            if self.see("CREATE", kind, "INDEX"):
                return self.index(kind.lower())
        if self.see("SELECT"):
            return self.select()
        if self.see("INSERT", "INTO"):
            table = self.name()
            self.need("VALUES")
            rows = [self.values()]
            while self.see(","):
                rows.append(self.values())
            return ast.Insert(table, tuple(rows))
        if self.see("DELETE", "FROM"):
            table = self.name()
            self.need("WHERE")
            column = self.name()
            self.need("=")
            return ast.Delete(table, column, self.value())
        raise QuarryError(f"statement not recognised: {self.sql.strip()[:60]!r}")

    def create(self) -> Any:
        table = self.name()
        if self.see("FROM", "FILE"):
            path = self.text()
            self.need("USING", "INDEX")
            kind = index_kind(self.name())
            self.need("(")
            key = self.name()
            self.need(")")
            return ast.LoadTable(table, path, kind, key)
        self.need("(")
        columns = [self.column()]
        while self.see(","):
            columns.append(self.column())
        self.need(")")
        names = [c.name for c in columns]
        if len(set(names)) < len(names):
            raise QuarryError("a column name is given twice")
        flagged = next((c for c in columns if c.key), columns[0])
        key, kind = flagged.name, flagged.index if flagged.key and flagged.index else "sequential"
        if self.see("USING", "INDEX"):
            kind = index_kind(self.name())
            self.need("(")
            key = self.name()
            self.need(")")
        if key not in names:
            raise QuarryError(f"no such column: {key}")
        return ast.CreateTable(table, tuple(columns), key, kind)

    def column(self) -> ast.ColumnDef:
        name, text = self.name(), self.name()
        if self.see("("):
            text += f"({self.integer()})"
            self.need(")")
        key, index, spatial = False, None, False
        while True:
            if self.see("KEY"):
                key = True
            elif self.see("SPATIAL", "INDEX"):
                spatial = True
            elif self.see("INDEX"):
                index = index_kind(self.name())
            else:
                return ast.ColumnDef(name, parse_type(text), key, index, spatial)

    def index(self, kind: str) -> ast.CreateIndex:
        name = self.name()
        self.need("ON")
        table = self.name()
        self.need("(")
        column = self.name()
        self.need(")")
        options = {}
        if kind == "multimedia":
            self.need("WITH", "TYPE")
            options["media"] = self.name().lower()
            options["method"] = self.name().lower() if self.see("METHOD") else "sift"
            if self.see("TRAIN", "FROM"):
                options["train"] = self.text()
        return ast.CreateIndex(kind, name, table, column, options)

    def select(self) -> ast.Select:
        top = self.integer() if self.see("TOP") else None
        columns, count = None, False
        if self.see("COUNT"):
            self.need("(")
            self.need("*")
            self.need(")")
            count = True
        elif not self.see("*") and not (top is not None and self.peek()[1].upper() == "FROM"):
            columns = [self.name()]
            while self.see(","):
                columns.append(self.name())
        self.need("FROM")
        table = self.name()
        where = self.either() if self.see("WHERE") else None
        order = []
        if self.see("ORDER", "BY"):
            order.append((self.name(), self.direction()))
            while self.see(","):
                order.append((self.name(), self.direction()))
        limit = self.limit(None)
        return ast.Select(table, tuple(columns) if columns else None, top, where, limit, count, tuple(order), self.integer() if self.see("OFFSET") else 0)

    def direction(self) -> bool:
        """Whether DESC comes next; ASC is the same as nothing."""
        return self.see("DESC") or (self.see("ASC") and False)


def parse(sql: str) -> Any:
    """The statement that sql holds; QuarryError if it holds none."""
    return _Parser(sql).statement()
