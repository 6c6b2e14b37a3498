import pytest

from quarry.plans import ast
from quarry.plans.parser import parse
from quarry.types import QuarryError


@pytest.mark.parametrize(
    "sql, kind",
    [
        ("CREATE TABLE R (id INT KEY INDEX SEQ, n VARCHAR(20) INDEX BTree, d DATE, u POINT SPATIAL INDEX)", ast.CreateTable),
        ("create table t from file 'x.csv' using index hash(\"id\")", ast.LoadTable),
        ("CREATE INVERTED INDEX i ON t (c)", ast.CreateIndex),
        ("CREATE MULTIMEDIA INDEX i ON t (c) WITH TYPE image METHOD sift TRAIN FROM 'd'", ast.CreateIndex),
        ("DROP TABLE t;", ast.DropTable),
        ("get_len(t)", ast.Count),
        ("DELETE FROM t WHERE id = 3", ast.Delete),
    ],
)
def test_statements(sql, kind):
    assert isinstance(parse(sql), kind)


@pytest.mark.parametrize(
    "where, predicate",
    [
        ("a <> 'x'", ast.Compare("a", "!=", "x")),
        ("a BETWEEN 1 AND 2.5", ast.Between("a", 1, 2.5)),
        ("u WITHIN ((0, 1.5), 10)", ast.Within("u", (0.0, 1.5), 10.0)),
        ("u IN ((0,-1),10)", ast.Within("u", (0.0, -1.0), 10.0)),
        ("u INTERSECTS 'POLYGON((0 0, 2 0, 2 3, 0 0))'", ast.Intersects("u", (0.0, 0.0, 2.0, 3.0))),
        ("u NEAREST POINT(1 2) LIMIT 3", ast.Nearest("u", (1.0, 2.0), 3)),
        ("u IN_RANGE ((3,4),(1,2))", ast.InRange("u", (1.0, 2.0, 3.0, 4.0))),
        ("x RANKED BY 'a b'", ast.RankedBy("x", "a b", 5)),
        ("x CONTAINS 'a AND b' LIMIT 2", ast.Contains("x", "a AND b", 2)),
        ("i SIMILAR TO 'p.png'", ast.SimilarTo("i", "p.png", 5)),
    ],
)
def test_predicates(where, predicate):
    assert parse(f"SELECT * FROM t WHERE {where}").where == predicate


def test_literals_keep_their_type():
    assert parse("INSERT INTO t VALUES ('123', 'it''s', null, true, (3,4), -2.5, '')").values == ("123", "it's", None, True, "POINT(3 4)", -2.5, "")


@pytest.mark.parametrize("sql", ["SELEC * FROM t", "SELECT * FROM", "CREATE TABLE t (a VIDEO)", "CREATE TABLE t (a VARCHAR)", "CREATE TABLE t (a INT, a INT)", "CREATE TABLE t (a INT) USING INDEX nope(a)", "SELECT * FROM t WHERE a ? 1"])
def test_errors(sql):
    with pytest.raises(QuarryError):
        parse(sql)


def test_lists_order_and_rows():
    s = parse("SELECT a FROM t WHERE a IN (1, 2) AND b NOT LIKE 'x%' AND c IS NOT NULL ORDER BY a DESC, b LIMIT 3 OFFSET 6")
    assert s.order == (("a", True), ("b", False)) and (s.limit, s.offset) == (3, 6)
    assert s.where.left.left == ast.IsIn("a", (1, 2)) and s.where.right == ast.Not(ast.IsNull("c"))
    assert isinstance(parse("SELECT a FROM t WHERE g IN ((1, 2), 3)").where, ast.Within)
    assert isinstance(parse("SELECT a FROM t WHERE g IN (POINT(1 2), 3)").where, ast.Within)
    assert parse("INSERT INTO t VALUES (1, 'a'), (2, 'b')").rows == ((1, "a"), (2, "b"))
