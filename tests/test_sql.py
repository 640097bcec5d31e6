import random

import pytest

from pyspark.sql import functions as F

from tessella.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, ParseError
from tessella.operators import predicate as P
from tessella.plans.lexer import tokenize
from tessella.plans.parser import parse
from tessella.schema import Column, DocumentSchema, SeriesSchema, TableSchema
from tessella.session import Session

USERS = [("Alice", 30), ("Bob", 22), ("Carol", 40)]


@pytest.fixture
def db(spark):
    s = Session(spark)
    s.tables.create("users", TableSchema([Column("name", "string", nullable=False), Column("age", "int", nullable=False)]))
    s.tables.insert("users", USERS)
    s.tables.create("metrics", TableSchema([Column(n, "int", nullable=False) for n in ("timestamp", "sensor_id", "value")]))
    s.tables.insert("metrics", [(100 + 5 * i, 1, 10 * (i + 1)) for i in range(6)])
    return s


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_parse_round_trip_and_errors():
    for q in ["SELECT * FROM t", "select a, b from t where x = 'it\\'s' or not y >= 1.5;", "INSERT INTO t VALUES (1, 'a')", "UPDATE t SET a = b * (c + 2) WHERE NOT NOT a BETWEEN 1 AND 3", "DELETE FROM t WHERE a = -1"]:
        assert str(parse(str(parse(q)))) == str(parse(q))
    for q in ["SELECT FROM t", "", "SELECT a FROM", "SELECT a b FROM t", "INSERT INTO t (a, b) VALUES (1)", "SELECT a FROM t WHERE a <> 1", "SELECT 'x FROM t", "SELECT 1.2.3 FROM t", "SELECT 99999999999999999999 FROM t", "DROP TABLE t"]:
        with pytest.raises(ParseError):
            parse(q)
    with pytest.raises(ParseError) as e:
        parse("SELECT a\nFROM t WHERE %")
    assert (e.value.line, e.value.column) == (2, 14)
    assert [t.kind for t in tokenize("a 1 'x' =")] == ["name", "number", "string", "op", "end"]


@pytest.mark.parametrize(
    "where, names",
    [
        ("age = 22 OR age = 22", ["Bob"]), ("NOT NOT age = 22", ["Bob"]), ("NOT (age < 40 OR name = 'x')", ["Carol"]), ("(NOT (1 < 2)) AND age = 22", []),
        ("(1 < 2) OR age = 22", ["Alice", "Bob", "Carol"]), ("age BETWEEN 22 AND 30", ["Alice", "Bob"]), ("30 <= age", ["Alice", "Carol"]), ("age > 'a'", []), ("name > 5", ["Alice", "Bob", "Carol"]), ("age = 30.0", ["Alice"]), ("age >= -1", ["Alice", "Bob", "Carol"]),
    ],
)
def test_where(db, where, names):
    assert sorted(r[0] for r in rows(db.sql(f"SELECT name FROM users WHERE {where}"))) == names


@pytest.mark.parametrize("text", ["SELECT nope FROM users", "SELECT name FROM users WHERE nope = 1", "SELECT name FROM users WHERE age = age", "SELECT name FROM users WHERE age + 1 = 2", "SELECT name FROM users WHERE age", "SELECT COUNT(age) FROM users", "SELECT FIRST(age) + 1 FROM users", "SELECT TIME_BUCKET(age, 0) FROM users", "SELECT TIME_BUCKET(age) FROM users", "SELECT FIRST(age, age, age) FROM users", "UPDATE users SET nope = 1", "UPDATE users SET age = age / 2", "INSERT INTO users (name, nope) VALUES ('x', 1)", "INSERT INTO users (name, age) VALUES ('x', age)", "INSERT INTO users (name) VALUES ('x')", "SELECT name - 1 FROM users"])
def test_invalid(db, text):
    with pytest.raises(InvalidArgument):
        db.sql(text)
    with pytest.raises(NotFound):
        db.sql("SELECT * FROM missing")


def test_projection_names_and_values(db):
    df = db.sql("SELECT name, age + 1, age * 2 AS twice, name + '_' + age AS tag, age > 25 AS old, NOT age AS none FROM users WHERE name = 'Alice'")
    assert df.columns == ["name", "expr", "twice", "tag", "old", "none"]
    assert rows(df) == [("Alice", 31, 60, "Alice_30", True, False)]


def test_update_sequence(db):
    for text, want in [("age + 1", 31), ("(age * 2) - 5", 57)]:
        assert rows(db.sql(f"UPDATE users SET age = {text} WHERE name = 'Alice'")) == [(1, "updated")]
        assert rows(db.sql("SELECT age FROM users WHERE name = 'Alice'")) == [(want,)]
    db.sql("UPDATE users SET name = name + '_2025' WHERE name = 'Alice'")
    assert rows(db.sql("SELECT age FROM users WHERE name = 'Alice_2025'")) == [(57,)]
    with pytest.raises(Exception):
        db.sql("UPDATE users SET name = name + (age / 0)")
    assert rows(db.sql("DELETE FROM users WHERE age > 25")) == [(2, "deleted")]
    assert rows(db.sql("DELETE FROM users")) == [(1, "deleted")] and rows(db.sql("SELECT * FROM users")) == []


def test_aggregates(db):
    assert rows(db.sql("SELECT TIME_BUCKET(timestamp, 10) AS t FROM metrics")) == [(100,), (110,), (120,)]
    assert rows(db.sql("SELECT FIRST(value) AS a, LAST(value, timestamp) AS b FROM metrics")) == [(10, 60)]
    got = rows(db.sql("SELECT TIME_BUCKET(timestamp, 10), FIRST(value, timestamp), LAST(value), sensor_id FROM metrics WHERE timestamp >= 110"))
    assert got == [(110, 30, 40, 1), (120, 50, 60, 1)]
    assert rows(db.sql("SELECT FIRST(value) FROM metrics WHERE value < 0")) == []


def test_insert_constraints(spark):
    s = Session(spark)
    s.tables.create("t", TableSchema([Column("id", "int", nullable=False, unique=True), Column("s", "string", min_length=2, max_length=4, one_of=("ok", "warn")), Column("x", "float", min_value=0)], primary_key="id"))
    with pytest.raises(AlreadyExists):
        s.tables.create("t", TableSchema([]))
    assert rows(s.sql("INSERT INTO t (id, s, x) VALUES (1, 'ok', 1), (2, 'warn', 2.5)")) == [(2, "inserted")]
    s.sql("INSERT INTO t (id) VALUES (3)")
    for text, error in [("(1, 'ok', 1)", FailedPrecondition), ("(4, 'toolong', 1)", InvalidArgument), ("(4, 'no', 1)", InvalidArgument), ("(4, 'ok', -1)", InvalidArgument), ("('x', 'ok', 1)", InvalidArgument), ("(9, 'ok', 1), (9, 'ok', 1)", FailedPrecondition)]:
        with pytest.raises(error):
            s.sql(f"INSERT INTO t (id, s, x) VALUES {text}")
    assert sorted(rows(s.tables.select("t", ["id", "x"]))) == [(1, 1.0), (2, 2.5), (3, None)]
    with pytest.raises(FailedPrecondition):
        s.sql("UPDATE t SET id = 7")
    assert s.tables.update("t", {"s": "ok", "x": F.col("x") * 2}, P.cmp("id", "=", 2)) == 1
    assert s.tables.update_with("t", lambda f: f.assign(x=f.x + 1), P.cmp("id", "<", 3)) == 2
    assert sorted(rows(s.tables.select("t", ["id", "s", "x"]))) == [(1, "ok", 2.0), (2, "ok", 6.0), (3, None, None)]
    assert s.tables.delete("t", P.negation(P.cmp("x", ">", 3))) == 2
    s.tables.truncate("t")
    assert s.tables.names() == ["t"] and s.tables.table("t").count() == 0
    s.tables.drop("t")
    with pytest.raises(NotFound):
        s.tables.drop("t")


def test_read_only_session(db, spark):
    s = Session(spark, "read")
    with pytest.raises(InvalidArgument):
        s.sql("DELETE FROM users")


def evaluate(p, row):
    if isinstance(p, P.Cmp):
        v = row.get(p.column)
        if v is None or p.value is None:
            return False
        return {"=": v == p.value, "!=": v != p.value, "<": v < p.value, "<=": v <= p.value, ">": v > p.value, ">=": v >= p.value}[p.op]
    if isinstance(p, P.And):
        return all(evaluate(x, row) for x in p.parts)
    if isinstance(p, P.Or):
        return any(evaluate(x, row) for x in p.parts)
    return p.part is not None and not evaluate(p.part, row)


def random_predicate(r, depth=3):
    if depth == 0 or r.random() < 0.3:
        return P.cmp(r.choice(["a", "b", "missing"]), r.choice(["=", "!=", "<", "<=", ">", ">="]), r.choice([0, 1, 2, 1.5, None]))
    kind = r.randrange(3)
    parts = [random_predicate(r, depth - 1) for _ in range(r.randrange(0, 3))]
    return P.negation(parts[0] if parts else None) if kind == 2 else (P.all_of, P.any_of)[kind](*parts)


def test_predicates_against_model(spark):
    r = random.Random(1)
    data = [{"i": i, "a": r.choice([None, 0, 1, 2]), "b": r.choice([None, 0.5, 1.0, 1.5])} for i in range(40)]
    df = spark.createDataFrame([(d["i"], d["a"], d["b"]) for d in data], "i long, a long, b double")
    preds = [random_predicate(r) for _ in range(120)]
    got = df.select("i", *[P.to_column(p, df.schema).alias(f"p{k}") for k, p in enumerate(preds)]).collect()
    for row in got:
        assert [*row][1:] == [evaluate(p, data[row.i]) for p in preds]


def test_schemas():
    t = TableSchema([Column("a", "int"), Column("b", "string", max_length=3, one_of=("x",))], "a")
    t.add(Column("c", "bool"))
    t.update(Column("c", "float"))
    with pytest.raises(AlreadyExists):
        t.add(Column("c", "bool"))
    again = TableSchema.of_json(t.json())
    assert again.columns == t.columns and again.primary_key == "a"
    t.remove("a")
    assert t.primary_key is None and t.names == ["b", "c"]
    for broken in (lambda: t.get("zz"), lambda: t.remove("zz")):
        with pytest.raises(NotFound):
            broken()
    with pytest.raises(InvalidArgument):
        t.set_primary_key("zz")
    d = DocumentSchema([Column("a", "int")])
    d.add(Column("a", "string"))
    assert d.get("a").kind == "string"
    d.remove("a")
    s = SeriesSchema(values=[Column("v", "float")])
    s.add_tag(Column("t", "int"))
    assert s.table().names == ["timestamp", "t", "v"]
    s.remove("t")
    with pytest.raises(NotFound):
        s.get("t")
