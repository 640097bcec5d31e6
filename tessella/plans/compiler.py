"""From statements to DataFrame plans.

WHERE has SQL's three-valued logic, so that Catalyst's own rules fold literals,
push NOT inwards and merge ranges; expressions in SELECT and SET are two-valued
and ordered across kinds.  Only the kinds of a table's columns are looked at,
never its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidArgument
from tessella.functions.scalar import INVERTED, MIRRORED, OPS, RANK, arithmetic, compared, kind_of_type, kind_of_value, literal, numeric, ordered, truth
from tessella.plans.ast import Between, Binary, Call, Item, Literal, Name, Negation, Select
from tessella.plans.parser import signed

AGGREGATES = ("TIME_BUCKET", "FIRST", "LAST")
#: The hidden column of the order in which rows came.
SEQ = "__seq"


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != SEQ]


def _column(df: DataFrame, name: str) -> tuple[Column, str]:
    if name not in visible(df):
        raise InvalidArgument(f"unknown column {name}")
    kind = kind_of_type(df.schema[name].dataType)
    if kind is None:
        raise InvalidArgument(f"column {name} is no scalar")
    return F.col(f"`{name}`"), kind


def condition(expr, df: DataFrame) -> Column:
    """A WHERE clause: comparisons of a column and a literal, or of two literals."""
    if isinstance(expr, Negation):
        return ~condition(expr.part, df)
    if isinstance(expr, Binary) and expr.op in ("AND", "OR"):
        a, b = condition(expr.left, df), condition(expr.right, df)
        return a & b if expr.op == "AND" else a | b
    if isinstance(expr, Between):
        value, low, high = expr.value, signed(expr.low), signed(expr.high)
        if not (isinstance(value, Name) and isinstance(low, Literal) and isinstance(high, Literal)):
            raise InvalidArgument("BETWEEN takes a column and two literals")
        return condition(Binary(">=", value, low), df) & condition(Binary("<=", value, high), df)
    if isinstance(expr, Binary) and expr.op in OPS:
        left, right, op = signed(expr.left), signed(expr.right), expr.op
        if isinstance(left, Literal) and isinstance(right, Literal):
            return F.lit(_folded(left.value, op, right.value))
        if isinstance(left, Literal) and isinstance(right, Name):
            left, right, op = right, left, MIRRORED[op]
        if isinstance(left, Name) and isinstance(right, Literal):
            column, kind = _column(df, left.name)
            return ordered(column, kind, op, literal(right.value), kind_of_value(right.value))
    raise InvalidArgument(f"WHERE does not take {expr}")


def unmet(expr, df: DataFrame, is_true: bool = True) -> Column:
    """Where a WHERE clause is not true (or, with ``is_true`` false, not false):
    comparisons and IS NULL without a NOT around them, which a scan can take."""
    if isinstance(expr, Negation):
        return unmet(expr.part, df, not is_true)
    if isinstance(expr, Binary) and expr.op in ("AND", "OR"):
        a, b = unmet(expr.left, df, is_true), unmet(expr.right, df, is_true)
        return a | b if (expr.op == "AND") == is_true else a & b
    if isinstance(expr, Between):
        return unmet(Binary("AND", Binary(">=", expr.value, expr.low), Binary("<=", expr.value, expr.high)), df, is_true)
    if isinstance(expr, Binary) and expr.op in OPS:
        left, right, op = signed(expr.left), signed(expr.right), expr.op
        if isinstance(left, Literal) and isinstance(right, Literal):
            return F.lit(_folded(left.value, op, right.value) != is_true)
        name = left if isinstance(left, Name) else right
        met = condition(Binary(INVERTED[op] if is_true else op, left, right), df)
        return _column(df, name.name)[0].isNull() | met
    raise InvalidArgument(f"WHERE does not take {expr}")


def _folded(a, op, b) -> bool:
    ka, kb = kind_of_value(a), kind_of_value(b)
    if ka == kb or numeric(ka) and numeric(kb):
        return bool(OPS[op](a.encode(), b.encode()) if ka == "string" else OPS[op](a, b))
    return bool(OPS[op](RANK[ka], RANK[kb]))


def expression(expr, scope) -> tuple[Column, str]:
    """A value in SELECT or SET; ``scope`` gives (column, kind) of a name."""
    expr = signed(expr)
    if isinstance(expr, Literal):
        return literal(expr.value), kind_of_value(expr.value)
    if isinstance(expr, Name):
        return scope(expr.name)
    if isinstance(expr, Negation):
        return ~truth(*expression(expr.part, scope)), "bool"
    if isinstance(expr, Binary):
        (a, ka), (b, kb) = expression(expr.left, scope), expression(expr.right, scope)
        if expr.op in ("AND", "OR"):
            a, b = truth(a, ka), truth(b, kb)
            return (a & b if expr.op == "AND" else a | b), "bool"
        if expr.op in OPS:
            return compared(a, ka, expr.op, b, kb), "bool"
        return arithmetic(expr.op, a, ka, b, kb)
    raise InvalidArgument(f"unsupported expression {expr}")


def scope_of(df: DataFrame):
    return lambda name: _column(df, name)


def output_name(item: Item) -> str:
    if item.alias:
        return item.alias
    if isinstance(item.expr, Name):
        return item.expr.name
    return item.expr.name.lower() if isinstance(item.expr, Call) else "expr"


def _is_aggregate(item: Item) -> bool:
    return isinstance(item.expr, Call) and item.expr.name.upper() in AGGREGATES


def select(statement: Select, df: DataFrame) -> DataFrame:
    source = df
    if statement.where is not None:
        df = df.where(condition(statement.where, df))
    if statement.items is None:
        return df.select(*[f"`{c}`" for c in visible(df)])
    if any(map(_is_aggregate, statement.items)):
        return _aggregate(statement.items, df)
    out = []
    for item in statement.items:
        if isinstance(item.expr, Name):
            if item.expr.name not in visible(source):
                raise InvalidArgument(f"unknown column {item.expr.name}")
            column = F.col(f"`{item.expr.name}`")
        else:
            column, _ = expression(item.expr, scope_of(source))
        out.append(column.alias(output_name(item)))
    return df.select(*out)


def time_bucket(call: Call, scope) -> Column:
    """(ts div n) * n, truncating toward zero."""
    width = signed(call.args[1]) if len(call.args) == 2 else None
    if width is None or not isinstance(width, Literal) or isinstance(width.value, str):
        raise InvalidArgument("TIME_BUCKET takes an expression and a number")
    if int(width.value) <= 0:
        raise InvalidArgument("TIME_BUCKET needs a positive width")
    ts, kind = expression(call.args[0], scope)
    if kind not in ("int", "bool"):
        raise InvalidArgument("TIME_BUCKET needs whole numbers")
    n = F.lit(int(width.value)).cast("bigint")
    ts = ts.cast("bigint")
    return (ts - ts % n).cast("bigint")


def _aggregate(items, df: DataFrame) -> DataFrame:
    """Groups by the last TIME_BUCKET, or all rows as one group (none, if there are no rows)."""
    scope = scope_of(df)
    buckets = [i.expr for i in items if isinstance(i.expr, Call) and i.expr.name.upper() == "TIME_BUCKET"]
    key = time_bucket(buckets[-1], scope) if buckets else F.lit(0).cast("bigint")
    for call in buckets[:-1]:
        time_bucket(call, scope)
    if SEQ not in df.columns:
        df = df.withColumn(SEQ, F.monotonically_increasing_id())
    aggregates, names = [], []
    for n, item in enumerate(items):
        call = item.expr
        names.append(output_name(item))
        if isinstance(call, Call):
            what = call.name.upper()
            if what == "TIME_BUCKET":
                aggregates.append(F.first("__key").alias(f"_{n}"))
                continue
            if what not in AGGREGATES:
                raise InvalidArgument(f"unknown aggregate function {call.name}")
            if len(call.args) not in (1, 2):
                raise InvalidArgument(f"{what} takes one or two arguments")
            value, _ = expression(call.args[0], scope)
            order = expression(call.args[1], scope)[0] if len(call.args) == 2 else F.col("timestamp") if "timestamp" in visible(df) else F.col(SEQ)
            by = F.struct(order.alias("o"), F.col(SEQ).alias("s"))
            aggregates.append((F.min_by if what == "FIRST" else F.max_by)(value, by).alias(f"_{n}"))
        else:
            aggregates.append(F.min_by(expression(call, scope)[0], F.col(SEQ)).alias(f"_{n}"))
    out = df.withColumn("__key", key).groupBy("__key").agg(*aggregates)
    if buckets:
        out = out.orderBy("__key")
    return out.select(*[F.col(f"_{n}").alias(name) for n, name in enumerate(names)])


def assignments(sets, df: DataFrame) -> dict[str, Column]:
    """New columns of an UPDATE.  With only literals and column names all are
    taken at once and the first of a repeated column holds; otherwise they go
    left to right, each seeing those before."""
    simple = all(isinstance(signed(e), (Literal, Name)) for _, e in sets)
    made: dict[str, tuple[Column, str]] = {}
    base = scope_of(df)
    for name, expr in sets:
        want = base(name)[1]
        if simple:
            if name not in made:
                made[name] = expression(expr, base)
        else:
            made[name] = expression(expr, lambda n: made.get(n) or base(n))
        got = made[name][1]
        if got != want and not (want == "float" and got == "int"):
            raise InvalidArgument(f"{name} is {want}, not {got}")
    return {n: c.cast(df.schema[n].dataType) for n, (c, _) in made.items()}
