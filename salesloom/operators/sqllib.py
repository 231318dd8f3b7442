"""Ready-made SQL reports and read-only user statements over registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesloom.sources.sinks import register_tables

# The names and statements of the ready-made reports.
TEMPLATES = {
    "revenue_by_category": """
        SELECT category, sum(amount) AS total_revenue, count(*) AS order_count
        FROM sales
        GROUP BY category
        ORDER BY total_revenue DESC, category
        LIMIT 10
    """,
    "monthly_revenue": """
        SELECT date_format(date, 'yyyy-MM') AS month, sum(amount) AS revenue
        FROM sales
        WHERE date IS NOT NULL
        GROUP BY month
        ORDER BY month
    """,
    "cancellation_by_fulfilment": """
        SELECT fulfilment,
               count_if(status ILIKE '%cancel%') / count(*) AS cancel_rate,
               count(*) AS total_orders
        FROM sales
        GROUP BY fulfilment
    """,
    "b2b_performance": """
        SELECT b2b, count(*) AS orders, sum(amount) AS revenue, avg(amount) AS avg_order_value
        FROM sales
        GROUP BY b2b
    """,
    "top_states": """
        SELECT ship_state, sum(amount) AS revenue, count(*) AS orders
        FROM sales
        GROUP BY ship_state
        ORDER BY revenue DESC, ship_state
        LIMIT 10
    """,
}

# Parsed plan nodes that only read. Anything else is refused: commands, writing
# statements, scripts, settings.
_READING = set(
    "Project Filter Aggregate Join LateralJoin AsOfJoin Sort GlobalLimit LocalLimit Offset Distinct "
    "Deduplicate Union Intersect Except SubqueryAlias OneRowRelation LocalRelation Pivot "
    "UnresolvedPivot Unpivot UnresolvedUnpivot UnresolvedUnpivotTransposed UnresolvedTranspose "
    "UnresolvedHaving UnresolvedWith CTERelationDef UnresolvedRelation "
    "UnresolvedInlineTable ResolvedInlineTable UnresolvedTableValuedFunction "
    "UnresolvedSubqueryColumnAliases Generate Expand Sample Window WithWindowDefinition "
    "UnresolvedHint Tail View PipeOperator".split()
)
# Built-in functions that call any method of the driver's or executors' classes.
_REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
# Table functions that make rows from their arguments; others may read or run anything.
_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "inline", "inline_outer", "posexplode",
                    "posexplode_outer", "stack", "json_tuple"}


def _seq(values) -> list:
    return [values.apply(i) for i in range(values.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _refused_expression(expression, builtin) -> str | None:
    """Why an expression or one below it is refused. Plans in it are walked by the caller."""
    todo = [expression]
    while todo:
        one = todo.pop()
        kind = _kind(one)
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            if kind == "UnresolvedFunction":
                parts = _seq(one.nameParts())
            else:
                parts = [one.name().funcName()]
            name = parts[-1].lower()
            if len(parts) > 1 or name in _REFUSED_FUNCTIONS or name not in builtin:
                return f"function {'.'.join(parts)}"
        elif kind in ("ExpressionWithUnresolvedIdentifier", "CallMethodViaReflection") or "UDF" in kind:
            return kind
        todo += _seq(one.children())
    return None


def refusal(spark: SparkSession, text: str) -> str | None:
    """What keeps a statement from being a plain query; None where nothing does.

    Walks the parsed plan with its common table expressions, subqueries and expressions.
    Tables have to be views of the session, tables of the catalog or names the statement
    defines, so that no file is read by its path.
    """
    functions = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry
    builtin = {f.funcName().lower() for f in _seq(functions.functionSet().toSeq())}
    named: set[str] = set()
    tables: list[list[str]] = []
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while todo:
        node = todo.pop()
        kind = _kind(node)
        if kind not in _READING:
            return kind
        if kind == "UnresolvedRelation":
            tables.append(_seq(node.multipartIdentifier()))
        if kind == "UnresolvedTableValuedFunction":
            name = _seq(node.name())
            if len(name) > 1 or name[0].lower() not in _TABLE_FUNCTIONS:
                return f"table function {'.'.join(name)}"
        inner = _seq(node.innerChildren())
        if kind == "UnresolvedWith":
            named |= {one.alias().lower() for one in inner}
        for expression in _seq(node.expressions()):
            found = _refused_expression(expression, builtin)
            if found is not None:
                return found
        todo += _seq(node.children()) + inner
    for parts in tables:
        known = len(parts) == 1 and parts[0].lower() in named
        if not known and not spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts)):
            return f"table {'.'.join(parts)}"
    return None


def run_user_sql(
    spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Run one plain query over registered tables; anything else is refused unrun."""
    register_tables(tables or {})
    found = refusal(spark, text)
    if found is not None:
        raise ValueError(f"only reading statements are allowed, not {found}")
    return spark.sql(text)


def run_template(
    spark: SparkSession, name: str, tables: dict[str, DataFrame] | None = None
) -> DataFrame:
    return run_user_sql(spark, TEMPLATES[name], tables)
