"""Read-only SQL over one table, known to the query as `data`.

A statement is judged twice: as Spark parses it, so that nothing but a query is ever analysed, and as Spark resolves it in a
session of its own whose only view is `data`, so that what counts is the table or function a name stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

VIEW = "data"

#: Parsed plan nodes that a query over one table consists of. All else (commands, inserts, scripts, files) is refused.
READING = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct", "Deduplicate",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Union", "Except", "Intersect", "Join", "AsOfJoin",
    "LateralJoin", "UnresolvedHaving", "UnresolvedInlineTable", "OneRowRelation", "Window", "WithWindowDefinition", "Generate",
    "Pivot", "Unpivot", "Sample", "Expand", "UnresolvedHint", "UnresolvedRelation", "UnresolvedTableValuedFunction",
    "PlanWithUnresolvedIdentifier", "SerializeFromObject", "LocalRelation", "Values", "RepartitionByExpression", "PipeOperator",
}
#: Resolved plan nodes of such a query; the view `data` is looked at by name and not entered.
RESOLVED = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct", "Deduplicate",
    "SubqueryAlias", "Union", "Except", "Intersect", "Join", "AsOfJoin", "LateralJoin", "OneRowRelation", "LocalRelation",
    "Range", "Window", "Generate", "Pivot", "Unpivot", "Sample", "Expand", "ResolvedHint", "WithCTE", "CTERelationDef",
    "CTERelationRef", "UnionLoop", "UnionLoopRef", "RepartitionByExpression", "Repartition", "RebalancePartitions", "PipeOperator",
}
#: Expressions that hold a plan.
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
#: Built-in functions that call outside code, read files or tell of them.
REFUSED_FUNCTIONS = {
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length",
    "from_protobuf", "to_protobuf", "from_avro", "to_avro", "schema_of_avro",
}
#: Table functions that make rows out of their arguments only.
ROW_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}
#: Resolved expressions besides those that a built-in function is registered with: syntax, and what some functions become.
EXPRESSIONS = """
    Alias AttributeReference OuterReference OuterScopeReference Literal Cast SortOrder CaseWhen If In InSet InSubquery Exists
    ScalarSubquery ListQuery LateralSubquery CreateNamedStruct GetStructField GetArrayStructFields GetArrayItem GetMapValue
    NamedLambdaVariable LambdaFunction UnresolvedNamedLambdaVariable Not And Or IsNull IsNotNull EqualTo EqualNullSafe
    WindowExpression WindowSpecDefinition SpecifiedWindowFrame CurrentRow$ UnboundedPreceding$ UnboundedFollowing$
    UnspecifiedFrame$ Grouping GroupingID GroupingSets Cube Rollup LikeAll LikeAny NotLikeAll NotLikeAny BinaryPad
    BinaryPredicate Contains StartsWith EndsWith Ceil Floor RoundCeil RoundFloor Collate ResolvedCollation Explode PosExplode
    Inline Stack GeneratorOuter KnownNullable KnownNotNull PreciseTimestampConversion TimestampAddInterval TimeAdd Hour Minute Second
    MakeTimestamp MakeTimestampNTZ MakeTimestampFromDateTime TryMakeTimestamp TryMakeTimestampFromDateTime TryEval
    Mask RaiseError StringLPad StringRPad ToCharacter DateAddInterval DateAddYMInterval TimestampAddYMInterval
    SubtractDates SubtractTimestamps DatetimeSub ExtractIntervalPart UnaryMinus MultiplyYMInterval MultiplyDTInterval
    DivideYMInterval DivideDTInterval TempResolvedColumn PivotFirst DecimalDivideWithOverflowCheck CheckOverflow
    PromotePrecision EvalMode ArrayTransform AssertNotNull NormalizeNaNAndZero PipeExpression Extract PercentileCont
    aggregate.AggregateExpression aggregate.CountMinSketchAgg aggregate.Mode aggregate.PercentileCont
    aggregate.PercentileDisc aggregate.PivotFirst aggregate.Percentile aggregate.ListAgg variant.ParseJson variant.VariantGet
""".split()
_PACKAGE = "org.apache.spark.sql.catalyst.expressions."


class NotReadOnly(ValueError):
    """The statement does more than read `data`."""


def _items(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _expressions(roots: list) -> Iterator:
    todo = list(roots)
    while todo:
        one = todo.pop()
        yield one
        todo.extend(_items(one.children()))


def _check_identifier(expression) -> None:
    """Spark computes the argument of IDENTIFIER while it resolves names, so it must be a text as it stands."""
    if _kind(expression) != "Literal":
        raise NotReadOnly("IDENTIFIER takes a literal here.")


def _check_plan(plan, names: set[str], builtin) -> None:
    """Every node, expression and subquery of one plan; `names` are the relations that may be read."""
    todo = [(plan, names)]
    while todo:
        node, known = todo.pop()
        kind = _kind(node)
        if kind not in READING:
            raise NotReadOnly(f"A query may not contain {kind}.")
        if kind == "UnresolvedRelation":
            parts = list(_items(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in known:
                raise NotReadOnly(f"{'.'.join(parts)} is not the table `{VIEW}` or a name defined in the query.")
        if kind == "UnresolvedTableValuedFunction" and list(_items(node.name()))[-1].lower() not in ROW_FUNCTIONS:
            raise NotReadOnly("This table function is not available here.")
        if kind == "PlanWithUnresolvedIdentifier":
            _check_identifier(node.identifierExpr())
        if kind == "UnresolvedWith":
            defined = set(known)
            for entry in _items(node.cteRelations()):
                if _kind(entry._2()) not in READING:
                    raise NotReadOnly("A WITH list may only hold queries.")
                own = {entry._1().lower()} if node.allowRecursion() else set()
                todo.append((entry._2(), defined | own))
                defined.add(entry._1().lower())
            todo.append((node.child(), defined))
        else:
            todo.extend((child, known) for child in _items(node.children()))
        for e in _expressions(list(_items(node.expressions()))):
            name = _kind(e)
            if name in ("ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier"):
                _check_identifier(e.identifierExpr())
            if name == "UnresolvedFunction":
                parts = list(_items(e.nameParts()))
                if len(parts) != 1 or parts[0].lower() in REFUSED_FUNCTIONS or not builtin(parts[0]):
                    raise NotReadOnly(f"The function {'.'.join(parts)} is not available here.")
            if name in SUBQUERIES:
                todo.append((e.plan(), known))


def guard(spark: SparkSession, sql: str) -> str:
    """`sql` as it is, or `NotReadOnly` with the reason; nothing is run or looked up."""
    jvm, state = spark._jvm, spark._jsparkSession.sessionState()
    if not sql.strip():
        raise NotReadOnly("There is no statement.")
    try:
        plan = state.sqlParser().parsePlan(sql)
    except Exception as e:
        raise NotReadOnly(f"Spark cannot read this as one statement: {str(e).splitlines()[0][:200]}") from None
    registry = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    name_of = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    _check_plan(plan, {VIEW}, lambda name: registry.functionExists(name_of.apply(name.lower())))
    return sql


@lru_cache(maxsize=8)
def _known_expressions(spark: SparkSession) -> frozenset[str]:
    """Classes of expressions that may stand in a resolved query: those of the built-in functions, and EXPRESSIONS."""
    jvm = spark._jvm
    registry = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    classes = {_PACKAGE + name for name in EXPRESSIONS}
    for name in _items(registry.listFunction().toSeq()):
        info = registry.lookupFunction(name).get()
        if info.getName().lower() not in REFUSED_FUNCTIONS and info.getClassName().startswith(_PACKAGE):
            classes.add(info.getClassName())
    return frozenset(classes)


def _isolated(df: DataFrame):
    """A JVM session with the caller's settings and one view, `data`; files cannot be named as tables there."""
    spark = df.sparkSession
    session = spark._jsparkSession.newSession()
    conf = session.sessionState().conf()
    for entry in _items(spark._jsparkSession.sessionState().conf().getAllConfs().toSeq()):
        conf.setConfString(entry._1(), entry._2())
    conf.setConfString("spark.sql.runSQLOnFiles", "false")
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    dataset.ofRows(session, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(VIEW)
    return session


def _is_data(node) -> bool:
    own = node.desc().identifier()
    return node.isTempView() and own.table() == VIEW and own.database().isEmpty()


def _check_resolved(spark: SparkSession, plan) -> None:
    """Every node and expression above the view `data` must be of a kind that only reads and computes."""
    known = _known_expressions(spark)
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    replaced = spark._jvm.java.lang.Class.forName(_PACKAGE + "InheritAnalysisRules", False, loader)
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = _kind(node)
        if kind == "View" and _is_data(node):
            continue
        if kind not in RESOLVED:
            raise NotReadOnly(f"A query may not read or contain {kind}.")
        todo.extend(_items(node.children()))
        if kind == "WithCTE":
            todo.extend(_items(node.cteDefs()))
        expressions = list(_items(node.expressions()))
        while expressions:
            e = expressions.pop()
            name = e.getClass().getName()
            if name not in known:
                raise NotReadOnly(f"{name.rpartition('.')[2]} is not available in a query.")
            # What Spark will put in the place of a built-in function is Spark's own; its arguments are the query's.
            expressions.extend(_items(e.parameters() if replaced.isInstance(e) else e.children()))
            if _kind(e) in SUBQUERIES:
                todo.append(e.plan())


def run_sql(df: DataFrame, sql: str) -> DataFrame:
    """The query's whole result, lazily, in the caller's session, whose views play no part."""
    spark = df.sparkSession
    guard(spark, sql)
    state = _isolated(df).sessionState()
    try:
        skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
        plan = state.executePlan(state.sqlParser().parsePlan(sql), skip).analyzed()
    except Exception as e:
        raise NotReadOnly(f"The query cannot be resolved over `{VIEW}` alone: {str(e).splitlines()[0][:200]}") from None
    _check_resolved(spark, plan)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def preview_sql(df: DataFrame, sql: str, rows: int) -> DataFrame:
    """The first `rows` rows of the result, for a screen."""
    return run_sql(df, sql).limit(rows)
