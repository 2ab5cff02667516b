"""Which SQL a model may run: the statement is parsed by Spark and every part of the parsed plan must be on a list.

Nothing is resolved yet, so names of relations and functions are as they stand in the text: whatever could read another
table or a file, call into the JVM or change anything is a part that no list holds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: Nodes of a parsed plan that only read.
PLANS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Join SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases Union Intersect Except OneRowRelation WithWindowDefinition".split()
)
#: Expressions that the parser makes of operators, literals and names.
EXPRESSIONS = frozenset(
    """UnresolvedAttribute UnresolvedStar UnresolvedAlias UnresolvedFunction UnresolvedOrdinal UnresolvedExtractValue UnresolvedSubscript UnresolvedNamedLambdaVariable
    UnresolvedWindowExpression LambdaFunction Literal Alias MultiAlias SortOrder Cast Add Subtract Multiply Divide Remainder IntegralDivide UnaryMinus UnaryPositive
    And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual Between In InSubquery Exists ScalarSubquery ListQuery Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny
    IsNull IsNotNull IsNaN CaseWhen If Coalesce Concat WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ UnboundedPreceding$ UnboundedFollowing$ CurrentRow$ RowFrame$ RangeFrame$ CreateStruct
    CreateNamedStruct Substring Upper Lower Trim StringTrim StringTrimLeft StringTrimRight Extract StringLocate BitwiseAnd BitwiseOr BitwiseXor BitwiseNot IsTrue IsFalse IsUnknown""".split()
)
#: Functions by name.
FUNCTIONS = frozenset(
    """abs any any_value array array_agg array_contains array_distinct array_join array_max array_min array_position array_size array_sort avg between bool_and bool_or cardinality ceil ceiling char_length
    coalesce collect_list collect_set concat concat_ws contains count count_if cume_dist dense_rank element_at endswith every exists exp filter first first_value flatten floor forall greatest if ifnull initcap instr
    isnan isnotnull isnull lag last last_value lcase lead least left len length levenshtein ln locate log log10 log2 lower lpad ltrim max max_by mean median min min_by mod named_struct nth_value ntile nullif nvl nvl2
    percent_rank percentile percentile_approx pow power rank regexp_extract regexp_like repeat replace reverse right rlike round row_number rpad rtrim sign size slice some sort_array split sqrt startswith std stddev
    string_agg listagg struct substr substring sum transform translate trim ucase upper var_pop var_samp variance when zip_with""".split()
)


def _children(node) -> Iterator:
    it = node.iterator()
    while it.hasNext():
        yield it.next()


def _name(part) -> str:
    """Simple name of a part's class; Scala's objects end with a dollar sign."""
    return part.getClass().getName().rsplit(".", 1)[-1]


def _parts(seq) -> list[str]:
    return [str(x).lower() for x in _children(seq)]


def _check_expression(e, relations: frozenset[str]) -> None:
    name = _name(e)
    if name not in EXPRESSIONS:
        raise ValueError(f"{name} is not allowed")
    if name == "UnresolvedFunction":
        function = _parts(e.nameParts())
        if len(function) != 1 or function[0] not in FUNCTIONS:
            raise ValueError(f"function {'.'.join(function)} is not allowed")
    if name in ("ScalarSubquery", "Exists", "ListQuery"):
        _check_plan(e.plan(), relations)
    if name == "InSubquery":
        _check_expression(e.query(), relations)
    for child in _children(e.children()):
        _check_expression(child, relations)


def _check_plan(plan, relations: frozenset[str]) -> None:
    name = _name(plan)
    if name not in PLANS:
        raise ValueError(f"{name} is not allowed")
    if name == "UnresolvedRelation":
        table = _parts(plan.multipartIdentifier())
        if len(table) != 1 or table[0] not in relations:
            raise ValueError(f"relation {'.'.join(table)} is not allowed")
    if name == "UnresolvedWith":
        for named in _children(plan.cteRelations()):
            # a name of the query's own hides a relation, so it may not be one
            alias = str(named._1()).lower()
            if alias in relations:
                raise ValueError(f"{alias} is a relation already")
            _check_plan(named._2(), relations)
            relations = relations | {alias}
    for e in _children(plan.expressions()):
        _check_expression(e, relations)
    for child in _children(plan.children()):
        _check_plan(child, relations)


def check(spark: SparkSession, sql: str, relations: tuple[str, ...]) -> None:
    """Raises ValueError unless sql is one statement that reads these relations alone, by the listed means."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise ValueError("no statement that Spark parses") from e
    _check_plan(plan, frozenset(relations))
