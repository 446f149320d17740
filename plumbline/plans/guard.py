"""Read-only checks and access rules for SQL.

Spark's own parser reads the text; the rules look at the parsed plan through the
JVM bridge, which only this module and ``apart`` use for plans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.tables import TABLE_FUNCTIONS
from plumbline.session import col

# Words that never occur in a read-only statement, words that reach outside one frame, first words that may open a statement.
BLOCKED_WORDS = [
    "DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "lo_import", "lo_export",
    "dblink", "dblink_exec", "pg_read_file", "pg_write_file", "pg_execute_server_program", "COPY",
]
DATASET_WORDS = [
    "insert", "update", "delete", "drop", "create", "alter", "attach", "detach", "copy", "pragma", "set", "install", "load", "export",
    "import", "call", "read_csv", "read_parquet", "read_json", "read_text", "glob", "system", "shell",
]
FIRST_WORDS = ["SELECT", "WITH", "EXPLAIN", "SHOW", "DESCRIBE"]
# Schemas that never belong to a user.
SYSTEM_SCHEMAS = {
    "information_schema", "pg_catalog", "auth", "storage", "realtime", "supabase_functions", "supabase_migrations", "extensions",
    "graphql", "graphql_public", "vault", "pgbouncer", "_realtime", "net", "cron", "_analytics", "supabase", "pgsodium", "pgtle",
}
AGGREGATES = {
    "count", "sum", "avg", "mean", "min", "max", "stddev", "stddev_samp", "stddev_pop", "variance", "var_samp", "var_pop",
    "approx_count_distinct", "count_if", "median", "percentile", "percentile_approx", "corr", "covar_samp", "covar_pop",
}
# Aggregates that give out one of the values they read: no protection for a sensitive column.
SHOWING = {"min", "max", "median", "percentile", "percentile_approx"}
_WINDOWS = ("UnresolvedWindowExpression", "WindowExpression")


def is_system_schema(name: str | None, extra: tuple[str, ...] = ()) -> bool:
    low = (name or "").lower()
    return low in SYSTEM_SCHEMAS or low in {e.strip().lower() for e in extra} or low.startswith("pg_toast")


def bare_text(sql: str) -> str:
    """The statement without comments and with empty literals."""
    spaced = re.sub(r"('(?:[^']|'')*'|\"[^\"]*\")|--[^\n]*|/\*.*?\*/", lambda m: "''" if m.group(1) else " ", sql, flags=re.S)
    return spaced.strip()


def check_read_only(sql: str, blocked: list[str] = BLOCKED_WORDS, first: list[str] = FIRST_WORDS) -> str | None:
    """``None`` if the text is one read-only statement, else the reason why not."""
    text = bare_text(sql)
    if not text:
        return "empty query"
    if ";" in text.rstrip("; \n\t"):
        return "more than one statement"
    word = re.search(r"\b(" + "|".join(blocked) + r")\b", text, flags=re.I)
    if word:
        return f"blocked word {word.group(1).upper()}"
    opening = text.split()[0].upper()
    if opening not in first:
        return f"only SELECT queries may run, not {opening}"
    return None


def check_dataset_sql(sql: str) -> str | None:
    """Rule for SQL over one frame: SELECT or WITH only, and no words that reach outside."""
    return check_read_only(sql, BLOCKED_WORDS + DATASET_WORDS, ["SELECT", "WITH"])


def read_only_verdict(sql: Column, blocked: list[str] = BLOCKED_WORDS, first: list[str] = FIRST_WORDS) -> Column:
    """``check_read_only`` as a column: the reason why a statement may not run, or NULL."""
    literal, mark = r"('(?:[^']|'')*'|\"[^\"]*\")", "\u0001"
    marked = F.regexp_replace(sql, rf"(?s){literal}|--[^\n]*|/\*.*?\*/", f"$1{mark}")
    text = F.regexp_replace(F.regexp_replace(marked, f"{literal}{mark}", "''"), mark, " ")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    word = F.regexp_extract(text, r"(?i)\b(" + "|".join(blocked) + r")\b", 1)
    opening = F.upper(F.regexp_extract(text, r"^(\S+)", 1))
    return (
        F.when(text == "", "empty query")
        .when(F.regexp_replace(text, r"[; \n\t]+$", "").contains(";"), "more than one statement")
        .when(word != "", F.concat(F.lit("blocked word "), F.upper(word)))
        .when(~opening.isin(first), F.concat(F.lit("only SELECT queries may run, not "), opening))
    )


def dataset_verdict(sql: Column) -> Column:
    return read_only_verdict(sql, BLOCKED_WORDS + DATASET_WORDS, ["SELECT", "WITH"])


# ---------------------------------------------------------------- parsed plans
def parse(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


# Plan nodes a checked statement may be made of; anything else is refused.
PLAN_NODES = {
    "Aggregate", "Distinct", "Except", "ExplainCommand", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Repartition", "RepartitionByExpression", "Sample",
    "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "UnresolvedHint", "WithWindowDefinition",
}
# Functions of Spark that reach outside the tables, or run code.
CLOSED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length"}
SET_NODES = {"Union", "Intersect", "Except"}


class Unsupported(ValueError):
    """The statement uses a form the checks do not follow."""


@dataclass
class References:
    tables: set[str] = field(default_factory=set)  # base tables, wherever they stand
    aliases: dict[str, set[str]] = field(default_factory=dict)  # every base table an alias stands for anywhere
    columns: list[tuple[tuple[str, ...], bool]] = field(default_factory=list)  # name parts, inside an aggregate
    stars: list[str] = field(default_factory=list)  # qualifier of each qualified star
    whole: set[str] = field(default_factory=set)  # base tables below a star, or used without a list of columns
    functions: set[str] = field(default_factory=set)


class _Reader:
    """Reads a parsed plan. Names of common table expressions hold only where SQL lets them: below their WITH, and
    in the definitions after their own."""

    def __init__(self):
        self.found = References()
        self.scopes: list[set[str]] = [set()]  # tables of the FROM clauses being read

    def plan(self, node, ctes: frozenset, listed: bool) -> None:
        """``listed``: a list of columns stands between this node and whatever gives its columns out."""
        kind, found = _name(node), self.found
        if kind == "UnresolvedTableValuedFunction":
            return self.table_function(node, ctes)
        if kind not in PLAN_NODES:
            raise Unsupported(kind)
        if kind == "ExplainCommand":
            return self.plan(node.logicalPlan(), ctes, listed)
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in _items(node.multipartIdentifier())]
            if not (len(parts) == 1 and parts[0] in ctes):
                self.table(parts, parts[-1], listed)
            return None
        if kind == "UnresolvedWith":
            recursive = bool(node.allowRecursion()) if hasattr(node, "allowRecursion") else False
            for pair in _items(node.cteRelations()):
                name = pair.productElement(0).lower()
                self.plan(pair.productElement(1), ctes | {name} if recursive else ctes, False)
                ctes = ctes | {name}
        if kind == "SubqueryAlias" and _name(node.child()) == "UnresolvedRelation":
            parts = [p.lower() for p in _items(node.child().multipartIdentifier())]
            if not (len(parts) == 1 and parts[0] in ctes):
                self.table(parts, node.alias().lower(), listed)
            return None
        if kind == "Join" and _name(node.joinType()) == "UsingJoin":
            found.columns += [((c.lower(),), False) for c in _items(node.joinType().usingColumns())]
        elif kind == "Join" and _name(node.joinType()) == "NaturalJoin":
            listed = False  # compares columns it does not name
        if kind in ("Project", "Aggregate"):
            listed = True
            self.scopes.append(set())
            for child in _items(node.children()):
                self.plan(child, ctes, listed)
            for expr in _items(node.expressions()):
                self.expr(expr, (), ctes)
            inner = self.scopes.pop()
            self.scopes[-1] |= inner
            return None
        if kind in SET_NODES or kind in ("UnresolvedSubqueryColumnAliases", "Pivot", "Unpivot"):
            listed = False  # columns go on by position
        for expr in _items(node.expressions()):
            self.expr(expr, (), ctes)
        for child in _items(node.children()):
            self.plan(child, ctes, listed)
        return None

    def table_function(self, node, ctes: frozenset) -> None:
        """Only our own table functions, called by their plain name. What a table argument hands over counts as given out."""
        name = ".".join(_items(node.name())).lower()
        if name not in TABLE_FUNCTIONS:
            raise Unsupported(f"table function {name}")
        self.found.functions.add(name)
        for expr in _items(node.functionArgs()):
            self.expr(expr, (), ctes)

    def table(self, parts: list[str], alias: str, listed: bool) -> None:
        name = ".".join(parts)
        self.found.tables.add(name)
        self.scopes[-1].add(name)
        self.found.aliases.setdefault(alias, set()).add(name)
        if not listed:
            self.found.whole.add(name)

    def expr(self, expr, above: tuple, ctes: frozenset) -> None:
        kind, found = _name(expr), self.found
        if kind == "UnresolvedAttribute":
            found.columns.append((tuple(p.lower() for p in _items(expr.nameParts())), any(f in AGGREGATES - SHOWING for f in above) and not set(above) & {"window", *SHOWING}))
        elif kind.startswith("UnresolvedStar") or kind == "UnresolvedRegex":
            if "count" not in above:
                target = expr.target() if hasattr(expr, "target") and kind != "UnresolvedRegex" else None
                if target is not None and target.isDefined():
                    found.stars.append(".".join(p.lower() for p in _items(target.get())))
                else:
                    found.whole |= self.scopes[-1]
        elif kind == "UnresolvedFunction":
            name = _items(expr.nameParts())[-1].lower()
            found.functions.add(name)
            above = (*above, name)
        elif kind in _WINDOWS:
            above = (*above, "window")  # a window aggregates over as little as one row
        elif "Subquery" in kind or kind in ("Exists", "ListQuery"):
            if kind != "InSubquery":  # holds its plan in a child
                self.scopes.append(set())
                self.plan(expr.plan(), ctes, kind == "Exists")
                inner = self.scopes.pop()
                if kind == "FunctionTableSubqueryArgumentExpression":
                    for by in _items(expr.partitionByExpressions()) + _items(expr.orderByExpressions()):
                        self.expr(by, above, ctes)
                if kind == "LateralSubquery":
                    self.scopes[-1] |= inner
        elif "Plan" in kind or "Identifier" in kind:
            raise Unsupported(kind)
        for child in _items(expr.children()):
            self.expr(child, above, ctes)


def references(spark: SparkSession, sql: str) -> References:
    """Base tables, columns, stars and functions of a statement, with names read in their scope."""
    reader = _Reader()
    reader.plan(parse(spark, sql), frozenset(), False)
    return reader.found


@dataclass
class Parts:
    plans: list[tuple[str, object, object]] = field(default_factory=list)  # kind, node, parent
    expressions: list[tuple[str, object, object]] = field(default_factory=list)


def statement_parts(plan) -> Parts:
    """Plan nodes and expressions of a parsed statement, each with what it stands in."""
    found, waiting = Parts(), [(plan, None, True)]
    while waiting:
        node, parent, is_plan = waiting.pop()
        (found.plans if is_plan else found.expressions).append((_name(node), node, parent))
        waiting += [(child, node, is_plan) for child in _items(node.children())]
        if is_plan:
            waiting += [(expr, None, False) for expr in _items(node.expressions())]
    return found


def function_name(expr) -> str | None:
    return _items(expr.nameParts())[-1].upper() if _name(expr) == "UnresolvedFunction" else None


def referenced_tables(spark: SparkSession, sql: str) -> set[str]:
    return references(spark, sql).tables


def _read(spark: SparkSession, sql: str) -> tuple[References | None, str | None]:
    try:
        found = references(spark, sql)
    except Unsupported as form:
        return None, f"{form} is not supported"
    except Exception:
        return None, "the query could not be parsed"
    closed = sorted(found.functions & CLOSED_FUNCTIONS)
    return found, f"function {closed[0]} is not allowed" if closed else None


def check_scope(spark: SparkSession, sql: str, known: set[str], allowed: set[str] | None = None,
                allowed_schemas: set[str] = frozenset()) -> str | None:
    """Refuse system, unknown and non-allowlisted tables, functions that reach outside, and forms that cannot be followed."""
    found, problem = _read(spark, sql)
    if problem:
        return problem
    known = {k.lower() for k in known}
    for name in sorted(found.tables):
        schema = name.rsplit(".", 1)[0] if "." in name else ""
        if is_system_schema(schema):
            return f"{name} is a system object"
        if name not in known:
            return f"{name} is unknown"
        if allowed is not None and name not in {a.lower() for a in allowed} and schema not in {s.lower() for s in allowed_schemas}:
            return f"{name} is outside the allowed scope"
    return None


@dataclass
class Policy:
    """Access rules: tables by name, columns as ``table.column``."""

    hidden_tables: set[str] = field(default_factory=set)
    restricted_columns: set[str] = field(default_factory=set)
    sensitive_columns: set[str] = field(default_factory=set)


def check_policy(spark: SparkSession, sql: str, policy: Policy) -> str | None:
    """Refuse hidden tables and restricted columns; sensitive ones may occur only inside an aggregate that is not a window and does not
    give out one of its values."""
    if not (policy.hidden_tables or policy.restricted_columns or policy.sensitive_columns):
        return None
    refs, problem = _read(spark, sql)
    if problem:
        return problem
    short = lambda name: name.split(".")[-1]
    tables = {short(t) for t in refs.tables}
    hidden = {short(t.lower()) for t in policy.hidden_tables}
    if tables & hidden:
        return f"table {sorted(tables & hidden)[0]} is hidden"
    restricted = {c.lower() for c in policy.restricted_columns}
    sensitive = {c.lower() for c in policy.sensitive_columns}

    def owners(qualifier: str) -> set[str]:
        """Tables a qualifier may stand for; one that names no base table may carry columns of any."""
        return {short(t) for t in refs.aliases.get(short(qualifier), refs.tables)} if qualifier else tables

    for parts, inside in refs.columns:
        # a name of several parts may be table.column or column.field
        owned = {f"{o}.{name}" for i, name in enumerate(parts) for o in owners(".".join(parts[:i]))}
        if owned & restricted:
            return f"column {sorted(owned & restricted)[0]} is restricted"
        if owned & sensitive and not inside:
            return f"column {sorted(owned & sensitive)[0]} is sensitive and must be aggregated"
    shown = {short(t) for t in refs.whole}.union(*[owners(q) for q in refs.stars])
    exposed = sorted(c for c in restricted | sensitive if c.split(".")[0] in shown)
    return f"* would expose {exposed[0]}" if exposed else None


def judged(statements: DataFrame, sql: str, check) -> DataFrame:
    """The statements with ``verdict``: what ``check(text)`` says, null where it has no objection.

    Spark's parser lives on the driver: distinct texts are read there one partition at a time, and the verdicts are joined back to
    any number of rows.
    """
    spark = statements.sparkSession
    verdicts = [(text, check(text or "")) for (text,) in statements.select(col(sql)).distinct().toLocalIterator()]
    found = spark.createDataFrame(verdicts, "_text string, verdict string")
    return statements.join(found, col(sql).eqNullSafe(F.col("_text"))).drop("_text")


def governed(df: DataFrame, restricted: list[str], sensitive: list[str]) -> DataFrame:
    """A view without restricted columns and with sensitive ones hashed: equal values stay
    equal for counting and joining, the content is not shown."""
    kept = [c for c in df.columns if c not in restricted]
    return df.select([F.sha2(col(c).cast("string"), 256).alias(c) if c in sensitive else col(c) for c in kept])
