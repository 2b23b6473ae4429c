"""Column expressions shared by the operators: layers, expression classes, text scores. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layers in the order data flows, their indexes, layers of database names.
LAYERS = ("src", "stg", "ods", "dim", "dwd", "dws", "ads", "app", "other")
LAYER_INDEX = {"src": 0, "stg": 0, "ods": 1, "dim": 1, "dwd": 2, "dws": 3, "ads": 4, "app": 5, "other": 2}
SCHEMA_LAYERS = {"src": "src", "source": "src", "stg": "stg", "stage": "stg", "ods": "ods", "dim": "dim", "dwd": "dwd", "cdw": "dwd", "dws": "dws", "ads": "ads", "app": "app"}
NAME_LAYERS = ("ods", "dim", "ads", "dwd", "dws")
#: Aggregate functions and the words that stand before a parenthesis without being functions.
AGGREGATES = ("SUM", "COUNT", "AVG", "MAX", "MIN", "STDDEV", "VARIANCE", "COLLECT_SET", "COLLECT_LIST", "PERCENTILE", "MEDIAN")
NOT_FUNCTIONS = ("AS", "AND", "OR", "NOT", "IN", "THEN", "WHEN", "ELSE", "END")
#: Classes of expressions.
CLASSES = ("窗口函数", "条件分支", "比率", "聚合", "算术计算", "函数转换", "直取")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def table_layer(name: Column) -> Column:
    """The layer of a table name: by what the table's own name holds, then by database, then by its beginning."""
    name = F.lower(F.coalesce(name, F.lit("")))
    parts = F.split(name, r"\.")
    table, schema = F.element_at(parts, -1), F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("")
    out = F.when(table.contains("dwd"), "dwd").when(table.contains("dws"), "dws")
    out = out.when(schema.isin(*SCHEMA_LAYERS), _map(SCHEMA_LAYERS)[schema])
    for key in NAME_LAYERS:
        out = out.when(table.startswith(key + "_") | (table == key), key)
    return out.otherwise("other")


def layer_step_ok(source: Column, target: Column) -> Column:
    """Whether data may flow from one layer to another: same or next layer; side and unknown layers always."""
    s, t = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(target, F.lit("")))
    free = s.isin("dim", "", "other") | t.isin("dim", "", "other")
    index = _map(LAYER_INDEX)
    step = F.coalesce(index[t], F.lit(LAYER_INDEX["other"])) - F.coalesce(index[s], F.lit(LAYER_INDEX["other"]))
    return free | step.between(0, 1)


#: A lexeme is a name that opens a bracket, another name, a number, a run of comment signs, or one sign.
_LEXEME = r"[A-Za-z_][A-Za-z_0-9]*\s*\(|[\p{L}_][\p{L}\p{N}_]*|[0-9][0-9.]*|[/*]{2,}|\S"
#: Shapes that an expression's outline, one letter a lexeme, may hold; the first one found gives the class.
_OUTLINES = (("V", 0), ("C.*W|W.*C", 1), ("/", 2), ("A", 3), (r"[xCW)][-+*/][xFAVCW(]", 4), ("[FAV]", 5))


def _lexemes(expr: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(expr, F.lit("")), F.lit(_LEXEME), 0)


def _opened(lexeme: Column) -> Column:
    """The upper-cased function that a lexeme opens, null for other lexemes."""
    name = F.upper(F.rtrim(F.translate(lexeme, "(", "")))
    return F.when((F.right(lexeme, F.lit(1)) == "(") & (F.length(lexeme) > 1) & ~name.isin(*NOT_FUNCTIONS), name)


def _letter(lexeme: Column) -> Column:
    name, up = _opened(lexeme), F.upper(lexeme)
    out = F.when(name == "OVER", "V").when(name.isin(*AGGREGATES), "A").when(name.isNotNull(), "F").when(F.length(up) > 1, F.when(up == "CASE", "C").when(up == "WHEN", "W"))
    out = out.when(up.rlike(r"^[/*]{2,}$"), "~").when(up.isin("(", "["), "(").when(up.isin(")", "]"), ")").when(up.isin("+", "-", "*", "/"), up)
    return F.coalesce(out, F.when(up.rlike(r"^[\p{L}\p{N}_]"), F.when(F.right(up, F.lit(1)) == "(", "(").otherwise("x")), F.lit("~"))


def detect_functions(expr: Column) -> Column:
    """Distinct upper-cased function names in order of appearance."""
    return F.array_distinct(F.array_compact(F.transform(_lexemes(expr), _opened)))


def aggregate_of(expr: Column) -> Column:
    """The first aggregate function, or null."""
    return F.try_element_at(F.filter(detect_functions(expr), lambda f: f.isin(*AGGREGATES)), F.lit(1))


def classify_expression(expr: Column) -> Column:
    """One of CLASSES, read off the outline of the expression's lexemes; the first that applies."""
    outline = F.array_join(F.transform(_lexemes(expr), _letter), "")
    found = [F.when(outline.rlike(shape), F.lit(CLASSES[k])) for shape, k in _OUTLINES]
    return F.coalesce(*found, F.lit(CLASSES[6]))


#: Signs that part the words of a query.
QUERY_SIGNS = "，,。.、;；:：!！?？'\"“”‘’()（）[]【】/\\|"
_APART = str.maketrans(dict.fromkeys(QUERY_SIGNS, " "))


def _han(sign: str) -> bool:
    return "\u4e00" <= sign <= "\u9fff"


def query_tokens(query: str) -> list[str]:
    """The words of a query; words that are not CJK also give their parts at _ and -."""
    found: dict[str, None] = {}
    for word in query.translate(_APART).split():
        parts = [] if all(map(_han, word)) else word.replace("-", "_").split("_")
        found |= dict.fromkeys(filter(None, [word, *parts]))
    return list(found)


def score_text(text: Column, query: str) -> Column:
    """100 equal, 82 beginning, 65 inside, 45 by the share of words found, 40 characters in order (CJK), else 0."""
    hay, needle = F.lower(F.coalesce(text, F.lit(""))), query.lower()
    if not needle.strip():
        return F.lit(0.0)
    out = F.when(hay == "", 0.0).when(hay == needle, 100.0).when(hay.startswith(needle), 82.0).when(hay.contains(needle), 65.0)
    words = query_tokens(query)
    if len(words) > 1:
        hits = sum((F.when(hay.contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))
        out = out.when(hits > 0, F.lit(45.0) * hits / len(words))
    if any(map(_han, needle)):
        out = out.when(hay.rlike("(?s)" + ".*".join(map(re.escape, needle))), 40.0)
    return out.otherwise(0.0)


def weighted_score(fields: list[tuple[Column, float]], query: str) -> Column:
    """The best weighted score over several columns, to one decimal."""
    return F.round(F.greatest(*[score_text(c, query) * w for c, w in fields], F.lit(0.0)), 1)


#: Kinds of filter conditions in the order they are tried: a pattern on the upper-cased text, what stands
#: before and after the condition in its sentence.
FILTER_KINDS = (
    (r"IS NOT NULL", "空值过滤：", "（该字段为空视为脏数据）"),
    (r"(DT|PT|DS|DATE|MONTH)\s*=", "时点/分区过滤：", ""),
    (r"(DT|PT|DS|DATE)\s*[<>]", "时间范围过滤：", ""),
    (r"\bIN\s*\(", "枚举过滤：", ""),
    (r"<>|!=", "取值排除：", ""),
    (r"(STATUS|TYPE|FLAG|LEVEL)\s*=", "状态过滤：", ""),
    (r".", "过滤条件：", ""),
)
SHOWN = 120


def describe_filter(expr: Column) -> Column:
    """A sentence for a filter condition, by the first of FILTER_KINDS; long conditions are shortened."""
    said = F.trim(F.coalesce(expr, F.lit("")))
    shown = F.when(F.length(said) > SHOWN, F.concat(F.left(said, F.lit(SHOWN - 1)), F.lit("…"))).otherwise(said)
    kinds = [F.when(F.upper(said).rlike(f"(?s){pattern}"), F.concat(F.lit(lead), shown, F.lit(tail))) for pattern, lead, tail in FILTER_KINDS]
    return F.coalesce(*kinds, F.lit("过滤条件"))


#: Names that stand before another one, each level of which a pass takes off.
_QUALIFIER = r"(?U)(?<![\w.$'])(?:`[^`]+`|[^\W\d]\w*)\s*\.\s*(?=[`（(]|[^\W\d])"


def normalize_expression(expr: Column) -> Column:
    """Without trailing semicolon, alias and qualifiers (up to three levels), and with even spacing."""
    e = F.regexp_replace(F.trim(F.coalesce(expr, F.lit(""))), r";\s*$", "")
    e = F.regexp_replace(e, r"(?i)\s+AS\s+`?[^\s`()]+`?\s*$", "")
    for _ in range(3):
        e = F.regexp_replace(e, _QUALIFIER, "")
    e = F.regexp_replace(F.regexp_replace(e, r"\s+", " "), r"\s*([(),])\s*", "$1")
    e = F.regexp_replace(e, ",", ", ")
    return F.trim(F.regexp_replace(e, r"\s*(<>|<=|>=|!=|[-+*/=<>])\s*", " $1 "))


def split_identifier(name: Column) -> Column:
    """Lower-cased parts of a snake- or camel-case name, numbers left out."""
    s = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.filter(F.transform(F.split(s, r"[_\-\s]+"), F.lower), lambda p: (p != "") & ~p.rlike(r"^\d+$"))
