"""SQL inside shell and Python scripts.

``extract`` works on one text; ``extract_frame`` runs it over a DataFrame of scripts in batches on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship

# Client commands, their switches for text and files, task types, and what tells the kinds of scripts apart.
CLIENTS = "hive hivef beeline spark-sql spark_sql spark3-sql impala-shell impala mysql psql clickhouse-client".split()
TEXT_SWITCHES = "-e --execute -q --query -c --command --sql".split()
FILE_SWITCHES = "-f --file".split()
PYTHON_TASKS = frozenset("PYTHON PY PYSPARK PY_SPARK PYTHON3 PYSQL".split())
SHELL_TASKS = frozenset("SHELL SH BASH SHELL_SCRIPT".split())
SQL_TASKS = frozenset("SQL HIVE HIVESQL HIVE_SQL SPARK SPARKSQL SPARK_SQL SPARK3 CLICKHOUSE MYSQL POSTGRESQL ORACLE SQLSERVER DB2 PRESTO DORIS STARROCKS TRINO CLICKHOUSE_SQL".split())

_LEAD = r"^\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*"
SQL_START = re.compile(_LEAD + r"(?:SELECT|INSERT|WITH|CREATE|MERGE|UPDATE|DELETE|ALTER|DROP|TRUNCATE|EXPLAIN)\b", re.I | re.S)
SQL_SCRIPT = re.compile(_LEAD + r"(?:SET\s+[A-Za-z_]\w*\s*=|(?:SELECT|INSERT|WITH|CREATE|MERGE|UPDATE|DELETE|ALTER|DROP|TRUNCATE|EXPLAIN|USE|MSCK|ANALYZE|REFRESH)\b)", re.I | re.S)
SQL_INSIDE = re.compile(r"\b(?:INSERT\s+(?:INTO|OVERWRITE)|CREATE\s+(?:TABLE|VIEW)|MERGE\s+INTO)\b|\bSELECT\b.{0,4000}?\bFROM\b", re.I | re.S)
SHELL_SIGNS = re.compile(r"^#!.*\b(?:ba|z|k)?sh\b|^\s*(?:set\s+-[a-zA-Z]+|export\s+\w+=|echo\s)|\$\{\w+\}|\$\w+\b|\b(?:fi|then|done)\s*$", re.M)
PYTHON_SIGNS = re.compile(r"^#!.*\bpython[\d.]*\b|^\s*(?:import\s+\w|from\s+[\w.]+\s+import\s|def\s+\w+\s*\()|\.sql\s*\(|\b(?:read_sql\w*|sqlalchemy\.text)\s*\(|\bSparkSession|\bspark\s*=|\bprint\s*\(", re.M)
_CLIENT = re.compile(r"(?:^|(?<=[\n;|&(`${}]))[ \t]*(?:\w+=\S+[ \t]+|sudo[ \t]+|nohup[ \t]+|exec[ \t]+)*(" + "|".join(map(re.escape, sorted(CLIENTS, key=len, reverse=True))) + r")(?=[ \t\n\\])")
_QUOTED = r"'[^']*'|\"(?:\\.|[^\"\\])*\""
_ASSIGN = re.compile(rf"^[ \t]*(?:export[ \t]+|local[ \t]+|readonly[ \t]+)?(\w+)=({_QUOTED})", re.M | re.S)
_HEREDOC = re.compile(r"<<(-?)[ \t]*(['\"]?)(\w+)\2")
_PY_STRING = re.compile(r"(?P<comment>#[^\n]*)|(?P<prefix>[rubfRUBF]{0,3})(?P<q>'''|\"\"\"|'|\")(?P<body>(?:\\.|(?!(?P=q)).)*?)(?P=q)", re.S)
_PY_CALL = re.compile(r"(?P<name>[\w.\])]*?\.sql|\bread_sql(?:_query|_table)?|(?<![\w.])(?:sqlalchemy\.)?text)\s*\(\s*")


@dataclass
class Entry:
    sql: str | None
    hint: str
    start: int
    line: int
    note: str = ""
    placeholders: list[str] = field(default_factory=list)
    resolved: bool = True


@dataclass
class Extraction:
    kind: str
    entries: list[Entry] = field(default_factory=list)
    hints: list[str] = field(default_factory=list)


def looks_like_sql(text: str) -> bool:
    body = "\n".join(x for x in (text or "").splitlines() if not x.strip().startswith("--")).strip()
    return bool(body) and bool(SQL_START.match(body) or SQL_INSIDE.search(body))


def detect_kind(text: str, task_type: str | None = None) -> str:
    """shell, python, sql or unknown; what the text holds comes before what its task says."""
    if text and text.strip():
        if SQL_SCRIPT.match(text) and not text.startswith("#!"):
            return "sql"
        if clients(text) or re.match(r"#!.*\b(?:ba|z|k)?sh\b", text):
            return "shell"
        if PYTHON_SIGNS.search(text):
            return "python"
        if SHELL_SIGNS.search(text):
            return "shell"
    task = (task_type or "").upper()
    return "python" if task in PYTHON_TASKS else "shell" if task in SHELL_TASKS else "sql" if task in SQL_TASKS else "unknown"


def _blank_comments(text: str) -> str:
    """Shell comment lines as blanks, places kept."""
    return re.sub(r"^[ \t]*#[^\n]*", lambda m: " " * len(m.group()), text, flags=re.M)


def clients(text: str) -> list[tuple[str, int]]:
    """(command, place) of SQL clients where a command may stand."""
    return [(m.group(1), m.start(1)) for m in _CLIENT.finditer(_blank_comments(text or ""))]


def shell_variables(text: str) -> dict[str, str]:
    return {n: v[1:-1].replace('\\"', '"') for n, v in _ASSIGN.findall(_blank_comments(text))}


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _arguments(text: str, at: int) -> tuple[list[tuple[str, str, int]], int]:
    """Words of a command from ``at`` on: (text, quote or '', place), and where the command ends."""
    out, i = [], at
    while i < len(text):
        c = text[i]
        if c == "\\" and text[i + 1 : i + 2] == "\n":
            i += 2
        elif c in " \t":
            i += 1
        elif c in "\n;|&)":
            break
        elif c == "<" and text.startswith("<<", i):
            break
        elif m := re.compile(_QUOTED, re.S).match(text, i):
            body = m.group()[1:-1]
            out.append((body.replace('\\"', '"').replace("\\`", "`") if c == '"' else body, c, i + 1))
            i = m.end()
        else:
            m = re.compile(r"(?:\\.|[^\s;|&)'\"])+").match(text, i)
            if not m:
                break
            out.append((m.group(), "", i))
            i = m.end()
    return out, i


def extract_shell(text: str, read_file=None) -> Extraction:
    """Here-documents, inline texts, files and variables handed to SQL clients; a hint for everything left out.

    ``read_file(name)`` gives a file's text or None; without it file arguments are hints.
    """
    out, used, names, code = Extraction("shell"), set(), shell_variables(text), _blank_comments(text)
    for command, at in clients(text):
        args, stop = _arguments(code, at + len(command))
        end = code.find("\n", stop)
        rest = code[stop : end if end >= 0 else len(code)]
        found = False
        if here := _HEREDOC.search(rest):
            body_at = (end if end >= 0 else len(code)) + 1
            close = re.compile(rf"^{'[ \t]*' if here.group(1) else ''}{re.escape(here.group(3))}[ \t]*$", re.M).search(text, body_at)
            if close:
                body = text[body_at : close.start()]
                if here.group(1):
                    body = re.sub(r"^\t+", "", body, flags=re.M)
                out.entries.append(Entry(body.strip(), f"{command} << {here.group(3)}", body_at, _line(text, body_at)))
            else:
                out.hints.append(f"line {_line(text, at)}: here-document {here.group(3)} has no end")
            found = True
        for k, (word, quote, _) in enumerate(args):
            switch, _, value = word.partition("=")
            if quote or switch not in TEXT_SWITCHES + FILE_SWITCHES:
                continue
            nxt = (value, "=", 0) if value else args[k + 1] if k + 1 < len(args) else None
            if nxt is None:
                continue
            found, (body, q, place) = True, nxt
            ref = re.fullmatch(r"\$(?:\{(\w+)\}|(\w+))", body.strip())
            if switch in FILE_SWITCHES and not (command == "psql" and switch == "-c"):
                got = read_file(body) if read_file else None
                if got is None:
                    out.entries.append(Entry(None, f"{command} {switch} {body}", at, _line(text, at), "file not read", resolved=False))
                    out.hints.append(f"line {_line(text, at)}: {command} {switch} {body} was not read")
                else:
                    out.entries.append(Entry(got, f"{command} {switch} {body}", at, _line(text, at), f"from {body}"))
            elif ref and q != "'":
                name = ref.group(1) or ref.group(2)
                used.add(name)
                if name in names:
                    own = re.search(rf"\b{name}=", text).start()  # the SQL stands where the variable is set
                    out.entries.append(Entry(names[name].strip(), f"{command} {switch} ${name}", own, _line(text, own), f"from variable {name}"))
                else:
                    out.hints.append(f"line {_line(text, at)}: variable {name} has no literal value")
            elif body.strip():
                marks = re.findall(r"\$\{?\w+\}?", body) if q != "'" else []
                out.entries.append(Entry(body.strip(), f"{command} {switch}", place, _line(text, place), placeholders=marks))
        if not found:
            out.hints.append(f"line {_line(text, at)}: {command} without SQL text")
    have = {re.sub(r"\s+", " ", e.sql) for e in out.entries if e.sql}
    for name, body in names.items():
        if name not in used and SQL_START.match(body) and re.sub(r"\s+", " ", body.strip()) not in have:
            m = re.search(rf"\b{name}=", text)
            out.entries.append(Entry(body.strip(), f"variable {name}", m.start(), _line(text, m.start()), "not handed to a client"))
    out.entries.sort(key=lambda e: e.start)
    return out


def neutral(body: str) -> tuple[str, list[str]]:
    """An f-string's text with each field as 0 and doubled braces single, and the fields, which may hold braces themselves."""
    out, marks, depth, begun = [], [], 0, 0
    at = 0
    while at < len(body):
        sign = body[at]
        if not depth and body[at : at + 2] in ("{{", "}}"):
            out.append(sign)
            at += 1
        elif sign == "{":
            depth += 1
            if depth == 1:
                begun = at + 1
        elif sign == "}" and depth:
            depth -= 1
            if not depth:
                marks.append(body[begun:at])
                out.append("0")
        elif not depth:
            out.append(sign)
        at += 1
    return "".join(out) + (body[begun - 1 :] if depth else ""), marks


def extract_python(text: str) -> Extraction:
    """Literals, f-strings and variables handed to .sql(), read_sql*() and text(); other literals that start as SQL."""
    out, taken = Extraction("python"), set()
    strings = [m for m in _PY_STRING.finditer(text) if m.group("q")]
    at_start = {m.start(): m for m in strings}
    inside = [(m.start(), m.end()) for m in _PY_STRING.finditer(text)]
    names = {}
    for m in strings:
        if v := re.search(r"(?:^|\n)[ \t]*(\w+)[ \t]*=[ \t]*\(?\s*$", text[: m.start()]):
            names[v.group(1)] = m

    def entry(m, hint, note=""):
        body = m.group("body")
        marks: list[str] = []
        if "f" in m.group("prefix").lower():
            body, marks = neutral(body)
        if body.strip():
            out.entries.append(Entry(body.strip(), hint, m.start(), _line(text, m.start()), note or (f"{len(marks)} placeholders" if marks else ""), marks))

    for call in _PY_CALL.finditer(text):
        if any(a < call.start() < b for a, b in inside):
            continue
        hint = call.group("name").split(".")[-1] + "()"
        if m := at_start.get(call.end()):
            taken.add(m.start())
            entry(m, hint)
        elif v := re.compile(r"(\w+)\s*[,)]").match(text, call.end()):
            if v.group(1) in names:
                taken.add(names[v.group(1)].start())
                entry(names[v.group(1)], hint, f"from variable {v.group(1)}")
            else:
                out.hints.append(f"line {_line(text, call.start())}: {hint} gets {v.group(1)}, which has no literal value")
        else:
            out.hints.append(f"line {_line(text, call.start())}: {hint} gets an expression")
    for m in strings:
        before = text[: m.start()].rstrip(" \t")
        doc = len(m.group("q")) == 3 and (not before.strip() or before.endswith("\n") and before.rstrip()[-1:] not in "(,=[{+")
        if m.start() not in taken and not doc and SQL_START.match(m.group("body")) and looks_like_sql(m.group("body")):
            entry(m, "literal")
    out.entries.sort(key=lambda e: e.start)
    return out


def extract(text: str, kind: str | None = None, task_type: str | None = None, read_file=None) -> Extraction:
    kind = kind or detect_kind(text, task_type)
    if kind == "shell":
        return extract_shell(text, read_file)
    if kind == "python":
        return extract_python(text)
    if kind == "sql":
        body = "\n".join(x for x in text.splitlines() if not x.strip().startswith("--")).strip()
        return Extraction("sql", [Entry(body, "script", 0, 1)] if body else [])
    if looks_like_sql(text):
        return Extraction("unknown", [Entry(text.strip(), "whole text", 0, 1)])
    return Extraction("unknown", [], ["no SQL found"] if text and text.strip() else [])


EXTRACT_SCHEMA = "path string, kind string, seq int, sql string, source_hint string, line int, note string, placeholders array<string>, resolved boolean"


def extract_frame(scripts: DataFrame) -> DataFrame:
    """(path, text, task_type) to a row for each piece of SQL; scripts without any give no row."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, text, task in zip(batch["path"], batch["text"], batch["task_type"], strict=True):
                got = extract(text or "", task_type=task)
                rows += [(path, got.kind, i, e.sql, e.hint, e.line, e.note, e.placeholders, e.resolved) for i, e in enumerate(got.entries)]
            yield pd.DataFrame(rows, columns=["path", "kind", "seq", "sql", "source_hint", "line", "note", "placeholders", "resolved"])

    ship(scripts.sparkSession)
    return scripts.select("path", "text", "task_type").mapInPandas(run, EXTRACT_SCHEMA)


def parse_scripts(spark, scripts: list[tuple], kind: str | None = None, read_file=None) -> list[dict]:
    """Lineage of all SQL in scripts (text, source, task type); each piece is parsed alone, so a broken one costs only itself."""
    from ..plans.lineage import ParseError, aggregate, parse_texts

    found = [extract(text, kind, task_type, read_file) for text, _, task_type in scripts]
    pieces = [(source, e.sql) for got, (_, source, _) in zip(found, scripts, strict=True) for e in got.entries if e.sql]
    parsed = iter(parse_texts(spark, pieces))
    outs = []
    for got in found:
        out = {"kind": got.kind, "sqls": got.entries, "statements": [], "errors": [], "unresolved_hints": list(dict.fromkeys(got.hints)), "column_lineage": []}
        via: dict[tuple[str, str], list[str]] = {}
        for e in got.entries:
            records = next(parsed) if e.sql else []
            if isinstance(records, ParseError):
                out["errors"].append({"line": e.line, "error": str(records)})
                continue
            for r in records:
                r["statement_index"] = len(out["statements"]) + 1
                out["statements"].append(r)
                out["column_lineage"] += [c | {"source_hint": e.hint} for c in r["columns"]]
                for s, t in aggregate([r])["table_lineage"]:
                    via.setdefault((s, t), []).append(e.hint)
        out["table_lineage"] = [{"source": s, "target": t, "via": list(dict.fromkeys(v))} for (s, t), v in sorted(via.items())]
        for side in ("input", "output"):
            out[f"{side}_tables"] = list(dict.fromkeys(t for r in out["statements"] for t in r[f"{side}_table_names"]))
        outs.append(out)
    return outs


def parse_script(spark, text: str, source: str = "<script>", kind: str | None = None, task_type: str | None = None, read_file=None) -> dict:
    """Lineage of all SQL in one script."""
    return parse_scripts(spark, [(text, source, task_type)], kind, read_file)[0]
