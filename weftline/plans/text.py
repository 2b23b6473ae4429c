"""SQL text before it reaches the parser: tokens, statements, quoting of non-ASCII names, QUALIFY, comments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_WIDE_STOPS = "，。；：、！？"
TOKEN = re.compile(
    r"(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<string>'(?:\\.|''|[^'\\])*'|\"(?:\\.|\"\"|[^\"\\])*\")"
    r"|(?P<quoted>`(?:``|[^`])*`)"
    rf"|(?P<word>(?:[A-Za-z_]|[^\x00-\x7F\s{_WIDE_STOPS}])(?:\w|[^\x00-\x7F\s{_WIDE_STOPS}])*)"
    r"|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<sign>.)",
    re.S,
)
_BARE_WIDE = re.compile(r"`([^`]*[^\x00-\x7F][^`]*)`")
_CLAUSE_END = {"ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "MINUS", "CLUSTER", "DISTRIBUTE", "SORT", "INSERT", "WINDOW"}


def tokens(sql: str):
    for m in TOKEN.finditer(sql):
        yield m.lastgroup, m.group(), m.start()


def split_statements(sql: str) -> list[tuple[int, str]]:
    """(offset, text) of each statement; semicolons in strings, comments and quoted names do not count."""
    out, start, real = [], 0, False
    for kind, text, at in tokens(sql):
        if kind == "sign" and text == ";":
            if real:
                out.append((start, sql[start:at]))
            start, real = at + 1, False
        elif kind not in ("space", "comment"):
            real = True
    if real:
        out.append((start, sql[start:]))
    return out


@dataclass
class Prepared:
    """Text for the parser and the conditions of QUALIFY clauses taken out of it."""

    text: str
    qualify: list[str] = field(default_factory=list)


def prepare(sql: str) -> Prepared:
    """Back-quotes bare non-ASCII names and takes out QUALIFY clauses, which the parser does not know."""
    out, conds, depth, inside = [], [], 0, None
    for kind, text, _ in tokens(sql):
        if text == "(" and kind == "sign":
            depth += 1
        if text == ")" and kind == "sign":
            depth -= 1
        if inside is not None:
            ends = depth < inside or (depth == inside and kind == "word" and text.upper() in _CLAUSE_END)
            if not ends:
                conds[-1] += text
                continue
            inside = None
        if kind == "word" and text.upper() == "QUALIFY":
            inside = depth
            conds.append("")
            continue
        out.append(f"`{text}`" if kind == "word" and not text.isascii() else text)
    return Prepared("".join(out), [c.strip() for c in conds])


def shown(text: str) -> str:
    """A slice of prepared text as its author wrote it, but for comments, which become a blank."""
    if "--" in text or "/*" in text:
        kept: list[str] = []
        for kind, part, _ in tokens(text):
            gap = kind == "comment" or kind == "space" and kept[-1:] == [" "]
            if gap and kept and kept[-1].isspace():
                kept.pop()
            kept.append(" " if gap else part)
        text = "".join(kept)
    return _BARE_WIDE.sub(r"\1", text).strip()


def without_comments(sql: str) -> str:
    return "".join(" " if kind == "comment" else text for kind, text, _ in tokens(sql))


@dataclass
class Comments:
    header: str = ""
    columns: dict[str, str] = field(default_factory=dict)
    where: list[tuple[str, str]] = field(default_factory=list)
    notes: list[tuple[str, str]] = field(default_factory=list)
    tables: dict[str, str] = field(default_factory=dict)


_ALIAS = re.compile(r"(?:\bAS\s+)?`?([^\W\d]\w*)`?\s*,?\s*$", re.I)
_TABLE_COMMENT = re.compile(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`]+).*?\bCOMMENT\s+'([^']*)'", re.I | re.S)


def comments(sql: str) -> Comments:
    """Header block, column comments (the first of a name wins), comments of filter lines, other notes, table comments."""
    out, head, started = Comments(), [], False
    for line in sql.splitlines():
        code, note = line, ""
        for kind, text, at in tokens(line):
            if kind == "comment" and text.startswith("--"):
                code, note = line[:at], text[2:].strip().strip("-=*# ").strip()
                break
        if not code.strip():
            if note and not started:
                head.append(note)
            continue
        started = True
        if not note:
            continue
        if re.match(r"\s*(WHERE|AND|OR|HAVING)\b", code, re.I):
            out.where.append((code.strip(), note))
            continue
        m = _ALIAS.search(code)
        if m and not re.search(r"\b(FROM|JOIN|TABLE|INTO)\b", code, re.I):
            out.columns.setdefault(m.group(1).lower(), note)
        else:
            out.notes.append((code.strip()[:60], note))
    out.header = "\n".join(head)
    for name, note in _TABLE_COMMENT.findall(sql):
        out.tables.setdefault(name.replace("`", ""), note)
    return out
