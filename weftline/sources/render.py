"""Reports: HTML pages of an analysis and markdown of a knowledge base."""

from __future__ import annotations

import hashlib
import html
import os
import re
import time

from pyspark.sql import functions as F

from ..operators.kb import Store
from ..plans.lineage import aggregate

KEEP, MAX_ROWS, MAX_NODES = 200, 500, 24
_ID = re.compile(r"rpt_\d+_[0-9a-f]{8}")


def _table(head: list[str], rows: list[list]) -> str:
    h = "".join(f"<th>{html.escape(x)}</th>" for x in head)
    b = "".join("<tr>" + "".join(f"<td>{html.escape(str(c if c is not None else ''))}</td>" for c in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{h}</tr></thead><tbody>{b}</tbody></table>"


def _columns(pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Longest-path columns of a small graph; edges that close a cycle are passed over after as many rounds as nodes."""
    names = sorted({n for p in pairs for n in p})
    at = dict.fromkeys(names, 0)
    for _ in names:
        for s, t in pairs:
            if s != t and at[t] < at[s] + 1 <= len(names):
                at[t] = at[s] + 1
    return at


def svg(pairs: list[tuple[str, str]]) -> str:
    names = sorted({n for p in pairs for n in p})[:MAX_NODES]
    pairs = [p for p in pairs if p[0] in names and p[1] in names]
    cols, seen, place = _columns(pairs), {}, {}
    for n in names:
        c = cols.get(n, 0)
        place[n] = (20 + 240 * c, 20 + 50 * seen.get(c, 0))
        seen[c] = seen.get(c, 0) + 1
    lines = "".join(f'<path d="M{place[s][0] + 200},{place[s][1] + 15} L{place[t][0]},{place[t][1] + 15}" stroke="#888" fill="none"/>' for s, t in pairs)
    boxes = "".join(f'<g><rect x="{x}" y="{y}" width="200" height="30" rx="4" fill="#eef" stroke="#557"/><text x="{x + 6}" y="{y + 20}" font-size="12">{html.escape(n)}</text></g>' for n, (x, y) in place.items())
    w, h = max((x for x, _ in place.values()), default=0) + 230, max((y for _, y in place.values()), default=0) + 60
    return f'<svg viewBox="0 0 {w} {h}" width="{w}" height="{h}">{lines}{boxes}</svg>'


def report(records: list[dict], title: str, metrics: list[dict] = ()) -> str:
    a = aggregate(records)
    cols = a["column_lineage"][:MAX_ROWS]
    parts = [
        f"<h1>{html.escape(title)}</h1><p>{len(records)} statements, {len(a['input_tables'])} inputs, {len(a['output_tables'])} outputs, {len(a['column_lineage'])} column mappings</p>",
        "<h2>Tables</h2>" + _table(["source", "target"], [list(p) for p in a["table_lineage"]]),
        "<h2>Columns</h2>" + _table(["target", "column", "source", "column", "expression", "resolved"], [[c["target_table"], c["target_column"], c["source_table"], c["source_column"], c["expression"], c["resolved"]] for c in cols]),
        "<h2>Metrics</h2>" + _table(["metric", "table", "formula"], [[m["metric_name"], m["table_name"], m["formula"]] for m in metrics]),
        "<h2>Graph</h2>" + svg(a["table_lineage"]),
        "<h2>SQL</h2>" + "".join(f"<pre>{html.escape(r['sql'])}</pre>" for r in records),
    ]
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font-family:sans-serif}}td,th{{border:1px solid #ccc;padding:2px 6px}}table{{border-collapse:collapse}}</style>" + "".join(parts)


def workflow_report(found: dict, title: str) -> str:
    """A page of a workflow analysis: counts, the longest chain, dependencies, what each task reads and writes, issues."""
    show = lambda df, cols, order: _table(cols, [[", ".join(map(str, r[c])) if isinstance(r[c], list) else r[c] for c in cols] for r in df.select(*cols).orderBy(*order).limit(MAX_ROWS).collect()])
    g = found["graph"].pairs()
    parts = [
        f"<h1>{html.escape(title)}</h1>" + _table(list(found["stats"]), [list(found["stats"].values())]), "<h2>Longest chain</h2><p>" + html.escape(" → ".join(found["chain"])) + "</p>",
        "<h2>Dependencies of workflows</h2>" + show(found["dependencies"], ["source", "target", "kind", "via_tables"], ["source", "target", "kind"]),
        "<h2>Tasks and tables</h2>" + show(found["task_tables"], ["workflow_code", "task_code", "table", "direction"], ["workflow_code", "task_code", "direction", "table"]),
        "<h2>Between workflows</h2>" + show(found["cross_workflow"], ["table", "writers", "readers"], ["table"]), "<h2>Issues</h2>" + show(found["quality"], ["issue", "table", "detail"], ["issue", "table"]),
        "<h2>Graph</h2>" + svg(g if g is not None else []),
    ]
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font-family:sans-serif}}td,th{{border:1px solid #ccc;padding:2px 6px}}table{{border-collapse:collapse}}</style>" + "".join(parts)


def save_report(page: str, folder: str) -> str:
    """Writes a page and returns its id; the oldest beyond KEEP go."""
    os.makedirs(folder, exist_ok=True)
    rid = f"rpt_{int(time.time())}_{hashlib.sha1(page.encode()).hexdigest()[:8]}"
    with open(os.path.join(folder, f"{rid}.html"), "w", encoding="utf-8") as f:
        f.write(page)
    for old in list_reports(folder)[KEEP:]:
        os.remove(os.path.join(folder, f"{old}.html"))
    return rid


def list_reports(folder: str) -> list[str]:
    names = [n[:-5] for n in os.listdir(folder) if n.endswith(".html") and _ID.fullmatch(n[:-5])] if os.path.isdir(folder) else []
    return sorted(names, reverse=True)


def load_report(rid: str, folder: str) -> str | None:
    if not _ID.fullmatch(rid):
        return None
    path = os.path.join(folder, f"{rid}.html")
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()


def graph_page(pairs: list[tuple[str, str]], title: str = "lineage") -> str:
    """A page of its own with the graph; nothing is loaded from elsewhere."""
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title>{svg(pairs)}"


def kb_markdown(store: Store, limit: int = 500) -> str:
    """The knowledge base in nine parts."""
    s = store.summary()

    def table(df, cols):
        rows = df.select(*cols).limit(limit + 1).collect()
        more = df.count() - limit if len(rows) > limit else 0
        rows = rows[:limit]
        cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
        return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *["| " + " | ".join(cell(r[c]) for c in cols) + " |" for r in rows], *([f"\n{more} more rows are not shown."] if more else [])])

    m, f, t = store.table("metrics"), store.table("fields"), store.table("tables")
    parts = [
        "# Knowledge base", "## 1 Overview", "\n".join(f"- {k}: {v}" for k, v in s["counts"].items()), "## 2 Metrics by layer", "\n".join(f"- {k}: {v}" for k, v in s["metrics_by_layer"].items()),
        "## 3 Metrics", table(m.orderBy("layer", "table_name", "metric_name"), ["metric_name", "table_name", "metric_type", "formula", "confidence"]),
        "## 4 Terms", table(store.table("terms").orderBy("term"), ["term", "chinese_name", "category", "source", "occurrences"]), "## 5 Fields by table", table(f.orderBy("table_name", "column_name"), ["table_name", "column_name", "chinese_name", "role", "unit"]),
        "## 6 Rules", table(store.table("rules").orderBy("rule_type", "expression"), ["rule_type", "expression", "description", "source_file"]),
        "## 7 To be confirmed", table(f.where(F.col("confidence") < 0.5).orderBy("table_name", "column_name"), ["table_name", "column_name", "chinese_source", "confidence"]),
        "## 8 Scripts", table(store.table("scripts").orderBy("source_file"), ["source_file", "statement_count", "header_comment"]), "## 9 Limits", f"Names come from comments, a glossary and rules; {t.where('is_root').count()} tables have no known source. Each list shows at most {limit} rows.",
    ]
    return "\n\n".join(parts)
