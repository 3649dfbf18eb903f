"""The Markdown report and the HTML page of a set of runs: small tables, collected and rendered on the driver."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import stats
from .session import cut_lineage

#: Charts tell systems apart by colour; more than this can't be told apart.
MAX_SYSTEMS = 8
COLOURS = ("#4c78a8", "#f58518", "#54a24b", "#e45756", "#72b7b2", "#b279a2", "#9d755d", "#bab0ac")


def _pct(x: float | None) -> str:
    return "n/a" if x is None else f"{int(x * 100 + 0.5 + 1e-9)}%"


def _usd(x: float | None) -> str:
    return "n/a" if x is None else f"${x:.4f}"


def _cell(rate: tuple[float, float] | None) -> str:
    if rate is None:
        return "n/a"
    p, s = rate
    return f"{_pct(p)} (avg {_pct(s)})" if s is not None and abs(p - s) > 0.005 else _pct(p)


def tables(graded: DataFrame) -> dict[str, list]:
    """What a report shows, collected: rows per suite, task and system (settings-sized), never records."""
    g = cut_lineage(graded)
    diffs = cut_lineage(stats.paired_differences(g))
    return {
        "summary": stats.summary(g).join(stats.consistency(g), stats.KEY).orderBy("suite", "task", "system").collect(),
        "rates": stats.grader_rates(g).collect(),
        "paired": stats.paired(diffs).join(stats.bootstrap(diffs).drop("n"), ["suite", "grader", "a", "b"]).orderBy("suite", "grader", "a", "b").collect(),
        "models": stats.models_used(g).orderBy("system", "place").collect(),
        "judges": stats.judges_used(g).orderBy("suite", "judge").collect(),
    }


def markdown(run_id: str, t: dict[str, list], graders: dict[str, str], expected: int | None = None, found: int | None = None, failures: Sequence | None = None, details: bool = True) -> str:
    """The report as Markdown. expected and found: a banner says that the run is incomplete where they differ; failures: rows
    of `stats.failures`; without details nothing of the gold is shown."""
    out = ["# Report", "", f"Run: {run_id}", ""]
    if expected is not None and expected != found:
        out += [f"**Incomplete: {found} of {expected} records. The numbers are no valid comparison.**", ""]
    for s in dict.fromkeys(m.system for m in t["models"]):
        out.append(f"- {s}: {', '.join(m.model for m in t['models'] if m.system == s and m.model) or 'n/a'}")
    rates = {(r.suite, r.task, r.system, r.grader): (r.pass_rate, r.mean_score) for r in t["rates"]}
    for suite in dict.fromkeys(r.suite for r in t["summary"]):
        names = sorted({k[3] for k in rates if k[0] == suite})
        judges = [j.judge for j in t.get("judges", []) if j.suite == suite and j.judge]
        out += ["", f"## {suite}", "", *([f"Judged by {', '.join(judges)}.", ""] if judges else []), "| task | system | n | errors | " + " | ".join(names) + " | consistency | latency ms | tokens in/out | calls | cost | judge cost | total cost |", "|" + " --- |" * (len(names) + 11)]
        for r in sorted((x for x in t["summary"] if x.suite == suite), key=lambda x: (x.task == "ALL", x.task, x.system)):
            cells = [_cell(rates.get((suite, r.task, r.system, g))) for g in names]
            cons = "n/a" if r.consistency is None else _pct(r.consistency)
            num = lambda v, d=0: "n/a" if v is None else f"{v:.{d}f}"
            out.append(f"| {r.task} | {r.system} | {r.n} | {_pct(r.errors)} | {' | '.join(cells)} | {cons} | {num(r.latency_ms)} | {num(r.tokens_in)}/{num(r.tokens_out)} | {num(r.model_calls, 1)} | {_usd(r.cost_usd)} | {_usd(r.judge_cost_usd)} | {_usd(None if r.cost_usd is None else r.n * (r.cost_usd + (r.judge_cost_usd or 0.0)))} |")
    if t["paired"]:
        out += ["", "## Paired comparisons", "", "| suite | grader | A | B | cases | wins/ties/losses | difference | 95 % interval |", "|" + " --- |" * 8]
        pts = lambda v: f"{'+' if v >= 0 else '−'}{abs(int(v * 100 + (0.5 if v >= 0 else -0.5)))}"
        out += [f"| {p.suite} | {p.grader} | {p.a} | {p.b} | {p.n} | {p.wins}/{p.ties}/{p.losses} | {pts(p.mean_diff)} | {pts(p.low)} to {pts(p.high)} |" for p in t["paired"]]
    used = sorted({k[3] for k in rates})
    out += ["", "## Graders", "", *[f"- {g}: {graders[g]}" for g in used if g in graders]]
    if failures is not None:
        out += ["", f"## Failures ({len(failures)})", ""]
        out += [f"- {f.case_id} [{f.system}, {f.repetition}] {f.grader}" + (f": {f.detail}" if details and f.detail else "") + (f" error: {f.error}" if f.error else "") for f in failures]
    return "\n".join(out) + "\n"


def wrapped_label(text: str) -> list[str]:
    """A label on one or two lines, cut at the blank nearest its middle; underscores are blanks."""
    text = text.replace("_", " ")
    blanks = [i for i, c in enumerate(text) if c == " "]
    if len(text) <= 12 or not blanks:
        return [text]
    at = min(blanks, key=lambda i: abs(i - len(text) / 2))
    return [text[:at], text[at + 1 :]]


def bars(title: str, groups: Sequence[str], systems: Sequence[str], value: dict[tuple[str, str], tuple[float, float]]) -> str:
    """Grouped columns as SVG: a column is the mean score, a dot the pass rate."""
    if len(systems) > MAX_SYSTEMS:
        raise ValueError(f"more than {MAX_SYSTEMS} systems in one chart")
    width, step = max(1, len(groups)) * (len(systems) * 22 + 30) + 60, len(systems) * 22 + 30
    out = [f'<svg viewBox="0 0 {width} 240" role="img" aria-label="{html.escape(title, quote=True)}">']
    out += [f'<line x1="40" x2="{width}" y1="{190 - y}" y2="{190 - y}" stroke="#ddd"/><text x="34" y="{194 - y}" text-anchor="end" font-size="10">{y // 16 * 10}%</text>' for y in range(0, 161, 80)]
    for i, g in enumerate(groups):
        for j, s in enumerate(systems):
            if (v := value.get((g, s))) is None:
                continue
            x, h = 50 + i * step + j * 22, 160 * (v[1] or 0)
            out.append(f'<rect x="{x}" y="{190 - h:.1f}" width="18" height="{h:.1f}" fill="{COLOURS[j]}"><title>{html.escape(f"{s}: {_cell(v)}")}</title></rect><circle cx="{x + 9}" cy="{190 - 160 * v[0]:.1f}" r="3" fill="#222"/>')
        out += [f'<text x="{50 + i * step + step / 2 - 15}" y="{206 + 12 * k}" text-anchor="middle" font-size="11">{html.escape(line)}</text>' for k, line in enumerate(wrapped_label(g))]
    return "\n".join([*out, "</svg>"])


def page(title: str, t: dict[str, list], best: Sequence) -> str:
    """The HTML page: a chart per suite for its systems, and the comparison with the best values bold."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    rates = {(r.suite, r.grader, r.system): (r.pass_rate, r.mean_score) for r in t["rates"] if r.task == "ALL"}
    for suite in dict.fromkeys(r.suite for r in t["summary"]):
        systems = sorted({k[2] for k in rates if k[0] == suite})
        graders = sorted({k[1] for k in rates if k[0] == suite})
        out.append(f"<h2>{html.escape(suite)}</h2>")
        if 0 < len(systems) <= MAX_SYSTEMS:
            out.append(bars(suite, graders, systems, {(g, s): rates[suite, g, s] for g in graders for s in systems if (suite, g, s) in rates}))
        cells = {(b.metric, b.system): b for b in best if b.suite == suite}
        head = "".join(f"<th>{html.escape(s)}</th>" for s in systems)
        rows = ""
        for m in sorted({k[0] for k in cells}):
            tds = ""
            for s in systems:
                b = cells.get((m, s))
                v = "n/a" if b is None or b.value is None else f"{b.value:.4g}"
                tds += f"<td>{f'<b>{v}</b>' if b is not None and b.best else v}</td>"
            rows += f"<tr><td>{html.escape(m)}</td>{tds}</tr>"
        out.append(f"<table><tr><th>metric</th>{head}</tr>{rows}</table>")
    return "\n".join(out)


def markdown_to_html(text: str) -> str:
    """The subset of Markdown that the reports use: headings, lists, tables, paragraphs, bold, code, links."""

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
        s = re.sub(r"\*\*([^*]+)\*\*", r"<b>\1</b>", s)
        return re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', s)

    out: list[str] = []
    rows: list[list[str]] = []
    items: list[str] = []

    def flush() -> None:
        if rows:
            body = [r for r in rows if not all(re.fullmatch(r"\s*:?-+:?\s*", c) for c in r)]
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{inline(c.strip())}</td>" for c in r) + "</tr>" for r in body) + "</table>")
            rows.clear()
        if items:
            out.append("<ul>" + "".join(f"<li>{inline(i)}</li>" for i in items) + "</ul>")
            items.clear()

    for line in text.splitlines():
        if line.startswith("|"):
            rows.append(line.strip().strip("|").split("|"))
        elif line.startswith("- "):
            items.append(line[2:])
        else:
            flush()
            if m := re.match(r"(#{1,6}) (.*)", line):
                out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            elif line.strip():
                out.append(f"<p>{inline(line)}</p>")
    flush()
    return "\n".join(out)


def site_index(runs: Sequence[tuple[str, str, int, int]]) -> str:
    """An index page of runs: (name, suites, cases, repetitions)."""
    rows = "".join(f'<tr><td><a href="{html.escape(n)}/chart.html">{html.escape(n)}</a></td><td>{html.escape(s)}</td><td>{c}</td><td>{r}</td></tr>' for n, s, c, r in sorted(runs))
    return f"<!doctype html><meta charset=utf-8><title>Runs</title><h1>Runs</h1><table><tr><th>run</th><th>suites</th><th>cases</th><th>repetitions</th></tr>{rows}</table>"
