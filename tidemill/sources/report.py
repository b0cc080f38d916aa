"""The self-contained HTML quality report: counts only, every value escaped."""

from __future__ import annotations

import html
from collections.abc import Iterable, Mapping

from ..functions.contracts import AS_OF, DEMO_SEED, OUTPUTS, PIPELINE_VERSION, SPECIFICATION_VERSION, TIMEZONE

_STYLE = "body{font:16px/1.5 sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .6rem;text-align:left}"


def share(count: int, total: int) -> str:
    """A percentage with one decimal; n/a of nothing."""
    return f"{100 * count / total:.1f}%" if total else "n/a"


def _e(x: object) -> str:
    return html.escape(str(x), quote=True)


def _table(head: Iterable[str], rows: Iterable[Iterable[object]]) -> str:
    line = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{_e(x)}</{tag}>" for x in xs) + "</tr>"
    return "<table>\n" + line("th", head) + "\n" + "\n".join(line("td", r) for r in rows) + "\n</table>"


def build_report(summary: Mapping, rejected: Mapping[str, int], full_pipeline: bool) -> str:
    """Eight sections in fixed order from the summary and the rejected rows' dispositions."""
    t, refs, files = summary["transaction_counts"], summary["reference_counts"], summary["input_files"]
    equation = f"{t['input']} input rows = {t['accepted']} accepted + {t['quarantined']} quarantined + {t['deduplicated']} deduplicated"
    outside = sum(n for d, n in rejected.items() if d.startswith("REFERENCE_"))
    state = (
        "All six artifacts were generated and verified by the completed pipeline."
        if full_pipeline
        else "Only the evidence artifacts are written here; the cleaned outputs belong to the full pipeline."
    )
    sections = (
        ("Processed inputs", _table(("Input file", "Record type", "Data rows", "Selected sheets"), ((f["path"], f["record_type"], f["row_count"], ", ".join(f["selected_sheets"]) or "(none)") for f in files))),
        ("Transaction dispositions", _table(("Disposition", "Rows", "Share of input"), ((k.capitalize(), t[k], share(t[k], t["input"])) for k in ("input", "accepted", "quarantined", "deduplicated"))) + f"\n<p>Each transaction row has exactly one disposition. rejected_rows.csv holds {sum(rejected.values())} rows, {outside} of them reference rows.</p>"),
        ("Reconciliation", f"<p>{_e(equation)}</p>\n<p>Reconciliation: {'PASS' if t['reconciled'] else 'FAIL'}</p>"),
        ("Defect and normalization counts", _table(("Rule code", "Audit events"), sorted(summary["rule_counts"].items())) + "\n" + _table(("Rule code", "Audit events"), sorted(summary["normalization_counts"].items()))),
        ("Reference data quality", _table(("Reference table", "Input", "Usable", "Rejected", "Deduplicated"), ((r, c["input"], c["valid"], c["rejected"], c["deduplicated"]) for r, c in refs.items())) + f"\n<p>Near-duplicate name candidates: {summary['rule_counts'].get('FUZZY_CUSTOMER_CANDIDATE', 0)}; they are evidence and merge nothing.</p>"),
        ("Safeguards", "<ul><li>Every row keeps its file, sheet and row number.</li><li>Rows that break a rule are quarantined with codes and reasons, never corrected in silence.</li><li>Every change, rejection and flag is an audit row.</li><li>Equal inputs give equal bytes.</li></ul>"),
        ("Output artifacts", "<ul>" + "".join(f"<li>{_e(o)}</li>" for o in OUTPUTS) + f"</ul>\n<p>{state}</p>"),
        ("Limitations and non-goals", f"<ul><li>Three fixed schemas with an exhaustive list of headers.</li><li>Bounded date, money, country and category forms; the clock stands at {AS_OF} ({TIMEZONE}).</li><li>No entity resolution, no streaming, no services.</li></ul>"),
    )
    body = "\n".join(f"<h2>{i}. {name}</h2>\n{text}" for i, (name, text) in enumerate(sections, 1))
    head = f"<p>Specification version {SPECIFICATION_VERSION}; demo date {AS_OF} ({TIMEZONE}); pipeline version {PIPELINE_VERSION}; demo seed {DEMO_SEED}</p>"
    return f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>Data quality report</title>\n<style>{_STYLE}</style>\n</head>\n<body>\n<h1>Data quality report</h1>\n{head}\n{body}\n</body>\n</html>\n'
