"""Markdown reports from results of a few rows: metrics, gates and the choice."""

from __future__ import annotations

MOST_ROWS = 1000  # of one table in a report; more is an error, not cut


def cell(value) -> str:
    """A value as a table's cell: null is a dash, floats have six digits, bars and line ends are escaped."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value).replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")


def table(df, order: list[str]) -> str:
    """A result's rows in the order of columns ``order``."""
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report's table holds at most {MOST_ROWS} rows")
    head = "| " + " | ".join(map(cell, df.columns)) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def development(metrics, gates, chosen, fingerprints: dict[str, str]) -> str:
    """The development report: the policy chosen (or that none passes), metrics, failed gates and fingerprints."""
    pick = chosen.limit(2).collect()
    if len(pick) > 1:
        raise ValueError("more than one policy is chosen")
    verdict = f"Nominated: `{cell(pick[0]['policy'])}`" if pick else "No policy passes all gates."
    prints = "\n".join(f"- {cell(k)}: `{cell(v)}`" for k, v in sorted(fingerprints.items()))
    return "\n\n".join(["# Development report", verdict, "## Metrics", table(metrics, ["policy"]), "## Failed gates", table(gates.where("NOT pass"), ["policy", "gate"]), "## Fingerprints", prints]) + "\n"
