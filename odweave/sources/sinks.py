"""Small outputs: one-file CSV, JSON, Markdown and LaTeX tables.  Rows are collected only up to a stated limit."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows that a document table may have.
MOST_ROWS = 10_000


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def _cells(df: DataFrame, digits: int) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a document table has at most {MOST_ROWS} rows")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return df.columns, [[show(v) for v in r] for r in rows]


def markdown(df: DataFrame, digits: int = 3) -> str:
    head, rows = _cells(df, digits)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)]) + "\n"


def latex(df: DataFrame, digits: int = 3) -> str:
    head, rows = _cells(df, digits)
    safe = lambda c: "".join("\\" + x if x in "&%$#_{}" else x for x in c)
    line = lambda cells: " & ".join(map(safe, cells)) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(head) + "}", r"\hline", line(head), r"\hline", *map(line, rows), r"\hline", r"\end{tabular}"]) + "\n"


def write_json(value: dict, path: str) -> None:
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")
