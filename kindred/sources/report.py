"""Reports: Markdown tables of metric frames, and the package of a run."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows of a table that a report shows; metric frames are small, and a report says when it leaves some out.
SHOWN = 200


def markdown(df: DataFrame, title: str, digits: int = 4) -> str:
    """A metric frame as a Markdown table."""
    rows = df.limit(SHOWN + 1).collect()
    cell = lambda x: "" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", r"\|")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows[:SHOWN]]
    return "\n".join([*lines, *(["", f"The first {SHOWN} rows."] if len(rows) > SHOWN else [])]) + "\n"


def write_report(frames: dict[str, DataFrame], path: str, head: str = "") -> None:
    Path(path).write_text("\n".join([head, *(markdown(df, t) for t, df in frames.items())]), encoding="utf-8")


def package(files: list[str], to: str) -> str:
    """A zip of files under their own names, the same bytes for the same contents."""
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(files):
            z.writestr(zipfile.ZipInfo(Path(f).name, (1980, 1, 1, 0, 0, 0)), Path(f).read_bytes(), zipfile.ZIP_DEFLATED)
    return to


def write_table(df: DataFrame, path: str) -> None:
    """A table artifact as Parquet."""
    df.write.mode("overwrite").parquet(path)
