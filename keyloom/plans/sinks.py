"""Writing results for people: CSV files, a workbook, Markdown and JSON reports.

Reports are small by contract (a plan has hundreds of rows); each writer that
gathers rows checks a bound first and refuses to cut them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tabular import write_workbook


def bounded_rows(df: DataFrame, most: int = 100_000) -> list[list[object]]:
    """All rows, for a report; an error where there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write it as a table instead")
    return [list(r) for r in rows]


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header, arrays joined by bars; as many files as partitions."""
    flat = [F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if t.startswith("array<") and "struct" not in t else (F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c)) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def spreadsheet_csv(df: DataFrame, most: int = 100_000) -> bytes:
    """A small table as CSV that spreadsheets open as UTF-8: a byte order mark first, lines ended as they expect."""
    import csv as writer
    import io

    out = io.StringIO()
    w = writer.writer(out, lineterminator="\r\n")
    w.writerow(df.columns)
    w.writerows([["|".join(map(str, v)) if isinstance(v, list) else v for v in r] for r in bounded_rows(df, most)])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


#: What spreadsheets take in.
SHEET_NAME, SHEET_ROWS, CELL_TEXT = 31, 1_048_576, 32_767


def workbook(sheets: dict[str, DataFrame], most: int = 100_000) -> bytes:
    """A workbook of small tables, one sheet each, headers first; names, rows and texts beyond a spreadsheet's limits are errors."""
    names = [n.lower() for n in sheets]
    wrong = [n for n in sheets if not n or len(n) > SHEET_NAME or set(n) & set("[]:*?/\\") or n[0] == "'" or n[-1] == "'"]
    if wrong or len(set(names)) < len(names):
        raise ValueError(f"names that no sheet can have, or twice: {wrong or names}")
    tables = {}
    for name, df in sheets.items():
        rows = [["; ".join(map(str, v)) if isinstance(v, list) else v for v in r] for r in bounded_rows(df, min(most, SHEET_ROWS - 1))]
        if any(isinstance(v, str) and len(v) > CELL_TEXT for r in rows for v in r):
            raise ValueError(f"a text of more than {CELL_TEXT} characters in {name!r}")
        tables[name] = [df.columns, *rows]
    return write_workbook(tables)


def markdown(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in bounded_rows(df, most)]) + "\n"


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def link_formula(url, anchor):
    """A spreadsheet link; quotes doubled; plain text where the formula would exceed 8000 characters."""
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit('""'))
    formula = F.concat(F.lit('=HYPERLINK("'), quoted(url), F.lit('","'), quoted(anchor), F.lit('")'))
    return F.when(F.length(formula) <= 8000, formula).otherwise(F.concat_ws(" || ", anchor, url))
