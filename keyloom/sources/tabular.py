"""Keyword tables from text files and workbooks with unknown layouts.

The driver looks at the first kilobytes of a file to find its encoding, header
row, delimiter and columns; the body is read by Spark, as strings, and typed by
column expressions.  Workbooks are zipped XML and small; they are parsed on the
executors from ``binaryFile`` rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import numbers as N

# Canonical columns and the headers that name them, in order of preference.
ALIASES: dict[str, tuple[str, ...]] = {
    "keyword": (
        "keyword", "keywords", "query", "queries", "top queries", "top query", "search term", "search terms", "term", "phrase", "từ khóa", "từ khoá",
        "main keyword",
    ),
    "volume": (
        "volume", "search volume", "avg. monthly searches", "avg monthly searches", "monthly searches", "monthly volume", "sv", "us volume",
        "uk volume",
    ),
    "impressions": ("impressions",),
    "clicks": ("clicks",),
    "kd": ("kd", "kd %", "kd%", "keyword difficulty", "keyword difficulty index", "difficulty", "seo difficulty"),
    "pkd": ("personal keyword difficulty", "pkd", "pkd %", "pkd%"),
    "cpc": ("cpc", "cost per click", "top of page bid"),
    "market": ("market", "country", "location", "geo", "country code", "database"),
    "serp_urls": ("serp_urls", "serp urls", "top_urls", "top urls", "serp", "top 10 urls", "serp results"),
    "intent": ("intent", "intents", "search intent", "keyword intents"),
    "parent": ("parent topic", "parent_topic", "parent keyword"),
    "position": ("position", "avg. position", "average position", "current position"),
    "features": ("serp features", "serp features by keyword", "features"),
    "trend": ("trend", "trends", "sv trend", "volume trend"),
    "traffic_potential": ("traffic potential",),
    "url": ("url", "current url", "page", "landing page"),
    "competitive_density": ("competitive density",),
    "results": ("number of results",),
    "click_potential": ("click potential",),
    "change_3m": ("three month change",),
    "change_yoy": ("yoy change",),
    "flag_branded": ("branded",),
    "flag_local": ("local",),
    "flag_informational": ("informational",),
    "flag_commercial": ("commercial",),
    "flag_transactional": ("transactional",),
    "flag_navigational": ("navigational",),
    "group": ("cluster", "cluster name", "group", "keyword group", "topic", "nhóm", "cụm", "nhóm từ khóa", "nhóm từ khoá", "chủ đề"),
    "main": ("main keyword", "primary keyword", "từ khóa chính", "từ khoá chính"),
    "secondary": ("secondary keyword", "secondary keywords", "từ khóa phụ", "từ khoá phụ"),
    "role": ("page type", "category kind", "kind", "post kind", "page kind", "pillar/cluster", "loại bài", "loại"),
    "pillar": ("pillar", "thuộc pillar"),
    "stt": ("stt",),
    "status": ("trạng thái", "status"),
    "url_blog": ("url blog", "target url"),
    "category": ("category", "danh mục"),
}
INTENT_FLAGS = ("informational", "commercial", "transactional", "navigational")
#: What a header must hold to come from a kind of tool; the first that fits.
TOOLS: tuple[tuple[str, tuple[frozenset[str], ...]], ...] = (
    ("team plan", (frozenset({"main keyword", "thuộc pillar"}), frozenset({"main keyword", "category kind"}))),
    ("strategy builder", (frozenset({"page", "topic"}), frozenset({"page type"}), frozenset({"seed keyword"}))),
    ("site explorer", tuple(frozenset({"current url", f}) for f in (*INTENT_FLAGS, "branded", "local"))),
    ("positions", (frozenset({"position", "url"}),)),
    ("api", (frozenset({"keyword difficulty index"}), frozenset({"database"}))),
    ("explorer", (frozenset({"parent keyword"}), frozenset({"parent topic"}), frozenset({"traffic potential"}))),
    ("planner", (frozenset({"avg. monthly searches"}),)),
    ("search console", (frozenset({"top queries"}), frozenset({"impressions", "ctr"}))),
    ("research", (frozenset({"competitive density"}), frozenset({"number of results"}), frozenset({"trend", "keyword difficulty"}))),
)
#: How export tools name their files; db is the market's code.
FILE_NAMES = (
    r"-organic\.positions-(?P<db>[a-z]{2})-(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})",
    r"^google_(?P<db>[a-z]{2})_(?:.*?_(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2}))?",
    r"_(?:clusters|list)_(?P<db>)(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})",
    r"_(?P<db>[a-z]{2})_(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})",
)
DELIMITERS = (",", "\t", ";", "|")
HEADER_LINES = 40


def decode(data: bytes, sample: bool = False) -> tuple[str, str]:
    """Text and Spark's name of the encoding: byte order mark, zeros of UTF-16, UTF-8, else Windows-1252."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "ignore"), "UTF-8"
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return data.decode("utf-16", "ignore"), "UTF-16"
    if data and data[:4096].count(0) > len(data[:4096]) // 5:
        little = data[1:4096:2].count(0) > data[0:4096:2].count(0)
        return data.decode("utf-16-le" if little else "utf-16-be", "ignore"), "UTF-16LE" if little else "UTF-16BE"
    try:
        return data.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError as e:
        if sample and e.start >= len(data) - 4:  # cut inside a character at the end of the sample
            return data[: e.start].decode("utf-8"), "UTF-8"
        return data.decode("cp1252", "replace"), "windows-1252"


def header_form(cell: str) -> str:
    """A header's comparable form: lower case, single blanks, a trailing parenthesis dropped."""
    x = re.sub(r"\s+", " ", cell.strip().lower().replace("’", "'"))
    return re.sub(r"\s*\([^)]*\)$", "", x)


def cells_of(line: str, delimiter: str) -> list[str]:
    import csv

    return next(csv.reader([line], delimiter=delimiter), [])


def find_header(lines: list[str], names: frozenset[str] | None = None) -> tuple[int, str]:
    """Row and delimiter of the header: the first line with a keyword column; the delimiter that gives most cells."""
    names = names or frozenset(ALIASES["keyword"])
    for i, line in enumerate(lines[:HEADER_LINES]):
        best = max(DELIMITERS, key=lambda d: len(cells_of(line, d)))
        if names & {header_form(c) for c in cells_of(line, best)}:
            return i, best
    raise ValueError("no header row with a keyword column in the first lines")


def column_map(header: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Canonical column to physical header; overrides first, then the first alias; one header feeds one column.

    ``topic`` is a pillar where a page column exists, else a group.
    """
    forms = {header_form(h): h for h in reversed(header)}
    out, used = {}, set()
    for name, physical in (overrides or {}).items():
        if header_form(physical) not in forms:
            raise ValueError(f"no column {physical!r}")
        out[name] = forms[header_form(physical)]
        used.add(out[name])
    for name, aliases in ALIASES.items():
        for a in aliases:
            if name not in out and a in forms and forms[a] not in used:
                if a == "topic" and "page" in forms:
                    out["pillar"] = forms[a]
                else:
                    out[name] = forms[a]
                used.add(forms[a])
    return out


def tool_of(header: list[str], file: str = "") -> str:
    """The kind of tool that a header comes from; of a plain header the file's name may tell."""
    forms = {header_form(h) for h in header}
    by_name = "research" if re.search(r"_(broad-match|phrase-match|exact-match|related|all-keywords|questions)_", file.lower()) else "unknown"
    return next((name for name, needs in TOOLS if any(n <= forms for n in needs)), by_name)


def market_and_date(name: str) -> tuple[str, str]:
    """Market and date that a file name tells, by the tools' forms, else by any code and date in it; empty where it doesn't."""
    low = name.lower()
    for form in FILE_NAMES:
        if found := re.search(form, low):
            date = "-".join(found.group(*"ymd")) if found["y"] else ""
            return N.MARKETS.get(found["db"], found["db"]) if found["db"] else "", date
    market = re.search(r"(?:^|[^a-z])(us|uk|gb|usa)(?:[^a-z]|$)", low)
    date = re.search(r"(20\d\d)[-_.]?([01]\d)[-_.]?([0-3]\d)", low)
    return N.MARKETS.get(market[1], "") if market else "", "-".join(date.groups()) if date else ""


@dataclass
class Layout:
    """What the driver found in a file's head."""

    path: str
    encoding: str
    header_row: int
    delimiter: str
    header: list[str]
    columns: dict[str, str]
    tool: str
    market: str
    date: str
    ignored: list[str] = field(default_factory=list)


def layout(spark: SparkSession, path: str, overrides: dict[str, str] | None = None, sample: int = 65536) -> Layout:
    """Read a file's head through Spark, so any store that Spark reaches will do."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, sample).alias("head")).first()
    text, encoding = decode(bytes(raw["head"]), len(raw["head"]) >= sample)
    lines = text.splitlines()
    row, delimiter = find_header(lines)
    header = [c.strip() for c in cells_of(lines[row], delimiter)]
    columns = column_map(header, overrides)
    market, date = market_and_date(raw["path"].rsplit("/", 1)[-1])
    ignored = [h for h in header if h and h not in columns.values()]
    return Layout(path, encoding, row, delimiter, header, columns, tool_of(header, raw["path"].rsplit("/", 1)[-1]), market, date, ignored)


def read_text(spark: SparkSession, path: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """A text table's canonical columns as strings, with _src, _tool and _market; blank rows skipped.

    Quoted cells keep their newlines.  Rows above the header are skipped by
    position: lines are numbered only where there is a preamble.
    """
    found = layout(spark, path, overrides)
    names = [f"c{i}" for i in range(len(found.header))]
    schema = ", ".join(f"{n} string" for n in names)
    reader = spark.read.schema(schema).option("sep", found.delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", found.encoding).option("mode", "PERMISSIVE")
    rows = reader.csv(path)
    at = {h: n for h, n in reversed(list(zip(found.header, names)))}
    body = rows.filter(~(F.trim(F.coalesce(F.col(at[found.columns["keyword"]]), F.lit(""))) == found.columns["keyword"]))
    if found.header_row:
        first_cells = [cells_of(line, found.delimiter)[:1] for line in _head_lines(spark, path)[: found.header_row]]
        preamble = [c[0].lstrip("﻿").strip() for c in first_cells if c]
        others_blank = F.forall(F.array(*[F.coalesce(F.trim(F.col(n)), F.lit("")) for n in names[1:]] or [F.lit("")]), lambda v: v == "")
        body = body.filter(~(F.trim(F.coalesce(F.col(names[0]), F.lit(""))).isin(*preamble) & others_blank)) if preamble else body
    chosen = [F.trim(F.col(at[physical])).alias(name) for name, physical in found.columns.items()]
    some = F.exists(F.array(*[F.coalesce(F.trim(F.col(n)), F.lit("")) for n in names]), lambda v: v != "")
    return body.filter(some).select(
        *chosen, F.lit(path.rsplit("/", 1)[-1]).alias("_src"), F.lit(found.tool).alias("_tool"), F.lit(found.market).alias("_market"),
    )


def _head_lines(spark: SparkSession, path: str) -> list[str]:
    raw = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("head")).first()
    return decode(bytes(raw["head"]), len(raw["head"]) >= 65536)[0].splitlines()


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def workbook_sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(sheet name, rows) of a workbook: shared, inline, rich and formula strings, booleans, gaps between cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [
                "".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_NS}si")
            ]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows: list[list[str]] = []
            for row in root.iter(f"{_NS}row"):
                cells: list[str] = []
                for c in row.findall(f"{_NS}c"):
                    at = _column_number(c.get("r", "")) if c.get("r") else len(cells)
                    cells.extend([""] * (at - len(cells)))
                    value = c.find(f"{_NS}v")
                    text = value.text or "" if value is not None else ""
                    if c.get("t") == "s" and text:
                        text = shared[int(text)]
                    elif c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif c.get("t") == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    cells.append(text)
                rows.append(cells)
            yield sheet.get("name", ""), rows


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(_src, _sheet, row, record map) of every sheet with a keyword header in the workbooks under ``path``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, content in zip(pdf["path"], pdf["content"]):
                for name, rows in workbook_sheets(bytes(content)):
                    at = next((i for i, r in enumerate(rows[:HEADER_LINES]) if frozenset(ALIASES["keyword"]) & {header_form(c) for c in r}), None)
                    if at is None:
                        continue
                    columns = column_map(rows[at])
                    place = {k: rows[at].index(v) for k, v in columns.items()}
                    records = [(source.rsplit("/", 1)[-1], name, i, {k: r[p].strip() if p < len(r) else "" for k, p in place.items()}) for i, r in enumerate(rows[at + 1 :], at + 1) if any(c.strip() for c in r)]
                    yield pd.DataFrame(records, columns=["_src", "_sheet", "row", "record"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "_src string, _sheet string, row long, record map<string,string>")


def write_workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """A small workbook (plan sheets); cells beginning with ``=`` are formulas."""
    from xml.sax.saxutils import escape

    def letter(n: int) -> str:
        out = ""
        n += 1
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(value: object, ref: str) -> str:
        if value is None or value == "":
            return ""
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value}</v></c>'
        if str(value).startswith("="):
            return f'<c r="{ref}" t="str"><f>{escape(str(value)[1:])}</f></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    main, rel = _NS.strip("{}"), _REL.split("}")[0].strip("{")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(
            f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)
        )
        z.writestr(
            "[Content_Types].xml",
            f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
        )
        z.writestr(
            "_rels/.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        )
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(
                f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)
            ) + "</Relationships>",
        )
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(v, f"{letter(c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def typed(rows: DataFrame, default_market: str = "", range_mode: str = "low") -> DataFrame:
    """Canonical string columns to typed ones: numbers, market, the class of the volume (3 exact .. 0 none); a range of volumes counts by its ``low``, ``mid`` or ``high`` end."""
    have = set(rows.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    volume, impressions, clicks = (N.parse_number(col(n), integer=True, range_mode=range_mode) for n in ("volume", "impressions", "clicks"))
    value = F.coalesce(volume["value"], impressions["value"], clicks["value"])
    estimate = F.coalesce(volume["estimate"], F.lit(False))
    vclass = F.when(volume["value"].isNotNull(), F.when(estimate, 2).otherwise(3)).when(value.isNotNull(), 1).otherwise(0)
    kd = F.coalesce(N.parse_number(col("pkd"))["value"], N.parse_number(col("kd"))["value"])
    market = F.coalesce(F.nullif(N.market(col("market")), F.lit("")), F.nullif(col("_market"), F.lit("")), F.lit(default_market))
    return rows.select(
        "keyword", market.alias("market"), F.coalesce(value.cast("long"), F.lit(0)).alias("volume"), estimate.alias("vol_est"), vclass.alias("vclass"), kd.alias("kd"), N.parse_number(col("cpc"))["value"].alias("cpc"),
        N.parse_number(col("position"))["value"].alias("position"), col("url").alias("url"), col("parent").alias("parent"), col("intent").alias("intent"), col("features").alias("features"), N.parse_number(col("traffic_potential"), integer=True)["value"].cast("long").alias("traffic_potential"),
        E.intents(
            col("intent"), {n: col(f"flag_{n}") for n in (*INTENT_FLAGS, "branded", "local")},
        ).alias("intents"), col("group").alias("group"), col("main").alias("main"), col("role").alias("role"), col("pillar").alias("pillar"), col("status").alias("status"), col("_src").alias("src"), col("_tool").alias("tool"),
    ).filter("coalesce(trim(keyword), '') <> ''")
