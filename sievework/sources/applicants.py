"""Applicant files (CSV, workbook, text document) and the rows that can be screened."""

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.functions.scalars import control_free

# Headings that people write for the known columns, lower case, letters and digits only.
COLUMNS = {
    "full_name": ("fullname", "name", "applicantname", "applicant", "customername", "clientname", "nameofapplicant"),
    "dob": ("dateofbirth", "dob", "birthdate", "dateofbirthyyyymmdd"),
    "nationality": ("nationality", "citizenship"),
    "cnic": ("cnic", "cnicnumber", "nic", "nicnumber", "nationalid", "idnumber", "idcardnumber"),
    "father_name": ("fatherorhusband", "fathername", "father", "husbandname", "husband", "fatherhusbandname", "fatherorhusbandname", "fatherhusband"),
    "province": ("province", "state", "region", "provinceterritory"),
}
HEAD_ROWS, LONGEST, UNPACKED = 10, 200, 80 << 20
ROW = "row_no int, " + ", ".join(f"{c} string" for c in COLUMNS)


def _column_of(head: str) -> str | None:
    key = re.sub(r"[^a-z0-9]", "", (head or "").lower())
    return next((c for c, known in COLUMNS.items() if key in known), None)


def named_rows(grid: list[list[str]]) -> list[tuple]:
    """Rows of a grid below its heading row, with the row number that the writer sees; no heading with a name column gives none."""
    for at, row in enumerate(grid[:HEAD_ROWS]):
        fields = [_column_of(c) for c in row]
        if "full_name" in fields:
            break
    else:
        return []
    out = []
    for no, row in enumerate(grid[at + 1 :], at + 2):
        cells = {f: c.strip() for f, c in zip(fields, row) if f and c and c.strip()}
        if cells:
            out.append((no, *[cells.get(c) for c in COLUMNS]))
    return out


def _members(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if sum(i.file_size for i in z.infolist()) > UNPACKED:
            raise ValueError("the file unpacks to too much")
        return {n: z.read(n) for n in z.namelist() if n.endswith(".xml")}


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def workbook_grid(content: bytes) -> list[list[str]]:
    """Cells of the first sheet of a zipped workbook as text; whole numbers without a decimal point."""
    parts = _members(content)
    shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ElementTree.fromstring(parts["xl/sharedStrings.xml"])] if "xl/sharedStrings.xml" in parts else []
    sheet = min(n for n in parts if re.match(r"xl/worksheets/sheet\d+\.xml$", n))
    grid: list[list[str]] = []
    for row in (e for e in ElementTree.fromstring(parts[sheet]).iter() if _tag(e) == "row"):
        cells: list[str] = []
        for c in row:
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = len(cells)
            if letters:
                at = 0
                for ch in letters.group():
                    at = at * 26 + ord(ch) - 64
                at -= 1
            value = "".join(t.text or "" for t in c.iter() if _tag(t) in ("v", "t"))
            if c.get("t") == "s" and value:
                value = shared[int(value)]
            elif re.fullmatch(r"-?\d+\.0+", value):
                value = value.partition(".")[0]
            cells += [""] * (at - len(cells)) + [value]
        number = int(row.get("r", len(grid) + 1))
        grid += [[] for _ in range(number - 1 - len(grid))] + [cells]
    return grid


def document_grid(content: bytes) -> list[list[str]]:
    """Cells of the first table of a zipped text document."""
    root = ElementTree.fromstring(_members(content)["word/document.xml"])
    table = next((e for e in root.iter() if _tag(e) == "tbl"), None)
    rows = [] if table is None else [r for r in table if _tag(r) == "tr"]
    return [["".join(t.text or "" for t in c.iter() if _tag(t) == "t") for c in r if _tag(c) == "tc"] for r in rows]


def csv_grid(content: bytes) -> list[list[str]]:
    import csv

    for encoding in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            body = content.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    head = body[:4096]
    return list(csv.reader(io.StringIO(body, newline=""), delimiter=max(",;\t|", key=head.count)))


def read_applicants(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, known columns) of applicant files; many files are read in parallel, one file in one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                kind = name.rsplit(".", 1)[-1].lower()
                grid = workbook_grid(content) if kind == "xlsx" else document_grid(content) if kind == "docx" else csv_grid(content)
                out += [(name, *row) for row in named_rows(grid)]
            yield pd.DataFrame(out, columns=["path", "row_no", *COLUMNS])

    return files.mapInPandas(run, "path string, " + ROW)


def refusal(name: Column) -> Column:
    """Why a name cannot be screened, or null: missing, too long, a script that cannot be compared, nothing to compare."""
    s = control_free(F.coalesce(name, F.lit("")))
    return (
        F.when(s == "", "Full name is missing.")
        .when((F.length(s) < 2) | (F.length(s) > LONGEST), "Full name: 2 to 200 characters.")
        .when(text.unsupported_script(s), "Full name: letters that cannot be compared.")
        .when(text.norm(s) == "", "Full name: nothing to compare.")
    )


def prepared(rows: DataFrame, name: str = "full_name") -> DataFrame:
    """Adds state ('pending' or 'invalid') and error; a row that cannot be screened stays visible."""
    marked = rows.withColumn("error", refusal(F.col(name)))
    return marked.withColumn("state", F.when(F.col("error").isNull(), "pending").otherwise("invalid"))


def results_sheet(rows: DataFrame) -> DataFrame:
    """The thirteen columns of a results sheet from (row_no, applicant columns, state, error, overall_status, sanctions, news, pep, case_ref)."""
    done = F.col("state") == "screened"
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if_done = lambda c: F.when(done, text_of(c)).otherwise("")
    note = F.when(done, "").when(F.col("state") == "pending", "Not reached yet").otherwise(F.coalesce("error", F.lit("This row could not be screened")))
    cells = {
        "Row": text_of("row_no"), "Full name": text_of("full_name"), "Date of birth": text_of("dob"), "Nationality": text_of("nationality"), "CNIC": text_of("cnic"), "Father or husband": text_of("father_name"),
        "Province": text_of("province"), "Outcome": F.when(done, text_of("overall_status")).otherwise("Not screened"), "Sanctions matches": if_done("sanctions"), "News articles": if_done("news"),
        "PEP matches": if_done("pep"), "Case reference": if_done("case_ref"), "Note": note,
    }
    return rows.select(*[v.alias(k) for k, v in cells.items()])


def manifest(files: DataFrame, name: str, content: Column) -> DataFrame:
    """(name, bytes, sha256) of stored contents."""
    return files.select(F.col(name).alias("name"), F.octet_length(content).alias("bytes"), F.sha2(content, 256).alias("sha256"))
