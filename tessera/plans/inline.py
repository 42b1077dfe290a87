"""Cases of functions whose subject the tables do not hold, carried by documents.

Each document takes a case by its id, and the case's texts are joined with the document's own, so what a function reads
differs from row to row and grows with the table.  The same expressions build the rows in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The beginning of the document that a case is joined with, without brackets.
OWN = "translate(substr(d.text, 1, 200), '[]{}', '    ')"


def after(column: str) -> str:
    """The case's text, and the document's on the next line."""
    return f"c.{column} || chr(10) || {OWN}"


def some_after(column: str) -> str:
    """As after(), for every second document; the others have the case's text alone."""
    return f"CASE WHEN d.doc_id // 64 % 2 = 0 THEN c.{column} ELSE {after(column)} END"


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """(VALUES ...) AS t(columns), to be put after FROM; line feeds stay within the quotes."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS t({columns})"


def _numbered(rows: list[tuple], columns: list[str]) -> tuple[list[tuple], int, dict[str, str]]:
    """rows with the number of their case before them, the number of cases, and how columns are told apart by document."""
    first = columns[0] if columns[0] in ("id", "run") else None
    cases = [(r[0] - 1 if first else i, *r) for i, r in enumerate(rows)]
    return cases, max(c[0] for c in cases) + 1, {first: f"d.doc_id * 100 + c.{first}"} if first else {}


def carried(rows: list[tuple], columns: str, **edits: str) -> str:
    """The rows by documents as a subquery named t; edits give columns by expressions over the case c and the document d."""
    names = [c.strip() for c in columns.split(",")]
    cases, n, own = _numbered(rows, names)
    chosen = ", ".join(f"{(own | edits).get(c, 'c.' + c)} AS {c}" for c in names)
    return f"(SELECT {chosen} FROM documents d JOIN {values(cases, 'k, ' + columns).replace(' AS t(', ' AS c(')} ON d.doc_id % {n} = c.k) AS t"


def carry(read, rows: list[tuple], schema: str, **edits: str) -> DataFrame:
    """The same rows in Spark; the cases are constants of the code, so they are broadcast."""
    names = [f.split()[0] for f in schema.split(", ")]
    cases, n, own = _numbered(rows, names)
    chosen = [f"{(own | edits).get(c, 'c.' + c)} AS {c}".replace("//", "div") for c in names]
    table = F.broadcast(read.spark.createDataFrame(cases, f"k int, {schema}")).alias("c")
    return read("documents").alias("d").join(table, F.expr(f"d.doc_id % {n} = c.k")).selectExpr(*chosen)
