"""Small literal inputs of the queries on sources, registries and sinks, as frames and as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def literal(v) -> str:
    """A Python value as DuckDB SQL."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


class Given:
    """Rows under a Spark schema such as `a long, b array<string>`."""

    KINDS = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        """SELECT of the rows, with their types."""
        fields = [f.strip().split(" ", 1) for f in self.schema.split(",")]
        kind = lambda t: f"{self.KINDS[t[6:-1]]}[]" if t.startswith("array<") else self.KINDS[t]
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        names = ", ".join(f"c{k}" for k in range(len(fields)))
        columns = ", ".join(f"CAST(c{k} AS {kind(t)}) AS {n}" for k, (n, t) in enumerate(fields))
        return f"SELECT {columns} FROM (VALUES {values}) v({names})" + ("" if self.rows else " WHERE false")


PYTHON = Given("path string, text string", [
    ("pkg/a.py", '''from pkg.b import helper, Base
import pkg.c as c
import os

__all__ = ["main", "Tool", "idle"]


class Tool(Base):
    def run(self):
        self.step()
        return c.area(2)

    def step(self):
        return helper(os.getcwd())


def main():
    def inner():
        return helper(1)
    inner()
    return Tool()


def idle():
    return 0
'''),
    ("pkg/b.py", '''"""Helpers (v1.2.0)."""
import ast
import pkg.gone


class Base:
    def close(self):
        return None


class Walker(ast.NodeVisitor):
    def visit_Name(self, node):
        return node


def helper(x):
    return x
'''),
    ("pkg/c.py", '''"""Areas (v1.3.0, new)."""
from pkg.a import main


def area(r):
    return r * r


def spare(x):
    return area(x)


def idle():
    handle = open("x")
    for a in handle:
        if a:
            while a:
                a = None
    return handle
'''),
    ("tests/test_a.py", '''from pkg.a import main
from pkg.c import spare


def test_main():
    assert main() and "idle"
    spare(1)
'''),
    ("pkg/broken.py", "def (\n"),
    ("pkg/empty.py", None),
    ("notes.weird", "nothing"),
])

PROOFS = Given("path string, text string", [
    ("a.lean", '''import A.B
/- theorem hidden : sorry /- nested -/ still -/
theorem one (h : a) (k : b) : c := by
  exact h -- sorry

lemma two : x < x := by
  sorry
axiom three : False
def four := "sorry"
'''),
    ("b.lean", '''import A.B
import A.C
theorem five : a = b := by
  simp
  sorry
'''),
])

REGISTRY = Given("path string, text string", [("r.md", '''# Title
## Routes
| name | status | hole |
|---|---|---|
| `alpha` | NOMMÉ → PROUVÉE | 1 (2) |
| `beta` | EN-COURS | 3 |
| broken row |
## Journal
| a | b |
|:--|--:|
| x | y |
''')])  # fmt: skip

LOG = Given("value string", [("""abcdef1|2024-01-02T10:00:00|first subject
3\t1\tsrc/a.py
-\t-\tlogo.png
abcdef2|2024-02-20T10:00:00|second | with a bar
10\t0\tsrc/a.py
2\t2\tsrc/b.py
abcdef3|2024-02-25T10:00:00|third
1\t1\tsrc/a.py""",)])

MECHANISMS = Given("mechanism string, holes array<long>", [("alpha", [1, 2]), ("beta", [3]), ("lone", [9])])
HYPOTHESES = Given("name string, status string, holes array<long>, source string, worksites array<string>, rank long, weight double", [
    ("alpha", "NOMMÉ", [1], "table §1", ["7"], 0, 0.4),
    ("H1", "DÉMONTRÉ", [1, 2], "table §1", ["1"], 0, 0.5),
    ("H2", "NOMMÉ", [2, 3], "table §1", [], 1, 0.3),
    ("H3", "EN-COURS", [1], "table §1", ["2"], 1, 0.2),
    ("H4", "RÉFUTÉ", [3], "journal §12 (Ch.4)", ["4"], 2, 0.25),
    ("H5", "NOMMÉ (récolté)", [2], "journal §12 (Ch.5)", ["5"], 4, 0.125),
    ("H6", "ÉLIMINÉ", [3, 1], "table §1", ["6"], 3, 0.0625),
    ("H7", "POINTEUR", [5], "table §1", [], 3, 1.0),
])
OBSTRUCTIONS = Given("title string, holes array<long>", [
    ("version faible RÉFUTÉE, version forte PROUVÉE (H1 et `H3`)", [1]),
    ("mur de beta : version dure ÉLIMINÉE, version molle CONDITIONNELLE, `beta`", [8]),
    ("rien version autre INCONNU H4", [2, 3]),
])
ENTRIES = Given("worksite string, body string", [
    ("4", "On a `foo_bar` : RÉFUTÉE puis `baz_qux` — **ÉLIMINÉ** et `alpha_one`, DÉMONTRÉ."),
    ("5", "RÉFUTÉE par `g4_kinetic` mais `other_one` reste. `foo_bar`: RÉFUTÉ"),
    ("6", ""),
])
KILLS = Given("mechanism string, step long, name string", [("alpha", 1, "H3"), ("alpha", 2, "H1"), ("alpha", 3, "H3"), ("alpha", 4, "unknown"), ("beta", 1, "H4")])
STEPS = Given("t long, agent string, type string, msg string", [
    (1, "a", "appel", "call 1"), (2, "a", "resultat", "ok 1"), (3, "a", "appel", "call 2"), (4, "a", "exception", "boom"), (5, "a", "appel", "call 3"),
    (1, "b", "appel", "b call"), (2, "b", "resultat", "b ok"), (1, "c", "exception", "at once"), (9, "c", "resultat", "late"),
])
