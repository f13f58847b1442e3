"""What users add: analysers by language, orders by strategy, grouped aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

ANALYSED = "path string, language string, item string, line long, kappa double, failed string"
_analysers: dict[str, Callable[[str, str], Iterator[tuple]]] = {}


def analyser(language: str):
    """Register a function of (path, text) that gives (item, line, kappa) rows for sources of a language."""

    def add(f):
        _analysers[language] = f
        return f

    return add


def analysed(files: DataFrame, path: str = "path", text: str = "text", language: str = "language") -> DataFrame:
    """Items of all files whose language has an analyser; a file whose analyser raises gives one row that tells so."""
    known = dict(_analysers)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, t, lang in zip(pdf[path], pdf[text], pdf[language], strict=True):
                try:
                    out += [(p, lang, *row, None) for row in known[lang](p, t or "")]
                except Exception as e:  # an analyser is foreign code: its failure is a row
                    out.append((p, lang, None, None, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "language", "item", "line", "kappa", "failed"]).astype({"line": "Int64"})

    return files.where(F.col(language).isin(*known) if known else F.lit(False)).select(path, text, language).mapInPandas(run, ANALYSED)


def ordered_by(frame: DataFrame, keys: list[str], item: str, strategy: Callable, arrival: str) -> DataFrame:
    """(keys, item, place, fallback): each group in the order that a strategy gives for its rows (a data frame in, item values out).

    An order that is no permutation of the group's items is refused: the group keeps its order of arrival, and fallback is true. A group is one task's: for strategies on batches of bounded size.
    """
    kinds = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in [*keys, item])

    def run(pdf):
        rows = pdf.sort_values(arrival)
        asked = list(strategy(rows))
        bad = sorted(asked, key=str) != sorted(rows[item], key=str)
        places = {v: k for k, v in enumerate(rows[item] if bad else asked)}
        out = rows[[*keys, item]].assign(place=rows[item].map(places).astype("int64"), fallback=bad)
        return out[[*keys, item, "place", "fallback"]]

    return frame.groupBy(*keys).applyInPandas(run, f"{kinds}, place long, fallback boolean")


def grouped(kind: str = "double"):
    """A user's aggregate of a series of values as a grouped Pandas UDF."""

    def make(f) -> Callable[..., Column]:
        import pandas as pd

        def run(v: pd.Series) -> float:
            return f(v)

        return F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG)

    return make


def table_function(spark, name: str, schema: str):
    """Register a generator of rows as a table function for SQL (and LATERAL joins)."""

    def make(f):
        class Table:
            def eval(self, *args):
                yield from f(*args)

        spark.udtf.register(name, F.udtf(Table, returnType=schema))
        return f

    return make
