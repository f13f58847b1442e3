"""Declarations of proof sources by regular expressions: kinds, names, spans, holes, axioms, imports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values
KINDS = ["theorem", "lemma", "def", "abbrev", "structure", "class", "instance", "inductive", "axiom", "opaque", "example"]
HOLES = ["sorry", "admit"]
HEAD = r"^\s*(?:@\[[^\]]*\]\s*)?(?:(?:private|protected|noncomputable|partial|unsafe|nonrec|scoped|local)\s+)*(" + "|".join(KINDS) + r")\b[ \t]*([^\s:({\[⦃]*)"


def stripped(text: str) -> str:
    """The text with comments (which nest) and strings blanked, line by line as it was."""
    out, depth, i = [], 0, 0
    quoted = line_comment = False
    while i < len(text):
        two = text[i : i + 2]
        if text[i] == "\n":
            line_comment = False
            out.append("\n")
        elif line_comment:
            out.append(" ")
        elif quoted:
            out.append(" ")
            if text[i] == "\\":
                i += 1
                out.append("\n" if text[i : i + 1] == "\n" else " ")
            elif text[i] == '"':
                quoted = False
        elif two == "/-" or (depth and two == "-/"):
            depth += 1 if two == "/-" else -1
            out.append("  ")
            i += 1
        elif depth:
            out.append(" ")
        elif two == "--":
            line_comment = True
            out.append(" ")
        else:
            quoted = text[i] == '"'
            out.append(" " if quoted else text[i])
        i += 1
    return "".join(out)


def without_comments(files: DataFrame, text: str = "text") -> DataFrame:
    """The files with comments and strings blanked; a loop over characters in Arrow batches, for comments nest."""

    def run(batches):
        for pdf in batches:
            pdf[text] = [None if t is None else stripped(t) for t in pdf[text]]
            yield pdf

    return files.mapInPandas(run, files.schema)


def declarations(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, kind, name, line, end_line, n_lines, kappa, hole, body): heads by line; a declaration ends before the next head.

    kappa is the number of lines and of tactic steps (non-blank lines after the head). Expects text without comments.
    """
    lines = files.select(path, F.posexplode(F.split(text, "\n")).alias("_p", "_l"))
    head = F.regexp_extract("_l", HEAD, 1)
    own = Window.partitionBy(path).orderBy("_p")
    marked = lines.withColumn("_k", head).withColumn("_n", F.sum(F.when(F.col("_k") != "", 1).otherwise(0)).over(own)).where("_n > 0")
    out = marked.groupBy(path, "_n").agg(
        F.min_by("_k", "_p").alias("kind"),
        F.min_by(F.regexp_extract("_l", HEAD, 2), "_p").alias("name"),
        (F.min("_p") + 1).cast("long").alias("line"),
        (F.max(F.when(F.trim("_l") != "", F.col("_p"))) + 1).cast("long").alias("end_line"),
        (F.count_if(F.trim("_l") != "") - 1).alias("_steps"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_l"))), lambda x: x["_l"]), "\n").alias("body"),
    )
    n = F.col("end_line") - F.col("line") + 1
    return out.select(path, "kind", "name", "line", "end_line", n.alias("n_lines"), (n + F.col("_steps")).alias("kappa"), F.col("body").rlike(r"\b(" + "|".join(HOLES) + r")\b").alias("hole"), "body")


def axioms(found: DataFrame) -> DataFrame:
    return found.where("kind = 'axiom'")


def unused_binders(found: DataFrame, path: str = "path") -> DataFrame:
    """(path, name, line, binder): named binders of a head that stand nowhere else in the declaration."""
    named = F.flatten(F.transform(F.regexp_extract_all("body", F.lit(r"[({⦃]\s*((?:[A-Za-zα-ωΑ-Ω_][\w'₀-₉]*\s+)+):"), 1), lambda x: F.split(F.trim(x), r"\s+")))
    words = F.split("body", r"[^\w'₀-₉]+")
    rows = found.select(path, "name", "line", words.alias("_w"), F.explode(F.array_distinct(named)).alias("binder"))
    return rows.where((F.col("binder") != "_") & (F.size(F.filter("_w", lambda x: x == F.col("binder"))) < 2)).drop("_w")


def identifiers(found: DataFrame, keys: list[str], text: str = "body", leave: list[str] | None = None) -> DataFrame:
    """Distinct identifiers of each body, less keywords and its own name."""
    words = F.array_except(F.array_distinct(F.split(text, r"[^\w'.₀-₉]+")), F.array(*map(F.lit, [*KINDS, *HOLES, "by", "fun", "let", "have", "show", "from", "where", "with", "if", "then", "else", "match", "do", "in", "end", "import", "open", *(leave or [])])))
    return found.select(*keys, F.explode(words).alias("identifier")).where((F.col("identifier") != "") & ~F.col("identifier").rlike(r"^[0-9.']") & (F.col("identifier") != F.col("name")))


def head_symbol(type_: str) -> str | None:
    """The logical head of a type: past quantifiers, arrows and parentheses, the relation or the applied name."""
    text = type_.strip()
    while m := re.match(r"[∀∃Πλ][^,]*,\s*", text):
        text = text[m.end() :]
    depth, last = 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{⟨") - (c in ")]}⟩")
        if depth == 0 and c in "→⟶":
            last = i + 1
    text = text[last:].strip()
    if text.startswith("(") and text.endswith(")"):
        return head_symbol(text[1:-1])
    depth = 0
    for c in text:
        depth += (c in "([{⟨") - (c in ")]}⟩")
        if depth == 0 and c in "=<>≤≥≠↔∧∨∈∣":
            return c
    m = re.match(r"[¬]?\s*([\w'.₀-₉]+)", text)
    return m[1] if m else None


def differing(a: DataFrame, b: DataFrame, name: str = "name", line: str = "line", path: str = "path", within: int = 2) -> DataFrame:
    """Declarations that only one of two extractors has: (path, name, line, only), names equal and lines within two of each other being the same one."""

    def rest(x: DataFrame, y: DataFrame, only: str) -> DataFrame:
        other = y.select(F.col(path).alias("_f"), F.col(name).alias("_n"), F.col(line).alias("_l"))
        near = (F.col(path) == F.col("_f")) & (F.col(name) == F.col("_n")) & (F.abs(F.col(line) - F.col("_l")) <= within)
        return x.join(other, near, "left_anti").select(path, name, line, F.lit(only).alias("only"))

    return rest(a, b, "first").unionByName(rest(b, a, "second"))


def impossible(found: DataFrame, path: str = "path") -> DataFrame:
    """Declarations whose stated type is t < t, t > t, t ≠ t or False."""
    stated = F.trim(F.regexp_extract("body", r"(?s)^[^:]*:\s*(.*?)\s*(?::=|$)", 1))
    pair = F.regexp_extract(stated, r"^(\S+)\s*([<>≠])\s*(\S+)$", 1)
    same = (pair != "") & (pair == F.regexp_extract(stated, r"^(\S+)\s*([<>≠])\s*(\S+)$", 3))
    return found.where(same | (stated == "False")).select(path, "name", "line", stated.alias("stated"))


def quantifiers(found: DataFrame, path: str = "path") -> DataFrame:
    """(path, name, place, quantifier, bound): the quantifiers of what a declaration states, in order, and the names each binds."""
    stated = F.regexp_extract("body", r"(?s)^(.*?)(?::=|$)", 1)
    rows = found.select(path, "name", F.posexplode(F.regexp_extract_all(stated, F.lit(r"([∀∃]\s*[^,]+,)"), 1)).alias("place", "_q"))
    bound = F.trim(F.regexp_replace(F.regexp_replace("_q", r"^[∀∃]\s*|,$", ""), r"\s*[:∈<>≤≥].*$", ""))
    return rows.select(path, "name", "place", F.substring("_q", 1, 1).alias("quantifier"), bound.alias("bound"))


def _never(type_: Column) -> Column:
    """t < t, t > t, t ≠ t or False."""
    pair = F.regexp_extract(type_, r"^(\S+)\s*([<>≠])\s*(\S+)$", 1)
    return (type_ == "False") | ((pair != "") & (pair == F.regexp_extract(type_, r"^(\S+)\s*([<>≠])\s*(\S+)$", 3)))


def vacuous(found: DataFrame, path: str = "path") -> DataFrame:
    """(path, name, line, why, detail): the first impossible hypothesis of a declaration, told directly, or after the one definition that it applies is unfolded.

    A definition `def F (a : T) := body` unfolds at `F x` by putting x for its one named argument.
    """
    flat = F.regexp_replace("body", r"\s+", " ")
    binders = F.regexp_extract_all(flat, F.lit(r"\(\s*[\w']+\s*:\s*([^()]*(?:\([^()]*\)[^()]*)*)\)"), 1)
    hypotheses = found.where("kind IN ('theorem', 'lemma')").select(path, "name", "line", F.posexplode(binders).alias("_at", "_t")).withColumn("_t", F.trim("_t"))
    defs = found.where("kind = 'def'").select(F.col("name").alias("_f"), F.regexp_extract(flat, r"\(\s*([\w']+)\s*:", 1).alias("_a"), F.trim(F.regexp_extract(flat, r":=\s*(.*)$", 1)).alias("_b")).where("_a <> ''")
    parts = F.split("_t", " ")
    rows = hypotheses.withColumn("_h", F.when(F.size(parts) == 2, parts[0])).join(defs, F.col("_h") == F.col("_f"), "left")
    opened = F.regexp_replace(F.col("_b"), F.concat(F.lit(r"(?<![\w'])"), F.col("_a"), F.lit(r"(?![\w'])")), parts[1])
    why = F.when(_never(F.col("_t")), "direct").when(_never(opened), "unfolded")
    hits = rows.withColumn("why", why).where("why IS NOT NULL").withColumn("detail", F.when(F.col("why") == "direct", F.col("_t")).otherwise(opened))
    return hits.groupBy(path, "name", "line").agg(F.min_by(F.struct("why", "detail"), "_at").alias("_x")).select(path, "name", "line", "_x.why", "_x.detail")
