"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits,
schemes and identifier cues. At an anchor a local parser expands to both sides and validates what
it finds. Kinds, in order: email, ip, card, phone (the base kinds), url, iban, key.

The base kinds give the leftmost, non-overlapping matches of
    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 16 to 19 digits that pass Luhn's test
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 8 to 15 digits
and a match that fails its test is dropped and its text consumed. Added kinds: url (http, https,
ftp and mailto schemes), iban (after its cue, with its checksum), key (values after password, token,
secret and api_key cues, and access key ids). Null text is empty and has no spans. Positions are code
points, ends exclusive. Digit runs of any length are read in one go. Each row is judged on its own, so repeated rows and null ids need no rule.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from orrery.llm.shared import table

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "iban", "key"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~%-]+(?::[0-9]+)?(?:[/?#@][^\s<>\"'`|\\^{}\[\]]*)?")
_IBAN = re.compile(r"[\s:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_VALUE = re.compile(r"[\x20\t]{0,2}[:=][\x20\t]{0,2}[\"']?([A-Za-z0-9_+/.~-]{8,})[\"']?")
_KEY_ID = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_SCHEMES = ["http://", "https://", "ftp://", "mailto:"]
_CUES = ["password", "passwd", "token", "secret", "api_key", "apikey", "api-key"]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _at_most_255(digits: str) -> bool:
    """Of any number of digits, leading zeros among them."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    out.add_word("@", ("@", 1))
    out.add_word("+", ("+", 1))
    for c in "0123456789":
        out.add_word(c, ("0", 1))
    for word in _SCHEMES:
        for form in {word, word.capitalize(), word.upper()}:
            out.add_word(form, ("u", len(word)))
    for word in _CUES:
        for form in {word, word.capitalize(), word.upper()}:
            out.add_word(form, ("k", len(word)))
    for form in ("IBAN", "iban", "Iban"):
        out.add_word(form, ("i", 4))
    out.add_word("AKIA", ("a", 4))
    out.make_automaton()
    return out


def spans_of(text: str, anchors) -> list[tuple[int, int, int]]:
    """(kind number, start, end), in order of kind and start."""
    found: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = url_end = iban_end = key_end = 0
    for last, (what, size) in anchors.iter(text):
        p = last - size + 1
        if what == "0":
            if p >= ip_end:
                m = _IP.match(text, p)
                if m:
                    ip_end = m.end()
                    if all(_at_most_255(x) for x in m[0].split(".")):
                        found.append((1, p, ip_end))
                else:
                    ip_end = _DIGITS.match(text, p).end()
            if p >= card_end:
                m = _CARD.match(text, p)
                if m:
                    card_end = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found.append((2, p, card_end))
        elif what == "@":
            start = p
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < p and (m := _DOMAIN.match(text, p + 1)):
                email_end = m.end()
                found.append((0, start, email_end))
        elif what == "+":
            if p >= phone_end and (m := _PHONE.match(text, p)):
                phone_end = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((3, p, phone_end))
        elif what == "u":
            if p >= url_end and not (p and text[p - 1].isalnum()) and (m := _URL.match(text, last + 1)):
                end = m.end()
                while text[end - 1] in ".,;:!?)":
                    end -= 1
                if end > last + 1:
                    url_end = end
                    found.append((4, p, end))
        elif what == "i":
            if p >= iban_end and (m := _IBAN.match(text, last + 1)) and iban_valid(m[1]):
                iban_end = m.end(1)
                found.append((5, m.start(1), iban_end))
        elif what == "k":
            if p >= key_end and (m := _VALUE.match(text, last + 1)) and _DIGITS.search(m[1]):
                key_end = m.end(1)
                found.append((6, m.start(1), key_end))
        elif p >= key_end and not (p and text[p - 1].isalnum()) and (m := _KEY_ID.match(text, last + 1)):
            key_end = m.end()
            found.append((6, p, key_end))
    return sorted(found)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first, of equal starts the longest, names the whole."""
    out, at, end = [], 0, 0
    for start, stop, kind in sorted((a, -b, k) for k, a, b in spans):
        stop = -stop
        if start >= end:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end = max(end, stop)
    return "".join([*out, text[at:]])


_anchors: list = []


def _automaton():
    if not _anchors:
        _anchors.append(automaton())
    return _anchors[0]


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, and spans in order of kind and start."""
    import numpy as np

    def run(batches):
        anchors = _automaton()
        for batch in batches:
            texts = batch.column(1)
            offsets, kinds, starts, ends = [0], [], [], []
            for k in range(len(texts)):
                text = texts[k].as_py()
                for kind, a, b in spans_of(text, anchors) if text else ():
                    kinds.append(KINDS[kind])
                    starts.append(a)
                    ends.append(b)
                offsets.append(len(kinds))
            entries = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), entries)], names=["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", SPAN)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with personal data replaced; n_chars, where it is a column, follows a changed text. Clean texts stay as they are."""
    names = docs.columns
    at, count = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        anchors = _automaton()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = {}
            for k, text in enumerate(texts):
                if text and (spans := spans_of(text, anchors)):
                    changed[k] = redacted(text, spans)
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array([changed.get(k, x) for k, x in enumerate(texts)], columns[at].type)
                if count is not None:
                    columns[count] = pa.array([len(changed[k]) if k in changed else x for k, x in enumerate(columns[count].to_pylist())], columns[count].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind
