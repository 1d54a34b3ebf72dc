"""JSON documents of any depth: canonical forms, differences by path, values by name, and objects found within text."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.storage import bounded_batches


class _Number(str):
    """The digits of a number as VARIANT writes them."""


#: Numbers keep their digits: no float rounds them.
DECODER = json.JSONDecoder(parse_int=_Number, parse_float=_Number)
_ESCAPES = {i: f"\\u{i:04X}" for i in range(32)} | {ord(c): "\\" + e for c, e in zip('"\\\b\t\n\f\r', '"\\btnfr', strict=True)}


def _quoted(text: str) -> str:
    return f'"{text.translate(_ESCAPES)}"'


def _parsed(text: str):
    """The value of a text as ``_plain`` gives it; frames for as many levels as VARIANT takes."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8000))
    return DECODER.decode(text)


def canonical(x, drop: tuple[str, ...] = ()) -> str:
    """Canonical text of a JSON value: keys sorted, lists as sorted multisets, numbers without trailing zeros, null and '' alike."""
    if isinstance(x, dict):
        return "{" + ",".join(sorted([f'{{"name":{_quoted(k)}}}:{canonical(v, drop)}' for k, v in x.items() if k not in drop])) + "}"
    if isinstance(x, list):
        return "[" + ",".join(sorted([canonical(v, drop) for v in x])) + "]"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, _Number):
        return re.sub(r"(\.\d*?)0+$", r"\1", x).removesuffix(".")
    return _quoted(x) if x else "null"


def differences(a, b, drop: tuple[str, ...], at: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(path, change) of two JSON values, highest paths only."""
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in a.keys() | b.keys():
            if k in drop:
                continue
            if k in a and k in b:
                out += differences(a[k], b[k], drop, (*at, k))
            else:
                out.append((".".join((*at, k)), "removed" if k in a else "added"))
        return out
    return [] if canonical(a, drop) == canonical(b, drop) else [(".".join(at) if at else ".", "changed")]


def _plain(column: Column) -> Column:
    """JSON text as VARIANT reads it; '' for text that isn't JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(column)), F.lit(""))


def _documents(df: DataFrame, key: str, column: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.where(F.col(column).isNotNull()).select(F.col(key).alias("id"), _plain(F.col(column)).alias("text"))


def canonical_hash(df: DataFrame, key: str, column: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``id, hash``: a hash that is equal for JSON documents that say the same, whatever their order, blanks, nulls or metadata keys.

    Null documents have no row; all texts that aren't JSON have one hash.
    """

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return pd.Series([canonical(_parsed(t), drop) if t else "invalid" for t in texts], dtype=object)

    return _documents(df, key, column).select("id", F.sha2(form("text"), 256).alias("hash"))


def path_diff(before: DataFrame, after: DataFrame, key: str, column: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``id, path, change``: where two versions of JSON documents differ, as dotted paths (``.`` for the whole).

    Only objects are gone into; lists are equal as sorted lists, null and '' are
    equal, a missing key and a null one aren't. Below a path that differs no other
    is named. Change is added, removed or changed; a document that one side lacks
    differs as a whole. The versions meet once, by id, and are gone through row by row.
    """
    a, b = _documents(before, key, column), _documents(after, key, column)
    both = a.toDF("a_id", "a").join(b.toDF("b_id", "b"), F.col("a_id") == F.col("b_id"), "full").select(F.coalesce("a_id", "b_id").alias("id"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (one, two) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if one == two:
                    continue
                if one and two:
                    own = differences(_parsed(one), _parsed(two), drop)
                else:
                    own = [(".", "added" if one is None else "removed" if two is None else "changed")]
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([x[c] for x in found], pa.string()) for c in (0, 1))], names=["id", "path", "change"])

    return both.mapInArrow(run, T.StructType([both.schema["id"], T.StructField("path", T.StringType()), T.StructField("change", T.StringType())]))


def values_of(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """``id, node, form``: every value of an object key of that name, at any depth, inside lists too; ``node`` is its path, list elements by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nodes, forms = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                todo = [([""], _parsed(text))] if text else []
                while todo:
                    node, x = todo.pop()
                    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
                        todo.append(([*node, str(k)], v))
                        if k == name:
                            at.append(i)
                            nodes.append(todo[-1][0])
                            forms.append(canonical(v))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(nodes, pa.list_(pa.string())), pa.array(forms, pa.string())], names=["id", "node", "form"])

    docs = _documents(df, key, column)
    return docs.mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("node", T.ArrayType(T.StringType())), T.StructField("form", T.StringType())]))


def objects_in(text: str) -> list[str]:
    """Balanced ``{...}`` stretches of a text, outermost ones, braces inside strings left alone."""
    found, depth, start, at = [], 0, 0, 0
    for m in re.finditer(r'["{}]', text):
        if m.start() < at:
            continue  # inside a string
        mark = m.group()
        if mark == '"' and depth:
            closing = re.compile(r'(?:[^"\\]|\\.)*"', re.S).match(text, m.end())
            at = closing.end() if closing else len(text)
        elif mark == "{":
            start = start if depth else m.start()
            depth += 1
        elif mark == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : m.end()])
    return found


FENCE = re.compile(r"\s*```(?:json)?\s*\n?(.*?)\n?\s*```\s*", re.S | re.I)


def one_object(text: str | None) -> tuple[str | None, str]:
    """The one JSON object that a text is or holds, and what it took: steps joined by ``|``, or why there is none.

    Steps: a byte order mark removed, outer blanks trimmed, a single code fence
    unwrapped, the only object among other text extracted.
    """
    if text is None:
        return None, "not_text"
    steps = []
    if text.startswith("﻿"):
        text = text[1:]
        steps.append("removed_utf8_bom")
    if text.strip() != text:
        text = text.strip()
        steps.append("trimmed_outer_whitespace")
    fenced = FENCE.fullmatch(text)
    if fenced and "```" not in fenced.group(1):
        text = fenced.group(1).strip()
        steps.append("unwrapped_single_json_fence")

    def parsed(part: str):
        try:
            return json.loads(part)
        except (json.JSONDecodeError, RecursionError):
            return None

    value = parsed(text)
    if value is None and text != "null":
        good = [p for p in objects_in(text) if isinstance(parsed(p), dict)]
        if len(good) != 1:
            return None, f"objects:{len(good)}"
        text, value = good[0], {}
        steps.append("extracted_unique_json_object")
    return (text, "|".join(steps)) if isinstance(value, dict) else (None, "root_not_object")


def json_in_text(text: Column) -> Column:
    """``value`` and ``steps`` of ``one_object`` for each row; a state machine over quotes and braces, one pass over each text."""

    @F.pandas_udf("value string, steps string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one_object(t) for t in texts], columns=["value", "steps"])

    return run(text)


