"""Query files: finding them, and running their text, written for another dialect, on registered relations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.templates import Tables


def discover(spark: SparkSession, root: str) -> DataFrame:
    """template (int), instance (int), sql: every file qN_versions/*_sK.sql under root, whole."""
    files = spark.read.text(f"{root}/*_versions/*.sql", wholetext=True).select(F.col("value").alias("sql"), F.input_file_name().alias("file"))
    found = files.select(F.regexp_extract("file", r"q(\d+)_versions/", 1).alias("template"), F.regexp_extract("file", r"_s(\d+)\.sql$", 1).alias("instance"), "sql")
    return found.where("template <> '' and instance <> ''").select(F.col("template").cast("int"), F.col("instance").cast("int"), "sql")


def _closing(text: str, start: int) -> int:
    """The position of the bracket that closes the one at start."""
    depth = 0
    for k in range(start, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if not depth:
            return k
    raise ValueError("unbalanced brackets")


def _wrap(text: str, name: str, before: str, after: str) -> str:
    """Each call name(x) as before + x + after."""
    call, done = re.compile(rf"\b{name}\s*\(", re.I), 0
    while m := call.search(text, done):
        end = _closing(text, m.end() - 1)
        text = text[: m.start()] + before + text[m.end() : end] + after + text[end + 1 :]
        done = m.start() + len(before)
    return text


def _shares(text: str) -> str:
    """Each n * 100 / d as a quotient of doubles that is IEEE's where d is zero; n and d are calls, d possibly over a window."""
    sign, done = re.compile(r"\s*\*\s*100\s*/\s*"), 0
    while m := sign.search(text, done):
        start, depth = m.start(), 0
        while start:  # back to where the call before the sign begins
            start -= 1
            depth += (text[start] == ")") - (text[start] == "(")
            if not depth:
                break
        while start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        end = _closing(text, text.index("(", m.end())) + 1
        if over := re.compile(r"\s*over\s*(?=\()", re.I).match(text, end):
            end = _closing(text, over.end()) + 1
        top, whole = text[start : m.start()], text[m.end() : end]
        new = f"case when {whole} = 0 then {top} * double('Infinity') else {top} * 100D / nullif({whole}, 0) end"
        text = text[:start] + new + text[end:]
        done = start + len(new)
    return text


def _nulls_last(text: str) -> str:
    """The last ORDER BY with NULLS LAST after each key."""
    ordered = list(re.finditer(r"\border\s+by\b", text, re.I))
    if not ordered:
        return text
    at = ordered[-1].end()
    tail = re.search(r"\blimit\b", text[at:], re.I)
    end = at + tail.start() if tail else len(text)
    keys, depth = [""], 0
    for c in text[at:end]:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            keys.append("")
        else:
            keys[-1] += c
    return text[:at] + ",".join(f" {k.strip()} nulls last" for k in keys) + "\n" + text[end:]


def translate(text: str) -> str:
    """Spark's SQL for the text of a query: lists, list aggregates that are null over no rows, sorting with nulls last, and
    division and averages of decimals as double. Quoted strings are left alone."""
    quoted: list[str] = []

    def hide(m: re.Match) -> str:
        quoted.append(m[0])
        return f"\0{len(quoted) - 1}\0"

    text = re.sub(r"'(?:[^']|'')*'", hide, text.strip().rstrip(";"))
    text = re.sub(r"\blist_value\s*\(", "array(", text, flags=re.I)
    text = _wrap(text, "array_agg", "nullif(collect_list(", "), cast(array() as array<array<string>>))")
    text = _wrap(text, "avg", "cast(avg(", ") as double)")
    text = _shares(text)
    text = _nulls_last(text)
    return re.sub("\0(\\d+)\0", lambda m: quoted[int(m[1])], text)


def run_text(spark: SparkSession, db: Tables, relations: list[str], text: str) -> DataFrame:
    """The rows of a query's text over the relations, which are registered as temporary views."""
    for relation in relations:
        db[relation].createOrReplaceTempView(relation)
    return spark.sql(translate(text))
