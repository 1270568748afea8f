"""Files: Markdown, plain text, TeX and BibTeX as documents, and documents as files."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tex_to_prose

SUFFIXES = (".md", ".txt", ".tex", ".bib")


def checked(path) -> Path:
    """The path, if its suffix (as it is written) is one that can be read."""
    path = Path(path)
    if path.suffix not in SUFFIXES:
        raise ValueError(f"Unsupported file type: {path.suffix}")
    return path


def read_raw(spark: SparkSession, paths: list) -> DataFrame:
    """doc_id (place in the list), path, fmt, text: whole files."""
    paths = [checked(p) for p in paths]
    missing = [p for p in paths if "://" not in str(p) and not p.exists()]
    if missing:
        raise FileNotFoundError(str(missing[0]))
    names = [str(p) if "://" in str(p) else p.absolute().as_uri() for p in paths]
    order = spark.createDataFrame([(k, str(p), n, p.suffix[1:]) for k, (p, n) in enumerate(zip(paths, names))], "doc_id long, path string, uri string, fmt string")
    key = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = spark.read.text(names, wholetext=True).select(F.col("value").alias("text"), key(F.col("_metadata.file_path")).alias("_file")).distinct()
    # an empty file has no row
    return order.join(files, key(F.col("uri")) == F.col("_file"), "left").select("doc_id", "path", "fmt", F.coalesce("text", F.lit("")).alias("text"))


def read_corpus(spark: SparkSession, paths: list) -> DataFrame:
    """doc_id, path, fmt, text: what is there to read in files of all formats, in the order of the list."""
    return prose(read_raw(spark, paths))


def prose(raw: DataFrame) -> DataFrame:
    """TeX without commands, BibTeX as the values of all its fields, everything else as it is."""

    def values(batches):
        for b in batches:
            b["text"] = [" ".join(v for e in parse_bib(t) for v in e.values()) for t in b.text]
            yield b

    bib = raw.where("fmt = 'bib'").mapInPandas(values, raw.schema)
    rest = raw.where("fmt <> 'bib'").withColumn("text", F.when(F.col("fmt") == "tex", tex_to_prose(F.col("text"))).otherwise(F.col("text")))
    return rest.unionByName(bib)


_ENTRY = re.compile(r"@\s*(\w+)\s*([{(])")


def parse_bib(content: str) -> list[dict[str, str]]:
    """Entries of a BibTeX file: their fields in order, then ENTRYTYPE and ID. Comments, preambles and strings are left out."""
    entries, at = [], 0
    while m := _ENTRY.search(content, at):
        at = m.end()
        end, depth = at, 1
        while end < len(content) and depth:
            depth += (content[end] in "{(") - (content[end] in "})")
            end += 1
        body, kind = content[at : end - 1], m[1].lower()
        at = end
        if kind in ("comment", "preamble", "string"):
            continue
        key, _, rest = body.partition(",")
        entry = {}
        for name, value in _fields(rest):
            entry[name.lower()] = value
        entries.append(entry | {"ENTRYTYPE": kind, "ID": key.strip()})
    return entries


def _fields(text: str):
    at = 0
    while m := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(text, at):
        at, parts = m.end(), []
        while at < len(text):
            if text[at] == "{":
                end, depth = at + 1, 1
                while end < len(text) and depth:
                    depth += (text[end] == "{") - (text[end] == "}")
                    end += 1
                parts.append(text[at + 1 : end - 1])
            elif text[at] == '"':
                end, depth = at + 1, 0
                while end < len(text) and (text[end] != '"' or depth):
                    depth += (text[end] == "{") - (text[end] == "}")
                    end += 1
                parts.append(text[at + 1 : end])
                end += 1
            else:
                end = re.compile(r"[^,#]*").match(text, at).end()
                parts.append(text[at:end].strip())
            at = re.compile(r"\s*").match(text, end).end()
            if text[at : at + 1] != "#":
                break
            at = re.compile(r"#\s*").match(text, at).end()
        yield m[1], "".join(parts)


def dump_bib(entries: list[dict[str, str]]) -> str:
    out = []
    for e in entries:
        fields = "".join(f" {k} = {{{v}}},\n" for k, v in e.items() if k not in ("ENTRYTYPE", "ID"))
        out.append(f"@{e.get('ENTRYTYPE', 'misc')}{{{e.get('ID', '')},\n{fields.rstrip(',').removesuffix(',' + chr(10))}\n}}\n")
    return "\n".join(out)


def bib_fields(raw: DataFrame) -> DataFrame:
    """doc_id, entry_no, field_no, field, text: a row per field of each entry of BibTeX documents."""

    def fields(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(d, i, j, k, v) for d, t in zip(b.doc_id, b.text) for i, e in enumerate(parse_bib(t)) for j, (k, v) in enumerate(e.items())], columns=["doc_id", "entry_no", "field_no", "field", "text"])

    return raw.select("doc_id", "text").mapInPandas(fields, "doc_id long, entry_no int, field_no int, field string, text string")


def bib_text(fields: DataFrame) -> DataFrame:
    """doc_id, text: the other way round of bib_fields()."""

    def dumped(pdf):
        import pandas as pd

        entries: dict[int, dict[str, str]] = {}
        for r in pdf.sort_values(["entry_no", "field_no"]).itertuples():
            entries.setdefault(r.entry_no, {})[r.field] = r.text
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "text": [dump_bib(list(entries.values()))]})

    return fields.groupBy("doc_id").applyInPandas(dumped, "doc_id long, text string")


def write_text(path, text: str) -> None:
    Path(path).write_text(text, encoding="utf-8")
