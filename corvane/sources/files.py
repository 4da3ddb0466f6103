"""Readers and writers: notes, notebooks, HTML, delimited text, JSON lines, judged collections, run files."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.runtime import importable
from corvane.sources.chunks import grouped_rows

# What an ingest takes and what it skips.
EXTENSIONS = (".md", ".markdown", ".txt", ".rst", ".html", ".htm")
EXCLUDED_SEGMENTS = ("_seen.jsonl", "_seen.json", "_index.jsonl")
EXCLUDED_FIRST_SEGMENTS = ("logs", "tmp", "_tmp")
EXCLUDED_BASENAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
SKIPPED_NAMES = (r"(?i):Zone\.Identifier$", r"^\._", r"(?i)^Thumbs\.db$", r"^\.DS_Store$")


def ingestible(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether a path relative to its shelf is taken, by extension, segments and names."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    hidden = F.exists(parts, lambda p: p.startswith("."))
    excluded = F.exists(parts, lambda p: p.isin(*EXCLUDED_SEGMENTS)) | ((F.size(parts) > 1) & F.get(parts, F.lit(0)).isin(*EXCLUDED_FIRST_SEGMENTS))
    return extension.isin(*extensions) & ~hidden & ~excluded & ~name.isin(*EXCLUDED_BASENAMES) & ~F.greatest(*[name.rlike(p) for p in SKIPPED_NAMES])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Every ingestible file below ``root``/<shelf>/...: kb, relative_path, extension, sha256, modified_at, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.regexp_extract("path", r"^(?:\w+:)?/*" + root.rstrip("/").split(":")[-1].lstrip("/").replace(".", r"\.") + r"/(.+)$", 1)
    files = files.withColumn("tail", tail).withColumns({"kb": F.substring_index("tail", "/", 1), "relative_path": F.regexp_extract("tail", r"^[^/]+/(.+)$", 1)})
    files = files.filter(ingestible(F.col("relative_path")) & ~F.col("kb").startswith("."))
    return files.select("kb", "relative_path", F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1)).alias("extension"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified_at"), "length", "content")


def whole_text(df: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Decode ``content`` to ``text``; beyond ``most_bytes`` it is cut, and a broken last character dropped."""
    content = F.col("content") if most_bytes is None else F.substring("content", 1, most_bytes)
    text = F.make_valid_utf8(content.cast("string"))
    text = text if most_bytes is None else F.regexp_replace(text, "\ufffd+$", "")
    return df.withColumn("text", text).drop("content")


def delimited_text(spark: SparkSession, path: str, sep: str = ",", chunk: int = 1000) -> DataFrame:
    """Rows of a delimited file as ``row N: col=val | ...`` lines, in parts that hold as many as fit into ``chunk`` characters below a head of path, rows and columns."""
    rows = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"')
    names = [c if not c.startswith("_c") else f"column_{int(c[2:]) + 1}" for c in rows.columns]
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"[\r\n]+", " / "), r"[ \t]+", " "))
    cells = [F.concat(F.lit(f"{n}="), cell(c)) for n, c in zip(names, rows.columns, strict=True)]
    lines = rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("i"), F.concat_ws(" | ", *cells).alias("cells"))
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("i"))).withColumn("line", F.concat(F.lit("row "), F.col("n").cast("string"), F.lit(": "), "cells"))
    columns = " | ".join(names)
    head = F.concat(F.lit("source_path: "), "file", F.lit("\nrows: "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(f"\ncolumns: {columns}\n\n"))
    parts = grouped_rows(lines, "file", "n", "line", len(f"source_path: {path.rsplit('/', 1)[-1]}\nrows: none\ncolumns: {columns}"), chunk)
    return parts.select("file", "part", F.concat(head, "text").alias("text"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs) -> None:  # noqa: ANN001
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Replace ``html`` by its visible ``text``; links and images leave their words alone."""
    importable(df.sparkSession)

    @F.pandas_udf("string")
    def plain(pages: pd.Series) -> pd.Series:
        def one(page):  # noqa: ANN001, ANN202
            if page is None:
                return None
            p = _Text()
            p.feed(page)
            p.close()
            lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
            return "\n".join(x for x in lines if x)

        return pages.map(one)

    return df.withColumn("text", plain(html)).drop(html)


def notebook_text(df: DataFrame, content: str = "text", path: str = "path", most_output: int = 1200) -> DataFrame:
    """Render notebook JSON: a header with the path, then a block for each cell, with outputs of code cells cut."""
    importable(df.sparkSession)

    @F.pandas_udf("string")
    def render(bodies: pd.Series, paths: pd.Series) -> pd.Series:
        def joined(x):  # noqa: ANN001, ANN202
            return "".join(x) if isinstance(x, list) else str(x or "")

        def one(body, where):  # noqa: ANN001, ANN202
            try:
                book = json.loads(body)
                cells = book.get("cells") or [c for s in book.get("worksheets", []) for c in s.get("cells", [])]
            except (TypeError, ValueError, AttributeError):
                return None
            blocks = [f"source_path: {where}"]
            for i, cell in enumerate(cells, 1):
                kind = cell.get("cell_type", "code")
                block = f"cell {i}/{len(cells)} ({kind}):\n{joined(cell.get('source') or cell.get('input'))}"
                output = "".join(joined(o.get("text") or (o.get("data") or {}).get("text/plain")) for o in cell.get("outputs", []))
                blocks.append(block + (f"\noutput:\n{output[:most_output]}" if kind == "code" and output else ""))
            return "\n\n".join(blocks)

        return pd.Series([one(b, p) for b, p in zip(bodies, paths, strict=True)])

    return df.withColumn("text", render(content, path))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed rows with ``malformed``: broken lines are marked, not fatal."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    full = f"{schema}, _broken STRING"
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.select("r.*", F.col("r._broken").isNotNull().alias("malformed")).drop("_broken")


def judged_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgments of a collection with corpus.jsonl, queries.jsonl and qrels/test.tsv."""
    corpus = spark.read.json(f"{path}/corpus.jsonl", schema="_id string, title string, text string")
    queries = spark.read.json(f"{path}/queries.jsonl", schema="_id string, text string")
    qrels = spark.read.csv(f"{path}/qrels/test.tsv", sep="\t", header=True, schema="query_id string, id string, relevance int")
    return corpus, queries, qrels


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    """Lines of a run file: query, Q0, document, rank, score with six digits, tag."""
    return run.select(F.format_string("%s Q0 %s %d %.6f %s", F.col("query_id").cast("string"), F.col("id").cast("string"), F.col("rank").cast("int"), F.col("score"), F.lit(tag)).alias("value"))


def write_versioned(df: DataFrame, path: str, version: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write one version of a table beside the others; readers move when they are told the new path."""
    target = f"{path}/version={version}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return target


def gauges(df: DataFrame, name: Column, value: Column) -> DataFrame:
    """Exposition lines of gauges, one per row, with the end marker last."""
    lines = df.select(F.concat_ws(" ", name, value.cast("string")).alias("value"))
    return lines.unionAll(df.sparkSession.createDataFrame([("# EOF",)], "value string"))
