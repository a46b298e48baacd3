"""Chunkers: one file in, its chunks out, as (rel_path, kind, symbol, start_line, end_line, content).

Lines end at ``\\n`` only. Files, paragraphs, headings, blocks and scenarios are native; greedy line
packing and Python syntax trees, whose state runs through the file, are Arrow functions.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rules import MAX_CHUNK_CHARS, MIN_CHUNK_CHARS

SHAPE = "rel_path string, kind string, symbol string, start_line int, end_line int, content string"


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def paragraphs(files: DataFrame) -> DataFrame:
    """Each line of ``content`` that holds more than white space."""
    each = files.select("rel_path", F.posexplode(lines(F.col("content"))).alias("pos", "content")).where(F.trim("content") != "")
    return each.select("rel_path", F.lit("paragraph").alias("kind"), F.lit(None).cast("string").alias("symbol"), (F.col("pos") + 1).cast("int").alias("start_line"), (F.col("pos") + 1).cast("int").alias("end_line"), "content")


def pack_lines(body: str, most: int = MAX_CHUNK_CHARS) -> list[tuple[int, int, str]]:
    """Greedy runs of lines of up to ``most`` characters; a longer line stands alone."""
    out, held, start, size = [], [], 1, 0
    for n, line in enumerate(body.split("\n"), 1):
        if held and size + len(line) + 1 > most:
            out.append((start, n - 1, "\n".join(held)))
            held, start, size = [], n, 0
        held.append(line)
        size += len(line) + 1
    out.append((start, start + len(held) - 1, "\n".join(held)))
    return out


def whole_files(files: DataFrame, most: int = MAX_CHUNK_CHARS, least: int = MIN_CHUNK_CHARS) -> DataFrame:
    """One chunk a file; longer files are packed into parts. Files of under ``least`` characters go."""
    some = files.select("rel_path", "content").where(F.length(F.trim("content")) >= least)
    short = some.where(F.length("content") <= most).select("rel_path", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(1).alias("start_line"), F.size(lines(F.col("content"))).alias("end_line"), "content")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, "file_part", None, a, b, t) for p, c in zip(f.rel_path, f.content) for a, b, t in pack_lines(c, most) if len(t.strip()) >= least]
            yield pd.DataFrame(rows, columns=["rel_path", "kind", "symbol", "start_line", "end_line", "content"])

    return short.unionByName(some.where(F.length("content") > most).mapInPandas(pack, SHAPE))


HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"


def headings(files: DataFrame, most: int | None = None) -> DataFrame:
    """Sections of ``#`` headings: from a heading to before the next one of its level or higher; the prelude first.

    ``parent_line`` is where the nearest section around a section starts. Spans come from the array of a
    document's headings and its text is cut in place, so nothing is shuffled. With ``most``, a longer
    section comes as ``section_part`` rows (packed lines), which keep its symbol and parent.
    """
    split = files.select("rel_path", lines(F.col("content")).alias("ls"))
    mark = lambda x, i: F.when(x.rlike(HEADING), F.struct((i + 1).cast("int").alias("pos"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("title")))
    heads = split.select("rel_path", "ls", F.size("ls").alias("n"), F.filter(F.transform("ls", mark), lambda h: h.isNotNull()).alias("heads"))
    first = lambda xs, of: of(F.transform(xs, lambda x: x["pos"]))
    after = lambda h: first(F.filter("heads", lambda o: (o["pos"] > h["pos"]) & (o["level"] <= h["level"])), F.array_min)
    around = lambda h: first(F.filter("heads", lambda o: (o["pos"] < h["pos"]) & (o["level"] < h["level"])), F.array_max)
    span = lambda kind, title, a, b, up: F.struct(F.lit(kind).alias("kind"), title.cast("string").alias("symbol"), a.cast("int").alias("start_line"), b.cast("int").alias("end_line"), up.cast("int").alias("parent_line"))
    sections = F.transform("heads", lambda h: span("section", h["title"], h["pos"], F.coalesce(after(h) - 1, F.col("n")), around(h)))
    opened = F.coalesce(F.try_element_at("heads", F.lit(1))["pos"] - 1, F.col("n"))
    prelude = F.when(opened >= 1, F.array(span("document", F.lit(None), F.lit(1), opened, F.lit(None)))).otherwise(F.slice(F.array(span("document", F.lit(None), F.lit(1), F.lit(1), F.lit(None))), 1, 0))
    spans = heads.select("rel_path", "ls", F.concat(prelude, sections).alias("spans"))
    cut = F.transform("spans", lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "symbol", "start_line", "end_line", "parent_line")), F.array_join(F.slice("ls", x["start_line"], x["end_line"] - x["start_line"] + 1), "\n").alias("content")))
    out = spans.select("rel_path", F.explode(cut).alias("c")).select("rel_path", "c.*")
    if most is None:
        return out
    fits = F.length("content") <= most
    shape, names = ", ".join(f"{c} {t}" for c, t in out.dtypes), out.columns

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (r.rel_path, f"{r.kind}_part", r.symbol, r.start_line + a - 1, r.start_line + b - 1, None if pd.isna(r.parent_line) else int(r.parent_line), t)
                for r in f.itertuples(index=False) for a, b, t in pack_lines(r.content, most)
            ]
            yield pd.DataFrame(rows, columns=names).astype({"parent_line": "Int32"})

    return out.where(fits).unionByName(out.where(~fits).mapInPandas(pack, shape))


def tag_blocks(files: DataFrame, tags: tuple[str, ...] = ("script", "template", "style")) -> DataFrame:
    """The bodies of top-level ``<tag ...>...</tag>`` blocks, in order within each tag, with the lines they stand on.

    ``setup`` tells blocks whose tag has that attribute. Where a block starts follows from the lengths
    of what stands before it: the text is split at the blocks themselves.
    """
    per = []
    for t in tags:
        whole = rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>"
        blocks, gaps = F.regexp_extract_all("content", F.lit(whole), F.lit(0)), F.split("content", whole)
        # Line of the opening tag: line feeds in the gaps up to it and in the blocks before it.
        feeds = lambda xs: F.aggregate(F.transform(xs, lambda x: F.size(F.split(x, "\n")) - 1), F.lit(0), lambda a, x: a + x)
        item = lambda x, i: F.struct(
            F.lit(f"component_{t}").alias("kind"), (i + 1).alias("nth"),  # noqa: B023
            (1 + feeds(F.slice(gaps, F.lit(1), i + 1)) + feeds(F.slice(blocks, F.lit(1), i))).alias("start_line"),  # noqa: B023
            F.regexp_extract(x, rf"(?is)\A<{t}\b([^>]*)>", 1).rlike(r"(?i)\bsetup\b").alias("setup"),  # noqa: B023
            F.regexp_extract(x, rf"(?is)\A<{t}\b[^>]*>(.*?)</{t}\s*>\z", 1).alias("content"), x.alias("whole"))  # noqa: B023
        per.append(F.transform(blocks, item))
    each = files.select("rel_path", F.explode(F.flatten(F.array(*per))).alias("b"))
    end = F.col("b.start_line") + F.size(F.split("b.whole", "\n")) - 1
    return each.select("rel_path", "b.kind", "b.nth", "b.content", "b.start_line", end.alias("end_line"), "b.setup")


def components(files: DataFrame, most_lines: int = 150) -> DataFrame:
    """Single-file components: short ones whole, longer ones by block (``.setup`` marks such scripts), without blocks as a file."""
    n = F.size(lines(F.col("content")))
    short = files.where(n <= most_lines).select("rel_path", F.lit("component").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(1).alias("start_line"), n.alias("end_line"), "content")
    long = files.where(n > most_lines).select("rel_path", "content")
    some = F.lit(False)
    for t in ("script", "template", "style"):
        some |= F.col("content").rlike(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>")
    blocks = tag_blocks(long.where(some))
    named = blocks.select("rel_path", "kind", F.when(F.col("setup"), F.lit("setup")).cast("string").alias("symbol"), "start_line", "end_line", "content")
    return short.unionByName(named).unionByName(whole_files(long.where(~some)))


def scenarios(files: DataFrame) -> DataFrame:
    """Gherkin: the feature up to its first part, then each part up to the next; cut in place, without a shuffle."""
    start = r"^\s*(Scenario Outline|Scenario|Background|Rule|Examples?|Feature):\s*(.*)$"
    split = files.select("rel_path", lines(F.col("content")).alias("ls"))
    is_mark = lambda x: x.rlike(start) & ~x.rlike(r"^\s*Examples?:\s*$")
    mark = lambda x, i: F.when(is_mark(x), F.struct((i + 1).cast("int").alias("pos"), F.regexp_extract(x, start, 1).alias("word"), F.trim(F.regexp_extract(x, start, 2)).alias("title")))
    marks = split.select("rel_path", "ls", F.size("ls").alias("n"), F.filter(F.transform("ls", mark), lambda m: m.isNotNull()).alias("marks"))
    feature = F.try_element_at(F.filter("marks", lambda m: m["word"] == "Feature"), F.lit(1))["title"]
    known = marks.select("*", feature.alias("feature"))
    end = lambda i: F.coalesce(F.try_element_at("marks", i + 2)["pos"] - 1, F.col("n"))
    symbol = lambda m: F.when(m["word"] == "Feature", m["title"]).otherwise(F.concat_ws(" :: ", "feature", m["title"]))
    part = lambda m, i: F.struct(F.lower(F.regexp_replace(m["word"], " ", "_")).alias("kind"), symbol(m).alias("symbol"), m["pos"].alias("start_line"), end(i).alias("end_line"), F.array_join(F.slice("ls", m["pos"], end(i) - m["pos"] + 1), "\n").alias("content"))
    return known.select("rel_path", F.explode(F.transform("marks", part)).alias("c")).select("rel_path", "c.*")


def python_units(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, dotted name, first line, last line) of classes, functions and methods; nothing if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple[str, str, int, int]] = []

    def visit(node: ast.AST, path: tuple[str, ...], inside_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                own = (*path, child.name)
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                is_class = isinstance(child, ast.ClassDef)
                out.append(("class" if is_class else "method" if inside_class else "function", ".".join(own), start, child.end_lineno))
                if is_class:
                    visit(child, own, True)

    visit(tree, (), False)
    return out


def python_chunks(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of Python files; files that do not parse or hold none come whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, source in zip(f.rel_path, f.content):
                body = source.split("\n")
                units = python_units(source) or [("file", None, 1, len(body))]
                rows += [(path, k, s, a, b, "\n".join(body[a - 1 : b])) for k, s, a, b in units]
            yield pd.DataFrame(rows, columns=["rel_path", "kind", "symbol", "start_line", "end_line", "content"])

    return files.select("rel_path", "content").mapInPandas(run, SHAPE)


def dispatch(files: DataFrame, repo: Column | None = None, most: int = MAX_CHUNK_CHARS, least: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Each file to the chunker of its language (rel_path, language, content), blank files to none; then ids.

    ``parent_chunk_id`` links a section to the one around it. Chunks of under ``least`` characters go.
    """
    some = files.where(F.col("content").rlike(r"\S"))
    special = ("markdown", "gherkin", "vue", "python")
    of = lambda x: some.where(F.col("language") == x)
    rest = whole_files(some.where(~F.coalesce(F.col("language"), F.lit("")).isin(*special)), most, least)
    parts = [headings(of("markdown"), most), scenarios(of("gherkin")), components(of("vue")), python_chunks(of("python")), rest]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    kept = identified(out.where((F.length(F.trim("content")) >= least) | (F.col("kind") != "section")), repo)
    up = kept.where("kind = 'section'").select(F.col("rel_path").alias("p_path"), F.col("start_line").alias("p_line"), F.col("chunk_id").alias("parent_chunk_id"))
    return kept.join(up, (F.col("rel_path") == F.col("p_path")) & (F.col("parent_line") == F.col("p_line")), "left").drop("p_path", "p_line", "parent_line")


def identified(chunks: DataFrame, repo: Column | None = None) -> DataFrame:
    """Adds content_hash and chunk_id."""
    hashed = chunks.withColumn("content_hash", text.sha256(F.col("content")))
    return hashed.withColumn("chunk_id", text.chunk_id(F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("content_hash"), repo))
