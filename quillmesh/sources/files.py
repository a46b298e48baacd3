"""Sources as DataFrames. Paths go to Spark's readers; nothing is opened on the driver but small text configs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text

GOLDEN = "id string, query string, expected_paths array<string>, expected_symbols array<string>, tags array<string>"
LOG = "event string, repo string, files long, chunks long, embedded long, reused long, enricher_cache_hits long, timestamp string, adapter_id string, stage string"


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(rel_path, language, size_bytes, mtime, content) of the files below ``root`` that are indexed."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(base) + "/*", "")
    return indexed_files(raw.select(rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content"), ignore)


def indexed_files(files: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Known language, 1 byte to the size limit, no NUL in the first bytes, not ignored; content as text."""
    known = files.withColumn("language", text.language_of(F.col("rel_path"))).where(F.col("language").isNotNull() & F.col("size_bytes").between(1, rules.MAX_FILE_BYTES))
    kept = known.where(~F.contains(F.substring("content", 1, rules.SNIFF_BYTES), F.lit(b"\x00")))
    ignored = F.lit(False)
    for p in ignore or []:  # the last line that matches decides; ! takes a path back
        back = p.startswith("!")
        ignored = F.when(F.col("rel_path").rlike(ignore_pattern(p[1:] if back else p)), F.lit(not back)).otherwise(ignored)
    kept = kept.where(~ignored)
    return kept.withColumn("content", F.decode("content", "UTF-8"))


def ignore_pattern(glob: str) -> str:
    """One line of an ignore file as a regular expression over relative paths: ``*`` and ``?`` stay within a
    name, ``**`` crosses folders, a slash at the end means folders, one before it the root."""
    bare, out, i = glob.strip("/"), [], 0
    while i < len(bare):
        if bare.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif bare.startswith("**", i):
            out.append(".*")
            i += 2
        elif bare[i] == "[" and "]" in bare[i + 2 :]:
            end = bare.index("]", i + 2)
            inner = bare[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]")
            i = end + 1
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(bare[i]) or re.escape(bare[i]))
            i += 1
    anchored = glob.startswith("/") or "/" in bare
    return ("^" if anchored else "(?:^|/)") + "".join(out) + ("/" if glob.endswith("/") else "(?:/|$)")


def read_ignore(bodies: list[str]) -> list[str]:
    """The patterns of ignore files, in order; blank lines and # lines are none."""
    return [x.strip() for body in bodies for x in body.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def parse_name_status(raw: DataFrame) -> DataFrame:
    """Version-control deltas, one line each (``M\\tpath``, ``R087\\told\\tnew``), as (action, rel_path, old_path, similarity)."""
    p = F.split("value", "\t")
    code = F.substring(p[0], 1, 1)
    action = F.when(code == "D", "delete").when(code == "M", "modify").when(code == "R", "rename").otherwise("add")
    return raw.where(F.trim("value") != "").select(action.alias("action"), F.when(code.isin("R", "C"), F.try_element_at(p, F.lit(3))).otherwise(p[1]).alias("rel_path"), F.when(code == "R", p[1]).alias("old_path"), F.when(code.isin("R", "C"), F.substring(p[0], 2, 3).try_cast("int")).alias("similarity"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; blank and # lines are skipped, a line without a query fails with its text."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#")))
    return golden_cases(lines)


def golden_cases(lines: DataFrame) -> DataFrame:
    row = lines.select("value", F.from_json("value", GOLDEN).alias("c"))
    return row.select(F.coalesce("c.query", F.raise_error(F.concat(F.lit("no query in: "), "value"))).alias("query"), F.col("c.id").alias("query_id"), "c.expected_paths", "c.expected_symbols", "c.tags")


def read_graph(spark: SparkSession, path: str, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON file; ids get the repo as prefix; edges stand under ``links`` or ``edges`` or both."""
    shape = "nodes array<struct<id: string, label: string, file_type: string, source_file: string, source_location: string>>, links array<struct<source: string, target: string, relation: string, confidence: string, confidence_score: double, context: string, source_file: string, source_location: string, weight: double>>, communities map<string, array<string>>, community_labels map<string, string>"
    edge = shape.split("links ")[1].split(", communities ")[0]
    g = spark.read.schema(f"{shape}, edges {edge}").option("multiLine", "true").json(path)
    prefix = lambda c: F.concat(F.lit(f"{repo}:"), c) if repo else c
    members = g.select(F.explode("communities").alias("cid", "ids"), "community_labels").select(F.col("cid").cast("int").alias("community_id"), F.element_at("community_labels", F.col("cid")).alias("community_label"), F.explode("ids").alias("id"))
    nodes = g.select(F.explode("nodes").alias("n")).select("n.*").join(members, "id", "left").withColumn("line", text.line_of(F.col("source_location")))
    edges = g.select(F.explode(F.concat(*(F.coalesce(c, F.lit([]).cast(g.schema[c].dataType)) for c in ("links", "edges")))).alias("e")).select("e.*").withColumns({k: prefix(F.col(k)) for k in ("source", "target")})
    return nodes.withColumn("node_id", prefix(F.col("id"))).drop("id"), edges


def read_log(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Structured rows of JSON logs; other lines become rows with their marker as event."""
    return parse_log(spark.read.text(paths))


def parse_log(lines: DataFrame) -> DataFrame:
    parsed = lines.select("value", F.from_json("value", LOG).alias("j"))
    marker = F.when(F.col("value").rlike(r"(?i)hook.*(start|begin)"), "hook_start").when(F.col("value").rlike(r"(?i)hook.*(done|finish)"), "hook_done").when(F.col("value").rlike(r"(?i)hook.*(fail|error)"), "hook_failed")
    return parsed.select(F.coalesce("j.event", marker).alias("event"), *(F.col(f"j.{c.split()[0]}").alias(c.split()[0]) for c in LOG.split(", ")[1:])).where(F.col("event").isNotNull())


def parse_manifest(body: str) -> list[str]:
    """Enabled repositories of a manifest (``repos:`` of strings or path/enabled pairs), in order."""
    out: list[dict] = []
    for n, line in enumerate(body.splitlines(), 1):
        s = line.split("#", 1)[0].rstrip()
        if not s or s.strip() == "repos:":
            continue
        if s.lstrip().startswith("- "):
            out.append({"line": n})
            s = s.replace("- ", "  ", 1)
        if not out:
            raise ValueError(f"line {n}: expected `repos:`")
        key, colon, value = s.strip().partition(": ")
        out[-1] |= {key: value.strip("'\" ")} if colon else {"path": s.strip().strip("'\"")}
    for i, entry in enumerate(out):
        if not entry.get("path"):
            raise ValueError(f"entry {i}: no path")
    return [e["path"] for e in out if e.get("enabled", "true").lower() != "false"]
