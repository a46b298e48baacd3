"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

1. Seeds: emails, IP addresses, card and phone numbers by fixed patterns and checks, with their
   places (code points, end exclusive) and the two words before them.
2. Candidates: other tokens that hold a digit (with the tokens that start with one right after it),
   or an ``@`` or bracket inside, without the punctuation around them, and with the same context. A
   candidate that looks like a key (``KEY_CHARS`` characters or more, letters and digits, ``KEY_KINDS``
   different ones) is a seed of the kind ``secret`` for the graph, but no span by itself.
3. A bipartite graph of lexical patterns (the two words before, lower-cased, digits folded, as far as
   they lie in the ``REACH`` characters before the match) and instances (the values). In each round a
   pattern's confidence for a kind is the mean score of its distinct instances for that kind: one for a
   seed, and for an unseen instance one minus the chance that none of the confident patterns it occurs
   in is right. The sum of these scores must reach ``support``, so each round's discoveries can admit
   patterns that few seeds or none support.
4. Candidates after a pattern whose confidence reaches ``confident`` become spans of its kind.

Step 1 and 2 read each text once and write the matches (never the text) to the shared folder;
a match's place is the running sum of the lengths of what stands before it. The regular
expressions use possessive repeats and look-behind so that long texts cost linear time and bounded
stack, and match what the plain ones of the contract match.

Defined cases: a null text counts as empty; rows that repeat a ``doc_id`` each get their own row;
a null ``doc_id`` is kept; with no seeds nothing is added; overlapping spans of different kinds
all stay, a candidate that overlaps a seed is none; of kinds that a pattern is equally sure of, the
last in the alphabet counts; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import staged

KINDS = ("email", "ip", "card", "phone")
WS = r"\x20\x09-\x0D"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = rf"(?<![^{WS}])(?:[^{WS}0-9@(\[]*+[0-9][^{WS}]*+(?:\x20[0-9][^{WS}]*+)*+|[^{WS}0-9@(\[]++[@(\[][^{WS}]*+)"
CORE = r"(?s)[A-Za-z0-9+].*[A-Za-z0-9]|[A-Za-z0-9]"
#: The kind that the graph adds: seeds by shape, spans by pattern only.
SECRET, KEY_CHARS, KEY_KINDS = "secret", 20, 10
ADDED = (*KINDS, SECRET)
PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
ROUNDS, SUPPORT, CONFIDENT = 3, 5, 0.9
#: Characters before a match in which its context is looked for, and parts that a context's rows are dealt to.
REACH, SALTS = 80, 32


def found(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """array<(before: length of the text since the last match, value, context: from the whole text before)>"""
    context = lambda p: F.regexp_replace(F.lower(F.regexp_extract(F.right(p, F.lit(REACH)), rf"((?:[^{WS}]+[{WS}]+)?[^{WS}]+)[{WS}]+\z", 1)), "[0-9]+", "0")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern)
    row = lambda p, m: F.struct(F.length(p).cast("long").alias("before"), m.alias("value"), F.right(p, F.lit(REACH)).alias("tail"))
    every = F.filter(F.zip_with(pieces, matches, row), lambda r: r["value"].isNotNull())
    # A match has two characters or more, so the last REACH / 2 of them and what lies between reach far enough.
    last = lambda rows, i: F.slice(rows, F.greatest(i - REACH // 2 + 1, F.lit(1)), F.least(i, F.lit(REACH // 2)))
    ahead = lambda rows, r, i: F.concat(F.array_join(F.transform(last(rows, i), lambda x: F.concat(x["tail"], x["value"])), ""), r["tail"])
    shown = lambda rows: F.transform(rows, lambda r, i: F.struct(r["before"], r["value"], F.regexp_replace(context(ahead(rows, r, i)), rf"[{WS}]+", " ").alias("context")))
    out = F.transform(F.array(every), shown)[0]  # the lambda holds the rows, so that they are found once
    none = F.expr("cast(array() as array<struct<before: bigint, value: string, context: string>>)")
    return F.when(gate, out).otherwise(none) if gate is not None else out


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", value.rlike(rf"\A{PART}(?:\.{PART}){{3}}\z"))
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has row and doc_id; spans has row, kind ('' for candidates), start, end, value, context."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    per = [
        found(F.col("text"), EMAIL, F.contains("text", F.lit("@"))),
        found(F.col("text"), IP),
        found(F.col("text"), CARD),
        found(F.col("text"), PHONE, F.contains("text", F.lit("+"))),
        found(F.col("text"), TOKEN),
    ]
    cols = [f"m{k}" for k in range(len(per))]
    scan = staged(text.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(p.alias(c) for p, c in zip(per, cols))), "pii-matches")
    some = scan.where(" or ".join(f"size({c}) > 0" for c in cols))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("m")) for k, c in zip((*KINDS, ""), cols)))
    each = some.select("row", F.explode(kinds).alias("x")).select("row", "x.kind", F.posexplode("x.m").alias("nth", "m"))
    order = W.partitionBy("row", "kind").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("m.value").cast("long")
    end = F.sum(F.col("m.before") + size).over(order)
    spans = each.select("row", "kind", end.alias("end"), size.alias("size"), F.col("m.value").alias("value"), F.col("m.context").alias("context"))
    placed = spans.select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value", "context")
    core = F.regexp_extract("value", CORE, 0)
    begin = F.col("start") + F.instr("value", core) - 1
    bare = placed.where("kind = ''").select("row", "kind", begin.alias("start"), (begin + F.length(core)).alias("end"), core.alias("value"), "context").where("value <> ''")
    return scan.select("row", "doc_id"), placed.where("kind <> ''").unionByName(bare)


def looks_like_key(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
    return value.rlike(rf"\A[A-Za-z0-9_+/=.-]{{{KEY_CHARS},}}\z") & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (distinct >= KEY_KINDS)


def graph(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, candidates): seeds pass their kind's check; candidates overlap no seed."""
    valid = spans.where((F.col("kind") == "") | passes(F.col("kind"), F.col("value")))
    seed_end = F.when(F.col("kind") != "", F.col("end"))
    seed_start = F.when(F.col("kind") != "", F.col("start"))
    by = W.partitionBy("row").orderBy("start", "end", "kind")
    marked = valid.select("*", F.max(seed_end).over(by.rowsBetween(W.unboundedPreceding, 0)).alias("until"), F.min(seed_start).over(by.rowsBetween(0, W.unboundedFollowing)).alias("next"))
    free = (F.col("kind") == "") & (F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    kept = staged(marked.where((F.col("kind") != "") | free).select("row", "kind", "start", "end", "value", "context"), "pii-spans")
    return kept.where("kind <> ''"), kept.where("kind = ''")


def _by_context(rows: DataFrame, patterns: DataFrame, spread: str) -> DataFrame:
    """``rows`` joined with the patterns of their context. One context may stand before a third of all rows, so
    they are dealt to ``SALTS`` parts by ``spread``, and each pattern (one row a kind) comes in every part."""
    part = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    every = patterns.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("part", part).join(every.hint("merge"), ["context", "part"]).drop("part")


def confident_patterns(seeds: DataFrame, candidates: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(context, kind, confidence) of the patterns trusted after the last round."""
    own = lambda df: df.where("context <> ''").groupBy("context", "value", "kind").agg(F.lit(1).alias("one")).select("context", "value", "kind")
    shaped = candidates.withColumn("kind", F.when(looks_like_key(F.col("value")), F.lit(SECRET)).otherwise(F.lit("")))
    edges = staged(own(seeds).unionByName(own(shaped)), "pii-edges")
    counts = edges.groupBy("context").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("kind") == k, 1)).alias(f"seeds_{k}") for k in ADDED))
    # A score is one at most, so a pattern with fewer instances than ``support`` can never be trusted.
    able = staged(counts.where(F.col("n") >= support), "pii-patterns")
    unseen = staged(_by_context(edges.where("kind = ''").select("context", "value"), able.select("context"), "value"), "pii-unseen")
    scores = None  # (value, kind, score) of unseen instances, from the trusted patterns they occur in
    trusted = None
    for _ in range(rounds):
        known = able
        if scores is not None:
            gained = unseen.join(scores.hint("merge"), "value").groupBy("context").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(f"more_{k}") for k in ADDED))
            known = able.join(gained, "context", "left")
        more = lambda k: F.coalesce(F.col(f"more_{k}"), F.lit(0.0)) if scores is not None else F.lit(0.0)  # noqa: B023, E731
        kinds = F.array(*(F.struct(F.lit(k).alias("kind"), (F.col(f"seeds_{k}") + more(k)).alias("backed")) for k in ADDED))
        each = known.select("context", "n", F.explode(kinds).alias("x")).select("context", "x.kind", "x.backed", (F.col("x.backed") / F.col("n")).alias("confidence"))
        trusted = staged(each.where((F.col("backed") >= support) & (F.col("confidence") >= confident / 2)).select("context", "kind", "confidence"), "pii-trusted")
        miss = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        scores = _by_context(unseen, trusted, "value").groupBy("value", "kind").agg((1 - F.exp(miss)).alias("score"))
    return trusted.where(F.col("confidence") >= confident).groupBy("context").agg(F.max(F.struct("confidence", "kind")).alias("x")).select("context", "x.kind", "x.confidence")


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """doc_id and spans, an array of (kind number, start, end, kind, seed) in order, of every row."""
    rows, spans = matches(docs)
    seeds, candidates = graph(spans)
    patterns = confident_patterns(seeds, candidates, rounds, support, confident).select("context", F.col("kind").alias("as"))
    new = _by_context(candidates, patterns, "row").select("row", F.col("as").alias("kind"), "start", "end", F.lit(False).alias("seed"))
    every = seeds.select("row", "kind", "start", "end", F.lit(True).alias("seed")).unionByName(new)
    number = F.array_position(F.array(*map(F.lit, ADDED)), F.col("kind"))
    per_row = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(number.alias("number"), "start", "end", "kind", "seed"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<number: bigint, start: bigint, end: bigint, kind: string, seed: boolean>>)")
    return rows.join(per_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
