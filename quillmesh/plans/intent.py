"""Query understanding on a DataFrame of queries: intent, parts, prompts, rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def route(queries: DataFrame) -> DataFrame:
    """Adds intent, subject and confidence; the first matching pattern decides, none means search_code at 0.5."""
    q = F.trim("query")
    made = lambda name, subject, sure: F.struct(F.lit(name).alias("intent"), subject.cast("string").alias("subject"), F.lit(sure).alias("confidence"))
    step = F.when(q == "", made("search_code", F.lit(None), 1.0))
    for name, pattern in rules.INTENTS:
        p = f"(?i){pattern}"
        step = step.when(q.rlike(p), made(name, F.regexp_replace(F.regexp_extract(q, p, 1), "^[`'\"]+|[`'\"]+$", ""), 0.9))
    routed = step.otherwise(made("search_code", F.lit(None), 0.5))
    return queries.withColumn("r_", routed).select(*queries.columns, "r_.intent", "r_.subject", "r_.confidence")


def accept_model(routed: DataFrame, least: float = 0.7) -> DataFrame:
    """Takes a model's answer (model_intent, model_subject, model_confidence) where patterns said nothing and it is sure."""
    use = (F.col("confidence") < 0.9) & (F.col("model_confidence") >= least)
    pick = {"intent": "model_intent", "subject": "model_subject", "confidence": "model_confidence"}
    return routed.withColumns({k: F.when(use, F.col(v)).otherwise(F.col(k)) for k, v in pick.items()})


_ASKS = "|".join(rules.QUESTION_WORDS)
CUT = rf"(?i)\s*[,;]?\s+(?:and|or|also|then)\s+(?=(?:{_ASKS})\b)"


def is_compound(q: Column) -> Column:
    asks = F.regexp_count(q, F.lit(rf"(?i)\b(?:{_ASKS})\b"))
    return (asks >= 2) | q.rlike(CUT)


def decompose(queries: DataFrame) -> DataFrame:
    """(query_id, variant, query): parts of compound queries, cut before a question word; others as they are."""
    q = F.trim("query")
    parts = F.filter(F.transform(F.split(q, CUT), F.trim), lambda p: F.length(p) > 5)
    use = F.when(is_compound(q) & (F.size(parts) >= 2), parts).otherwise(F.array(q))
    return queries.select("query_id", F.posexplode(use).alias("variant", "query"))


def prompt_kind(q: Column) -> Column:
    """Which prompt a hypothetical document would be made with."""
    return reduce(lambda acc, kp: acc.when(q.rlike(f"(?i){kp[1]}"), kp[0]), rules.PROMPT_KINDS[1:], F.when(q.rlike(f"(?i){rules.PROMPT_KINDS[0][1]}"), rules.PROMPT_KINDS[0][0])).otherwise("other")


def rewrite(queries: DataFrame, expand=None, most: int = 500) -> DataFrame:
    """Appends the terms that ``expand(query)`` gives (a model as pandas_udf), up to ``most`` characters."""
    return queries if expand is None else queries.withColumn("query", F.substring(F.concat_ws(" ", "query", expand(F.col("query"))), 1, most))


def hypothetical(queries: DataFrame, write=None, most: int = 2000) -> DataFrame:
    """Adds dense_query: what ``write(query, prompt kind)`` says without code fences, or the query itself."""
    if write is None:
        return queries.withColumn("dense_query", F.col("query"))
    said = F.btrim(F.regexp_replace(write(F.col("query"), prompt_kind(F.col("query"))), r"(?m)^```\w*[ \t]*$", ""), F.lit(" \t\r\n"))
    return queries.withColumn("dense_query", F.when(said != "", F.substring(said, 1, most)).otherwise(F.col("query")))


def paraphrase_key(q: Column) -> Column:
    return F.sha2(F.lower(F.trim(q)), 256)
