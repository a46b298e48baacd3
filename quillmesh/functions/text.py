"""Identities, tokens and paths as column expressions (all stay inside generated code)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

TERM = r"[\p{L}\p{N}]+"


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(path: Column, start: Column, end: Column, content_hash: Column, repo: Column | None = None) -> Column:
    place = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), content_hash)
    return F.concat(F.lit("sha256:"), sha256(place if repo is None else F.concat(repo, F.lit(":"), place)))


def camel_split(c: Column) -> Column:
    """``camelCase`` and ``HTTPServer`` as words."""
    return F.regexp_replace(F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def query_terms(c: Column) -> Column:
    """Terms of a query: camel case split, single characters dropped, repeats kept."""
    return F.filter(terms(camel_split(c)), lambda t: F.length(t) > 1)


def identifier_tokens(c: Column) -> Column:
    """Distinct tokens of three or more characters that are no stop words, in order, lower-cased."""
    kept = F.filter(terms(camel_split(c)), lambda t: F.length(t) >= 3)
    return F.array_except(kept, F.array(*map(F.lit, sorted(rules.STOPWORDS))))


def search_document(content: Column, path: Column, symbol: Column) -> Column:
    """The text that is indexed: content, split content, path tokens, symbol tokens."""
    part = lambda c: F.regexp_replace(camel_split(c), r"[/._\-]+", " ")
    return F.concat_ws("\n", content, camel_split(content), part(path), F.when(symbol.isNotNull(), part(symbol)))


def snippet(c: Column, most: int = 480) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("…"))).otherwise(c)


def language_of(path: Column) -> Column:
    """By file name, else by lower-cased extension; null if neither is known."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    table = lambda d: F.create_map(*(F.lit(x) for kv in sorted(d.items()) for x in kv))
    return F.coalesce(F.try_element_at(table(rules.LANGUAGE_BY_NAME), name), F.try_element_at(table(rules.LANGUAGE_BY_EXTENSION), ext))


def repo_key(url: Column) -> Column:
    """``host/path`` of a git URL: short SSH form, user info, one trailing slash and ``.git`` folded, lower-cased."""
    long = F.regexp_replace(url, r"^(?:[^@/:]+@)?([^/:@]+):(?!//)", "ssh://$1/")
    bare = F.regexp_replace(F.regexp_replace(long, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^[^@/]*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"/$", ""), r"\.git$", ""))


def line_of(location: Column) -> Column:
    """First number of ``L12`` or ``12:5``; null without one."""
    found = F.regexp_extract(location, r"L?(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def is_test_path(path: Column) -> Column:
    return F.reduce(F.array(*(path.contains(p) for p in rules.TEST_PATHS)), F.lit(False), lambda a, b: a | b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors and for vectors of different dimension."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def l2_score(a: Column, b: Column) -> Column:
    """max(0, 1 - d**2 / 2), which is the cosine of unit vectors."""
    d2 = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda acc, x: acc + x)
    return F.greatest(F.lit(0.0), 1 - d2 / 2)


def _unit_counts(dim: int):
    def unit(slots: pd.Series) -> pd.Series:
        def one(s: np.ndarray | None) -> np.ndarray:
            both = np.bincount(s if s is not None else [], minlength=2 * dim).astype(np.float64)
            v = both[:dim] - both[dim:]
            return (v / (np.sqrt((v * v).sum()) or 1.0)).astype(np.float32)

        return slots.map(one, na_action=None)

    return F.pandas_udf(unit, "array<float>")


def hash_embedding(c: Column, dim: int = 64) -> Column:
    """Default embedder: terms hashed to ``dim`` signed counts, of unit length (zero for no terms).

    Hashing stays in the JVM; counting is one Arrow function, evaluated once per row before any join.
    """
    return _unit_counts(dim)(F.transform(terms(c), lambda t: F.pmod(F.xxhash64(t), F.lit(2 * dim)).cast("int")))
