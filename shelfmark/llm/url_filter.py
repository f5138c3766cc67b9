"""URL filter: host and path rules first, then a weighted vocabulary of terms.

An Aho-Corasick automaton finds every term of the vocabulary in one pass over the
URL. A hit counts only between boundaries: the characters beside it must not be
ASCII letters or digits. One strict hit rejects; soft terms reject once the
weights of the *distinct* soft terms found reach the threshold.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged by its terms (null: allow). Repeated rows are judged
each for itself; other columns pass through unless they bear a result's name.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ("porn", "xxx", "hentai", "escorts", "camgirls", "warez", "malware", "phishing")
SOFT = {
    "adult": 1.0, "casino": 1.0, "sex": 1.0, "poker": 1.0, "viagra": 1.0, "betting": 1.0, "dating": 0.5,
    "nude": 1.0, "torrent": 1.0, "crack": 0.5, "loan": 0.5, "pills": 1.0, "jackpot": 1.0, "bonus": 0.5,
}


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Rules of the registered query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def split_url(url) -> DataFrame:
    """Host and path as columns of the URL."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host, path, rules: Sequence[Rule]):
    """Name and verdict of the longest rule that fits, as a struct; null without one."""
    found = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def automaton(strict: Sequence[str], soft: Mapping[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in soft.items():
        found.add_word(term, (term, float(weight)))
    for term in strict:
        found.add_word(term, (term, None))
    if len(found):
        found.make_automaton()
    return found


def term_score(url: str | None, found: ahocorasick.Automaton) -> tuple[int, float]:
    """Distinct strict terms, and the weight of the distinct soft terms, between boundaries."""
    if not url or not len(found):
        return 0, 0.0
    text = url.translate(_LOWER)
    strict, soft = set(), {}
    for end, (term, weight) in found.iter(text):
        begin = end - len(term) + 1
        if (begin and text[begin - 1] in _INSIDE) or (end + 1 < len(text) and text[end + 1] in _INSIDE):
            continue
        if weight is None:
            strict.add(term)
        else:
            soft[term] = weight
    return len(strict), sum(soft.values())


_LOWER = {c: c + 32 for c in range(65, 91)}
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Mapping[str, float] = SOFT,
    soft_limit: float = 2.0,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``strict_hits``, ``soft_weight`` and ``verdict``.

    No shuffle: every URL is judged where it lies. The vocabulary is part of the
    program, a parameter of bounded size.
    """

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = automaton(strict, soft)
        for urls in batches:
            rows = [term_score(u, found) for u in urls]
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_weight"])

    counted = F.pandas_udf(scores, "strict_hits int, soft_weight double")
    made = ("host", "path", "rule", "strict_hits", "soft_weight", "verdict")
    url = F.col(f"`{url_col}`")
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    host, path = split_url(url)
    df = pages.select(*keep, host.alias("host"), path.alias("path"), counted(url.cast("string")).alias("_terms"))
    df = df.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    bad = (F.col("_terms.strict_hits") > 0) | (F.col("_terms.soft_weight") >= soft_limit)
    return df.select(
        *keep,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.col("_terms.strict_hits").alias("strict_hits"),
        F.col("_terms.soft_weight").alias("soft_weight"),
        F.coalesce(F.col("_rule.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
    )
