"""Tokens, wildcard patterns and edit distance."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that separate tokens.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"

# Longest term (in characters) that allows 0 or 1 edit; longer terms allow 2.
EXACT_UP_TO = 2
ONE_EDIT_UP_TO = 5


def normalise_query(query: str) -> str:
    if not isinstance(query, str) or not query.strip():
        raise ValueError("Query parameter is required and must be a non-empty string")
    return query.strip()


def tokens(c: Column) -> Column:
    """Lower-cased tokens of a text column; null stays null."""
    return F.filter(F.split(F.lower(c), TOKEN_BREAK), lambda x: x != "")


def tokens_of_all(values: Column) -> Column:
    """Tokens of all texts of an array."""
    return F.flatten(F.transform(F.filter(values, lambda x: x.isNotNull()), tokens))


def query_terms(query: str) -> dict[str, int]:
    """Terms of a query string with the number of times each occurs."""
    found: dict[str, int] = {}
    for term in re.findall(r"[^\W_]+", normalise_query(query).lower()):
        found[term] = found.get(term, 0) + 1
    return found


def like_pattern(wildcard: str) -> str:
    r"""Turn ``*`` and ``?`` into LIKE wildcards and protect literal ``%``, ``_`` and ``\``."""
    escaped = re.sub(r"([\\%_])", r"\\\1", wildcard)
    return escaped.replace("*", "%").replace("?", "_")


def wildcard_match(c: Column, wildcard: str) -> Column:
    return F.like(c, F.lit(like_pattern(wildcard)))


def allowed_edits(term: str, fuzziness: str | int = "AUTO") -> int:
    if fuzziness != "AUTO":
        return int(fuzziness)
    if len(term) <= EXACT_UP_TO:
        return 0
    return 1 if len(term) <= ONE_EDIT_UP_TO else 2


def _swaps(word: str) -> set[str]:
    return {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word}


def _gap_swaps(word: str) -> set[str]:
    """Drop one character, then swap the two it separated."""
    return {
        word[: i - 1] + word[i + 1] + word[i - 1] + word[i + 2 :] for i in range(1, len(word) - 1)
    } - {word}


def edit_distance(c: Column, term: str, limit: int) -> Column:
    """Edits between ``term`` and a column, a swap of neighbours being one; null above ``limit``.

    Spark's bounded Levenshtein counts a swap as two edits. A path with swaps is a
    path from a swapped spelling of the term, so the swapped spellings (a handful,
    made once from the query term) cost one edit each before the plain distance.
    """
    if limit == 0:
        return F.when(c == term, F.lit(0))
    near = F.abs(F.length(c) - len(term)) <= limit
    options = [_bounded(c, term, limit)]
    once = sorted(_swaps(term))
    for variant in once:
        if limit == 1:
            options.append(F.when(c == variant, F.lit(1)))
        else:
            options.append(_bounded(c, variant, limit - 1) + 1)
    if limit >= 2:
        twice = sorted(({w for v in once for w in _swaps(v)} | _gap_swaps(term)) - {term})
        if twice:
            options.append(F.when(c.isin(twice), F.lit(2)))
    best = F.least(*options) if len(options) > 1 else options[0]
    return F.when(near, best)


def _bounded(c: Column, word: str, limit: int) -> Column:
    d = F.levenshtein(c, F.lit(word), limit)
    return F.when(d >= 0, d)


#: Terms beyond this length have no deletions of their own, but share one mark.
LONGEST = 24
LONG_MARK = "\u0000long"


def deletions(term: Column, edits: int = 2) -> Column:
    """A term, and what is left of it without one or two (or only one) of its characters.

    Two terms within so many edits of each other, a swap being one, have such a rest in common.
    """

    every = _less(term) if edits == 1 else F.flatten(F.transform(_less(term), lambda t: _less(t)))
    return F.when(F.length(term) <= LONGEST, F.array_distinct(every)).otherwise(F.array(F.lit(LONG_MARK)))


def _less(t: Column, *mark: Column) -> Column:
    """A text, and the text without each of its characters, each behind a mark."""
    # place 0 takes nothing away
    some = F.sequence(F.lit(0), F.length(t))
    return F.transform(some, lambda i: F.concat(*mark, F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))


def deletions_of(term: str, edits: int) -> set[str]:
    """The stored rests at which terms within so many edits of ``term`` are found."""
    rests = level = {term}
    for _ in range(edits):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        rests = rests | level
    return rests | ({LONG_MARK} if len(term) + edits > LONGEST else set())


#: Most edits for which ``half_rests`` find every term.
HALVED_EDITS = 2
FRONT, BACK = "<", ">"


def half_rests(term: Column) -> Column:
    """What is left of either half of a term without at most one character, marked with the half and the term's length.

    Of two edits at most one falls on one of the halves; a swap across the middle is one
    replaced character on either side. So terms within two edits of each other have such a
    rest in common, and a term has about as many as characters, not half their square.
    """
    middle = F.floor(F.length(term) / 2).cast("int")

    mark = F.concat(F.length(term).cast("string"), F.lit(":"))
    front, back = F.substring(term, F.lit(1), middle), F.substring(term, middle + 1, F.length(term))
    rests = F.concat(_less(front, F.lit(FRONT), mark), _less(back, F.lit(BACK), mark))
    return F.when(F.length(term) <= LONGEST, rests).otherwise(F.array(F.lit(LONG_MARK)))


def half_rests_of(term: str, edits: int) -> set[str]:
    """The stored rests at which terms within so many edits of ``term``, two at most, are found."""
    rests, less = set(), min(edits, 1)
    for n in range(max(len(term) - edits, 0), min(len(term) + edits, LONGEST) + 1):
        front, back = n // 2, n - n // 2
        for i in range(len(term) + 1):
            if abs(i - front) <= less:
                rests |= {f"{FRONT}{n}:{r}" for r in deletions_of(term[:i], less)}
            if abs(len(term) - i - back) <= less:
                rests |= {f"{BACK}{n}:{r}" for r in deletions_of(term[i:], less)}
    return rests | ({LONG_MARK} if len(term) + edits > LONGEST else set())
