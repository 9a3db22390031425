"""Instruction-like text matching (FN-13..17, DET-28).

Matching is a handful of anchored alternations evaluated by the JVM. The whole
text is inspected unless a limit is given. Compatibility folding (NFKC) has no
built-in, so it runs as an Arrow Pandas UDF; values that folding cannot change
are passed to it as nulls and never leave the JVM.
"""

from __future__ import annotations

import unicodedata
from string import ascii_letters

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions.text import collapse_spaces, strip

# The coarse profiling pattern.
INSTRUCTION_LIKE = (
    r"\b(ignore|disregard)\s+(all\s+)?(previous|prior)\s+instructions\b"
    r"|\byou\s+are\s+now\b"
    r"|\bnew\s+instructions\s*:"
)
INSTRUCTION_WORDS = ("ignore", "disregard", "you", "new")

# Nouns that name a secret.
SECRET_NOUN = (
    r"(api[\s_-]?keys?|access\s+tokens?|auth(entication)?\s+tokens?|bearer\s+tokens?"
    r"|passwords?|passphrases?|secret\s+keys?|private\s+keys?|ssh\s+keys?|credentials?"
    r"|connection\s+strings?)"
)

# The pattern families and, for the two heightened ones, their longer phrasings.
FAMILIES: dict[str, tuple[str, ...]] = {
    "ignore_previous_instructions": (
        r"\b(ignore|disregard)\s+(all\s+)?(previous|prior)\s+instructions\b",
    ),
    "reveal_system_prompt": (
        r"\b(reveal|show|print|display)\s+(me\s+)?(the\s+)?(system|hidden)\s+prompt\b",
    ),
    "act_as_another_system": (
        r"\byou\s+are\s+now\b"
        r"|\bact\s+as\s+(a|an)\s+\w+(\s+\w+){0,3}\b"
        r"|\bpretend\s+(that\s+)?you\s+are\b",
    ),
    "suppress_reporting": (
        r"\b(do\s+not|don'?t)\s+(report|mention|flag|disclose)\s+(this|these|any)\b",
    ),
    "claim_data_valid": (
        r"\b(claim|say|state)\s+(this|the)\s+(dataset|data)\s+is\s+"
        r"(perfect|valid|clean|accurate)\b",
    ),
    "forced_output_only": (
        r"\b(output|respond|answer)\s+only\b|\bonly\s+(output|respond|say|answer)\b",
    ),
    "disclose_secrets": (
        r"\b(reveal|disclose|share|give)\s+(me\s+)?(the\s+)?"
        r"(api\s*key|password|secret|credentials?)\b",
        r"\b(tell|provide|show|print|display|paste|send|email|output|return|list|dump"
        r"|expose|leak|hand\s+over|read\s+out)\s+(me\s+|us\s+)?"
        r"(the\s+|your\s+|all\s+the\s+|all\s+of\s+the\s+|all\s+|any\s+)?"
        + SECRET_NOUN + r"\b",
        r"\bwhat(\s+is|'s|s)\s+(the\s+|your\s+)" + SECRET_NOUN + r"\b",
    ),
    "exfiltrate_data": (
        r"\b(send|email|post|upload|export)\s+(this\s+|the\s+)?data\s+(to|externally)\b",
        r"\b(send|email|mail|post|upload|export|forward|transmit|copy|leak|sync|stream)\s+"
        r"(all\s+|any\s+)?(of\s+)?(this\s+|the\s+|these\s+|that\s+|my\s+|our\s+)?"
        r"(data|dataset|records|rows|table|file|spreadsheet|information)\s+"
        r"((to|into|onto)\s+(an?\s+|the\s+|my\s+|this\s+|that\s+)?"
        r"(external|outside|remote|third[\s-]party|unknown|public|personal|private"
        r"|attacker|own)\b"
        r"|externally\b|off[\s-]?site\b|outside\s+(the\s+)?(company|organi[sz]ation|network)\b)",
        r"\b(exfiltrate|leak)\s+(all\s+)?(of\s+)?(the\s+|this\s+|these\s+)?"
        r"(data|dataset|records|rows|information)\b",
    ),
}
# The words a phrase can open with.
OPENING_WORDS = (
    "ignore disregard reveal show print display you act pretend do don claim say state output "
    "respond answer only disclose share give tell provide paste send email return list dump "
    "expose leak hand read what post upload export mail forward transmit copy sync stream exfiltrate"
).split()
HEIGHTENED = ("disclose_secrets", "exfiltrate_data")

# Subtypes in report order, and the families that are not plain injection.
SUBTYPES = ("prompt_injection", "exfiltration_instruction", "secret_request")
FAMILY_SUBTYPE = {
    "exfiltrate_data": "exfiltration_instruction",
    "disclose_secrets": "secret_request",
}

# What is masked in an excerpt, in this order.
MASKS = (
    r"(?iU)\bhttps?://\S+",
    r"(?U)(?<![^\s@])[^\s@]{1,64}@[^\s@]{1,255}",
    r"\b(sk|pk|rk)-[A-Za-z0-9_-]{8,}|\bAKIA[0-9A-Z]{8,}|\bgh[pousr]_[A-Za-z0-9]{8,}"
    r"|\bxox[abpr]-[A-Za-z0-9-]{8,}",
    r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}(?![A-Za-z0-9+/=_-])",
)
MASK_TEXT = "[redacted]"
EXCERPT_LENGTH = 80

# Texts of these characters only are left alone by folding: NFKC does not change them and they are no
# format characters (ASCII, Latin-1 letters and stable signs, common typographic punctuation). Latin-1
# is listed one by one and the rest only compared within its range, which keeps a comparison cheap.
_STABLE_LATIN = [*range(0x80), *range(0xA1, 0xA8), 0xA9, 0xAB, 0xAC, 0xAE, 0xB0, 0xB1, 0xB6, 0xB7, 0xBB, *range(0xBF, 0x100)]
_STABLE = (
    "\\A[" + "".join(f"\\x{{{c:x}}}" for c in _STABLE_LATIN)
    + r"[\x{2012}-\x{2023}&&[\x{2012}-\x{2016}\x{2018}-\x{2023}]]]*+\z"
)


def _fold(c: Column) -> Column:
    """NFKC, invisible format characters dropped."""

    # Local, so that it travels to the workers by value and needs no import there.
    def fold(value: str) -> str:
        folded = unicodedata.normalize("NFKC", value)
        return "".join(ch for ch in folded if unicodedata.category(ch) != "Cf")

    def fold_all(values: pd.Series) -> pd.Series:
        return values.map(fold, na_action="ignore")

    return F.pandas_udf(fold_all, T.StringType())(c)


def normalize(c: Column, raw_limit: int | None = None, limit: int | None = None) -> Column:
    """FN-14. Limits are optional guards: by default the whole text is kept."""
    raw = F.substring(c, 1, raw_limit) if raw_limit else c
    ascii_only = F.octet_length(raw) == F.length(raw)
    folded = F.coalesce(_fold(F.when(~ascii_only & ~raw.rlike(_STABLE), raw)), raw)
    flat = strip(collapse_spaces(folded))
    return F.substring(flat, 1, limit) if limit else flat


def _phrase_in(c: Column, phrases: str, words: tuple[str, ...] | list[str]) -> Column:
    """Does a phrase that opens with one of `words`, at a word boundary, occur in the text?

    Such a phrase follows no ASCII letter, and a plain class of first letters refuses most other
    places, so the costlier Unicode matching starts at few of them. The blank is for the first word.
    """
    first = "".join(sorted({x for word in words for x in (word[0], word[0].upper())}))
    # the other characters that a letter matches when case is ignored
    return F.concat(F.lit(" "), c).rlike(f"[^{ascii_letters}](?=[{first}\u0130\u0131\u017f\u212a])(?iU:{phrases})")


def instruction_like(c: Column) -> Column:
    """FN-13."""
    return _phrase_in(c, INSTRUCTION_LIKE, INSTRUCTION_WORDS)


def family_match(normalized: Column, family: str) -> Column:
    return normalized.rlike("(?iU)" + "|".join(f"(?:{p})" for p in FAMILIES[family]))


def any_match(normalized: Column) -> Column:
    """Does any family match? One pattern, so one pass over the text.

    Every phrase opens with one of a few words; looking for their first letters at a word
    boundary skips most positions before any phrase is tried.
    """
    openings = "|".join(sorted({word[:3] for word in OPENING_WORDS}))
    patterns = "|".join(f"(?:{p})" for family in FAMILIES.values() for p in family)
    return _phrase_in(normalized, f"\\b(?={openings})(?:{patterns})", OPENING_WORDS)


def matched_families(normalized: Column) -> Column:
    """FN-15: the names of the families a normalized text matches; told apart only if any does."""
    told = F.array_compact(F.array(*[F.when(family_match(normalized, f), F.lit(f)) for f in FAMILIES]))
    return F.when(any_match(normalized), told).otherwise(F.array().cast("array<string>"))


def subtypes(families: Column) -> Column:
    """FN-16: the subtypes of a families column, in report order."""
    special = F.array(*[F.lit(f) for f in FAMILY_SUBTYPE])
    marks = [F.when(F.size(F.array_except(families, special)) > 0, F.lit(SUBTYPES[0]))]
    for name in SUBTYPES[1:]:
        family = next(f for f, s in FAMILY_SUBTYPE.items() if s == name)
        marks.append(F.when(F.array_contains(families, family), F.lit(name)))
    return F.array_compact(F.array(*marks))


def excerpt(normalized: Column) -> Column:
    """FN-17: cut at the earliest heightened phrase, mask, bound."""
    ends = []
    for family in HEIGHTENED:
        for p in FAMILIES[family]:
            found = F.regexp_substr(normalized, F.lit(f"(?iU){p}"))
            before = F.element_at(F.split(normalized, f"(?iU){p}", 2), 1)
            ends.append(F.length(before) + F.length(found))
    cut = F.coalesce(F.least(*ends), F.length(normalized))
    kept = F.substring(normalized, F.lit(1), cut)
    for mask in MASKS:
        kept = F.regexp_replace(kept, mask, MASK_TEXT)
    return F.substring(kept, 1, EXCERPT_LENGTH)


def severity(heightened: Column, samples_sent: bool) -> Column:
    """DET-28: severity by exposure."""
    high, low = ("critical", "medium") if samples_sent else ("high", "low")
    return F.when(heightened, high).otherwise(low)


def confidence(family_count: Column) -> Column:
    return F.when(family_count >= 2, 0.75).otherwise(0.6)
