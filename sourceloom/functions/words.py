"""Word-level helpers: names, tokens, claims, snippets."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceloom.functions.fold import WS, ascii_fold, collapse_spaces, search_fold, strip, tidy
from sourceloom.functions.lets import let, none_if_blank

# Word lists and name patterns that decide results.
LEGAL_SUFFIXES = [
    "s.a.p.i. de c.v.", "s. de r.l. de c.v.", "s.l.u.", "s.a.u.", "s.c.r.", "s.l.", "s.a.",
    "sociedad limitada", "sociedad anonima", "inc", "ltd", "llc",
    "gmbh", "b.v.", "s.r.l.", "limited", "corp", "co", "sl", "sa",
]
QUERY_STOP_WORDS = [
    "the", "a", "an", "in", "on", "of", "for", "and", "or", "to", "is", "are", "was",
    "were", "what", "which", "who", "how", "when", "where", "with", "about", "does",
    "do", "did", "at", "by", "it", "its", "our", "their", "this", "that", "please",
]
CLAIM_STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "from", "was", "were", "are", "our",
    "their", "has", "have", "had", "will", "would", "into", "over", "under", "about",
]
RECENCY_WORDS = ["current", "latest", "now", "today", "newest", "most recent"]
VERSION_MARKER_WORDS = r"(?i)\b(?:final|draft|copy|old|new|updated|revised|v\d+|rev\d*)\b|\(\d+\)"
COPY_MARKERS = r"(?i)(?:copy|\(\d+\)|_old|_v\d+\b|draft|unsigned)"
SYSTEM_FOOTERS = ["Summary of a live spreadsheet", "Original file:"]


def _spoken(suffix: str) -> str:
    """A legal form as it reads once dots and commas became spaces."""
    return " ".join(suffix.replace(".", " ").replace(",", " ").split())


_SUFFIX_TAIL = "(?: (?:" + "|".join(dict.fromkeys(_spoken(s) for s in LEGAL_SUFFIXES)) + "))+$"


def entity_key(name: Column) -> Column:
    """Canonical key of an entity name: folded, unpunctuated, legal forms removed."""
    bare = F.regexp_replace(F.lower(ascii_fold(name)), r"[.,()\"'/]", " ")
    return F.trim(F.regexp_replace(F.trim(collapse_spaces(bare)), _SUFFIX_TAIL, ""))


def is_noise_key(key: Column) -> Column:
    return (F.length(key) < 3) | key.rlike(r"^[a-z](?:\s+[a-z])*$")


def file_stem(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.when(base.contains("."), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def version_stem(name: Column) -> Column:
    """File stem with version markers removed."""
    return F.lower(strip(collapse_spaces(F.regexp_replace(file_stem(name), VERSION_MARKER_WORDS, " "))))


def marker_score(name: Column) -> Column:
    """Version strength of a name: final > vN > unmarked > copy > draft."""
    low = F.lower(name)
    numbered = none_if_blank(F.regexp_extract(low, r"\bv(\d+)\b", 1)).cast("bigint")
    return (F.when(low.contains("final"), 100).otherwise(0).cast("bigint")
            - F.when(low.contains("draft"), 100).otherwise(0)
            + F.coalesce(numbered, F.lit(0))
            - F.when(low.rlike(r"\bcopy\b|\(\d+\)"), 1).otherwise(0))


def content_tokens(text: Column) -> Column:
    """Distinct content words (three or more characters, stop words removed)."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in CLAIM_STOP_WORDS]))


def strip_page_chrome(page_text: Column) -> Column:
    """Prose of a page: no frontmatter, headings, tables, quotes or system footers."""
    body = F.when(page_text.startswith("---\n"), F.regexp_replace(page_text, r"(?s)\A---\n.*?\n---\n?", "")).otherwise(page_text)

    def prose(line: Column) -> Column:
        kept = ~line.startswith("#")
        for mark in ["|", ">", *SYSTEM_FOOTERS]:
            kept = kept & ~line.startswith(mark)
        return kept

    return F.array_join(F.filter(F.split(body, "\n"), prose), "\n")


def split_claims(body: Column, min_chars: int = 40, max_claims: int | None = None) -> Column:
    """Paragraphs worth judging, in order."""
    blocks = F.transform(F.split(body, rf"\n{WS}*\n"), tidy)
    kept = F.filter(blocks, lambda b: F.length(b) >= min_chars)
    return F.slice(kept, 1, max_claims) if max_claims else kept


def question_terms(question: Column) -> Column:
    """Full-text terms of a question; a hyphenated or quoted word is one term (a phrase)."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_'\-]*"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(QUERY_STOP_WORDS))
    return F.array_distinct(F.filter(F.transform(kept, lambda w: F.array_join(search_tokens(w), " ")),
                                     lambda p: p != ""))


def question_tokens(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(
        F.lower(question), F.lit(r"[a-z0-9][a-z0-9'\-]*"), F.lit(0)))


def search_tokens(text: Column) -> Column:
    """Full-text tokens: maximal runs of letters and digits, folded."""
    return F.regexp_extract_all(search_fold(F.coalesce(text, F.lit(""))),
                                F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def snippet(body: Column, tokens: Column, width: int = 240) -> Column:
    """Region around the longest question token the body contains (head when none)."""
    def pick(low: Column) -> Column:
        hits = F.filter(tokens, lambda t: (F.length(t) >= 3) & (F.instr(low, t) > 0))
        best = F.get(F.array_sort(F.transform(
            hits, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), F.lit(0))["t"]
        start = F.coalesce(F.greatest(F.instr(low, best) - 1 - width // 3, F.lit(0)), F.lit(0))
        return strip(collapse_spaces(F.substring(body, start + 1, F.lit(width))))

    return let(F.lower(F.coalesce(body, F.lit(""))), pick)


def normalized_quote(text: Column) -> Column:
    return F.lower(strip(collapse_spaces(F.coalesce(text, F.lit("")))))
