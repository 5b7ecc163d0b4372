"""Text cleaning, hashing, tokenizing and rule predicates as column expressions (no Python in the tasks)."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import once

# Word lists, patterns and constants whose results must match.
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "then", "so", "of", "in", "on", "at", "to", "for", "with",
    "by", "from", "up", "about", "into", "over", "after",
    "is", "am", "are", "was", "were", "be", "been", "being", "do", "does", "did", "doing",
    "have", "has", "had", "having",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
    "my", "your", "his", "its", "our", "their",
    "this", "that", "these", "those", "as", "not", "no", "yes",
    "can", "could", "will", "would", "shall", "should", "may", "might", "must",
    "what", "when", "where", "who", "whom", "which", "why", "how",
]
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid"]
MONTHS = ["january|jan", "february|feb", "march|mar", "april|apr", "may", "june|jun", "july|jul", "august|aug", "september|sept|sep", "october|oct", "november|nov", "december|dec"]
HINGLISH = [
    "hai", "hain", "hoon", "hun", "tha", "thi", "thay",
    "nahi", "nahin", "haan", "han",
    "kya", "kyun", "kyu", "kaise", "kahan", "kab", "kaun", "kitna", "kitne",
    "hum", "humein", "humko", "mujhe", "mujhko", "tumhe", "tumko", "aap", "aapka", "aapko",
    "mera", "meri", "mere", "tera", "teri", "tere", "uska", "uski", "unka", "iska", "iski", "unko", "isko", "usko",
    "karo", "kro", "karna", "krna", "kiya", "kijiye", "krke",
    "raha", "rha", "rahi", "rhi", "rahe", "rhe",
    "bhai", "yaar", "acha", "accha", "theek", "thik", "sahi",
    "bahut", "bohot", "matlab", "chahiye",
    "wala", "wale", "wali", "jaisa", "jaise", "waisa", "waise", "isliye", "lekin", "magar",
    "paisa", "paise", "paisay", "abhi", "phir", "fir",
    "samajh", "samjho", "dekho", "suno", "bolo", "jaana", "jana",
    "ka", "ki", "ke", "ko", "se", "mein", "par", "aur", "poora", "pura",
    "din", "kaam", "jaldi", "pahle", "jo", "ek", "jayega", "jaye", "hisab", "bnate", "banate", "usme", "isme",
]
INJECTION_PATTERNS = [
    r"(?i)ignore\s+(all|any|the)?\s*(previous|above|prior)\s*instructions?",
    r"(?i)disregard\s+(all|any|the)?\s*(previous|above|prior)",
    r"(?i)forget\s+(everything|all)\s+(you know|above)",
    r"(?i)you\s+are\s+now\b",
    r"(?i)act\s+as\s+(?!an?\s+assistant\b)",
    r"(?i)pretend\s+(you|to\s+be)",
    r"(?i)reveal\s+(your|the)\s*(system\s*prompt|instructions|prompt)",
    r"(?i)what\s+(is|are)\s+your\s+(system\s*prompt|instructions)",
    r"(?i)print\s+(your|the)\s+(instructions|system\s*prompt)",
    r"(?i)\bjailbreak\b",
    r"(?i)developer\s+mode",
    r"\bDAN\b",
    r"(?i)\[?system\]?\s*:",
]
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
MONEY = r"[$€£₹¥]\s?\d[\d,]*(?:\.\d{1,2})?"
PRICE_KEYS = r"(?i)(price|cost|fee|amount|discount|msrp)"

#: White space as a browser's regular expressions see it.
SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CONTROLS = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]"
URL_CHARS = r"""[^\s)"'<>]"""


#: The same characters one by one.
SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_spaces(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze_spaces(c: Column) -> Column:
    """Every run of white space as one space. Plain replacements leave the regular expression only texts with a run to shorten."""
    for x in SPACE_CHARS.replace(" ", ""):
        c = F.replace(c, F.lit(x), F.lit(" "))
    return once(c, lambda x: F.when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x))


def strip_invalid_unicode(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return trim_spaces(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalize_numbers(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９．，", "0123456789.,")


def normalize_punctuation(c: Column) -> Column:
    c = F.replace(F.translate(c, "‘’‚‛“”„‟–—", "''''\"\"\"\"--"), F.lit("…"), F.lit("..."))
    return F.regexp_replace(F.regexp_replace(c, r"([!?,;:])\1+", "$1"), r"\.{4,}", "...")


def strip_tracking_params(c: Column) -> Column:
    """Texts without a link are left alone, so the ten replacements run on few rows."""
    out = c
    for name in TRACKING_PARAMS:
        out = F.regexp_replace(out, rf"(https?://{URL_CHARS}*?[?&]){name}=[^&#\s)\"'<>]*&?", "$1")
    out = F.regexp_replace(out, rf"(https?://{URL_CHARS}*?)[?&]+([\s)\"'<>#]|$)", "$1$2")
    return F.when(c.contains("://"), out).otherwise(c)


_MONTH = "|".join(MONTHS)
#: Any date that is rewritten; texts without one skip the replacements of the twelve months.
DATED = rf"(?i)\b(?:(?:{_MONTH})\s+\d{{1,2}}|\d{{1,2}}\s+(?:{_MONTH})),?\s+\d{{4}}\b"


def normalize_dates(c: Column) -> Column:
    def month(number: int, names: str):
        def replaced(x: Column) -> Column:
            out = x
            for day, zero in ((r"(\d\d)", ""), (r"(\d)", "0")):
                out = F.regexp_replace(out, rf"(?i)\b(?:{names})\s+{day},?\s+(\d{{4}})\b", f"$2-{number:02d}-{zero}$1")
                out = F.regexp_replace(out, rf"(?i)\b{day}\s+(?:{names}),?\s+(\d{{4}})\b", f"$2-{number:02d}-{zero}$1")
            return F.when(x.rlike(f"(?i){names}"), out).otherwise(x)

        return replaced

    out = c
    for number, names in enumerate(MONTHS, 1):
        out = once(out, month(number, names))
    return F.when(c.rlike(r"\d{4}") & c.rlike(DATED), out).otherwise(c)


def normalize_text(c: Column) -> Column:
    """All steps in order; compose with ``nfc`` where input may be decomposed."""
    c = normalize_whitespace(nfc(strip_invalid_unicode(c)))
    return normalize_dates(strip_tracking_params(normalize_punctuation(normalize_numbers(c))))


def nfc(c: Column) -> Column:
    """Unicode NFC; Spark has no function for it, so texts go through one Arrow batch call."""
    return F.pandas_udf(_nfc, "string")(c)


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def sanitize_message(c: Column, longest: int = 4000) -> Column:
    return F.left(trim_spaces(F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", "")), F.lit(longest))


def escape_html(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def content_hash(c: Column) -> Column:
    return F.sha2(F.trim(squeeze_spaces(F.lower(c))), 256)


def tokenize(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def looks_like_hinglish(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)
    hits = F.size(F.filter(words, lambda w: w.isin(HINGLISH)))
    return (hits >= 2) & (hits / F.greatest(F.size(words), F.lit(1)) >= 0.08)


def matched_patterns(c: Column, patterns: list[str]) -> Column:
    """Numbers (from 1) of the patterns found in ``c``."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in enumerate(patterns, 1)]))


def unit_issues(content: Column, source: Column) -> Column:
    """Codes of what is wrong with a content unit, in declared order."""
    words = F.filter(F.split(squeeze_spaces(F.lower(content)), " "), lambda w: w != "")
    broken = F.regexp_count(content, F.lit("�")) / F.greatest(F.length(content), F.lit(1))
    repetitive = once(words, lambda w: (F.size(w) >= 20) & (F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)) < 0.15))
    blank = F.length(trim_spaces(content)) == 0
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.length(trim_spaces(source)), F.lit(0)) == 0, "missing_source"),
            F.when(blank, "empty_content"),
            F.when(broken > 0.05, "encoding_broken"),
            F.when(~blank & (F.length(trim_spaces(content)) < 10), "content_too_short"),
            F.when(repetitive, "repetitive_content"),
        )
    )


ERRORS = ("missing_source", "empty_content", "encoding_broken")


def is_js_shell(html: Column, least: int = 250) -> Column:
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), html)
    text = F.regexp_replace(body, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    text = trim_spaces(F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]+>", " "), r"\s+", " "))
    return html.rlike("(?i)<script") & (F.length(text) < least)


def looks_like_code(c: Column) -> Column:
    """At least two non-blank lines, half of them with a mark of code."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.length(F.trim(x)) > 0)
    marks = F.filter(lines, lambda x: x.rlike(r"[{};]\s*$|^\s*(def|class|import|function|const|let|var|return|if|for|while)\b|=>|</?[a-z]+>"))
    return (F.size(lines) >= 2) & (F.size(marks) / F.greatest(F.size(lines), F.lit(1)) >= 0.5)


# What a full stop does not end, and the ends of sentences (read alike by Java and the regex module).
ABBREVIATIONS = r"(?:[A-Z]|Mr|Ms|Dr|Sr|Jr|St|vs|No|Mrs|etc|Inc|Ltd|Prof|e\.g|i\.e)"
SENTENCE_END = rf"(?<=[.!?]|[.!?][\"'”’)])(?<!(?:^|[^\p{{L}}\p{{N}}_]){ABBREVIATIONS}\.)\s+"


def split_sentences(c: Column) -> Column:
    """Sentences at an end mark (with a closing quote) before white space; abbreviations, initials and decimals do not end one."""
    return F.filter(F.split(trim_spaces(c), SENTENCE_END), lambda s: F.length(s) > 0)
