"""Text column builders. Everything here stays in the JVM except ``nfc``/``nfkc``,
whose Python part sees only the rows that hold a character in need of it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode spellings of Python's \w and \s for Java regexes.
WORD = r"\p{L}\p{N}_"
SPACE = r"[\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Its blanks: the separators that SQL's TRIM takes off.
BLANKS = "".join(map(chr, [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
#: The characters of SPACE.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Patterns shared with the SQL side of the checks.
TOKEN_PATTERN = rf"[{WORD}]+|[^{WORD}\s]"
WORD_PATTERN = r"[\p{L}\p{N}]+"
TERM_PATTERN = rf"[{WORD}]+"
LEGAL_REFERENCE = (
    r"(?iu)(?<![\p{L}\p{N}_])(?:Luật|Nghị định|Thông tư|Quyết định)\s+"
    r"(?:số\s+)?[\p{L}\p{N}_./-]+(?:\s*/\s*[A-ZĐ-]+)?"
)
QUANTIFIED = (
    r"(?iu)(?<![\p{L}\p{N}_])\d[\d.,]*\s*"
    r"(?:(?:ngày|tháng|năm|đồng|triệu|tỷ|kg|km)(?![\p{L}\p{N}_])|%(?=[\p{L}\p{N}_]))"
)
SOURCE_MARKER = r"(?iu)\s*\[(?:Nguon|Nguồn|Source)\s+(\d+)\]\s*"


@cache
def _changed_class(form: str) -> str:
    """Regex class of the characters that ``form`` may rewrite, derived from Unicode data."""
    spans: list[list[int]] = []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch) or unicodedata.normalize(form, ch) != ch or 0x1100 <= cp <= 0x11FF:
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    spans.append([0x10000, 0x10FFFF])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + "]"


@cache
def _other_than_stable(form: str) -> str:
    """Short class for a first look: anything but the common letters ``form`` keeps."""
    spans: list[list[int]] = []
    for cp in [*range(0x300), *range(0x1EA0, 0x1EFA), *range(0x2010, 0x2028)]:
        if unicodedata.normalize(form, chr(cp)) == chr(cp):
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    return "[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + "]"


@F.pandas_udf(T.StringType())
def _normalize_form(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, form in parts:
        yield pd.Series(
            [None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form)],
            dtype=object,
        )


def _normal_form(col: Column, form: str) -> Column:
    needs = col.rlike(_other_than_stable(form)) & col.rlike(_changed_class(form))
    return F.coalesce(_normalize_form(F.when(needs, col), F.lit(form)), col)


def nfc(col: Column) -> Column:
    return _normal_form(col, "NFC")


def nfkc(col: Column) -> Column:
    return _normal_form(col, "NFKC")


@cache
def _accent_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, derived from Unicode data."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))
        kept = "".join(c for c in base if unicodedata.category(c) != "Mn")
        if len(kept) == 1 and kept != chr(cp):
            src.append(chr(cp))
            dst.append(kept)
    return "".join(src) + "đĐ", "".join(dst) + "dD"


def fold(col: Column) -> Column:
    """Case folding: lower case plus the two letters whose folding differs from it."""
    sigma = F.replace(F.lower(col), F.lit("ς"), F.lit("σ"))
    return F.replace(sigma, F.lit("ß"), F.lit("ss"))


def deaccent(col: Column) -> Column:
    src, dst = _accent_table()
    return F.regexp_replace(F.translate(col, src, dst), r"\p{Mn}", "")


def strip(col: Column) -> Column:
    """Python-like strip of all white space, not only blanks; looks at both ends only, unlike a regex."""
    return F.trim(col, F.lit(SPACES))


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, rf"{SPACE}+", " "))


def normalize_content(col: Column, *, unicode_form: bool = True) -> Column:
    """H1: canonical form, blanks and tabs collapsed, trimmed."""
    base = nfc(col) if unicode_form else col
    return strip(F.regexp_replace(base, r"[ \t]+", " "))


def normalize_source(col: Column, *, unicode_form: bool = True) -> Column:
    """H2: form in which quotes are compared with their source."""
    base = nfkc(col) if unicode_form else col
    ascii_marks = F.translate(base, "“”‘’–— ", "\"\"''-- ")
    return collapse(fold(ascii_marks))


def search_form(normalized: Column) -> Column:
    """H3: compact form of an already source-normalized column."""
    return F.regexp_replace(normalized, rf"[^{WORD}]+", "")


def slug(col: Column, joiner: str = " ") -> Column:
    """H4: accent-free key with every other character run turned into ``joiner``."""
    return F.trim(F.regexp_replace(fold(deaccent(col)), "[^a-z0-9]+", joiner), F.lit(joiner))


def canonical_name(col: Column, *, unicode_form: bool = True) -> Column:
    base = nfkc(col) if unicode_form else col
    trimmed = F.trim(collapse(base), F.lit(" ,.;"))
    return strip(F.regexp_replace(trimmed, r"\s*\([A-ZĐ]{2,12}\)\s*$", ""))


def normalized_name(canonical: Column) -> Column:
    """H5: comparison key of a canonical name."""
    return slug(canonical, " ")


def tokens(col: Column) -> Column:
    """H7: folded alphanumeric tokens."""
    return F.regexp_extract_all(fold(col), F.lit(WORD_PATTERN), F.lit(0))


def terms(col: Column) -> Column:
    """H8: distinct folded word terms."""
    return F.array_distinct(F.regexp_extract_all(fold(col), F.lit(TERM_PATTERN), F.lit(0)))


def token_count(col: Column) -> Column:
    """H6: words plus single punctuation marks."""
    return F.regexp_count(col, F.lit(TOKEN_PATTERN)).cast("long")


def _before_last_blank(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)^(.*) .*$", "$1")


def display(col: Column, limit: int | None = 240) -> Column:
    """H9: one-line display text cut at a word; whole without a limit, as for names that identify."""
    text = F.trim(collapse(col), F.lit(" ,;"))
    if limit is None:
        return text
    cut = F.concat(_before_last_blank(F.substring(text, 1, limit)), F.lit("..."))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def quote(col: Column, limit: int = 360) -> Column:
    """H9: source excerpt cut at a word."""
    text = strip(col)
    return F.when(F.length(text) <= limit, text).otherwise(
        _before_last_blank(F.substring(text, 1, limit))
    )


def fit_label(col: Column, limit: int = 255) -> Column:
    cut = F.concat(F.regexp_replace(F.substring(col, 1, limit - 3), r"\s+$", ""), F.lit("..."))
    return F.when(F.length(col) <= limit, col).otherwise(cut)


def executive_summary(col: Column, limit: int = 700) -> Column:
    text = collapse(col)
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def family_key(title: Column, number: Column, explicit: Column) -> Column:
    """An explicit key wins; otherwise number and title without their year."""
    unyeared = F.regexp_replace(
        F.concat_ws(" ", number, title), rf"(?<![{WORD}])(?:19|20)\d{{2}}(?![{WORD}])", ""
    )
    given = F.when(F.length(F.trim(explicit)) > 0, explicit)
    return slug(F.coalesce(given, unyeared), "-")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Reproducible identifier of the given parts."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 20))


def detect_language(col: Column) -> Column:
    """H16. The letter class also holds accents of other languages; that is kept."""
    low = fold(col)
    words = rf"(?<![{WORD}])(điều|khoản|ngày|cơ quan|trách nhiệm|thời hạn)(?![{WORD}])"
    hit = low.rlike("[ăâđêôơưà-ỹ]") | low.rlike(words)
    return F.when(hit, "vi").otherwise("multilingual")


# Markers of a query written in Vietnamese.
QUERY_MARKERS = ("đ", "ă", "â", "ê", "ô", "ơ", "ư", "điều", "khoản", "thời hạn")
# Markers of a question that needs a comprehensive answer.
COMPREHENSIVE_MARKERS = (
    "so sánh", "tổng hợp", "ngân sách", "kinh phí", "deadline",
    "thời hạn", "trách nhiệm", "pháp lý", "số liệu",
)
# Markers of a spoken question.
QUESTION_MARKERS = ("?", "ở điều nào", "bao lâu", "bao nhiêu", "ai chịu trách nhiệm")


def contains_any(col: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | col.contains(needle)
    return hit


def is_vietnamese_query(col: Column) -> Column:
    return contains_any(fold(col), QUERY_MARKERS)


def segment_type(text: Column, supplied: Column | None = None) -> Column:
    asked = contains_any(fold(text), QUESTION_MARKERS)
    if supplied is not None:
        asked = asked | F.coalesce(supplied == "QUESTION", F.lit(False))
    return F.when(asked, "QUESTION").otherwise("SPEECH")


def question_intent(question: Column, document_count: Column) -> Column:
    wide = (document_count > 1) | contains_any(fold(question), COMPREHENSIVE_MARKERS)
    return F.when(wide, "COMPREHENSIVE").otherwise("FACTUAL")


def sentences(col: Column, space: str = r"\s", ends: str = SPACES) -> Column:
    """Trimmed, non-empty segments ending at . ! ? or a line break.

    ``space``: regex of what separates sentences; ``ends``: characters trimmed from a segment."""
    parts = F.transform(F.split(col, rf"(?<=[.!?]){space}+|\n+"), lambda s: F.trim(s, F.lit(ends)))
    return F.filter(parts, lambda s: s != "")


def best_segment(text: Column, question_tokens: Column, space: str = r"\s", ends: str = SPACES) -> Column:
    """First segment sharing most distinct tokens with the question, as hits, rank and text; null if there is no segment."""
    scored = F.transform(
        sentences(text, space, ends),
        lambda s, i: F.struct(
            F.size(F.array_intersect(tokens(s), question_tokens)).alias("hits"),
            (-i).alias("rank"),
            s.alias("text"),
        ),
    )
    return F.array_max(scored)


def best_quote(text: Column, question_tokens: Column, limit: int = 600) -> Column:
    """The text of ``best_segment``, else of ``text`` itself."""
    best = best_segment(text, question_tokens)["text"]
    return F.coalesce(strip(F.substring(best, 1, limit)), F.substring(text, 1, limit))


def cited_numbers(answer: Column) -> Column:
    found = F.regexp_extract_all(answer, F.lit(SOURCE_MARKER), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: n.cast("int")))


def strip_markers(answer: Column) -> Column:
    out = F.regexp_replace(answer, SOURCE_MARKER, " ")
    out = F.regexp_replace(out, r"\s+([,.!?;:])", "$1")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def display_clause(col: Column) -> Column:
    return F.regexp_replace(col, r"(?iu)^\s*(?:Khoản|Khoan)\s+", "Mục ")


def quantified_values(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(QUANTIFIED), F.lit(0))


def legal_references(col: Column) -> Column:
    """Cited acts in order of first appearance."""
    found = F.regexp_extract_all(col, F.lit(LEGAL_REFERENCE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda s: strip(s)))


def first_line(col: Column) -> Column:
    line = F.regexp_extract(col, r"(?m)^[ \t]*(\S[^\r\n]*)$", 1)
    return F.when(line != "", strip(line)).otherwise(strip(col))


def same_value(a: Column, b: Column) -> Column:
    return collapse(fold(a)) == collapse(fold(b))


def display_stem(name: Column) -> Column:
    """File name without its last suffix (a leading dot is no suffix)."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def name_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


# Rank of severities and importances.
RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}


def rank_of(col: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in RANK.items():
        out = F.when(col == name, value).otherwise(out)
    return out


def rank_name(col: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in RANK]), col + 1)


def lookup(col: Column, table: dict[str, str], default: Column) -> Column:
    out = default
    for key, value in table.items():
        out = F.when(col == key, value).otherwise(out)
    return out


def level_of(score: Column) -> Column:
    """H34."""
    return (
        F.when(score >= 0.95, "CRITICAL").when(score >= 0.70, "HIGH")
        .when(score >= 0.45, "MEDIUM").otherwise("LOW")
    )


def unfence(col: Column) -> Column:
    """Content of a fenced block, or the trimmed text itself."""
    body = F.regexp_extract(col, r"(?is)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(body != "", body).otherwise(strip(col))


# Key parts whose values never reach the audit log.
SENSITIVE_PARTS = (
    "password", "passwd", "token", "authorization", "cookie", "secret", "credential",
)


def sanitize_metadata(entries: Column) -> Column:
    """H22 on a map<string,string>: redact, cut keys to 128 and values to 1024."""
    cut = F.transform(
        F.map_entries(entries), lambda e: F.struct(F.substring(e["key"], 1, 128).alias("key"), e["value"].alias("value"))
    )
    keys = F.transform(cut, lambda e: e["key"])
    # Of keys that became equal the last one stays.
    kept = F.filter(cut, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.transform_values(
        F.map_from_entries(kept),
        lambda k, v: F.when(contains_any(fold(k), SENSITIVE_PARTS), "[REDACTED]").otherwise(
            F.substring(v, 1, 1024)
        ),
    )


def camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(part.capitalize() for part in tail)


def bbox_of(box: Column, polygon: Column) -> Column:
    """[x1,y1,x2,y2] when complete, else the hull of the polygon's points."""
    points = F.filter(polygon, lambda p: F.size(p) >= 2)
    xs = F.transform(points, lambda p: p[0])
    ys = F.transform(points, lambda p: p[1])
    given = F.struct(
        F.get(box, 0).alias("x1"), F.get(box, 1).alias("y1"),
        F.get(box, 2).alias("x2"), F.get(box, 3).alias("y2"),
    )
    hull = F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"),
        F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"),
    )
    return F.when(F.size(box) >= 4, given).when(F.size(points) > 0, hull)
