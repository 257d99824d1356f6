"""Text preparation: HTML to text, quality, attachment names, chunks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EXTRACTABLE = "pdf doc ppt xls docx pptx xlsx rtf txt csv odt ods odp html htm".split()
SNIFFED_TAGS = "<p <div <br <html <body <h1 <h2 <li <table".split()
AFTER = "br div section article tr header footer nav aside".split()
AROUND = "p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre".split()
BEFORE = "li dt dd".split()
LINE_TAGS = "p div section article header footer nav aside blockquote pre table ul li ol dl dt dd tr td th".split()  # and h with a digit
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}


#: What ends a line of a page: a tag whose name begins like one of these, a line break, a line feed.
LINE_BREAK = rf"(?i:</?(?:{'|'.join(LINE_TAGS)}|h[0-9])[^>]*>|<br/?>)|\n"


# The characters that are white space in Unicode.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without the white space of any kind around it."""
    return F.trim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~text.rlike(f"[^{WHITE}]"), F.lit(True))


def is_html(text: Column) -> Column:
    """At least ten characters, and in the first thousand an angle bracket of each kind and the start of a known tag."""
    head = F.lower(F.substring(text, 1, 1000))
    tag = reduce(lambda a, b: a | b, [head.contains(t) for t in SNIFFED_TAGS])
    return F.coalesce((F.length(text) >= 10) & head.contains("<") & head.contains(">") & tag, F.lit(False))


def html_to_text(html: Column) -> Column:
    """The text of a page: wiki metadata, scripts, styles and comments dropped, blocks on lines of their own.

    White space collapses; runs of line breaks to two, other runs to one blank. Named and decimal entities of common use
    are decoded; malformed mark-up is read tag by tag.
    """
    drop = r"(?is)<!--.*?-->|<(script|style|title|ac:parameter|ac:image|ac:emoticon)\b[^>]*>.*?</\1\s*>|</?ri:[^>]*>|<(?:ac:parameter|ac:image|ac:emoticon)\b[^>]*/>"
    t = F.regexp_replace(html, drop, "")
    t = F.regexp_replace(t, r"\s+", " ")
    mark = "\u0001"
    around, after, before = ("|".join(x) for x in (AROUND, AFTER, BEFORE))
    t = F.regexp_replace(t, rf"(?i)</?(?:{around})(?:\s[^>]*)?/?>", mark)
    t = F.regexp_replace(t, rf"(?i)</(?:{after})\s*>|<br\s*/?>", mark)
    t = F.regexp_replace(t, rf"(?i)<(?:{before})(?:\s[^>]*)?>", mark)
    t = F.regexp_replace(t, r"(?i)</t[dh]\s*>", " ")
    t = F.regexp_replace(t, r"<[!/?a-zA-Z][^>]*>", "")
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(t, f"[\\u00a0 ]*{mark}[\\u00a0 ]*", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "\n{2,}", "\n\n"), "[\\u00a0 ]{2,}", " ")
    return F.regexp_replace(t, "^[ \n]+|[ \n]+$", "")


def clean(text: Column) -> Column:
    """HTML cleaned to text, other texts as they are."""
    return F.when(is_html(text), html_to_text(text)).otherwise(text)


def _share(text: Column, others: str) -> Column:
    """The share of characters left when those of a class are taken away."""
    return F.length(F.regexp_replace(text, others, "")) / F.length(text)


def quality_reason(text: Column) -> Column:
    """The first rule by which a text is taken for an image without text; null if it is text."""
    n = F.length(text)
    return (
        F.when(is_blank(text), "blank")
        .when(n < 50, "too_short")
        .when(_share(text, r"(?U)[^\p{L}\p{Nd}]") < 0.05, "low_alphanumeric")
        .when((n > 100) & (_share(text, "[^ ]") < 0.02), "insufficient_spacing")
        .when(_share(text, r"[\x00-\x1F\x7F-\x9F]") < 0.80, "control_characters")
        .when(_share(text, r"(?U)[\p{L}\p{Nd}\s]") > 0.40, "special_characters")
    )


def extension(name: Column) -> Column:
    """Lower case after the last dot; empty if there is none, or nothing before or after it."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"^.+\.([^.]+)$", 1))


def is_extractable(ext: Column) -> Column:
    return F.coalesce(F.lower(strip(ext)).isin(EXTRACTABLE), F.lit(False))


def char_chunks(text: Column, size: int, overlap: int, chars_per_token: int = 4) -> Column:
    """``array<struct<text, start, end>>``: windows that step by ``size`` and reach back by ``overlap`` (in tokens)."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size > 0 and 0 <= overlap < size")
    step, back, n = size * chars_per_token, overlap * chars_per_token, F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    window = lambda at: (F.greatest(F.lit(0), at - back), F.least(n, at + step))
    return F.transform(starts, lambda at: F.struct(F.substr(text, window(at)[0] + 1, window(at)[1] - window(at)[0]).alias("text"), window(at)[0].alias("start"), window(at)[1].alias("end")))


def token_chunks(text: Column, size: int, overlap: int, token: str = r"\w+|[^\w\s]") -> Column:
    """``array<struct<text, start, end, tokens>>``: windows of ``size`` tokens, ``size - overlap`` apart, cut at tokens' starts.

    The first window starts at 0, the last ends with the text; a text without tokens is one window.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size > 0 and 0 <= overlap < size")
    windows = F.pandas_udf(lambda texts: texts.map(lambda t: _token_windows(t or "", size, overlap, token)), "array<struct<start:int,end:int,tokens:int>>")
    return F.transform(windows(text), lambda s: F.struct(F.substr(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["tokens"].alias("tokens")))


def _token_windows(text: str, size: int, overlap: int, token: str) -> list[dict]:
    """A running sum over tokens in an array expression costs the square of their number, so this is a batch function."""
    at = [m.span() for m in re.finditer(token, text)]
    if not at:
        return [{"start": 0, "end": len(text), "tokens": 0}] if text else []
    out = []
    for i in range(0, len(at), size - overlap):
        last = i + size >= len(at)
        out.append({"start": 0 if i == 0 else at[i][0], "end": len(text) if last else at[i + size - 1][1], "tokens": min(size, len(at) - i)})
        if last:
            break
    return out


def has_non_bmp(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\x{10000}-\\x{10FFFF}]"), F.lit(False))


def normal_label(label: Column) -> Column:
    """Camel case split, lower case, runs of other characters as one underscore, none at the ends."""
    t = F.regexp_replace(label, "([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def file_name(name: Column, ext: str, longest: int = 255) -> Column:
    """A report's file name: characters that file systems refuse become underscores, cut to the longest allowed."""
    return F.concat(F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), 1, longest - len(ext)), F.lit(ext))


def tsv_safe(text: Column) -> Column:
    return F.translate(text, "\t\n\r", "   ")
