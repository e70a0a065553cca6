"""Texts of others made safe to put into a note, and what a draft must hold to. Rules are fixed values, in this order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement). A note's reader must neither run nor fetch anything: links and embeds of notes and
# images, comments, code fences, inline queries, tags, headings and tasks at a line's start, scripts as link targets.
ESCAPES = [
    (r"\[(?=\[)|(?<=\[)\[", r"\\["),
    (r"!\[", r"!\\["),
    (r"%(?=%)|(?<=%)%", r"\\%"),
    (r"[`~](?=[`~]{2})|(?<=[`~])[`~](?=[`~])|(?<=[`~]{2})[`~]", r"\\$0"),
    (r"(?U)`(\s*\$?)=", r"\\`$1\\="),
    (r"<(?=[/!?%a-zA-Z])", "&lt;"),
    (r"(?mdU)^(\s*)#", r"$1\\#"),
    (r"(?mdU)^(\s*[-*+] )\[", r"$1\\["),
    (r"(?iU)\]\(\s*(javascript|data):", r"]\\($1:"),
]
# Addresses of sources in a text.
ADDRESSES = r"(?i)https?://\S+|\b10\.\d{4,9}/\S+|(?:arxiv(?:\.org)?[:/.\s]*(?:(?:abs|pdf)/)?|/(?:abs|pdf|papers)/)\d{2}(?:0[1-9]|1[0-2])\.\d{4,5}\S*|github\.com/[\w.-]+/[\w.-]+\S*"
# Fixed value: letters that stay as they are in an address.
PLAIN_IN_URL = r"[A-Za-z0-9_.~:/?#@!&=+,;%\-*']"


def sanitized(text: Column, one_line: bool = False) -> Column:
    """A text that renders, but neither runs nor fetches anything."""
    for pattern, put in ESCAPES:
        text = F.regexp_replace(text, pattern, put)
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) if one_line else text


def link_text(text: Column) -> Column:
    """One line that stays between the brackets of a link."""
    return sanitized(F.regexp_replace(text, r"([\\\[\]])", r"\\$1"), one_line=True)


def safe_url(url: Column) -> Column:
    """A web address with what would end a link percent-encoded, and any bare %; null for other addresses."""
    whole = F.regexp_replace(url, r"%(?![0-9A-Fa-f]{2})", "%25")
    letters = F.regexp_extract_all(whole, F.lit("(?s)."), F.lit(0))
    coded = F.transform(letters, lambda c: F.when(F.rlike(c, F.lit(PLAIN_IN_URL)), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))))
    return F.when(F.rlike(url, F.lit("^https?://")), F.array_join(coded, ""))


def printable(text: Column, mark: str, limit: int = 160) -> Column:
    """A line of at most `limit` characters without addresses of sources and without the mark by which a note's own lines are read.

    The cut comes last and takes an escape or an entity that it would halve with it, so that it opens nothing again.
    """
    clean = F.regexp_replace(F.regexp_replace(text, ADDRESSES, "<url>"), rf"(?i)(\Q{mark}\E):", "$1 :")
    out = sanitized(clean, one_line=True)
    # what may be half written at the end: backslashes, and an entity before its semicolon, one behind the other
    cut = F.regexp_replace(F.left(out, F.lit(limit)), r"(?U)(?:\\+|&[#\w]*)+$", "")
    return F.when(F.length(out) <= limit, out).otherwise(cut)


# Sentences in the polite register end so, but for verbs that end alike; what is quoted isn't the draft's.
POLITE = r"(?md)(?<![冷済覚醒励澄])(?:です|ます|でした|ました|ません|でしょう|ましょう|ください)(?:か|ね|よ)?(?=[。」）)]|\s*\[|\s*[(（]S|$)"
QUOTED, KANA, CJK = "「[^」]*」", "[぀-ヿ]", "[぀-ヿ一-鿿]"


def failed_gates(prose: Column, claims: Column, language: str, mark: str, no_evidence: str = "", framing: int = 120) -> Column:
    """Names of what a draft fails, in order: the paragraph that `mark` begins is the only one and the last (inference_place)
    and cites nothing (inference_cited); others cite a claim or an excerpt, say that there is no evidence, or are short and
    without a figure (uncited); there is a citation if there are claims (no_citation); the register is plain (polite, ja);
    no Japanese stands in another language's draft (japanese).
    """
    parts = F.filter(F.transform(F.split(prose, "\n\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    marked = lambda p: F.startswith(p, F.lit(mark))
    inferred, last = F.size(F.filter(parts, marked)), F.try_element_at(parts, F.lit(-1))
    placed = (inferred == 1) & F.coalesce(marked(last), F.lit(False))
    evidence = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.when(inferred > 0, 1).otherwise(0), F.lit(0)))
    grounded = lambda p: F.rlike(p, F.lit(r"\[\d+\]|\(S\d+\)")) | (p == no_evidence) | ((F.length(p) <= framing) & ~F.rlike(p, F.lit(r"(?U)\d")))
    script = {"en": CJK, "zh": KANA}.get(language)
    found = [
        F.when(~placed, F.lit("inference_place")).when(F.rlike(last, F.lit(r"\[\d+\]")), F.lit("inference_cited")),
        F.when(F.exists(evidence, lambda p: ~grounded(p)), F.lit("uncited")),
        F.when((claims > 0) & ~F.rlike(prose, F.lit(r"\[\d+\]")), F.lit("no_citation")),
        F.when(F.rlike(F.regexp_replace(prose, QUOTED, ""), F.lit(POLITE)), F.lit("polite")) if language == "ja" else F.lit(None).cast("string"),
        F.when(F.rlike(prose, F.lit(script)), F.lit("japanese")) if script else F.lit(None).cast("string"),
    ]
    return F.filter(F.array(*found), lambda g: g.isNotNull())
