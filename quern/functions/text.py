"""Normalising, tokenising and showing text, as native expressions.

Case folding is of ASCII only. A document becomes runs of CJK characters, which give their characters and then their
pairs, and runs of other word characters; stop words go and leave no gap in positions. A query becomes ASCII words and single CJK characters,
stop words included.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# CJK ideographs of documents and of queries, and separators beyond ASCII.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"
QUERY_CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
RUN = f"[{CJK}]+|[^{CJK}{SEPARATORS}]+"
QUERY, STRICT_QUERY = f"[a-z0-9]+|[{QUERY_CJK}]", "[a-z0-9]+"
TOKEN_BYTES, PAIR_BYTES, SNIPPET = 127, 8, 120

# Tags that begin a line, by their start and by their end.
START_TAGS = "p|br|h[1-6]|div|li|tr|td|th|hr|section|article|header|footer"
END_TAGS = "p|h[1-6]|div|li|tr|td|th|hr|section|article|header|footer"
#: Noncharacters that stand for source white space and for line breaks until tags are gone.
BLANK, BREAK = "\uffff", "\ufffe"
SCRIPTS = r"(?is)<script(?:>| [^>]*>).*?(?:</script>|\z)|<style(?:>| [^>]*>).*?(?:</style>|\z)"
#: Steps from HTML to text with entities: pattern and what takes its place.
HTML_STEPS = [
    (SCRIPTS, ""),
    (r"[\n\r\t]", BLANK),
    (f"(?i)<(?:{START_TAGS})(?: [^<>]*|>)", BREAK),
    (f"(?i)</(?:{END_TAGS})[^<>]*", BREAK),
    (f"<[^<>{BREAK}]*", ""),
    (">", ""),
]
SQUEEZE = [(f"([ \n{BREAK}]){BLANK}+", "$1"), (f"{BLANK}+", " "), (BREAK, "\n")]
# Named entities.
ENTITIES = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "apos;": "'", "nbsp;": " "}
NUMERIC = "^#(?:[xX]0*([0-9a-fA-F]{1,2})|0*([0-9]{1,3}));"


def stopwords() -> list[str]:
    """The default stop words."""
    lines = (Path(__file__).parent / "stopwords.txt").read_text(encoding="utf-8").splitlines()
    return [x for x in lines if x and not x.startswith("#")]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def head_bytes(text: Column, most: int) -> Column:
    """As many whole characters as fit ``most`` bytes."""
    fits = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda n: F.octet_length(F.substr(text, F.lit(1), n)) <= most))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substr(text, F.lit(1), fits))


def doc_tokens(text: Column, stop: Sequence[str] | None = None, max_tokens: int | None = None) -> Column:
    """Index terms of a text in order; null gives none."""
    words = list(stopwords() if stop is None else stop)
    runs = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(RUN), F.lit(0))

    def parts(run: Column) -> Column:
        pairs = F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        cjk = F.concat(F.regexp_extract_all(run, F.lit("(?s)."), F.lit(0)), F.filter(pairs, lambda x: F.octet_length(x) < PAIR_BYTES))
        return F.when(run.rlike(f"^[{CJK}]"), cjk).otherwise(F.array(head_bytes(run, TOKEN_BYTES)))

    out = F.flatten(F.transform(runs, parts))
    out = F.filter(out, lambda t: ~t.isin(words)) if words else out
    return F.slice(out, 1, max_tokens) if max_tokens else out


def query_terms(text: Column, strict: bool = False, max_terms: int | None = None) -> Column:
    """Keywords of a query in order; ``strict``: of ASCII only; ``max_terms``: the first so many."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(STRICT_QUERY if strict else QUERY), F.lit(0))
    out = F.transform(found, lambda t: F.substr(t, F.lit(1), F.lit(TOKEN_BYTES)))
    return F.slice(out, 1, max_terms) if max_terms else out


def clean_ascii(text: Column) -> Column:
    """Lower case, and a space for every character that is not an ASCII letter or digit."""
    return F.regexp_replace(ascii_lower(text), "[^a-z0-9]", " ")


def trimmed(text: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.regexp_replace(text, r"^[\t-\r ]+|[\t-\r ]+$", "")


def decode_entities(text: Column) -> Column:
    """Named and numeric entities (1 to 255) replaced in one pass; others stay."""
    parts = F.split(text, "&")

    def decoded(part: Column) -> Column:
        hexa, number = F.regexp_extract(part, NUMERIC, 1), F.regexp_extract(part, NUMERIC, 2)
        code = F.when(hexa != "", F.conv(F.when(hexa != "", hexa), 16, 10).cast("int")).when(number != "", F.when(number != "", number).cast("int")).otherwise(0)
        out = F.when((code > 0) & (code < 256), F.concat(F.chr(code.cast("long")), F.regexp_replace(part, NUMERIC, ""))).otherwise(F.concat(F.lit("&"), part))
        for name, char in ENTITIES.items():
            out = F.when(F.startswith(part, F.lit(name)), F.concat(F.lit(char), F.substr(part, F.lit(len(name) + 1), F.length(part)))).otherwise(out)
        return out

    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def html_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and tags gone, line breaks for block tags, source white space squeezed."""
    out = html
    for pattern, new in HTML_STEPS:
        out = F.regexp_replace(out, pattern, new)
    out = decode_entities(out)
    for pattern, new in SQUEEZE:
        out = F.regexp_replace(out, pattern, new)
    return out


def file_type(name: Column) -> Column:
    """txt, html, pdf, docx or unknown, by the ending in either case."""
    low = ascii_lower(name)
    return F.when(low.endswith(".txt"), "txt").when(low.endswith(".htm") | low.endswith(".html"), "html").when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").otherwise("unknown")


def snippet(text: Column, size: int = SNIPPET) -> Column:
    return F.concat(F.substr(text, F.lit(1), F.lit(size)), F.lit("..."))


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def highlight_pattern(query: str) -> str | None:
    """A pattern of the query's words, longest first, in either case of ASCII letters; None without words."""
    words = sorted(dict.fromkeys(query.split()), key=len, reverse=True)
    plain = lambda w: "".join(c if c.isalnum() or not c.isascii() else f"\\{c}" for c in w)
    return "(?i)(" + "|".join(map(plain, words)) + ")" if words else None


def highlight(text: Column, query: str) -> Column:
    """HTML-escaped text with the query's words in <mark>."""
    pattern = highlight_pattern(query)
    return F.regexp_replace(html_escape(text), pattern, "<mark>$1</mark>") if pattern else html_escape(text)


def djb2(text: Column, buckets: int = 256) -> Column:
    """Bucket of a string by the hash that takes times 33 plus each byte, modulo 2**32."""
    codes = F.transform(F.filter(F.split(F.hex(F.encode(text, "utf-8")), "(?<=\\G..)"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda a, x: (a * 33 + x) % (1 << 32)) % buckets
