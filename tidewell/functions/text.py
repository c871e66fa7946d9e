"""Text predicates and rewrites as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values: patterns that decide which texts count ----
TOKENS = [
    r"hf_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"sk-ant-[A-Za-z0-9_-]{20,}",
    r"sk-proj-[A-Za-z0-9_-]{20,}",
    r"sk-[A-Za-z0-9]{32,}",
    r"AKIA[0-9A-Z]{16}",
    r"ASIA[0-9A-Z]{16}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"(?:sk|rk)_live_[A-Za-z0-9]{20,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"npm_[A-Za-z0-9]{36}",
    r"shpat_[A-Za-z0-9]{32}",
    r"[0-9]{8,10}:[A-Za-z0-9_-]{35}",
    r"(?i:(?:aws_secret_access_key|secret_access_key)\s*[=:]\s*[A-Za-z0-9/+=]{40,})",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----(?s:.*?)-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----",
]
TOKEN_MARKS = ["hf_", "github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "sk-", "AKIA", "ASIA", "xox", "_live_", "AIza", "npm_", "shpat_", "eyJ", "-----BEGIN "]
TOKEN_FIRST = "[-0-9AaSsegrhnx]"
BLOCKED = [
    r"just a moment", r"attention required", r"verify(?:ing)? (?:that )?you(?:'| a)?re (?:a )?human", r"enable javascript and cookies",
    r"please enable (?:js|javascript|cookies)", r"checking your browser", r"are you a robot", r"\bcaptcha\b", r"access denied",
    r"ddos protection by", r"cf-browser-verification", r"performing security verification", r"checking if the site connection is secure",
]
SPONSOR = r"(?i)\bsponsor(?:ed|ship)?\b|\bpatrocin|\bpublieditorial\b"
JOB = r"(?i)\bclassifieds?\b|\bhiring\b|\bvaga(s)?\b|\bjob board\b"
GENERIC_ANCHOR = r"(?i)^(demo\.?|release notes?\.?|changelog|docs?|documentation|more info\.?|info|here|link|website|homepage|github|announcement|blog|details)$"
TRIGGER = r"view changes on github|view on github|view all(?: \d+)? changes?|show more|read more"
RELEASE_MARKS = [r"(?m)^\s*v?\d+\.\d+(?:\.\d+)?(?:[-\s].*)?$", r"(?i)what'?s changed|full changelog", r"(?i)by @[a-z0-9-]+ in #\d+", r"\(\s*#\d{3,}\s*\)"]
FRAME_START = [
    r"(?i)^published on [a-z]+\s+\d{1,2},\s+\d{4}, filed under [^.]*\.[^)]*\)\.?\s*",
    r"(?i)^pre-release\s+pre-release\s+immutable\s+release\.?\s+only release title and notes can be modified\.?\s*",
    r"(?i)^pre-release\s+immutable\s+release\.?\s+only release title and notes can be modified\.?\s*",
]
_SENTENCE = r"(?:^|(?<=[.!?])\s+|\n\s*)"
FRAME_END = [
    r"(?is)\bhere on [a-z0-9.-]+\.[a-z]{2,} i (?:talk|write|share|blog) about.*$",
    rf"(?i){_SENTENCE}share this post[^.!?]*$",
    rf"(?i){_SENTENCE}read next:?[^.!?]*$",
    rf"(?i){_SENTENCE}related (?:posts|articles|stories|reading)[^.!?]*$",
    rf"(?i){_SENTENCE}subscribe(?: to|:)? [^.!?]*$",
    rf"(?i){_SENTENCE}sign up(?: for| to|:)? [^.!?]*$",
    rf"(?i){_SENTENCE}©\s*\d{{4}}[^.!?]*\.?$",
    rf"(?i){_SENTENCE}all rights reserved\.?$",
]
SECTION_WORDS = r"(?i)\b(in brief|code (?:&|and) tools|tools|releases?|news|elsewhere|classifieds?|jobs?|community|quick (?:bytes|hits|links)|in other news|from (?:our )?sponsor|opinion|tutorials?|articles?)\b"
CJK = r"[㐀-䶿一-鿿぀-ヿ가-힯豈-﫿]"
STOP_WORDS = "the and for with that this from are was new via how using use can its into than has have will not você para com que dos das".split()


def _of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


# ---- folding ----
def _folder(form: str):
    @F.pandas_udf(StringType())
    def fold(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize(form, s.lower()) if not "̀" <= c <= "ͯ"))

    return fold


def fold(text: Column) -> Column:
    """X3, client form: canonical decomposition without combining marks."""
    return _folder("NFD")(_of(text))


def fold_compatible(text: Column) -> Column:
    """X3, server form: compatibility decomposition without combining marks."""
    return _folder("NFKD")(_of(text))


def slugify(text: Column) -> Column:
    """X7."""
    given = F.when(_of(text) == "", "untitled").otherwise(text)
    dashed = F.regexp_replace(F.regexp_replace(fold_compatible(given), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(dashed, 1, 80), F.lit("")), F.lit("untitled"))


def slugify_plain(text: Column) -> Column:
    """X7 for texts without accents: built-in functions alone."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(_of(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(dashed, 1, 80), F.lit("")), F.lit("untitled"))


# ---- measures and cuts ----
def content_hash(text: Column) -> Column:
    """X8."""
    return F.sha2(_of(text), 256)


def has_cjk(text: Column) -> Column:
    """X9."""
    return _of(text).rlike(CJK)


def cjk_ratio(text: Column) -> Column:
    """X9, AG26: the share of CJK characters, 0 for an empty text."""
    n = F.length(_of(text))
    return F.when(n > 0, F.regexp_count(text, F.lit(CJK)) / n).otherwise(F.lit(0.0))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(_of(text), r"\s+", " "))


def snippet(text: Column, size: int = 200) -> Column:
    """White space first, then the cut."""
    return F.substring(squeezed(text), 1, size)


def raw_snippet(blurb: Column, content: Column, size: int = 280) -> Column:
    """X11: the cut first."""
    return F.substring(F.coalesce(blurb, content, F.lit("")), 1, size)


def capped(html: Column, size: int = 2 << 20) -> Column:
    """X16."""
    return F.substring(html, 1, size)


def masked(key: Column) -> Column:
    """The ends of a key."""
    return F.when(F.length(key) > 8, F.concat(F.substring(key, 1, 4), F.lit("…"), F.substring(key, -4, 4))).otherwise(F.when(key.isNotNull() & (key != ""), "…"))


def redact(text: Column) -> Column:
    """Tokens become [REDACTED]; null stays null. Texts without any mark of a token skip the pattern, positions without a first character its branches."""
    marks = [F.contains(text, F.lit(m)) for m in TOKEN_MARKS]
    marked = reduce(or_, marks, text.rlike("[0-9]{8}:") | F.contains(F.lower(text), F.lit("secret_access_key")))
    return F.when(marked, F.regexp_replace(text, f"(?={TOKEN_FIRST})(?:{'|'.join(TOKENS)})", "[REDACTED]")).otherwise(text)


# ---- guards ----
def looks_like_html(text: Column) -> Column:
    """A tag with an attribute, or a closing tag."""
    return _of(text).rlike(r"(?i)<[a-z][\w-]*\s+[a-z][\w-]*\s*=|</[a-z][\w-]*\s*>")


def is_json_page(text: Column) -> Column:
    """FL20: the whole text parses to an object or array."""
    trimmed = F.trim(_of(text))
    return trimmed.rlike(r"^[\[{]") & F.try_parse_json(trimmed).isNotNull()


def is_json_like(text: Column) -> Column:
    """FL21: at least 40 characters of JSON, whole or cut off after a key."""
    trimmed = F.trim(_of(text))
    return (F.length(trimmed) >= 40) & trimmed.rlike(r"^[\[{]") & (F.try_parse_json(trimmed).isNotNull() | trimmed.rlike(r'"[^"\n]{1,80}"\s*:'))


def tolerant_json(text: Column) -> Column:
    """The text as JSON, else its first {…} block."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(_of(text), r"(?s)(\{.*\})", 1), F.lit(""))))


def is_blocked_page(title: Column, text: Column) -> Column:
    """FL17: a challenge page by its title and first 600 characters."""
    return F.concat(_of(title), F.lit("\n"), F.substring(_of(text), 1, 600)).rlike("(?i)" + "|".join(BLOCKED))


def is_error_page(title: Column, text: Column) -> Column:
    """FL18: a not-found or server error by its title, or by a short body."""
    error = r"(?i)\b(404|403|500|502|503)\b.*\b(error|not found|forbidden)\b|page not found|not found$|internal server error|bad gateway|service unavailable"
    return _of(title).rlike(error) | ((F.length(_of(text)) < 300) & _of(text).rlike(error))


def is_thin(text: Column, least: int = 50) -> Column:
    """FL19."""
    return F.length(F.trim(_of(text))) < least


def is_readable(text: Column) -> Column:
    """FL19."""
    return F.length(F.trim(_of(text))) >= 400


def starts_with_menu(text: Column) -> Column:
    """FL22: three or more separators in the first 120 characters, between short tokens."""
    parts = F.split(F.substring(_of(text), 1, 120), r"\s*(?:[•·|/]\s*)+")
    head = F.transform(F.slice(parts, 1, 4), lambda p: F.trim(p))
    short = F.forall(head, lambda t: (F.length(t) <= 24) & ~t.rlike("[:.]"))
    filled = F.forall(F.slice(head, 2, 3), lambda t: t != "")
    return (F.size(parts) >= 4) & short & filled


def is_sponsor(title: Column, section: Column, blurb: Column) -> Column:
    """FL24."""
    return F.concat_ws(" ", title, section, blurb).rlike(SPONSOR)


def is_job(section: Column) -> Column:
    """FL24."""
    return _of(section).rlike(JOB)


def is_real_item(title: Column, blurb: Column) -> Column:
    """FL25: a recovered item with a title of its own and a blurb."""
    title = F.trim(_of(title))
    return ~title.rlike(GENERIC_ANCHOR) & (F.length(F.trim(_of(blurb))) >= 30) & (F.length(title) >= 6)


def is_collection(external_links: Column, prose: Column, depth: Column, curated: Column) -> Column:
    """FL26."""
    return external_links.between(10, 60) & (prose < 1500) & (depth < 3) & ~curated


def needs_script(links: Column, chars: Column) -> Column:
    """FL29."""
    return (links < 5) | (chars < 500)


# ---- cleaning ----
def ends_truncated(text: Column) -> Column:
    """A button's words in the last 100 characters."""
    return F.substring(squeezed(text), -100, 100).rlike(f"(?i){TRIGGER}")


def without_trigger(text: Column) -> Column:
    """The text without a closing button, where that is a sentence or line of its own."""
    trimmed = F.regexp_replace(_of(text), r"^\s+|\s+$", "")
    return F.when(trimmed.rlike(rf"(?i){_SENTENCE}(?:{TRIGGER})[.!]?\s*$"), F.regexp_replace(F.regexp_replace(trimmed, rf"(?i){_SENTENCE}(?:{TRIGGER})[.!]?\s*$", ""), r"\s+$", "")).otherwise(text)


def _first_pattern_removed(text: Column, patterns: list[str], trim: str) -> Column:
    out = text
    for pattern in reversed(patterns):
        out = F.when(text.rlike(pattern) & (F.trim(F.regexp_extract(text, f"({pattern})", 1)) != ""), F.regexp_replace(F.regexp_replace(text, pattern, ""), trim, "")).otherwise(out)
    return out


def without_frame(text: Column) -> Column:
    """At most three patterns off the start and three off the end, one a pass."""
    # a fold over three passes keeps the expression small
    passes = F.array(F.lit(1), F.lit(2), F.lit(3))
    cut = F.aggregate(passes, _of(text), lambda acc, _: _first_pattern_removed(acc, FRAME_START, r"^\s+"))
    cut = F.aggregate(passes, cut, lambda acc, _: _first_pattern_removed(acc, FRAME_END, r"\s+$"))
    return F.regexp_replace(cut, r"^\s+|\s+$", "")


def sane_cleaning(original: Column, cleaned: Column) -> Column:
    """Neither emptied, nor too short, nor longer than the original allows."""
    n, m = F.length(F.trim(_of(original))), F.length(F.trim(_of(cleaned)))
    least = F.floor(F.least(F.greatest(F.lit(200.0), n * 0.15), n * 0.6))
    return (m > 0) & (m >= least) & (m <= n * 1.2 + 500)


def without_spans(text: Column, spans: Column) -> Column:
    """A struct of the text without the spans, and whether the cut was applied, rejected or found nothing."""
    wanted = F.array_distinct(F.filter(F.coalesce(spans, F.array().cast("array<string>")), lambda s: F.length(F.trim(s)) >= 4))
    ordered = F.slice(F.transform(F.array_sort(F.transform(wanted, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda x: x["s"]), 1, 60)
    found = F.filter(ordered, lambda s: F.contains(_of(text), s))
    removed = F.aggregate(ordered, _of(text), lambda acc, s: F.replace(acc, s, F.lit(" ")))
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(removed, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    applied, ok = F.size(found) > 0, sane_cleaning(text, tidy)
    return F.struct(
        F.when(applied & ok, tidy).otherwise(_of(text)).alias("text"),
        F.when(applied & ok, F.size(found)).otherwise(0).alias("applied"),
        (F.size(ordered) - F.size(found)).alias("not_found"),
        (applied & ~ok).alias("rejected"),
    )


def is_release_note(text: Column) -> Column:
    """X22."""
    marks = F.lit(False)
    for pattern in RELEASE_MARKS:
        marks = marks | _of(text).rlike(pattern)
    return (F.length(F.trim(_of(text))) >= 50) & marks


def section_title(line: Column) -> Column:
    """The label that a heading, a bold line or a known short line gives, else null."""
    s = F.trim(_of(line))
    heading, bold = F.regexp_extract(s, r"^#{1,6}\s+(.+?)\s*#*$", 1), F.regexp_extract(s, r"^\*\*(.{2,48}?):?\*\*$", 1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[*_>#`]", ""), r"^[^\p{L}\p{N}]+", ""), r"[:\s]+$", ""))
    known = ~bare.rlike(r"[.!?…]$") & F.length(bare).between(2, 40) & bare.rlike(SECTION_WORDS)
    label = F.when(heading != "", F.trim(F.replace(heading, F.lit("**"), F.lit("")))).when(bold != "", F.trim(bold)).when(known, bare)
    return F.when((s != "") & (F.length(s) <= 60) & ~s.rlike(r"(?i)https?:|\]\("), label)


# ---- search terms ----
def query_terms(query: Column, most: int = 24) -> Column:
    """Lower-cased letter or digit runs of two or more, the first `most`; repeats stay."""
    return F.slice(F.filter(F.split(F.lower(_of(query)), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2), 1, most)


def match_expression(query: Column) -> Column:
    """The quoted OR expression, null without terms."""
    terms = F.transform(query_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.when(F.size(terms) > 0, F.array_join(terms, " OR "))


def spec_words(text: Column) -> Column:
    """OR11: distinct alphanumeric words of three or more that are no stop words."""
    words = F.filter(F.split(F.lower(_of(text)), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(words)
