"""Text functions as column expressions: titles, DOIs, tokens, entities, links, hosts, flags."""

from __future__ import annotations

import html
import html.entities
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def accent_table() -> tuple[str, str]:
    """Lower-case letters of all scripts whose decomposition is a letter and combining marks, and those letters: é to e, й to и, ΐ to ι.
    Hangul syllables decompose into letters and are left to `same_title`."""
    letters = (chr(c) for c in (*range(0xC0, 0x3100), *range(0xA640, 0xAC00), *range(0xF900, 0x10000)))
    parts = ((c, unicodedata.normalize("NFD", c)) for c in letters if c.isalpha() and c == c.lower())
    pairs = [(c, d[0].lower()) for c, d in parts if d[0] != c and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents, whether letters are composed or followed by combining marks."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), *accent_table())


def same_title(text: Column) -> Column:
    """The Unicode title with a collation that takes canonically equal strings (composed and decomposed Hangul) for equal: a key of
    joins and groups."""
    return F.collate(title_unicode(text), "UNICODE")


def title_ascii(text: Column) -> Column:
    """Lower case without accents, everything but a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def first_words(text: Column, n: int) -> Column:
    """A prefix that holds at least n words of `title_ascii`, or the whole text where it has fewer: so many pieces between white space
    with an ASCII letter or digit each. Only it needs to be normalised if n words are all that is asked for."""
    head = F.regexp_extract(text, r"(?s)^(?:[^A-Za-z0-9]*+[A-Za-z0-9]\S*+\s){%d}" % n, 0)
    return F.when(head != "", head).otherwise(text)


def title_unicode(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def useful_tokens(norm: Column, stop: tuple[str, ...] = ("with", "from", "that", "this", "using", "based")) -> Column:
    return F.filter(F.split(norm, " "), lambda t: (F.length(t) >= 4) & ~t.isin(*stop))


def set_similarity(a: Column, b: Column) -> Column:
    """|A & B| / max(|A|, |B|) of token sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))).cast("double"))


def doi(raw: Column, keep_case: bool = False) -> Column:
    """The DOI without resolver, scheme and surrounding dots; null if nothing is left."""
    x = F.regexp_replace(F.trim(raw), r"(?i)^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")
    x = F.regexp_replace(x, r"^\.+|\.+$", "")
    return F.nullif(x if keep_case else F.lower(x), F.lit(""))


def has_doi(x: Column) -> Column:
    return F.coalesce(F.length(x) > 3, F.lit(False))


def squeeze(x: Column) -> Column:
    """Trimmed, white space squeezed; 'nan' and '' are null."""
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(~F.lower(x).isin("nan", "none", "<na>", ""), x)


def level(x: Column) -> Column:
    x = F.upper(F.trim(x))
    return F.when(x.isin("A*", "A-STAR", "ASTAR", "A STAR", "A+"), "A*").when(x == "A", "A").when(x.isin("A*+A", "A*/A", "A+A*"), "A*+A")


def country_code(x: Column, aliases: dict[str, str] | None = None) -> Column:
    """Two upper-case letters after aliases, else null. "NA" is a code like any other unless an alias says otherwise."""
    x = F.upper(F.trim(x))
    for a, b in (aliases or {"UK": "GB", "EL": "GR"}).items():
        x = F.when(x == a, b).otherwise(x)
    return F.when(x.rlike("^[A-Z]{2}$"), x)


def html_names() -> tuple[str, ...]:
    """All named entities of HTML 5 that end with a semicolon."""
    return tuple(sorted(n[:-1] for n in html.entities.html5 if n.endswith(";")))


def entities(x: Column, names: tuple[str, ...] | None = None) -> Column:
    """Named HTML entities as their characters (nbsp as a space), each once: what comes out is not read again. The table is one
    constant map, looked up where a text has an entity."""
    table = {n: " " if n == "nbsp" else html.unescape(f"&{n};") for n in names or html_names()}
    held = F.from_json(F.lit(json.dumps(table)), "map<string,string>")

    def repaired(piece):
        name = F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*);", 1)
        return F.when(name == "", piece).otherwise(F.coalesce(F.concat(F.try_element_at(held, name), F.substring(piece, F.length(name) + 3, F.length(piece))), piece))

    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(F.split(x, "(?=&[A-Za-z][A-Za-z0-9]*;)"), repaired), "")).otherwise(x)


def xml_safe(x: Column) -> Column:
    """HTML entities repaired, the five of XML kept."""
    return entities(x, tuple(n for n in html_names() if n not in ("quot", "amp", "lt", "gt", "apos", "QUOT", "AMP", "LT", "GT")))


def pdf_links(page: Column, url: Column, hosts: tuple[str, ...]) -> Column:
    """Distinct PDF links of a page, made absolute, on allowed hosts only, in their order."""
    found = F.array_distinct(F.transform(hrefs(page), lambda h: absolute(url, h)))
    pdf = lambda u: F.lower(u).rlike(r"\.pdf(?:[?#].*)?$|/pdf/") & host_allowed(host(u), hosts)
    return F.filter(found, pdf)


def links(x: Column) -> Column:
    """http links of a list separated by white space, ';' or '|'."""
    return F.filter(F.split(x, r"[|;\s]+"), lambda u: u.startswith("http"))


def hrefs(page: Column) -> Column:
    """Values of href attributes in either kind of quotes."""
    found = F.regexp_extract_all(page, F.lit(r"(?i)\bhref\s*=\s*(\"[^\"]*\"|'[^']*')"), F.lit(1))
    return F.transform(found, lambda h: F.substring(h, F.lit(2), F.length(h) - 2))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#:]+)", 1))


def host_allowed(h: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | (h == s) | h.endswith(f".{s}")
    return out


def absolute(base: Column, link: Column) -> Column:
    """A link relative to its page."""
    root = F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]+)", 1)
    here = F.regexp_extract(base, "^([a-zA-Z]+://[^?#]*/)", 1)
    return F.when(link.rlike("^[a-zA-Z]+://"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.when(F.length(here) > F.length(root), here).otherwise(F.concat(root, F.lit("/"))), link))


def short_id(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def truth(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y", "si", "sí"), F.lit(False))


def hits(x: Column, words: tuple[str, ...]) -> Column:
    """The words that x contains, in their order, joined by ';'."""
    return F.array_join(F.filter(F.array(*map(F.lit, words)), lambda t: F.contains(F.lower(x), t)), ";")


def has_any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.contains(F.lower(x), F.lit(w)), F.lit(False))
    return out


def parsed(doc: Column) -> Column:
    """A JSON document read once, of any shape; null where it is none."""
    return F.try_parse_json(doc)


def content(doc: Column, key: str, root: str = "$", kind: str = "string") -> Column:
    """root.key of a parsed document, or root.key.value where that is an object."""
    return F.coalesce(F.try_variant_get(doc, f"{root}.{key}.value", kind), F.try_variant_get(doc, f"{root}.{key}", kind))


def first_doi(found: Column) -> Column:
    return F.get(F.filter(found, lambda u: F.contains(u, F.lit("doi.org/"))), F.lit(0))


def first_arxiv(found: Column) -> Column:
    hit = F.get(F.filter(found, lambda u: F.contains(u, F.lit("arxiv.org/"))), F.lit(0))
    return F.nullif(F.regexp_replace(F.regexp_extract(hit, r"arxiv\.org/(?:abs|pdf)/([^\s?#]+)", 1), r"(v[0-9]+)?(\.pdf)?$", ""), F.lit(""))


def accepted(decision: Column, venue: Column) -> Column:
    """Words of rejection win, then words of acceptance, else a venue decides."""
    d = F.lower(F.coalesce(decision, F.lit("")))
    return F.when(d.rlike("reject|withdraw|desk"), False).when(d.rlike("accept|oral|poster|spotlight"), True).otherwise(F.coalesce(venue != "", F.lit(False)))


def route(prefix: Column, title: Column, shared: str, rules: dict[str, tuple[str, ...]], default: str) -> Column:
    """The venue of a record of a stream that several share, by tokens of the title; null for other streams."""
    out = None
    for venue, words in rules.items():
        cond = has_any(title, words)
        out = F.when(cond, venue) if out is None else out.when(cond, venue)
    return F.when(prefix == shared, out.otherwise(default) if out is not None else F.lit(default))
