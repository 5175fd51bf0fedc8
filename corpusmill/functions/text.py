"""Text, identifier and URL functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import constants as C


def stripped(c: Column) -> Column:
    """Without white space (line ends too) at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def clean(c: Column) -> Column:
    """Runs of blanks other than line ends become one space; ends are stripped."""
    return stripped(F.regexp_replace(c, r"[ \t\r\f\x0B]+", " "))


def clean_ws(c: Column) -> Column:
    """Every run of white space becomes one space; ends are stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def repaired(c: Column) -> Column:
    """Undoes line breaks and blanks that page layout left in sentences, in five steps whose order matters."""
    for pattern, new in ((r"(?U)(?<=\w)\n \n(?=\w)", " "), (r"[\t\r ]+", " "), (r"(?<=[a-z,;])\n(?=[a-z])", " "), (r"[  ]{2,}", " "), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, new)
    return stripped(c)


def content_hash(c: Column) -> Column:
    """SHA-1 of the text in lower case, stripped, with single spaces."""
    return F.sha1(F.regexp_replace(stripped(F.lower(c)), r"\s+", " "))


def est_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def est_tokens_by_words(c: Column) -> Column:
    return F.floor(F.size(F.regexp_extract_all(c, F.lit(r"((?U)\w+)"), F.lit(1))) * 1.3).cast("int")


def words(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def shingles(w: Column, n: int = 5) -> Column:
    """Distinct runs of n words, each joined by spaces; none for fewer words."""

    def of(v: Column) -> Column:
        return F.when(F.size(v) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.array_join(F.slice(v, i, n), " ")))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(w), of), 1)  # binds the words to a variable, so that they are split once


def content_words(c: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z][a-z\-]{2,})"), F.lit(1)))
    return F.array_except(found, F.array(*(F.lit(w) for w in sorted(C.GROUNDING_STOPWORDS))))


def grounding(summary: Column, text: Column) -> Column:
    """Share of the summary's content words that the text has; 0 without any."""
    s = content_words(summary)
    return F.when(F.size(s) == 0, 0.0).otherwise(F.size(F.array_intersect(s, content_words(text))) / F.size(s))


PLACEHOLDER = r"\[\[LINK_\d{4,}\]\]"


def placeholders(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({PLACEHOLDER})"), F.lit(1))


def without_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, PLACEHOLDER, "")


def safe_id(c: Column, longest: int = 220, default: str = "UNKNOWN") -> Column:
    s = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.when(s == "", default).otherwise(F.substring(s, 1, longest))


def dedupe_url(c: Column) -> Column:
    """Lower case, without fragment, last slash, scheme, www and the endings that name a representation."""
    u = F.regexp_replace(F.substring_index(F.lower(F.coalesce(c, F.lit(""))), "#", 1), "/+$", "")
    return F.regexp_replace(F.regexp_replace(u, r"^https?://(www\.)?", ""), r"/(data\.(akn|xml|htm|feed)|contents|made|introduction)$", "")


def domain(c: Column) -> Column:
    return F.regexp_extract(c, r"https?://(?:www\.)?([^/]+)", 1)


def locator_parts(c: Column) -> Column:
    """83B(5)(b) becomes [83B, 5, b]."""
    s = F.regexp_replace(stripped(F.coalesce(c, F.lit(""))), r"\.+$", "")
    head = F.regexp_extract(s, "^([0-9]+[A-Za-z]*)", 1)
    parts = F.concat(F.array(head), F.regexp_extract_all(s, F.lit(r"\(([^)]+)\)"), F.lit(1)))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def norm_locator(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")), F.lit(""))


def strip_number(c: Column) -> Column:
    last = F.regexp_extract(c, r"(?i)([0-9]+[A-Z]*|[IVXLC]+)\s*$", 1)
    return F.coalesce(F.nullif(last, F.lit("")), F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def ancestors(node: Column) -> Column:
    """Ids of a node's ancestors in its document, nearest first: the last dash-separated part is dropped again and again."""
    doc, path = F.substring_index(node, "__", 1), F.coalesce(F.try_element_at(F.split(node, "__", 2), F.lit(2)), F.lit(""))
    bits = F.split(path, "-")
    return F.when(F.size(bits) > 1, F.transform(F.sequence(F.size(bits) - 1, F.lit(1), F.lit(-1)), lambda k: F.concat(doc, F.lit("__"), F.array_join(F.slice(bits, 1, k), "-")))).otherwise(F.array().cast("array<string>"))


def with_aliases(c: Column) -> Column:
    """The query, followed by the full names of the instruments it abbreviates, unless it has them."""
    extra = F.array_compact(F.array(*(F.when(c.rlike(p) & ~F.lower(c).contains(full.lower()), F.lit(full)) for p, full in C.ALIASES)))
    return F.concat_ws(" ", c, extra)


def query_terms(c: Column) -> Column:
    """Terms of two characters or more, without stop words unless there is nothing else; original case and order."""
    terms = F.filter(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9][A-Za-z0-9\-']+)"), F.lit(1)), lambda t: F.length(t) > 1)
    content = F.filter(terms, lambda t: ~F.lower(t).isin(*sorted(C.QUERY_STOPWORDS)))
    return F.when(F.size(content) > 0, content).otherwise(terms)


def lane(authority: Column) -> Column:
    """legislation or other; a missing class is other."""
    return F.when(authority.isin(*C.LEGISLATION_CLASSES), "legislation").otherwise("other")


def weight_of(c: Column, weights: dict[str, float], default: float) -> Column:
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def authority_weight(c: Column) -> Column:
    return weight_of(c, C.AUTHORITY_WEIGHTS, C.DEFAULT_AUTHORITY_WEIGHT)


def jurisdiction_weight(c: Column) -> Column:
    return weight_of(c, C.JURISDICTION_WEIGHTS, C.DEFAULT_JURISDICTION_WEIGHT)


def token_band(n: Column) -> Column:
    bands = ((50, "0-50"), (100, "50-100"), (200, "100-200"), (400, "200-400"), (800, "400-800"), (1600, "800-1600"), (3000, "1600-3k"))
    return reduce(lambda rest, b: F.when(n < b[0], b[1]).otherwise(rest), reversed(bands), F.lit("3k+"))


def length_bin(n: Column) -> Column:
    return F.when(n < 100, "<100").when(n >= 800, "800+").otherwise(F.concat((F.floor(n / 100) * 100).cast("string"), F.lit("-"), (F.floor(n / 100) * 100 + 99).cast("string")))


def regime(c: Column) -> Column:
    """PCR2015 before PR2024 before PA2023, by what an id contains."""
    return F.when(c.contains("PCR2015") | c.contains("2015_102"), "PCR2015").when(c.contains("PR2024") | c.contains("2024_692"), "PR2024").when(c.contains("PA2023") | c.contains("2023_54"), "PA2023")


def ingest_route(url: Column) -> Column:
    return F.when(F.trim(F.coalesce(url, F.lit(""))).rlike(r"(?i)legislation\.gov\.uk/.*?/data\.(akn|xml)$|legislation\.gov\.uk/[a-z]+/\d{4}/[\w-]+/?$"), "LEGISLATION").otherwise("BLOCKS")


def drop_reason(text: Column, domain: Column | None = None, block_type: Column | None = None) -> Column:
    """Why a block is dropped: the first rule that matches, or null."""
    t = stripped(F.coalesce(text, F.lit("")))
    found = [F.when(t == "", "empty")] + [F.when(t.rlike(p), name) for name, p in C.UNIVERSAL_DROPS]
    if domain is not None:
        found += [F.when((domain == d) & t.rlike(p), name) for d, rules in C.DOMAIN_DROPS.items() for name, p in rules]
    heading = F.coalesce(block_type, F.lit("")).startswith("h") if block_type is not None else F.lit(False)
    thin = (F.length(t) < C.MIN_SUBSTANTIVE_CHARS) & ~heading & ~t.rlike(C.SUBSTANCE)
    return F.coalesce(*found, F.when(thin, "thin_no_substance"))


def predicted_classes(query: Column) -> Column:
    q = F.lower(F.coalesce(query, F.lit("")))
    hits = (F.when(reduce(lambda a, b: a | b, (q.contains(k) for k in keys)), F.lit(cls)) for cls, keys in C.CLASS_KEYWORDS.items())
    return F.array_compact(F.array(*hits))


def embedding_text(citation: Column, heading_path: Column, title: Column, text: Column) -> Column:
    """Citation, heading path and title on lines of their own, a blank line, the text without placeholders; empty parts are left out."""
    head = F.filter(F.array(citation, F.array_join(heading_path, " > "), title), lambda p: F.coalesce(p, F.lit("")) != "")
    return stripped(F.concat(F.array_join(head, "\n"), F.lit("\n\n"), without_placeholders(text)))
