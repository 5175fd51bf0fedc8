"""Rules that classify, name and route: ladders over addresses, ids, texts and classes, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import constants as C
from corpusmill.functions import text as T


def ladder(rules: list[tuple[Column, str]], rest: str | None) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda below, rule: F.when(rule[0], rule[1]).otherwise(below), reversed(rules), F.lit(rest))


def renamed(c: Column, names: dict[str, str], default: Column | str | None = None) -> Column:
    """The name of a value; one without a name keeps itself or takes ``default``."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), c if default is None else F.lit(default))


def host_class(url: Column) -> Column:
    """Publisher of an address: the first of the ladder that it contains; 'gov.uk (other)' for the rest of gov.uk."""
    rules = [(url.contains(h), h if h != "gov.uk" else "gov.uk (other)") for h in C.HOST_LADDER]
    return ladder([*rules, (F.coalesce(url, F.lit("")) == "", "(no source_url)")], "other publishers")


def category_name(c: Column) -> Column:
    return renamed(c, C.CATEGORY_NAMES)


def source_group(c: Column) -> Column:
    return renamed(F.coalesce(c, F.lit("")), C.SOURCE_GROUPS, "other")


def class_group(c: Column, fine: bool = True) -> Column:
    """primary, secondary, guidance and the like; the coarse form has one group for all that isn't legislation."""
    rules = [(c == "PRIMARY_LEGISLATION", "primary_legislation"), (c == "SECONDARY_LEGISLATION", "secondary_legislation")]
    if fine:
        rules += [(c == "OFFICIAL_GOVERNMENT_GUIDANCE", "official_guidance"), (c.isin("REGULATOR_GUIDANCE", "REGULATOR_INTERPRETATION"), "regulator_technical")]
    return ladder(rules, "guidance_workflow")


def gold_tag(essential: Column, wrong_regime: Column, gold: Column) -> Column:
    """essential before wrong regime before supporting before none; missing flags don't hold."""
    return ladder([(F.coalesce(x, F.lit(False)), name) for x, name in ((essential, "essential_gold"), (wrong_regime, "wrong_regime"), (gold, "supporting_gold"))], "non_gold")


def document_role(document_id: Column) -> Column:
    """struct(corpus_role, authority_class, legal_regime) by a document id's type and number."""
    commencing = document_id.isin(*C.COMMENCEMENT_DOCUMENTS)
    return F.struct(
        F.when(commencing, "PA2023_COMMENCEMENT").otherwise("CITED_SUPPORTING_LEGISLATION").alias("corpus_role"),
        F.when(F.substring_index(document_id, "_", 1).isin(*C.PRIMARY_TYPES), "PRIMARY_LEGISLATION").otherwise("SECONDARY_LEGISLATION").alias("authority_class"),
        F.when(commencing, "PA2023").alias("legal_regime"),
    )


def parent_type(node: Column, citation: Column) -> Column:
    """schedule_paragraph, schedule, regulation or section."""
    schedule = node.contains("schedule-")
    return ladder([(schedule & node.contains("paragraph"), "schedule_paragraph"), (schedule, "schedule"), (citation.contains("reg "), "regulation")], "section")


def canonical_doc_id(kind: Column, year: Column, number: Column) -> Column:
    """UKPGA_2023_54 of ukpga, 2023 and 54; an unknown type in capitals."""
    known = F.create_map(*(F.lit(x) for kv in C.DOCUMENT_TYPES.items() for x in kv))
    return F.concat_ws("_", F.coalesce(F.try_element_at(known, F.lower(kind)), F.upper(kind)), year, number)


def eid_suffix(eid: Column, document_id: Column) -> Column:
    """What follows the document's own slug in an element id, without dashes in front; the id itself if it lacks the slug."""
    slug = F.replace(F.lower(document_id), F.lit("_"), F.lit("-"))
    at = F.instr(eid, slug)
    return F.when(at == 0, eid).otherwise(F.regexp_replace(F.substring(eid, at + F.length(slug), F.length(eid)), "^-+", ""))


def provision_citation(title: Column, unit: Column, suffix: Column, number: Column) -> Column:
    """'<title> Sch 2 para 3', '<title> Sch 2' or '<title> s 45'."""
    schedule, para = F.regexp_extract(suffix, r"^schedule-(\w+)", 1), F.regexp_extract(suffix, r"^schedule-\w+-paragraph-(\w+)", 1)
    return F.when(para != "", F.concat(title, F.lit(" Sch "), schedule, F.lit(" para "), para)).when(schedule != "", F.concat(title, F.lit(" Sch "), schedule)).otherwise(F.concat(title, F.lit(" "), unit, F.lit(" "), F.coalesce(number, F.lit(""))))


def segment_citation(title: Column, node: Column, kind: Column, number: Column) -> Column:
    """A top provision's citation; the node's id says what it is, the type only where the id doesn't."""
    schedule = F.regexp_extract(node, "__schedule-([0-9]+[A-Za-z]?)-paragraph-", 1)
    label = F.when(schedule != "", F.concat(F.lit("Sch "), schedule, F.lit(" para"))).when(node.contains("__schedule-") & ~node.contains("-paragraph-"), "Sch").when(node.contains("__regulation-"), "reg").otherwise(renamed(kind, {"section": "s", "regulation": "reg", "schedule": "Sch"}))
    raw = F.trim(F.coalesce(number, F.lit("")))
    bare = F.coalesce(F.nullif(F.regexp_extract(raw, "([A-Za-z]?[0-9]+[A-Za-z]?)", 1), F.lit("")), F.regexp_replace(raw, r"\.+$", ""))
    return F.concat_ws(" ", title, label, bare)


def document_citation(document_id: Column, provision: Column, titles: dict[str, str] | None = None) -> Column:
    base = renamed(document_id, titles, F.replace(document_id, F.lit("_"), F.lit(" "))) if titles else F.replace(document_id, F.lit("_"), F.lit(" "))
    unit = renamed(F.substring_index(document_id, "_", 1), C.UNIT_SIGNS, "s")
    return F.when(F.coalesce(provision, F.lit("")) == "", base).otherwise(F.concat_ws(" ", base, unit, provision))


def window(text: Column, start: Column, end: Column, width: int = 140) -> Column:
    """The text from ``width`` characters before start to as many behind end, both counted from 0."""
    low = F.greatest(start - width, F.lit(0))
    return F.when(start.isNull(), "").otherwise(F.substring(F.coalesce(text, F.lit("")), (low + 1).cast("int"), (F.coalesce(end, start) + width - low).cast("int")))


def after_match(context: Column, matched: Column, width: int = 90) -> Column:
    """The ``width`` characters behind the first occurrence of ``matched``; nothing without one."""
    at = F.instr(context, matched)
    return F.when((at > 0) & (matched != ""), F.substring(context, at + F.length(matched), F.lit(width))).otherwise("")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def url_key(url: Column) -> Column:
    """By which addresses are compared: without fragment and last slashes, in lower case."""
    return F.lower(F.regexp_replace(without_fragment(url), "/+$", ""))


def joined_url(base: Column, href: Column) -> Column:
    """href as seen from base, by the rules of relative references, with dot segments removed."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"(\?[^#]*)", 1)
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    own = F.regexp_extract(href, r"^([^?#]*)", 1)
    raw = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), own))
    parts = F.slice(F.split(raw, "/"), 2, 1 << 20)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    ends_in_dots = F.element_at(parts, -1).isin(".", "..")
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_in_dots & (F.size(kept) > 0), "/").otherwise(""))
    return (
        F.when(href == "", without_fragment(base)).when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href))
        .when(own == "", F.concat(root, path, F.when(href.startswith("#"), query).otherwise(""), tail)).otherwise(F.concat(root, clean, tail))
    )


def link_class(url: Column) -> Column:
    """What a link leads to, by host, path and file ending."""
    host, path = url_host(url), url_path(url)
    assets = host == "assets.publishing.service.gov.uk"
    files = [(assets & path.endswith(f".{e}"), f"GOVUK_{e.upper()}_ATTACHMENT") for e in ("pdf", "odt", "docx", "xlsx")]
    sections = [("/guidance/", "GUIDANCE"), ("/government/publications/", "PUBLICATION"), ("/government/collections/", "COLLECTION"), ("/government/organisations/", "ORGANISATION")]
    pages = [((host == "www.gov.uk") & path.startswith(p), f"GOVUK_{n}") for p, n in sections]
    return ladder(
        [(host.endswith("legislation.gov.uk"), "LEGISLATION"), *files, (assets, "GOVUK_ASSET"), (host == "submit.forms.service.gov.uk", "GOVUK_FORM"), *pages, (host == "www.gov.uk", "GOVUK_PAGE"), (host.endswith("gov.uk"), "OTHER_GOVUK_SERVICE"), (host.contains("ico.org.uk"), "ICO_INTERNAL")],
        "EXTERNAL",
    )


def effect_class(text: Column) -> Column:
    return ladder([(F.coalesce(text, F.lit("")).rlike(p), n) for n, p in C.EFFECTS], "LEGAL_EFFECT_OTHER")


def annotation_class(text: Column) -> Column:
    return ladder([(F.coalesce(text, F.lit("")).rlike(p), n) for n, p in C.ANNOTATIONS], "OTHER_ANNOTATION")


def document_status(text: Column) -> Column:
    low = F.lower(T.clean_ws(F.coalesce(text, F.lit(""))))
    return F.when(low.contains("this guidance was withdrawn") | low.contains("[withdrawn]"), "WITHDRAWN").otherwise("CURRENT_OR_UNMARKED")


def review_tag(decision: Column, old: Column) -> Column:
    """The tag of a reviewer's decision; KEEP and KEEP_RECHUNK clear a tag, no decision leaves it."""
    tags = F.create_map(*(F.lit(x) for kv in C.REVIEW_TAGS.items() for x in kv))
    return F.when(decision.isNull(), old).otherwise(F.try_element_at(tags, decision))


def normalized_lines(text: Column) -> Column:
    """Lines with single blanks, stripped; runs of empty lines leave one, none at either end."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t\f\x0B]+", " ")))
    kept = F.filter(lines, lambda x, i: (x != "") | (F.coalesce(F.get(lines, i - 1), F.lit("")) != ""))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")


def dated_notes(text: Column) -> Column:
    """Dates such as '24 February 2025' in an update history."""
    return F.regexp_extract_all(text, F.lit(r"\b(\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4})\b"), F.lit(1))


def file_name(c: Column, longest: int = 180, default: str = "file") -> Column:
    """A name without characters that file systems refuse, runs of them one underscore, the ending kept."""
    s = F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"\s+", " "), F.lit(" ._"))
    return F.when(s == "", default).otherwise(F.substring(s, 1, longest))


def enriched_text(citation: Column, title: Column, summary: Column, authority: Column, regime: Column, text: Column) -> Column:
    """What a reranker reads: the parts with a stop and a blank between them, nulls empty."""
    return F.concat_ws(". ", *(F.coalesce(c, F.lit("")) for c in (citation, title, summary, authority, regime, text)))


def as_text(c: Column) -> Column:
    """A list's values with blanks between them, null as nothing."""
    return F.coalesce(F.array_join(c, " "), F.lit(""))


def keywords(topics: Column, concepts: Column, stage: Column, intents: Column, heading_path: Column) -> Column:
    """The keyword column of the lexical index."""
    return F.concat_ws(" ", *(F.nullif(as_text(c), F.lit("")) for c in (topics, concepts, stage, intents, heading_path)))


def expansion_gate(query: Column, expanded: Column, colloquialisms: Column, always: bool = False) -> Column:
    """The expanded query where colloquial words were found (or ``always``) and it isn't empty; else the query."""
    use = F.lit(always) | (F.coalesce(F.size(colloquialisms), F.lit(0)) > 0)
    return F.when(use & (F.coalesce(expanded, F.lit("")) != ""), expanded).otherwise(query)
