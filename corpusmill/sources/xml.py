"""Legislation XML as rows of nodes: a table function that walks the tree with the standard library's parser."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# Structural elements of both markups and the type they stand for.
NODE_TYPES = {
    "part": "part", "chapter": "chapter", "section": "section", "subsection": "subsection", "paragraph": "paragraph", "subparagraph": "subparagraph", "article": "article", "schedule": "schedule", "hcontainer": "container",
    "Part": "part", "Chapter": "chapter", "P1": "section", "P2": "subsection", "P3": "paragraph", "P4": "subparagraph", "Schedule": "schedule", "P1group": "group",
}
NUMBERS, HEADINGS = frozenset(("num", "Pnumber", "Number")), frozenset(("heading", "Title"))


def _name(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _words(element: ET.Element) -> str:
    return " ".join("".join(element.itertext()).split())


def walk(document_id: str, xml: str | None):
    """(node_id, parent_node_id, node_type, number, heading, eid, depth, ordinal, path_index, text) of each structural node, parents first.

    A node without an id attribute is named by its type and number, or its place. XML that can't be parsed has no nodes.
    """
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return
    stack, ordinal = [(root, None, 0, ())], 0
    while stack:
        element, parent, depth, path = stack.pop()
        kind = NODE_TYPES.get(_name(element))
        if kind:
            ordinal += 1
            number = next((_words(c) for c in element if _name(c) in NUMBERS), None)
            heading = next((_words(c) for c in element if _name(c) in HEADINGS), None)
            eid = element.get("eId") or element.get("id")
            own = f"{document_id}__{eid or f'{kind}-{(number or str(ordinal)).strip(" .()")}'}"
            yield own, parent, kind, number, heading, eid, depth, ordinal, list(path), _words(element)
            parent, depth = own, depth + 1
        children = list(element)
        stack.extend((c, parent, depth, (*path, i)) for i, c in reversed(list(enumerate(children))))


_SCHEMA = StructType()
for _field in ("node_id", "parent_node_id", "node_type", "number", "heading", "eid"):
    _SCHEMA = _SCHEMA.add(_field, StringType())
_SCHEMA = _SCHEMA.add("depth", IntegerType()).add("ordinal", IntegerType()).add("path_index", ArrayType(IntegerType())).add("text", StringType())


@udtf(returnType=_SCHEMA)
class LegalNodes:
    def eval(self, document_id: str, xml: str):
        yield from walk(document_id, xml)


def nodes(documents: DataFrame) -> DataFrame:
    """document_id and the nodes of each document (document_id, xml)."""
    documents.sparkSession.udtf.register("legal_nodes", LegalNodes)
    documents.select("document_id", "xml").createOrReplaceTempView("_xml_documents")
    return documents.sparkSession.sql("SELECT document_id, n.* FROM _xml_documents, LATERAL legal_nodes(document_id, xml) n")
