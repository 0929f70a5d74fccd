"""Prefixes and terms of the recommendations, and the expansion of compact IRIs."""

from __future__ import annotations

import re

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
CSVW = "http://www.w3.org/ns/csvw#"

#: The prefixes of the public initial context.
PREFIXES = {
    "as": "https://www.w3.org/ns/activitystreams#",
    "cc": "http://creativecommons.org/ns#",
    "csvw": CSVW,
    "ctag": "http://commontag.org/ns#",
    "dc": "http://purl.org/dc/terms/",
    "dc11": "http://purl.org/dc/elements/1.1/",
    "dcat": "http://www.w3.org/ns/dcat#",
    "dcterms": "http://purl.org/dc/terms/",
    "dctypes": "http://purl.org/dc/dcmitype/",
    "dqv": "http://www.w3.org/ns/dqv#",
    "duv": "https://www.w3.org/TR/vocab-duv#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "gr": "http://purl.org/goodrelations/v1#",
    "grddl": "http://www.w3.org/2003/g/data-view#",
    "ical": "http://www.w3.org/2002/12/cal/icaltzd#",
    "ldp": "http://www.w3.org/ns/ldp#",
    "ma": "http://www.w3.org/ns/ma-ont#",
    "oa": "http://www.w3.org/ns/oa#",
    "og": "http://ogp.me/ns#",
    "org": "http://www.w3.org/ns/org#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "prov": "http://www.w3.org/ns/prov#",
    "qb": "http://purl.org/linked-data/cube#",
    "rdf": RDF,
    "rdfa": "http://www.w3.org/ns/rdfa#",
    "rdfs": RDFS,
    "rev": "http://purl.org/stuff/rev#",
    "rif": "http://www.w3.org/2007/rif#",
    "rr": "http://www.w3.org/ns/r2rml#",
    "schema": "http://schema.org/",
    "sd": "http://www.w3.org/ns/sparql-service-description#",
    "sioc": "http://rdfs.org/sioc/ns#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "skosxl": "http://www.w3.org/2008/05/skos-xl#",
    "v": "http://rdf.data-vocabulary.org/#",
    "vcard": "http://www.w3.org/2006/vcard/ns#",
    "void": "http://rdfs.org/ns/void#",
    "wdr": "http://www.w3.org/2007/05/powder#",
    "wrds": "http://www.w3.org/2007/05/powder-s#",
    "xhv": "http://www.w3.org/1999/xhtml/vocab#",
    "xml": "http://www.w3.org/XML/1998/namespace",
    "xsd": XSD,
}

#: Terms for the kinds of descriptions, all in the csvw namespace.
TERMS = {t: CSVW + t for t in ("TableGroup", "Table", "Schema", "Column", "Row", "Cell", "Dialect", "Template", "Datatype", "ForeignKey", "NumericFormat", "Direction")} | {"describedby": "http://www.w3.org/2007/05/powder-s#describedby", "license": "http://www.w3.org/1999/xhtml/vocab#license", "role": "http://www.w3.org/1999/xhtml/vocab#role"}

ABSOLUTE = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*:")


def expand_curie(text: str) -> str | None:
    """The IRI of a term, of `prefix:name` with a known prefix, or None."""
    if text in TERMS:
        return TERMS[text]
    prefix, colon, name = text.partition(":")
    if colon and not name.startswith("//") and prefix in PREFIXES:
        return PREFIXES[prefix] + name
    return None


def expand_url(text: str) -> str:
    """The IRI that a property name or a type stands for: a datatype, a term, a compact IRI, or itself if it has a scheme."""
    from ..functions.datatypes import REGISTRY

    if (iri := expand_curie(text)) is not None:
        return iri
    if text in REGISTRY:
        return REGISTRY[text].iri
    if ABSOLUTE.match(text):
        return text
    raise ValueError(f"{text!r} is neither a term, nor a compact IRI, nor an IRI")
