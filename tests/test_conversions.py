"""Whole conversions of small files, with the triples written out."""

import json

import pytest

from loomtable import convert, convert_group, parse_metadata
from loomtable.plans.metadata import MetadataError, MetadataParser
from loomtable.sources.discovery import MemoryResolver

BASE = "http://example.org/"
URL = BASE + "countries.csv"
XSD = "http://www.w3.org/2001/XMLSchema#"
COUNTRIES = 'countryCode,latitude,longitude,name\nAD,42.5,1.6,Andorra\nAE,23.4,53.8,"United Arab Emirates"\nAF,33.9,67.7,Afghanistan\n'
ROWS = [("AD", "42.5", "1.6", "Andorra"), ("AE", "23.4", "53.8", "United Arab Emirates"), ("AF", "33.9", "67.7", "Afghanistan")]
NAMES = ("countryCode", "latitude", "longitude", "name")


@pytest.fixture
def run(spark, tmp_path):
    def go(meta, text=COUNTRIES, url=URL, standard=False, bom=True):
        path = tmp_path / "t.csv"
        path.write_text(("﻿" if bom else "") + text, encoding="utf-8")
        group = parse_metadata(meta, BASE + "metadata.json")
        done = convert_group(spark, group, base=BASE + "metadata.json", resolver=MemoryResolver({}, {url: str(path)}), standard=standard)
        return done, {tuple(r) for r in done.triples().collect()}

    return go


def lit(s, p, o, kind=XSD + "string", lang=None, s_kind="iri"):
    return (s, s_kind, p if "://" in p else f"{URL}#{p}", o, "literal", None if lang else kind, lang)


def schema(columns, **more):
    return {"url": URL, "tableSchema": {"columns": columns} | more}


def test_header_supplies_columns(run):
    _, got = run({"url": URL})
    assert got == {lit(f"_:s0_{k + 1}", n, v, s_kind="bnode") for k, row in enumerate(ROWS) for n, v in zip(NAMES, row, strict=True)}


def test_decimals_keep_their_scale(run):
    kinds = {"latitude": XSD + "decimal", "longitude": XSD + "decimal"}
    _, got = run(schema([{"name": n} | ({"datatype": "decimal"} if n in kinds else {}) for n in NAMES], aboutUrl=BASE + "countries.csv/{_row}"))
    assert got == {lit(f"{URL}/{k + 1}", n, v, kinds.get(n, XSD + "string")) for k, row in enumerate(ROWS) for n, v in zip(NAMES, row, strict=True)}


def test_subject_of_table_and_of_column(run):
    meta = schema([{"name": "countryCode", "aboutUrl": BASE + "countries/{_row}"}, {"name": "latitude"}, {"name": "longitude"}, {"name": "name"}])
    _, got = run(meta | {"aboutUrl": BASE + "countries/{countryCode}"})
    want = {lit(f"{BASE}countries/{k + 1}", "countryCode", r[0]) for k, r in enumerate(ROWS)}
    assert got == want | {lit(f"{BASE}countries/{r[0]}", n, v) for r in ROWS for n, v in zip(NAMES[1:], r[1:], strict=True)}


def test_predicate_names_are_positional_and_languages(run):
    _, got = run(schema([{"name": "cc", "propertyUrl": URL + "/def/countryCode"}, {"suppressOutput": True}, {"suppressOutput": True}, {"name": "name", "lang": "en"}], aboutUrl=BASE + "countries/{cc}"))
    assert got == {lit(f"{BASE}countries/{r[0]}", URL + "/def/countryCode", r[0]) for r in ROWS} | {lit(f"{BASE}countries/{r[0]}", "name", r[3], lang="en") for r in ROWS}


def test_virtual_column_with_default(run):
    columns = [{"name": "cc"}, {"suppressOutput": True}, {"suppressOutput": True}, {"suppressOutput": True}, {"virtual": True, "default": "foo", "propertyUrl": URL + "/def/test"}]
    _, got = run(schema(columns, aboutUrl=BASE + "countries/{cc}"))
    assert got == {lit(f"{BASE}countries/{r[0]}", "cc", r[0]) for r in ROWS} | {lit(f"{BASE}countries/{r[0]}", URL + "/def/test", "foo") for r in ROWS}


def test_empty_cell_gives_nothing(run):
    _, got = run({"url": URL}, "name,age,email\nFred,23,\n")
    assert got == {lit("_:s0_1", "name", "Fred", s_kind="bnode"), lit("_:s0_1", "age", "23", s_kind="bnode")}


def test_spaces_in_iris_are_encoded(run):
    _, got = run({"url": URL, "aboutUrl": BASE + "data/{Subject}"}, "Subject,String Value\nfoo bar,foo bar\n")
    assert got == {lit(BASE + "data/foo%20bar", "Subject", "foo bar"), lit(BASE + "data/foo%20bar", "String%20Value", "foo bar")}


def test_dates(run):
    columns = [{"name": "Thing"}, {"name": "iso", "datatype": {"base": "datetime", "format": "yyyy-MM-ddTHH:mm:ssX"}}, {"name": "us", "datatype": {"base": "date", "format": "M/d/yyyy"}}, {"name": "uk", "datatype": {"base": "date", "format": "d/M/yyyy"}}]
    _, got = run(schema(columns, aboutUrl=BASE + "{Thing}"), "Thing,a,b,c\nx,2015-03-15T15:02:37+0900,3/22/2015,22/3/2015\ny,never,3/22/2015,1/1/2015\n")
    assert lit(BASE + "x", "iso", "2015-03-15T15:02:37+09", XSD + "dateTime") in got
    assert {lit(BASE + "x", c, "2015-03-22", XSD + "date") for c in ("us", "uk")} <= got
    assert not any(t[0] == BASE + "y" and t[2].endswith("iso") for t in got)


def test_ragged_rows_quotes_and_line_ends(run):
    done, got = run({"url": URL, "aboutUrl": BASE + "{_row}/{_sourceRow}"}, 'a,b\n1,"two ""2""\nlines"\n3\n4,5,6\n')
    assert got == {lit(BASE + "1/2", "a", "1"), lit(BASE + "1/2", "b", 'two "2"\nlines'), lit(BASE + "2/3", "a", "3"), lit(BASE + "3/4", "a", "4"), lit(BASE + "3/4", "b", "5"), lit(BASE + "3/4", "_col.3", "6")}


def test_short_records_and_unbound_templates_are_errors(run):
    done, got = run({"url": URL, "tableSchema": {"aboutUrl": BASE + "{a}", "columns": [{"name": "a"}, {"name": "b"}, {"name": "c", "propertyUrl": BASE + "p/{b}"}]}}, "a,b,c\n1,2,3\n,5,6\n7\n8,,9\n")
    assert got == {lit(BASE + "1", "a", "1"), lit(BASE + "1", "b", "2"), lit(BASE + "1", BASE + "p/2", "3"), lit(BASE + "7", "a", "7"), lit(BASE + "8", "a", "8")}
    told = {(r["row"], r["column"], r["kind"], r["value"]) for r in done.errors().collect()}
    assert told == {("2", "b", "aboutUrl", "5"), ("2", "c", "aboutUrl", "6"), ("4", "c", "propertyUrl", "9"), ("4", None, "fields", "1")}


def test_no_header(run):
    _, got = run({"url": URL, "aboutUrl": BASE + "{_row}", "dialect": {"header": False}}, "1,2\n3,4\n")
    assert got == {lit(BASE + "1", "_col.1", "1"), lit(BASE + "1", "_col.2", "2"), lit(BASE + "2", "_col.1", "3"), lit(BASE + "2", "_col.2", "4")}


@pytest.mark.parametrize("dialect,text", [({"delimiter": "\t", "skipColumns": 1, "headerRowCount": 2}, "z\ta\tb\nz\tc\td\nz\t1\t2\n"), ({"commentPrefix": "//", "trim": "true"}, "a,b\n// no\n 1 , 2\n"), ({"quoteChar": None}, "a,b\n1,2\n")])
def test_dialects(run, dialect, text):
    _, got = run({"url": URL, "aboutUrl": BASE + "{a}", "dialect": dialect}, text)
    assert got == {lit(BASE + "1", "a", "1"), lit(BASE + "1", "b", "2")}


def test_standard_mode_and_notes(run):
    done, got = run(schema([{"name": n} for n in NAMES], aboutUrl=BASE + "c/{countryCode}") | {"dc:title": "Countries", "notes": ["n"]}, standard=True)
    csvw = "http://www.w3.org/ns/csvw#"
    assert ("_:t0", "bnode", csvw + "url", URL, "iri", None, None) in got
    assert ("_:r0_2", "bnode", csvw + "url", URL + "#row=3", "iri", None, None) in got
    assert ("_:r0_2", "bnode", csvw + "describes", BASE + "c/AE", "iri", None, None) in got
    assert ("_:t0", "bnode", "http://purl.org/dc/terms/title", "Countries", "literal", XSD + "string", None) in got
    assert ("_:t0", "bnode", csvw + "note", "n", "literal", XSD + "string", None) in got


def test_discovery(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a\n1\n")
    meta = json.dumps({"url": "x.csv", "aboutUrl": BASE + "{a}"})
    for place in ("x.csv-metadata.json", "csv-metadata.json"):
        resolver = MemoryResolver({BASE + place: meta}, {BASE + "x.csv": str(path)})
        assert convert(spark, BASE + "x.csv", resolver=resolver, standard=False).triples().first()["s"] == BASE + "1"
    site = MemoryResolver({BASE + ".well-known/csvm": "meta/{+url}.json\nm.json", BASE + "m.json": meta}, {BASE + "x.csv": str(path)})
    assert convert(spark, BASE + "x.csv", resolver=site, standard=False).triples().first()["s"] == BASE + "1"
    bare = MemoryResolver({}, {BASE + "x.csv": str(path)})
    assert convert(spark, BASE + "x.csv", resolver=bare, standard=False).triples().first()["s"] == "_:s0_1"
    assert convert(spark, BASE + "m.json", resolver=site, standard=False).triples().count() == 1


def test_validation_of_a_group(spark, tmp_path):
    (tmp_path / "p").write_text("id\n1\n2\n2\n")
    (tmp_path / "c").write_text("ref,n\n1,5\n3,\n2,x\n")
    tables = [
        {"url": "p", "tableSchema": {"columns": [{"name": "id"}], "primaryKey": "id"}},
        {"url": "c", "tableSchema": {"columns": [{"name": "ref"}, {"name": "n", "datatype": {"base": "integer", "minimum": 6}, "required": True}], "foreignKeys": [{"columnReference": "ref", "reference": {"resource": "p", "columnReference": "id"}}]}},
    ]
    done = convert_group(spark, parse_metadata({"tables": tables}, BASE), base=BASE, resolver=MemoryResolver({}, {BASE + n: str(tmp_path / n) for n in "pc"}))
    got = {(r["table"][-1], r["row"], r["column"], r["kind"], r["value"]) for r in done.errors().collect()}
    assert got == {("p", None, "id", "primaryKey", "2"), ("c", "1", "n", "minInclusive", "5"), ("c", "2", "n", "required", ""), ("c", "3", "n", "datatype", "x"), ("c", "2", "ref", "foreignKey", "3")}


@pytest.mark.parametrize("bad", ["[1]", "{}", '{"tables": []}', '{"url": "x", "@type": "TableGroup"}', '{"@id": "_:b", "url": "x"}', '{"url": "x", "suppressOutput": "yes"}', '{"url": "x", "tableSchema": {"columns": [{"name": "a"}, {"name": "a"}]}}', '{"@context": {"@vocab": "x"}, "url": "x"}'])
def test_fatal_descriptions(bad):
    with pytest.raises(MetadataError):
        parse_metadata(bad, BASE)


def test_warnings_and_names():
    group = parse_metadata({"@context": ["http://www.w3.org/ns/csvw", {"@language": "en"}], "url": "x", "lang": "not a tag", "tableSchema": {"columns": [{"name": "_a", "titles": "A b"}, {"titles": {"en": ["T"], "de": "D"}}, {"datatype": "nothing"}]}}, BASE)
    assert [c.name for c in group.tables[0].schema.columns] == ["A%20b", "T", "_col.3"]
    assert len(group.warnings) == 3


def test_unknown_properties_are_warned_of():
    meta = {"@context": "http://www.w3.org/ns/csvw", "tables": [{"url": URL, "colour": 1, "dc:title": "t", "http://x.org/p": 2, "tableSchema": {"columns": [{"name": "a", "titel": "A", "separator": ";"}], "keys": []}}], "sorted": True}
    group = parse_metadata(meta, BASE)
    assert sorted(w.split("'")[1] for w in group.warnings) == ["colour", "keys", "sorted", "titel"]
    assert group.tables[0].common == {"dc:title": "t", "http://x.org/p": 2}


def test_a_reference_may_be_a_link():
    meta = schema([{"name": "a"}], foreignKeys=[{"columnReference": "a", "reference": "ref.json"}])
    parser = MetadataParser(BASE, {BASE + "ref.json": {"@context": "x", "resource": "other.csv", "columnReference": "b"}}.get)
    (key,) = parser.parse(meta).tables[0].schema.foreign_keys
    assert (key.columns, key.resource) == (("a",), BASE + "other.csv") and not parser.warnings
    with pytest.raises(MetadataError):
        MetadataParser(BASE).parse(meta)
