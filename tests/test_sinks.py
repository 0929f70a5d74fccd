"""Text that sinks must keep, and compiled plans that must stay small."""

import re

from pyspark.sql import functions as F

from loomtable.operators.triples import SCHEMA
from loomtable.operators.validate import _decimal_order, _duration_order
from loomtable.plans import catalogue
from loomtable.sources import sinks

TEXTS = ["C:\\new", 'a"b', "tab\tq", "\\\\", "\\", "x\\\\ny\\n", "é😀", "", '"', "end\\", "line\nend\r", "see <http://www.w3.org/2001/XMLSchema#date> here", "\\ " * 9000]


def graph(spark):
    rows = [(f"http://e.org/{k}", "iri", "http://e.org/p", t, "literal", "http://www.w3.org/2001/XMLSchema#string", None) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, ("_:b", "bnode", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "_:c.d", "bnode", None, None), ("_:b", "bnode", "http://e.org/p", "x", "literal", None, "de-AT")], SCHEMA)


def test_ntriples_round_trip(spark, tmp_path):
    path = str(tmp_path / "t.nt")
    sinks.write_ntriples(graph(spark), path)
    assert sorted(map(str, sinks.read_ntriples(spark, path).collect())) == sorted(map(str, graph(spark).collect()))
    assert sinks.unread_ntriples(spark, path).count() == 0


def test_lines_that_are_no_triples_are_told(spark, tmp_path):
    path = str(tmp_path / "bad.nt")
    spark.createDataFrame([(r'<a> <b> "\u00e9 \U0001F600 \\u00e9" .',), ("# remark",), ("",), ('<a> <b> "x" "y" .',), ("<a> <b> .",)], "value string").write.text(path)
    assert [r["o"] for r in sinks.read_ntriples(spark, path).collect()] == ["é 😀 \\u00e9"]
    assert sorted(r["value"] for r in sinks.unread_ntriples(spark, path).collect()) == ['<a> <b> "x" "y" .', "<a> <b> ."]


def test_turtle_leaves_text_alone(spark):
    lines = [r["value"] for r in sinks.turtle(graph(spark)).collect()]
    assert '<http://e.org/11> <http://e.org/p> "see <http://www.w3.org/2001/XMLSchema#date> here" .' in lines
    assert "_:b rdf:type _:c.d ." in lines


def test_limits_of_any_size(spark):
    def order(f, x, limit):
        return spark.range(1).select(f(F.lit(x), limit)).first()[0]

    cases = [("0.00000000004", "0", 1), ("1" * 32, "5", 1), ("-" + "1" * 400, "5", -1), ("-0.0", "0", 0), ("00012.50", "12.5", 0), ("100000000000000000001", "100000000000000000000", 1), ("-100000000000000000001", "-100000000000000000000", -1), ("0.1", "0.10000000000000000001", -1), ("-3", "-4", 1)]
    assert [order(_decimal_order, x, y) for x, y, _ in cases] == [w for _, _, w in cases]
    cases = [("P10D", "P2D", 1), ("PT24H", "P1D", 0), ("P1M", "P30D", 0), ("P1M", "P27D", 1), ("-P1Y", "P0D", -1), ("P1Y2M", "P14M", 0)]
    assert [order(_duration_order, x, y) for x, y, _ in cases] == [w for _, _, w in cases]


def test_generated_methods_can_be_compiled(spark):
    """The JVM compiles no method beyond 8,000 bytes: each step's code stays below."""
    for name in ("minimal_lineitem", "validate_range"):
        df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        told = df._sc._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told)]
        assert sizes and max(sizes) < 8000, (name, sizes)
