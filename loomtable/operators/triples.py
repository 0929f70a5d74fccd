"""Tables as triples: one projection of structs and one explode a table, no shuffle and no Python on the data path."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions.datatypes import REGISTRY
from ..functions.formats import Formatted, compile_format, keeps_text
from ..functions.template import compile_template, encoded, expressions
from ..plans import model
from ..plans.context import CSVW, RDF, XSD

#: Columns of every triple; o_datatype and o_lang are null except for literals.
COLUMNS = ("s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang")
SCHEMA = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"
IRI, BNODE, LITERAL = "iri", "bnode", "literal"


@dataclass(frozen=True)
class Node:
    value: Column
    kind: str


def triple(s: Node, p: Column | str, o: Node, datatype: Column | str | None = None, lang: str | None = None) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(s.value.alias("s"), F.lit(s.kind).alias("s_kind"), text(p).alias("p"), o.value.cast("string").alias("o"), F.lit(o.kind).alias("o_kind"), text(datatype).alias("o_datatype"), text(lang).alias("o_lang"))


def iri(value: Column | str) -> Node:
    return Node(value if isinstance(value, Column) else F.lit(value), IRI)


@dataclass
class CompiledColumn:
    column: model.Column
    props: dict[str, Any]
    #: normalised text of a cell, or null
    value: Column
    #: its canonical text under the format, null where the format doesn't admit it
    text: Column
    #: array of texts where the column has a separator
    values: Column | None
    subject: Node
    predicate: Column


#: Names of columns that compiling adds to a frame.
STAGED = "__loom_"


class TableCompiler:
    """Compiles one table's description against a frame of raw strings.

    The frame has a column for each described column that isn't virtual, in order, and `_row` and
    `_source_row` where templates, blank subjects or the annotated structure need row numbers; columns
    named in `aside` belong to neither. Every normalised cell, canonical text, encoded variable and
    filled template is worked out once, as a named column of `staged`, in steps that each read the one
    before; triples and errors only refer to them.
    """

    def __init__(self, group: model.TableGroup, table: model.Table, frame: DataFrame, index: int = 0, string_datatype: bool = True, aside: tuple[str, ...] = ()):
        self.group, self.table, self.frame, self.index, self.string_datatype = group, table, frame, index, string_datatype
        self.dialect = model.dialect_of(group, table)
        raw = [c for c in frame.columns if c not in ("_row", "_source_row", *aside)]
        columns = table.schema.columns
        if columns is None:  # the header supplies the names
            columns = [model.Column(n) for n in raw]
        columns = list(columns)
        real = [c for c in columns if not c.virtual]
        for k in range(len(real), len(raw)):  # fields beyond the description
            columns.insert(k, model.Column(f"_col.{k + 1}"))
        self.columns = columns
        self._steps: list[dict[str, Column]] = [{}, {}, {}, {}]
        self.raw: dict[str, Column] = {}
        #: columns whose values have neither white space nor characters that an IRI would escape
        self._bare: set[str] = set()
        kinds = {f.name: f.dataType for f in frame.schema.fields}
        source = iter(raw)
        for c in columns:
            if not c.virtual:
                name = next(source, None)
                self.raw[c.name] = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name is not None else F.lit(None).cast("string")
                if name is not None and isinstance(kinds[name], T.IntegralType | T.DateType | T.BooleanType):
                    self._bare.add(c.name)
        self.compiled = [self._compile(k, c) for k, c in enumerate(columns)]

    # --- steps

    def _step(self, k: int, name: str, make: Callable[[], Column]) -> Column:
        """A named column of step k; steps refer to steps before them."""
        if name not in self._steps[k]:
            self._steps[k][name] = make()
        return F.col(STAGED + name)

    @property
    def staged(self) -> DataFrame:
        """The frame with what is worked out of it, a projection a step."""
        out = self.frame
        for step in self._steps:
            if step:
                out = out.select("*", *[x.alias(STAGED + name) for name, x in step.items()])
        return out

    # --- expressions

    def _cell(self, column: model.Column, props: dict[str, Any]) -> Column:
        if column.virtual:
            return cells.scalar_value(F.lit(props["default"] or None).cast("string"), props)
        return self._step(0, f"cell_{self.columns.index(column)}", lambda: cells.scalar_value(self.raw[column.name], props, bare=column.name in self._bare))

    def told(self, column: model.Column, props: dict[str, Any]) -> Formatted:
        """Validity and canonical text of a column's cells."""
        k = self.columns.index(column)
        made: list[Formatted] = []

        def once() -> Formatted:
            if not made:
                made.append(compile_format(self._cell(column, props), props["datatype"]))
            return made[0]

        return Formatted(self._step(1, f"valid_{k}", lambda: once().valid), self._step(1, f"canonical_{k}", lambda: once().text))

    def _text(self, column: model.Column, props: dict[str, Any]) -> Column:
        value = self._cell(column, props)
        return value if keeps_text(props["datatype"]) or props["separator"] else self.told(column, props).value

    def lookup(self, number: int, name: str):
        """Variables of a template in a given column, encoded: the numbers of rows and columns, or a cell's value."""

        def find(variable: str, form: str) -> Column:
            if variable == "_row":
                return F.col("_row").cast("string")
            if variable == "_sourceRow":
                return F.col("_source_row").cast("string")
            if variable == "_column":
                return F.lit(str(number + 1))
            if variable == "_sourceColumn":
                return F.lit(str(number + 1 + self.dialect.skip_columns))
            if variable == "_name":
                return encoded(F.lit(name), form)
            for k, c in enumerate(self.columns):
                if c.name == variable:
                    props = model.effective(self.group, self.table, c)
                    value = self._text(c, props)
                    if variable in self._bare and not props["default"] and keeps_text(props["datatype"]):
                        return value if "" in props["null"] else F.nullif(value, F.lit(""))
                    return encoded(value, form) if c.virtual else self._step(2, f"variable_{k}_{'safe' if form else 'encoded'}", lambda: encoded(value, form))
            raise ValueError(f"a template names the column {variable!r}, which the table lacks")

        return find

    def _template(self, template: str, number: int, name: str) -> Column:
        names = expressions(template)
        if not names:
            return compile_template(template, self.lookup(number, name), self.table.url)
        own = f"_{number}" if {"_column", "_sourceColumn", "_name"} & set(names) else ""
        place = self._places.setdefault((template, own), len(self._places))
        return self._step(3, f"iri_{place}", lambda: compile_template(template, self.lookup(number, name), self.table.url))

    @cached_property
    def _places(self) -> dict[tuple[str, str], int]:
        return {}

    def _compile(self, number: int, column: model.Column) -> CompiledColumn:
        props = model.effective(self.group, self.table, column)
        if props["aboutUrl"]:
            subject = iri(self._template(props["aboutUrl"], number, column.name))
        else:
            subject = self.row_subject
        if props["propertyUrl"]:
            predicate = self._template(props["propertyUrl"], number, column.name)
        else:
            predicate = F.lit(f"{self.table.url}#{column.name}".replace(" ", "%20"))
        values = None
        if props["separator"] is not None and not column.virtual:
            values = self._step(0, f"list_{number}", lambda: cells.list_value(self.raw[column.name], props))
        return CompiledColumn(column, props, self._cell(column, props), self._text(column, props), values, subject, predicate)

    @property
    def row_subject(self) -> Node:
        return Node(F.concat(F.lit(f"_:s{self.index}_"), F.col("_row").cast("string")), BNODE)

    @property
    def row_node(self) -> Node:
        return Node(F.concat(F.lit(f"_:r{self.index}_"), F.col("_row").cast("string")), BNODE)

    @property
    def table_node(self) -> Node:
        return iri(self.table.id) if self.table.id else Node(F.lit(f"_:t{self.index}"), BNODE)

    @property
    def emitted(self) -> list[CompiledColumn]:
        return [c for c in self.compiled if not c.column.suppress_output]

    def literal(self, c: CompiledColumn, value: Column | None = None) -> tuple[Column, str | None, str | None]:
        """Text, datatype IRI and language of a value (of the cell, if none is given); null text where the format doesn't admit it."""
        datatype: model.Datatype = c.props["datatype"]
        kind = datatype.id or REGISTRY[datatype.base].iri
        if kind == XSD + "string" and c.props["lang"]:
            return c.value if value is None else value, None, c.props["lang"]
        if value is None:
            text = c.text
        else:
            text = value if keeps_text(datatype) else compile_format(value, datatype).value
        if kind == XSD + "string" and not self.string_datatype:
            return text, None, None
        return text, kind, None

    # --- structs

    def cell_structs(self) -> tuple[list[Column], list[Column]]:
        """Triples of a row: structs, and arrays of structs (from lists)."""
        single: list[Column] = []
        many: list[Column] = []
        for number, c in enumerate(self.compiled):
            if c.column.suppress_output:
                continue
            if c.props["valueUrl"]:
                single.append(triple(c.subject, c.predicate, iri(self._template(c.props["valueUrl"], number, c.column.name))))
            elif c.values is not None and c.props["ordered"]:
                many.append(self._ordered(number, c))
            elif c.values is not None:
                many.append(F.transform(F.filter(c.values, lambda v: v.isNotNull()), self._element(c)))
            else:
                text, kind, lang = self.literal(c)
                single.append(triple(c.subject, c.predicate, Node(text, LITERAL), kind, lang))
        return single, many

    def _element(self, c: CompiledColumn):
        def one(v: Column) -> Column:
            text, kind, lang = self.literal(c, v)
            return triple(c.subject, c.predicate, Node(text, LITERAL), kind, lang)

        return one

    def _ordered(self, number: int, c: CompiledColumn) -> Column:
        """An rdf:List: its head is the object; every node has a first value and a rest."""
        kept = F.filter(c.values, lambda v: v.isNotNull())
        name = lambda k: F.concat(F.lit(f"_:l{self.index}_{number}_"), F.col("_row").cast("string"), F.lit("_"), k.cast("string"))
        nil = F.lit(RDF + "nil")
        last = F.size(kept) - 1

        def nodes(v: Column, k: Column) -> Column:
            text, kind, lang = self.literal(c, v)
            rest = F.when(k < last, name(k + 1)).otherwise(nil)
            tail = triple(Node(name(k), BNODE), RDF + "rest", Node(rest, BNODE))
            tail = tail.withField("o_kind", F.when(k < last, F.lit(BNODE)).otherwise(F.lit(IRI)))
            return F.array(triple(Node(name(k), BNODE), RDF + "first", Node(text, LITERAL), kind, lang), tail)

        head = triple(c.subject, c.predicate, Node(F.when(last >= 0, name(F.lit(0))).otherwise(nil), BNODE))
        head = head.withField("o_kind", F.when(last >= 0, F.lit(BNODE)).otherwise(F.lit(IRI)))
        return F.when(c.values.isNotNull(), F.concat(F.array(head), F.flatten(F.transform(kept, nodes))))

    def row_structs(self) -> list[Column]:
        """The annotated structure of a row, without what it describes."""
        r = self.row_node
        out = [
            triple(self.table_node, CSVW + "row", r),
            triple(r, RDF + "type", iri(CSVW + "Row")),
            triple(r, CSVW + "rownum", Node(F.col("_row"), LITERAL), XSD + "integer"),
            triple(r, CSVW + "url", iri(F.concat(F.lit(self.table.url + "#row="), F.col("_source_row").cast("string")))),
        ]
        for name in self.table.schema.row_titles:
            c = next(x for x in self.compiled if x.column.name == name)
            lang = c.props["lang"] if c.props["lang"] not in (None, "und") else None
            out.append(triple(r, CSVW + "title", Node(c.value, LITERAL), None if lang or not self.string_datatype else XSD + "string", lang))
        return out

    def described(self) -> Column:
        """One csvw:describes for each different subject of a row."""
        subjects = F.array_distinct(F.array(*[F.struct(c.subject.value.alias("v"), F.lit(c.subject.kind).alias("k")) for c in self.emitted]))
        return F.transform(subjects, lambda x: triple(self.row_node, CSVW + "describes", Node(x["v"], IRI)).withField("o_kind", x["k"]))

    def triples(self, standard: bool = False) -> DataFrame:
        """The table's triples; null subjects, predicates and objects give none."""
        single, many = self.cell_structs()
        if standard:
            single = self.row_structs() + single
            if self.emitted:
                many = [*many, self.described()]
        arrays = [F.array(*single)] if single else []
        arrays += [F.coalesce(m, F.array().cast(f"array<struct<{SCHEMA.replace(' string', ':string')}>>")) for m in many]
        if not arrays:
            return self.frame.sparkSession.createDataFrame([], SCHEMA)
        every = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
        out = self.staged.select(F.explode(every).alias("t")).select("t.*")
        return out.filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Set semantics: the only shuffle that making triples can need."""
    return triples.dropDuplicates(list(COLUMNS))


def pivot_back(triples: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Subjects as rows again: {column: predicate}; of several objects the least."""
    wanted = triples.filter(F.col("p").isin(*predicates.values()))
    return wanted.groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(c) for c, p in predicates.items()])
