"""Section definitions, and their compilation to a parse schema and Column expressions.

A definition names where rows sit in an envelope and which tags feed each output column. Compiling it on the
driver gives (a) a ``from_xml`` schema holding only the tags used, every tag an array so that one and many
occurrences look alike, and (b) one select per document. A new section needs only a new definition.

Paths are written with ``/`` because tag names may contain dots; ``@NAME`` is an attribute.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from saldo.functions import scalars as S
from saldo.functions.transforms import NUMERIC, transform_for
from saldo.sources.responses import once

CORRUPT = "_corrupt_record"
# Where collection rows and messages sit below the envelope.
COLLECTION = "BODY/DATA/COLLECTION"
MESSAGE_PATHS = ("BODY/IMPORTDATA/REQUESTDATA/TALLYMESSAGE", "BODY/DATA/TALLYMESSAGE")
MESSAGES = "messages"


@dataclass(frozen=True)
class Field:
    name: str
    transform: str = "string"
    sources: tuple[str, ...] = ()
    default: object = None
    type: str | None = None


@dataclass(frozen=True)
class Child:
    name: str
    paths: tuple[str, ...]
    fields: tuple[Field, ...]
    children: tuple["Child", ...] = ()
    required: str | None = None


@dataclass(frozen=True)
class Section:
    name: str
    fields: tuple[Field, ...]
    mode: str = "list"  # list | single | indexed_rows
    rows: tuple[str, ...] = ()
    index: Mapping[str, str] = field(default_factory=dict)
    length: str | None = None
    children: tuple[Child, ...] = ()
    required: str | None = None
    finish: Callable[[DataFrame], DataFrame] | None = None
    keep: Callable[[], Column] | None = None

    def __post_init__(self):
        def check(fields, children):
            for f in fields:
                transform_for(f.transform)
            for c in children:
                check(c.fields, c.children)

        check(self.fields, self.children)
        if self.mode not in ("list", "single", "indexed_rows"):
            raise ValueError(f"Unsupported mode: {self.mode}")


def fields(spec: str, types: Mapping[str, str] | None = None) -> tuple[Field, ...]:
    """Fields from lines of ``name transform[=default] tag tag ...``."""
    out = []
    for line in spec.strip().splitlines():
        name, transform, *sources = line.split()
        transform, _, default = transform.partition("=")
        out.append(Field(name, transform, tuple(sources), default or None, (types or {}).get(name)))
    return tuple(out)


def _filters(request: Mapping) -> list[tuple[str, bool]]:
    """(tag, wanted value) of every filter that a request names."""
    formulae = {f["name"]: f["expression"] for f in request.get("system_formulae", ())}
    out = []
    for name in request.get("filters", ()):
        found = re.fullmatch(r"\s*(NOT\s+)?\$(\w+)\s*", formulae.get(name, ""), re.IGNORECASE)
        if not found:
            raise ValueError(f"filter {name!r} has no formula of the form [NOT] $Field")
        out.append((found[2].upper(), found[1] is None))
    return out


def section_from_json(name: str, definition: str | Mapping, **overrides) -> Section:
    """A section from the JSON form: mode, row_tag or row paths, index_sources, fields, children, and the request's filters.

    A filter is named by the request and given by a formula, ``$Field`` or ``NOT $Field`` of a yes-no field; rows that do
    not pass are dropped after parsing, whoever wrote the export.
    """
    whole = json.loads(definition) if isinstance(definition, str) else definition
    body = whole.get("response", whole)
    tests = _filters(whole.get("request", {}))

    def path(dotted: str) -> str:
        marked = dotted.replace(".LIST", "\0LIST").removeprefix("ENVELOPE.")
        return marked.replace(".", "/").replace("\0LIST", ".LIST")

    def read_fields(found: Mapping) -> tuple[Field, ...]:
        return tuple(
            Field(n, d.get("transform", "string"), tuple(path(s) for s in d.get("sources", ())), d.get("default"))
            for n, d in found.items()
        )

    def read_children(found) -> tuple[Child, ...]:
        return tuple(
            Child(
                c["name"],
                tuple(path(p) for p in c.get("source_paths", ())),
                read_fields(c["fields"]),
                read_children(c.get("children", ())),
                c.get("required_field"),
            )
            for c in found
        )

    if "row_path_options" in body:
        rows = tuple(path(p) for p in body["row_path_options"])
    else:
        rows = (f"{COLLECTION}/{body['row_tag']}",) if "row_tag" in body else ()
    hidden = tuple(Field(f"__only_{tag}", "bool_yesno", (tag,)) for tag, _ in tests)
    if tests:

        def keep() -> Column:
            passed = F.lit(True)
            for f, (_, wanted) in zip(hidden, tests, strict=True):
                passed = passed & (F.col(f.name) == F.lit(wanted))
            return passed

        overrides.setdefault("keep", keep)
        overrides.setdefault("finish", lambda rows: rows.drop(*(f.name for f in hidden)))
    return Section(
        name,
        read_fields(body["fields"]) + hidden,
        mode=body.get("mode", "list"),
        rows=rows,
        index={alias: path(p) for alias, p in body.get("index_sources", {}).items()},
        length=body.get("length_source"),
        children=read_children(body.get("children", ())),
        required=body.get("required_field"),
        **overrides,
    )


# ---- parse schema -----------------------------------------------------------------------------------


class _Tag(dict):
    """Tags seen below a tag; no entries means a leaf."""

    def at(self, path: str) -> "_Tag":
        tag = self
        for part in path.split("/"):
            tag = tag.setdefault(part, _Tag())
        return tag


def _row_paths(rows: tuple[str, ...]):
    for option in rows:
        if option.split("/")[0] == MESSAGES:
            tail = option.split("/", 1)[1]
            yield from (f"{m}/{tail}" for m in MESSAGE_PATHS)
        else:
            yield option


def _add_record(tag: _Tag, record) -> None:
    for f in record.fields:
        for source in f.sources:
            tag.at(source)
    for child in record.children:
        for path in child.paths:
            _add_record(tag.at(path), child)


def _struct(tag: _Tag) -> StructType:
    out = []
    for name, below in tag.items():
        if name.startswith("@"):
            out.append(StructField("_" + name[1:], StringType()))
        else:
            out.append(StructField(name, ArrayType(_struct(below) if below else StringType())))
    return StructType(out)


def parse_schema(section: Section) -> StructType:
    root = _Tag()
    for path in _row_paths(section.rows):
        _add_record(root.at(path), section)
    for path in section.index.values():
        root.at(path)
    for f in section.fields:
        for source in f.sources if section.index else ():
            alias, _, below = source.partition("/")
            if below:
                root.at(section.index[alias]).at(below)
    return StructType(_struct(root).fields + [StructField(CORRUPT, StringType())])


# ---- expressions ------------------------------------------------------------------------------------
#
# Where a value sits is written as SQL text: a definition then costs one call per field to build, which matters
# to a stream that compiles every section for every batch.

def _member(struct: str, tag: str) -> str:
    return f"{struct}.`{'_' + tag[1:] if tag.startswith('@') else tag}`"


def _at(struct: str, path: str) -> str:
    """Occurrences at a path as an array; a repeated tag on the way counts by its first occurrence."""
    *way, last = path.split("/")
    for tag in way:
        struct = f"get({_member(struct, tag)}, 0)"
    return _member(struct, last)


def _source(struct: str, path: str) -> tuple[str, bool]:
    """Where a source sits, and whether that is a plain text and not an array of occurrences."""
    if path.startswith("@"):
        return _member(struct, path), True
    return _at(struct, path), False


def _text(found: str, plain: bool) -> str:
    """Text of a tag: its only value, or the non-blank values joined; empty when there is none. The parser has trimmed them."""
    if plain:
        return f"coalesce({found}, '')"
    joined = f"array_join(filter({found}, p -> p <> ''), ', ')"
    return f"CASE WHEN size({found}) > 1 THEN {joined} ELSE coalesce(get({found}, 0), '') END"


def _value(sources: list[tuple[str, bool]], numeric: bool) -> str:
    """Text of the first source that holds any. As a number a repeated tag counts as nothing."""
    if not sources:
        return "''"
    if not numeric:
        texts = [_text(*source) for source in sources]
        return texts[0] if len(texts) == 1 else "coalesce(" + ", ".join(f"nullif({t}, '')" for t in texts) + ", '')"

    def single(found: str, plain: bool) -> str:
        return found if plain else f"CASE WHEN size({found}) = 1 THEN get({found}, 0) END"

    if len(sources) == 1:  # a blank is no number either
        return single(*sources[0])
    return "CASE " + " ".join(f"WHEN {_text(*source)} <> '' THEN {single(*source)}" for source in sources) + " END"


def _first_filled(options: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN size({o}) > 0 THEN {o} END" for o in options) + ")"


def _finish_value(text: Column, f: Field) -> Column:
    value = text if f.transform == "string" else transform_for(f.transform)(text)  # a text comes trimmed, and never null
    if f.default is not None:
        if f.transform in ("string", "quantity_unit"):
            value = F.when(value != "", value).otherwise(F.lit(f.default))
        else:
            value = F.coalesce(value, F.lit(f.default))
    return value.try_cast(f.type) if f.type else value


def _child_values(struct: str, child: Child, depth: int = 0) -> str:
    """Raw child rows; the first path with rows wins, blank rows and rows without the required field go."""
    row = f"c{depth}"
    rows = _first_filled([_at(struct, p) for p in child.paths])
    members = [f"'{f.name}', {_value([_source(row, s) for s in f.sources], f.transform in NUMERIC)}" for f in child.fields]
    members += [f"'{c.name}', {_child_values(row, c, depth + 1)}" for c in child.children]
    if child.required:
        keep = f"{row}.`{child.required}` <> ''"
    else:
        filled = [f"coalesce({row}.`{f.name}`, '') <> ''" for f in child.fields]
        keep = " OR ".join(filled + [f"size({row}.`{c.name}`) > 0" for c in child.children])
    read = f"transform({rows}, {row} -> named_struct({', '.join(members)}))"
    return f"coalesce(filter({read}, {row} -> {keep}), array())"


def _typed_children(raw: Column, child: Child) -> Column:
    def convert(row: Column) -> Column:
        return F.struct(
            *(_finish_value(row[f.name], f).alias(f.name) for f in child.fields),
            *(_typed_children(row[c.name], c).alias(c.name) for c in child.children),
        )

    return F.transform(raw, convert)


def parse_documents(checked: DataFrame, section: Section) -> DataFrame:
    """Parse each usable envelope once. A document the parser had to cut short becomes an error."""
    schema = parse_schema(section)
    doc = F.from_xml(
        F.when(F.col("error").isNull(), F.col("text")),
        schema,
        {"columnNameOfCorruptRecord": CORRUPT, "attributePrefix": "_", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"},
    )
    cut_short = F.when(F.col(f"doc.{CORRUPT}").isNotNull(), F.lit("Malformed document"))
    return once(checked, "doc", doc).withColumn("error", F.coalesce("error", cut_short)).drop("text")


def _row_array(section: Section) -> str:
    """All rows of a document: path options in order, the first with rows wins."""

    def option(path: str) -> str:
        if path.split("/")[0] != MESSAGES:
            return _at("doc", path)
        first, second = (_at("doc", m) for m in MESSAGE_PATHS)
        messages = f"CASE WHEN size({first}) > 0 THEN {first} ELSE {second} END"
        rows = f"transform({messages}, m -> {_member('m', path.split('/', 1)[1])})"
        return f"flatten(filter({rows}, r -> r IS NOT NULL))"

    return _first_filled([option(p) for p in section.rows])


def _indexed_array(section: Section) -> str:
    """Parallel lists zipped by position, as long as the length source, else as the longest; gaps are null."""
    lists = {alias: f"coalesce({_at('doc', path)}, array())" for alias, path in section.index.items()}
    names = ", ".join(f"'{alias}', get({found}, i)" for alias, found in lists.items())
    if section.length in lists:
        count = f"size({lists[section.length]})"
    else:
        count = "greatest(0, " + ", ".join(f"size({found})" for found in lists.values()) + ")"
    return f"CASE WHEN {count} > 0 THEN transform(sequence(0, {count} - 1), i -> named_struct({names})) END"


def staged_rows(parsed: DataFrame, section: Section) -> DataFrame:
    """Rows with ``error``, ``pos`` (place in the document) and ``valid``, one pass over the documents.

    A document without rows, or with an error, leaves one row that is not ``valid``: so an empty section can be
    told from one that was never fetched, and a failure from both.
    """
    carried = [c for c in parsed.columns if c not in ("doc", "error")]
    indexed = section.mode == "indexed_rows"
    found = _indexed_array(section) if indexed else _row_array(section)
    rows = parsed.select(*carried, "error", F.posexplode_outer(F.expr(found)).alias("pos", "row"))

    def place(source: str) -> tuple[str, bool]:
        if not indexed:
            return _source("row", source)
        alias, _, below = source.partition("/")
        return _source(f"row.`{alias}`", below) if below else (f"row.`{alias}`", True)

    def value(f: Field) -> Column:
        return F.expr(_value([place(s) for s in f.sources], f.transform in NUMERIC))

    raw = rows.select(
        *carried,
        "error",
        "pos",
        *(value(f).alias("__" + f.name) for f in section.fields),
        *(F.expr(_child_values("row", c)).alias("__" + c.name) for c in section.children),
    )
    # A number beyond its type is an error of its row, not the end of the job.
    beyond = F.lit(False)
    for f in section.fields:
        if f.type:
            whole = transform_for(f.transform)(F.col("__" + f.name))
            beyond = beyond | (whole.isNotNull() & whole.try_cast(f.type).isNull())
    out = raw.select(
        *carried,
        F.coalesce("error", F.when(beyond, F.lit("Number out of range"))).alias("error"),
        "pos",
        *(
            _finish_value(F.col("__" + f.name), f).alias(f.name)
            for f in section.fields
        ),
        *(_typed_children(F.col("__" + c.name), c).alias(c.name) for c in section.children),
    )
    valid = F.col("error").isNull() & F.col("pos").isNotNull()
    if section.required:
        valid = valid & (F.col(section.required) != "")
    if section.mode == "single":
        valid = valid & (F.col("pos") == 0)
    if section.keep:
        valid = valid & section.keep()
    out = out.withColumn("valid", valid)
    return section.finish(out) if section.finish else out


def extract(parsed: DataFrame, section: Section) -> DataFrame:
    """The section's rows, one output column per field."""
    good = parsed.withColumn("doc", F.when(F.col("error").isNull(), F.col("doc")))
    return staged_rows(good, section).filter("valid").drop("valid", "error")


def read_section(checked: DataFrame, section: Section) -> DataFrame:
    return extract(parse_documents(checked, section), section)


def rejected(checked: DataFrame, section: Section) -> DataFrame:
    """Responses that gave no rows because they report an error or could not be parsed whole."""
    parsed = parse_documents(checked, section).filter(F.col("error").isNotNull())
    return parsed.drop("doc")
