"""Problem 5: nested JSON records to adjacency rows and flat entity tables.

Every value of a payload becomes one row of a stored adjacency table: node,
parent node, label, ordinal (within an array) and scalar. All tables come from
it by joins: nodes are joined with their parents until each has met the element
object around it, object nodes are joined with their scalar children, and these
are pivoted into one flat table per kind of entity, each row linked to the
element it lies in, to the event and to its run.

Two readings come before that. A field that holds an array in some payloads may
hold its single element bare in others; the fields seen both ways are learnt
first, over all payloads. And a payload or field may hold its object as a
string of JSON, which is read as what it holds (``text`` fields excepted).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.session import store
from lorekiln.sources.tables import current_rows

PLAIN_TEXT = {"text"}
NODES = "event_id bigint, run_id string, stage string, node_id int, parent_id int, label string, ordinal int, kind string, scalar string, path string, route string"
#: Fields seen both as an array and bare, at most so many; real schemas have far fewer.
MOST_FIELDS = 1_000_000
#: Columns of the table of all entities; more are data, not a schema, and are refused.
MOST_COLUMNS = 5_000


def _refuse(name: str) -> None:
    raise ValueError(name)


DECODER = json.JSONDecoder(parse_constant=_refuse)


def read_json(text: str | None) -> Any:
    """The parsed value; ValueError for broken, empty and missing payloads (NaN and the like are broken)."""
    try:
        return DECODER.decode(text or "")
    except RecursionError as e:
        raise ValueError("too deep") from e


def unwrap(value: Any, label: str) -> Any:
    """What a string holds, if it is a JSON object (or an array of objects), however often it was encoded."""
    while isinstance(value, str) and label not in PLAIN_TEXT:
        if value[:1].isalnum():
            return value
        bare = value.strip()
        if not bare or bare[0] not in '{["':
            return value
        try:
            inner = read_json(bare)
        except ValueError:
            return value
        if isinstance(inner, dict) or isinstance(inner, str) and inner != value:
            value = inner
        elif isinstance(inner, list) and inner and all(isinstance(x, dict) for x in inner):
            return inner
        else:
            return value
    return value


def current_events(events: DataFrame) -> DataFrame:
    """(event_id, run_id, stage, payload): the latest delivery of each event; blank run ids become null."""
    rows = current_rows(events, "event_id", ["ingested_at"], ["run_id", "stage", "payload"])
    return rows.withColumn("run_id", F.when(F.trim("run_id") != "", F.trim("run_id")))


def _fields(value: Any, label: str, parent: str, seen: set[tuple[str, str, bool]]) -> None:
    """Collect (label around, label, holds an array?) of all fields that hold an array or an object."""
    stack = [(value, label, parent)]
    while stack:
        value, label, parent = stack.pop()
        value = unwrap(value, label)
        if isinstance(value, dict):
            if label:
                seen.add((parent, label, False))
            stack += [(v, k, label) for k, v in value.items()]
        elif isinstance(value, list):
            if label:
                seen.add((parent, label, True))
            for x in value:
                x = unwrap(x, label)
                if isinstance(x, dict):
                    stack += [(v, k, label) for k, v in x.items()]
                elif isinstance(x, list):
                    stack.append((x, "", label))


def bare_fields(events: DataFrame) -> set[tuple[str, str]]:
    """Fields (label around, label) that hold an array in some payloads and an object in others.

    Counted over all payloads; only distinct fields leave a batch, and only
    those seen both ways come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[str, str, bool]] = set()
            for payload in batch.column(0).to_pylist():
                try:
                    _fields(read_json(payload), "", "", seen)
                except ValueError:
                    continue
            columns = list(zip(*seen)) if seen else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], names=["around", "label", "listed"])

    found = events.select("payload").where(F.col("payload").isNotNull()).mapInArrow(run, "around string, label string, listed boolean")
    both = found.groupBy("around", "label").agg(F.bool_or("listed").alias("listed"), F.bool_or(~F.col("listed")).alias("bare")).where("listed AND bare")
    rows = both.select("around", "label").take(MOST_FIELDS + 1)
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields are seen both as array and bare; these labels are data, not a schema")
    return {(r[0], r[1]) for r in rows}


def _scalar(value: Any) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    if isinstance(value, (int, float)):
        return "number", repr(value)
    return "string", value


def _escaped(name: str) -> str:
    return name.replace("\\", "\\\\").replace(".", "\\.") if "." in name or "\\" in name else name


def _adjacency(value: Any, bare: set[tuple[str, str]], columns: list[list]) -> int:
    """Add one payload's nodes to the columns from ``node_id`` on; node 0 is the payload itself. Returns their number."""
    nodes, parents, labels, ordinals, kinds, scalars, paths, routes = columns
    count = 0

    def add(parent: int | None, label: str, ordinal: int | None, kind: str, scalar: str | None, path: str | None, route: str | None) -> int:
        nonlocal count
        nodes.append(count), parents.append(parent), labels.append(label), ordinals.append(ordinal)
        kinds.append(kind), scalars.append(scalar), paths.append(path), routes.append(route)
        count += 1
        return count - 1

    value = unwrap(value, "")
    if not isinstance(value, (dict, list)):
        add(None, "", None, *_scalar(value), "$", "$")
        return count
    stack: list[tuple] = [(value, None, "", None, "$", "$")]
    while stack:
        value, parent, label, ordinal, path, route = stack.pop()
        if isinstance(value, dict):
            node = add(parent, label, ordinal, "object", None, path, route)
            for name, child in value.items():
                child = unwrap(child, name)
                if isinstance(child, dict) and (label, name) in bare:
                    child = [child]  # the one element, held bare
                if isinstance(child, (dict, list)):
                    stack.append((child, node, name, None, f"{path}.{name}", f"{route}.{_escaped(name)}"))
                else:
                    add(node, name, None, *_scalar(child), None, None)
        else:
            node = add(parent, label, ordinal, "array", None, path, route)
            for i, child in enumerate(value):
                child = unwrap(child, label)
                if isinstance(child, (dict, list)):
                    stack.append((child, node, label, i, f"{path}[{i}]", f"{route}[]"))
                else:
                    add(node, label, i, *_scalar(child), None, None)
    return count


def shred(events: DataFrame) -> DataFrame:
    """The adjacency table of the current events' payloads, stored.

    Columns: event_id, run_id, stage; node_id and parent_id within the event;
    label, ordinal (position in an array, else null), kind (object, array,
    string, number, boolean, null), scalar; for objects and arrays path
    (``$.name[i]``) and route (the path without positions, ``.`` and ``\\`` in a
    name escaped). Payloads that are null, blank or don't parse give no rows;
    null run ids and stages stay null.
    """
    latest = current_events(events)
    shared = latest.sparkSession.sparkContext.broadcast(bare_fields(events))
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            at: list[int] = []
            for row, payload in enumerate(batch.column(3).to_pylist()):
                try:
                    value = read_json(payload)
                except ValueError:
                    value = ...
                if value is not ...:
                    at += [row] * _adjacency(value, bare, columns)
                if len(at) > 50_000 or row == batch.num_rows - 1:
                    rows = pa.array(at, pa.int32())
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)
                    columns, at = [[] for _ in kinds], []

    return store(latest.select("event_id", "run_id", "stage", "payload").mapInArrow(run, NODES), "nodes")


def parse_errors(events: DataFrame) -> DataFrame:
    """(event_id, run_id, stage, error): current events whose payload gives no rows: ``Missing`` (null or blank) or ``Broken``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, str] = {}
            for row, payload in enumerate(batch.column(3).to_pylist()):
                try:
                    read_json(payload)
                except ValueError:
                    found[row] = "Broken" if (payload or "").strip() else "Missing"
            rows = pa.array(list(found), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), pa.array(list(found.values()), pa.string())], names=["event_id", "run_id", "stage", "error"])

    return current_events(events).select("event_id", "run_id", "stage", "payload").mapInArrow(run, "event_id bigint, run_id string, stage string, error string")


def containers(nodes: DataFrame) -> DataFrame:
    """Objects and arrays with the head above them, by joins of nodes with their parents.

    A head is an object that is an array element, or the payload itself. Columns:
    event_id, node_id, parent_id, path, route, is_head, head_id, head_path and
    head_route (of the nearest head at or above the node). Pointers double, so
    the rounds are the logarithm of the steps between two heads.
    """
    element = (F.col("kind") == "object") & F.col("ordinal").isNotNull()
    inner = nodes.where("kind IN ('object', 'array')").select("event_id", "node_id", "parent_id", "path", "route", (element | F.col("parent_id").isNull()).alias("is_head"))
    own = lambda c: F.when(F.col("is_head"), F.col(c))
    state = inner.withColumns({"up": F.when(~F.col("is_head"), F.col("parent_id")), "head_id": own("node_id"), "head_path": own("path"), "head_route": own("route")})
    state = store(state, "containers")
    while state.where("head_id IS NULL").limit(1).count():
        above = state.select("event_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("head_id").alias("h"), F.col("head_path").alias("hp"), F.col("head_route").alias("hr"))
        met = state.where("head_id IS NULL").join(above, ["event_id", "up"]).select("event_id", "node_id", "parent_id", "path", "route", "is_head", F.col("next").alias("up"), F.col("h").alias("head_id"), F.col("hp").alias("head_path"), F.col("hr").alias("head_route"))
        state = store(state.where("head_id IS NOT NULL").unionByName(met), "containers")
    return state.drop("up")


def _owned(nodes: DataFrame, around: DataFrame) -> DataFrame:
    """``nodes`` joined with the container they lie in: adds its path, route and head."""
    up = around.select("event_id", F.col("node_id").alias("parent_id"), F.col("path").alias("up_path"), F.col("route").alias("up_route"), "head_id", "head_path", "head_route")
    return nodes.join(up, ["event_id", "parent_id"])


def _elements(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'object' AND ordinal IS NOT NULL")


def element_links(nodes: DataFrame) -> DataFrame:
    """(event_id, parent_path, child_path): every object that is an array element, linked to the one around it."""
    elements = _elements(nodes).select("event_id", "parent_id", F.col("path").alias("child_path"))
    return _owned(elements, containers(nodes)).select("event_id", F.col("head_path").alias("parent_path"), "child_path")


def entity_table(nodes: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """One flat table: the element objects of a field, joined with their scalar children and pivoted.

    Columns: event_id, run_id, stage, parent_path, child_path and the asked-for
    scalar fields as strings (absent and null ones are null). The pivot groups
    by event and node, so a hot event is bounded by its own payload.
    """
    taken = {"event_id", "run_id", "stage", "parent_path", "child_path"}
    if clash := taken & set(columns):
        raise ValueError(f"fields clash with link columns: {sorted(clash)}")
    own = _elements(nodes).where(F.col("label") == label).select("event_id", "run_id", "stage", "node_id", "parent_id", F.col("path").alias("child_path"))
    objects = _owned(own, containers(nodes)).select("event_id", "run_id", "stage", "node_id", F.col("head_path").alias("parent_path"), "child_path")
    children = nodes.where(F.col("label").isin(columns) & F.col("scalar").isNotNull() & F.col("ordinal").isNull()).select("event_id", F.col("parent_id").alias("node_id"), "label", "scalar")
    flat = children.groupBy("event_id", "node_id").agg(*[F.max(F.when(F.col("label") == c, F.col("scalar"))).alias(c) for c in columns])
    return objects.join(flat, ["event_id", "node_id"], "left").drop("node_id")


def _scalars(nodes: DataFrame, around: DataFrame) -> DataFrame:
    """Scalar nodes below a container, with ``field``: the names below their head, joined with ``.``, ``[]`` behind those of arrays."""
    name = F.regexp_replace("label", r"([.\\])", r"\\$1")
    route = F.concat("up_route", F.when(F.col("ordinal").isNull(), F.concat(F.lit("."), name)).otherwise("[]"))
    below = F.substring(route, F.length("head_route") + 1, F.length(route))
    rows = nodes.where("kind NOT IN ('object', 'array') AND parent_id IS NOT NULL").drop("path", "route")
    return _owned(rows, around).withColumn("field", F.when(F.startswith(below, F.lit(".")), F.substring(below, F.lit(2), F.length(below))).otherwise(below))


def _column_names(fields: list[str], taken: set[str]) -> dict[str, str]:
    """A column for each field; names that another column has, but for case, get a number."""
    out, taken = {}, {t.lower() for t in taken}
    for field in fields:
        base = name = field or "(empty)"
        k = 1
        while name.lower() in taken:
            k += 1
            name = f"{base}#{k}"
        taken.add(name.lower())
        out[field] = name
    return out


def entities(nodes: DataFrame) -> DataFrame:
    """All flat tables in one: each payload and each element object, joined with its scalars and pivoted.

    Columns: event_id, run_id, stage, entity (the field's label, ``$`` for a
    payload itself), parent_path (null for a payload), child_path, and one
    string column for each scalar field seen anywhere; values of plain objects
    have their names in front (``anchor.kind``). Scalars in arrays are rows of
    scalar_elements(). A payload that is one scalar has it in column ``$``.
    """
    links = ["event_id", "run_id", "stage", "entity", "parent_path", "child_path"]
    around = containers(nodes)
    base = ["event_id", "run_id", "stage"]
    roots = nodes.where("parent_id IS NULL").select(*base, F.col("node_id").alias("at"), F.lit("$").alias("entity"), F.lit(None).cast("string").alias("parent_path"), F.col("path").alias("child_path"), F.when(~F.col("kind").isin("object", "array"), F.struct(F.lit("$").alias("field"), "scalar")).alias("value"))
    no_value = F.lit(None).cast("struct<field:string,scalar:string>")
    elements = _owned(_elements(nodes), around).select(*base, F.col("node_id").alias("at"), F.col("label").alias("entity"), F.col("head_path").alias("parent_path"), F.col("path").alias("child_path"), no_value.alias("value"))
    nothing = F.lit(None).cast("string")
    # events, runs and stages come with the heads; the many scalars travel without them
    values = _scalars(nodes.where("ordinal IS NULL"), around).select("event_id", nothing.alias("run_id"), nothing.alias("stage"), F.col("head_id").alias("at"), nothing.alias("entity"), nothing.alias("parent_path"), nothing.alias("child_path"), F.struct("field", "scalar").alias("value"))
    found = roots.unionByName(elements).unionByName(values).groupBy("event_id", "at").agg(
        *[F.max(c).alias(c) for c in links[1:]], F.map_from_entries(F.collect_list("value")).alias("fields")
    )
    found = store(found.drop("at"), "entities")  # read twice: names and rows
    fields = sorted(r[0] for r in found.select(F.explode(F.map_keys("fields")).alias("field")).distinct().take(MOST_COLUMNS + 1))
    if len(fields) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} scalar fields; these labels are data, not a schema")
    names = _column_names(fields, set(links))
    return found.select(*links, *[F.col("fields")[F.lit(f)].alias(n) for f, n in names.items()])


def scalar_elements(nodes: DataFrame) -> DataFrame:
    """The child table of all arrays of scalars: one row per element, linked to the object around it; null elements too."""
    rows = _scalars(nodes.where("ordinal IS NOT NULL OR kind IN ('object', 'array')"), containers(nodes))
    path = F.concat("up_path", F.lit("["), F.col("ordinal").cast("string"), F.lit("]"))
    return rows.select("event_id", "run_id", "stage", F.col("head_path").alias("parent_path"), path.alias("child_path"), "field", "ordinal", F.col("scalar").alias("value"))
