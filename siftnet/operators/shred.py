"""Deeply nested records as flat child tables.

A tree of branches says which objects and arrays of a record are wanted, to any
depth, and which leaves of each. A record, be it a JSON text or nested Arrow
columns, is shredded into one stream per leaf path. Beside every value the stream
has a repetition level (at which repeated field of the path the entry starts
anew: 0 a new row, 1 a new record of it, 2 a new item of an array, and so on) and
a definition level (how far the path is there). Every branch's table is put
together again from these sequences alone, by running counts over whole columns;
see ``positions`` and ``rebuild``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftnet.session import materialize
from siftnet.tables import load


class Number(str):
    """A JSON number as it is written."""


def _refuse(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse, strict=True)


def parse_json(text: str | None) -> tuple[bool, Any]:
    """Whether ``text`` is valid JSON, and its value."""
    if text is None:
        return False, None
    try:
        return True, _DECODER.decode(text)
    except (ValueError, RecursionError):
        return False, None


def text_of(value: Any) -> str | None:
    """A leaf as text: strings and numbers as written, booleans and nested values as JSON."""
    if value is None or isinstance(value, str):
        return None if value is None else str(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@dataclass(frozen=True)
class Leaf:
    """A child table of one leaf: ``path`` is the field, ``item`` the leaf in each of its objects (``None``: the field is itself the leaf)."""

    child: str
    path: str
    item: str | None
    repeated: bool
    scalars: bool = False  #: an item may be the leaf's text instead of an object


ITSELF = ""  #: the leaf of an array of plain values


@dataclass(frozen=True)
class Branch:
    """An object or array of objects at field ``path`` of the branch above: its table's ``name``, its ``leaves``, and the branches in it. ``scalar`` is the leaf that a plain value in place of an object stands for; with ``plain`` leaves are strings and numbers only, else also booleans and nested values, as JSON."""

    name: str
    path: str
    repeated: bool
    leaves: tuple[str, ...]
    inner: tuple[Branch, ...] = ()
    scalar: str | None = None
    plain: bool = False


@dataclass(frozen=True)
class Placed:
    """A branch with its levels: ``rep`` repeated fields lead to it, at ``defn`` it is there (at ``defn`` - 1 only its place in an array)."""

    branch: Branch
    rep: int
    defn: int
    inner: tuple[Placed, ...]

    def all(self) -> Iterator[Placed]:
        yield self
        for p in self.inner:
            yield from p.all()


def placed(branch: Branch, rep: int = 0, defn: int = 0) -> Placed:
    own_rep, own_defn = rep + branch.repeated, defn + 1 + branch.repeated
    return Placed(branch, own_rep, own_defn, tuple(placed(b, own_rep, own_defn) for b in branch.inner))


@dataclass
class Levels:
    """The stream of one leaf path. Definition levels of a leaf in an array of a record: 0 no record, 1 record, 2 item slot, 3 item, 4 value."""

    values: list = field(default_factory=list)
    rep: list = field(default_factory=list)
    defn: list = field(default_factory=list)

    def put(self, value: str | None, rep: int, defn: int) -> None:
        self.values.append(value)
        self.rep.append(rep)
        self.defn.append(defn)


Streams = dict[tuple[str, str], Levels]


def lower_keys(obj: dict) -> dict:
    """Keys in lower case; of keys that differ in case only, the last that isn't null holds."""
    out: dict = {}
    for k, v in obj.items():
        k = k.lower()
        if v is not None or k not in out:
            out[k] = v
    return out


def records_of(body: Any, wrapper: str) -> list:
    """The records of a body: the objects of its ``wrapper`` array, or the body itself."""
    if isinstance(body, list):
        return body
    if not isinstance(body, dict):
        return []
    low = lower_keys(body)
    if wrapper not in low:
        return [low]
    data = _unwrapped(low[wrapper])
    return data if isinstance(data, list) else [] if data is None else [data]


def _unwrapped(value: Any) -> Any:
    """The value a string holds as JSON, where a string stands for an object or array."""
    if type(value) is str:
        ok, inner = parse_json(value)
        return inner if ok and isinstance(inner, (dict, list)) else None
    return value if isinstance(value, (dict, list)) else None


def _absent(p: Placed, rep: int, defn: int, out: Streams) -> None:
    for q in p.all():
        for leaf in q.branch.leaves:
            out[q.branch.name, leaf].put(None, rep, defn)


def _plain(value: Any) -> bool:
    return value is not None and not isinstance(value, (dict, list))


def _shred_value(p: Placed, value: Any, rep: int, out: Streams) -> None:
    """Append the entries of a branch, and of all in it, for its field's ``value``."""
    b, above = p.branch, p.defn - 1 - p.branch.repeated
    value = _unwrapped(value)
    items = (value if isinstance(value, list) else [] if value is None else [value]) if b.repeated else ([] if value is None or isinstance(value, list) else [value])
    if not items:
        _absent(p, rep, above, out)
    for x in items:
        if b.scalar is not None and _plain(x):
            for leaf in b.leaves:
                out[b.name, leaf].put(text_of(x) if leaf == b.scalar else None, rep, p.defn + (leaf == b.scalar))
            for q in p.inner:
                _absent(q, rep, p.defn, out)
        elif isinstance(x := _unwrapped(x), dict):
            _shred_object(p, lower_keys(x), rep, out)
        else:
            _absent(p, rep, p.defn - 1 if b.repeated else above, out)
        rep = p.rep


def _shred_object(p: Placed, record: dict, rep: int, out: Streams) -> None:
    for leaf in p.branch.leaves:
        value = record.get(leaf)
        text = None if p.branch.plain and isinstance(value, (dict, list, bool)) else text_of(value)
        out[p.branch.name, leaf].put(text, rep, p.defn + (text is not None))
    for q in p.inner:
        _shred_value(q, record.get(q.branch.path), rep, out)


def shred_json(bodies: Iterable[str | None], root: Branch, wrapper: str = "data") -> Streams:
    """The streams of all leaves over a column of JSON texts, whose records (at ``wrapper``, or the text itself) are the ``root``. A body that isn't JSON, or has no records, is one entry of definition level 0."""
    p = Placed(root, 1, 1, tuple(placed(b, 1, 1) for b in root.inner))
    out: Streams = {(q.branch.name, leaf): Levels() for q in p.all() for leaf in q.branch.leaves}
    for text in bodies:
        _, body = parse_json(text)
        rep = 0
        for record in records_of(body, wrapper):
            if isinstance(record, str):
                record = _unwrapped(record)
            _shred_object(p, lower_keys(record) if isinstance(record, dict) else {}, rep, out)
            rep = 1
        if rep == 0:
            _absent(p, 0, 0, out)
    return out


def shred(bodies: Iterable[str | None], leaves: list[Leaf], wrapper: str = "data") -> dict[str, Levels]:
    """The streams of single leaves over a column of JSON texts, by child. A leaf of the record itself is a string or number."""
    out = shred_json(bodies, _tree(leaves), wrapper)
    return {x.child: out[_at(x)] for x in leaves}


def _tree(leaves: list[Leaf]) -> Branch:
    inner = tuple(Branch(x.child, x.path, x.repeated, (x.item,), scalar=x.item if x.scalars else None) for x in leaves if x.item is not None)
    return Branch("", "", True, tuple(x.path for x in leaves if x.item is None), inner, plain=True)


def _at(leaf: Leaf) -> tuple[str, str]:
    return ("", leaf.path) if leaf.item is None else (leaf.child, leaf.item)


def running(starts: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """0-based running number of the counted entries since the last start."""
    total = np.cumsum(counted)
    base = np.maximum.accumulate(np.where(starts, total, 0))
    return total - base


def positions(rep: np.ndarray, defn: np.ndarray, levels: int = 2) -> tuple[np.ndarray, ...]:
    """Row, and index at each of ``levels`` repeated fields, of every entry, from the levels alone."""
    row = np.cumsum(rep == 0) - 1
    return row, *(running(rep < k, rep == k) for k in range(1, levels + 1))


@dataclass
class Table:
    """A branch's rows: which row of the input each comes from, its indices at the repeated fields above, and its leaves."""

    row: np.ndarray
    at: list[np.ndarray]
    leaves: dict[str, pa.Array]


def rebuild(streams: Streams, p: Placed) -> Table:
    """The table of one branch from its own streams: those of its leaves have an entry at the same places."""
    first = streams[p.branch.name, p.branch.leaves[0]]
    rep, defn = np.asarray(first.rep, dtype=np.int8), np.asarray(first.defn, dtype=np.int8)
    row, *at = positions(rep, defn, p.rep)
    keep = np.flatnonzero(defn >= p.defn)
    take = lambda v: (v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, pa.string())).take(pa.array(keep))
    return Table(row[keep], [x[keep] for x in at], {leaf: take(streams[p.branch.name, leaf].values) for leaf in p.branch.leaves})


CHILD_SCHEMA = "parent_id bigint, rec_pos bigint, child string, item_pos bigint, sub_pos bigint, item string"


def _child_batch(ids: pa.Array, child: str, row: np.ndarray, rec: np.ndarray, item_pos: np.ndarray, sub_pos: np.ndarray, item: pa.Array) -> pa.RecordBatch:
    n = len(row)
    cols = [ids.take(pa.array(row)), pa.array(rec), pa.array([child] * n, pa.string()), pa.array(item_pos), pa.array(sub_pos), item.cast(pa.string()).fill_null("")]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CHILD_SCHEMA.split(", ")])


def _json_children(leaves: list[Leaf], wrapper: str):
    tree = _tree(leaves)
    by_name = {q.branch.name: q for q in Placed(tree, 1, 1, tuple(placed(b, 1, 1) for b in tree.inner)).all()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = shred_json(batch.column(1).to_pylist(), tree, wrapper)
            for x in leaves:
                p = by_name[_at(x)[0]]
                own = Placed(Branch(p.branch.name, p.branch.path, p.branch.repeated, (_at(x)[1],)), p.rep, p.defn + (x.item is None), ())
                t = rebuild(streams, own)
                zero = np.zeros(len(t.row), dtype=np.int64)
                yield _child_batch(batch.column(0), x.child, t.row, t.at[0], t.at[1] if len(t.at) > 1 else zero, zero - 1, t.leaves[_at(x)[1]])

    return work


def first_delivery(df: DataFrame, key: str, order: str | None, *columns: str) -> DataFrame:
    """One row per key, of redelivered rows the one received first. Rows without key are left out."""
    rest = F.struct(*([F.col(f"`{order}`")] if order else []), *(F.col(f"`{c}`") for c in columns))
    return df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(F.min(rest).alias("first")).select(key, *(F.col(f"first.`{c}`").alias(c) for c in dict.fromkeys([*([order] if order else []), *columns])))


def json_children(df: DataFrame, key: str, body: str, leaves: list[Leaf], wrapper: str = "data", order: str | None = None) -> DataFrame:
    """Child rows (``CHILD_SCHEMA``) of JSON texts.

    Of rows with the same ``key`` one counts (the first by ``order``); a null key
    has no children that could point to it and gives none. Null, empty, blank and
    broken bodies give no rows, nor do null items, which keep their position. A
    missing or null leaf is the empty string. Texts of any length are read whole.
    An empty table gives an empty one.
    """
    own = first_delivery(df, key, order, body)
    return own.select(F.col(f"`{key}`").cast("bigint").alias("parent_id"), F.col(f"`{body}`").alias("body")).mapInArrow(_json_children(leaves, wrapper), CHILD_SCHEMA)


ADGUARD_LEAVES = [
    Leaf("answer", "answer", "value", True),
    Leaf("original_answer", "original_answer", "value", True),
    Leaf("rule", "rules", "text", True, scalars=True),
    Leaf("question", "question", "name", False),
    Leaf("client_info", "client_info", "name", False),
]


# --- nested Arrow columns ------------------------------------------------------------------------------------------------------------------


@dataclass
class _Entries:
    """Entries of a stream while it goes down: levels, and which element of the current column each is (-1: none)."""

    rep: np.ndarray
    defn: np.ndarray
    at: np.ndarray


def _items(e: _Entries, column: pa.Array, rep: int, defn: int) -> tuple[_Entries, pa.Array]:
    """The entries of a list column's items; null and empty lists stay one entry at the level they had."""
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).astype(np.int64)
    first = np.r_[0, np.cumsum(size)]  # where each list begins in ``flatten``, which leaves null lists out
    n = np.where(e.at >= 0, size[e.at] if len(size) else 0, 0)
    entries = np.maximum(n, 1)
    begin = np.r_[0, np.cumsum(entries)[:-1]].astype(np.int64)
    owner = np.repeat(np.arange(len(n)), entries)
    k = np.arange(len(owner)) - begin[owner]
    there = n[owner] > 0
    out = _Entries(np.where(k > 0, rep, e.rep[owner]).astype(np.int8), np.where(there, defn, e.defn[owner]).astype(np.int8), np.where(there, first[e.at[owner]] + k, -1))
    return out, column.flatten()


def _valid(e: _Entries, column: pa.Array, defn: int) -> _Entries:
    """Entries whose element isn't null are there; the others' way ends."""
    ok = (e.at >= 0) & (np.asarray(column.is_valid())[e.at] if len(column) else False)
    return _Entries(e.rep, np.where(ok, defn, e.defn).astype(np.int8), np.where(ok, e.at, -1))


def _shred_arrow(p: Placed, column: pa.Array, e: _Entries, out: Streams) -> None:
    b = p.branch
    if b.repeated:
        e, column = _items(e, column, p.rep, p.defn - 1)
    e = _valid(e, column, p.defn)
    for leaf in b.leaves:
        values = column if leaf == ITSELF else column.field(leaf)
        if leaf != ITSELF and len(column) and column.null_count:
            values = pa.compute.if_else(column.is_valid(), values, pa.scalar(None, values.type))
        v = _valid(e, values, p.defn + 1)
        out[b.name, leaf] = Levels(values.take(pa.array(np.where(v.at >= 0, v.at, 0), mask=v.at < 0)), v.rep, v.defn)
    for q in p.inner:
        _shred_arrow(q, column.field(q.branch.path), e, out)


def shred_arrow(column: pa.Array, root: Branch) -> tuple[Streams, Placed]:
    """The streams of all leaves of a nested column whose field is the branch ``root``."""
    p, out = placed(root), {}
    n = len(column)
    _shred_arrow(p, column, _Entries(np.zeros(n, dtype=np.int8), np.zeros(n, dtype=np.int8), np.arange(n)), out)
    return out, p


def array_children(df: DataFrame, key: str, array: str, name: str, items: str, order: str | None = None) -> DataFrame:
    """Children of an array of structs (``host``, its field ``name``) and of the array ``items`` in each (``open_port``), with the columns of ``CHILD_SCHEMA``.

    Null and empty arrays give no rows, null elements none either but keep their
    position; a missing name is the empty string. Of rows with the same key one
    counts, rows without key give none.
    """
    tree = Branch("host", array, True, (name,), (Branch("open_port", items, True, (ITSELF,)),))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, host = shred_arrow(batch.column(1), tree)
            t = rebuild(streams, host)
            zero = np.zeros(len(t.row), dtype=np.int64)
            yield _child_batch(batch.column(0), "host", t.row, zero, t.at[0], zero - 1, t.leaves[name])
            t = rebuild(streams, host.inner[0])
            # a null port keeps its place and gives no row
            there = np.flatnonzero(np.asarray(t.leaves[ITSELF].is_valid()))
            yield _child_batch(batch.column(0), "open_port", t.row[there], np.zeros(len(there), dtype=np.int64), t.at[0][there], t.at[1][there], t.leaves[ITSELF].take(pa.array(there)))

    slim = df.select(key, *([order] if order else []), F.transform(F.col(f"`{array}`"), lambda x: F.when(x.isNotNull(), F.struct(x[name].cast("string").alias(name), x[items].alias(items)))).alias(array))
    own = first_delivery(slim, key, order, array)
    return own.select(F.col(f"`{key}`").cast("bigint").alias("parent_id"), F.col(f"`{array}`").alias("body")).mapInArrow(work, CHILD_SCHEMA)


# --- whole tables -------------------------------------------------------------------------------------------------------------------------

ROWS_SCHEMA = "parent_id bigint, child string, at array<bigint>, leaves map<string, string>"


def _row_batches(ids: pa.Array, streams: Streams, branches: Iterable[Placed]) -> Iterator[pa.RecordBatch]:
    for p in branches:
        if not p.branch.leaves:
            continue
        t = rebuild(streams, p)
        n, k = len(t.row), len(t.leaves)
        at = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * p.rep, pa.int32()), pa.array(np.stack(t.at, axis=1).ravel() if t.at else np.zeros(0, dtype=np.int64), pa.int64()))
        items = pa.concat_arrays([a.cast(pa.string()) for a in t.leaves.values()]).take(pa.array(np.arange(n * k).reshape(k, n).T.ravel() if n else np.zeros(0, dtype=np.int64)))
        names = pa.array(list(t.leaves) * n, pa.string())
        maps = pa.MapArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), names, items)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(t.row)), pa.array([p.branch.name] * n, pa.string()), at, maps], names=["parent_id", "child", "at", "leaves"])


class Tables:
    """The child tables of a nested column, shredded once. ``table`` gives those of one branch."""

    def __init__(self, rows: DataFrame, branches: Iterable[Placed]) -> None:
        self.rows, self.placed = rows, {p.branch.name: p for p in branches}

    def table(self, name: str) -> DataFrame:
        """``parent_id``, an index for each repeated field above, and the branch's leaves as texts."""
        p = self.placed[name]
        up = [q for q in self.placed.values() if q.branch.repeated and any(x is p for x in q.all())]
        index = {q.rep: f"{q.branch.name or 'rec'}_pos" for q in up}
        at = [F.get("at", F.lit(k - 1)).alias(index.get(k, f"pos_{k}")) for k in range(1, p.rep + 1)]
        return self.rows.where(F.col("child") == name).select("parent_id", *at, *(F.col("leaves")[leaf].alias(leaf or name) for leaf in p.branch.leaves))


def json_tables(df: DataFrame, key: str, body: str, root: Branch, wrapper: str = "data", order: str | None = None) -> Tables:
    """All branches of the records in JSON texts as tables, with the rules of ``json_children``; ``rec_pos`` is the record's place in ``wrapper``."""
    p = Placed(root, 1, 1, tuple(placed(b, 1, 1) for b in root.inner))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _row_batches(batch.column(0), shred_json(batch.column(1).to_pylist(), root, wrapper), p.all())

    own = first_delivery(df, key, order, body).select(F.col(f"`{key}`").cast("bigint").alias("parent_id"), F.col(f"`{body}`").alias("body"))
    return Tables(materialize(own.mapInArrow(work, ROWS_SCHEMA), "tables"), p.all())


def array_tables(df: DataFrame, key: str, column: str, root: Branch, order: str | None = None) -> Tables:
    """All branches of a nested column as tables, to any depth. Of rows with the same key one counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams, p = shred_arrow(batch.column(1), root)
            yield from _row_batches(batch.column(0), streams, p.all())

    own = first_delivery(df, key, order, column).select(F.col(f"`{key}`").cast("bigint").alias("parent_id"), F.col(f"`{column}`").alias("body"))
    return Tables(materialize(own.mapInArrow(work, ROWS_SCHEMA), "tables"), placed(root).all())


ANSWER = ("value", "type", "ttl")
#: Everything in a record of the log; its own leaves name the record.
ADGUARD = Branch("record", "", True, ("time", "reason", "client", "status", "upstream", "elapsedms", "cached"), (
    Branch("answer", "answer", True, ANSWER), Branch("original_answer", "original_answer", True, ANSWER), Branch("rule", "rules", True, ("text", "filter_list_id"), scalar="text"),
    Branch("question", "question", False, ("name", "type", "class")), Branch("client_info", "client_info", False, ("name", "whois", "disallowed", "disallowed_rule")),
))
HOST = Branch("host", "hosts", True, ("ip_address", "mac_address", "hostname", "vendor", "status"), (Branch("open_port", "open_ports", True, (ITSELF,)),))


def p5_found(spark, sf_dir: str) -> DataFrame:
    """Children of AdGuard bodies and of device reports."""
    adguard = json_children(load(spark, sf_dir, "adguard_log"), "rec_id", "body", ADGUARD_LEAVES, order="received_at")
    devices = array_children(load(spark, sf_dir, "device_reports"), "report_id", "hosts", "ip_address", "open_ports")
    both = adguard.withColumn("src", F.lit("adguard_log")).unionByName(devices.withColumn("src", F.lit("device_reports")))
    return both.select("src", "parent_id", "rec_pos", "child", "item_pos", "sub_pos", "item")


def p5_hosts(spark, sf_dir: str) -> DataFrame:
    """The device reports' children alone, which SQL can express."""
    return array_children(load(spark, sf_dir, "device_reports"), "report_id", "hosts", "ip_address", "open_ports")


_HOSTS_SQL = """
with r as (select report_id, any_value(hosts) as hosts from device_reports where report_id is not null group by report_id),
h as (select report_id, unnest(range(len(hosts))) as i, hosts from r where len(hosts) > 0),
e as (select report_id, i, hosts[i + 1] as x from h where hosts[i + 1] is not null),
p as (select report_id, i, unnest(range(len(x.open_ports))) as j, x from e where len(x.open_ports) > 0)
select report_id as parent_id, cast(0 as bigint) as rec_pos, 'host' as child, i as item_pos, cast(-1 as bigint) as sub_pos, coalesce(x.ip_address, '') as item from e
union all
select report_id, 0, 'open_port', i, j, cast(x.open_ports[j + 1] as varchar) from p where x.open_ports[j + 1] is not null
"""



def p5_tables(spark, sf_dir: str) -> DataFrame:
    """Every leaf of every branch of the log's records: table, place and leaf."""
    t = json_tables(load(spark, sf_dir, "adguard_log"), "rec_id", "body", ADGUARD, order="received_at")
    return t.rows.select("parent_id", "child", F.array_join(F.transform("at", lambda x: x.cast("string")), ".").alias("place"), F.explode("leaves").alias("leaf", "value")).where("value is not null")


def p5_host_tables(spark, sf_dir: str) -> DataFrame:
    """The hosts of device reports with all their fields, and how many ports each has."""
    t = array_tables(load(spark, sf_dir, "device_reports"), "report_id", "hosts", HOST)
    ports = t.table("open_port").groupBy("parent_id", "host_pos").agg(F.count("open_port").alias("n_ports"))
    return t.table("host").join(ports, ["parent_id", "host_pos"], "left").na.fill(0, ["n_ports"])


_HOST_TABLES_SQL = """
with r as (select report_id, any_value(hosts) as hosts from device_reports where report_id is not null group by report_id),
h as (select report_id, unnest(range(len(hosts))) as i, hosts from r where len(hosts) > 0)
select report_id as parent_id, i as host_pos, hosts[i + 1].ip_address as ip_address, hosts[i + 1].mac_address as mac_address, hosts[i + 1].hostname as hostname, hosts[i + 1].vendor as vendor, hosts[i + 1].status as status,
 len(list_filter(coalesce(hosts[i + 1].open_ports, []), lambda p: p is not null)) as n_ports from h where hosts[i + 1] is not null
"""

QUERIES = {"p5_found": p5_found, "p5_hosts": p5_hosts, "p5_tables": p5_tables, "p5_host_tables": p5_host_tables}
SQL = {"p5_hosts": _HOSTS_SQL, "p5_host_tables": _HOST_TABLES_SQL}
