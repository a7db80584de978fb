"""Schemas that drift between files: one table from all files, and a report of each change from a file to the next.

Each payload is parsed once into a table of cells; fields, types and nesting of each file come from one aggregate over it. Files
whose schema lost and gained fields are matched by similarity flooding: the fields of both files, their names, types, nested
fields and values form two graphs, scores of pairs of nodes spread along common edges until they converge, and a stable
one-to-one choice is taken from the converged scores. Values are part of the graphs: two fields whose values agree in the records
both files hold share a node. A chosen pair counts as a rename when an exact check of those records confirms it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import as_table, broadcast_if_small, cut_lineage

#: Kinds of JSON values by the first word of their variant type.
KINDS = {"BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "text", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "list"}


def _kind(v: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.try_element_at(kinds, F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0))


def record_cells(df: DataFrame, payload: str = "payload") -> DataFrame:
    """stream_id, file_no, record_id, first, readable, field, kind, value, children of each field of each record.

    Readable is a text that parses as one JSON object; null, empty, cut-off and other texts aren't. A record without fields has one
    row with a null field, so that `first` marks each record once. kind is null for a JSON null. children: names and kinds of the
    fields of an object."""
    parsed = df.select("stream_id", "file_no", "record_id", F.when(F.col(f"`{payload}`").rlike(r"^[ \t\r\n]*\{"), F.try_parse_json(F.col(f"`{payload}`"))).alias("_v"))
    cells = df.sparkSession.sql("SELECT stream_id, file_no, record_id, coalesce(c.pos, 0) = 0 AS first, _v IS NOT NULL AS readable, c.key AS field, c.value AS _value FROM {view}, LATERAL variant_explode_outer(_v) AS c", view=parsed)
    cells = cells.withColumn("kind", _kind(F.col("_value")))
    nested = F.map_entries(F.when(F.col("kind") == "object", F.col("_value")).try_cast("map<string,variant>"))
    children = F.transform(nested, lambda e: F.struct(e["key"].alias("field"), _kind(e["value"]).alias("kind")))
    return cells.select("stream_id", "file_no", "record_id", "first", "readable", "field", "kind", F.col("_value").cast("string").alias("value"), children.alias("children"))


def file_schemas(cells: DataFrame) -> DataFrame:
    """stream_id, file_no, field, kind: the fields that more than half of a file's readable records have, null values included,
    with the kind of most of their non-null values (of equally many the first by name; null if all are null). A row with a null
    field stands for the file itself, so that files without fields are known."""
    kinds = sorted(set(KINDS.values()))
    by = ["stream_id", "file_no"]
    per = cells.groupBy(*by, "field").agg(F.count("*").alias("n"), F.count_if(F.col("first") & F.col("readable")).alias("_r"), *[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in kinds])
    best = F.greatest(*[F.col(f"_{k}") for k in kinds])
    kind = F.coalesce(*[F.when((best > 0) & (F.col(f"_{k}") == best), F.lit(k)) for k in kinds])
    # A file has as many rows here as names, so its names fit into one list.
    files = per.groupBy(*by).agg(F.sum("_r").alias("n_readable"), F.collect_list(F.struct("field", kind.alias("kind"), "n")).alias("_all"))
    some = F.filter("_all", lambda f: f["field"].isNotNull() & (f["n"] * 2 > F.col("n_readable")))
    own = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("kind")))
    return files.select(*by, F.inline(F.concat(own, F.transform(some, lambda f: F.struct(f["field"].alias("field"), f["kind"].alias("kind"))))))


def _same(value: Column) -> Column:
    """A value in a form in which a number equals its text."""
    number = value.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), number.cast("string")).otherwise(value)


def _grams(name: str) -> set[str]:
    s = f"^{name.lower()}$"
    return {s[i : i + 3] for i in range(len(s) - 2)} or {s}


def _likeness(a: str, b: str) -> float:
    both, either = _grams(a) & _grams(b), _grams(a) | _grams(b)
    return len(both) / len(either)


#: A field of a schema graph: its kind and its nested fields with their kinds.
Graph = dict[str, tuple[str, dict[str, str]]]


def flood(old: Graph, new: Graph, agree: dict[tuple[str, str], float], rounds: int = 200, settled: float = 1e-4) -> dict[tuple[str, str], float]:
    """Converged scores of the pairs of a field that only `old` has and one that only `new` has.

    Nodes of each graph: its root, fields, nested fields, kinds and values; edges: root to field, field to kind, to nested field
    and to its values, nested field to kind. A pair of nodes is linked to another where both graphs have an edge of that label; a
    pair's score flows in equal parts to its neighbours of each label, until no score moves by more than `settled`. Fields that
    both have are paired with themselves and anchor the kinds and the root. First scores: 1 for the same root, kind or field, the
    likeness of names for other fields, and `agree`, the share of equal values in common records, for a pair of value nodes."""
    first: dict[tuple, float] = {("root",): 1.0}
    edges: dict[tuple, list[tuple[str, tuple]]] = {}

    def link(label: str, a: tuple, b: tuple, score: float) -> None:
        first.setdefault(b, score)
        edges.setdefault(a, []).append((label, b))
        edges.setdefault(b, []).append((label + "^", a))

    wanted = [(f, g) for f in old if f not in new for g in new if g not in old]
    for f, g in wanted + [(f, f) for f in old if f in new]:
        (kind, inner), (kind2, inner2) = old[f], new[g]
        pair = ("field", f, g)
        link("field", ("root",), pair, 1.0 if f == g else 0.1 + 0.4 * _likeness(f, g))
        link("kind", pair, ("kind", kind, kind2), 1.0 if kind == kind2 else 0.0)
        link("value", pair, ("value", f, g), 1.0 if f == g else agree.get((f, g), 0.0))
        for x, k in inner.items():
            for y, m in inner2.items():
                below = ("nested", f, g, x, y)
                link("nested", pair, below, 1.0 if x == y else 0.1 + 0.4 * _likeness(x, y))
                link("kind", below, ("kind", k, m), 1.0 if k == m else 0.0)
    keys = list(first)
    index = {k: i for i, k in enumerate(keys)}
    rows, cols, weight = [], [], []
    for a, out in edges.items():
        count: dict[str, int] = {}
        for label, _ in out:
            count[label] = count.get(label, 0) + 1
        for label, b in out:
            rows.append(index[b]), cols.append(index[a]), weight.append(1.0 / count[label])
    start = np.array([first[k] for k in keys])
    score, rows, cols, weight = start.copy(), np.array(rows, int), np.array(cols, int), np.array(weight)
    for _ in range(rounds):
        base = start + score
        nxt = base + np.bincount(rows, weights=base[cols] * weight, minlength=len(keys))
        nxt /= nxt.max()
        moved, score = np.abs(nxt - score).max(), nxt
        if moved < settled:
            break
    return {p: float(score[index["field", *p]]) for p in wanted}


def choose(scores: dict[tuple[str, str], float], least: float = 0.5) -> list[tuple[str, str]]:
    """The pairs of a stable one-to-one match: the best pair first, each field once; equal scores by name. A pair that scores below
    `least` times the best pair of either of its fields is no correspondence."""
    top: dict[tuple[int, str], float] = {}
    for (a, b), s in scores.items():
        top[0, a], top[1, b] = max(top.get((0, a), 0.0), s), max(top.get((1, b), 0.0), s)
    used_a, used_b, out = set(), set(), []
    for (a, b), s in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if s > 0 and a not in used_a and b not in used_b and s >= least * max(top[0, a], top[1, b]):
            used_a.add(a), used_b.add(b), out.append((a, b))
    return out


_MATCHED = pa.schema([("stream_id", pa.string()), ("file_no", pa.int32()), ("field", pa.string()), ("new_field", pa.string())])
_LINEAGE = pa.schema([("stream_id", pa.string()), ("field", pa.string()), ("from_file", pa.int32()), ("to_file", pa.int32()), ("lineage", pa.string()), ("names", pa.list_(pa.string()))])


def _match(rows: pa.Table) -> pa.Table:
    """The correspondences of one file with the one before. Rows, told by `what`: `old` and `new` fields with kinds, `old+` and
    `new+` nested fields (new_field) with kinds, `same`: counts of equal values of an old and a new field."""
    r = rows.to_pylist()
    sides: dict[str, Graph] = {"old": {}, "new": {}}
    for x in r:
        if x["what"] in sides:
            sides[x["what"]][x["field"]] = (x["kind"] or "", {})
    for x in r:
        side = sides.get(x["what"][:-1], {})
        if x["field"] in side:
            side[x["field"]][1][x["new_field"]] = x["kind"] or ""
    seen = {(x["field"], x["new_field"]): (x["n_same"], x["n_both"]) for x in r if x["what"] == "same" and x["n_both"]}
    scores = flood(sides["old"], sides["new"], {p: same / both for p, (same, both) in seen.items()})
    # The exact check: most records of both files have the same value under both names.
    sure = [p for p in choose(scores) if p in seen and 2 * seen[p][0] > seen[p][1]]
    return pa.Table.from_pylist([{"stream_id": r[0]["stream_id"], "file_no": r[0]["file_no"], "field": f, "new_field": g} for f, g in sure], schema=_MATCHED)


def _common_records(sides: DataFrame) -> DataFrame:
    """(stream_id, file_no, field, new_field, n_both, n_same, n_like) from the records that agree in all fields both files have.

    sides: stream_id, file_no, record_id, side (0 old, 1 new), field, value, common. Records are never paired: of records with the
    same common fields, as many count as both files have, and of their values as many as are equal. n_like: of n_both, records whose
    common fields don't tell them from others of their file."""
    at = ["stream_id", "file_no"]
    own = F.when(F.col("common"), F.xxhash64("field", "value"))
    records = sides.groupBy(*at, "side", "record_id").agg(F.bit_xor(own).alias("_k"), F.sum(F.shiftright(own, 8)).alias("_s"), F.count(own).alias("_n"), F.collect_list(F.when(~F.col("common"), F.struct("field", "value"))).alias("_rest"))
    key = [*at, "_k", "_s", "_n"]
    # A record has a bounded number of fields; from here on only counts go on.
    each = records.where("_n > 0").select(*key, "side", F.inline("_rest")).groupBy(*key, "field", "value", "side").agg(F.count("*").alias("c"))
    each = each.groupBy(*key, "field", "side").agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("value", "c"))).alias("_values"))
    a = each.where("side = 0").select(*key, "field", F.col("c").alias("_ca"), F.col("_values").alias("_va"))
    b = each.where("side = 1").select(*key, F.col("field").alias("new_field"), F.col("c").alias("_cb"), F.col("_values").alias("_vb"))
    equal = F.aggregate(F.map_entries("_va"), F.lit(0).cast("bigint"), lambda n, e: n + F.least(e["value"], F.coalesce(F.try_element_at("_vb", e["key"]), F.lit(0))))
    return a.join(b, key).groupBy(*at, "field", "new_field").agg(F.sum(F.least("_ca", "_cb")).alias("n_both"), F.sum(equal).alias("n_same"), F.sum(F.when(F.greatest("_ca", "_cb") > 1, F.least("_ca", "_cb")).otherwise(0)).alias("n_like"))


def _linked_records(sides: DataFrame) -> DataFrame:
    """(stream_id, file_no, field, new_field, n_both, n_same) for files whose common fields, if any, don't tell their records apart: a
    record's partner is that with which it shares most values, and at least two, that are single in both files, whatever the
    fields' names."""
    at = ["stream_id", "file_no"]
    once = lambda k, rec: sides.where(F.col("side") == k).groupBy(*at, "value").agg(F.count("*").alias("_n"), F.min("record_id").alias(rec)).where("_n = 1").drop("_n")
    shared = once(0, "_a").join(once(1, "_b"), [*at, "value"]).groupBy(*at, "_a", "_b").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = shared.groupBy(*at, "_a").agg(F.max_by("_b", F.struct("_n", -F.col("_b"))).alias("_b"))
    own = lambda k, rec, field, value: sides.where((F.col("side") == k) & ~F.col("common")).select(*at, F.col("record_id").alias(rec), F.col("field").alias(field), F.col("value").alias(value))
    both = shared.join(own(0, "_a", "field", "_v"), [*at, "_a"]).join(own(1, "_b", "new_field", "_w"), [*at, "_b"])
    return both.groupBy(*at, "field", "new_field").agg(F.count("*").alias("n_both"), F.count_if(F.col("_v") == F.col("_w")).alias("n_same"))


def schema_changes(df: DataFrame, payload: str = "payload", cells: DataFrame | None = None) -> DataFrame:
    """(stream_id, file_no, change, field, new_field): changes of each file against file_no - 1 of its stream.

    df: stream_id, file_no, record_id, payload; cells: its written cells, where they are there already. Names compare exactly. A
    file whose predecessor isn't there has no changes; one without readable records has no fields. Null and unreadable payloads
    count as no record. Rows without stream or file number belong nowhere. An empty table gives no rows.
    """
    at = ["stream_id", "file_no"]
    cells = cells if cells is not None else as_table(record_cells(df, payload), "cells")  # read below by column and by file
    schemas = file_schemas(cells.where(F.col("stream_id").isNotNull() & F.col("file_no").isNotNull()))
    # Each field of a file stands beside that of the file before: one exchange, no self-join.
    twice = schemas.select("stream_id", F.inline(F.array(F.struct("file_no", F.lit(1).alias("side")), F.struct((F.col("file_no") + 1).alias("file_no"), F.lit(0).alias("side")))), "field", "kind")
    side = lambda k, c: F.max(F.when(F.col("side") == k, c))
    diff = twice.groupBy(*at, "field").agg(side(0, F.col("kind")).alias("old_kind"), side(1, F.col("kind")).alias("kind"), side(0, F.lit(1)).alias("_old"), side(1, F.lit(1)).alias("_new"))
    row = F.struct("field", "old_kind", "kind", "_old", "_new")
    pairs = diff.groupBy(*at).agg(F.collect_list(F.when(F.col("field").isNotNull(), row)).alias("_f"), F.count_if(F.col("field").isNull() & F.col("_old").isNotNull() & F.col("_new").isNotNull()).alias("_known")).where("_known > 0")
    is_lost, is_gained = (lambda f: f["_new"].isNull()), (lambda f: f["_old"].isNull())
    pairs = cut_lineage(pairs.select(*at, "_f", (F.exists("_f", is_lost) & F.exists("_f", is_gained)).alias("_both")))
    diff = pairs.select(*at, F.inline("_f"))

    # Only files that lost and gained fields are matched; only they need evidence from records.
    asked = pairs.where("_both")
    known = asked.select(*at, F.transform(F.filter("_f", lambda f: (f["kind"] == f["old_kind"]) | (f["kind"].isin("number", "text") & f["old_kind"].isin("number", "text"))), lambda f: f["field"]).alias("_same"), F.transform(F.filter("_f", lambda f: is_lost(f) | is_gained(f)), lambda f: f["field"]).alias("_apart"))
    roles = known.select("stream_id", F.inline(F.array(F.struct(F.col("file_no").alias("_of"), "file_no", F.lit(1).alias("side")), F.struct((F.col("file_no") - 1).alias("_of"), "file_no", F.lit(0).alias("side")))), "_same", "_apart")
    roles = broadcast_if_small(roles.withColumnRenamed("file_no", "_at"), 100_000)  # else all cells would be shuffled
    met = cells.where(F.col("field").isNotNull()).withColumnRenamed("file_no", "_of").join(roles, ["stream_id", "_of"]).withColumnRenamed("_at", "file_no")
    met = met.withColumns({"common": F.array_contains("_same", F.col("field")), "_part": F.array_contains("_apart", F.col("field"))})
    sides = met.where((F.col("common") | F.col("_part")) & F.col("kind").isNotNull()).select(*at, "record_id", "side", "field", _same(F.col("value")).alias("value"), "common")
    evidence = cut_lineage(_common_records(sides))
    # Files without such records, or where they are too alike to settle a pair, are read once more.
    settled = evidence.groupBy(*at).agg(F.bool_and((2 * F.col("n_same") > F.col("n_both")) | (2 * F.col("n_like") <= F.col("n_both"))).alias("_sure")).where("_sure").drop("_sure")
    rest = asked.select(*at).join(settled, at, "left_anti")
    if not rest.isEmpty():
        few = broadcast_if_small(rest, 100_000)
        evidence = evidence.join(settled, at, "left_semi").select(*at, "field", "new_field", "n_both", "n_same").unionByName(_linked_records(sides.join(few, at, "left_semi")))
    nested = met.where(F.col("kind") == "object").select(*at, "side", "field", F.inline("children").alias("new_field", "_k")).groupBy(*at, "side", "field", "new_field").agg(F.mode("_k", True).alias("kind"))
    what = lambda text: F.lit(text).alias("what")
    fields = asked.select(*at, F.inline("_f"))
    nodes = fields.where("_old = 1").select(*at, what("old"), "field", F.col("old_kind").alias("kind")).unionByName(fields.where("_new = 1").select(*at, what("new"), "field", "kind"))
    nodes = nodes.unionByName(nested.select(*at, F.when(F.col("side") == 0, "old+").otherwise("new+").alias("what"), "field", "new_field", "kind"), allowMissingColumns=True)
    nodes = nodes.unionByName(evidence.withColumn("what", F.lit("same")), allowMissingColumns=True)
    renamed = cut_lineage(nodes.groupBy(*at).applyInArrow(_match, "stream_id string, file_no int, field string, new_field string"))

    plain = lambda rows, change: rows.select(*at, F.lit(change).alias("change"), "field", F.lit("").alias("new_field"))
    gone = plain(diff.where("_new IS NULL").join(renamed, [*at, "field"], "left_anti"), "removed")
    come = plain(diff.where("_old IS NULL").join(renamed.select(*at, F.col("new_field").alias("field")), [*at, "field"], "left_anti"), "added")
    retyped = plain(diff.where("_old = 1 AND _new = 1 AND kind <> old_kind"), "retyped")
    return gone.unionByName(come).unionByName(retyped).unionByName(renamed.select(*at, F.lit("renamed").alias("change"), "field", "new_field"))


def _lineages(rows: pa.Table) -> pa.Table:
    """The lineages of a stream's fields: each name with the files in which it stands for a lineage, and all names the lineage had.
    A lineage is called by its first name; a name used again for another field starts a lineage of its own, told by the file."""
    r = sorted(rows.to_pylist(), key=lambda x: (x["file_no"], x["change"] != "removed", x["change"] != "renamed", x["field"]))
    now: dict[str, str] = {}  # name to lineage
    since: dict[str, int | None] = {}
    names: dict[str, list[str]] = {}
    out = []

    def begin(name: str, at: int | None) -> None:
        lineage = name if name not in names else f"{name}@{at}"
        names[lineage], now[name], since[name] = [name], lineage, at

    def end(name: str, at: int) -> str:
        if name not in now:
            begin(name, None)  # there from the start
        out.append((name, since.pop(name), at - 1, now[name]))
        return now.pop(name)

    i = 0
    while i < len(r):
        at = r[i]["file_no"]
        step = []
        while i < len(r) and r[i]["file_no"] == at:
            step.append(r[i])
            i += 1
        for x in step:
            if x["change"] == "removed":
                end(x["field"], at)
        moved = [(x["new_field"], end(x["field"], at)) for x in step if x["change"] == "renamed"]
        for name, lineage in moved:
            now[name], since[name] = lineage, at
            names[lineage].append(name)
        for x in step:
            if x["change"] == "added" and x["field"] not in now:
                begin(x["field"], at)
    out += [(name, since[name], None, lineage) for name, lineage in now.items()]
    stream = r[0]["stream_id"]
    return pa.Table.from_pylist([{"stream_id": stream, "field": n, "from_file": a, "to_file": b, "lineage": x, "names": names[x]} for n, a, b, x in out], schema=_LINEAGE)


def unify(df: DataFrame, changes: DataFrame, targets: dict[str, tuple[str, tuple[str, ...]]], payload: str = "payload", cells: DataFrame | None = None) -> DataFrame:
    """One row for each record of df: record_id, stream_id, file_no, the target columns and `fields`, the rest by lineage as texts.

    targets: column to (type, names). A field belongs to the target that one of its lineage's names stands for (letters and
    digits compared, case ignored; earlier names first); its value is cast, null where it can't be. Lineages hold for the files
    between a field's coming and going, so a name that is used again later isn't taken for the old field; names outside of their
    lineage's files, as in single stray records, stand for themselves. Unreadable records keep a row with nulls and an empty map.
    A stream's changes, a small part of its records, are followed in order in one group.
    """
    cells = cells if cells is not None else as_table(record_cells(df, payload), "cells")
    moves = changes.where(F.col("change").isin("renamed", "removed", "added"))
    lineage = moves.groupBy("stream_id").applyInArrow(_lineages, "stream_id string, field string, from_file int, to_file int, lineage string, names array<string>")
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    rank = lambda c, names: F.coalesce(*[F.when(plain(c) == n.lower(), F.lit(i)) for i, n in enumerate(names)])
    lineage = lineage.select("stream_id", "field", "from_file", "to_file", "lineage", *[F.array_min(F.transform("names", lambda c: rank(c, names))).alias(f"_rank_{t}") for t, (_, names) in targets.items()])  # noqa: B023
    lineage = broadcast_if_small(cut_lineage(lineage.groupBy("stream_id", "field").agg(F.collect_list(F.struct("from_file", "to_file", "lineage", *[f"_rank_{t}" for t in targets])).alias("_spans"))), 100_000)
    met = cells.where(F.col("field").isNotNull()).join(lineage, ["stream_id", "field"], "left")
    own = F.filter("_spans", lambda x: (x["from_file"].isNull() | (x["from_file"] <= F.col("file_no"))) & (x["to_file"].isNull() | (x["to_file"] >= F.col("file_no"))))
    met = met.withColumn("_own", F.try_element_at(own, F.lit(1))).withColumns({"lineage": F.coalesce("_own.lineage", "field")} | {f"_rank_{t}": F.coalesce(f"_own._rank_{t}", rank(F.col("field"), names)) for t, (_, names) in targets.items()})
    values = [F.min_by(F.col("value"), F.when(F.col(f"_rank_{t}").isNotNull() & F.col("kind").isNotNull(), F.struct(f"_rank_{t}", "field"))).try_cast(kind).alias(t) for t, (kind, _) in targets.items()]
    other = F.when(F.coalesce(*[F.col(f"_rank_{t}") for t in targets]).isNull() & F.col("value").isNotNull(), F.struct("lineage", "field", "value"))
    rows = met.groupBy("record_id").agg(*values, F.array_sort(F.collect_list(other)).alias("_rest"))
    first = F.aggregate("_rest", F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["lineage"]), m).otherwise(F.map_concat(m, F.create_map(x["lineage"], x["value"]))))
    rows = rows.select("record_id", *targets, first.alias("fields"))
    return df.select("record_id", "stream_id", "file_no").join(rows, "record_id", "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
