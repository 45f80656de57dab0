"""Problem 7: schemas that drift between the files of a feed.

A first pass counts, for each file, how many readable records hold each field with each type:
the counts are made in the map tasks, so what is shuffled has the size of the schemas. A
window over a feed's files (one narrow row a file) finds the file before; one row for each
pair of neighbouring files then holds both schemas.

Only files of pairs in which a field left and another came are read again. Their documents
are linked by marks that at most two different documents of either file hold: every value,
whatever its type and length, and combinations of the fields both schemas have (three disjoint groups
of them, and all), which link documents whose single values are all common, even if some
of them changed. Repeated copies of a record are one document. Marks are counted by partial
aggregation on (pair, mark), so a hot feed or file is spread over all tasks.

Renames are found by similarity flooding over the schema graphs of names, types and nesting
of each pair: match scores start from how alike names are and how often values agree on the
linked documents, spread along the edges until they converge, and the stable one-to-one
matching of the fields that left with those that came is taken. A match is a rename if, as the
definition wants, the values agree for most linked documents; else the fields came and left.

Unreadable payloads (cut off, no JSON object, null) are left out everywhere, and records without a file name. A null
feed is the feed ''. A field whose values are null is not held. Repeated records count as often as they stand in the
file; ties between types go to string, number, boolean, array in this order. A feed's first
file has no changes; files without a readable record are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from loomline.session import checkpointed, scattered, spread

TYPES = ("string", "number", "boolean", "array")
#: A field belongs to a file if so many of its records hold it.
HELD = 0.5
#: Groups the fields both schemas have are divided into for marks of combinations.
GROUPS = 3
#: Share of linked documents whose values agree for a rename, and how many of them at least.
AGREEING, LEAST_AGREEING = 0.5, 2
#: Distinct field names the mediated schema may have; more means the payloads are no records.
MOST_FIELDS = 5000
#: Bytes of what is sent to every executor at most; beyond, the files' rows are joined.
MOST_BROADCAST = 16_000_000


def _refuse(constant: str):
    raise ValueError(constant)


def _record(payload) -> dict | None:
    """The object a payload holds, None if it cannot be read."""
    try:
        record = json.loads(payload, parse_constant=_refuse)
    except (TypeError, ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _kind(value) -> int:
    """The number of a value's type in TYPES."""
    if isinstance(value, str):
        return 0
    if isinstance(value, bool):
        return 2
    return 1 if isinstance(value, (int, float)) else 3


def _walk(record: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    for key, value in record.items():
        if isinstance(value, dict):
            yield from _walk(value, f"{prefix}{key}.")
        elif value is not None:
            yield prefix + key, value


def _mark(value) -> int:
    """64 bits of a value; numbers are equal to their text, as a rename may change the type."""
    if isinstance(value, str):
        text = value
    elif isinstance(value, float) and value.is_integer():
        text = str(int(value))
    else:
        text = json.dumps(value, ensure_ascii=False, sort_keys=True)
    return xxh64_intdigest(text.encode("utf-8", "replace")) - 2**63


def _narrow(records: DataFrame) -> DataFrame:
    return records.where("payload is not null and file_name is not null").select(F.coalesce("feed", F.lit("")).alias("feed"), "file_name", "payload")


def field_counts(records: DataFrame) -> DataFrame:
    """(feed, file_name, path, n, n_string, ...): records holding each field, and with a null path all readable ones."""
    names = ["n", *(f"n_{t}" for t in TYPES)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            files: dict[tuple, dict] = {}
            for feed, name, payload in zip(pdf["feed"], pdf["file_name"], pdf["payload"]):
                record = _record(payload)
                if record is None:
                    continue
                counts = files.setdefault((feed, name), {})
                counts.setdefault(None, [0] * 5)[0] += 1
                for path, value in _walk(record):
                    own = counts.get(path)
                    if own is None:
                        own = counts[path] = [0] * 5
                    own[0] += 1
                    own[1 + _kind(value)] += 1
            rows = [(*file, path, *n) for file, counts in files.items() for path, n in counts.items()]
            yield pd.DataFrame(rows, columns=["feed", "file_name", "path", *names])

    counted = spread(_narrow(records)).mapInPandas(run, "feed string, file_name string, path string, " + ", ".join(f"{n} bigint" for n in names))
    return counted.groupBy("feed", "file_name", "path").agg(*[F.sum(n).alias(n) for n in names])


def schema_pairs(counts: DataFrame) -> DataFrame:
    """(feed, file_name, before, fields): each file with the readable one before it by the time in its name; fields are (path, old_type, new_type)."""
    time = F.regexp_extract("file_name", r"(\d{8}_\d{6})\D*$", 1)
    order = Window.partitionBy("feed").orderBy(time, "file_name")
    files = counts.where("path is null").select(
        "feed", "file_name", F.col("n").alias("n_records"), F.lag("file_name").over(order).alias("before"), F.lead("file_name").over(order).alias("after")
    )
    held = counts.where("path is not null").join(files, ["feed", "file_name"]).where(F.col("n") >= HELD * F.col("n_records"))
    most = F.greatest(*[F.col(f"n_{t}") for t in TYPES])
    kind = F.coalesce(*[F.when(F.col(f"n_{t}") == most, t) for t in TYPES])
    nothing = F.lit(None).cast("string")
    sides = F.array(
        F.struct(F.col("before").alias("before"), F.when(F.col("before").isNotNull(), F.col("file_name")).alias("file_name"), nothing.alias("old_type"), kind.alias("new_type")),
        F.struct(F.col("file_name").alias("before"), F.col("after").alias("file_name"), kind.alias("old_type"), nothing.alias("new_type")),
    )
    rows = held.select("feed", "path", F.inline(sides)).where("file_name is not null")
    fields = rows.groupBy("feed", "file_name", "before", "path").agg(F.max("old_type").alias("old_type"), F.max("new_type").alias("new_type"))
    pairs = fields.groupBy("feed", "file_name", "before").agg(F.array_sort(F.collect_list(F.struct("path", "old_type", "new_type"))).alias("fields"))
    return pairs


def _paths(fields: Column, keep) -> Column:
    return F.transform(F.filter(fields, keep), lambda x: x["path"])


def _left(x: Column) -> Column:
    return x["new_type"].isNull()


def _came(x: Column) -> Column:
    return x["old_type"].isNull()


def _sightings(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(feed, pair, is_new, doc, marks, moved, values): a record in the part it plays in a pair where fields both left and came."""
    open_pairs = pairs.where(F.exists("fields", _left) & F.exists("fields", _came))
    kept = _paths(F.col("fields"), lambda x: ~_left(x) & ~_came(x))
    part = lambda file, is_new, moved: F.struct(
        F.col(file).alias("file_name"), F.struct(F.col("file_name").alias("pair"), F.lit(is_new).alias("is_new"), _paths(F.col("fields"), moved).alias("moved"), kept.alias("kept")).alias("part")
    )
    parts = open_pairs.select("feed", F.inline(F.array(part("file_name", True, _came), part("before", False, _left))))
    parts = parts.groupBy("feed", "file_name").agg(F.to_json(F.collect_list("part")).alias("parts"))
    size = parts.agg(F.sum(F.length("parts") + F.length("feed") + F.length("file_name"))).collect()[0][0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, known = None, []
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for feed, payload, text in zip(*(batch.column(c).to_pylist() for c in ("feed", "payload", "parts"))):
                record = _record(payload)
                if record is None:
                    continue
                if text != read:
                    read, known = text, json.loads(text)
                held = {path: _mark(value) for path, value in _walk(record)}
                doc = xxh64_intdigest(payload.encode("utf-8", "replace")) - 2**63
                for p in known:
                    own = [(k, held[path]) for k, path in enumerate(p["kept"]) if path in held]
                    marks = set(held.values())
                    if len(own) > 1:
                        marks.add(hash(tuple(own)))  # of numbers, the same in every process
                        if len(own) >= 2 * GROUPS:
                            marks.update(hash(tuple(own[k::GROUPS])) for k in range(GROUPS))
                    moved = [k for k, path in enumerate(p["moved"]) if path in held]
                    for column, value in zip(out, (feed, p["pair"], p["is_new"], doc, list(marks), moved, [held[p["moved"][k]] for k in moved])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SIGHTING_TYPES)], list(_SIGHTING))

    rows = _narrow(records).join(F.broadcast(parts) if size <= MOST_BROADCAST else parts, ["feed", "file_name"]).select("feed", "payload", "parts")
    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in _SIGHTING.items()))


_SIGHTING = {"feed": "string", "pair": "string", "is_new": "boolean", "doc": "bigint", "marks": "array<bigint>", "moved": "array<int>", "values": "array<bigint>"}
_SIGHTING_TYPES = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))


def _agreements(sightings: DataFrame) -> DataFrame:
    """(feed, pair, agreements): (left, came, n_both, n_same) over the documents found in both files, fields by their numbers among those that left or came."""
    side = lambda f, is_new: f(F.when(F.col("is_new") == is_new, F.col("doc")))
    marks = sightings.select("feed", "pair", "is_new", "doc", F.explode("marks").alias("mark"))
    seen = marks.groupBy("feed", "pair", "mark").agg(
        *[side(f, new).alias(f"{name}_{at}") for name, new in (("old", False), ("new", True)) for at, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
    )
    rare = lambda name: (F.col(f"{name}_lo") == F.col(f"{name}_hi")) | (F.col(f"{name}_n") == 2)
    either = lambda name: F.explode(F.array_distinct(F.array(f"{name}_lo", f"{name}_hi")))
    shared = seen.where((F.col("old_n") > 0) & (F.col("new_n") > 0) & rare("old") & rare("new")).select("feed", "pair", either("old").alias("old_doc"), "new_lo", "new_hi")
    shared = shared.select("feed", "pair", "old_doc", either("new").alias("new_doc")).repartition("feed", "pair", "old_doc")
    votes = shared.groupBy("feed", "pair", "old_doc", "new_doc").agg(F.count(F.lit(1)).alias("votes"))
    links = votes.groupBy("feed", "pair", "old_doc").agg(F.max_by("new_doc", F.struct("votes", "new_doc")).alias("new_doc"))

    def fields(is_new: bool, name: str) -> DataFrame:  # copies of a record are one document
        held = F.arrays_zip("moved", "values")
        return sightings.where(F.col("is_new") == is_new).groupBy("feed", "pair", F.col("doc").alias(f"{name}_doc")).agg(F.first(held).alias(f"{name}_fields"))

    both = links.join(fields(False, "old"), ["feed", "pair", "old_doc"]).join(fields(True, "new"), ["feed", "pair", "new_doc"])
    crossed = both.select("feed", "pair", F.explode("old_fields").alias("o"), "new_fields").select("feed", "pair", "o", F.explode("new_fields").alias("n"))
    met = crossed.groupBy("feed", "pair", F.col("o.moved").alias("left"), F.col("n.moved").alias("came")).agg(
        F.count(F.lit(1)).alias("n_both"), F.count_if(F.col("o.values") == F.col("n.values")).alias("n_same")
    )
    return met.groupBy("feed", "pair").agg(F.collect_list(F.struct("left", "came", "n_both", "n_same")).alias("agreements"))


def _grams(name: str) -> set[str]:
    name = f"  {name.lower()} "
    return {name[k : k + 3] for k in range(len(name) - 2)}


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the trigrams of the last parts of two paths."""
    x, y = _grams(a.rsplit(".", 1)[-1]), _grams(b.rsplit(".", 1)[-1])
    return 2 * len(x & y) / (len(x) + len(y))


class _Graph:
    """A schema as incidence matrices: fields to types, fields to the objects they stand in, objects to theirs."""

    def __init__(self, schema: dict[str, str]):
        self.paths = sorted(schema)
        self.types = sorted(set(schema.values()))
        self.objects = sorted({"", *(p[:k] for p in self.paths for k, c in enumerate(p) if c == ".")})
        at = {o: k for k, o in enumerate(self.objects)}
        outer = lambda p: at[p.rpartition(".")[0]]
        self.has_type = np.array([[float(schema[p] == t) for t in self.types] for p in self.paths]).reshape(len(self.paths), len(self.types))
        self.inside = np.zeros((len(self.paths), len(self.objects)))
        self.nested = np.zeros((len(self.objects), len(self.objects)))
        for k, p in enumerate(self.paths):
            self.inside[k, outer(p)] = 1.0
        for k, o in enumerate(self.objects):
            if o:
                self.nested[k, outer(o)] = 1.0


def flood(old: dict[str, str], new: dict[str, str], agreement: dict[tuple[str, str], float], rounds: int = 100, eps: float = 1e-4) -> dict[tuple[str, str], float]:
    """Scores of all (old path, new path) after similarity flooding over the two schema graphs.

    Nodes are fields, the objects they are nested in and their types; edges are "nested in"
    and "has type". The edges of the pairwise connectivity graph carry the inverse of the
    number of like edges at the pair, and each round adds what flows in to the start scores.
    """
    if not old or not new:
        return {}
    a, b = _Graph(old), _Graph(new)
    start_f = np.array([[0.3 * name_similarity(p, q) + 0.7 * agreement.get((p, q), 0.0) + 0.3 * (p == q) for q in b.paths] for p in a.paths])
    start_o = np.array([[0.5 * (x == y) for y in b.objects] for x in a.objects])
    start_t = np.array([[0.5 * (x == y) for y in b.types] for x in a.types])
    of_type = np.outer(a.has_type.sum(0), b.has_type.sum(0))  # edges at a pair of types, of objects
    at_object = np.outer(a.inside.sum(0), b.inside.sum(0)) + np.outer(a.nested.sum(0), b.nested.sum(0)) + np.outer(a.nested.sum(1), b.nested.sum(1))
    at_object[at_object == 0] = 1.0
    top = max(start_f.max(), start_o.max(), start_t.max()) or 1.0
    f, o, t = start_f / top, start_o / top, start_t / top
    for _ in range(rounds):
        out_o, out_t = o / at_object, t / of_type
        flow_f = a.has_type @ out_t @ b.has_type.T + a.inside @ out_o @ b.inside.T
        flow_t = a.has_type.T @ f @ b.has_type
        flow_o = a.inside.T @ f @ b.inside + a.nested.T @ out_o @ b.nested + a.nested @ out_o @ b.nested.T
        after = [start + now + 0.25 * flow for start, now, flow in ((start_f, f, flow_f), (start_o, o, flow_o), (start_t, t, flow_t))]
        top = max(x.max() for x in after) or 1.0
        after = [x / top for x in after]
        change = max(np.abs(x - y).max() for x, y in zip(after, (f, o, t)))
        f, o, t = after
        if change < eps:
            break
    return {(p, q): float(f[j, k]) for j, p in enumerate(a.paths) for k, q in enumerate(b.paths)}


def matching(old: dict[str, str], new: dict[str, str], agreement: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The stable matching of the fields that left with those that came: by flooded score, best first, one to one."""
    scores = flood(old, new, agreement)
    free = sorted((-s, p) for p, s in scores.items() if p[0] not in new and p[1] not in old)
    found: list[tuple[str, str]] = []
    taken_old, taken_new = set(), set()
    for _, (a, b) in free:
        if a not in taken_old and b not in taken_new:
            found.append((a, b))
            taken_old.add(a)
            taken_new.add(b)
    return found


def correspondences(old: dict[str, str], new: dict[str, str], counts: dict[tuple[str, str], tuple[int, int]]) -> list[tuple[str, str]]:
    """(old path, new path) of the renames: the matched fields whose values agree for most documents."""
    agreement = {k: same / both for k, (both, same) in counts.items() if both}
    agrees = lambda p: agreement.get(p, 0.0) > AGREEING and counts[p][1] >= min(LEAST_AGREEING, counts[p][0])
    return [p for p in matching(old, new, agreement) if agrees(p)] if agreement else []


def changes(records: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(feed, file_name, change, field, old_field): what each file changed against the one before it."""
    pairs = checkpointed(schema_pairs(checkpointed(field_counts(records)) if counts is None else counts))
    met = _agreements(checkpointed(_sightings(records, pairs))).withColumnRenamed("pair", "file_name")
    rows = pairs.join(met, ["feed", "file_name"], "left").select("feed", "file_name", F.to_json("fields").alias("fields"), F.to_json("agreements").alias("agreements"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for feed, name, fields, agreements in zip(pdf["feed"], pdf["file_name"], pdf["fields"], pdf["agreements"]):
                fields = json.loads(fields)
                old = {x["path"]: x["old_type"] for x in fields if x.get("old_type")}
                new = {x["path"]: x["new_type"] for x in fields if x.get("new_type")}
                left, came = [p for p in old if p not in new], [p for p in new if p not in old]
                found = []
                if agreements:
                    found = correspondences(old, new, {(left[x["left"]], came[x["came"]]): (x["n_both"], x["n_same"]) for x in json.loads(agreements)})
                settled = {p for pair in found for p in pair}
                out += [(feed, name, "renamed", b, a) for a, b in found]
                out += [(feed, name, "added", p, "") for p in came if p not in settled]
                out += [(feed, name, "removed", p, "") for p in left if p not in settled]
                out += [(feed, name, "type_changed", p, "") for p in old if p in new and old[p] != new[p]]
            yield pd.DataFrame(out, columns=["feed", "file_name", "change", "field", "old_field"], dtype=object)

    # the flooding costs much CPU for few bytes
    return scattered(rows, "feed", "file_name").mapInPandas(run, "feed string, file_name string, change string, field string, old_field string")


def _groups(edges: list[tuple[str, str]], common: dict[str, int]) -> dict[str, str]:
    """The name of the group of each path renames connect: its path most records hold."""
    group: dict[str, set[str]] = {}
    for a, b in sorted(edges):
        joined = group.get(a, {a}) | group.get(b, {b})
        group.update(dict.fromkeys(joined, joined))
    return {p: min(paths, key=lambda x: (-common.get(x, 0), x)) for p, paths in group.items()}


def _field_maps(counts: DataFrame, found: DataFrame, common: dict[str, int]) -> tuple[dict[str, str], DataFrame]:
    """The column of each renamed path, and (feed, names) for the feeds in which another map holds.

    Paths renames connect in any feed share a column, unless two of them are fields of one
    file: in such a feed they are different things, and only its own renames hold for them.
    """
    renames = found.where("change = 'renamed'").groupBy("feed", "old_field", "field").agg(F.count(F.lit(1)).alias("n"))
    renames = checkpointed(renames)
    edges = renames.select("old_field", "field").distinct().limit(MOST_FIELDS + 1).collect()
    if len(edges) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} renames")
    everywhere = _groups([(e.old_field, e.field) for e in edges], common)
    if not everywhere:
        return {}, renames.select("feed", F.lit("").alias("names")).limit(0)
    sizes = counts.where("path is null").select("feed", "file_name", F.col("n").alias("n_records"))
    group = F.try_element_at(F.create_map(*[F.lit(x) for pair in everywhere.items() for x in pair]), "path")
    held = counts.where(F.col("path").isin(*everywhere)).join(sizes, ["feed", "file_name"]).where(F.col("n") >= HELD * F.col("n_records"))
    apart = held.groupBy("feed", "file_name", group.alias("name")).count().where("count > 1").groupBy("feed").agg(F.collect_set("name").alias("apart"))
    own = renames.groupBy("feed").agg(F.collect_set(F.struct("old_field", "field")).alias("edges"))
    rows = apart.join(own, "feed", "left").select("feed", F.to_json("apart").alias("apart"), F.to_json("edges").alias("edges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for feed, apart, edges in zip(pdf["feed"], pdf["apart"], pdf["edges"]):
                apart = set(json.loads(apart))
                names = {p: c for p, c in everywhere.items() if c not in apart}
                for p, c in _groups([(e["old_field"], e["field"]) for e in json.loads(edges or "[]")], common).items():
                    if everywhere[p] in apart:
                        names[p] = c
                out.append((feed, json.dumps(names, sort_keys=True)))
            yield pd.DataFrame(out, columns=["feed", "names"], dtype=object)

    return everywhere, rows.mapInPandas(run, "feed string, names string")


def _quoted(path: str) -> str:
    return ".".join(f"`{x.replace('`', '``')}`" for x in path.split("."))


def _leaf_values(payload: Column, paths: list[str]) -> tuple[Column, dict[str, Column]]:
    """A column that parses a payload once, to stand as __p, and the values of the paths in it as text.

    A path that is a value in some records and an object in others is taken from the parsed variant instead.
    """
    objects = {p[:k] for p in paths for k, c in enumerate(p) if c == "."}
    tree: dict = {}
    for p in paths:
        if p not in objects:
            node = tree
            *outer, leaf = p.split(".")
            for part in outer:
                node = node.setdefault(part, {})
            node[leaf] = None

    def ddl(node: dict) -> str:
        return ", ".join(f"`{k.replace('`', '``')}`: " + (f"struct<{ddl(v)}>" if v else "string") for k, v in node.items())

    values = {}
    for p in paths:
        if p in objects:
            at = F.try_variant_get(F.try_parse_json(payload), "$" + "".join(f"[{json.dumps(x, ensure_ascii=False)}]" for x in p.split(".")), "variant")
            values[p] = F.when(~F.schema_of_variant(at).startswith("OBJECT"), at.try_cast("string"))
        else:
            values[p] = F.col(f"__p.{_quoted(p)}")
    return F.from_json(payload, f"struct<{ddl(tree)}>") if tree else F.lit(None), values


def consistent_table(records: DataFrame) -> DataFrame:
    """All readable records in one table: record_id, feed, file_name, position, then the mediated columns.

    Paths renames connect share the column named after the one most records hold, but for
    feeds in whose files two of them are fields at once. A record that holds two paths of one column keeps both values:
    the column takes that of its own name, or else of the first name, and the other stands in a
    column of its own. Each payload is parsed once, natively, with a schema of the known paths;
    a column has the type most of its values have (numbers as double, arrays as JSON text).
    Values that cannot be cast are null.

    Only distinct field names and columns come to the driver; both are counted first.
    """
    counts = checkpointed(field_counts(records))
    of_types = [F.sum(f"n_{t}").alias(t) for t in TYPES]
    names = counts.where("path is not null").groupBy("path").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "path").limit(MOST_FIELDS + 1).collect()
    if len(names) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} field names")
    common = {r.path: r.n for r in names}
    everywhere, maps = _field_maps(counts, changes(records, counts), common)
    maps = checkpointed(maps)
    readable = records.where("file_name is not null and try_parse_json(payload) is not null and ltrim(payload) like '{%'")
    fixed = ["record_id", "feed", "file_name", "position"]
    if not names:
        return readable.select(*fixed)
    # which paths share a column somewhere, and the types of what stands in each column
    shared = maps.select(F.explode(F.from_json("names", "map<string,string>")).alias("path", "column")).distinct().limit(MOST_FIELDS + 1).collect()
    into: dict[str, list[str]] = {}
    for path, name in sorted({*everywhere.items(), *((r.path, r.column) for r in shared)}):
        if path != name:
            into.setdefault(name, []).append(path)
    size = maps.agg(F.sum(F.length("names"))).collect()[0][0] or 0
    maps = maps.select(F.col("feed").alias("__feed"), F.from_json("names", "map<string,string>").alias("__names"))
    maps = F.broadcast(maps) if size <= MOST_BROADCAST else maps
    always = F.create_map(*[F.lit(x) for pair in everywhere.items() for x in pair]) if everywhere else F.lit(None).cast("map<string,string>")
    named = lambda df: df.join(maps, F.coalesce("feed", F.lit("")) == F.col("__feed"), "left").withColumn("__names", F.coalesce("__names", always))
    column = F.coalesce(F.try_element_at("__names", "path"), "path")
    kinds = {r.column: r for r in named(counts.where("path is not null")).groupBy(column.alias("column")).agg(*of_types).collect()}

    parsed, values = _leaf_values(F.col("payload"), sorted(common))
    rows = named(readable.withColumn("__p", parsed))
    goes = lambda p: F.coalesce(F.try_element_at("__names", F.lit(p)), F.lit(p))
    takes = {c: [p for p in [c, *sorted(into[c])] if p in values] for c in into}
    winner = {c: F.coalesce(*[F.when((goes(p) == c) & values[p].isNotNull(), F.lit(p)) for p in takes[c]]) for c in into}
    moves = sorted({p for paths in into.values() for p in paths})
    displaced = {p: values[p].isNotNull() & (goes(p) != p) & F.coalesce(*[F.when(goes(p) == c, winner[c] != p) for c in into if p in into[c]], F.lit(False)) for p in moves}
    left_over = rows.agg(*[F.count_if(displaced[p]).alias(f"c{k}") for k, p in enumerate(moves)]).collect()[0] if moves else []
    columns = sorted({*kinds, *(p for p, n in zip(moves, left_over) if n)})
    cast = {"number": "double", "boolean": "boolean"}
    taken, out = set(fixed), []
    for c in columns:
        own = F.coalesce(*[F.when(goes(p) == c, values[p]) for p in takes[c]]) if c in into else values[c]
        if c in displaced:  # unless it goes to another column of this record's feed
            own = F.when((goes(c) == c) | displaced[c], own if c not in into else F.coalesce(own, values[c]))
        kind = max(TYPES, key=lambda t: (kinds[c][t], -TYPES.index(t))) if c in kinds else "string"
        name = c.replace(".", "_")
        while name in taken:
            name += "_"
        taken.add(name)
        out.append((own.try_cast(cast[kind]) if kind in cast else own).alias(name))
    return rows.select(*fixed, *out)
