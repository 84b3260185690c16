"""Schemas that drift between files: fingerprints, changes, and one consistent table.

Each file of a source is reduced to a fingerprint (its field paths with the types seen), which a
registry keeps, so that a file is read for it once. Comparing a file with its predecessor gives the
migration step: fields added, removed, renamed or retyped. The renames of a source chain the names a
field had over time into one line; a line leads to the target field that one of its names spells.
So every file has rules of its own, rename, default and cast, which route its records to the target schema.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.neighbours import with_previous
from folioscope.runtime import read_text, scratch_path, spread, write_lines, written

#: Files of a source whose names are chained together before the blocks are.
BLOCK = 1024

#: Type names of leaves; booleans are not integers, and 3.0 is a decimal number.
_KINDS = {bool: "boolean", int: "integer", float: "decimal", list: "list", str: "string"}


def kind_of(value: object) -> str:
    return _KINDS[type(value)]


def parse_object(text: str | None) -> dict | None:
    """The JSON object in ``text``, or None when it cannot be read or is no object."""
    if text is None:
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def leaves(record: dict) -> Iterator[tuple[str, object]]:
    """Dotted paths of all non-null leaves. Lists are leaves, objects never are."""
    stack = [("", record)]
    while stack:
        prefix, node = stack.pop()
        for name, value in node.items():
            if isinstance(value, dict):
                stack.append((f"{prefix}{name}.", value))
            elif value is not None:
                yield prefix + name, value


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


@dataclass(frozen=True)
class Feed:
    """Names of the columns of a table of raw records."""

    source: str = "scanner"
    position: str = "seq_no"
    file: str = "file_id"
    document: tuple[str, ...] = ("url", "md5")
    text: str = "report_json"


def file_fields(records: DataFrame, feed: Feed) -> DataFrame:
    """One row per file: source, position, file, ``fields`` (path to sorted kinds), ``fingerprint``.

    A file has a field if any readable record holds a non-null value there. Unreadable records,
    repeated lines and repeated deliveries do not matter. A file without a readable record has an
    empty fingerprint. Rows without source, position or file cannot be ordered and are left out.
    """
    keys = [feed.source, feed.position, feed.file]
    known = records.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(*keys, feed.text)

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:  # each field once for a file and batch
            found = {(*k, None, None): None for k in zip(*(f[c] for c in keys), strict=True)}
            for *k, text in zip(*(f[c] for c in [*keys, feed.text]), strict=True):
                record = parse_object(text)
                if record is not None:
                    for path, value in leaves(record):
                        found[*k, path, _KINDS[type(value)]] = None
            out = pd.DataFrame(list(found), columns=[*keys, "path", "kind"])
            yield out.assign(path=out["path"].map(_clean, na_action="ignore"))

    layout = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)
    per_field = spread(known).mapInPandas(seen, f"{layout}, path string, kind string").groupBy(*keys, "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    entry = F.when(F.col("path").isNotNull(), F.struct("path", "kinds"))
    return (
        per_field.groupBy(*keys)
        .agg(F.array_sort(F.array_compact(F.collect_list(entry))).alias("entries"))
        .select(*keys, F.map_from_entries("entries").alias("fields"), F.md5(F.to_json("entries")).alias("fingerprint"))
    )


def file_steps(fields: DataFrame, feed: Feed) -> DataFrame:
    """Each file beside its predecessor: ``previous_file``, ``added``, ``removed``, ``retyped``, ``is_new_version``.

    ``retyped`` are paths of both files that show a type the predecessor did not have. The first
    file of a source has no predecessor and no step. Fields may still be paired into renames.
    """
    chained = with_previous(fields, feed.source, feed.position, feed.file, "previous_file")
    before = fields.select(F.col(feed.file).alias("previous_file"), F.col("fields").alias("old"), F.col("fingerprint").alias("old_print"))
    both = chained.join(before, "previous_file", "left")
    here, there = F.map_keys("fields"), F.map_keys("old")
    wider = lambda p: F.size(F.array_except(F.element_at("fields", p), F.element_at("old", p))) > 0
    first = F.col("previous_file").isNull()
    none = F.array().cast("array<string>")
    return both.select(
        feed.source, feed.position, feed.file, "previous_file", "fingerprint",
        F.when(first, none).otherwise(F.array_except(here, there)).alias("added"),
        F.when(first, none).otherwise(F.array_except(there, here)).alias("removed"),
        F.when(first, none).otherwise(F.filter(F.array_intersect(here, there), wider)).alias("retyped"),
        (first | (F.col("fingerprint") != F.col("old_print"))).alias("is_new_version"),
    )


class SchemaRegistry:
    """Fingerprints of all files seen under ``path``, added to by each delivery.

    ``registry.json`` names the folders that count. A file that is registered is not read again; files may
    arrive in any order, since steps follow the positions.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, feed: Feed = Feed()) -> None:
        self.spark, self.path, self.feed = spark, path or scratch_path(spark, "registry"), feed
        self.folders: list[str] = json.loads(read_text(spark, f"{self.path}/registry.json") or "[]")
        self.layout: T.StructType | None = None

    def fields(self) -> DataFrame:
        """The rows of :func:`file_fields` of all registered files; :meth:`add` must have been called in this session."""
        return self.spark.read.schema(self.layout).parquet(*[f"{self.path}/{f}" for f in self.folders])

    def add(self, records: DataFrame) -> DataFrame:
        """Register the files of ``records`` that are new, and return all fields."""
        new = records
        if self.folders:
            new = records.join(self.spark.read.parquet(*[f"{self.path}/{f}" for f in self.folders]).select(self.feed.file), self.feed.file, "left_anti")
        found = file_fields(new, self.feed)
        self.layout = found.schema
        folder = f"files-{uuid.uuid4().hex[:12]}"
        found.write.parquet(f"{self.path}/{folder}")
        self.folders = [*self.folders, folder]
        write_lines(self.spark, f"{self.path}/registry.json", [json.dumps(self.folders)])
        return self.fields()


def _registered(records: DataFrame, feed: Feed, registry: SchemaRegistry | None) -> tuple[DataFrame, DataFrame]:
    """Fields of each file, and its step from the file before."""
    fields = (registry or SchemaRegistry(records.sparkSession, None, feed)).add(records)
    return fields, written(file_steps(fields, feed), "file-steps")


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _plain(name: Column) -> Column:
    return F.lower(F.regexp_replace(_last(name), "[^A-Za-z0-9]", ""))


def _sorted_words(name: Column) -> Column:
    """Words of the last part of a path, by underscores and capitals, in alphabetical order."""
    parted = F.regexp_replace(F.regexp_replace(_last(name), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.array_sort(F.split(F.trim(F.lower(F.regexp_replace(parted, "[^A-Za-z0-9]+", " "))), " "))


def renames(records: DataFrame, steps: DataFrame, feed: Feed) -> DataFrame:
    """``(file, old_field, new_field, equal, differing)``: the same facts under another path.

    Only files that both lost and gained fields are read again, and only those fields are taken from
    them. Documents reported in both files decide: a pair of fields is a rename if its values agree
    on at least three documents and differ on at most a twentieth as many, or, with fewer common
    values, if additionally the names agree apart from case, underscores, nesting and the order of
    their words (or, with one or two agreeing values, one name holds the other). Each field is used at most once; the best
    supported pair wins, then the more similar names, then the alphabet. A document reported
    repeatedly in a file counts with its smallest value.
    """
    moved = steps.where((F.size("added") > 0) & (F.size("removed") > 0))
    roles = moved.select(F.explode(F.array(
        F.struct(F.col(feed.file).alias("at"), F.struct(F.col(feed.file).alias("step"), F.lit("new").alias("role"), F.col("added").alias("wanted")).alias("r")),
        F.struct(F.col("previous_file").alias("at"), F.struct(F.col(feed.file).alias("step"), F.lit("old").alias("role"), F.col("removed").alias("wanted")).alias("r")),
    )).alias("x")).groupBy("x.at").agg(F.to_json(F.collect_list("x.r")).alias("roles"))
    first, *more = feed.document
    document = F.concat_ws("\x1f", first, *[F.coalesce(F.col(c), F.lit("\x1e")) for c in more])
    narrow = records.where(F.col(first).isNotNull()).select(F.col(feed.file).alias("at"), document.alias("document"), F.col(feed.text).alias("text"))
    step_kind = records.schema[feed.file].dataType.simpleString()

    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = lru_cache(4096)(lambda text: [(r["step"], r["role"], frozenset(r["wanted"])) for r in json.loads(text)])
        for f in frames:
            rows = []
            for document, text, roles in zip(f["document"], f["text"], f["roles"], strict=True):
                record = parse_object(text)
                if record is None:
                    continue
                held = {_clean(p): v for p, v in leaves(record)}
                for step, role, paths in wanted(roles):
                    rows += [(step, role, document, p, _clean(v if isinstance(v := held[p], str) else json.dumps(v, sort_keys=True))) for p in paths & held.keys()]
            yield pd.DataFrame(rows, columns=["step", "role", "document", "path", "value"])

    met = spread(narrow).join(roles, "at").select("document", "text", "roles")
    facts = met.mapInPandas(values, f"step {step_kind}, role string, document string, path string, value string").groupBy("step", "role", "document", "path").agg(F.min("value").alias("value"))
    side = lambda role: F.collect_list(F.when(F.col("role") == role, F.struct("path", "value"))).alias(role)
    common = (  # a document meets only its own record in the other file; fields that moved are few
        facts.groupBy("step", "document")
        .agg(side("old"), side("new"))
        .select("step", F.explode("old").alias("was"), "new")
        .select("step", "was", F.explode("new").alias("now"))
        .groupBy("step", F.col("was.path").alias("old_field"), F.col("now.path").alias("new_field"))
        .agg(F.sum(F.when(F.col("was.value") == F.col("now.value"), 1).otherwise(0)).alias("equal"), F.sum(F.when(F.col("was.value") != F.col("now.value"), 1).otherwise(0)).alias("differing"))
    )
    # Same-named pairs take part even without a common document.
    named = moved.select(F.col(feed.file).alias("step"), F.explode("removed").alias("old_field"), "added").select("step", "old_field", F.explode("added").alias("new_field"))
    old, new = F.col("old_field"), F.col("new_field")
    same = (_plain(old) == _plain(new)) | (_sorted_words(old) == _sorted_words(new))
    holds = _plain(F.col("old_field")).contains(_plain(F.col("new_field"))) | _plain(F.col("new_field")).contains(_plain(F.col("old_field")))
    pairs = named.join(common, ["step", "old_field", "new_field"], "left").fillna(0, ["equal", "differing"])
    supported = (F.col("differing") * 20 <= F.col("equal")) & ((F.col("equal") >= 3) | same | (holds & (F.col("equal") >= 1)))
    pairs = pairs.where(supported).withColumn("rank", F.struct((-F.col("equal") - F.when(same, 1000).when(holds, 2).otherwise(0)).alias("support"), F.levenshtein(_plain(F.col("old_field")), _plain(F.col("new_field"))).alias("far"), F.col("old_field"), F.col("new_field")))
    by_old = Window.partitionBy("step", "old_field")
    by_new = Window.partitionBy("step", "new_field")
    best = pairs.withColumn("of_old", F.min("rank").over(by_old)).withColumn("of_new", F.min("rank").over(by_new))
    return best.where((F.col("rank") == F.col("of_old")) & (F.col("rank") == F.col("of_new"))).select(F.col("step").alias(feed.file), "old_field", "new_field", "equal", "differing")


def field_changes(records: DataFrame, feed: Feed = Feed(), registry: SchemaRegistry | None = None) -> DataFrame:
    """``(file, change_kind, old_field, new_field)``: every change of a file against the one before it.

    With a ``registry`` that knows earlier files, ``records`` must still hold the files that new ones follow, for renames.
    """
    _, steps = _registered(records, feed, registry)
    renamed = written(renames(records, steps, feed), "renames")
    gone = renamed.groupBy(feed.file).agg(F.collect_set("old_field").alias("gone"), F.collect_set("new_field").alias("came"))
    none = F.array().cast("array<string>")
    left = steps.join(gone, feed.file, "left").select(
        feed.file,
        F.array_except("added", F.coalesce("came", none)).alias("added"),
        F.array_except("removed", F.coalesce("gone", none)).alias("removed"),
        "retyped",
    )
    as_events = lambda kind, c, old, new: F.transform(c, lambda p: F.struct(F.lit(kind).alias("change_kind"), (p if old else F.lit("")).alias("old_field"), (p if new else F.lit("")).alias("new_field")))
    events = F.concat(as_events("added", F.col("added"), False, True), as_events("removed", F.col("removed"), True, False), as_events("retyped", F.col("retyped"), True, True))
    single = left.select(feed.file, F.explode(events).alias("e")).select(feed.file, "e.*")
    return single.unionByName(renamed.select(feed.file, F.lit("renamed").alias("change_kind"), "old_field", "new_field"))


def schema_versions(records: DataFrame, feed: Feed = Feed(), registry: SchemaRegistry | None = None) -> DataFrame:
    """One row per file: its fingerprint and the number of the schema version it starts or continues.

    ``version`` counts the fingerprint changes of the source up to the file, from 1. The running
    count is taken inside blocks of files and over block totals, so a source with very many files
    is not one task.
    """
    _, steps = _registered(records, feed, registry)
    step = F.when(F.col("is_new_version"), 1).otherwise(0)
    blocked = steps.withColumn("_b", F.floor(F.col(feed.position) / 1024))
    totals = blocked.groupBy(feed.source, "_b").agg(F.sum(step).alias("_t")).withColumn("_before", F.sum("_t").over(Window.partitionBy(feed.source).orderBy("_b")) - F.col("_t"))
    inside = Window.partitionBy(feed.source, "_b").orderBy(feed.position)
    return (
        blocked.withColumn("_n", F.sum(step).over(inside))
        .join(totals.drop("_t"), [feed.source, "_b"])
        .select(feed.source, feed.position, feed.file, "fingerprint", (F.col("_n") + F.col("_before")).cast("bigint").alias("version"), F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), F.size("retyped").alias("n_retyped"))
    )


# --- one consistent table -------------------------------------------------------------------------


def target_paths(schema: T.StructType, prefix: str = "") -> dict[str, T.DataType]:
    """Dotted leaf paths of the target schema."""
    out: dict[str, T.DataType] = {}
    for f in schema.fields:
        out |= target_paths(f.dataType, f"{prefix}{f.name}.") if isinstance(f.dataType, T.StructType) else {prefix + f.name: f.dataType}
    return out


def _bare(path: str) -> str:
    return re.sub("[^a-z0-9]", "", path.rpartition(".")[2].lower())


def _words(path: str) -> tuple[str, ...]:
    return tuple(sorted(map(str.lower, re.findall("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", path.rpartition(".")[2]))))


def speller(targets: Iterable[str]) -> Callable[[str], tuple[int, str] | None]:
    """A function that gives the target a name spells, and how well: 3 as it stands, 2 apart from case, underscores and nesting, 1 also apart from the order of words."""
    exact, bare, by_words = set(targets), {}, {}
    for t in exact:
        bare.setdefault(_bare(t), []).append(t)
        by_words.setdefault(_words(t), []).append(t)

    def spelled(name: str) -> tuple[int, str] | None:
        if name in exact:
            return 3, name
        for strength, found in ((2, bare.get(_bare(name), [])), (1, by_words.get(_words(name), []))):
            if len(found) == 1:
                return strength, found[0]
        return None

    return spelled


def _chained(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Line of every name of each file of one block, as JSON: ``b:<file>:<name>`` where it began in the block, else ``e:<name>`` at its entry.

    The last row, without file, has the lines of the names with which the block ends.
    """
    rows = rows.sort_values("position")
    live: dict[str, str] = {}
    out = []
    for i, r in enumerate(rows.itertuples(index=False)):
        new, old = list(r.new_names), list(r.old_names)
        if i == 0 and not r.is_first:
            stayed = set(r.names) - set(r.added) - set(new)
            live = {n: f"e:{n}" for n in stayed | set(r.removed) | set(old)}
        moved = {n: live.pop(o, f"b:{r.file}:{n}") for o, n in zip(old, new, strict=True)}
        live = {n: line for n, line in live.items() if n not in set(r.removed)} | {n: f"b:{r.file}:{n}" for n in r.added} | moved
        out.append((r.file, {n: live.setdefault(n, f"b:{r.file}:{n}") for n in r.names}))
    out.append((None, live))
    frame = pd.DataFrame({"at": [f for f, _ in out], "lines": [json.dumps(m, sort_keys=True) for _, m in out]}).astype({"at": "Int64"} if pd.api.types.is_integer_dtype(rows["file"]) else {})
    return frame.assign(source=part[0], block=part[1])


def _entered(part: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each block of a source, the whole line of each name at its entry, as JSON; ``rows`` are the ends of blocks."""
    held: dict[str, str] = {}
    out = []
    for block, lines in sorted(zip(rows["block"], rows["lines"], strict=True)):
        out.append((part[0], block, json.dumps(held)))
        held = {n: held.get(line[2:], f"b:{block}:{n}") if line.startswith("e:") else line for n, line in json.loads(lines).items()}
    return pd.DataFrame(out, columns=["source", "block", "entry"])


def field_lines(steps: DataFrame, fields: DataFrame, renamed: DataFrame, feed: Feed) -> DataFrame:
    """``(source, file, name, line)``: the line each field of each file belongs to.

    A field keeps its line over the files of its source and through renames; one that is removed and added
    later begins a new line. Files are chained in blocks, and then the blocks, so that a source with very many
    files is not one task.
    """
    moved = renamed.groupBy(feed.file).agg(F.sort_array(F.collect_list(F.struct("old_field", "new_field"))).alias("moved"))
    none = F.array().cast("array<string>")
    names = lambda c: F.coalesce(F.transform("moved", lambda m: m[c]), none)
    rows = steps.join(fields.select(feed.file, F.map_keys("fields").alias("names")), feed.file).join(moved, feed.file, "left").select(
        F.col(feed.source).alias("source"), F.floor(F.col(feed.position) / BLOCK).alias("block"), F.col(feed.position).alias("position"), F.col(feed.file).alias("file"), "names",
        F.col("previous_file").isNull().alias("is_first"), names("old_field").alias("old_names"), names("new_field").alias("new_names"), F.array_except("added", names("new_field")).alias("added"), F.array_except("removed", names("old_field")).alias("removed"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    chained = written(rows.groupBy("source", "block").applyInPandas(_chained, f"at {kinds['file']}, lines string, source {kinds['source']}, block bigint"), "field-lines")
    entered = chained.where("at IS NULL").groupBy("source").applyInPandas(_entered, f"source {kinds['source']}, block bigint, entry string")
    as_map = lambda c: F.from_json(c, "map<string,string>")
    each = chained.where("at IS NOT NULL").join(entered, ["source", "block"]).select("source", F.col("at").alias("file"), as_map("entry").alias("entry"), F.explode(as_map("lines")).alias("name", "own"))
    return each.select("source", "file", "name", F.when(F.col("own").startswith("e:"), F.coalesce(F.try_element_at("entry", F.expr("substr(own, 3)")), F.col("own"))).otherwise(F.col("own")).alias("line"))


def migrations(records: DataFrame, schema: T.StructType, feed: Feed = Feed(), registry: SchemaRegistry | None = None) -> DataFrame:
    """``(file, field, target, rule, cast)``: the rules of every file, one row per field of the file and per target it lacks.

    ``rule``: ``keep``, ``rename`` (the field's line leads to the target), ``borrow`` (its line spells no target, but the
    lines of this name in other sources all lead to this one), ``other`` (no target) or ``default`` (the file has no field for
    the target). ``cast`` names the types seen that are not the target's, as ``integer>string``; null if there are none.
    """
    fields, steps = _registered(records, feed, registry)
    renamed = written(renames(records, steps, feed), "renames")
    lines = written(field_lines(steps, fields, renamed, feed), "lines")
    targets = target_paths(schema)
    spelled = speller(targets)

    @F.pandas_udf("strength int, target string")
    def spelling(names: pd.Series) -> pd.DataFrame:
        found = [spelled(n) or (None, None) for n in names]
        return pd.DataFrame({"strength": pd.array([s for s, _ in found], dtype="Int32"), "target": [t for _, t in found]})

    # Of several targets that the names of a line spell, the best spelled one, then the first by alphabet.
    known = lines.select("name").distinct().select("name", spelling("name").alias("s")).where("s.target IS NOT NULL")
    led = lines.select("source", "name", "line").distinct().join(known, "name").groupBy("source", "line").agg(F.min(F.struct((-F.col("s.strength")).alias("strength"), F.col("s.target").alias("target")))["target"].alias("led"))
    routed = lines.join(led, ["source", "line"], "left")
    lent = routed.where("led IS NOT NULL").groupBy("name").agg(F.min("led").alias("lent"), F.max("led").alias("most")).where("lent = most").select("name", "lent")
    own = routed.join(lent, "name", "left").withColumn("target", F.coalesce("led", "lent"))
    rule = F.when(F.col("target").isNull(), "other").when(F.col("name") == F.col("target"), "keep").when(F.col("led").isNotNull(), "rename").otherwise("borrow")
    native = F.create_map(*[F.lit(x) for t, k in targets.items() for x in (t, _native(k))])
    odd = F.array_sort(F.filter("kinds", lambda k: k != F.col("native")))
    cast = F.when(F.col("target").isNotNull() & (F.size(odd) > 0), F.concat(F.array_join(odd, ","), F.lit(">"), F.col("native")))
    held = fields.select(F.col(feed.file).alias("file"), F.explode("fields").alias("name", "kinds"))
    steps_of = own.join(held, ["file", "name"]).withColumn("native", F.try_element_at(native, F.col("target"))).select("file", F.col("name").alias("field"), "target", rule.alias("rule"), cast.alias("cast"))
    steps_of = written(steps_of, "migrations")
    every = F.array(*[F.lit(t) for t in targets])
    lacking = fields.select(F.col(feed.file).alias("file")).join(steps_of.groupBy("file").agg(F.collect_set("target").alias("has")), "file", "left")
    filled = lacking.select("file", F.lit(None).cast("string").alias("field"), F.explode(F.array_except(every, F.coalesce("has", F.array().cast("array<string>")))).alias("target"), F.lit("default").alias("rule"), F.lit(None).cast("string").alias("cast"))
    return steps_of.unionByName(filled).withColumnRenamed("file", feed.file)


def _native(kind: T.DataType) -> str:
    return {"boolean": "boolean", "int": "integer", "bigint": "integer", "double": "decimal", "float": "decimal"}.get(kind.simpleString(), "list" if isinstance(kind, T.ArrayType) else "string")


def cast_value(value: object, kind: T.DataType) -> object:
    """``value`` as the target type, or None where that is impossible. 0/1, numeric text, verdict words and delimited lists are understood."""
    if value is None:
        return None
    if isinstance(kind, T.BooleanType):
        if isinstance(value, bool):
            return value
        if isinstance(value, (int, float)):
            return {0: False, 1: True}.get(value)
        return {"true": True, "yes": True, "1": True, "pass": True, "false": False, "no": False, "0": False, "fail": False}.get(value.strip().lower()) if isinstance(value, str) else None
    if isinstance(kind, (T.IntegerType, T.LongType)):
        if isinstance(value, bool):
            return int(value)
        try:
            number = float(value) if isinstance(value, (float, str)) else value
            return int(number) if isinstance(number, (int, float)) and int(number) == number and abs(number) < 2**31 else None
        except (ValueError, OverflowError):
            return None
    if isinstance(kind, T.ArrayType):
        items = value if isinstance(value, list) else re.split(r"[;,|]\s*", value) if isinstance(value, str) else [value]
        return [i if isinstance(i, str) else json.dumps(i) for i in items if i is not None and i != ""]
    return value if isinstance(value, str) else json.dumps(value)


def _verdict(path: str, value: object) -> object:
    if path.endswith("Test") and isinstance(value, (bool, int, float)):
        return {0: "Fail", 1: "Pass"}.get(value, value)
    return value


def consistent_reports(records: DataFrame, schema: T.StructType, feed: Feed = Feed(), keep: tuple[str, ...] = ("line_no", "url", "md5"), defaults: Mapping[str, object] | None = None, registry: SchemaRegistry | None = None) -> DataFrame:
    """Every readable record once, as ``report`` of the target schema, by the rules of its own file.

    Fields without a target are kept as JSON text in ``other_fields``, and so is a value whose target
    already has a different one from another field of the record, and a value that cannot be cast, which is null in
    ``report`` and counted in ``n_uncast``. Missing fields come out as ``defaults`` (target path to value) or null. A
    line delivered repeatedly with the same text is one record. See :func:`migrations` for the rules.
    """
    targets = target_paths(schema)
    rules = migrations(records, schema, feed, registry=registry)
    routes = rules.where("field IS NOT NULL AND target IS NOT NULL").groupBy(feed.file).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "target"))))).alias("_route"))
    filled = dict(defaults or {})

    @F.pandas_udf("report string, other_fields map<string,string>, n_uncast int")
    def migrate(texts: pd.Series, routes: pd.Series) -> pd.DataFrame:
        parsed = lru_cache(4096)(lambda r: json.loads(r) if r else {})
        reports, others, lost = [], [], []
        for text, own in zip(texts, routes, strict=True):
            record = parse_object(text)
            if record is None:
                reports.append(None), others.append(None), lost.append(None)
                continue
            route = parsed(own)
            out, rest, bad = {}, {}, 0
            for path, value in sorted(leaves(record), key=lambda x: (route.get(x[0]) != x[0], x[0])):
                to = route.get(_clean(path))
                made = None if to is None else cast_value(_verdict(to, value), targets[to])
                if made is None:
                    bad += to is not None
                    rest[_clean(path)] = _clean(json.dumps(value, sort_keys=True))
                    continue
                if out.setdefault(to, made) != made:  # the target's own spelling comes first
                    rest[_clean(path)] = _clean(json.dumps(value, sort_keys=True))
            tree: dict = {}
            for to, made in {**filled, **out}.items():
                *above, last = to.split(".")
                node = tree
                for name in above:
                    node = node.setdefault(name, {})
                node[last] = made
            reports.append(_clean(json.dumps(tree))), others.append(rest), lost.append(bad)
        return pd.DataFrame({"report": reports, "other_fields": others, "n_uncast": pd.array(lost, dtype="Int32")})

    once = records.select(feed.source, feed.file, *keep, feed.text).distinct()
    moved = once.join(routes, feed.file, "left").withColumn("_m", migrate(F.col(feed.text), F.col("_route"))).where(F.col("_m.report").isNotNull())
    return moved.select(feed.source, feed.file, *keep, F.from_json("_m.report", schema).alias("report"), F.col("_m.other_fields").alias("other_fields"), F.col("_m.n_uncast").alias("n_uncast"))
