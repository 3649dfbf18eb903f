"""Schemas that drift between files: rescue-column ingestion and a report of every change.

Lines are read once, against a target schema (`ingest`). What fits goes into typed columns; every unknown member and every
value that can't be cast goes unchanged, as JSON, into the column `rescued`, so nothing is lost; `members` tells which members
a line had and of which JSON type. All else works on the ingested table. `changes_of` compares the files' members and, for
renames, the contents in typed columns and `rescued`. `promotions` collects the names under which a target's fields came;
those that are approved are promoted by `replay`, which fills the typed columns from `rescued` without reading a line again.

JSON is parsed in Arrow batches by Python's parser: the JVM's parsers accept text after the first value and refuse repeated
keys, and the problem asks for exactly the lines that are complete JSON objects.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.session import cut_lineage

#: The member whose own members are members of the line too.
NESTED = "run"


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_object(line: str | None) -> dict | None:
    """The object of a line, None if the line is not one complete JSON object."""
    if not line:
        return None
    try:
        found = json.loads(line, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def json_kind(value: object) -> str | None:
    """string, integer, fraction, boolean, object or array<...>; None where the value tells no type (null, [])."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "fraction"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        inner = {k for x in value if (k := json_kind(x))}
        inner = sorted(inner - {"integer"} if "fraction" in inner else inner)
        return f"array<{'|'.join(inner)}>" if inner else None
    return None


def flat_members(line: dict) -> dict[str, object]:
    """The members of a line by path: its own under their name, those of its member `run` under run.<name>, nothing deeper. A
    name that itself begins with `run.` gets a dot before it."""
    out = {("." + k if k.startswith(f"{NESTED}.") else k): v for k, v in line.items()}
    if isinstance(line.get(NESTED), dict):
        out |= {f"{NESTED}.{k}": v for k, v in line[NESTED].items()}
    return out


def _scope(path: Column) -> Column:
    return F.when(path.startswith(f"{NESTED}."), NESTED).otherwise("")


def _member(path: Column) -> Column:
    return F.regexp_replace(path, rf"^(?:{NESTED}\.|\.(?={NESTED}\.))", "")


def with_file_kind(raw: DataFrame) -> DataFrame:
    """raw_lines with `kind`: 'run' for manifests (run.json), 'results' for record files."""
    return raw.withColumn("kind", F.when(F.col("file_name").endswith("run.json"), "run").otherwise("results"))


def _profile(members: DataFrame, keys: list[str]) -> DataFrame:
    """What the values of a member of a file are made of: relative frequencies of masked tokens, per kind of value.

    Names (words with a capital) become X and long numbers their count of digits, so the profile tells the form of the
    content from the single values; member names inside objects are tokens as well.
    """
    words = F.expr(r"regexp_extract_all(value, '[\\p{L}_]+|[0-9]+', 0)")
    mask = F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}\p{Ll}+$"), F.lit("X")).when(w.rlike("^[0-9]{3,}$"), F.concat(F.lit("#"), F.length(w))).otherwise(w))
    tokens = members.where("kind is not null").select(*keys, "kind", F.explode(mask).alias("token"))
    counted = tokens.groupBy(*keys, "kind", "token").count()
    whole = Window.partitionBy(*keys, "kind")
    return counted.withColumn("share", F.col("count") / F.sum("count").over(whole)).withColumn("telling", F.count_if(F.col("token") != "X").over(whole)).drop("count")


def _matched(similar: pd.DataFrame) -> pd.DataFrame:
    """Of the pairs of one file and scope the most similar first, each name once, until none is left."""
    keep, used = [], set()
    for _, old, new in sorted(zip(-similar["similarity"], similar["old"], similar["new"])):
        if ("old", old) not in used and ("new", new) not in used:
            used |= {("old", old), ("new", new)}
            keep.append((old, new))
    place = list(similar.columns[:3])
    return pd.DataFrame([(*similar.iloc[0][place], *k) for k in keep], columns=[*place, "old", "new"])


def _contents(table: DataFrame, target: dict[str, str], wanted: DataFrame) -> DataFrame:
    """collector, seq, path, kind, value: the values of the wanted members (collector, seq, wanted: array of paths), from typed
    columns and `rescued`."""
    names = column_names(table.columns, target)
    text = {"string": F.col, "json": F.col, "array<string>": F.to_json, "map<string,string>": F.to_json}
    entry = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("value"))
    typed = [F.when(F.col(names[p]).isNotNull(), entry(p, text.get(t, lambda c: F.col(c).cast("string"))(names[p]))) for p, t in target.items()]
    inner = {p: names[p] for p in target if p.startswith(f"{NESTED}.")}
    if inner:
        whole = F.to_json(F.struct(*[F.col(c).alias(p.split(".", 1)[1]) for p, c in inner.items()]))
        typed.append(F.when(F.array_contains("wanted", NESTED), entry(NESTED, whole)))
    left = F.transform(F.map_entries(F.coalesce(F.from_json("rescued", "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value")))
    found = F.filter(F.concat(F.array_compact(F.array(*typed)), left), lambda e: F.array_contains("wanted", e["path"]))
    rows = table.join(wanted.hint("merge"), ["collector", "seq"]).withColumn("__kinds", F.from_json("members", "map<string,string>"))
    return rows.select("collector", "seq", "__kinds", F.inline(found)).select("collector", "seq", "path", F.try_element_at("__kinds", "path").alias("kind"), "value")


def changes_of(table: DataFrame, files: DataFrame, target: dict[str, str], kind: str, min_similarity: float = 0.4) -> DataFrame:
    """Every change of a file against the collector's file with the next lower seq, from files of one kind.

    table: what `ingest` made of their lines, with `members`; files: collector and seq of all files, also of those without a
    readable line. Result: collector, seq, kind, scope, member, change (added, removed, renamed, retyped), new_member (of a
    rename), old_kind, new_kind. A file counts as the set of its readable lines, so lines that were loaded twice or late
    change nothing; a file without any readable line has no members. A member is renamed when it is gone, another of the same
    scope is new, both have a common kind of value and the overlap of their contents' profiles is at least min_similarity (of
    the shares of their tokens, or of the smaller one's distinct tokens); each side takes part in one rename at most, the
    most similar pair first, until no pair is left (ties by name). Two kinds of value on either side are retyped when the sets
    of kinds differ.
    """
    # files grow with the corpus: their joins are by merging, never by broadcasting what compresses well on disk
    # a file's lines have few different sets of members: only those are unfolded
    flat = table.select("collector", "seq", "members").distinct().select("collector", "seq", F.explode(F.from_json("members", "map<string,string>")).alias("path", "kind"))
    order = Window.partitionBy("collector").orderBy("seq")
    files = files.select("collector", "seq").distinct().withColumn("before", F.lag("seq").over(order)).withColumn("after", F.lead("seq").over(order))
    # whole numbers among fractions are fractions
    seen = F.array_sort(F.collect_set("kind"))
    kinds = flat.groupBy("collector", "path", "seq").agg(F.when(F.array_contains(seen, "fraction"), F.array_remove(seen, "integer")).otherwise(seen).alias("kinds"))
    # a member's neighbours: the file before (was it there?) and the file after (is it still there?)
    w = Window.partitionBy("collector", "path").orderBy("seq")
    here = kinds.join(files.hint("merge"), ["collector", "seq"]).select("*", F.lag("seq").over(w).alias("p_seq"), F.lag("kinds").over(w).alias("p_kinds"), F.lead("seq").over(w).alias("n_seq"))
    same = F.col("p_seq").eqNullSafe(F.col("before"))
    event = lambda at, change: F.struct(at.alias("at"), F.lit(change).alias("change"))
    told = F.array_compact(
        F.array(
            F.when(F.col("before").isNotNull() & ~same, event(F.col("seq"), "added")),
            F.when(F.col("after").isNotNull() & ~F.col("n_seq").eqNullSafe(F.col("after")), event(F.col("after"), "removed")),
            F.when(F.col("before").isNotNull() & same & (F.size("kinds") > 0) & (F.size("p_kinds") > 0) & (F.col("kinds") != F.col("p_kinds")), event(F.col("seq"), "retyped")),
        )
    )
    events = cut_lineage(here.select("collector", "seq", "path", F.array_join("p_kinds", "|").alias("old_kind"), F.array_join("kinds", "|").alias("new_kind"), F.inline(told)))
    sides = events.where("change != 'retyped'").select("collector", "seq", "path", "at", "change")
    # only the contents of members that came or went are looked at
    wanted = sides.groupBy("collector", "seq").agg(F.collect_set("path").alias("wanted"))
    content = _contents(table, target, wanted).join(sides.hint("merge"), ["collector", "seq", "path"]).withColumn("scope", _scope(F.col("path")))
    place = ["collector", "at", "scope"]
    prof = _profile(content, [*place, "change", "path"])
    a = prof.where("change = 'removed'").select(*place, F.col("path").alias("old"), "kind", "token", F.col("share").alias("p"), F.col("telling").alias("n"))
    b = prof.where("change = 'added'").select(*place, F.col("path").alias("new"), "kind", "token", F.col("share").alias("q"), F.col("telling").alias("m"))
    both = a.join(b.hint("merge"), [*place, "kind", "token"]).groupBy(*place, "old", "new")
    similar = both.agg(F.greatest(F.sum(F.least("p", "q")), F.coalesce(F.try_divide(F.count_if(F.col("token") != "X") * 0.9, F.max(F.least("n", "m"))), F.lit(0.0))).alias("similarity")).where(F.col("similarity") >= min_similarity)
    pairs = cut_lineage(similar.groupBy(*place).applyInPandas(_matched, similar.select(*place, "old", "new").schema))
    none = F.lit(None).cast("string")
    renamed = pairs.select("collector", "at", F.col("old").alias("path"), F.lit("renamed").alias("change"), _member(F.col("new")).alias("new_member"), none.alias("old_kind"), none.alias("new_kind"))
    used = pairs.select("collector", "at", F.inline(F.array(F.struct(F.col("old").alias("path"), F.lit("removed").alias("change")), F.struct(F.col("new").alias("path"), F.lit("added").alias("change")))))
    typed = F.col("change") == "retyped"
    rest = events.join(used.hint("merge"), ["collector", "at", "path", "change"], "left_anti").select("collector", "at", "path", "change", none.alias("new_member"), F.when(typed, F.col("old_kind")).alias("old_kind"), F.when(typed, F.col("new_kind")).alias("new_kind"))
    out = rest.unionByName(renamed)
    return out.select("collector", F.col("at").alias("seq"), F.lit(kind).alias("kind"), _scope(F.col("path")).alias("scope"), _member(F.col("path")).alias("member"), "change", "new_member", "old_kind", "new_kind")


def changes(raw: DataFrame, min_similarity: float = 0.4) -> DataFrame:
    """The changes of all files (see `changes_of`) of raw lines: collector, seq, file_name, line. Each line is read once."""
    out = None
    for kind, target in TARGETS.items():
        lines = with_file_kind(raw.select("collector", "seq", "file_name", "line")).where(F.col("kind") == kind)
        table = cut_lineage(ingest(lines.select("collector", "seq", "line"), target, members=True).drop("line"))
        part = changes_of(table, lines.select("collector", "seq"), target, kind, min_similarity)
        out = part if out is None else out.unionByName(part)
    return out


#: Target schemas: member path -> Spark type. Scalars are cast by kind, `json` keeps the value as JSON text.
RECORD = {
    "run.caseId": "string", "run.system": "string", "run.repetition": "bigint", "run.output": "string", "run.latencyMs": "bigint", "run.error": "string",
    "run.modelCalls": "bigint", "run.tokensIn": "bigint", "run.tokensOut": "bigint", "run.costUsd": "double", "run.models": "array<string>",
    "run.modelRequests": "array<string>", "status": "string", "grades": "json", "judge": "json",
}
MANIFEST = {
    "runId": "string", "command": "array<string>", "startedAt": "string", "finishedAt": "string", "complete": "boolean", "expectedJobs": "bigint", "records": "bigint",
    "systems": "json", "suites": "array<string>", "reps": "bigint", "concurrency": "bigint", "sandbox": "string", "providers": "map<string,string>", "git": "json",
}


TARGETS = {"results": RECORD, "run": MANIFEST}


def _fit(value: object, kind: str) -> tuple[bool, object]:
    """Whether a JSON value fits a type, and the value. null fits every type."""
    if value is None:
        return True, None
    if kind == "json":
        return True, json.dumps(value, ensure_ascii=False)
    if kind == "string":
        return isinstance(value, str), value
    if kind == "boolean":
        return isinstance(value, bool), value
    if kind == "bigint":
        return isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63, value
    if kind == "double":
        return isinstance(value, (int, float)) and not isinstance(value, bool), value
    if kind == "array<string>":
        return isinstance(value, list) and all(x is None or isinstance(x, str) for x in value), value
    if kind == "map<string,string>":
        ok = isinstance(value, dict)
        return ok, [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in value.items()] if ok else None
    raise ValueError(kind)


ARROW = {"string": pa.string(), "json": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _column(path: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", path.replace("run.", "")).lower()


def column_names(own: list[str], target: dict[str, str]) -> dict[str, str]:
    """The typed column of each target member, in a table made of lines with the columns `own`, or in such a table, which has `rescued`."""
    out = {p: _column(p) for p in target}
    if "rescued" in own:  # an ingested table
        return {p: n + "_" if n + "_" in own else n for p, n in out.items()}
    clash = {c.lower() for c in own}
    return {p: (n + "_" if n in clash else n) for p, n in out.items()}


def ingest(lines: DataFrame, target: dict[str, str], members: bool = False) -> DataFrame:
    """Lines as typed rows: lines' own columns, one column per member of `target`, and `rescued` (JSON text or NULL).

    Members that `target` doesn't name and values of another type are kept in `rescued` under their path. members: add
    `members`, the paths of all members of the line with their JSON type (NULL where the value tells none), as JSON.
    Unreadable lines give no row.
    """
    own = [f.name for f in lines.schema.fields]
    names = column_names(own, target)
    ddl = {"json": "string"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields), *(f"`{names[p]}` {ddl.get(t, t)}" for p, t in target.items()), "rescued string", *["members string"] * members])
    at = own.index("line")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {p: [] for p in target}
            rescued, told, keep = [], [], []
            for i, line in enumerate(b.column(at).to_pylist()):
                o = parse_object(line)
                if o is None:
                    continue
                keep.append(i)
                flat = flat_members(o)
                if members:
                    told.append(json.dumps({p: json_kind(v) for p, v in flat.items()}, ensure_ascii=False, sort_keys=True))
                left = {p: v for p, v in flat.items() if p not in target and not (p == NESTED and isinstance(v, dict))}
                for p, t in target.items():
                    ok, v = _fit(flat.get(p), t)
                    if not ok:
                        left[p], v = flat[p], None
                    cols[p].append(v)
                rescued.append(json.dumps(left, ensure_ascii=False) if left else None)
            taken = b.take(pa.array(keep, pa.int64()))
            more = [pa.array(told, pa.string())] * members
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(cols[p], ARROW[t]) for p, t in target.items()), pa.array(rescued, pa.string()), *more], [*own, *names.values(), "rescued", *["members"] * members])

    return lines.mapInArrow(rows, schema)


def replay(table: DataFrame, target: dict[str, str], promoted: dict[str, list[str]]) -> DataFrame:
    """An ingested table with approved fields promoted: an empty typed column is filled from `rescued`, where the member's own
    value of another type, or else one of its promoted names (in their order), can be read by `replay_value`.

    `rescued` stays as it is, so a replay can be repeated with other promotions. Rows without rescued members pass by.
    """
    names = column_names(table.columns, target)
    columns = table.columns
    at = columns.index("rescued")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [json.loads(x) for x in b.column(at).to_pylist()]
            cols = list(b.columns)
            for p, t in target.items():
                i = columns.index(names[p])
                found, changed = cols[i].to_pylist(), False
                for k, (v, some) in enumerate(zip(found, left)):
                    if v is None:
                        for other in [p, *promoted.get(p, [])]:
                            if other in some and (v := replay_value(some[other], t)) is not None:
                                found[k], changed = v, True
                                break
                if changed:
                    cols[i] = pa.array(found, ARROW[t])
            yield pa.RecordBatch.from_arrays(cols, columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.where("rescued is null").unionByName(table.where("rescued is not null").mapInArrow(fill, schema))


def replay_value(value: object, kind: str) -> object:
    """A rescued value of an approved field read into its typed column; None if it can't be read.

    Read besides the type itself: for string, the text of a scalar and the member `code` of an object; for array<string>, one
    string, and objects by their JSON text; for map<string,string>, a list of objects by their member `model`, a list of
    names or one name as keys without a value.
    """
    ok, v = _fit(value, kind)
    if ok:
        return v
    if kind == "string":
        if isinstance(value, dict):
            return replay_value(value.get("code"), kind)
        return None if isinstance(value, list) else json.dumps(value)
    if kind == "array<string>":
        if isinstance(value, str):
            return [value]
        return [x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in value] if isinstance(value, list) else None
    if kind == "map<string,string>":
        items = [value] if isinstance(value, str) else value
        if not isinstance(items, list):
            return None
        pairs: dict[str, str | None] = {}
        for x in items:
            if isinstance(x, str):
                pairs[x] = None
            elif isinstance(x, dict) and isinstance(x.get("model"), str):
                pairs[x["model"]] = json.dumps({k: y for k, y in x.items() if k != "model"}, ensure_ascii=False)
        return list(pairs.items()) or None
    return None


def promotions(found: DataFrame, kind: str, target: dict[str, str], approved: set[str] | None = None) -> dict[str, list[str]]:
    """Names under which the target's members came, from the renames of `changes`, followed from name to name.

    approved: the paths that may be promoted; all that were found if None. The target's names are followed outwards, a step
    at a time, so only names that belong to it come to the driver, whatever else was renamed.
    """
    path = lambda c: F.when(F.col("scope") == "", F.col(c)).otherwise(F.concat_ws(".", "scope", c))
    rows = found.where((F.col("kind") == kind) & (F.col("change") == "renamed")).select(path("member").alias("a"), path("new_member").alias("b"))
    links = cut_lineage(rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    of = {p: p for p in target}
    todo = list(target)
    while todo:
        step = links.where(F.col("a").isin(todo)).collect()  # names of one schema's fields
        todo = []
        for a, b in sorted(tuple(r) for r in step):
            if b not in of and (approved is None or b in approved):
                of[b] = of[a]
                todo.append(b)
    out: dict[str, list[str]] = {}
    for name, p in of.items():
        if name != p:
            out.setdefault(p, []).append(name)
    return {p: sorted(v) for p, v in out.items()}
