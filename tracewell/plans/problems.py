"""The core training-data problems, bound to the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import instant_micros, is_blank, local_micros, plain_id, plain_predicate
from ..operators import drift, hierarchy, nested, references, snapshots
from ..sources.tables import read_table
from .scratch import Scratch

P4_FIELDS = [
    drift.Field("notes", ("notes",), words=("summary",)),
    drift.Field("coverage.coarser_than_year", ("coverage.coarser_than_year",), canonical="count"),
    drift.Field("generator", ("generator",)),
]
# for the SQL only, which can't tell them from the files: the paths that these test tables use
P4_SQL_PATHS = {
    "notes": ("notes", "Notes", "change_notes", "remarks", "build_log"),
    "coverage.coarser_than_year": ("coverage.coarser_than_year", "coverage.coarserThanYear", "coverage.coarse_dates", "coverage.dating.coarser_than_year", "coverage_coarse"),
    "generator": ("generator", "generatedBy", "producer", "built_by", "provenance.generator"),
}


# 1. nested records


def _case_tables(spark: SparkSession, sf_dir: str, paths: list[str]) -> dict[str, DataFrame]:
    df = read_table(spark, sf_dir, "adversarial_cases", ["case_id", "added_at", *paths])
    return nested.flat_tables(df, "case_id", paths, "added_at")


def _transcript_tables(spark: SparkSession, sf_dir: str, paths: list[str]) -> dict[str, DataFrame]:
    df = read_table(spark, sf_dir, "transcripts", ["transcript_id", "loaded_at", *paths])
    return nested.flat_tables(df, "transcript_id", paths, "loaded_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _case_tables(spark, sf_dir, ["expected.forbidden_triples[][]", "expected.resolution.node_id"])
    claims = _transcript_tables(spark, sf_dir, ["claims[].source_ids[]"])
    zero = F.lit(0).cast("bigint")
    parts = [
        (cases["expected.forbidden_triples[][]"], "case_id", "expected.forbidden_triples", F.col("pos_0"), F.col("pos_1"), "value"),
        (cases[""], "case_id", "expected.resolution.node_id", zero, zero, "expected_resolution_node_id"),
        (claims["claims[].source_ids[]"], "transcript_id", "claims.source_ids", F.col("pos_0"), F.col("pos_1"), "value"),
    ]
    found = None
    for df, key, name, outer, inner, value in parts:
        part = df.where(~is_blank(F.col(value))).select(F.col(key).cast("string").alias("record_id"), F.lit(name).alias("list_name"), outer.alias("outer_pos"), inner.alias("inner_pos"), F.col(value).alias("item"))
        found = part if found is None else found.unionByName(part)
    return found


_CLAIM_PATHS = ["claims[].subject", "claims[].predicate", "claims[].object", "claims[].subject_id", "claims[].object_id", "claims[].verification"]


def p1_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims table: one row per claim, child of its transcript by transcript_id, parent of the sources by pos_0."""
    return _transcript_tables(spark, sf_dir, _CLAIM_PATHS)["claims[]"]


def p1_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases' own table: the values of ``expected`` outside of any list."""
    return _case_tables(spark, sf_dir, ["expected.refusal", "expected.max_approved_claims", "expected.resolution.query_term", "expected.resolution.node_id", "expected.resolution.reason", "expected.must_name_gap"])[""]


# 3. hierarchies


def _subclass_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read_table(spark, sf_dir, "edges", ["subject_id", "predicate", "object_id"])
    return edges.where(plain_predicate(F.col("predicate")) == "subclass_of").select(plain_id(F.col("subject_id")).alias("child"), plain_id(F.col("object_id")).alias("parent"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy.hierarchy(_subclass_links(spark, sf_dir), with_paths=False)
    return tree.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy.hierarchy(_subclass_links(spark, sf_dir))
    return tree.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", " > ").alias("path"))


def p3_further_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links the hierarchy follows, and how many it leaves out as their child has another parent."""
    links = _subclass_links(spark, sf_dir).distinct()
    further = hierarchy.further_parents(links).agg(F.count(F.lit(1)).alias("n_left_out"))
    return links.where("trim(child) <> '' and trim(parent) <> ''").agg(F.count(F.lit(1)).alias("n_links")).crossJoin(F.broadcast(further))  # one row each


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(_subclass_links(spark, sf_dir))).withColumnsRenamed({"ancestor": "ancestor_id", "node": "node_id"})


# 4. drifting schemas


_MAPS = ("source_snapshot", "verification_counts")  # their keys are data


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "manifest_files", ["file_id", "feed", "written_at", "body"])


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of each manifest, parsed once and written."""
    return Scratch(spark, "paths").keep(drift.read_paths(_manifests(spark, sf_dir), ["feed", "file_id", "written_at"], opaque=_MAPS))


def _fields(read: DataFrame) -> list[drift.Field]:
    """The fields under their plain names and those that the files show."""
    return drift.other_names(read, P4_FIELDS, "feed", "written_at", "file_id")


def p4_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path under which a field is looked for."""
    rows = [(f.name, p) for f in _fields(_paths(spark, sf_dir)) for p in f.paths]
    return spark.createDataFrame(rows, "field_name string, path string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _paths(spark, sf_dir)
    cells = drift.located(read, _fields(read), ["feed", "written_at", "file_id"])
    return drift.changes(cells, "feed", "written_at", "file_id").select("feed", "file_id", "field_name", "change_kind")


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests in one table: each field in its canonical form, with the tag and path it was delivered in."""
    wide = drift.consistent_table(drift.parsed(_manifests(spark, sf_dir)), _fields(_paths(spark, sf_dir)), ["feed", "file_id"])
    names = [f.name.replace(".", "_") for f in P4_FIELDS]
    return wide.select("feed", "file_id", *[x for n in names for x in (F.col(f"{n}.canonical").alias(n), f"{n}_tag", f"{n}_path")])


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused schema: every path with its alternative types and the number of files that show them."""
    return drift.fused_schema(drift.path_tags(drift.read_paths(_manifests(spark, sf_dir), ["file_id"], opaque=_MAPS), ["file_id"]))


# 5. orphan references


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read_table(spark, sf_dir, "nodes", ["id", "retrieved_at"]).unionByName(read_table(spark, sf_dir, "seed_nodes", ["id", "retrieved_at"]))
    removals = read_table(spark, sf_dir, "node_removals", ["id", "removed_at", "restored_at"])
    return references.parent_intervals(
        nodes.select(plain_id(F.col("id")).alias("key"), instant_micros(F.col("retrieved_at")).alias("seen")),
        removals.select(plain_id(F.col("id")).alias("key"), local_micros(F.col("removed_at")).alias("removed"), local_micros(F.col("restored_at")).alias("restored")),
    )


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference that isn't blank: its record, field, place, plain id and time. A repeated record counts once."""
    asked = read_table(spark, sf_dir, "transcripts", ["transcript_id", "written_at", "loaded_at", "claims[].subject_id", "claims[].object_id"])
    rows = nested.latest_records(asked, "transcript_id", "loaded_at").select("transcript_id", "written_at", F.posexplode("claims").alias("pos", "claim"))
    both = F.array(*[F.struct(F.lit(f"claims.{c}").alias("ref_field"), F.col(f"claim.{c}").alias("ref")) for c in ("subject_id", "object_id")])
    of_claims = rows.select(F.lit("transcripts").alias("ref_table"), F.col("transcript_id").cast("string").alias("record_id"), F.col("pos").cast("bigint").alias("item_pos"), local_micros(F.col("written_at")).alias("at"), F.inline(both))
    cases = nested.latest_records(read_table(spark, sf_dir, "adversarial_cases", ["case_id", "added_at", "expected.resolution.node_id"]), "case_id", "added_at")
    of_cases = cases.select(
        F.lit("adversarial_cases").alias("ref_table"), F.col("case_id").alias("record_id"), F.lit(0).cast("bigint").alias("item_pos"), local_micros(F.col("added_at")).alias("at"), F.lit("expected.resolution.node_id").alias("ref_field"), F.col("expected.resolution.node_id").alias("ref")
    )
    return of_claims.unionByName(of_cases).where(~is_blank(F.col("ref"))).withColumn("key", plain_id(F.col("ref"))).drop("ref")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphans(_references(spark, sf_dir), _intervals(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_field", "record_id", "item_pos", F.col("key").alias("ref_id"), "cause")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, month of the record and cause."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return _orphans(spark, sf_dir).groupBy("ref_table", "ref_field", month.alias("month"), "cause").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("record_id").alias("n_records"))


# 6. snapshots


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read_table(spark, sf_dir, "edge_snapshots", ["artifact_version", "subject_id", "object_id", "source_id", "prose_tier", "delivered_at"])
    plain = held.withColumn("subject_id", plain_id(F.col("subject_id"))).withColumn("object_id", plain_id(F.col("object_id")))
    return snapshots.snapshot_changes(plain, ["subject_id", "object_id"], "artifact_version", "delivered_at", ["source_id", "prose_tier"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("from_version", "to_version", "subject_id", "object_id", "change_kind")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per pair of versions, with the columns that changed."""
    return _changes(spark, sf_dir).groupBy("from_version", "to_version", "change_kind", F.array_join("changed_columns", ",").alias("changed_columns")).agg(F.count(F.lit(1)).alias("n_edges"))


QUERIES = {f.__name__: f for f in (p1_found, p1_claims, p1_cases, p3_found, p3_paths, p3_further_parents, p3_descendants, p4_found, p4_table, p4_report, p4_names, p5_found, p5_report, p6_found, p6_report)}

# SQL for the driver: the same meaning in one statement each

_PID = r"upper(regexp_replace(regexp_replace({c}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '^.*/', ''))"
_SAID = r"{c} is not null and not regexp_full_match({c}, '[\s\pZ]*')"
_T = "t as (select * from transcripts qualify row_number() over (partition by transcript_id order by loaded_at desc) = 1)"
_A = "a as (select * from adversarial_cases qualify row_number() over (partition by case_id order by added_at desc) = 1)"
_CL = "cl as (select transcript_id, written_at, unnest(claims) c, unnest(range(len(claims))) i from t)"
_SUB = f"s as (select distinct {_PID.format(c='subject_id')} c, {_PID.format(c='object_id')} p from edges where regexp_matches(lower(predicate), '(^|:)subclass_of\\s*$') or lower(trim(predicate)) = 'subclass_of'), ids as (select c id from s union select p from s)"
_TREE = f"{_SUB}, w(id, cur, d, low) as (select id, id, 0, id from ids union all select w.id, s.p, d + 1, least(low, s.p) from w join s on s.c = w.cur where d < 300), m as (select id, max(d) d from w group by 1), onl as (select distinct w.id from w where w.cur = w.id and w.d > 0), lp as (select w.id, min(w.low) low from w join onl using (id) where w.d <= (select min(x.d) from w x where x.id = w.id and x.cur = w.id and x.d > 0) group by 1)"
_REFS = f"""{_T}, {_A}, {_CL}, r as (
 select 'transcripts' ref_table, 'claims.subject_id' ref_field, transcript_id::varchar record_id, i::bigint item_pos, c.subject_id ref, written_at tm from cl
 union all select 'transcripts', 'claims.object_id', transcript_id::varchar, i::bigint, c.object_id, written_at from cl
 union all select 'adversarial_cases', 'expected.resolution.node_id', case_id, 0::bigint, expected.resolution.node_id, added_at from a),
 b as (select {_PID.format(c='id')} id, min(retrieved_at::timestamptz at time zone 'UTC') born from (select id, retrieved_at from nodes union all select id, retrieved_at from seed_nodes) group by 1),
 k as (select ref_table, ref_field, record_id, item_pos, {_PID.format(c='ref')} ref_id, tm from r where {_SAID.format(c='ref')}),
 o as (select k.*, case when b.id is null then 'missing' when born > tm then 'late' when removed_at <= tm and not coalesce(restored_at <= tm, false) then 'deleted' end cause
  from k left join b on b.id = k.ref_id left join node_removals m on m.id = k.ref_id)"""
_VERSIONS = f"""v as (select artifact_version, row_number() over (order by list_transform(regexp_extract_all(artifact_version, '[0-9]+'), lambda x: x::bigint)) i from (select distinct artifact_version from edge_snapshots)),
 h as (select i, {_PID.format(c='subject_id')} subject_id, {_PID.format(c='object_id')} object_id, source_id, prose_tier from edge_snapshots join v using (artifact_version)
  qualify row_number() over (partition by i, {_PID.format(c='subject_id')}, {_PID.format(c='object_id')} order by delivered_at desc, source_id desc nulls last, prose_tier desc nulls last) = 1),
 z as (select coalesce(x.i + 1, y.i) i, coalesce(x.subject_id, y.subject_id) subject_id, coalesce(x.object_id, y.object_id) object_id, case when x.i is null then 'added' when y.i is null then 'removed' when x.source_id is distinct from y.source_id or x.prose_tier is distinct from y.prose_tier then 'changed' end change_kind,
   concat_ws(',', case when x.i is not null and y.i is not null and x.source_id is distinct from y.source_id then 'source_id' end, case when x.i is not null and y.i is not null and x.prose_tier is distinct from y.prose_tier then 'prose_tier' end) changed_columns
  from h x full join h y on y.i = x.i + 1 and y.subject_id = x.subject_id and y.object_id = x.object_id),
 ch as (select f.artifact_version from_version, t.artifact_version to_version, subject_id, object_id, change_kind, changed_columns from z join v t on t.i = z.i join v f on f.i = z.i - 1 where change_kind is not null)"""
def _cell(f: drift.Field) -> str:
    """The path and the type of a field in a file, for DuckDB."""
    spots = ["$." + ".".join(f'"{k}"' for k in p.split(".")) for p in P4_SQL_PATHS[f.name]]
    path = "case " + " ".join(f"when json_exists(body, '{x}') then '{p}'" for x, p in zip(spots, P4_SQL_PATHS[f.name], strict=True)) + " end"
    kind = "case " + " ".join(f"when json_exists(body, '{x}') then json_type(body, '{x}')" for x in spots) + " end"
    value = "case " + " ".join(f"when json_exists(body, '{x}') then json_extract(body, '{x}') " for x in spots) + " end"
    return f"select feed, file_id, written_at, '{f.name}' field_name, {value} j, {path} path, case {kind} when 'VARCHAR' then 'string' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'decimal' when 'ARRAY' then 'list' when 'OBJECT' then 'object' when 'BOOLEAN' then 'boolean' end tag from manifest_files"


_CELLS = "x as (" + " union all ".join(_cell(f) for f in P4_FIELDS) + ")"
ORACLES: dict[str, str] = {
    "p4_found": f"""with {_CELLS}, y as (select *, lag(path) over w before, row_number() over w k, last_value(tag ignore nulls) over (partition by feed, field_name order by written_at, file_id rows between unbounded preceding and 1 preceding) was from x window w as (partition by feed, field_name order by written_at, file_id))
 select feed, file_id, field_name, change_kind from (select *, unnest([case when before is null and path is not null then 'added' end, case when before is not null and path is null then 'removed' end, case when before <> path then 'renamed' end, case when before is not null and path is not null and was <> tag then 'retyped' end]) change_kind from y where k > 1) where change_kind is not null""",
    "p4_table": f"with {_CELLS}, y as (select *, case when field_name = 'coverage.coarser_than_year' then (case when try_cast(v as double) = floor(try_cast(v as double)) then try_cast(v as double)::bigint::varchar end) else v end canonical from (select *, case when tag = 'list' then array_to_string(from_json(j, '[\"VARCHAR\"]'), ' ') when tag = 'object' then (case field_name when 'notes' then j->>'$.summary' when 'generator' then trim(concat_ws(' ', j->>'$.module', array_to_string(from_json(j->'$.args', '[\"VARCHAR\"]'), ' '))) else j->>'$.n' end) when tag is not null then j->>'$' end v from x)) select file_id, max(feed) feed, "
    + ", ".join(f"max(path) filter (field_name = '{f.name}') {f.name.replace('.', '_')}_path, max(coalesce(tag, case when path is not null then 'null' end)) filter (field_name = '{f.name}') {f.name.replace('.', '_')}_tag, max(canonical) filter (field_name = '{f.name}'){'::bigint' if f.canonical == 'count' else ''} {f.name.replace('.', '_')}" for f in P4_FIELDS)
    + " from y group by 1",
    "p1_found": f"""with {_T}, {_A}, x as (
 select case_id record_id, 'expected.forbidden_triples' list_name, o outer_pos, unnest(range(len(y))) inner_pos, unnest(y) item from (select case_id, unnest(expected.forbidden_triples) y, unnest(range(len(expected.forbidden_triples))) o from a)
 union all select case_id, 'expected.resolution.node_id', 0, 0, expected.resolution.node_id from a
 union all select transcript_id::varchar, 'claims.source_ids', o, unnest(range(len(y.source_ids))), unnest(y.source_ids) from (select transcript_id, unnest(claims) y, unnest(range(len(claims))) o from t))
 select * from x where {_SAID.format(c='item')}""",
    "p3_found": f"""with recursive {_TREE}, g as (select w.id, w.cur, w.d from w join m using (id) where w.d = m.d)
 select g.id node_id, case when m.d < 300 then g.cur when lp.id is not null then lp.low else l2.low end root_id, (case when m.d < 300 then m.d when lp.id is not null then -1 else -2 end)::bigint depth
 from g join m using (id) left join lp using (id) left join lp l2 on l2.id = g.cur""",
    "p3_paths": f"""with recursive {_TREE}, g as (select w.id, w.cur, w.d from w join m using (id) where w.d = m.d),
 pa(id, d, path) as (select id, m.d, id from m where m.d = 0 union all select s.c, pa.d + 1, pa.path || ' > ' || s.c from pa join s on s.p = pa.id)
 select g.id node_id, case when m.d < 300 then g.cur when lp.id is not null then lp.low else l2.low end root_id, (case when m.d < 300 then m.d when lp.id is not null then -1 else -2 end)::bigint depth, pa.path
 from g join m using (id) left join lp using (id) left join lp l2 on l2.id = g.cur left join pa on pa.id = g.id""",
    "p3_further_parents": f"with {_SUB}, k as (select count(*) n from s where trim(c) <> '' and trim(p) <> '') select n n_links, (select coalesce(sum(x), 0) from (select count(*) - 1 x from s where trim(c) <> '' and trim(p) <> '' group by c))::bigint n_left_out from k",
    # objects named by ``_MAPS`` are tagged and not entered; no other key of these manifests holds a dot
    "p4_report": r"""with x as (select distinct m.file_id, replace(regexp_replace(substr(t.fullkey, 3), '\[[0-9]+\]', '[]', 'g'), '"', '') path, case t.type when 'VARCHAR' then 'string' when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'decimal' when 'ARRAY' then 'list' when 'OBJECT' then 'object' when 'BOOLEAN' then 'boolean' else 'null' end tag
  from manifest_files m, json_tree(m.body) t where json_valid(m.body) and t.parent is not null and not regexp_matches(t.fullkey, '^\$\.(source_snapshot|verification_counts)[.\[]')) select path, tag, count(*) n from x group by all""",
    "p4_names": "select * from (values " + ", ".join(f"('{n}', '{x}')" for n, xs in P4_SQL_PATHS.items() for x in xs) + ") v(field_name, path)",
    "p3_descendants": f"with recursive {_TREE} select w.cur ancestor_id, w.id node_id, w.d::bigint distance from w join m using (id) where w.d > 0 and m.d < 300",
    "p5_found": f"with {_REFS} select ref_table, ref_field, record_id, item_pos, ref_id, cause from o where cause is not null",
    "p5_report": f"with {_REFS} select ref_table, ref_field, strftime(tm, '%Y-%m') as \"month\", cause, count(*) n_refs, count(distinct record_id) n_records from o where cause is not null group by all",
    "p6_found": f"with {_VERSIONS} select from_version, to_version, subject_id, object_id, change_kind from ch",
    "p6_report": f"with {_VERSIONS} select from_version, to_version, change_kind, changed_columns, count(*) n_edges from ch group by all",
    "p1_claims": f"with {_T}, {_CL} select transcript_id, i::bigint pos_0, c.subject, c.predicate, c.object, c.subject_id, c.object_id, c.verification from cl",
    "p1_cases": f"with {_A} select case_id, expected.refusal expected_refusal, expected.max_approved_claims expected_max_approved_claims, expected.resolution.query_term expected_resolution_query_term, expected.resolution.node_id expected_resolution_node_id, expected.resolution.reason expected_resolution_reason, expected.must_name_gap expected_must_name_gap from a",
}
