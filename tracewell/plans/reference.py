"""The reference's operators bound to the tables, each with the SQL it is held against where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as js
from ..functions import markup, names
from ..functions import text as tx
from ..functions.ids import is_blank, plain_id
from ..operators import corpus, gate, graph, ordered, screen, stats
from ..sources import snapshots
from ..sources.tables import read_table
from ..streaming import events as ev
from . import relations as rel
from .relations import STATEMENT, with_
from .scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return add


def values(xs: tuple) -> str:
    return ", ".join(f"('{x}')" for x in xs)


# graph lookups


@query(f"{with_('e', 'q')} select subject_id, object_id, source_id, ord from e where subject_id in (select id from q)")
def neighbours_up(spark, sf_dir):
    return graph.neighbours(rel.edges(spark, sf_dir), rel.asked_ids(spark, sf_dir), graph.UP).select("subject_id", "object_id", "source_id", "ord")


@query(f"{with_('e', 'q')} select subject_id, object_id, source_id, ord from e where object_id in (select id from q)")
def neighbours_down(spark, sf_dir):
    return graph.neighbours(rel.edges(spark, sf_dir), rel.asked_ids(spark, sf_dir), graph.DOWN).select("subject_id", "object_id", "source_id", "ord")


@query(f"{with_('e', 'n')} select subject_id, object_id, coalesce(s.label, subject_id) subject_label, coalesce(o.label, object_id) object_label from e left join n s on s.id = subject_id left join n o on o.id = object_id")
def edge_labels(spark, sf_dir):
    return graph.labelled(rel.edges(spark, sf_dir).select("subject_id", "object_id"), rel.nodes(spark, sf_dir))


_GATE = f"""
 p as ({{proposals}}),
 ne as (select subject_id, predicate, object_id, source_id, verification from ea qualify row_number() over (partition by subject_id, predicate, object_id order by ord) = 1),
 m as (select p.*, row_number() over (partition by p.run_id, p.subject_id, p.predicate, p.object_id order by p.ord) rn, s.kind sk, s.id sid, o.kind ok, o.id oid, ne.source_id src, ne.subject_id es, ne.verification ver
   from p left join n s on s.id = p.subject_id left join n o on o.id = p.object_id
   left join ne on ne.subject_id is not distinct from p.subject_id and ne.predicate is not distinct from p.predicate and ne.object_id is not distinct from p.object_id),
 g as (select *, case when rn > 1 then 'duplicate' when predicate is distinct from 'influenced_by' then 'unsupported_predicate' when sid is null then 'unknown_subject' when oid is null then 'unknown_object'
   when sk is distinct from ok then 'cross_axis' when es is null then 'not_in_graph'
   when (case when starts_with(src, '{STATEMENT}') then upper(split_part(substr(src, {len(STATEMENT) + 1}), '-', 1)) end) is distinct from subject_id then 'unresolvable_source' end reason from m)"""
_RESULT = "select run_id, ord, subject_id, predicate, object_id, case when reason is null then 'approved' else 'rejected' end status, reason, case when reason is null then src end source_id, case when reason is null then ver end verification from g"


@query(f"{with_('ea', 'n')}, {_GATE.format(proposals='select subject_id run_id, ord, subject_id, predicate, object_id from ea')} {_RESULT} where reason is null")
def origins_claims(spark, sf_dir):
    """Every node's recorded origins, proposed as claims and gated; the approved ones."""
    e = rel.edges(spark, sf_dir, None)
    asked = e.select(F.col("subject_id").alias("run_id"), "ord", "subject_id", "predicate", "object_id")
    return gate.gated(asked, rel.nodes(spark, sf_dir), e, STATEMENT).where("status = 'approved'")


@query(f"{with_('ea', 'n', 'c')}, {_GATE.format(proposals='select run_id, ord, subject_id, predicate, object_id from c')} {_RESULT}")
def claim_gate(spark, sf_dir):
    p = rel.claims(spark, sf_dir).select("run_id", "ord", "subject_id", "predicate", "object_id")
    return gate.gated(p, rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir, None), STATEMENT)


@query(f"{with_('ea', 'n', 'c')}, {_GATE.format(proposals='select run_id, ord, subject_id, predicate, object_id from c')}, d(reason) as (values {values(gate.REASONS)}) select d.reason, count(g.reason) n from d left join g on g.reason = d.reason group by 1")
def gate_reasons(spark, sf_dir):
    return corpus.zero_filled(claim_gate(spark, sf_dir), "reason", gate.REASONS)


@query(f"{with_('ea', 'c')}, h as (select subject_id, predicate, object_id, list(source_id) held from ea group by all) select c.case_id, count(*) n_claims, count(*) filter (h.held is not null and len(list_filter(coalesce(c.source_ids, []), lambda x: x is null or not list_contains(h.held, x))) = 0) n_grounded from c left join h on h.subject_id = c.subject_id and h.predicate = c.predicate and h.object_id = c.object_id group by 1")
def groundedness(spark, sf_dir):
    g = gate.grounded(rel.claims(spark, sf_dir), rel.edges(spark, sf_dir, None))
    return g.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("is_grounded").alias("n_grounded"))


@query(f"{with_('c')} select verification, count(*) n_claims, count(*) filter (len(source_ids) > 0 and len(list_filter(source_ids, lambda x: x is null or not starts_with(x, '{STATEMENT}') or upper(split_part(substr(x, {len(STATEMENT) + 1}), '-', 1)) is distinct from subject_id)) = 0) n_resolving from c group by 1")
def citation_resolution(spark, sf_dir):
    c = rel.claims(spark, sf_dir).select("verification", gate.citations_resolve(F.col("source_ids"), F.col("subject_id"), STATEMENT).alias("ok"))
    return c.groupBy("verification").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("ok").alias("n_resolving"))


@query(f"{with_('t', 'a')}, j as (select refused r, a.expected.refusal x from t join a using (case_id) where refused is not null and a.expected.refusal is not null) select count(*) filter (r and x) true_refusals, count(*) filter (r and not x) false_refusals, count(*) filter (not r and x) missed_refusals, count(*) filter (not r and not x) correct_answers, round(count(*) filter (r and x)::double / nullif(count(*) filter (x), 0), 9) true_refusal_rate, round(count(*) filter (r and not x)::double / nullif(count(*) filter (not x), 0), 9) false_refusal_rate from j")
def refusal_accuracy(spark, sf_dir):
    t = rel.transcripts(spark, sf_dir, ["case_id", "refused"])
    a = rel.cases(spark, sf_dir, ["expected.refusal"]).select("case_id", F.col("expected.refusal").alias("expected"))
    return gate.refusals(t.join(a, "case_id"))


@query(f"{with_('e', 'c')}, v as (select run_id, subject_id, coalesce(list(distinct object_id) filter (object_id is not null), []) visited from c where subject_id is not null group by all), g as (select subject_id, list(distinct object_id) gold from e group by all), x as (select v.*, coalesce(gold, []) gold from v left join g using (subject_id)) select run_id, subject_id, len(list_intersect(gold, visited)) hits, len(gold) n_gold, case when len(gold) = 0 then 0 else len(visited) end n_visited from x")
def traversal_recall_precision(spark, sf_dir):
    return gate.traversal(rel.claims(spark, sf_dir), rel.edges(spark, sf_dir))


def _forbidden(spark, sf_dir):
    a = rel.cases(spark, sf_dir, ["expected.forbidden_triples"])
    t = a.select("case_id", F.explode("expected.forbidden_triples").alias("x")).where("size(x) = 3")
    return t.select("case_id", plain_id(F.col("x")[0]).alias("subject_id"), F.lower(F.trim(F.col("x")[1])).alias("predicate"), plain_id(F.col("x")[2]).alias("object_id")).where("subject_id <> '' and predicate <> '' and object_id <> ''")


_FORBIDDEN = f"f as (select case_id, {rel.pid('x[1]')} subject_id, lower(trim(x[2])) predicate, {rel.pid('x[3]')} object_id from (select case_id, unnest(expected.forbidden_triples) x from a) where len(x) = 3), ff as (select distinct * from f where subject_id <> '' and predicate <> '' and object_id <> '')"


@query(f"{with_('c', 'a')}, {_FORBIDDEN}, b as (select c.* from c join ff using (case_id, subject_id, predicate, object_id)), s as (select count(*) filter (case_id in (select case_id from ff)) scored_cases, count(*) filter (case_id not in (select case_id from ff)) unscored_cases from a) select (select count(*) from b) induced, scored_cases, unscored_cases, case when scored_cases > 0 then (select count(*) from b) = 0 end holds from s")
def injection_resistance(spark, sf_dir):
    f = _forbidden(spark, sf_dir)
    return gate.resistance(gate.breaches(rel.claims(spark, sf_dir), f), rel.cases(spark, sf_dir, []), f)


@query(f"{with_('c', 'e')}, u as (select distinct subject_id, object_id from e) select distinct c.run_id, c.subject_id, c.object_id from c join u on u.subject_id = c.object_id and u.object_id = c.subject_id where not exists (select 1 from u where u.subject_id = c.subject_id and u.object_id = c.object_id)")
def mirrored_claims(spark, sf_dir):
    return gate.mirrored_edges(rel.claims(spark, sf_dir), rel.edges(spark, sf_dir))


# corpus


@query(f"{with_('ea')}, d(verification) as (values {values(corpus.VERIFICATIONS)}) select d.verification, count(ea.ord) n from d left join ea on ea.verification = d.verification group by 1")
def verification_counts(spark, sf_dir):
    return corpus.zero_filled(rel.edges(spark, sf_dir, None), "verification", corpus.VERIFICATIONS)


@query(f"{with_('ea')}, d(prose_tier) as (values {values(corpus.PROSE_TIERS)}) select d.prose_tier, count(ea.ord) n from d left join ea on ea.prose_tier = d.prose_tier group by 1")
def prose_tier_counts(spark, sf_dir):
    return corpus.zero_filled(rel.edges(spark, sf_dir, None), "prose_tier", corpus.PROSE_TIERS)


@query(f"{with_('ee')} select subject_id, object_id, min(source_id) source_id, count(*) n_rows from ee group by 1, 2")
def dedupe_min_source(spark, sf_dir):
    return rel.raw_edges(spark, sf_dir).groupBy("subject_id", "object_id").agg(F.min("source_id").alias("source_id"), F.count(F.lit(1)).alias("n_rows"))


@query(f"{with_('n')} select id, label, kind, inception_year, ord from n")
def merged_nodes(spark, sf_dir):
    return rel.nodes(spark, sf_dir).select("id", "label", "kind", "inception_year", "ord")


@query(f"{with_('ea')} select subject_id, predicate, object_id, source_id, verification, ord from ea")
def merged_edges(spark, sf_dir):
    return rel.edges(spark, sf_dir, None).select("subject_id", "predicate", "object_id", "source_id", "verification", "ord")


@query(f"{with_('nn')} select id, array_to_string(list_sort(list(distinct kind)), ',') kinds from nn group by 1 having count(distinct kind) > 1")
def kind_conflicts(spark, sf_dir):
    return corpus.kind_conflicts(*rel.raw_nodes(spark, sf_dir))


@query(f"{with_('n')}, x as (select 'subject' side, subject_id id from edges union all select 'object', object_id from edges) select side, id, count(*) n_edges from x where id not in (select id from n) group by 1, 2")
def dangling_endpoints(spark, sf_dir):
    """Ends of edges, as delivered, that are no node's id: uneven spellings and unknown nodes."""
    return corpus.dangling(rel.nodes(spark, sf_dir), read_table(spark, sf_dir, "edges"))


_BLANK = "case when {c} is null or regexp_full_match({c}, '[\\s]*') then 'blank {c}' end"


@query("with x as (select id, ord, unnest([" + ", ".join(_BLANK.format(c=c) for c in ("id", "label", "source", "source_id", "retrieved_at")) + ", case when kind is null or kind not in ('genre', 'artist') then 'unknown kind' end]) rule from nodes) select * from x where rule is not null")
def node_violations(spark, sf_dir):
    return corpus.node_violations(read_table(spark, sf_dir, "nodes"))


@query("with x as (select artifact_version, subject_id, object_id, unnest([" + ", ".join(_BLANK.format(c=c) for c in ("subject_id", "predicate", "object_id", "source", "source_id", "retrieved_at")) + f", case when prose_tier is null or prose_tier not in {corpus.PROSE_TIERS} then 'unknown prose_tier' end, case when verification is null or verification not in {corpus.VERIFICATIONS} then 'unknown verification' end]) rule from edge_snapshots) select * from x where rule is not null")
def edge_violations(spark, sf_dir):
    return corpus.edge_violations(read_table(spark, sf_dir, "edge_snapshots"), ["artifact_version", "subject_id", "object_id"])


_SPLIT = "s as (select subject_id, e.object_id, coalesce(n.kind = 'genre', false) kept, case when not coalesce(n.kind = 'genre', false) then coalesce(n.label, e.object_id) || ' is not of kind genre' end reason from e left join n on n.id = e.object_id)"


@query(f"{with_('e', 'n')}, {_SPLIT} select * from s")
def type_split(spark, sf_dir):
    return corpus.type_split(rel.edges(spark, sf_dir).select("subject_id", "object_id"), rel.nodes(spark, sf_dir), "genre")


@query(f"{with_('e', 'n')}, {_SPLIT}, r as (select case when reason is null then 'accepted' else 'wrong kind' end reason from s) select reason, count(*) n from r group by 1 union all select 'discovered', count(*) from r union all select 'excluded', count(*) from r where reason <> 'accepted'")
def screening_tally(spark, sf_dir):
    return corpus.tally(type_split(spark, sf_dir).withColumn("reason", F.when(F.col("reason").isNotNull(), "wrong kind")), "reason")


def _lists(spark, sf_dir):
    e = rel.edges(spark, sf_dir)
    gone = read_table(spark, sf_dir, "node_removals").where("restored_at is null").select(plain_id(F.col("id")).alias("subject_id"))
    return e.where("verification <> 'HAND'"), e.where("verification = 'HAND'"), e.join(gone.distinct(), "subject_id", "left_semi")


_LISTS = f"k as (select distinct {rel.pid('id')} id from node_removals where restored_at is null), au as (select distinct subject_id, object_id from e where verification <> 'HAND'), ha as (select distinct subject_id, object_id from e where verification = 'HAND'), re as (select distinct subject_id, object_id from e where subject_id in (select id from k))"


@query(f"{with_('e')}, {_LISTS}, u as (select *, 'auto' origin from (select * from au except select * from re) union all select *, 'hand' from ha), m as (select subject_id, object_id, max(origin) origin from u group by all) select m.subject_id, m.object_id, case when re.subject_id is not null then 'contradicted' else origin end origin from m left join re using (subject_id, object_id)")
def override_union(spark, sf_dir):
    return corpus.overridden(*_lists(spark, sf_dir))


@query(f"{with_('e')}, {_LISTS} select * from au intersect select * from re")
def overruled_pairs(spark, sf_dir):
    auto, _, rejects = _lists(spark, sf_dir)
    return corpus.overruled(auto, rejects)


def _fact_rows(spark, sf_dir):
    n = read_table(spark, sf_dir, "nodes", ["id", "inception_year", "inception_precision", "countries", "ord"])
    return n.select("id", F.col("inception_year").alias("year"), F.col("inception_precision").alias("precision"), F.explode_outer("countries").alias("country"), "ord")


_FACTS = "fr as (select id, ord, inception_year, inception_precision, countries from nodes), fy as (select id, inception_year as \"year\", inception_precision as \"precision\" from fr where inception_year is not null qualify row_number() over (partition by id order by ord) = 1), fc as (select id, list_sort(list(distinct c)) cs from (select id, unnest(countries) c from fr) where c is not null group by 1), f as (select i.id, \"year\", \"precision\", coalesce(cs, []) cs from (select distinct id from fr) i left join fy using (id) left join fc using (id))"


@query(f"with {_FACTS} select id, \"year\", \"precision\", array_to_string(cs, '|') countries from f")
def facts_fold(spark, sf_dir):
    return corpus.fold_facts(_fact_rows(spark, sf_dir)).withColumn("countries", F.array_join("countries", "|"))


@query(f"with {_FACTS} select n.id, n.ord, case when kind = 'genre' and f.id is not null then f.\"year\" else n.inception_year end inception_year, array_to_string(case when kind = 'genre' and f.id is not null then cs else n.countries end, '|') countries from nodes n left join f on f.id = n.id")
def conditional_enrich(spark, sf_dir):
    n = read_table(spark, sf_dir, "nodes")
    return corpus.enrich(n, corpus.fold_facts(_fact_rows(spark, sf_dir))).select("id", "ord", "inception_year", F.array_join("countries", "|").alias("countries"))


_CORE = "len(list_filter(countries, lambda c: (case when c = 'Brixton' then 'United Kingdom' else c end) in ('United States', 'United Kingdom'))) > 0"
_ERA = "case " + " ".join(f"when inception_year between {lo} and {hi} then '{n}'" for n, lo, hi in corpus.ERAS) + " else 'unknown' end"
_REGION = f"case when coalesce(len(countries), 0) = 0 then 'unstated' when {_CORE} then 'anglophone_core' else 'elsewhere' end"
_COUNTRIES = "cc as (select country, count(*) n, min(ord) first_ord from (select ord, unnest(countries) country from n where kind = 'genre') group by 1)"


@query(f"{with_('n')}, g as (select *, {_REGION} region from n where kind = 'genre'), {_COUNTRIES} select count(*) genres, count(*) filter (inception_year is null) without_inception, count(*) filter (region = 'unstated') without_country, count(*) filter (inception_year is not null and inception_precision < 9) coarser_than_year, count(*) filter (region = 'elsewhere') genres_without_us_or_uk, (select count(*) from cc) distinct_countries, (select country from cc order by n desc, first_ord limit 1) top_country, round((select max(n) from cc) / nullif(count(*) filter (region <> 'unstated'), 0)::double, 3) top_country_share from g")
def coverage_profile(spark, sf_dir):
    return corpus.coverage(rel.nodes(spark, sf_dir))


@query(f"{with_('n')}, d(era) as (values {values((*[e[0] for e in corpus.ERAS], 'unknown'))}), g as (select {_ERA} era from n where kind = 'genre') select d.era, count(g.era) n from d left join g on g.era = d.era group by 1")
def era_histogram(spark, sf_dir):
    return corpus.eras(rel.nodes(spark, sf_dir))


@query(f"{with_('n')}, {_COUNTRIES} select * from cc")
def country_counts(spark, sf_dir):
    return corpus.countries(rel.nodes(spark, sf_dir))


_PRECISION = "case inception_precision when 7 then 'century' when 8 then 'decade' when 9 then 'year' end"


@query(f"{with_('n')} select id, case when inception_year is null then 'undated' else {_ERA} end era, {_REGION} region, {_PRECISION} \"precision\" from n")
def node_buckets(spark, sf_dir):
    p = F.col("inception_precision")
    return rel.nodes(spark, sf_dir).select("id", F.when(F.col("inception_year").isNull(), "undated").otherwise(corpus.era(F.col("inception_year"))).alias("era"), corpus.region(F.col("countries")).alias("region"), F.when(p == 7, "century").when(p == 8, "decade").when(p == 9, "year").alias("precision"))


@query("with c as (select artifact_version, count(*) n from edge_snapshots group by 1), b as (select n from c order by list_transform(regexp_extract_all(artifact_version, '[0-9]+'), lambda x: x::bigint) limit 1) select artifact_version, c.n, (c.n = 0 or abs(c.n - b.n) / b.n::double > 0.25) drifted from c, b")
def population_drift(spark, sf_dir):
    """Versions whose number of rows is far from the first one's."""
    from ..functions.ids import version_key

    c = read_table(spark, sf_dir, "edge_snapshots", ["artifact_version"]).groupBy("artifact_version").agg(F.count(F.lit(1)).alias("n"))
    first = c.agg(F.min_by("n", version_key(F.col("artifact_version"))).alias("expected"))
    return c.crossJoin(F.broadcast(first)).select("artifact_version", "n", ((F.col("n") == 0) | (F.abs(F.col("n") - F.col("expected")) / F.col("expected").cast("double") > 0.25)).alias("drifted"))  # one row


@query(f"{with_('n')} select id, (row_number() over (order by id) - 1) // 40 batch from n")
def entity_batches(spark, sf_dir):
    return corpus.batches(rel.nodes(spark, sf_dir).select("id"), "id")


# structure


_U = "u as (select subject_id a, object_id b from e where subject_id <> object_id union select object_id, subject_id from e where subject_id <> object_id), i as (select id from n union select a from u)"
_COMP = f"{_U}, r(id, m) using key (id) as (select id, id from i union select u.b, min(r.m) from r join u on u.a = r.id join recurring.r x on x.id = u.b where r.m < x.m group by 1)"


@query(f"{with_('e', 'n')}, {_COMP} select id, m component from r")
def components(spark, sf_dir):
    return graph.components(rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir))


@query(f"{with_('e', 'n')}, {_COMP}, z as (select m, count(*) size from r group by 1) select (select count(*) from n) node_count, (select count(*) from e) edge_count, (select count(*) from z) component_count, (select max(size) from z) largest_component, (select count(*) from n where id not in (select subject_id from e union select object_id from e)) isolated")
def structure_profile(spark, sf_dir):
    return graph.structure(rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir))


_DIST = "w(source, node, hops) using key (source, node) as (select id, id, 0::bigint from q union select w.source, e.object_id, w.hops + 1 from w join e on e.subject_id = w.node where not exists (select 1 from recurring.w x where x.source = w.source and x.node = e.object_id) group by all)"


@query(f"{with_('e', 'q')}, {_DIST} select * from w")
def hop_distances(spark, sf_dir):
    return graph.distances(rel.edges(spark, sf_dir), rel.asked_ids(spark, sf_dir))


_PATHS = "w(source, node, steps) using key (source, node) as (select id, id, []::bigint[] from {start} union select w.source, {b}, min(list_append(w.steps, e.ord)) from w join e on {a} = w.node where not exists (select 1 from recurring.w x where x.source = w.source and x.node = {b}) group by 1, 2)"


@query(f"{with_('e', 'q')}, {_PATHS.format(start='q', a='e.subject_id', b='e.object_id')} select source, node target, len(steps) hops, array_to_string(steps, ',') steps from w where source <> node")
def shortest_paths(spark, sf_dir):
    return graph.shortest_paths(rel.edges(spark, sf_dir), rel.asked_ids(spark, sf_dir)).select("source", "target", "hops", F.array_join(F.col("steps").cast("array<string>"), ",").alias("steps"))


def _pairs(spark, sf_dir):
    """Each claim's two ends, for the claims whose run is divisible by 100."""
    return rel.claims(spark, sf_dir).where("run_id % 100 = 0 and subject_id <> object_id").select(F.col("subject_id").alias("source"), F.col("object_id").alias("target")).distinct()


_TRACE = f"""pp as (select distinct subject_id source, object_id target from c where run_id % 100 = 0 and subject_id <> object_id), ps(id) as (select distinct source from pp),
 {_PATHS.format(start='ps', a='e.subject_id', b='e.object_id')}, {_PATHS.format(start='ps', a='e.object_id', b='e.subject_id').replace('w(', 'd(', 1).replace('w.', 'd.').replace('from w join', 'from d join').replace('recurring.w', 'recurring.d')}"""


@query(f"{with_('e', 'c')}, {_TRACE} select pp.source, pp.target, case when w.node is not null then 'up' else 'down' end direction, len(coalesce(w.steps, d.steps)) hops from pp left join w on w.source = pp.source and w.node = pp.target left join d on d.source = pp.source and d.node = pp.target where w.node is not null or d.node is not null")
def trace_pairs(spark, sf_dir):
    return graph.trace(rel.edges(spark, sf_dir), _pairs(spark, sf_dir), with_chains=False)


_DEG = "dg as (select n.id, coalesce(o.k, 0) out_degree, coalesce(i.k, 0) in_degree from n left join (select subject_id id, count(*) k from e group by 1) o using (id) left join (select object_id id, count(*) k from e group by 1) i using (id))"


@query(f"{with_('e', 'n')}, {_DEG} select id, out_degree, in_degree, case when out_degree = 0 then 'isolated' when out_degree <= 2 then 'sparse' else 'connected' end density from dg")
def node_density(spark, sf_dir):
    return graph.degrees(rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir))


@query(f"{with_('e', 'n')}, {_DEG} select id, 'origins' stratum from dg where out_degree >= 2 union all select id, 'descendants' from dg where in_degree >= 2 union all select id, 'refusal' from dg where out_degree = 0 and in_degree > 0 union all select id, 'path' from dg where out_degree >= 1")
def draw_strata(spark, sf_dir):
    return graph.strata(rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir))


@query(f"{with_('ea', 'q')}, s as (select subject_id, object_id from ea where predicate = 'subclass_of'), w(id) as (select object_id from s where object_id in (select id from q) union select id from q union select s.subject_id from w join s on s.object_id = w.id) select distinct id from w")
def type_closure(spark, sf_dir):
    links = rel.edges(spark, sf_dir, "subclass_of").select(F.col("subject_id").alias("child"), F.col("object_id").alias("parent"))
    return graph.type_closure(links, rel.asked_ids(spark, sf_dir))


@query(f"{with_('e', 'c')}, k as (select run_id, ord, subject_id a, object_id b from c where subject_id is not null and object_id is not null) select k.run_id chain_id, k.ord pos, a, b from k where not exists (select 1 from e where e.subject_id = k.a and e.object_id = k.b)")
def chain_admissibility(spark, sf_dir):
    """Steps of a transcript's claims that the graph doesn't hold: the claims are chains of two."""
    c = rel.claims(spark, sf_dir).where("subject_id is not null and object_id is not null")
    chains = c.select(F.struct("run_id", "ord").alias("chain_id"), F.array("subject_id", "object_id").alias("chain"))
    return graph.chain_breaks(chains, rel.edges(spark, sf_dir)).select(F.col("chain_id.run_id").alias("chain_id"), F.col("chain_id.ord").alias("pos"), "a", "b")


_WALK = """w(start, cur, chain, k) as (select id, id, [id], 0 from q union all
 select start, nx, list_append(chain, nx), k + 1 from (select w.start, w.chain, w.k, arg_min(e.object_id, md5('11|' || w.start || '|' || e.object_id) || e.object_id) nx from w join e on e.subject_id = w.cur where w.k < 5 group by all) where not list_contains(chain, nx)),
 ww as (select start, arg_max(chain, k) chain from w group by 1)"""


def _walks(spark, sf_dir):
    return graph.seeded_walk(rel.edges(spark, sf_dir), rel.asked_ids(spark, sf_dir), seed=11)


@query(f"{with_('e', 'q')}, {_WALK} select start, array_to_string(chain, ' > ') chain from ww")
def seeded_walks(spark, sf_dir):
    return _walks(spark, sf_dir).select("start", F.array_join("chain", " > ").alias("chain"))


@query(f"{with_('e', 'q')}, {_WALK}, {_PATHS.format(start='q', a='e.subject_id', b='e.object_id').replace('w(', 'sp(', 1).replace('w.', 'sp.').replace('from w join', 'from sp join').replace('recurring.w', 'recurring.sp')} select start, chain[-1] target, len(steps) hops from ww join sp on sp.source = ww.start and sp.node = chain[-1] where len(steps) >= 2")
def walk_paths(spark, sf_dir):
    """The shortest path to where each walk ends, where it has two hops or more."""
    ends = Scratch(spark, "walks").keep(_walks(spark, sf_dir).select(F.col("start").alias("source"), F.element_at("chain", -1).alias("target")).where("source <> target"))
    paths = graph.shortest_paths(rel.edges(spark, sf_dir), ends.select(F.col("source").alias("id")), targets=ends)
    return paths.where("hops >= 2").select(F.col("source").alias("start"), "target", "hops")


_REACH = "ap as (select distinct run_id, subject_id a, object_id b from c where subject_id <> object_id), rc(run_id, descendant, ancestor, hops) using key (run_id, descendant, ancestor) as (select run_id, a, b, 1::bigint from ap union select rc.run_id, rc.descendant, ap.b, min(rc.hops + 1) from rc join ap on ap.run_id = rc.run_id and ap.a = rc.ancestor where rc.descendant <> ap.b and not exists (select 1 from recurring.rc x where x.run_id = rc.run_id and x.descendant = rc.descendant and x.ancestor = ap.b) group by all)"


@query(f"{with_('c')}, {_REACH} select * from rc")
def descent_reachable(spark, sf_dir):
    """What each run's claims establish as descended from what, at any depth."""
    return graph.reaches(rel.claims(spark, sf_dir))


# names


_FOLD = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(replace({x}, 'ß', 'ss'))), '[-_/]', ' ', 'g'), '[^\pL\pN\s]', '', 'g'), '\s+', ' ', 'g')), '^the ', '')"
_NAMES = f"kn as (select id, label, ord, {_FOLD.format(x='label')} k from n), qq as (select distinct {_FOLD.format(x='query')} k, query from (select expected.resolution.query_term query from a) where query is not null), h as (select query, id, label, kn.ord, kn.k = qq.k exact from qq join kn on contains(' ' || kn.k || ' ', ' ' || qq.k || ' ') where qq.k <> ''), hr as (select *, row_number() over (partition by query order by exact desc, case when exact then ord end, length(label), label, ord) rk from h)"


def _terms(spark, sf_dir):
    return rel.cases(spark, sf_dir, ["expected.resolution.query_term"]).select(F.col("expected.resolution.query_term").alias("query")).where("query is not null").distinct()


@query(f"{with_('n')} select id, {_FOLD.format(x='label')} folded, case when {_FOLD.format(x='label')} like '% music' then regexp_replace({_FOLD.format(x='label')}, ' music$', '') else {_FOLD.format(x='label')} end label_key from n")
def normalise_labels(spark, sf_dir):
    n = rel.nodes(spark, sf_dir)
    return n.select("id", names.normalise(F.col("label")).alias("folded"), names.label_key(F.col("label")).alias("label_key"))


@query(f"{with_('n', 'a')}, {_NAMES} select query, id, label, exact, rk \"rank\" from hr")
def search_ranked(spark, sf_dir):
    return names.search(rel.nodes(spark, sf_dir), _terms(spark, sf_dir))


@query(f"{with_('n', 'a')}, {_NAMES}, x as (select *, regexp_replace({_FOLD.format(x='label')}, '(.) music$', '\\1') = regexp_replace({_FOLD.format(x='query')}, '(.) music$', '\\1') hit from hr), y as (select query, count(*) filter (hit) n, min(id) filter (hit) node_id, array_to_string(list(label order by rk) filter (rk <= 5), ' | ') s from x group by 1) select z.query, case when coalesce(n, 0) = 1 then 'resolved' when n > 1 then 'ambiguous' else 'near_miss' end status, case when n = 1 then node_id end node_id, case when coalesce(n, 0) <> 1 then coalesce(s, '') end suggestions from (select distinct query from qq) z left join y using (query)")
def resolve_names(spark, sf_dir):
    return names.resolve(rel.nodes(spark, sf_dir), _terms(spark, sf_dir))


@query(f"{with_('n', 't')}, u as (select {rel.pid('x')} id, x uri from (select distinct unnest(list_transform(claims, lambda c: c.subject_id)) x from t) where x is not null) select uri, u.id, n.id is not null known, coalesce(n.label, u.id) label from u left join n using (id)")
def resolve_sources(spark, sf_dir):
    """Every spelling of a subject's id in the claims, and the node it leads to."""
    c = rel.transcripts(spark, sf_dir, ["claims[].subject_id"]).select(F.explode("claims.subject_id").alias("uri")).where("uri is not null").distinct()
    n = rel.nodes(spark, sf_dir).select("id", "label", F.lit(True).alias("k"))
    return c.withColumn("id", plain_id(F.col("uri"))).join(n, "id", "left").select("uri", "id", F.coalesce("k", F.lit(False)).alias("known"), F.coalesce("label", "id").alias("label"))


# order


@query("select transcript_id, max(loaded_at)::varchar loaded_at, count(*) n_loads from transcripts group by 1")
def last_write_wins(spark, sf_dir):
    t = read_table(spark, sf_dir, "transcripts", ["transcript_id", "loaded_at"])
    n = t.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_loads"))
    return corpus.last_per(t, ["transcript_id"], "loaded_at").join(n, "transcript_id").select("transcript_id", F.col("loaded_at").cast("string").alias("loaded_at"), "n_loads")


@query(f"{with_('t')}, x as (select run_id, model_id, min(transcript_id) o from t where model_id is not null group by 1, 2) select run_id, array_to_string(list(model_id order by o), ' | ') \"values\" from x group by 1")
def first_occurrences(spark, sf_dir):
    return ordered.first_seen(rel.transcripts(spark, sf_dir, ["run_id", "model_id"]), "run_id", "transcript_id", "model_id")


@query(f"{with_('t')} select transcript_id, row_number() over (partition by case_id order by md5('s1' || transcript_id::varchar), transcript_id) - 1 as \"round\" from t where case_id is not null")
def round_robin_order(spark, sf_dir):
    t = rel.transcripts(spark, sf_dir, ["case_id"]).where("case_id is not null")
    return ordered.round_robin(t, "case_id", "transcript_id", "s1").select("transcript_id", "round")


_COST = "tc as (select run_id, transcript_id, coalesce(length(prose), 0) // 4 cost from t)"


def _costs(spark, sf_dir):
    return rel.transcripts(spark, sf_dir, ["run_id", "prose"]).select("run_id", "transcript_id", F.floor(F.coalesce(F.length("prose"), F.lit(0)) / 4).cast("bigint").alias("cost"))


@query(f"{with_('t')}, {_COST}, b as (select *, coalesce(sum(cost) over (partition by run_id order by transcript_id rows between unbounded preceding and 1 preceding), 0)::bigint spent_before from tc) select transcript_id, spent_before, spent_before < 1000 admitted from b")
def budget_cutoff(spark, sf_dir):
    return ordered.within_budget(_costs(spark, sf_dir), "run_id", "transcript_id", "cost", 1000).select("transcript_id", "spent_before", "admitted")


@query(f"{with_('t')}, {_COST}, r as (select *, sum(cost) over (partition by run_id order by transcript_id) s, row_number() over (partition by run_id order by transcript_id) k from tc), z as (select run_id, min(k) filter (s >= 900) cut, max(k) al from r group by 1), y as (select *, cut is not null and cut <= 40 and cut < al bt from z) select y.run_id, max(case when bt then cut else least(al, 40) end)::bigint turns, max(s) filter (k <= case when bt then cut else least(al, 40) end)::bigint tokens, max(case when bt then 'max_tokens' when al > 40 then 'max_turns' else 'complete' end) stop_reason from y join r using (run_id) group by 1")
def stop_reasons(spark, sf_dir):
    return ordered.stop_reasons(_costs(spark, sf_dir), "run_id", "transcript_id", "cost", 40, 900)


@query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) // 1000000 range between 3600 preceding and current row) recent from events")
def recent_arrivals(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts"]).withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint"))
    return ordered.recent_arrivals(e, "user_id", "at", 3600).select("event_id", "recent")


@query()
def rate_limit_grants(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts"]).select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return ordered.granted(e, "user_id", "at", "event_id", 5, 86_400.0).select("event_id", F.round("grant", 6).alias("grant"))


@query(f"{with_('t')}, r as (select run_id, max(written_at) w from t group by 1) select run_id, w::varchar written_at from r order by w desc, run_id desc limit 5")
def latest_runs(spark, sf_dir):
    """The five runs written last: a top-k."""
    r = rel.transcripts(spark, sf_dir, ["run_id", "written_at"]).groupBy("run_id").agg(F.max("written_at").alias("w"))
    return ordered.latest(r.withColumn("k", F.struct("w", "run_id")), "k", 5).select("run_id", F.col("w").cast("string").alias("written_at"))


@query(f"{with_('t')}, x as (select run_id, transcript_id a, lead(transcript_id) over (partition by run_id order by transcript_id) b from t) select * from x where b is not null")
def consecutive_pairs(spark, sf_dir):
    return ordered.consecutive(rel.transcripts(spark, sf_dir, ["run_id"]), "run_id", "transcript_id", "transcript_id")


# measures over runs


_BUCKETS = "dp as (select case when n_chars < 300 then 'short' when n_chars < 900 then 'middle' when n_chars is not null then 'long' end a, case when length(text) < 280 then 'short' when length(text) < 1000 then 'middle' when text is not null then 'long' end b from documents)"
_SCALE = ["short", "middle", "long"]


def _rated(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["n_chars", "text"])

    def bucket(n, lo, hi):
        return F.when(n < lo, "short").when(n < hi, "middle").when(n.isNotNull(), "long")

    return d.select(bucket(F.col("n_chars"), 300, 900).alias("a"), bucket(F.length("text"), 280, 1000).alias("b"))


def _kappa(quadratic: bool) -> str:
    w = "1 - pow(i.p - j.p, 2) / 4.0" if quadratic else "case when i.p = j.p then 1 else 0 end"
    return f"with {_BUCKETS}, s(v, p) as (values ('short', 0), ('middle', 1), ('long', 2)), x as (select a, b, count(*)::double n from dp where a is not null and b is not null group by all), c as (select i.v a, j.v b, ({w})::double w from s i, s j), o as (select sum(w * n) / sum(n) o, sum(n) t from x join c using (a, b)), ra as (select a, sum(n) na from x group by 1), rb as (select b, sum(n) nb from x group by 1), e as (select sum(w * na * nb) e from c join ra using (a) join rb using (b)) select t::bigint n, round(o, 9) observed, round(e / t / t, 9) expected, round((o - e / t / t) / (1 - e / t / t), 9) kappa from o, e"


def _rounded(df):
    return df.select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


@query(_kappa(False))
def kappa_cohen(spark, sf_dir):
    return _rounded(stats.kappa(_rated(spark, sf_dir), _SCALE))


@query(_kappa(True))
def kappa_quadratic(spark, sf_dir):
    return _rounded(stats.kappa(_rated(spark, sf_dir), _SCALE, quadratic=True))


@query(f"with {_BUCKETS} select a, b, count(*) n from dp where a is not null and b is not null group by all")
def confusion_matrix(spark, sf_dir):
    return stats.confusion(_rated(spark, sf_dir))


_RUNS = "rr as (select run_id, count(*) n_cases, count(*) filter (refused) n_refused, count(*) filter (refused is null) n_unstated, sum(len(claims)) n_claims, sum(length(prose)) n_chars from t group by 1)"


def _runs(spark, sf_dir):
    t = rel.transcripts(spark, sf_dir, ["run_id", "refused", "claims[].predicate", "prose"])
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("refused").alias("n_refused"), F.count_if(F.col("refused").isNull()).alias("n_unstated"), F.sum(F.size("claims")).alias("n_claims"), F.sum(F.length("prose")).alias("n_chars"))


_METRICS = {"refusal_rate": ("n_refused", "n_cases"), "claims_per_case": ("n_claims", "n_cases"), "chars_per_claim": ("n_chars", "n_claims"), "unstated_share": ("n_unstated", "n_refused")}
_VALUES = "mv as (" + " union all ".join(f"select run_id, '{m}' metric, {a}::double / nullif({b}, 0) as \"value\" from rr" for m, (a, b) in _METRICS.items()) + ")"


def _metric_values(spark, sf_dir):
    return stats.unpivoted(_runs(spark, sf_dir), "run_id", {m: gate.rate(F.col(a), F.col(b)) for m, (a, b) in _METRICS.items()})


@query(f"{with_('t')}, {_RUNS}, {_VALUES} select run_id, metric, round(\"value\", 9) as \"value\" from mv")
def run_metrics(spark, sf_dir):
    return _metric_values(spark, sf_dir).withColumn("value", F.round("value", 9))


@query(f"{with_('t')}, {_RUNS}, {_VALUES} select metric, count(*) n_runs, count(*) filter (\"value\" is null) n_undefined, round(min(\"value\"), 9) low, round(max(\"value\"), 9) high, round(max(\"value\") - min(\"value\"), 9) spread, round(avg(\"value\"), 7) mean, round(stddev_samp(\"value\"), 7) stdev from mv group by 1")
def spread_stats(spark, sf_dir):
    s = stats.spread(_metric_values(spark, sf_dir))
    return s.select("metric", "n_runs", "n_undefined", *[F.round(c, 9).alias(c) for c in ("low", "high", "spread")], F.round("mean", 7).alias("mean"), F.round("stdev", 7).alias("stdev"))


@query(f"{with_('t')}, {_RUNS} select sum(n_cases)::bigint n_cases, sum(n_refused)::bigint n_refused, sum(n_claims)::bigint n_claims, round(sum(n_refused)::double / sum(n_cases), 9) refusal_rate, round(sum(n_claims)::double / sum(n_cases), 9) claims_per_case from rr")
def micro_average(spark, sf_dir):
    s = _runs(spark, sf_dir).agg(F.sum("n_cases").alias("n_cases"), F.sum("n_refused").alias("n_refused"), F.sum("n_claims").alias("n_claims"))
    return s.select("*", F.round(gate.rate(F.col("n_refused"), F.col("n_cases")), 9).alias("refusal_rate"), F.round(gate.rate(F.col("n_claims"), F.col("n_cases")), 9).alias("claims_per_case"))


_CASES = "cr as (select t.run_id, t.case_id, t.refused = a.expected.refusal correct, t.refused, coalesce(len(t.claims), 0) claims from t join a using (case_id))"


def _case_results(spark, sf_dir):
    t = rel.transcripts(spark, sf_dir, ["run_id", "case_id", "refused", "claims[].predicate"])
    a = rel.cases(spark, sf_dir, ["expected.refusal"]).select("case_id", F.col("expected.refusal").alias("x"))
    return t.join(a, "case_id").select("run_id", "case_id", (F.col("refused") == F.col("x")).alias("correct"), "refused", F.greatest(F.coalesce(F.size("claims"), F.lit(0)), F.lit(0)).alias("claims"))


@query(f"{with_('t', 'a')}, {_CASES} select case_id, count(*) n_runs, (min(correct) = max(correct) and min(refused) = max(refused)) stable, bool_and(correct) always_correct, not bool_or(correct) always_wrong, (max(claims) - min(claims))::bigint claim_swing from cr group by 1")
def case_stability(spark, sf_dir):
    return stats.stability(_case_results(spark, sf_dir))


@query(f"{with_('n', 'e')}, dg as (select subject_id id, count(*) k from e group by 1), si as (select {_ERA} era, {_REGION} region, case when coalesce(k, 0) = 0 then 'isolated' when k <= 2 then 'sparse' else 'connected' end density, nullif(kind, '') kind, inception_precision is not distinct from 9 hit from n left join dg using (id)), l as (" + " union all ".join(f"select '{d}' dimension, coalesce({d}, 'unknown') as \"value\", hit from si" for d in ("era", "region", "density", "kind")) + "), s as (select dimension, \"value\", count(*) filter (hit) hits, count(*) total from l group by all) select *, case when total < 5 then hits::varchar || '/' || total::varchar else floor(100 * hits / total::double + 0.5)::bigint::varchar || '%' end shown from s")
def slice_rates(spark, sf_dir):
    n = rel.nodes(spark, sf_dir)
    d = graph.degrees(n, rel.edges(spark, sf_dir)).select("id", "density")
    items = n.join(d, "id").select(corpus.era(F.col("inception_year")).alias("era"), corpus.region(F.col("countries")).alias("region"), "density", "kind", F.col("inception_precision").eqNullSafe(9).alias("hit"))
    return stats.sliced(items, ["era", "region", "density", "kind"], "hit")


@query(f"{with_('t')}, {_RUNS} select run_id, case when n_refused::double / nullif(n_cases, 0) is null then 'FAIL' when n_refused::double / n_cases >= 0.05 then 'PASS' else 'FAIL' end refusal_floor, case when n_chars::double / nullif(n_claims, 0) is null then 'FAIL' when n_chars::double / n_claims >= 40 then 'PASS' else 'FAIL' end chars_floor, 'N/A' claims_floor from rr")
def gate_verdicts(spark, sf_dir):
    def verdict(a, b, least):
        return stats.floor_verdict(gate.rate(F.col(a), F.col(b)), F.lit(least).cast("double"))

    return _runs(spark, sf_dir).select("run_id", verdict("n_refused", "n_cases", 0.05).alias("refusal_floor"), verdict("n_chars", "n_claims", 40.0).alias("chars_floor"), verdict("n_claims", "n_cases", None).alias("claims_floor"))


@query(
    f"{with_('t')}, l as ("
    + " union all ".join(f"select '{f}' field, coalesce({f}::varchar, '<null>') v from t" for f in ("dataset", "provider", "model_id", "artifact_version"))
    + """), k as (select field, v as "value", count(*) n from l group by all) select * from k where field in (select field from k group by 1 having count(*) > 1)"""
)
def incomparable_runs(spark, sf_dir):
    fields = ["dataset", "provider", "model_id", "artifact_version"]
    return stats.incomparable(rel.transcripts(spark, sf_dir, fields), fields)


@query(f"{with_('t')}, k as (select distinct run_id, case_id from t where case_id is not null) select run_id, count(*) n_cases, bit_xor(('0x' || substr(md5(case_id), 1, 15))::bigint) case_set from k group by 1")
def case_sets(spark, sf_dir):
    """Which runs were over the same cases."""
    return stats.case_sets(rel.transcripts(spark, sf_dir, ["run_id", "case_id"]))


# json and digests


@query("select file_id, sha256(file_name || chr(0) || body) digest, sha256(body) body_digest, length(body) n_chars from manifest_files")
def snapshot_digests(spark, sf_dir):
    m = read_table(spark, sf_dir, "manifest_files", ["file_id", "file_name", "body"])
    return m.select("file_id", js.running_digest(F.col("file_name"), F.col("body")).alias("digest"), js.digest(F.col("body")).alias("body_digest"), F.length("body").cast("bigint").alias("n_chars"))


@query("with x as (select event_id, props, try_cast(regexp_extract(props, '(?s)(\\{.*\\})', 1) as json) j from events) select event_id, try_cast(j->>'k' as bigint) k, j is not null readable from x")
def tolerant_json(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", ["event_id", "props"]).withColumn("v", js.embedded_object(F.col("props")))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.col("v").isNotNull().alias("readable"))


@query("select file_id, '{\"feed\":' || to_json(feed)::varchar || ',\"file_id\":' || file_id::varchar || ',\"file_name\":' || to_json(file_name)::varchar || '}' canonical from manifest_files")
def canonical_json(spark, sf_dir):
    m = read_table(spark, sf_dir, "manifest_files", ["file_id", "feed", "file_name"])
    return m.select("file_id", js.canonical({"file_name": F.col("file_name"), "feed": F.col("feed"), "file_id": F.col("file_id")}).alias("canonical"))


@query("select feed, count(*) n_files, count(*) filter (file_name like 'feed%') n_named from manifest_files group by 1")
def files_per_feed(spark, sf_dir):
    return read_table(spark, sf_dir, "manifest_files", ["feed", "file_name"]).groupBy("feed").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("file_name").startswith("feed")).alias("n_named"))


@query(f"{with_('t')} select count(*) filter (prose is not null and not regexp_full_match(prose, '[\\s\\pZ]*') and len(claims) > 0) answered_with_claims, count(*) filter (prose is null or regexp_full_match(prose, '[\\s\\pZ]*')) without_prose, count(*) filter (coalesce(len(claims), 0) = 0) without_claims from t")
def answered(spark, sf_dir):
    t = rel.transcripts(spark, sf_dir, ["prose", "claims[].predicate"])
    has, spoken = F.coalesce(F.size("claims"), F.lit(0)) > 0, ~is_blank(F.col("prose"))
    return t.agg(F.count_if(spoken & has).alias("answered_with_claims"), F.count_if(~spoken).alias("without_prose"), F.count_if(~has).alias("without_claims"))


# texts


def _articles(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", ["doc_id", "subject_id", "title", "text", "source"])
    wiki = d.where(F.lower(F.trim("source")) == "wikitext").withColumn("subject_id", plain_id(F.col("subject_id")))
    return screen.one_article(wiki)


@query(f"with w as (select {rel.pid('subject_id')} subject_id, doc_id, title from documents where lower(trim(source)) = 'wikitext' and subject_id is not null) select subject_id, min(doc_id) doc_id, arg_min(coalesce(title, ''), doc_id) title from w group by 1")
def subject_articles(spark, sf_dir):
    """The one article that is read for each subject."""
    return _articles(spark, sf_dir).select("subject_id", "doc_id", F.coalesce("title", F.lit("")).alias("title"))


_REGEX = {k: v.replace("(?:", "(") for k, v in {"a": markup.ASSERTS, "e": markup.EXPOSURE}.items()}


@query(f"select doc_id, case when regexp_matches(lower(text), '{_REGEX['a']}') then 'ASSERTS' when regexp_matches(lower(text), '{_REGEX['e']}') then 'EXPOSURE' else 'NONE' end assertion from documents")
def assertion_classes(spark, sf_dir):
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", screen.assertion_of(F.col("text")).alias("assertion"))


@query()
def stripped_documents(spark, sf_dir):
    """Documents without their markup."""
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", screen.prose(F.col("text")).alias("prose"))


@query()
def edge_verdicts(spark, sf_dir):
    """What the subject's article says for each edge."""
    v = screen.screened(rel.edges(spark, sf_dir), _articles(spark, sf_dir), rel.nodes(spark, sf_dir))
    return v.select("subject_id", "object_id", "tier", "hits", "assertion", "taxonomic_lead", "taxonomic_hits", F.array_join("sentences", " ").alias("sentences"))


@query()
def screening_exclusions(spark, sf_dir):
    return screen.excluded(screen.screened(rel.edges(spark, sf_dir), _articles(spark, sf_dir), rel.nodes(spark, sf_dir)))


_ASKED = r"""case when query similar to '.*lead to\?' or query like 'List everything that descends%' or query like '%picked up ideas%' or query like '%later styles%' then 'descendants'
 when query similar to '.*descend from\?' or query like '%fed into%' or query like '%ancestry%' or query like '%shaped%' or query like '%older music%' then 'origins' end"""
_ABOUT = ["^What did (.+) lead to\\?$", "^Which styles does (.+) descend from\\?$", "^List everything that descends from (.+)\\.$", "^Who picked up ideas from (.+)\\?$", "^Can you tell me what fed into (.+)\\?$", "^Trace the ancestry of (.+) for me\\.$", "^Which later styles grew out of (.+)\\?$", "^What shaped (.+) in its early years\\?$", "^(.+): which older music stands behind it\\?$"]


@query(f"{with_('t')} select transcript_id, {_ASKED} direction, coalesce(" + ", ".join(f"nullif(regexp_extract(query, '{p}', 1), '')" for p in _ABOUT) + ") about from t")
def parsed_questions(spark, sf_dir):
    t = rel.transcripts(spark, sf_dir, ["query"])
    return t.select("transcript_id", tx.asked_direction(F.col("query")).alias("direction"), tx.asked_about(F.col("query")).alias("about"))


@query(f"{with_('c', 't')}, k as (select run_id, count(*) n, count(distinct subject_id) ns, count(distinct object_id) no from c group by 1) select transcript_id, coalesce(n, 0) n_claims, case when coalesce(n, 0) = 0 then null when n = 1 then 'single' when ns = 1 then 'fan_out' when no = 1 then 'fan_in' else 'mixed' end shape from t left join k on k.run_id = t.transcript_id")
def answer_shapes(spark, sf_dir):
    c = rel.claims(spark, sf_dir).groupBy(F.col("run_id").alias("transcript_id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject_id").alias("ns"), F.countDistinct("object_id").alias("no"))
    t = rel.transcripts(spark, sf_dir, []).select("transcript_id").join(c, "transcript_id", "left").na.fill(0, ["n", "ns", "no"])
    return t.select("transcript_id", F.col("n").alias("n_claims"), tx.shape(F.col("ns"), F.col("no"), F.col("n")).alias("shape"))


# events


def _events(spark, sf_dir):
    runs = rel.transcripts(spark, sf_dir, ["prose", "refused"]).select(F.col("transcript_id").alias("run_id"), "prose", "refused")
    return ev.events_of(claim_gate(spark, sf_dir), runs)


_FOLD_SQL = f"{with_('ea', 'n', 'c')}, {_GATE.format(proposals='select run_id, ord, subject_id, predicate, object_id from c')}, k as (select run_id, count(*) n, count(*) filter (reason is null) ok from g group by 1) select transcript_id run_id, 3 + coalesce(n, 0) n_events, coalesce(ok, 0) n_approved, coalesce(n - ok, 0) n_rejected, coalesce(refused, false) refused, coalesce(prose, '') prose, true complete from t left join k on k.run_id = transcript_id"


@query(_FOLD_SQL)
def event_fold(spark, sf_dir):
    return ev.folded(_events(spark, sf_dir))


@query(_FOLD_SQL)
def event_fold_stream(spark, sf_dir):
    """The same fold by a stream over the events' files, with state per run."""
    scratch = Scratch(spark, "stream")
    return ev.run_stream(scratch.keep(_events(spark, sf_dir))._scratch_path, scratch, spark)


_FRAMES = f"""{with_('ea', 'n', 'c')}, {_GATE.format(proposals='select run_id, ord, subject_id, predicate, object_id from c')},
 ev as (select transcript_id run_id, 0::bigint seq, 'planned' kind, null::varchar "text" from t union all select transcript_id, {1 << 30}::bigint, case when coalesce(refused, false) then 'refused' else 'token' end, prose from t
  union all select transcript_id, {(1 << 30) + 1}::bigint, 'done', null from t union all select run_id, ord + 1, case when reason is null then 'claim_approved' else 'claim_rejected' end, reason from g)"""


@query(_FRAMES + """ select run_id, seq, 'event: ' || kind || chr(10) || 'data: ' || to_json({'run_id': run_id, 'seq': seq, 'text': "text"})::varchar || chr(10) || chr(10) frame from ev""")
def event_frames(spark, sf_dir):
    return ev.frames(_events(spark, sf_dir))


# snapshots


@query()
def snapshot_manifest(spark, sf_dir):
    m = snapshots.manifest(rel.nodes(spark, sf_dir), rel.edges(spark, sf_dir), "1.0.0")
    return m.withColumn("verification_counts", F.to_json("verification_counts"))


@query(f"{with_('n')}, h as (select kind, ('0x' || substr(sha256(id || '|' || coalesce(label, '')), 1, 15))::bigint h from n) select kind, count(*) n_rows, bit_xor(h) folded from h group by 1")
def folded_digests(spark, sf_dir):
    """An order-independent digest of the nodes per kind."""
    h = F.conv(F.substring(F.sha2(F.concat("id", F.lit("|"), F.coalesce("label", F.lit(""))), 256), 1, 15), 16, 10).cast("bigint")
    return rel.nodes(spark, sf_dir).select("kind", h.alias("h")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("folded"))
