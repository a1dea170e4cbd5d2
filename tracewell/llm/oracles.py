"""SQL for DuckDB that says what the queries of this subpackage must give.

Token counts, containers and fitted models have no SQL. For these, queries of their own state what
must hold for every document, source or pair, and the SQL names all of them with what must hold.
"""

from __future__ import annotations

from . import lookalikes

_T = "t as (select * from transcripts qualify row_number() over (partition by transcript_id order by loaded_at desc) = 1)"
_SOURCE = r"regexp_replace(lower(trim({c})), '[\s-]+', '_', 'g')"


def oracles(domains: dict[str, str]) -> dict[str, str]:
    looks = f"k as (select doc_id, text, {lookalikes.one_form_sql('text')} look from documents where doc_id is not null and text is not null)"
    tree = "case source " + " ".join(f"when '{s}' then '{d}'" for s, d in domains.items()) + " else 'other' end"
    targets = f"g as (select source, sum(greatest(coalesce(target_weight, 0), 0)) w, max(coalesce(max_repeats, 1)) r from (select {_SOURCE.format(c='source')} source, target_weight, max_repeats from mixture_targets) where source is not null group by 1)"
    held = f"h as (select {_SOURCE.format(c='source')} source, count(*) n from documents where doc_id is not null and text <> '' group by 1)"
    return {
        "p9_found": f"with {looks} select a.doc_id doc_id_a, b.doc_id doc_id_b from k a join k b on a.look = b.look and a.text <> b.text and a.doc_id < b.doc_id",
        "p9_classes": f"""with {looks}, v as (select look, text, count(*) n, min(doc_id) f from k group by 1, 2), l as (select look, min(f) class_id, count(*) n_variants, sum(n) total from v group by 1)
 select doc_id, class_id, n_variants, (total - n)::bigint n_alike from k join v using (look, text) join l using (look)""",
        "p7_places": "select doc_id, true whole, true fits, true split_only_if_longer from documents where doc_id is not null",
        "p8_caps": f"with {targets}, {held} select source, coalesce(n, 0) n_documents, 0::bigint n_over_cap, 0::bigint n_wrong_tokens, 0::bigint n_foreign from g left join h using (source)",
        # what a source without documents lacks goes to its domain, in proportion to the weights
        "p8_held": f"""with {targets}, {held}, x as (select source, w / sum(w) over () w, {tree} d, n is not null has from g left join h using (source)),
 y as (select *, sum(w) filter (has) over (partition by d) has_w, coalesce(sum(w) filter (not has) over (partition by d), 0) lost from x)
 select source, round(w, 3) target_share, round(case when has then w + lost * w / has_w else 0 end, 3) reached_share, true within_cap from y""",
        "p2_marks": rf"""with {_T}, x as (select transcript_id, coalesce(refused, false) marked, regexp_full_match(coalesce(prose, ''), '[\s\pZ]*') blank,
   coalesce(lower(regexp_replace(refusal_reason, '[^\pL\pN]+', '', 'g')), '') not in ('', 'na', 'none', 'null', 'nil', 'nan', 'no', 'false', '0') reasoned from t)
 select case when marked or blank and reasoned then 'refusal' else 'empty' end defect, count(*) n_pairs, count(*) n_found from x where marked or blank group by 1""",
    }
