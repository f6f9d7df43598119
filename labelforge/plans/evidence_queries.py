"""Evidence-tuple scores."""

from pyspark.sql import functions as F

from labelforge.operators import evidence as op
from labelforge.plans.registry import query

_PS = lambda x: f"floor(({x}) * 1000) / 10"
_F = "case when p + r > 0 then 2 * p * r / (p + r) else 0 end"


def _mask(column, facet):
    return column if column == facet else "'_'"


def _overlap(facet):
    g, s = [f"(select distinct document_id, {_mask('query', facet)} as query, {_mask('stance', facet)} as stance, list_sort(list_distinct(pages)) as pages from v_evid_{x})" for x in ("gold", "pred")]

    def side(a, b):
        inter = "len(list_intersect(a.pages, b.pages))"
        return f"""(select coalesce(sum(case when hit then w end), 0) from (select max({inter} / len(a.pages)) as w, bool_or(a.query = b.query and a.stance = b.stance) as hit
 from {a} a join {b} b on a.document_id = b.document_id and {inter} > 0 group by a.document_id, a.query, a.stance, a.pages))"""

    return f"""select 'overlap' as metric, '{facet}' as facet, g, s, null::BIGINT as c, {side(s, g)} / (s + 1e-16) as p, {side(g, s)} / (g + 1e-16) as r
 from (select (select count(*) from {g}) as g, (select count(*) from {s}) as s)"""


def _sets(metric, facet, columns, page):
    def rows(x):
        source = f"(select document_id, query, stance, {page} as page from v_evid_{x})"
        return f"select distinct document_id, {', '.join(columns)} from {source}"

    both = f"({rows('gold')} intersect {rows('pred')})"
    return f"""select '{metric}' as metric, '{facet}' as facet, g, s, c, case when s > 0 then c / s else 0 end as p, case when g > 0 then c / g else 0 end as r from
 (select (select count(*) from ({rows('gold')})) as g, (select count(*) from ({rows('pred')})) as s, (select count(*) from {both}) as c)"""


_OVERLAP = " union all ".join(_overlap(f) for f in op.OVERLAP_FACETS)
_DOCUMENT = " union all ".join(_sets("document", f, c, "unnest(pages)") for f, c in op.DOCUMENT_FACETS.items())
_STRICT = " union all ".join(_sets("strict", f, ["page" if x == "pages" else x for x in c], "list_sort(pages)") for f, c in op.STRICT_FACETS.items())
_FINAL = f"select metric, facet, g, s, c, {_PS('p')} as p, {_PS('r')} as r, {_PS(_F)} as f from x"
_VIEWS = ("v_evid_gold", "v_evid_pred")


@query("overlap_scores", f"with x as ({_OVERLAP}) {_FINAL.replace('g, s, c,', 'g, s,')}", _VIEWS)
def overlap_scores(t):
    return op.overlap_scores(t.v_evid_gold, t.v_evid_pred).drop("c")


@query("document_scores", f"with x as ({_DOCUMENT}) {_FINAL}", _VIEWS)
def document_scores(t):
    return op.document_scores(t.v_evid_gold, t.v_evid_pred)


@query("strict_scores", f"with x as ({_STRICT}) {_FINAL}", _VIEWS)
def strict_scores(t):
    return op.strict_scores(t.v_evid_gold, t.v_evid_pred)


@query("evidence_score_row", f"with x as ({_OVERLAP} union all {_DOCUMENT} union all {_STRICT}), y as ({_FINAL}) select " + ", ".join(
    f"max(f) filter (metric = '{m}' and facet = '{f}') as {m}_{f}" for m in ("strict", "overlap", "document") for f in ("page", "query", "stance")) + " from y", _VIEWS)
def evidence_score_row(t):
    return op.score_row(op.all_scores(t.v_evid_gold, t.v_evid_pred))


@query("evidence_tuples", "select distinct document_id, query, '_' as stance, array_to_string(list_sort(list_distinct(pages)), ',') as pages from v_evid_pred", ("v_evid_pred",))
def evidence_tuples(t):
    return op.evidence_tuples(t.v_evid_pred, ("query",)).withColumn("pages", F.array_join("pages", ","))
