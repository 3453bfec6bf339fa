"""Pieces of SQL that the queries' statements share."""

from __future__ import annotations

from siftwell.functions.columns import SPACE, TOKEN_PATTERN
from siftwell.functions.text import C1

_PAIRS = [(chr(k), v) for k, v in C1.items()]
_KNOWN = "".join(a for a, b in _PAIRS if b), "".join(b for _, b in _PAIRS if b)
_LOST = "".join(a for a, b in _PAIRS if not b)
# The entities that occur in the tables; the operators resolve all of HTML's.
_ENTITIES = (("&quot;", '"'), ("&#39;", "''"), ("&#40;", "("), ("&#41;", ")"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def cleaned(column: str) -> str:
    """Entities, C1 characters and invisible marks repaired."""
    expression = column
    for _ in range(4):
        for entity, char in _ENTITIES:
            expression = f"replace({expression}, '{entity}', '{char}')"
    expression = f"translate({expression}, '{_KNOWN[0]}', '{_KNOWN[1]}')"
    for char in (*_LOST, "\ufeff", "\u200b"):
        expression = f"replace({expression}, '{char}', '')"
    return f"replace({expression}, '\u00a0', ' ')"


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def fold(column: str) -> str:
    return f"nullif(lower({strip(column)}), '')"


def words(column: str) -> str:
    return rf"regexp_extract_all(lower({cleaned(column)}), '[\p{{L}}\p{{N}}]+')"


def tokens(column: str) -> str:
    return f"len(regexp_extract_all({column}, '{TOKEN_PATTERN}'))"


def pieces(column: str) -> str:
    """Blank-separated pieces in lower case."""
    return rf"list_filter(regexp_split_to_array(lower({column}), '[ \t\n\f\r]+'), lambda x: x <> '')"


def n_blank(column: str) -> str:
    return rf"len(regexp_extract_all({column}, '\S+'))"


DOCS = f"""docs as (select doc_id, any_value(stratum) as stratum, any_value({fold('source')}) as source, any_value({fold('source_doc_id')}) as source_doc_id, any_value(pub_year) as pub_year,
  any_value(text) as text, any_value(meta) as meta, any_value({n_blank('text')}) as n_tokens, any_value(text_sha256) as text_sha256 from candidates group by doc_id)"""

LATEST = """latest as (select instance, item_id, arg_max(group_name, run_id) as group_name, arg_max(score, run_id) as score from scores where score is not null and not isnan(score) group by 1, 2)"""

FLAGS = f"""{DOCS}, {LATEST},
flags as (select l.instance, l.item_id, l.score, t.threshold, (l.score > t.threshold)::int as flagged, d.stratum, d.n_tokens from latest l join thresholds t using (instance) join docs d on d.doc_id = l.item_id)"""

RATES = f"""{FLAGS}, counts as (select instance, stratum, sum(flagged) as k, count(*) as n from flags group by 1, 2)"""

# The independent predictor: an add-one unigram model of all documents.
PPL = f"""unitok as (select unnest({pieces('text')}) as v from documents), unic as (select v, count(*) as c from unitok group by v),
dtok as (select doc_id, unnest({pieces('text')}) as v from docs), size as (select (select count(*) from unitok) + (select count(*) from (select v from unic union select v from dtok)) as s),
ppl as (select doc_id as item_id, -avg(ln((coalesce(c, 0) + 1) / s)) as log_ppl_indep from dtok left join unic using (v), size group by doc_id)"""

DOC_TABLE = f"""{FLAGS}, {PPL},
dt as (select f.instance, split_part(f.instance, '@', 1) as detector, nullif(split_part(f.instance, '@', 2), '') as reference, f.item_id, f.stratum, f.score, f.threshold, f.flagged, p.log_ppl_indep, f.n_tokens from flags f left join ppl p using (item_id))"""

CELLS = f"""{DOC_TABLE},
cells as (select instance, detector, reference, stratum, avg(flagged) as fpr, count(*) as n, sum(flagged) as k, avg(log_ppl_indep) as log_ppl_indep, avg(n_tokens) as length from dt group by 1, 2, 3, 4)"""


# Bigram models of the three folds of documents, by doc_id modulo 3; needs lists.
MODELS = """
mc as (select fold, v, count(*) as c from (select doc_id % 3 as fold, unnest(w) as v from lists) group by 1, 2),
msize as (select fold, sum(c) + (select count(*) from vocab) as s from mc group by fold),
muni as (select s.fold, b.v, (coalesce(c, 0) + 1) / s.s::double as p0 from vocab b cross join msize s left join mc on mc.v = b.v and mc.fold = s.fold),
mfloor as (select fold, sum(p0 * ln(p0)) as s0, sum(p0 * ln(p0) * ln(p0)) as q0 from muni group by fold),
mpairs as (select doc_id % 3 as fold, u, v, count(*) as c from pairs group by 1, 2, 3),
mseen as (select fold, u, v, p0, 0.5::double * c / n + 0.5::double * p0 as p from mpairs join (select fold, u, sum(c) as n from mpairs group by 1, 2) using (fold, u) join muni using (fold, v)),
msums as (select fold, u, sum(p * ln(p)) as a, sum(p * ln(p) * ln(p)) as b, sum(p0 * ln(p0)) as s, sum(p0 * ln(p0) * ln(p0)) as r, sum(p0) as m, sum(p * ln(p0)) as x from mseen group by 1, 2),
mctx as (select fold, u, a + 0.5 * ((s0 - s) + ln(0.5) * (1 - m)) as mu, b + 0.5 * ((q0 - r) + 2 * ln(0.5) * (s0 - s) + ln(0.5) * ln(0.5) * (1 - m)) as second, -(x + 0.5 * (s0 - s)) as xent from msums join mfloor using (fold))"""


def stats(reference: int, name: str) -> str:
    """CTE {name}stats: token statistics of every document under the model of another fold, the first or the second after its own."""
    return f"""
{name}stats as (select e.doc_id, e.token_idx, ln(coalesce(n.p, case when t.mu is not null then 0.5 * g.p0 else g.p0 end)) as logp, coalesce(t.mu, f.s0) as mu,
  greatest(coalesce(t.second - t.mu * t.mu, f.q0 - f.s0 * f.s0), 0) as var, -ln(g.p0) as ce, coalesce(t.xent, -f.s0) as xent
  from (select *, (doc_id + {reference}) % 3 as fold from pairs) e join muni g using (fold, v) left join mseen n on n.fold = e.fold and n.u = e.u and n.v = e.v left join mctx t on t.fold = e.fold and t.u = e.u join mfloor f on f.fold = e.fold)"""


LISTS = f"""lists as (select doc_id, stratum, {pieces('text')} as w from documents), vocab as (select distinct unnest(w) as v from lists),
pairs as (select doc_id, i as token_idx, w[i] as u, w[i + 1] as v from (select doc_id, w, unnest(range(1, len(w))) as i from lists))"""

SIGNATURES = """g as (select distinct doc_id, ('0x' || substr(md5(sh), 1, 8))::bigint as h from (select doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) as sh from (select doc_id, {pieces} as w from docs)))"""
SIGNATURES = SIGNATURES.replace("{pieces}", pieces("text"))
