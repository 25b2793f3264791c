"""The registered queries in DuckDB's SQL, where SQL can state them."""

from __future__ import annotations

from . import quality

_SPACED = r"[^\x20\x09-\x0D]+"
_WORDS = rf"regexp_extract_all(coalesce(text, ''), '{_SPACED}')"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quality(alpha: float = 0.02, delta: float = 0.05) -> str:
    """Features, proposed cutoffs, the sequence of exact binomial tests, and the verdict."""
    rules = {rule: (score.replace(" / ", "::double / "), grid) for rule, (score, grid) in quality.RULES.items()}
    notches = max(len(grid) for _, grid in rules.values())
    over = ", ".join(f"count(*) filter (proposes and coalesce({score} > {cut}::double, false)) as {rule}_{i}" for rule, (score, grid) in rules.items() for i, cut in enumerate(grid))
    strictest = ", ".join(f"case when np = 0 then {len(grid)} " + " ".join(f"when {rule}_{i} <= np * {alpha / len(rules)!r} then {i}" for i in range(len(grid))) + f" else {len(grid)} end as at_{rule}" for rule, (_, grid) in rules.items())
    listed = {rule: "[" + ", ".join(f"{c}::double" for c in grid) + "]" for rule, (_, grid) in rules.items()}
    rejects = " or ".join(f"coalesce({score} > ({listed[rule]})[at_{rule} + lax + 1], false)" for rule, (score, _) in rules.items())
    cuts = ", ".join(f"({listed[rule]})[at_{rule} + lax + 1] as cut_{rule}" for rule in rules)
    passed = " and ".join(f"coalesce({score} <= cut_{rule}, true)" for rule, (score, _) in rules.items())
    term = f"exp(lgamma(n + 1.0::double) - lgamma(j + 1.0::double) - lgamma(n - j + 1.0::double) + j * ln({alpha!r}::double) + (n - j) * ln(1 - {alpha!r}::double))"
    return rf"""with d as (select doc_id, lang as stratum, coalesce(text, '') as t, {_WORDS} as w from documents),
 windows as (select doc_id, i, array_to_string(w[i:i+2], ' ') as g from d, lateral (select unnest(range(1, len(w) - 1)) as i) r),
 again as (select doc_id, unnest([i, i + 1, i + 2]) as i from windows join (select doc_id, g from windows group by all having count(*) > 1) x using (doc_id, g)),
 repeats as (select doc_id, count(distinct i) as n_repeat_words from again group by doc_id),
 f as (select doc_id, stratum, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACED}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACED}')))))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals, length(regexp_replace(t, '[^!?|]', '', 'g')) as n_marks,
  len(w) < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * len(w) as base_failed from d left join repeats using (doc_id)),
 held as (select *, {quality.PROPOSES} as proposes from f where not base_failed and doc_id in (select doc_id from labels group by doc_id having min(quality) = 1)),
 sizes as (select stratum, count(*) filter (not proposes) as n from held group by stratum), risk as (select {delta}::double / (count(*) + 1) as level from sizes),
 groups as (select stratum, case when n < ln(level) / ln(1 - {alpha}::double) then 'pool' else coalesce('=' || stratum, '') end as g from sizes, risk),
 pooled as (select held.*, g from held join groups on held.stratum is not distinct from groups.stratum),
 counted as (select g, count(*) filter (proposes) as np, {over} from pooled group by g), proposed as (select g, {strictest} from counted),
 tested as (select g, lax, count(*) as n, count(*) filter ({rejects}) as k from pooled join proposed using (g), (select unnest(range(0, {notches})) as lax) l where not proposes group by g, lax),
 sure as (select g, min(lax) as lax from tested, risk where k < n * {alpha}::double and list_sum(list_transform(range(0, k + 1), lambda j: {term})) <= level group by g),
 cut as (select stratum, {cuts} from groups join proposed using (g) join sure using (g))
 select doc_id, f.stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and ({passed}) as kept from f left join cut on f.stratum is not distinct from cut.stratum"""


ORACLES = {
    "op1_quality_rules": _quality(),
    "op2_ngram_jaccard_join": rf"""with recursive d as (select doc_id, {_WORDS} as w from documents),
 s as (select distinct doc_id, array_to_string(w[i:i+4], ' ') as g from d, lateral (select unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i) r where len(w) > 0),
 n as (select doc_id, count(*) as n from s group by doc_id),
 met as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
 links as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 5 * c >= 4 * (x.n + y.n - c)),
 sym as (select a, b from links union all select b, a from links),
 reach as (select distinct a as node, a as root from sym union select sym.b, reach.root from reach join sym on sym.a = reach.node),
 classes as (select node, min(root) as class_id from reach group by node), degree as (select a, count(*) as n_links from sym group by a)
 select d.doc_id, coalesce(class_id, d.doc_id) as class_id, coalesce(n_links, 0) as n_links from d left join classes on node = d.doc_id left join degree on a = d.doc_id""",
    "op8_substring_dedup": rf"""with d as (select doc_id, {_WORDS} as w from documents),
 windows as (select doc_id, i, array_to_string(w[i:i+12], ' ') as g from d, lateral (select unnest(range(1, len(w) - 11)) as i) r),
 hit as (select doc_id, unnest(range(i, i + 13)) as i from windows join (select g, min(doc_id) as first from windows group by g having count(distinct doc_id) > 1) f using (g) where doc_id > first),
 gone as (select distinct doc_id, i from hit),
 edges as (select doc_id, count(*) filter (before is null or before < i - 1) as n_spans, count(*) as n_removed from (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from gone) q group by doc_id),
 kept as (select doc_id, string_agg(word, ' ' order by i) as kept from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d) x anti join gone using (doc_id, i) group by doc_id)
 select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(coalesce(kept, '')) as kept_sha256 from d left join edges using (doc_id) left join kept using (doc_id)""",
    "op9_url_filters": rf"""with recursive rules as (select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(action, h, p)),
 p as (select row_number() over () as row_id, page_id, url, coalesce(html, '') as html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
 q as (select *, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as node from p),
 found as (select url, rest, node, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\srel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\shref\s*=\s*["'']?([^"''\s>]*)', 1) as target from q
  union all select url, rest, node, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\shttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)url\s*=\s*["'']?([^"''>]*)', 1) from q),
 aimed as (select node, case when regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') then substr(target, strpos(target, '://') + 3) when starts_with(target, '//') then substr(target, 3) when starts_with(target, '/') then regexp_extract(rest, '^([^/?#]*)', 1) || target else '' end as to_rest from found where target <> ''),
 edge as (select distinct node as u, translate(regexp_extract(to_rest, '^([^/?#]*)', 1), {_AZ}) || regexp_extract(to_rest, '^[^/?#]*([^#]*)', 1) as v from aimed where node <> '' and to_rest <> ''),
 sym as (select u, v from edge union select v, u from edge), reach as (select distinct u as node, u as root from sym union select sym.v, reach.root from reach join sym on sym.u = reach.node),
 classes as (select node, min(root) as root from reach group by node),
 fits as (select node, action, h || p as rule, row_number() over (partition by node order by length(h || p) desc, h || p desc, action desc) as r from (select node, regexp_extract(node, '^([^/?#]*)', 1) as host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) as path from (select node from q union select node from classes) a) b join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
 best as (select node, action, rule from fits where r = 1),
 told as (select root, bool_or(action = 'allow') as allowed, bool_or(action = 'block') as blocked from classes left join best using (node) group by root)
 select page_id, host, path, rule, coalesce(action, case when blocked and not coalesce(allowed, false) then 'block' end, 'allow') as verdict from q left join best using (node) left join classes using (node) left join told using (root)""",
    "op10_decontaminate": rf"""with b as (select item_id::varchar as item, {_ALNUM} as w from benchmark),
 bw as (select distinct item, least(10, len(w)) as n, array_to_string(w[i:i+least(10, len(w))-1], ' ') as g from b, lateral (select unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i) r where len(w) > 0),
 d as (select doc_id, {_ALNUM} as w from documents),
 dw as (select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') as g from d, (select distinct n from bw) l, lateral (select unnest(range(1, len(w) - n + 2)) as i) r),
 h as (select doc_id, item, i, n from dw join bw using (g, n)),
 hw as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) q group by doc_id),
 it as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from h group by doc_id)
 select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join hw using (doc_id) left join it using (doc_id)""",
}
