"""DuckDB SQL for the corpus queries that SQL can express."""

from . import divergence, merkle, quality

_WHITE = "[\\x20\\x09-\\x0D]+"

#: Water filling: sources in order of cap over weight, the first of which are capped.
_TARGETS = """sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size, md5(coalesce(cast(doc_id as varchar), '')) as h from documents),
 sums as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
 ranked as (select *, row_number() over (order by source nulls last) - 1 as place from sums),
 weighted as (select *, cast(place%3+1 as bigint) as w, 3*source_size as most, 3*source_size/cast(place%3+1 as double) as r from ranked),
 level as (select *, sum(source_size) over () as total, coalesce(sum(most) over (order by r, place rows between unbounded preceding and 1 preceding), 0) as capped, sum(w) over (order by r, place rows between current row and unbounded following) as free from weighted),
 first as (select r as r1, place as p1, capped as c1, free as f1 from level where (total-capped)*w <= most*free order by r, place limit 1),
 targets as (select source, source_size, case when (r, place) < (r1, p1) then cast(most as double) else cast(w*(total-c1) as double)/f1 end as target from level, first),
 rates as (select *, floor(rate) as whole, rate-floor(rate) as part from (select *, case when source_size > 0 then target/source_size else 0e0 end as rate from targets)),
 hashed as (select doc_id, source, size, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2 from sized),
 drawn as (select d.*, source_size, target, whole, part from hashed d join rates t on d.source is not distinct from t.source),
 tried as (select source, k, abs(sum(case when (h1+k*h2)%4294967296/4294967296e0 < part then size else 0 end) - max(part*source_size)) as off from drawn, range(64) s(k) group by source, k),
 seeds as (select source, arg_min(k, (off, k)) as seed from tried group by source)"""

_BASE32 = "array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, cast(1+5*g as int), 5) as bigint) >> cast(15-5*j as int)) & 31 as int) + 1, 1)), '')), '')"



def _quality() -> str:
    """Measures and votes by rows; every round of the estimate is three tables, over the votes' patterns."""
    test = lambda v, low, fine, best, high: "case when " + (" or ".join(x for x in (low is not None and f"{v} < {low}e0", high is not None and f"{v} > {high}e0") if x)) + " then -1 when " + (" and ".join(x for x in (fine is not None and f"{v} >= {fine}e0", best is not None and f"{v} <= {best}e0") if x)) + " then 1 else 0 end"
    votes = [test(f"({a}/cast(greatest({b}, 1) as double))", *bounds) for a, b, *bounds in quality.BOUNDS.values()]
    names = [f"v{k}" for k in range(len(votes))]
    kept = lambda pattern: f"length(regexp_replace(t, '[^{pattern}]', '', 'g'))"
    window = " || ' ' || ".join(f"words[i+{k}]" for k in range(quality.WINDOW))
    parts = [
        "texts as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents)",
        f"split as (select k, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from texts)",
        f"windows as (select k, i, {window} as key from (select k, words, unnest(range(1, len(words)-{quality.WINDOW - 2})) as i from split))",
        f"again as (select k, count(distinct p) as n from (select k, unnest(range(i, i+{quality.WINDOW})) as p from (select k, i, count(*) over (partition by k, key) as c from windows) where c > 1) group by k)",
        f"""measures as (select split.k, doc_id, len(words) as n_words, cast(length(regexp_replace(t, '{_WHITE}', '', 'g')) as bigint) as word_chars, cast({kept("#*$%&|<>")} as bigint) as n_symbols, len(lines)-len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(lines) as n_lines,
 len(list_filter(range(1, len(words)), lambda i: words[i] = words[i+1])) as n_same_words, {kept("\\p{L}\\p{M}\\p{N}")} as n_plain, {kept("\\p{L}")} as n_letters, {kept("\\p{Lu}")} as n_capitals, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?][\\x20\\x09-\\x0D]*$'))) as n_ends, {kept("!")} as n_shouts, len(list_distinct(words)) as n_distinct from split left join again on split.k = again.k)""",
        f"voted as materialized (select *, n_words < {quality.MIN_WORDS} or 100*n_repeat_words > {quality.MAX_REPEATED}*n_words as base_failed, {', '.join(f'{v} as {n}' for v, n in zip(votes, names))} from measures)",
        f"patterns as materialized (select row_number() over () as pattern, * from (select {', '.join(names)}, cast(count(*) as double) as n from voted where not base_failed group by all))",
        "cells as materialized (" + " union all ".join(f"select pattern, n, {k} as rule, {v} as vote from patterns" for k, v in enumerate(names)) + ")",
        f"start as (select rule, vote, bad0, good0 from range({len(names)}) r(rule), (values " + ", ".join(f"({v}, {b!r}::double, {g!r}::double)" for v, b, g in zip((-1, 0, 1), quality.START[False], quality.START[True])) + ") s(vote, bad0, good0))",
        f"share0 as (select rule, vote, bad0 as bad, good0 as good from start), prior0 as (select {quality.START_GOOD!r}::double as good)",
    ]
    for k in range(1, quality.ROUNDS + 1):
        parts += [
            f"odds{k} as materialized (select pattern, any_value(c.n) as n, any_value(c.n)/(1+exp(-(sum(ln(s.good)-ln(s.bad)) + any_value(ln(p.good)-ln(1-p.good))))) as w from cells c join share{k - 1} s using (rule, vote), prior{k - 1} p group by pattern)",
            f"prior{k} as materialized (select {1 - quality.HELD!r}*sum(w)/sum(n)+{quality.HELD * quality.START_GOOD!r} as good, sum(w) as w, sum(n)-sum(w) as u from odds{k})",
            f"share{k} as materialized (select rule, vote, {1 - quality.HELD!r}*coalesce(any_value(u1), 0)/greatest(any_value(p.u), 1e-9)+{quality.HELD!r}*any_value(bad0) as bad, {1 - quality.HELD!r}*coalesce(any_value(w1), 0)/greatest(any_value(p.w), 1e-9)+{quality.HELD!r}*any_value(good0) as good from start left join (select rule, vote, sum(o.w) as w1, sum(o.n-o.w) as u1 from cells join odds{k} o using (pattern) group by rule, vote) using (rule, vote), prior{k} p group by rule, vote)",
        ]
    last = quality.ROUNDS
    parts.append(f"verdict as (select pattern, 1/(1+exp(-(sum(ln(s.good)-ln(s.bad)) + any_value(ln(p.good)-ln(1-p.good))))) >= {quality.KEPT_FROM!r} as fine from cells join share{last} s using (rule, vote), prior{last} p group by pattern)")
    same = " and ".join(f"voted.{n} = patterns.{n}" for n in names)
    return f"with {', '.join(parts)} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(not base_failed and fine, false) as kept from voted left join patterns on {same} left join verdict using (pattern)"


def _merkle() -> str:
    """Levels and folds by recursion; a node's siblings on a level are the rest of its run."""
    field = lambda c: f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"
    leaf = lambda n: "sha256(" + " || ".join(field(n if c == "n_chars" else c) for c in merkle.FIELDS) + ")"
    crc = "list_reduce(list_prepend(4294967295::ubigint, list_transform(range(strlen(s)), lambda i: cast(ascii(s[i+1]) as ubigint))), lambda a, b: " + "xor(a, b)"
    step = "list_reduce(list_prepend({x}, cast(range(8) as ubigint[])), lambda c, d: case when c % 2 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)"
    crc = f"xor({crc[: -len('xor(a, b)')]}{step.format(x='xor(a, b)')}), 4294967295::ubigint)"
    fan = merkle.FAN
    climb = lambda name, grp, base: f"""{name}(level, {grp}, idx, n, h) as (select 0, {grp}, idx, n, h from {base} union all select level+1, {grp}, idx//{fan}, (any_value(n)+{fan - 1})//{fan}, sha256(string_agg(h, '' order by idx)) from {name} where n > 1 group by level, {grp}, idx//{fan})"""
    return f"""with recursive leaves as (select doc_id, lang, {leaf("n_chars")} as h, case when {crc} % 7 = 0 and n_chars is not null then {leaf("n_chars+1")} end as bad from (select *, cast(doc_id as varchar) as s from documents)),
 base as (select *, row_number() over (partition by lang order by doc_id nulls first, h)-1 as idx, count(*) over (partition by lang) as n from leaves),
 {climb("nodes", "lang", "base")}, tops as (select lang, h from nodes where n = 1),
 ranked as (select lang, h, 0 as crown, row_number() over (order by lang nulls first)-1 as idx, count(*) over () as n from tops), {climb("heights", "crown", "ranked")},
 root as (select h as root from heights where n = 1),
 steps as materialized (select level, lang, a.idx, n, coalesce(string_agg(case when b.idx < a.idx then b.h end, '' order by b.idx), '') as l, coalesce(string_agg(case when b.idx > a.idx then b.h end, '' order by b.idx), '') as r from (select level, lang, idx, n from nodes where n > 1) a join (select level as level2, lang as lang2, idx, h from nodes) b on level = level2 and lang is not distinct from lang2 and a.idx//{fan} = b.idx//{fan} group by level, lang, a.idx, n),
 rises as materialized (select level, a.idx, coalesce(string_agg(case when b.idx < a.idx then b.h end, '' order by b.idx), '') as l, coalesce(string_agg(case when b.idx > a.idx then b.h end, '' order by b.idx), '') as r from (select level, idx from heights where n > 1) a join (select level as level2, idx, h from heights) b on level = level2 and a.idx//{fan} = b.idx//{fan} group by level, a.idx),
 walk(doc_id, lang, leaf, part, level, idx, acc, proof) as (select doc_id, lang, h, 0, 0, idx, coalesce(bad, h), '' from base union all
 select doc_id, w.lang, leaf, part, w.level+1, w.idx//{fan}, sha256(s.l || acc || s.r), proof || s.l || s.r from walk w join steps s on part = 0 and w.level = s.level and w.lang is not distinct from s.lang and w.idx = s.idx),
 arrived as (select doc_id, walk.lang, leaf, acc, proof, tops.h as subroot, ranked.idx from walk join nodes on part = 0 and nodes.n = 1 and walk.lang is not distinct from nodes.lang and walk.level = nodes.level join tops on walk.lang is not distinct from tops.lang join ranked on walk.lang is not distinct from ranked.lang),
 rise(doc_id, leaf, subroot, level, idx, acc, proof) as (select doc_id, leaf, subroot, 0, idx, acc, proof from arrived union all
 select doc_id, leaf, subroot, w.level+1, w.idx//{fan}, sha256(s.l || acc || s.r), proof || s.l || s.r from rise w join rises s on w.level = s.level and w.idx = s.idx)
 select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, acc as folded_root, acc = root as verified from rise, root where level = (select max(level) from heights)"""


def _divergence() -> str:
    d = divergence
    return f"""with docs as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
 words as (select k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
 kept as materialized (select lang, term from words group by lang, term having count(distinct k) >= {d.MIN_DOCUMENTS}), sizes as (select lang, count(*) as v from kept group by lang),
 groups as materialized (select distinct lang, source from docs),
 counts as materialized (select g.lang, g.source, kept.term, coalesce(n, 0) as n from groups g join kept on g.lang = kept.lang left join (select lang, source, term, count(*) as n from words group by all) c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
 sums as (select lang, source, sum(n) as total from counts group by lang, source), wide as (select lang, term, sum(n) as n from counts group by lang, term), totals as (select lang, sum(n) as total from wide group by lang),
 p as materialized (select lang, source, term, n, cast(1+({d.SCALE}::hugeint*(n+{d.SMOOTH}))//(total+{d.SMOOTH}*v) as bigint) as p from counts join sums using (lang, source) join sizes using (lang)),
 q as (select lang, term, cast(1+({d.SCALE}::hugeint*(n+{d.SMOOTH}))//(total+{d.SMOOTH}*v) as bigint) as q from wide join totals using (lang) join sizes using (lang)),
 pairs as (select a.lang, a.source, b.source as item, cast(coalesce(any_value(f), 0) as bigint) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join (select x.lang, x.source as s1, y.source as s2, sum(abs(x.p-y.p)) as f from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) on a.lang = p_lang and a.source = s1 and b.source = s2 group by all),
 terms as (select lang, source, term as item, p-q as value from p join q using (lang, term) where n > 0 and p > q)
 select lang, source, part, item, value, cast(rank as int) as rank from (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms) where part = 'pair' or rank <= {d.LISTED}""".replace("select x.lang, x.source", "select x.lang as p_lang, x.source")


ORACLES = {
    "op3_mixing": f"with {_TARGETS} select doc_id, size, source_size, target, cast(size*(whole + case when (h1+seed*h2)%4294967296/4294967296e0 < part then 1 else 0 end) as bigint) as taken from drawn join seeds on drawn.source is not distinct from seeds.source",
    "op7_chat": """with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select * from (values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')))
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(length('<|im_start|>') + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\n')) + 1 + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) + length('<|im_end|>') + 1) as bigint) as formatted_chars from turns group by conv_id""",
    "op8_exact_dedup": f"""select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
 from (select doc_id, regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g') as t from documents) window w as (partition by t)""",
    "op10_warc": f"""select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to
 from (select page_id, cast(strlen(p) as bigint) as payload_bytes, sha1(p) as h, min(page_id) over (partition by p) as first_id from (select page_id, coalesce(html, '') as p from pages))""",
    "op11_quality": _quality(),
    "op12_merkle": _merkle(),
    "op13_divergence": _divergence(),
}
