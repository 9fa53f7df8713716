"""DuckDB SQL of the reference queries, written independently of the Spark plans."""

from __future__ import annotations

from sievelake.functions.text import ADDRESS_KEY, ADDRESS_STOPS, FILTER_KEYS, SCHEDULE_KEYS, STOPWORDS, STRICT_KEYS, java_escape

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def norm(x: str) -> str:
    return f"replace(lower(coalesce({x}, '')), 'ё', 'е')"


def toks(x: str, stop: bool = True) -> str:
    found = f"regexp_extract_all({norm(x)}, '[0-9a-zа-я]+')"
    return f"list_filter({found}, lambda w: w NOT IN ({_STOP}))" if stop else found


CORPUS = """corpus AS (SELECT item_id, min(item_title_raw) t, min(item_infm_params_text) p, min(item_description_raw) d, min(item_location_id) loc, min(item_latitude) lat,
  min(item_longitude) lon, min(item_microcat_id) mc, min(item_rating_reviews_count) nrev FROM benchmark_items WHERE item_id IS NOT NULL GROUP BY 1)"""
DOCS = f"""{CORPUS},
docs AS (SELECT item_id, list_concat(list_concat({toks('t')}, {toks('t')}), list_concat({toks('p')}, {toks('d')})) w FROM corpus),
tf AS (SELECT item_id, len(w) dl, unnest(w) term FROM docs),
cnt AS (SELECT item_id, dl, term, count(*) tf FROM tf GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE n, CASE WHEN avg(len(w)) > 0 THEN avg(len(w)) ELSE 1.0 END avgdl FROM docs),
df AS (SELECT term, count(*) df FROM cnt GROUP BY 1),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) idf FROM df, st),
post AS (SELECT item_id, term, idf, idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) w FROM cnt JOIN idf USING (term), st)"""
TITLE = f"""tdocs AS (SELECT item_id, {toks('t')} w FROM corpus),
tcnt AS (SELECT item_id, dl, term, count(*) tf FROM (SELECT item_id, len(w) dl, unnest(w) term FROM tdocs) GROUP BY ALL),
tst AS (SELECT count(*)::DOUBLE n, avg(len(w)) avgdl FROM tdocs),
tidf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) idf FROM (SELECT term, count(*) df FROM tcnt GROUP BY 1), tst),
tpost AS (SELECT item_id, term, idf, idf * tf * 2.2 / (tf + 1.2 * (1 - 0.5 + 0.5 * dl / avgdl)) w FROM tcnt JOIN tidf USING (term), tst)"""
ASKED = f"q AS (SELECT DISTINCT qi, unnest({toks('search_query')}) term FROM benchmark_queries)"


def topk(inner: str, k: int, order: str = "score DESC, item_id", by: str = "qi", cols: str = "*") -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) rnk FROM ({inner})) WHERE rnk <= {k}"


def grams(table: str, key: str, text: str) -> str:
    return f"""SELECT {key}, substring(pw, i, n) gram FROM (SELECT {key}, ' ' || w || ' ' pw FROM (SELECT {key}, unnest(regexp_split_to_array({text}, '[\\s\\x{{a0}}]+')) w FROM {table}) WHERE w <> ''),
  (SELECT unnest(range(3, 6)) n), LATERAL (SELECT unnest(range(1, length(pw) - n + 2)) i)"""


LOG = f"log AS (SELECT log_id, item_id, {norm('search_query')} qn, {toks('search_query')} terms FROM train)"
TFIDF = f"""texts AS (SELECT DISTINCT qn FROM log),
lg AS (SELECT qn, gram, count(*) tf FROM ({grams('texts', 'qn', 'qn')}) GROUP BY 1, 2),
voc AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM texts)) / (1.0 + count(*))) + 1 idf FROM lg GROUP BY 1 HAVING count(*) >= 2),
lraw AS (SELECT qn, gram, (1 + ln(tf)) * idf w FROM lg JOIN voc USING (gram)),
lw AS (SELECT qn, gram, w / sqrt(sum(w * w) OVER (PARTITION BY qn)) w FROM lraw)"""
NEAR = f"""{LOG}, {TFIDF},
bq AS (SELECT qi, {norm('search_query')} qn FROM benchmark_queries),
aq AS (SELECT DISTINCT qn asked FROM bq),
ag AS (SELECT asked, gram, count(*) tf FROM ({grams('aq', 'asked', 'asked')}) GROUP BY 1, 2),
araw AS (SELECT asked, gram, (1 + ln(tf)) * idf w FROM ag JOIN voc USING (gram)),
aw AS (SELECT asked, gram, w / sqrt(sum(w * w) OVER (PARTITION BY asked)) w FROM araw),
sims AS (SELECT asked, lw.qn, round(sum(aw.w * lw.w), 6) sim FROM aw JOIN lw USING (gram) GROUP BY 1, 2),
best AS (SELECT asked, qn, sim FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY sim DESC, qn) rn FROM sims WHERE sim >= 0.25) WHERE rn <= 30),
near AS (SELECT bq.qi, best.qn, sim FROM bq JOIN best ON bq.qn = best.asked)"""
KNOWN = f"""{CORPUS},
known AS (SELECT item_id, t, loc, lat, lon, mc, true in_bench FROM corpus UNION ALL
  SELECT item_id, item_title_raw, item_location_id, item_latitude, item_longitude, item_microcat_id, false FROM
    (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY log_id) rn FROM train WHERE item_id NOT IN (SELECT item_id FROM corpus)) WHERE rn = 1)"""
SHARES = "shares AS (SELECT qn, item_id, count(*) n, count(*) / sum(count(*)) OVER (PARTITION BY qn) share FROM log WHERE item_id IN (SELECT item_id FROM known) GROUP BY 1, 2)"
PROFILE = f"""{KNOWN}, {SHARES},
tt AS (SELECT DISTINCT item_id, in_bench, unnest({toks('t')}) term FROM known),
prof AS (SELECT qn, term, sum(share) value FROM shares JOIN tt USING (item_id) WHERE term IN (SELECT term FROM tt WHERE in_bench) GROUP BY 1, 2)"""
TRANS = """firsts AS (SELECT qn, terms FROM (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY log_id) rn FROM log) WHERE rn = 1),
src AS (SELECT DISTINCT qn, unnest(terms) source FROM firsts),
freq AS (SELECT source, count(*) nt FROM src GROUP BY 1 HAVING count(*) >= 2),
pw AS (SELECT term, sum(value) / (SELECT count(DISTINCT qn) FROM log) + 1e-6 p_w FROM prof GROUP BY 1),
pwt AS (SELECT source, term, sum(value) / nt p FROM src JOIN freq USING (source) JOIN prof USING (qn) GROUP BY source, term, nt),
lift AS (SELECT source, term, round(p * ln(greatest(p / p_w, 1.0)), 6) AS value FROM pwt JOIN pw USING (term)),
trans AS (SELECT source, term, value FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY value DESC, term) rn FROM lift WHERE value > 0) WHERE rn <= 50)"""
PMC = """mcs AS (SELECT qn, mc, sum(share) value FROM shares JOIN known USING (item_id) GROUP BY 1, 2),
pm0 AS (SELECT qi, mc, sum(sim * sim * value) v FROM near JOIN mcs USING (qn) GROUP BY 1, 2),
pmc AS (SELECT qi, mc, v / greatest(sum(v) OVER (PARTITION BY qi), 1e-9) pmc FROM pm0)"""
PLACED = f"{KNOWN}, placed AS (SELECT search_location_id s, known.* FROM train JOIN known USING (item_id))"
CENTRES = """own AS (SELECT loc, median(lat) lat, median(lon) lon, count(*) n_points FROM known WHERE loc IS NOT NULL GROUP BY 1),
centres AS (SELECT * FROM own UNION ALL SELECT s, median(lat), median(lon), count(*) FROM placed WHERE s IS NOT NULL AND s NOT IN (SELECT loc FROM own) GROUP BY 1)"""
HAV = "2 * 6371.0 * asin(sqrt(least(greatest(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2), 0.0), 1.0)))"
PRIOR = f"""cond AS (SELECT s, loc, count(*) / sum(count(*)) OVER (PARTITION BY s) p FROM placed WHERE s IS NOT NULL AND loc IS NOT NULL GROUP BY 1, 2), {CENTRES},
sl AS (SELECT DISTINCT search_location_id s FROM benchmark_queries WHERE search_location_id IS NOT NULL), il AS (SELECT DISTINCT loc FROM corpus WHERE loc IS NOT NULL),
dist AS (SELECT sl.s, il.loc, coalesce({HAV.format(a='a', b='b')}, 5000.0) km FROM sl CROSS JOIN il LEFT JOIN centres a ON a.loc = sl.s LEFT JOIN centres b ON b.loc = il.loc),
prior AS (SELECT dist.s, dist.loc, km, p, ln(greatest(coalesce(p, 0.0), CASE WHEN dist.s = dist.loc THEN 0.5 ELSE 0.0 END, 0.05 * exp(-km / 30.0)) + 1e-4) lp FROM dist LEFT JOIN cond ON cond.s = dist.s AND cond.loc = dist.loc)"""
#: All pairs of a query and an item with the prior, the floor where a location is null.
AT = "JOIN benchmark_queries b USING (qi) JOIN corpus c USING (item_id) LEFT JOIN prior ON prior.s = b.search_location_id AND prior.loc = c.loc"
LP = "coalesce(lp, ln(1e-4))"
_KEYS = "|".join(java_escape(k).replace(" ", "  ") for k in sorted(FILTER_KEYS, key=len, reverse=True))
_STRICT = ", ".join(f"'{k}'" for k in STRICT_KEYS)
_WS = r"[\s\x{a0}]"


def fpairs(x: str) -> str:
    """List of {k, v} of a filter text: every blank is doubled, so that each key has its own on either side, keys are marked, the text is split at the marks, and blanks are halved again."""
    from_first = rf"regexp_extract(regexp_replace({x}, '({_WS})', '\1\1', 'g'), '(?s)(?:{_KEYS})(?:{_WS}|$).*')"
    marked = rf"regexp_replace({from_first}, '(^|{_WS})({_KEYS})({_WS}|$)', chr(1) || '\2' || chr(2), 'g')"
    half = lambda y: rf"regexp_replace({y}, '({_WS}){_WS}', '\1', 'g')"
    value = rf"regexp_replace(split_part(y, chr(2), 2), '^{_WS}+|{_WS}+$', '', 'g')"
    one = "{'k': " + half("split_part(y, chr(2), 1)") + ", 'v': " + half(value) + "}"
    return f"list_filter(list_transform(string_split({marked}, chr(1))[2:], lambda y: {one}), lambda z: z.v <> '' AND NOT contains(z.v, chr(10)))"


WISHES = f"""wishes AS (SELECT qi, unnest({fpairs('search_infm_params_text')}) x FROM benchmark_queries),
wanted AS (SELECT qi, x.k k, x.v v, count(*) OVER (PARTITION BY qi) nc FROM wishes WHERE x.k IN ({_STRICT})),
vals AS (SELECT DISTINCT x.k k, x.v v FROM (SELECT unnest({fpairs('search_infm_params_text')}) x FROM (SELECT DISTINCT search_infm_params_text FROM train)) WHERE x.k IN ({_STRICT})),
have AS (SELECT item_id, k, v FROM (SELECT item_id, k, v, row_number() OVER (PARTITION BY item_id, k ORDER BY instr(p || ' ', k || ' ' || v || ' '), length(v) DESC) rn
  FROM corpus JOIN vals ON instr(p || ' ', k || ' ' || v || ' ') > 0 AND NOT (k = 'Тип услуги' AND v || ' ' LIKE 'автосервиса %')) WHERE rn = 1),
fbs AS (SELECT qi, item_id, count(DISTINCT k) / any_value(nc) fb FROM wanted JOIN have USING (k, v) GROUP BY 1, 2)"""
WITH_FB = "LEFT JOIN fbs USING (qi, item_id)"
FB = "0.5 * coalesce(fb, 0)"
QPROF = f"""p0 AS (SELECT qi, term, sum(sim * sim * value) v FROM near JOIN prof USING (qn) GROUP BY 1, 2), p1 AS (SELECT qi, term, round(v / greatest(sum(v) OVER (PARTITION BY qi), 1e-9), 6) AS value FROM p0),
qprof AS (SELECT qi, term, value FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY value DESC, term) rn FROM p1) WHERE rn <= 30)"""
QTRANS = """x0 AS (SELECT qi, trans.term, sum(value) v FROM q JOIN trans ON trans.source = q.term GROUP BY 1, 2), x1 AS (SELECT qi, term, round(v / greatest(sum(v) OVER (PARTITION BY qi), 1e-9), 6) AS value FROM x0),
qtrans AS (SELECT qi, term, value FROM (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY value DESC, term) rn FROM x1) WHERE rn <= 30)"""
KEY = "search_query, search_location_id, search_infm_params_text, search_category, search_is_delivery_search"
KEYED = " AND ".join(f"{c} IS NOT NULL" for c in KEY.split(", "))


def h01(x: str, salt: str = "") -> str:
    return f"(('0x' || substr(md5('{salt}' || {x}), 1, 8))::BIGINT / 4294967296.0)"


GROUPS = f"""items AS (SELECT DISTINCT item_id FROM train WHERE item_id IS NOT NULL), grp AS (SELECT item_id, {h01('item_id')} h, {h01('item_id')} < 0.55 is_a FROM items),
chosen AS ((SELECT item_id FROM grp WHERE is_a ORDER BY {h01('item_id', 'a')}, item_id LIMIT 1800) UNION ALL (SELECT item_id FROM grp WHERE NOT is_a ORDER BY {h01('item_id', 'b')}, item_id LIMIT 200))"""
EVENTS = f"""ev0 AS (SELECT {KEY}, item_id, min(log_id) pos FROM train WHERE {KEYED} GROUP BY ALL),
ev AS (SELECT {KEY}, min(pos) AS first_log_id, string_agg(item_id, ' ' ORDER BY pos) AS relevant, list(item_id) ids FROM ev0 GROUP BY {KEY})"""
VAL = f"""{GROUPS}, {EVENTS},
okev AS (SELECT * FROM ev WHERE len(list_filter(ids, lambda i: i NOT IN (SELECT item_id FROM chosen))) = 0),
okev2 AS (SELECT {KEY}, first_log_id, relevant FROM ev WHERE NOT EXISTS (SELECT 1 FROM ev0 WHERE {' AND '.join(f'ev0.{c} = ev.{c}' for c in KEY.split(', '))} AND ev0.item_id NOT IN (SELECT item_id FROM chosen))),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_query ORDER BY {h01("concat_ws('|', " + ', '.join(f'{c}::VARCHAR' for c in KEY.split(', ')) + ')', 'e')}, first_log_id) r FROM okev2) WHERE r = 1),
val AS (SELECT *, row_number() OVER (ORDER BY {h01('search_query', 'q')}, search_query) rn FROM one QUALIFY rn <= 100)""".replace(
    "okev AS (SELECT * FROM ev WHERE len(list_filter(ids, lambda i: i NOT IN (SELECT item_id FROM chosen))) = 0),\n", ""
)
FIT = f"fit AS (SELECT train.* FROM train WHERE item_id NOT IN (SELECT item_id FROM grp WHERE is_a) AND NOT EXISTS (SELECT 1 FROM val WHERE {' AND '.join(f'val.{c} = train.{c}' for c in KEY.split(', '))}))"
ONCE = "once AS (SELECT qi, ci, max(CASE WHEN isnan(score) THEN NULL ELSE score END) score, max(label) label, " + ", ".join(f"max(src_{n}) src_{n}" for n in ("all", "title", "prof", "tr", "hist", "mc", "emb")) + " FROM candidates GROUP BY 1, 2), rel AS (SELECT qi, sum(label)::BIGINT n_relevant FROM once GROUP BY 1 HAVING sum(label) > 0)"
RECALL = f"""{ONCE}, top AS ({topk('SELECT qi, ci, score, label FROM once WHERE score IS NOT NULL', 50, 'score DESC, ci')}),
rec AS (SELECT qi, coalesce(hits, 0)::BIGINT hits, n_relevant, coalesce(hits, 0) / n_relevant recall FROM rel LEFT JOIN (SELECT qi, sum(label) hits FROM top GROUP BY 1) USING (qi))"""
IDS = "ids AS (SELECT DISTINCT ci, item_id FROM emb_items_full)"
VEC = "v AS (SELECT ci, min(embedding::DOUBLE[]) e FROM emb_items_full WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"
SIM = f"{VEC}, s AS (SELECT a.ci q_ci, b.ci, round(list_cosine_similarity(a.e, b.e), 6) sim FROM v a JOIN v b ON a.ci % 100 = 0)"
_REL = lambda c, t="DOUBLE": f"round(nullif_nan({c}) / CASE WHEN max(nullif_nan({c})) OVER w > 0 THEN max(nullif_nan({c})) OVER w ELSE 1 END, 5) + 0.0".replace(f"nullif_nan({c})", f"(CASE WHEN isnan({c}) THEN NULL ELSE {c}::{t} END)")
_RANK = lambda c: f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN rank() OVER (PARTITION BY qi ORDER BY CASE WHEN isnan({c}) THEN NULL ELSE {c} END DESC NULLS LAST) END"
def bm25(name: str, words: str, b: float) -> str:
    """Postings (item_id, term, idf, w) of a field of the corpus, as ``name``."""
    return f"""{name}_d AS (SELECT item_id, {words} w FROM corpus), {name}_c AS (SELECT item_id, dl, term, count(*) tf FROM (SELECT item_id, len(w) dl, unnest(w) term FROM {name}_d) GROUP BY ALL),
{name}_s AS (SELECT count(*)::DOUBLE n, CASE WHEN avg(len(w)) > 0 THEN avg(len(w)) ELSE 1.0 END a FROM {name}_d),
{name}_i AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) idf FROM (SELECT term, count(*) df FROM {name}_c GROUP BY 1), {name}_s),
{name} AS (SELECT item_id, term, idf, idf * tf * 2.2 / (tf + 1.2 * (1 - {b} + {b} * dl / a)) w FROM {name}_c JOIN {name}_i USING (term), {name}_s)"""


def source(name: str, inner: str, k: int) -> str:
    return f"src_{name} AS (SELECT qi, item_id, '{name}' src FROM ({topk(inner, k)}))"


_SCORES = {"title": ("q", "1", "tpost"), "params": ("q", "1", "ppost"), "desc": ("q", "1", "dpost"), "all": ("q", "1", "post"), "prof": ("qprof", "value", "tpost"), "tr": ("qtrans", "value", "tpost")}
_REL9 = ["bm_title", "bm_all", "bm_prof", "bm_tr", "bm_desc", "emb_sim", "pmc", "loc_logp", "reviews"]
_FULL = f"SELECT qi, item_id, round(sc + 2 * {LP} + {FB}, 6) score FROM {{}} sc {AT} {WITH_FB}"
FEATURES = (
    f"WITH {NEAR}, {PROFILE}, {QPROF}, {TRANS}, {ASKED}, {QTRANS}, {PLACED.replace(KNOWN + ', ', '')}, {PRIOR}, {WISHES}, {PMC}, {VEC}, {IDS}, "
    + ", ".join(bm25(n, w, b) for n, w, b in (("post", f"list_concat(list_concat({toks('t')}, {toks('t')}), list_concat({toks('p')}, {toks('d')}))", 0.75), ("tpost", toks("t"), 0.5), ("ppost", toks("p"), 0.75), ("dpost", toks("d"), 0.75)))
    + "".join(f", s_{n} AS (SELECT qi, item_id, sum({v} * w) sc, sum(idf) m FROM {a} JOIN {p} USING (term) GROUP BY 1, 2)" for n, (a, v, p) in _SCORES.items())
    + """, cl AS (SELECT qn, item_id, count(*) n FROM log WHERE item_id IN (SELECT item_id FROM corpus) GROUP BY 1, 2),
hist AS (SELECT qi, item_id, sum(sim * sim * n) sc, sum(CASE WHEN sim > 0.99 THEN n ELSE 0 END) ex FROM near JOIN cl USING (qn) GROUP BY 1, 2),
qs AS (SELECT qi, search_location_id s FROM benchmark_queries WHERE qi IN (SELECT qi FROM pmc)),
cosines AS (SELECT b.qi, c.item_id, list_cosine_similarity(a.e, i.e) sim FROM v a JOIN benchmark_queries b ON b.qi = a.ci CROSS JOIN v i JOIN ids ON ids.ci = i.ci JOIN corpus c ON c.item_id = ids.item_id), """
    + ", ".join(source(n, _FULL.format(f"s_{n}"), k) for n, k in (("all", 200), ("title", 100), ("prof", 100), ("tr", 100)))
    + ", " + source("hist", f"SELECT qi, item_id, round(ln(sc + 1e-3) + {LP}, 6) score FROM hist sc {AT}", 50)
    + ", " + source("mc", f"SELECT qs.qi, c.item_id, round(ln(coalesce(pmc.pmc, 0.0) + 1e-3) + 2 * {LP} + 0.1 * ln(1 + coalesce(nrev, 0)) + {FB}, 6) score FROM qs CROSS JOIN corpus c LEFT JOIN prior ON prior.s = qs.s AND prior.loc = c.loc LEFT JOIN pmc ON pmc.qi = qs.qi AND pmc.mc = c.mc LEFT JOIN fbs ON fbs.qi = qs.qi AND fbs.item_id = c.item_id", 50)
    + ", " + source("emb", f"SELECT qi, item_id, round(40 * round(sim, 6) + 2 * {LP} + {FB}, 6) score FROM cosines {AT} {WITH_FB}", 100)
    + ", found AS (" + " UNION ALL ".join(f"FROM src_{n}" for n in ("all", "title", "prof", "tr", "hist", "mc", "emb")) + "), "
    + source("pop", f"SELECT b.qi, c.item_id, round(2 * {LP} + 0.1 * ln(1 + coalesce(nrev, 0)), 6) score FROM benchmark_queries b CROSS JOIN corpus c LEFT JOIN prior ON prior.s = b.search_location_id AND prior.loc = c.loc WHERE b.qi NOT IN (SELECT qi FROM found)", 50)
    + ", flags AS (SELECT qi, item_id, " + ", ".join(f"max(CASE WHEN src = '{n}'{' OR src = ' + chr(39) + 'pop' + chr(39) if n == 'mc' else ''} THEN 1 ELSE 0 END)::BIGINT src_{n}" for n in ("all", "title", "prof", "tr", "hist", "mc", "emb"))
    + " FROM (FROM found UNION ALL FROM src_pop) GROUP BY 1, 2),\n"
    + """more AS (SELECT item_id, min(item_rating) r, min(item_price) price, min(item_is_phone_hidden) ph, min(item_is_message_forbidden) mf, min(item_category_id) cat FROM benchmark_items WHERE item_id IS NOT NULL GROUP BY 1),
qi_idf AS (SELECT qi, sum(idf) q_idf, count(idf)::DOUBLE q_nknown FROM q JOIN post_i USING (term) GROUP BY 1),
base0 AS (SELECT f.*, """
    + ", ".join(f"round(coalesce(x_{n}.sc, 0.0), 6) bm_{n}" for n in _SCORES)
    + f""", coalesce(q_idf, 0.0) q_idf, coalesce(q_nknown, 0.0) q_nknown, coalesce(x_title.m, 0.0) / greatest(coalesce(q_idf, 0.0), 1e-6) cov_title, coalesce(x_all.m, 0.0) / greatest(coalesce(q_idf, 0.0), 1e-6) cov_all,
  coalesce(round(cosines.sim, 6), 0.0) emb_sim, coalesce((SELECT max(round(z.sim, 6)) FROM cosines z WHERE z.qi = f.qi), 0.0) emb_sim_max, coalesce(hist.sc, 0.0) hist_nb, coalesce(hist.ex, 0)::DOUBLE hist_exact,
  ln(1 + (SELECT count(*) FROM log WHERE log.item_id = f.item_id)) hist_cnt, coalesce(prior.p, 0.0) loc_p, CASE WHEN b.search_location_id = c.loc THEN 1.0 ELSE 0.0 END loc_same, ln(1 + coalesce(km, 5000.0)) loc_dist, round({LP}, 6) loc_logp,
  coalesce((SELECT any_value(nc) FROM wanted w WHERE w.qi = f.qi), 0)::DOUBLE q_ncons, coalesce(fb, 0.0) fb, round(coalesce(pmc.pmc, 0.0), 6) pmc, coalesce((SELECT max(z.pmc) FROM pmc z WHERE z.qi = f.qi), 0.0) pmc_max,
  coalesce(r, -1.0) rating, ln(1 + coalesce(nrev, 0)) reviews, ln(1 + CASE WHEN price IS NULL THEN NULL ELSE least(greatest(price, 0.0), 1e7) END) log_price, ph::INT::DOUBLE phone_hidden, mf::INT::DOUBLE msg_forbidden,
  greatest(len({toks('t')}), 1)::DOUBLE title_len, greatest(len({toks('d')}) - 1, 0)::DOUBLE desc_len, (CASE WHEN cat = 114 THEN 1 ELSE 0 END)::BIGINT cat114, len({toks('b.search_query')})::DOUBLE q_nterms,
  coalesce((SELECT max(sim) FROM near WHERE near.qi = f.qi), 0.0) q_nb_max, (SELECT count(*) FROM near WHERE near.qi = f.qi)::DOUBLE q_nb_cnt, CASE WHEN b.search_location_id IN (SELECT loc FROM corpus WHERE loc IS NOT NULL) THEN 0.0 ELSE 1.0 END q_region,
  ln(1 + (SELECT count(*) FROM placed WHERE placed.s = b.search_location_id)) q_loc_n, count(*) OVER (PARTITION BY f.qi)::DOUBLE q_ncand
FROM flags f JOIN benchmark_queries b USING (qi) JOIN corpus c USING (item_id) JOIN more USING (item_id) LEFT JOIN prior ON prior.s = b.search_location_id AND prior.loc = c.loc LEFT JOIN fbs USING (qi, item_id)
  LEFT JOIN hist USING (qi, item_id) LEFT JOIN cosines USING (qi, item_id) LEFT JOIN pmc ON pmc.qi = f.qi AND pmc.mc = c.mc LEFT JOIN qi_idf ON qi_idf.qi = f.qi """
    + " ".join(f"LEFT JOIN s_{n} x_{n} ON x_{n}.qi = f.qi AND x_{n}.item_id = f.item_id" for n in _SCORES)
    + "),\nbased AS (SELECT * EXCLUDE (fb), CASE WHEN q_ncons > 0 THEN fb ELSE -1.0 END filt_frac, bm_all + 2 * loc_logp base, 40 * emb_sim + 2 * loc_logp emb_base, "
    + ", ".join(f"{c} / CASE WHEN max({c}) OVER w > 0 THEN max({c}) OVER w ELSE 1 END {c}_rel, rank() OVER (w ORDER BY {c} DESC) {c}_rank" for c in _REL9)
    + " FROM base0 WINDOW w AS (PARTITION BY qi)), ranked AS (SELECT *, rank() OVER (PARTITION BY qi ORDER BY base DESC) base_rank, rank() OVER (PARTITION BY qi ORDER BY emb_base DESC) emb_base_rank FROM based)\n"
    + "SELECT qi, item_id, COLUMNS('^(src_.*|cat114|.*_rank)$'), round(COLUMNS(lambda c: NOT regexp_matches(c, '^(qi|item_id|src_.*|cat114|.*_rank)$')), 6) FROM ranked"
)
SRC = ("all", "title", "prof", "tr", "hist", "mc", "emb")

SQL = {
    "normalize_tokens": f"WITH {CORPUS} SELECT item_id, {norm('t')} AS norm, coalesce(array_to_string({toks('t', False)}, ' '), '') AS tokens FROM corpus",
    "stopword_filter": f"WITH {CORPUS} SELECT item_id, len({toks('d')}) AS n_kept, coalesce(array_to_string({toks('d')}, ' '), '') AS kept FROM corpus",
    "char_wb_ngrams": f"WITH b AS (SELECT qi, {norm('search_query')} qn FROM benchmark_queries) SELECT qi, gram, count(*) AS n FROM ({grams('b', 'qi', 'qn')}) GROUP BY 1, 2",
    "term_frequency": f"WITH {DOCS} SELECT item_id, term, tf FROM cnt",
    "doc_frequency": f"WITH {DOCS} SELECT term, df FROM df",
    "doc_length_avg": f"WITH {DOCS} SELECT n::BIGINT AS n_docs, round(avgdl, 6) AS avgdl FROM st",
    "bm25_idf": f"WITH {DOCS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_postings": f"WITH {DOCS} SELECT item_id, term, round(w, 6) AS weight FROM post",
    "bm25_topk": f"WITH {DOCS}, {ASKED} " + topk("SELECT qi, item_id, round(sum(w), 6) score FROM q JOIN post USING (term) GROUP BY 1, 2", 50, cols="qi, item_id, score, rnk"),
    "bm25_title_weighted": f"WITH {CORPUS}, {TITLE}, {ASKED} " + topk("SELECT qi, item_id, round(sum(w), 6) score FROM q JOIN tpost USING (term) GROUP BY 1, 2", 50, cols="qi, item_id, score, rnk"),
    "idf_coverage": f"WITH {DOCS}, {TITLE}, {ASKED}, tot AS (SELECT qi, sum(idf) q_idf FROM q JOIN idf USING (term) GROUP BY 1), best AS ("
    + topk("SELECT qi, item_id, round(sum(w), 6) score, sum(idf) m FROM q JOIN tpost USING (term) GROUP BY 1, 2", 100)
    + ") SELECT qi, item_id, round(m / greatest(coalesce(q_idf, 0), 1e-6), 6) AS cov_title FROM best LEFT JOIN tot USING (qi)",
    "tfidf_l2": f"WITH {LOG}, {TFIDF} SELECT qn, gram AS term, round(w, 6) AS weight FROM lw",
    "query_neighbors": f"WITH {NEAR} SELECT qi, qn, sim FROM near",
    "log_profiles": f"WITH {LOG}, {PROFILE} SELECT qn, term, round(value, 6) AS value FROM prof",
    "query_profile": f"WITH {NEAR}, {PROFILE}, p0 AS (SELECT qi, term, sum(sim * sim * value) v FROM near JOIN prof USING (qn) GROUP BY 1, 2), p1 AS (SELECT qi, term, round(v / greatest(sum(v) OVER (PARTITION BY qi), 1e-9), 6) AS value FROM p0) "
    + topk("SELECT * FROM p1", 30, "value DESC, term", cols="qi, term, value"),
    "term_translation": f"WITH {LOG}, {PROFILE}, {TRANS} SELECT source, term, value FROM trans",
    "query_translation": f"WITH {LOG}, {PROFILE}, {TRANS}, {ASKED}, x0 AS (SELECT qi, trans.term, sum(value) v FROM q JOIN trans ON trans.source = q.term GROUP BY 1, 2), x1 AS (SELECT qi, term, round(v / greatest(sum(v) OVER (PARTITION BY qi), 1e-9), 6) AS value FROM x0) "
    + topk("SELECT * FROM x1", 30, "value DESC, term", cols="qi, term, value"),
    "microcat_distribution": f"WITH {NEAR}, {KNOWN}, {SHARES}, {PMC} SELECT qi, mc AS item_microcat_id, round(pmc, 6) AS pmc FROM pmc",
    "item_history": f"WITH {CORPUS} SELECT item_id, coalesce(n, 0) AS n_clicks FROM corpus LEFT JOIN (SELECT item_id, count(*) n FROM train GROUP BY 1) USING (item_id)",
    "history_topk": f"WITH {NEAR}, {CORPUS}, cl AS (SELECT qn, item_id, count(*) n FROM log WHERE item_id IN (SELECT item_id FROM corpus) GROUP BY 1, 2) "
    + topk("SELECT qi, item_id, round(sum(sim * sim * n), 6) hist_nb, sum(CASE WHEN sim > 0.99 THEN n ELSE 0 END)::BIGINT hist_exact FROM near JOIN cl USING (qn) GROUP BY 1, 2", 50, "hist_nb DESC, item_id", cols="qi, item_id, hist_nb, hist_exact"),
    "first_by_position": "SELECT item_id, log_id, search_query, item_price FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY log_id) rn FROM train WHERE item_id IS NOT NULL) WHERE rn = 1",
    "union_precedence": f"WITH {KNOWN} SELECT item_id, t AS item_title_raw, mc AS item_microcat_id, in_bench FROM known",
    "ordered_distinct_list": f"WITH {EVENTS} SELECT {KEY}, first_log_id, relevant FROM ev",
    "event_all_in_corpus": f"WITH {CORPUS}, {EVENTS} SELECT {KEY} FROM ev0 GROUP BY {KEY} HAVING bool_and(item_id IN (SELECT item_id FROM corpus))",
    "md5_bucket_split": f"WITH {GROUPS} SELECT item_id, h, is_a FROM grp",
    "sample_exact_n": f"WITH {GROUPS} SELECT item_id FROM chosen",
    "validation_events": f"WITH {VAL} SELECT printf('val%06d', rn - 1) AS query_id, CASE WHEN rn <= 30 THEN 'eval' ELSE 'rank' END AS part, search_query, search_location_id, relevant FROM val",
    "anti_join_fit": f"WITH {VAL}, {FIT} SELECT log_id, item_id FROM fit",
    "split_leakage": f"WITH {VAL}, {FIT} SELECT (SELECT round(avg(CASE WHEN search_query IN (SELECT search_query FROM fit WHERE search_query IS NOT NULL) THEN 1.0 ELSE 0.0 END), 6) FROM val) AS seen_texts, (SELECT round(avg(CASE WHEN item_id IN (SELECT item_id FROM fit) THEN 1.0 ELSE 0.0 END), 6) FROM chosen) AS seen_items",
    "location_conditional": f"WITH {PLACED} SELECT s AS search_location_id, loc AS item_location_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY s), 6) AS p FROM placed WHERE s IS NOT NULL AND loc IS NOT NULL GROUP BY 1, 2",
    "location_median_centroid": f"WITH {PLACED}, {CENTRES} SELECT loc AS location, round(lat, 6) AS lat, round(lon, 6) AS lon, n_points FROM centres",
    "haversine_distance": f"WITH {PLACED}, {CENTRES} SELECT k.item_id, round({HAV.format(a='k', b='c')}, 4) AS km FROM known k JOIN centres c USING (loc) WHERE k.lat IS NOT NULL AND k.lon IS NOT NULL",
    "location_log_prior": f"WITH {PLACED}, {PRIOR} SELECT s AS s_loc, loc AS item_loc, round(km, 4) AS loc_dist, round(lp, 6) AS loc_logp FROM prior WHERE p IS NOT NULL OR s = loc OR km <= 1000",
    "bm25_location_topk": f"WITH {DOCS}, {ASKED}, {PLACED.replace(CORPUS + ',', '')}, {PRIOR}, sc AS (SELECT qi, item_id, sum(w) sc FROM q JOIN post USING (term) GROUP BY 1, 2) "
    + topk(f"SELECT sc.qi, sc.item_id, round(sc + 2 * {LP}, 6) score FROM sc {AT}", 200, cols="qi, item_id"),
    "src_all": f"WITH {DOCS}, {ASKED}, {PLACED.replace(CORPUS + ',', '')}, {PRIOR}, {WISHES}, sc AS (SELECT qi, item_id, sum(w) sc FROM q JOIN post USING (term) GROUP BY 1, 2) "
    + topk(f"SELECT qi, item_id, round(sc + 2 * {LP} + {FB}, 6) score FROM sc {AT} {WITH_FB}", 200, cols="qi, item_id"),
    "src_title": f"WITH {PLACED}, {TITLE}, {ASKED}, {PRIOR}, {WISHES}, sc AS (SELECT qi, item_id, sum(w) sc FROM q JOIN tpost USING (term) GROUP BY 1, 2) "
    + topk(f"SELECT qi, item_id, round(sc + 2 * {LP} + {FB}, 6) score FROM sc {AT} {WITH_FB}", 100, cols="qi, item_id"),
    "src_prof": f"WITH {NEAR}, {PROFILE}, {QPROF}, {TITLE}, {PLACED.replace(KNOWN + ', ', '')}, {PRIOR}, {WISHES}, sc AS (SELECT qi, item_id, sum(value * w) sc FROM qprof JOIN tpost USING (term) GROUP BY 1, 2) "
    + topk(f"SELECT qi, item_id, round(sc + 2 * {LP} + {FB}, 6) score FROM sc {AT} {WITH_FB}", 100, cols="qi, item_id"),
    "src_tr": f"WITH {LOG}, {PROFILE}, {TRANS}, {ASKED}, {QTRANS}, {TITLE}, {PLACED.replace(KNOWN + ', ', '')}, {PRIOR}, {WISHES}, sc AS (SELECT qi, item_id, sum(value * w) sc FROM qtrans JOIN tpost USING (term) GROUP BY 1, 2) "
    + topk(f"SELECT qi, item_id, round(sc + 2 * {LP} + {FB}, 6) score FROM sc {AT} {WITH_FB}", 100, cols="qi, item_id"),
    "src_hist": f"WITH {NEAR}, {PLACED}, {PRIOR}, cl AS (SELECT qn, item_id, count(*) n FROM log WHERE item_id IN (SELECT item_id FROM corpus) GROUP BY 1, 2), sc AS (SELECT qi, item_id, sum(sim * sim * n) sc FROM near JOIN cl USING (qn) GROUP BY 1, 2) "
    + topk(f"SELECT qi, item_id, round(ln(sc + 1e-3) + {LP}, 6) score FROM sc {AT}", 50, cols="qi, item_id"),
    "src_mc": f"WITH {NEAR}, {PLACED}, {SHARES}, {PMC}, {PRIOR}, {WISHES}, qs AS (SELECT qi, search_location_id s FROM benchmark_queries WHERE qi IN (SELECT qi FROM pmc)) "
    + topk(f"SELECT qs.qi, c.item_id, round(ln(coalesce(pmc.pmc, 0.0) + 1e-3) + 2 * {LP} + 0.1 * ln(1 + coalesce(nrev, 0)) + {FB}, 6) score FROM qs CROSS JOIN corpus c LEFT JOIN prior ON prior.s = qs.s AND prior.loc = c.loc LEFT JOIN pmc ON pmc.qi = qs.qi AND pmc.mc = c.mc LEFT JOIN fbs ON fbs.qi = qs.qi AND fbs.item_id = c.item_id", 50, cols="qi, item_id"),
    "src_emb": f"WITH {VEC}, {IDS}, {PLACED}, {PRIOR}, {WISHES} "
    + topk(f"SELECT b.qi, c.item_id, round(40 * round(list_cosine_similarity(a.e, i.e), 6) + 2 * {LP} + {FB}, 6) total FROM v a JOIN benchmark_queries b ON b.qi = a.ci CROSS JOIN v i JOIN ids ON ids.ci = i.ci JOIN corpus c ON c.item_id = ids.item_id LEFT JOIN prior ON prior.s = b.search_location_id AND prior.loc = c.loc LEFT JOIN fbs ON fbs.qi = b.qi AND fbs.item_id = c.item_id", 100, "total DESC, item_id", cols="qi, item_id, total"),
    "features_66": FEATURES,
    "parse_filters": f"SELECT qi, pos::INT AS pos, ps[pos + 1].k AS filter_key, ps[pos + 1].v AS filter_value FROM (SELECT qi, ps, unnest(range(0, len(ps))) pos FROM (SELECT qi, {fpairs('search_infm_params_text')} ps FROM benchmark_queries))",
    "required_phrases": f"SELECT qi, coalesce(array_to_string(list_transform(list_filter(coalesce({fpairs('search_infm_params_text')}, []), lambda x: x.k IN ({_STRICT})), lambda x: x.k || ' ' || x.v), '|'), '') AS phrases FROM benchmark_queries",
    "filter_match_fraction": f"WITH {CORPUS}, {WISHES} SELECT qi, item_id, round(fb, 6) AS fb FROM fbs",
    "params_without_place": f"WITH {CORPUS} SELECT item_id, regexp_replace(regexp_replace(coalesce(p, ''), '{java_escape(ADDRESS_KEY)}.*?( (?:{'|'.join(java_escape(x) for x in ADDRESS_STOPS)})|$)', ' \\1', 'g'), '(?:{'|'.join(SCHEDULE_KEYS)})[^А-ЯЁ]*', ' ', 'g') AS params FROM corpus",
    "microcat_topk": f"WITH {NEAR}, {PLACED}, {SHARES}, {PMC}, {PRIOR}, qs AS (SELECT qi, search_location_id s FROM benchmark_queries WHERE qi IN (SELECT qi FROM pmc)) "
    + topk(f"SELECT qs.qi, c.item_id, round(ln(coalesce(pmc.pmc, 0.0) + 1e-3) + 2 * {LP} + 0.1 * ln(1 + coalesce(nrev, 0)), 6) score FROM qs CROSS JOIN corpus c LEFT JOIN prior ON prior.s = qs.s AND prior.loc = c.loc LEFT JOIN pmc ON pmc.qi = qs.qi AND pmc.mc = c.mc", 50, cols="qi, item_id"),
    "popular_topk": f"WITH {PLACED}, {PRIOR} " + topk(f"SELECT b.qi, c.item_id, round(2 * {LP} + 0.1 * ln(1 + coalesce(nrev, 0)), 6) score FROM benchmark_queries b CROSS JOIN corpus c LEFT JOIN prior ON prior.s = b.search_location_id AND prior.loc = c.loc", 50, cols="qi, item_id"),
    "embedding_topk": f"WITH {SIM} " + topk("SELECT * FROM s", 100, "sim DESC, ci", "q_ci", "q_ci, ci, sim"),
    "embedding_global_max": f"WITH {SIM} SELECT q_ci, max(sim) AS sim_max FROM s GROUP BY 1",
    "candidate_union_flags": "SELECT qi, ci, " + ", ".join(f"max(CASE WHEN src_{n} = 1 THEN 1 ELSE 0 END)::TINYINT AS src_{n}" for n in SRC) + " FROM candidates GROUP BY 1, 2 HAVING " + " + ".join(f"max(CASE WHEN src_{n} = 1 THEN 1 ELSE 0 END)" for n in SRC) + " > 0",
    "candidate_lookup_default": f"WITH {IDS}, c AS (SELECT ci, count(*) n FROM train JOIN ids USING (item_id) GROUP BY 1) SELECT qi, d.ci, coalesce(n, 0) AS n_clicks FROM (SELECT DISTINCT qi, ci FROM candidates) d LEFT JOIN c ON c.ci = d.ci",
    "relative_to_max": f"SELECT qi, ci, {_REL('bm_all')} AS bm_all_rel, {_REL('loc_logp')} AS loc_logp_rel, {_REL('score')} AS score_rel FROM candidates WINDOW w AS (PARTITION BY qi)",
    "rank_min": f"SELECT qi, ci, {_RANK('bm_all')} AS bm_all_rank, {_RANK('score')} AS score_rank FROM candidates",
    "base_score_rank": f"WITH b AS (SELECT qi, ci, round(bm_all::DOUBLE + 2 * loc_logp::DOUBLE, 5) base, round(40 * emb_sim::DOUBLE + 2 * loc_logp::DOUBLE, 5) emb_base FROM candidates) SELECT qi, ci, base, emb_base, {_RANK('base')} AS base_rank, {_RANK('emb_base')} AS emb_base_rank FROM b",
    "label_join": f"WITH {LOG}, {IDS}, pos AS (SELECT DISTINCT b.qi, ids.ci FROM (SELECT DISTINCT qn, item_id FROM log) l JOIN ids USING (item_id) JOIN (SELECT qi, {norm('search_query')} qn FROM benchmark_queries) b USING (qn)) SELECT d.qi, d.ci, CASE WHEN pos.qi IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT DISTINCT qi, ci FROM candidates) d LEFT JOIN pos ON pos.qi = d.qi AND pos.ci = d.ci",
    "recall_at_k": f"WITH {RECALL} SELECT qi, hits, n_relevant, round(recall, 6) AS recall FROM rec",
    "mean_recall": f"WITH {RECALL} SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall FROM rec",
    "recall_ceiling": f"WITH {ONCE}, g AS (SELECT qi, sum(label) hits, count(*) n FROM once GROUP BY 1) SELECT round(avg(n), 6) AS candidates_per_query, round(avg(coalesce(hits, 0) / n_relevant), 6) AS recall FROM rel LEFT JOIN g USING (qi)",
    "per_source_recall": f"WITH {ONCE} " + " UNION ALL ".join(f"(SELECT '{n}' AS source, round(avg(coalesce(h, 0) / n_relevant), 6) AS recall FROM rel LEFT JOIN (SELECT qi, sum(CASE WHEN src_{n} = 1 THEN label ELSE 0 END) h FROM once GROUP BY 1) USING (qi))" for n in SRC),
    "group_has_positive": "SELECT qi, count(*) AS n_rows, sum(label)::BIGINT AS n_positive FROM candidates GROUP BY 1 HAVING max(label) > 0",
    "answer_string_agg": f"WITH {RECALL.split(', top AS')[0]}, {IDS}, top AS (" + topk("SELECT qi, item_id, score FROM once JOIN ids USING (ci) WHERE score IS NOT NULL", 50, "score DESC, item_id") + "), a AS (SELECT qi, string_agg(item_id, ' ' ORDER BY rnk) answer FROM top GROUP BY 1) SELECT query_id, coalesce(answer, '') AS answer FROM benchmark_queries LEFT JOIN a USING (qi)",
    "answer_validation": f"WITH {RECALL.split(', top AS')[0]}, {IDS}, top AS (" + topk("SELECT qi, item_id, score FROM once JOIN ids USING (ci) WHERE score IS NOT NULL", 50, "score DESC, item_id") + """), a AS (SELECT qi, string_agg(item_id, ' ' ORDER BY rnk) answer FROM top GROUP BY 1),
ans AS (SELECT qi, query_id, coalesce(answer, '') answer FROM benchmark_queries LEFT JOIN a USING (qi)),
given AS (SELECT CASE WHEN qi % 7 = 4 THEN 'x' || query_id ELSE query_id END query_id,
    CASE qi % 7 WHEN 2 THEN answer || ' unknown' WHEN 3 THEN answer || ' ' || split_part(answer, ' ', 1) WHEN 5 THEN answer || ' ' || array_to_string(list_transform(range(0, 51), lambda i: 'new' || i), ' ') ELSE answer END answer
  FROM ans CROSS JOIN (SELECT unnest([1, 2]) copy) WHERE qi % 7 <> 0 AND (copy = 1 OR qi % 7 = 1)),
parts AS (SELECT query_id, list_filter(string_split(answer, ' '), lambda x: x <> '') ids FROM given)
SELECT 'repeated query' AS problem, count(*) AS n FROM (SELECT query_id FROM parts GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'query without answer', count(*) FROM benchmark_queries WHERE query_id NOT IN (SELECT query_id FROM parts)
UNION ALL SELECT 'unknown query', count(*) FROM parts WHERE query_id NOT IN (SELECT query_id FROM benchmark_queries)
UNION ALL SELECT 'too many items', count(*) FROM parts WHERE len(ids) > 50
UNION ALL SELECT 'repeated item', count(*) FROM parts WHERE len(list_distinct(ids)) < len(ids)
UNION ALL SELECT 'unknown item', count(*) FROM (SELECT unnest(ids) id FROM parts) WHERE id NOT IN (SELECT item_id FROM benchmark_items WHERE item_id IS NOT NULL)""",
    "row_normalize_topk": "WITH o AS (SELECT qi, ci, max(bm_all::DOUBLE) v FROM candidates GROUP BY 1, 2 HAVING max(bm_all) > 0), s AS (SELECT qi, ci, round(v / greatest(sum(v) OVER (PARTITION BY qi), 1e-9), 6) AS share FROM o) " + topk("SELECT * FROM s", 30, "share DESC, ci", cols="qi, ci, share"),
    "feature_vector_wide": f"""WITH c AS (SELECT item_id, min(item_title_raw) t, min(item_description_raw) d, min(item_rating) r, min(item_rating_reviews_count) n, min(item_price) p, min(item_is_phone_hidden) ph, min(item_is_message_forbidden) mf, min(item_category_id) cat FROM benchmark_items WHERE item_id IS NOT NULL GROUP BY 1)
SELECT item_id, round(coalesce(r, -1.0), 6) AS rating, round(ln(1 + coalesce(n, 0)), 6) AS reviews, round(ln(1 + CASE WHEN p IS NULL THEN NULL ELSE least(greatest(p, 0.0), 1e7) END), 6) AS log_price, ph::INT::DOUBLE AS phone_hidden, mf::INT::DOUBLE AS msg_forbidden,
  (CASE WHEN len({toks('t')}) = 0 THEN 1 ELSE len({toks('t')}) END)::DOUBLE AS title_len, (CASE WHEN len({toks('d')}) = 0 THEN 0 ELSE len({toks('d')}) - 1 END)::DOUBLE AS desc_len, (CASE WHEN cat = 114 THEN 1 ELSE 0 END)::TINYINT AS cat114 FROM c""",
}
