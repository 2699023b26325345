"""Corpus management, evaluation, pairwise comparison and language-model statistics, as SQL for either engine.

Documents stand for a corpus (source: an author or profile, lang: a purpose), events for the analysis history, labels for
the calibration corpus, benchmark passages for originals that rewrites are compared with.
"""

from __future__ import annotations

from inkspan.functions.dialect import Spark, mean, spread
from inkspan.functions.lexicons import GENRE_RICHNESS
from inkspan.operators import document as D
from inkspan.operators import profile as P
from inkspan.operators import sentence as S

AS_OF = "timestamp '2024-01-30 00:00:00'"


def words(d: Spark, x: str = "lower(text)") -> str:
    return d.extract(x, r"[\p{L}\p{N}_]+")


def normal(d: Spark, x: str) -> str:
    """Stripped, lower-cased, white space collapsed."""
    return d.strip("lower(" + d.replace(x, r"\s+", " ") + ")")


def folded(d: Spark, x: str) -> str:
    """Compatibility forms folded (NFKC), then as T17. DuckDB has only NFC: there the two agree on texts without such forms."""
    return f"inkspan_nfkc({x})" if d.name == "spark" else normal(d, f"nfc_normalize({x})")


def _json(d: Spark, x: str, key: str) -> str:
    return f"get_json_object({x}, '$.{key}')" if d.name == "spark" else f"json_extract_string({x}, '$.{key}')"


def _days(d: Spark, n: int) -> str:
    return f"interval {n} days" if d.name == "spark" else f"INTERVAL {n} DAY"


def _ts(e: str) -> str:
    return f"cast({e} as varchar(40))"


# --- S: relational shapes ---
def s01(d: Spark) -> str:
    return "select doc_id, source, lang from {documents} where doc_id = 42"


def s02(d: Spark) -> str:
    return "select doc_id, n_chars from {documents} where source = 'src1' and lang = 'en'"


def s03(d: Spark) -> str:
    return "select event_id, user_id from {events} order by ts desc, event_id limit 25"


def s04(d: Spark) -> str:
    return "select doc_id, case lang when 'en' then 1 when 'de' then 2 else 3 end as rank, source from {documents} order by rank, source, doc_id"


def s05(d: Spark) -> str:
    return f"select lang, count(*) as docs, coalesce(sum({d.length('text')}), 0) as chars from {{documents}} group by lang"


def s06(d: Spark) -> str:
    return "select source, count(distinct lang) as langs, count(distinct doc_id) as docs from {documents} group by source"


def s07(d: Spark) -> str:
    return "select source, count(*) as docs, (select count(*) from {documents}) as total from {documents} group by source"


def s08(d: Spark) -> str:
    return "select doc_id, exists (select 1 from {labels} l where l.doc_id = d.doc_id) as labelled from {documents} d"


def s09(d: Spark) -> str:
    return f"select event_id, event_type, {_json(d, 'props', 'k')} as k from {{events}} order by ts desc, event_id limit 100"


def s10(d: Spark) -> str:
    """Retention: younger than the limit, and at most so many for each user, the newest first."""
    return f"select user_id, event_id from (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as place from {{events}}) x where place <= 50 and ts >= {AS_OF} - {_days(d, 20)}"


def s11(d: Spark) -> str:
    return f"select event_id from {{events}} where ts < {AS_OF} - {_days(d, 25)} and event_type <> 'purchase'"


def s12(d: Spark) -> str:
    """Cascading delete: what is left of the children when their parents of one kind go."""
    return "select l.doc_id, l.quality from {labels} l where not exists (select 1 from {documents} p where p.doc_id = l.doc_id and p.source = 'src3')"


def s13(d: Spark) -> str:
    """UPDATE .. FROM: each document takes the default of its group (the first of its source), where there is one."""
    return "select a.doc_id as doc_id, coalesce(b.lang, a.lang) as lang from {documents} a left join (select source, min_by(lang, doc_id) as lang from {documents} group by source) b on a.source = b.source"


def s14(d: Spark) -> str:
    """Upsert: of two versions of a key the later wins."""
    return "select doc_id, lang, version from (select *, row_number() over (partition by doc_id order by version desc) as z_k from (select doc_id, lang, 1 as version from {documents} union all select doc_id, 'xx' as lang, 2 as version from {labels}) u) x where z_k = 1"


def s15(d: Spark) -> str:
    """Insert what isn't there yet."""
    return "select doc_id, 'old' as origin from {labels} union all select d.doc_id, 'new' as origin from {documents} d left join {labels} l on d.doc_id = l.doc_id where l.doc_id is null"


def s16(d: Spark) -> str:
    return f"select doc_id, {d.length('left(text, 5000)')} as shown, {d.length('text')} as n_chars from {{documents}}"


def s17(d: Spark) -> str:
    return f"select source, max({d.length('text')}) as longest, max_by(doc_id, struct_pack(n := {d.length('text')}, d := -doc_id)) as doc_id from {{documents}} group by source" if d.name == "duckdb" else f"select source, max({d.length('text')}) as longest, max_by(doc_id, struct({d.length('text')}, -doc_id)) as doc_id from {{documents}} group by source"


def s18(d: Spark) -> str:
    return "select doc_id, case when source = 'src1' then 'src2' else source end as source from {documents}"


def s19(d: Spark) -> str:
    """Documents whose normalised text stands in the corpus under a smaller id of the same source."""
    h = d.sha256(folded(d, "text"))
    return f"select a.doc_id as doc_id, b.first_id as first_id from (select doc_id, source, {h} as h from {{documents}}) a join (select source, {h} as h, min(doc_id) as first_id from {{documents}} group by source, {h}) b on a.h = b.h and coalesce(a.source, '') = coalesce(b.source, '') where a.doc_id > b.first_id"


def s20(d: Spark) -> str:
    """Length-band candidates: per benchmark passage how many documents are within 5 % of its length. Documents are counted by length
    first, so that the range join meets as many rows as there are lengths, whatever the corpus."""
    return f"select b.item_id as item_id, cast(sum(c.docs) as bigint) as candidates from {{benchmark}} b join (select {d.length('text')} as size, count(*) as docs from {{documents}} where text is not null group by {d.length('text')}) c on c.size between 0.95 * {d.length('b.text')} and 1.05 * {d.length('b.text')} group by b.item_id"


def s21(d: Spark) -> str:
    return "select source, lang, count(*) as same from {documents} group by source, lang"


def s22(d: Spark, lang: str | None = "en", source: str | None = None, least: int | None = 1000) -> str:
    """A listing whose predicates are optional: those that aren't given fall away."""
    given = [f"lang = {d.lit(lang)}" if lang else "", f"source = {d.lit(source)}" if source else "", f"n_chars > {least}" if least is not None else ""]
    return "select doc_id, source, n_chars from {documents} where source is not null" + "".join(f" and {g}" for g in given if g)


def s23(d: Spark) -> str:
    """Parents with their children in order."""
    if d.name == "spark":
        return "select conv_id, array_join(transform(sort_array(collect_list(struct(turn, role))), x -> x.role), '>') as roles, count(*) as turns from {conversations} group by conv_id"
    return "select conv_id, string_agg(role, '>' order by turn) as roles, count(*) as turns from {conversations} group by conv_id"


def s24(d: Spark) -> str:
    """Sections of a configuration: each has a default; the latest event of its kind overwrites it."""
    last = f"select event_type, {'max_by(props, struct(ts, event_id))' if d.name == 'spark' else 'max_by(props, struct_pack(t := ts, e := event_id))'} as props from {{events}} where ts >= {AS_OF} - {_days(d, 1)} group by event_type"
    return f"select s.section as section, coalesce({_json(d, 'o.props', 'k')}, '0') as config, o.props is null as is_default from (select distinct event_type as section from {{events}} union all select 'unset' as section) s left join ({last}) o on s.section = o.event_type"


def s25(d: Spark) -> str:
    """Settings of one row: fields of a fixed list are set by the latest event of each, others are ignored, the rest stay."""
    fields = ("click", "view", "purchase")
    value = lambda f: f"coalesce(max_by(case when event_type = '{f}' then {_json(d, 'props', 'k')} end, case when event_type = '{f}' then event_id end), 'default') as set_{f}"
    return f"select 1 as id, {', '.join(map(value, fields))} from {{events}}"


def s26(d: Spark) -> str:
    """Snapshots, the newest first: here days of events."""
    day = "cast(date_trunc('day', ts) as date)"
    return f"select {_ts(day)} as snapshot, count(*) as n, max(event_id) as last_event from {{events}} group by {day} order by snapshot desc"


def s27(d: Spark) -> str:
    return f"select event_id, user_id from {{events}} where ts >= {AS_OF} - {_days(d, 2)}"


def s28(d: Spark) -> str:
    return "select d.source as source, count(*) as docs, sum(case when l.doc_id is not null then 1 else 0 end) as labelled, max(n_chars) as longest from {documents} d left join {labels} l on d.doc_id = l.doc_id group by d.source"


# --- T: text primitives ---
def t_counts(d: Spark) -> str:
    steps = D.base(d) | {"letters": d.size(d.extract("text", "[a-zA-Z]+")), "s7": d.size(d.filter("s0", "z_q", f"{d.strip('z_q')} <> ''")), "marks": d.size(d.filter(d.split("text", "[.!?]+"), "z_q", f"{d.strip('z_q')} <> ''"))}
    steps |= {"np": d.size("paras"), "npb": d.size("pa")}
    return D.statement(d, steps, {"t1_alpha": "n", "t2_word": "nu", "t3_letters": "letters", "t4_space": "nws", "t5_scoring": "n5", "t6_long": "n6", "t7_nonblank": "s7", "t8_marks": "marks", "t9_blank_line": "np", "t9_newlines": "npb"}, "{documents}")


def t05(d: Spark) -> str:
    return S.rows(d, "{documents}") + " select doc_id, cast(place as bigint) as place, sentence from z_rows"


def t11(d: Spark) -> str:
    """Chunks of 300 words; the tail joins the last."""
    steps = D.base(d) | {"k": "cast(floor(nws / 300.0) as bigint)", "z_ch": d.map(d.seq("k"), "z_i", d.join(d.slice("ws", "300 * (z_i - 1) + 1", "case when z_i = k then nws - 300 * (k - 1) else 300 end"), " "))}
    rows = D.layered(d, D.needed(steps, "z_ch nws"), "{documents}", "doc_id, text", "text is not null")
    return f"{rows}, z_x as ({d.explode('(select * from z_end where nws >= 900) z_y', 'doc_id', 'z_ch', 'chunk', 'place')}) select doc_id, cast(place as bigint) as place, {d.size(d.extract('chunk', '[^' + chr(92) + 's]+'))} as words, {d.sha256('chunk')} as digest from z_x"


def t13(d: Spark) -> str:
    return D.statement(d, D.readability_steps(d), {"syllables": "cast(syllables as bigint)", "grade": "round(cast(grade as double), 6)", "ease": "round(cast(ease as double), 6)"}, "{documents}")


def t15(d: Spark) -> str:
    """Text as the language model sees it: no code, addresses or mail; lower case, ASCII, single spaces."""
    x = d.replace("text", r"(?s)```.*?```", " ")
    x = d.replace(d.replace(x, r"https?://[^\s]+|www\.[^\s]+", " "), r"[^\s]+@[^\s]+\.[^\s]+", " ")
    return f"select doc_id, {d.sha256(d.strip(d.replace(d.replace(f'lower({x})', r'[^\x00-\x7F]', ' '), r'\s+', ' ')))} as digest from {{documents}}"


def t16(d: Spark) -> str:
    return f"select doc_id, {d.sha256(folded(d, 'text'))} as content_hash from {{documents}}"


#: How answers begin that aren't part of a text.
BOILERPLATE = ("Sure", "Here", "Abstract", "Title", "I'm happy to help", "Certainly")


def t18(d: Spark) -> str:
    """A text as the chunk classifier sees it: without a first line that is boilerplate; lower case, single spaces."""
    lines = d.filter(d.split("text", "\n"), "z_q", f"{d.strip('z_q')} <> ''")
    steps = {"z_li": lines, "z_fi": d.replace(f"coalesce({d.at('z_li', '1')}, '')", "^[^a-zA-Z0-9]*", ""), "z_cut": "(" + " or ".join(d.starts("z_fi", b) for b in BOILERPLATE) + f") and {d.size('z_li')} > 1"}
    steps["z_tx"] = f"case when z_cut then {d.join(d.slice('z_li', '2', d.size('z_li')), chr(10))} else text end"
    return D.layered(d, steps, "{documents}", "doc_id, text", "text is not null") + f" select doc_id, z_cut as stripped, {d.sha256(normal(d, 'z_tx'))} as digest from z_end"


def t19(d: Spark) -> str:
    steps = D.base(d)
    for k in (2, 3, 4, 5, 6):
        steps |= {f"g{k}": d.size(d.distinct(d.map(d.seq(f"nu - {k - 1}"), "z_i", d.join(d.slice("u", "z_i", str(k)), " "))))}
    return D.statement(d, steps, {f"types_{k}": f"g{k}" for k in (2, 3, 4, 5, 6)}, "{documents}")


# --- L: language-model signals ---
def l03(d: Spark) -> str:
    grams = lambda k: d.map(d.seq(f"n - {k - 1}"), "z_i", d.join(d.slice("w", "z_i", str(k)), " "))
    steps: dict[str, str] = {}
    for k, name in ((2, "b"), (3, "t")):
        own = {f"{name}_g": grams(k), f"{name}_n": f"greatest(n - {k - 1}, 0)"}
        own |= {f"{name}_{x}": e.replace("z_sorted", f"{name}_z_sorted").replace("z_begin", f"{name}_z_begin").replace("z_types", f"{name}_z_types") for x, e in D.word_counts(d, f"{name}_g", f"{name}_n").items()}
        own |= {f"{name}_share": f"{d.size(d.filter(f'{name}_c', 'z_c', 'z_c > 1'))} / cast(nullif({name}_z_types, 0) as double)"}
        steps |= own
    steps |= {"density": "0.4 * b_share + 0.6 * t_share", "score": "cast(case when n < 30 then 0 when density > 0.25 then 60 when density > 0.15 then 40 when density > 0.08 then 20 else 0 end as double)"}
    return D.statement(d, steps, {"density": "round(cast(density as double), 6)", "score": "score"}, "{documents}")


def trigrams(d: Spark) -> str:
    """CTEs: z_w3 (doc_id, sentence place, trigram), z_lm (trigram, logprob) over the whole corpus, z_floor."""
    cleaned = d.replace(d.replace("lower(sentence)", r"[^\x00-\x7F]", " "), r"\s+", " ")
    steps = {"z_cw": d.extract(cleaned, "[a-z']+"), "z_cn": d.size("z_cw"), "z_t3": d.map(d.seq("z_cn - 2"), "z_i", d.join(d.slice("z_cw", "z_i", "3"), " "))}
    chain, at = D.chained(steps, "z_rows", "z_l")
    return S.rows(d, "{documents}") + f"""{chain}, z_w3 as ({d.explode(at, "doc_id, place, z_cn", "z_t3", "tri", "at3")}),
      z_count as (select tri, count(*) as c from z_w3 group by tri), z_kept as (select * from z_count where c >= 2),
      z_sum as (select sum(c) as total, count(*) as types from z_kept),
      z_lm as (select k.tri as tri, ln((k.c + 1) / cast(s.total + s.types + 1 as double)) as lp from z_kept k join z_sum s on s.types > 0)"""


def l10(d: Spark) -> str:
    return trigrams(d) + " select tri, round(lp, 6) as logprob from z_lm"


def perplexity(d: Spark) -> str:
    return trigrams(d) + """, z_floor as (select ln(1 / cast(total + types + 1 as double)) as f from z_sum),
      z_hit as (select w.doc_id as doc_id, w.place as place, w.z_cn as z_cn, m.lp as lp, z.f as f from z_w3 w left join z_lm m on w.tri = m.tri join z_floor z on true),
      z_all as (select doc_id, place, case when sum(case when lp is null then 1 else 0 end) > 0.6 * count(*) then null else exp(-avg(coalesce(lp, f))) end as ppl from z_hit where z_cn >= 5 group by doc_id, place), z_ppl as (select * from z_all where ppl is not null)"""


def l05(d: Spark) -> str:
    """Every document has a row; without a sentence that can be judged the score is 0."""
    mean_ppl = "m.mean_ppl"
    return perplexity(d) + f", z_doc as (select doc_id, avg(ppl) as mean_ppl from z_ppl group by doc_id) select t.doc_id as doc_id, round({mean_ppl}, 4) as mean_ppl, cast(case when {mean_ppl} < 800 then 60 when {mean_ppl} < 1500 then 40 when {mean_ppl} < 2500 then 20 else 0 end as double) as score from {{documents}} t left join z_doc m on t.doc_id = m.doc_id"


def l06(d: Spark) -> str:
    cv = "stddev_pop(ppl) / nullif(avg(ppl), 0)"
    return perplexity(d) + f", z_doc as (select doc_id, {cv} as cv, count(*) as k from z_ppl group by doc_id) select t.doc_id as doc_id, round(m.cv, 6) as cv, cast(case when coalesce(k, 0) < 5 then 0 when cv < 0.2 then 60 when cv < 0.35 then 40 when cv < 0.5 then 20 else 0 end as double) as score from {{documents}} t left join z_doc m on t.doc_id = m.doc_id"


def l07(d: Spark) -> str:
    f = f"ln({d.at('fc', 'z_i')})"
    tail = d.filter(d.seq("z_types"), "z_i", "z_i > 2 * z_types / 3.0")
    steps = D.zipf_steps(d) | {"z_res": d.map(tail, "z_i", f"{f} - (my - alpha * (ln(z_i) - mx))"), "z_rn": d.size("z_res"), "z_rm": mean(d, "z_res", "z_rn"), "rsd": f"sqrt({spread(d, 'z_res', 'z_rn', 'z_rm')})"}
    steps |= {"score": "cast(case when n < 100 or z_types < 10 then 0 when r2 > 0.95 and rsd < 0.25 then 60 when r2 > 0.92 and rsd < 0.35 then 40 when r2 > 0.88 and rsd < 0.45 then 20 else 0 end as double)"}
    return D.statement(d, steps, {"score": "score", "r2": "round(cast(r2 as double), 6)"}, "{documents}")


def l08(d: Spark) -> str:
    """Distance of a text's MATTR from the baseline of its genre."""
    of = lambda k: "cast(case genre " + " ".join(f"when '{g}' then {v[k]}" for g, v in GENRE_RICHNESS.items()) + f" else {GENRE_RICHNESS['general'][k]} end as double)"
    steps = D.genre_steps(d) | D.mattr_steps(d) | {"z_gm": of(0), "z_gb": of(1), "z": "abs(mattr - z_gm) / z_gb", "sd": "sqrt(mattr_var)"}
    steps |= {"score": "cast(case when n < 70 then 0 when z < 0.3 and sd < 0.7 * z_gb then 50 when z < 0.5 and sd < 0.85 * z_gb then 30 when z < 0.8 and sd < z_gb then 15 else 0 end as double)"}
    return D.statement(d, steps, {"score": "score", "genre": "genre", "mattr": "round(cast(mattr as double), 6)"}, "{documents}")


def l09(d: Spark) -> str:
    steps = {"k": "cast(floor(n / 100.0) as bigint)", "z_t": d.map(d.seq("k"), "z_i", f"{d.size(d.distinct(d.slice('w', '100 * (z_i - 1) + 1', '100')))} / cast(100 as double)"), "m": mean(d, "z_t", "k"), "v": spread(d, "z_t", "k", "m"), "cv": "sqrt(v) / nullif(m, 0)"}
    steps |= {"score": "cast(case when n < 200 then 0 when v < 0.001 and cv < 0.03 then 60 when v < 0.002 and cv < 0.05 then 40 when v < 0.004 and cv < 0.08 then 20 else 0 end as double)"}
    return D.statement(d, steps, {"score": "score"}, "{documents}")


def l11(d: Spark) -> str:
    """Baselines of a genre (here a language): mean and deviation over all windows of 50 words and all chunks of 100 words of its
    documents; windows don't reach from one document into the next. Moments are summed by document first."""
    chunk = f"{d.size(d.distinct(d.slice('w', '100 * (z_i - 1) + 1', '100')))} / cast(100 as double)"
    steps = D.mattr_steps(d) | {"z_k": "cast(floor(n / 100.0) as bigint)", "z_tt": d.map(d.seq("z_k"), "z_i", chunk), "z_s": d.total("z_tt"), "z_ss": d.total(d.map("z_tt", "z_x", "z_x * z_x"))}
    inner = D.statement(d, steps, {"n": "n", "k": "windows", "s": "coalesce(mattr, 0) * windows", "ss": "(coalesce(mattr_var, 0) + coalesce(mattr, 0) * coalesce(mattr, 0)) * windows", "k2": "z_k", "s2": "z_s", "ss2": "z_ss"}, "{documents}")
    m, m2 = "sum(s) / nullif(sum(k), 0)", "sum(s2) / nullif(sum(k2), 0)"
    sd = lambda ss, k, mean: f"round(sqrt(greatest(0, sum({ss}) / nullif(sum({k}), 0) - ({mean}) * ({mean}))), 6)"
    return f"select lang, round({m}, 6) as mattr_mean, {sd('ss', 'k', m)} as mattr_std, round({m2}, 6) as ttr_mean, {sd('ss2', 'k2', m2)} as ttr_std from ({inner}) x join {{documents}} d on x.doc_id = d.doc_id group by lang having sum(n) >= 100"


def h42(d: Spark) -> str:
    """Mean pairwise cosine of a document's sentences under TF-IDF, by the closed form over sums of unit vectors: no pairs."""
    steps = {"z_sw": d.extract("lower(sentence)", r"[\p{L}\p{N}_]+")}
    chain, at = D.chained(steps, "z_rows", "z_m")
    return S.rows(d, "{documents}") + f"""{chain}, z_tok as ({d.explode(at, "doc_id, place", "z_sw", "tok", "at_w")}),
      z_tf as (select doc_id, place, tok, count(*) as tf from z_tok group by doc_id, place, tok), z_df as (select doc_id, tok, count(*) as df from z_tf group by doc_id, tok),
      z_n as (select doc_id, count(*) as n from z_rows group by doc_id),
      z_wt as (select t.doc_id as doc_id, t.place as place, t.tok as tok, t.tf * (ln((n.n + 1) / cast(f.df + 1 as double)) + 1) as wt, n.n as n from z_tf t join z_df f on t.doc_id = f.doc_id and t.tok = f.tok join z_n n on t.doc_id = n.doc_id),
      z_norm as (select doc_id, place, sqrt(sum(wt * wt)) as norm from z_wt group by doc_id, place),
      z_unit as (select w.doc_id as doc_id, w.tok as tok, sum(w.wt / m.norm) as u, max(w.n) as n from z_wt w join z_norm m on w.doc_id = m.doc_id and w.place = m.place group by w.doc_id, w.tok),
      z_some as (select doc_id, count(*) as k from z_norm group by doc_id),
      z_sim as (select u.doc_id as doc_id, (sum(u.u * u.u) - max(s.k)) / cast(nullif(max(u.n) * (max(u.n) - 1), 0) as double) as sim, max(u.n) as n from z_unit u join z_some s on u.doc_id = s.doc_id group by u.doc_id)
      select t.doc_id as doc_id, round(case when n >= 4 then sim end, 6) as similarity, cast(case when n >= 4 and sim > 0.12 then round((sim - 0.12) / 0.88 * 40) else 0 end as double) as score from {{documents}} t left join z_sim m on t.doc_id = m.doc_id"""


def chunk_rows(d: Spark) -> str:
    """(doc_id, text): chunks of about 300 words of texts that have at least three, under ids of their own."""
    steps = D.base(d) | {"k": "cast(floor(nws / 300.0) as bigint)", "z_ch": d.map(d.seq("k"), "z_i", d.join(d.slice("ws", "300 * (z_i - 1) + 1", "case when z_i = k then nws - 300 * (k - 1) else 300 end"), " "))}
    rows = D.layered(d, D.needed(steps, "z_ch nws"), "{documents}", "doc_id, text", "text is not null")
    return f"{rows}, z_x as ({d.explode('(select * from z_end where nws >= 900) z_y', 'doc_id', 'z_ch', 'chunk', 'place')}) select concat(cast(doc_id as varchar(20)), ':', cast(place as varchar(20))) as doc_id, chunk as text from z_x"


def chunk_spread(d: Spark, scored: str) -> str:
    """H43 from the whole scores of chunks: those that score high and alike are suspicious."""
    by = f"cast({d.at(d.split('doc_id', ':'), '1')} as bigint)"
    cv = "stddev_pop(overall_score) / nullif(avg(overall_score), 0)"
    return f"select t.doc_id as doc_id, round(m.cv, 6) as cv, coalesce(m.chunks, 0) as chunks, cast(case when cv < 0.25 and mean >= 25 then least(35, {d.half_even('(1 - cv / 0.25) * 35', 0)}) else 0 end as double) as score from {{documents}} t left join (select {by} as doc_id, {cv} as cv, avg(overall_score) as mean, count(*) as chunks from {scored} z_a group by {by}) m on t.doc_id = m.doc_id"


def h43(d: Spark) -> str:
    return chunk_spread(d, f"({S.analysis(d, f'({chunk_rows(d)}) z_chunks')})")


# --- N, P: vectors and pairs ---
def n02(d: Spark) -> str:
    """Cosine of each vector with the first of its label (the one with the smallest id)."""
    if d.name == "spark":
        dot = "aggregate(zip_with(a.embedding, b.embedding, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"
        norm = lambda v: f"sqrt(aggregate({v}.embedding, 0D, (s, x) -> s + cast(x as double) * x))"
    else:
        dot = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]))"
        norm = lambda v: f"sqrt(list_sum(list_transform({v}.embedding, lambda x: x::DOUBLE * x)))"
    return f"select a.vec_id as vec_id, round({dot} / nullif({norm('a')} * {norm('b')}, 0), 6) as cosine from {{embeddings}} a join (select label, min_by(embedding, vec_id) as embedding from {{embeddings}} group by label) b on a.label = b.label"


def p01(d: Spark) -> str:
    h = d.sha256(folded(d, "text"))
    return f"select {h} as content_hash, source, count(*) as copies, min(doc_id) as first_id from {{documents}} group by source, {h} having count(*) > 1"


def overlap(d: Spark) -> str:
    """CTEs: z_pair (doc_id, item_id, shared) for documents and passages that share a word trigram, joined on trigrams."""
    doc = D.layered(d, {"z_u": words(d), "z_k": d.size("z_u"), "z_g": d.distinct(d.map(d.seq("z_k - 2"), "z_i", d.join(d.slice("z_u", "z_i", "3"), " "))), "z_gn": d.size("z_g")}, "{documents}", "doc_id, text")
    item = D.layered(d, {"z_u": words(d), "z_k": d.size("z_u"), "z_g": d.distinct(d.map(d.seq("z_k - 2"), "z_i", d.join(d.slice("z_u", "z_i", "3"), " "))), "z_gn": d.size("z_g")}, "{benchmark}", "item_id, text")
    return f"with z_a as ({doc} {d.explode('z_end', 'doc_id, z_gn', 'z_g', 'gram', 'at_g')}), z_b as ({item} {d.explode('z_end', 'item_id, z_gn', 'z_g', 'gram', 'at_g')}), z_pair as (select a.doc_id as doc_id, b.item_id as item_id, count(*) as shared, max(a.z_gn) as n_doc, max(b.z_gn) as n_item from z_a a join z_b b on a.gram = b.gram group by a.doc_id, b.item_id)"


def contained(d: Spark) -> str:
    """How much of a passage's word trigrams stands in a document."""
    return overlap(d) + " select doc_id, item_id, round(shared / cast(n_item as double), 4) as overlap, case when shared / cast(n_item as double) > 0.7 then 'high' when shared / cast(n_item as double) > 0.4 then 'moderate' else 'low' end as level from z_pair"


def n04(d: Spark) -> str:
    x = "1 - shared / cast(n_doc + n_item - shared as double)"
    return overlap(d) + f" select doc_id, item_id, round({x}, 4) as divergence, case when {x} < 0.15 then 'low' when {x} <= 0.35 then 'moderate' else 'high' end as level from z_pair"


# --- E: evaluation against labels ---
#: Only documents with a label are scored.
LABELLED = "(select doc_id, text from {documents} where doc_id in (select doc_id from {labels})) z_labelled"


def scored(d: Spark) -> str:
    return f"with z_s as ({S.units(d, LABELLED, 'doc_id')} select doc_id, overall from z_units), z_x as (select l.doc_id as doc_id, l.quality as label, s.overall as score from {{labels}} l join z_s s on l.doc_id = s.doc_id)"


def e01(d: Spark) -> str:
    """Least, mean, greatest and upper median by label, over scores to one digit: these are counted first, so that what is ordered
    are at most 1,001 scores of a label, whatever the corpus."""
    return scored(d) + f""", z_cnt as (select label, cast(score as decimal(6, 1)) as score, count(*) as k from (select label, {d.half_even('cast(score as double)', 1)} as score from z_x) y group by label, cast(score as decimal(6, 1))),
      z_o as (select *, sum(k) over (partition by label order by score rows unbounded preceding) as upto, sum(k) over (partition by label) as z_n from z_cnt)
      select label, cast(min(score) as double) as least, round(cast(sum(score * k) as double) / sum(k), 6) as mean, cast(max(score) as double) as most, cast(min(case when upto >= floor(z_n / 2.0) + 1 then score end) as double) as median from z_o group by label"""


def e02(d: Spark) -> str:
    """How far each sentence score separates the labels: means and firing rates; sums are exact decimals."""
    names = ["d1_buzzwords", "d3_hedges", "d4_transitions", "d5_structure", "d6_dual_adjectives", "d7_trailing", "d8_declarations", "d9_dichotomies", "d10_expositions", "d11_phrases", "d12_fingerprint", "d13_sentence"]
    doc = S.statement(d, names, LABELLED) + f" select doc_id, {', '.join(f'max({n}) as {n}' for n in names)} from z_scored group by doc_id"
    each = ("array(" if d.name == "spark" else "[") + ", ".join(f"cast({n} as decimal(18, 4))" for n in names) + (")" if d.name == "spark" else "]")
    mean = lambda k: f"coalesce(cast(sum(case when label = {k} then score end) as double) / nullif(sum(case when label = {k} then 1 else 0 end), 0), 0)"
    rate = lambda k: f"sum(case when label = {k} and score > 0 then 1 else 0 end) / cast(nullif(sum(case when label = {k} then 1 else 0 end), 0) as double)"
    return f"with z_s as ({doc}), z_l as (select l.doc_id as doc_id, l.quality as label, {each} as z_scores from {{labels}} l join z_s s on l.doc_id = s.doc_id), z_t as ({d.explode('z_l', 'doc_id, label', 'z_scores', 'score', 'place')}) select {d.at(d.arr(names), 'place')} as signal, round({mean(1)}, 6) as mean_good, round({mean(0)}, 6) as mean_bad, round({mean(1)} - {mean(0)}, 6) as difference, round({rate(1)}, 6) as firing_good, round({rate(0)}, 6) as firing_bad from z_t group by place"


def e03(d: Spark) -> str:
    """Confusion at each threshold from 15 to 50 (E3, E4), and which is the first of the most accurate; low quality is looked for."""
    steps = "explode(sequence(15, 50, 5))" if d.name == "spark" else "unnest(range(15, 51, 5))"
    ratio = lambda a, b: f"coalesce(({a}) / cast(nullif({b}, 0) as double), 0)"
    return scored(d) + f""", z_t as (select {steps} as threshold), z_c as (select cast(t.threshold as bigint) as threshold, sum(case when score >= t.threshold and label = 0 then 1 else 0 end) as tp, sum(case when score >= t.threshold and label = 1 then 1 else 0 end) as fp, sum(case when score < t.threshold and label = 1 then 1 else 0 end) as tn, sum(case when score < t.threshold and label = 0 then 1 else 0 end) as fn from z_x join z_t t on true group by t.threshold)
      select threshold, tp, fp, tn, fn, round((tp + tn) / cast(tp + fp + tn + fn as double), 6) as accuracy, round({ratio('tp', 'tp + fp')}, 6) as precision, round({ratio('tp', 'tp + fn')}, 6) as recall, round({ratio('2.0 * tp', '2 * tp + fp + fn')}, 6) as f1, row_number() over (order by tp + tn desc, threshold) = 1 as best from z_c"""


def e11(d: Spark) -> str:
    """Variants of blending an outside score (here from the labels) with the heuristic one, each judged at 40; the best by F1."""
    outside = "case when doc_id % 3 = 0 then 50.0 else 100.0 * (1 - label) end"
    blends = {"a": f"0.6 * {outside} + 0.4 * score", "b": outside, "c": outside, "d": f"0.55 * {outside} + 0.45 * score"}
    each = " union all ".join(f"select '{n}' as variant, label, {e} as blended from z_x" for n, e in blends.items())
    return scored(d) + f", z_v as ({each}), z_c as (select variant, sum(case when blended >= 40 and label = 0 then 1 else 0 end) as tp, sum(case when blended >= 40 and label = 1 then 1 else 0 end) as fp, sum(case when blended < 40 and label = 0 then 1 else 0 end) as fn from z_v group by variant) select variant, tp, fp, fn, round(2.0 * tp / cast(greatest(1, 2 * tp + fp + fn) as double), 6) as f1, row_number() over (order by 2.0 * tp / cast(greatest(1, 2 * tp + fp + fn) as double) desc, variant) = 1 as best from z_c"


#: Candidates of a search over weights: each scales a third of the weights by a half and a third by one and a half.
CANDIDATES = 6


def signals(d: Spark, labelled: bool = True) -> str:
    """CTEs ending in z_sig (doc_id, label, place, signal, score): what a re-scoring needs, worked out once."""
    table, label = (LABELLED, "join {labels} l on e.doc_id = l.doc_id") if labelled else ("{documents}", "join (select 0 as quality) l on true")
    steps, names = S.signal_steps(d)
    each = ("array(" if d.name == "spark" else "[") + ", ".join(f"{n}__score" for n in names) + (")" if d.name == "spark" else "]")
    doc = D.layered(d, D.needed(D.base(d) | steps | {"z_all": each}, "z_all"), table, "doc_id, text", f"text is not null and {d.strip('text')} <> ''")
    return f"{doc}, z_ex as ({d.explode('z_end', 'doc_id', 'z_all', 'score', 'place')}), z_sig as (select e.doc_id as doc_id, l.quality as label, e.place as place, {d.at(d.arr(names), 'place')} as signal, cast(e.score as decimal(18, 6)) as score from z_ex e {label})"


def e09(d: Spark) -> str:
    return signals(d) + " select doc_id, signal, round(cast(score as double), 4) as score from z_sig where score > 0"


def c11(d: Spark) -> str:
    """C11: how severe a document's signals are."""
    return signals(d, False) + " select doc_id, signal, round(cast(score as double), 4) as score, case when score >= 60 then 'high' when score >= 30 then 'medium' else 'low' end as severity from z_sig where score > 0"


SCALE = "cast(case when candidate = 0 then 1.0 when (place + candidate) % 3 = 0 then 0.5 when (place * candidate + candidate) % 3 = 1 then 1.5 else 1.0 end as decimal(4, 2))"


def rescored(d: Spark) -> str:
    """E5: CTEs ending in z_re (candidate, doc_id, label, score): C1 again under each candidate's weights."""
    ids = "explode(sequence(0, {0}))" if d.name == "spark" else "unnest(range(0, {0} + 1))"
    names = S.signal_steps(d)[1]
    weight = f"cast({d.at('[' + ', '.join(str(S.weight_of(n)) for n in names) + ']' if d.name == 'duckdb' else 'array(' + ', '.join(str(S.weight_of(n)) for n in names) + ')', 'place')} as decimal(6, 3))"
    scale = SCALE
    on = "cast(case when score > 0 then 1 else 0 end as bigint)"
    sums = f"sum(w * score) as ws, sum(case when score > 0 then w else 0 end) as w, sum({on} * case when w0 >= 0.3 then 1 else 0 end) as z_some, sum({on} * case when w0 >= 0.7 then 1 else 0 end) as strong, sum(case when score > 0 and w0 >= 0.7 then score else 0 end) as strong_sum"
    value = "least(100, coalesce(cast(ws as double) / nullif(cast(w as double), 0), 0) + least(15, 3 * greatest(0, z_some - 2)) + case when strong >= 3 and cast(strong_sum as double) / strong > 30 then 5 else 0 end)"
    return f"{signals(d)}, z_cand as (select {ids.format(CANDIDATES)} as candidate), z_w as (select candidate, doc_id, label, score, {weight} as w0, {weight} * {scale} as w from z_sig s join z_cand c on true), z_sum as (select candidate, doc_id, label, {sums} from z_w group by candidate, doc_id, label), z_re as (select candidate, doc_id, label, {value} as score from z_sum)"


def e05(d: Spark) -> str:
    return rescored(d) + " select cast(candidate as bigint) as candidate, doc_id, round(score, 4) as score from z_re"


def e07(d: Spark) -> str:
    """A random search: each candidate's separation of the labels, the best one marked; all are judged in one pass."""
    sep = "cast(sum(case when label = 0 then cast(score as decimal(18, 6)) end) as double) / nullif(sum(case when label = 0 then 1 else 0 end), 0) - cast(sum(case when label = 1 then cast(score as decimal(18, 6)) end) as double) / nullif(sum(case when label = 1 then 1 else 0 end), 0)"
    return rescored(d) + f", z_sep as (select cast(candidate as bigint) as candidate, round({sep}, 4) as separation from z_re group by candidate) select candidate, separation, row_number() over (order by separation desc, candidate) = 1 as best from z_sep"


def e06(d: Spark) -> str:
    """Separation of the labels, and squared loss to 10 and 80."""
    return scored(d) + " select round(avg(case when label = 0 then score end) - avg(case when label = 1 then score end), 6) as separation, round(avg(case when label = 1 then (score - 10) * (score - 10) else (score - 80) * (score - 80) end), 6) as loss from z_x"


def c12(d: Spark) -> str:
    """Blends of a heuristic score with an outside one (here from the labels) and a classifier's (here missing for
    even ids), and the gauge's bands."""
    outside, third = "100.0 * (1 - label)", "case when doc_id % 2 = 1 then 50.0 end"
    blend = f"case when {third} is null then 0.6 * {outside} + 0.4 * score else 0.35 * {outside} + 0.35 * score + 0.30 * {third} end"
    return scored(d) + f", z_b as (select doc_id, cast({d.half_even(f'cast({blend} as double)', 1)} as double) as blended from z_x) select doc_id, blended, case when blended <= 20 then 'clean' when blended >= 40 then 'written' else 'touched' end as band from z_b"


def e12(d: Spark) -> str:
    """A stratified subset by a seeded hash: a sample is the feature here."""
    return "select doc_id, quality from (select doc_id, quality, row_number() over (partition by quality order by md5(cast(doc_id + 42 as varchar(20))), doc_id) as place from {labels}) x where place <= 20"


def e13(d: Spark) -> str:
    """Weights before and after the search, by signal."""
    head, _, _ = e07(d).rpartition(" select candidate, separation")
    names = " union all ".join(f"select {d.lit(n)} as signal, cast({S.weight_of(n)} as decimal(6, 3)) as old_weight, {k + 1} as place" for k, n in enumerate(S.SCORED))
    return f"{head}, z_top as (select candidate from (select candidate, row_number() over (order by separation desc, candidate) as z_k from z_sep) y where z_k = 1), z_was as ({names}) select signal, cast(old_weight as double) as old_weight, cast(old_weight * {SCALE} as double) as new_weight, cast(old_weight * {SCALE} - old_weight as double) as delta from z_was join z_top on true"


# --- R, V: deterministic rewriting and compliance ---
#: Plainer words, in order; openings that say nothing; words and constructions that don't comply.
REPLACED = {"utilize": "use", "leverage": "use", "facilitate": "help", "implement": "build", "robust": "strong", "comprehensive": "full", "furthermore": "also", "moreover": "also", "additionally": "also", "consequently": "so", "nevertheless": "still", "enhance": "improve", "optimize": "improve", "streamline": "simplify", "innovative": "new", "holistic": "complete"}
WEAK_OPENINGS = ("^It is (?:worth noting|important to note|essential to understand) that ", "^(?:In conclusion|To summarize|In summary|Overall), ", "^This (?:demonstrates|illustrates|highlights|underscores|showcases) ")
BANNED = "leverage utilize spearhead synergize operationalize revolutionize supercharge harness empower elevate amplify streamline champion evangelize pioneer robust holistic innovative cutting-edge game-changing best-in-class world-class state-of-the-art mission-critical enterprise-grade paradigm synergy".split()
STRUCTURAL = {"impersonal_construction": r"It is \w+ to \w+", "ai_conclusion": "In conclusion,?", "ai_transition": "Furthermore,?|Moreover,?|Additionally,?", "parallel_construction": "not only .+ but also"}
AVOIDED = {"em_dash_usage": "—", "semicolon_usage": ";", "passive_voice_rate": r"\b(?:is|are|was|were|been|being)\s+\w+ed\b", "ellipsis_usage": r"\.{3}|…", "parenthetical_usage": r"\([^)]{20,}\)"}


def r01(d: Spark) -> str:
    """Sentences with plainer words and without weak openings, joined by spaces; how many changed."""
    x = "z_s"
    for a, b in REPLACED.items():
        x = d.replace(x, rf"(?i)\b{a}\b", b)
    for w in WEAK_OPENINGS:
        x = d.replace(x, f"(?i){w}", "")
    steps = {"z_st": d.strip("text"), "z_old": d.after_stop("z_st"), "z_new": d.map("z_old", "z_s", x), "z_ch": d.size(d.filter(d.seq(d.size("z_old")), "z_i", f"{d.at('z_old', 'z_i')} <> {d.at('z_new', 'z_i')}"))}
    return D.layered(d, steps, "{documents}", "doc_id, text", "text is not null") + f" select doc_id, {d.sha256(d.join('z_new', ' '))} as digest, z_ch as changes from z_end"


def _found(d: Spark, patterns: dict[str, str]) -> dict[str, str]:
    return {n: f"cast({d.like('text', f'(?i){p}')} as bigint)" for n, p in patterns.items()}


def v02(d: Spark) -> str:
    """V1 without a profile: banned words and constructions."""
    banned = " + ".join(_found(d, {w: rf"\b{w}\b" for w in BANNED}).values())
    return f"select doc_id, banned_words, {', '.join(STRUCTURAL)}, banned_words + {' + '.join(STRUCTURAL)} as violations, banned_words + {' + '.join(STRUCTURAL)} = 0 as compliant from (select doc_id, {banned} as banned_words, {', '.join(f'{e} as {n}' for n, e in _found(d, STRUCTURAL).items())} from {{documents}}) x"


def v03(d: Spark) -> str:
    """V1 with the profile of the document's source: elements to be avoided (less, weight over 0.6) and constructions."""
    found = _found(d, AVOIDED)
    less = f"z_less as (select source, {', '.join(f'max(case when element = {d.lit(n)} then 1 else 0 end) as l_{n}' for n in AVOIDED)} from z_prof where direction = 'less' and weight > 0.6 group by source)"
    each = ", ".join(f"{e} * coalesce(l_{n}, 0) as {n}" for n, e in found.items())
    names = [*AVOIDED, *STRUCTURAL]
    return P.profiles(d) + f", {less}, z_v as (select doc_id, {each}, {', '.join(f'{e} as {n}' for n, e in _found(d, STRUCTURAL).items())} from {{documents}} t left join z_less l on t.source = l.source) select doc_id, {', '.join(names)}, {' + '.join(names)} as violations, {' + '.join(names)} = 0 as compliant from z_v"


# --- K: consolidation, over conversation turns as observations ---
def k01(d: Spark) -> str:
    """Observations of a profile (turns of a conversation) flattened in order and normalised (T17); empty ones drop out."""
    text = normal(d, "text")
    return f"select conv_id, row_number() over (partition by conv_id order by turn) as seq, role, {d.sha256(text)} as prompt, {d.length(text)} as size from {{conversations}} where text is not null and {text} <> ''"


QUERIES = {
    "s01_point_lookup": s01, "s02_conjunction": s02, "s03_newest": s03, "s04_case_rank": s04, "s05_totals": s05, "s06_distinct": s06, "s07_scalar_subquery": s07, "s08_exists": s08, "s09_json_path": s09, "s10_retention": s10,
    "s11_interval_purge": s11, "s12_cascade_delete": s12, "s13_update_from": s13, "s14_upsert": s14, "s15_insert_new": s15, "s16_preview": s16, "s17_longest": s17, "s18_reparent": s18, "s19_exact_duplicate": s19, "s20_length_band": s20,
    "s21_same_name": s21, "s22_optional_predicates": s22, "s23_parent_children": s23, "s24_config_sections": s24, "s25_settings": s25, "s26_snapshots": s26, "s27_history": s27, "s28_corpus_info": s28,
    "t01_token_and_sentence_counts": t_counts, "t05_sentences": t05, "t11_chunks": t11, "t13_syllables": t13, "t15_clean": t15, "t16_content_hash": t16, "t18_boilerplate": t18, "t19_ngrams": t19,
    "l03_repetition_density": l03, "l05_ngram_perplexity": l05, "l06_ngram_burstiness": l06, "l07_zipf_v2": l07, "l08_mattr_v2": l08, "l09_ttr_variance": l09, "l10_trigram_model": l10, "l11_genre_baselines": l11, "h42_semantic_monotony": h42,
    "n02_cosine": n02, "n04_divergence": n04, "p01_exact_groups": p01, "p03_exact_containment": contained, "c12_source_blending": c12, "e01_label_summary": e01, "e02_discrimination": e02, "e03_threshold_sweep": e03, "e05_rescored": e05, "e06_separation": e06, "e07_weight_search": e07, "e13_weight_report": e13, "c11_severity": c11, "e09_signals": e09, "e11_variants": e11, "e12_stratified_subset": e12,
    "r01_rewrite": r01, "v02_compliance": v02, "v03_profile_compliance": v03, "k01_consolidate": k01,
}
