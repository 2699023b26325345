"""Style profiles: measurable elements of a text, folds over a corpus, and comparison of profiles.

Elements are SQL expressions over one row (no shuffle); the tall table (doc_id, element, kind, direction, weight, value)
is the fact table that folds, convergence, similarity and completeness are grouped from. Texts under 200 words give no
profile. Elements that need a parser or a sentiment lexicon are declared in ``HOOKS`` and have no value.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from inkspan.functions.dialect import Spark, mean
from inkspan.operators import document as D
from inkspan.plans.rowwise import over

Steps = dict[str, str]

# --- fixed values: vocabulary of elements ---
ARCHAIC = "thee thou thy thine hath doth dost hast wherefore hence thence whence ere oft tis twas nay aye forsooth prithee methinks perchance mayhap verily betwixt amongst hither thither whither".split()
FUNCTION = "the of and to a in is it that for was on with as at by from or but not be this which an are were been have has had do did will would could should may might can shall must if so than no when what who how all each every both few more most other some such any only same".split()
PREPOSITIONS = "of in to for with on at by from about into through during before after above below between under over against among without within along across behind beyond toward towards upon around near".split()
INVERTED = "is are was were do did shall will would could should may might have has had let come go speak think know see hear give take make never yet thus hence now then here there so well oft".split()
OPENING_CONJUNCTIONS = "and but or so yet because nor".split()
COORDINATING = "and but or nor for yet so".split()
SUBORDINATING = "because although though while since if unless when where whereas whenever wherever until after before once provided supposing".split()
MODALS = "can could would should may might must shall".split()
DISCOURSE = "well basically essentially actually literally honestly obviously clearly frankly naturally anyway anyhow indeed certainly definitely surely simply merely".split()
HEDGING = "maybe perhaps might somewhat arguably possibly apparently relatively fairly likely unlikely probably presumably conceivably roughly approximately seemingly supposedly tends suggest suggests indicate indicates appear appears seem seems".split()
INTENSIFYING = "very really extremely absolutely totally incredibly quite rather highly particularly especially remarkably utterly thoroughly deeply profoundly enormously vastly significantly considerably exceedingly terribly awfully entirely completely".split()
TRANSITIONAL = "however therefore meanwhile furthermore moreover consequently nevertheless nonetheless additionally accordingly subsequently alternatively conversely similarly likewise otherwise hence thus instead regardless notwithstanding".split()
NOMINAL = "(tion|sion|ment|ness|ity|ence|ance)$"
PASSIVE = r"(?i)\b(was|were|been|being|is|are)\s+\w+ed\b"
QUOTED = '["“][^"”]*["”]'
FIRST = "i me my mine myself we us our ours ourselves".split()
SECOND = "you your yours yourself yourselves".split()
THIRD = "he she they them his her hers their theirs him himself herself themselves".split()
FIGURATIVE = r"(?i)\blike a\b|\bas a\b|\bas if\b|\bas though\b|'tis\b|\bseems\b|\bappears\b"
#: Written without word borders of the engine's own, which differ beside accented letters.
VOCATIVE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:(?:O|Oh|Lo|Good|Dear) [\p{L}\p{N}_]|Come,|(?:Hark|Alas|My lord|My lady)(?:$|[^\p{L}\p{N}_]))"
#: Declared elements without a value: they need a parser, a sentiment lexicon or a topic model.
HOOKS = "adjective_to_noun_ratio adverb_density verb_tense_past_ratio verb_tense_present_ratio clause_depth_avg named_entity_density sentiment_mean sentiment_variance sentiment_shift_rate topic_drift_rate topic_coherence_score vocabulary_concentration paragraph_opening_pos_entropy narrative_vs_analytical_ratio".split()
SOURCE_WORDS = 200


def base(d: Spark) -> Steps:
    """aw letter words as written, lw in lower case, ss sentences, and what several elements share."""
    per = lambda words: d.size(d.filter("lw", "z_w", d.member("z_w", words)))
    vowels = lambda x: d.size(d.extract(x, "[aeiouy]+"))
    silent = f"case when {d.ends('z_w', 'e')} and {d.length('z_w')} > 2 and not {d.like('z_w', '[aeiouy]e$')} then 1 else 0 end"
    first = lambda s: f"lower({d.at(d.extract(d.strip(s), '^[a-zA-Z]+'), '1')})"
    steps = {
        "low": "lower(text)", "t0": d.strip("text"), "aw": d.extract("text", "[a-zA-Z]+"), "lw": d.map("aw", "z_w", "lower(z_w)"), "ut": d.extract("low", r"[\p{L}\p{N}_]+"), "an": d.size("aw"),
        "ss": d.filter(d.after_stop("t0"), "z_q", f"{d.strip('z_q')} <> ''"), "sn": f"greatest(1, {d.size('ss')})",
        "pp": d.filter(d.split("t0", r"\n\s*\n"), "z_q", f"{d.strip('z_q')} <> ''"), "pn": f"greatest(1, {d.size('pp')})",
        "sl": d.map("ss", "z_s", d.size(d.extract("z_s", "[a-zA-Z']+"))), "sm": mean(d, "sl", "sn"),
        "sd": f"coalesce(sqrt({d.total(d.map('sl', 'z_l', '(z_l - sm) * (z_l - sm)'))} / nullif(sn - 1, 0)), 0)",
        "pc": d.map("pp", "z_p", d.size(d.filter(d.after_stop("z_p"), "z_q", f"{d.strip('z_q')} <> ''"))),
        "fw": d.filter(d.map("ss", "z_s", first("z_s")), "z_f", "z_f is not null and z_f <> ''"),
        "k_function": per(FUNCTION), "k_sub": per(SUBORDINATING), "commas": d.length("text") + " - " + d.length("replace(text, ',', '')"),
        "letters": d.total(d.map("aw", "z_w", d.length("z_w"))), "syl": d.total(d.map("lw", "z_w", f"greatest(1, {vowels('z_w')} - {silent})")),
        "poly": d.size(d.filter("lw", "z_w", f"greatest(1, {vowels('z_w')} - {silent}) >= 3")),
        "bigrams": d.map(d.seq("an - 1"), "z_i", f"concat({d.at('lw', 'z_i')}, ' ', {d.at('lw', 'z_i + 1')})"), "bn": "greatest(an - 1, 0)",
    }
    for name, a, n in (("w", "lw", "an"), ("f", "fw", d.size("fw")), ("b", "bigrams", "bn")):
        counts = D.word_counts(d, a, n)
        for k, e in counts.items():
            steps[f"{name}_{k}"] = re.sub(r"\b(z_sorted|z_begin|z_types)\b", lambda m, name=name: f"{name}_{m[1]}", e)
    if d.name == "spark":
        # Syllables are counted once for each distinct word, not twice for each word; sums of whole numbers are the same.
        each = d.map("w_z_begin", "z_i", d.at("w_z_sorted", "z_i"))
        steps["w_syl"] = d.map(each, "z_w", f"greatest(1, {vowels('z_w')} - {silent})")
        for name, e in (("syl", "z_n * z_k"), ("poly", "case when z_n >= 3 then z_k else 0 end")):
            steps[name] = d.total(f"zip_with(w_syl, w_c, (z_n, z_k) -> {e})")
        steps["poly"] = f"cast({steps['poly']} as bigint)"
        steps |= {k: steps.pop(k) for k in ("syl", "poly")}  # steps stand behind those that they use
    return steps


def elements(d: Spark) -> list[tuple[str, str, str, str, str | None]]:
    """(name, category, value, weight, condition of "more" or None for a metric)."""
    an, sn = "cast(nullif(an, 0) as double)", "cast(sn as double)"
    share = lambda words: f"{d.size(d.filter('lw', 'z_w', d.member('z_w', words)))} / {an}"
    sents = lambda cond: f"{d.size(d.filter('ss', 'z_s', cond))} / {sn}"
    openers = lambda words: f"{d.size(d.filter('fw', 'z_f', d.member('z_f', words)))} / {sn}"
    chars = lambda c: f"(({d.length('text')} - {d.length(f'replace(text, {d.lit(c)}, {d.lit(str())})')}) / {len(c)})"
    lens = lambda cond: f"{d.size(d.filter('sl', 'z_l', cond))} / {sn}"
    fn = f"{d.size('fw')}"
    opener = f"case when {fn} > 1 then (log2({fn}) - {d.total(d.map('f_c', 'z_c', 'z_c * log2(z_c)'))} / {fn}) / log2({fn}) else 0.0 end"
    rare = d.size(d.filter(d.seq("w_z_types"), "z_i", f"{d.at('w_c', 'z_i')} = 1 and {d.length(d.at('w_z_sorted', d.at('w_z_begin', 'z_i')))} > 8"))
    em = f"({chars('—')} + {chars('--')})"
    quoted = d.total(d.map(d.extract("text", QUOTED), "z_q", d.length("z_q")))
    out: list[tuple[str, str, str, str, str | None]] = []

    def more(name: str, category: str, value: str, over: float, at: str) -> None:
        out.append((name, category, value, f"v / {over}", at))

    def metric(name: str, category: str, value: str, over: float) -> None:
        out.append((name, category, value, f"v / {over}", None))

    more("vocabulary_richness", "lexical", f"w_z_types / {an}", 0.8, "v >= 0.4")
    metric("avg_word_length", "lexical", f"letters / {an}", 10)
    more("contraction_rate", "lexical", "0.0", 0.1, "v > 0.02")
    more("long_word_frequency", "lexical", f"{d.size(d.filter('aw', 'z_w', d.length('z_w') + ' > 6'))} / {an}", 1, "v >= 0.2")
    more("archaic_vocabulary_rate", "lexical", share(ARCHAIC), 0.05, "v > 0")
    more("rare_word_rate", "lexical", f"{rare} / {an}", 0.3, "v >= 0.05")
    metric("function_word_rate", "lexical", f"k_function / {an}", 0.6)
    metric("article_rate", "lexical", share(["a", "an", "the"]), 0.1)
    metric("preposition_rate", "lexical", share(PREPOSITIONS), 0.15)
    metric("lexical_density", "lexical", f"1 - k_function / {an}", 1)
    metric("hapax_legomena_ratio", "lexical", f"{d.size(d.filter('w_c', 'z_c', 'z_c = 1'))} / cast(nullif(w_z_types, 0) as double)", 1)
    more("nominalization_rate", "lexical", f"{d.size(d.filter('lw', 'z_w', d.length('z_w') + ' > 4 and ' + d.like('z_w', NOMINAL)))} / {an}", 0.08, "v >= 0.03")
    metric("avg_sentence_length", "syntactic", "sm", 40)
    metric("sentence_length_stddev", "syntactic", "sd", 20)
    more("short_sentence_ratio", "syntactic", lens("z_l < 10"), 1, "v >= 0.3")
    more("long_sentence_ratio", "syntactic", lens("z_l > 25"), 1, "v >= 0.2")
    more("passive_voice_rate", "syntactic", f"{d.count('text', PASSIVE)} / {sn}", 0.3, "false")
    more("inverted_syntax_rate", "syntactic", openers(INVERTED), 0.2, "v >= 0.05")
    more("conjunction_opening_rate", "syntactic", openers(OPENING_CONJUNCTIONS), 0.2, "v >= 0.05")
    metric("sentence_opener_variety", "syntactic", opener, 1)
    metric("coordinating_conjunction_rate", "syntactic", share(COORDINATING), 0.08)
    metric("subordinating_conjunction_rate", "syntactic", f"k_sub / {an}", 0.05)
    metric("avg_clause_complexity", "syntactic", f"(commas + k_sub) / {sn}", 5)
    metric("paragraph_avg_length", "structural", f"{d.total('pc')} / pn", 10)
    more("single_sentence_paragraph_ratio", "structural", f"{d.size(d.filter('pc', 'z_c', 'z_c = 1'))} / cast(pn as double)", 1, "v >= 0.2")
    more("quotation_density", "structural", f"{quoted} / greatest({d.length('text')}, 1)", 0.3, "v >= 0.05")
    for name, k in (("em_dash_usage", em), ("semicolon_usage", chars(";")), ("ellipsis_usage", chars("..."))):
        more(name, "idiosyncratic", f"{k} / {sn}", 0.3, "v > 0")
    more("exclamation_usage", "idiosyncratic", sents(d.ends(d.strip("z_s"), "!")), 1, "v >= 0.05")
    more("parenthetical_usage", "idiosyncratic", f"{chars('(')} / {sn}", 0.3, "v > 0")
    more("rhetorical_question_rate", "idiosyncratic", sents(d.ends(d.strip("z_s"), "?")), 1, "v >= 0.05")
    for name, r, at, over in (("first_person_usage", FIRST, 0.03, 0.1), ("second_person_usage", SECOND, 0.02, 0.1), ("third_person_usage", THIRD, 0.02, 0.08)):
        more(name, "idiosyncratic", f"{d.size(d.filter('ut', 'z_w', d.member('z_w', r)))} / {an}", over, f"v >= {at}")
    more("figurative_language_markers", "idiosyncratic", f"{d.count('text', FIGURATIVE)} / {sn}", 0.15, "v >= 0.05")
    more("repetition_rate", "idiosyncratic", f"{d.size(d.filter('b_c', 'z_c', 'z_c >= 3'))} / cast(greatest(bn, 1) as double)", 0.02, "v > 0")
    more("vocative_usage", "idiosyncratic", f"{d.count('text', VOCATIVE)} / {sn}", 0.1, "v > 0")
    more("modal_verb_rate", "idiosyncratic", share(MODALS), 0.04, "v >= 0.015")
    metric("comma_rate", "idiosyncratic", f"commas / {sn}", 4)
    more("colon_usage", "idiosyncratic", f"{chars(':')} / {sn}", 0.2, "v > 0")
    more("discourse_marker_rate", "idiosyncratic", share(DISCOURSE), 0.02, "v >= 0.005")
    more("hedging_language_rate", "voice_tone", share(HEDGING), 0.02, "v >= 0.005")
    more("intensifier_rate", "voice_tone", share(INTENSIFYING), 0.02, "v >= 0.005")
    more("transition_word_rate", "voice_tone", f"{d.size(d.filter('lw', 'z_w', d.member('z_w', TRANSITIONAL)))} / {sn}", 0.2, "v >= 0.05")
    wps, spw, lpw, spx = f"an / {sn}", f"syl / {an}", f"letters / {an} * 100", f"{sn} / {an} * 100"
    metric("flesch_kincaid_grade", "idiosyncratic", f"0.39 * ({wps}) + 11.8 * ({spw}) - 15.59", 20)
    metric("flesch_reading_ease", "idiosyncratic", f"206.835 - 1.015 * ({wps}) - 84.6 * ({spw})", 100)
    metric("gunning_fog_index", "idiosyncratic", f"0.4 * (({wps}) + 100 * poly / {an})", 20)
    metric("coleman_liau_index", "idiosyncratic", f"0.0588 * ({lpw}) - 0.296 * ({spx}) - 15.8", 20)
    metric("smog_index", "idiosyncratic", f"1.043 * sqrt(poly * 30.0 / {sn}) + 3.1291", 20)
    metric("automated_readability_index", "idiosyncratic", f"4.71 * letters / {an} + 0.5 * ({wps}) - 21.43", 20)
    return out


def measures(d: Spark) -> tuple[Steps, str]:
    """Steps over a text that end in z_v, z_g and z_dir: values, weights and directions of all elements; and which texts have them."""
    own = elements(d)
    inner = {f"v{k}": f"cast({e[2]} as double)" for k, e in enumerate(own)}
    array = lambda items: ("array(" if d.name == "spark" else "[") + ", ".join(items) + (")" if d.name == "spark" else "]")
    of = lambda e, k: re.sub(r"\bv\b", f"v{k}", e)
    weights = [f"greatest(0.0, least(1.0, {of(e[3], k)}))" for k, e in enumerate(own)]
    more = [f"case when {of(e[4], k)} then 'more' else 'less' end" if e[4] else "''" for k, e in enumerate(own)]
    steps = base(d) | inner | {"z_v": array(f"v{k}" for k in range(len(own))), "z_g": array(weights), "z_dir": array(more)}
    return D.needed(steps, "z_v z_g z_dir an"), f"text is not null and {d.size(d.extract('text', '[a-zA-Z]+'))} >= {SOURCE_WORDS}"


def measured(docs: DataFrame) -> DataFrame:
    """The same, by doc_id, in Arrow batches."""
    steps, where = measures(Spark())
    schema = pa.schema([("z_v", pa.list_(pa.float64())), ("z_g", pa.list_(pa.float64())), ("z_dir", pa.list_(pa.string()))])
    rows = docs.selectExpr("doc_id", "text").where(where)
    return rows.mapInArrow(over(steps, ["text"], schema.names, ["doc_id"], schema), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, z_v array<double>, z_g array<double>, z_dir array<string>")


def tall(d: Spark, table: str = "{documents}", key: str = "doc_id") -> str:
    """CTEs ending in z_tall: key, element, category, kind, direction, weight, value, rounded to four digits."""
    own = elements(d)
    r = lambda x: d.rounded(f"cast({x} as double)", 4)
    steps, where = measures(d)
    names, cats = d.arr([e[0] for e in own]), d.arr([e[1] for e in own])
    rows = f"with z_end as (select * from {d.measured})" if d.measured and table == "{documents}" else D.layered(d, steps, table, f"{key}, text", where)
    direction = d.at("z_dir", "place")
    return f"""{rows}, z_each as ({d.explode("z_end", f"{key}, z_g, z_dir", "z_v", "z_value", "place")}),
      z_tall as (select {key}, {d.at(names, "place")} as element, {d.at(cats, "place")} as category, case when {direction} = '' then 'metric' else 'directional' end as kind,
      nullif({direction}, '') as direction, {r(d.at("z_g", "place"))} as weight, case when {direction} = '' then {r("z_value")} end as value, place from z_each)"""


def element_query(d: Spark) -> str:
    return tall(d) + " select doc_id, element, category, kind, direction, weight, value from z_tall"


#: Documents of a source in the order of their ids are an author's corpus.
def corpus(d: Spark) -> str:
    """CTEs ending in z_c: source, seq, cumulative words, element, kind, weight, value, current (what is tracked: the weight)."""
    joined = "z_src as (select t.doc_id as doc_id, s.source as source, t.element as element, t.kind as kind, t.direction as direction, t.weight as weight, t.value as value, t.category as category from z_tall t join {documents} s on t.doc_id = s.doc_id)"
    docs = f"z_docs as (select doc_id, source, {d.size(d.extract('text', '[a-zA-Z]+'))} as words from {{documents}} where text is not null), z_long as (select * from z_docs where words >= {SOURCE_WORDS})"
    seq = "z_seq as (select doc_id, row_number() over (partition by source order by doc_id) as seq, sum(words) over (partition by source order by doc_id rows unbounded preceding) as words_upto from z_long)"
    return f"{tall(d)}, {joined}, {docs}, {seq}, z_c as (select a.*, b.seq as seq, cast(b.words_upto as bigint) as words_upto from z_src a join z_seq b on a.doc_id = b.doc_id)"


def mean4(x: str) -> str:
    """Mean of numbers of four digits, to four digits, halves up: from whole numbers, so that no engine rounds it differently."""
    return f"floor((2 * sum(cast(round({x} * 10000) as bigint)) + count({x})) / cast(nullif(2 * count({x}), 0) as double)) / 10000"


def averaged(d: Spark) -> str:
    """A2: the profile of a source, averaged over its documents (each has every element, so the fold is the mean)."""
    return corpus(d) + f" select source, element, kind, max_by(direction, seq) as direction, {mean4('weight')} as weight, {mean4('value')} as value, count(*) as parses from z_c group by source, element, kind"


def convergence(d: Spark) -> str:
    """A3, A4: Welford statistics in order, stable runs of three, and the words read when a run was last completed."""
    return corpus(d) + """,
      z_m as (select *, avg(weight) over (partition by source, element order by seq rows unbounded preceding) as m, stddev_samp(weight) over (partition by source, element order by seq rows unbounded preceding) as sd from z_c),
      z_l as (select *, lag(m) over (partition by source, element order by seq) as pm from z_m),
      z_d as (select *, case when pm is null then null when abs(pm) < 0.01 then abs(m - pm) else abs(m - pm) / abs(pm) end as delta from z_l),
      z_st as (select *, case when pm is null then 0 when abs(pm) < 0.01 then case when delta < 0.001 then 1 else 0 end else case when delta < 0.02 then 1 else 0 end end as stable from z_d),
      z_i as (select *, sum(1 - stable) over (partition by source, element order by seq rows unbounded preceding) as island from z_st),
      z_run as (select *, sum(stable) over (partition by source, element, island order by seq rows unbounded preceding) as run from z_i)
      select source, element, cast(max(seq) as bigint) as n, """ + d.rounded("max_by(m, seq)", 6) + """ as mean, """ + d.rounded("case when max(seq) < 2 or max_by(m, seq) < 0.01 then 0 else max_by(sd, seq) / max_by(m, seq) end", 6) + """ as cv,
      cast(max_by(run, seq) as bigint) as consecutive_stable, max_by(run, seq) >= 3 as converged, max(case when run = 3 then words_upto end) as converged_at_words from z_run group by source, element"""


def completeness(d: Spark) -> str:
    """A5: share of converged elements, the highest tier reached (bronze needs 20,000 words as well) and the next one."""
    inner = convergence(d).replace("select source, element, cast(max(seq)", "select source, element, max(category) as category, max(words_upto) as words, cast(max(seq)")
    head, _, tail = inner.rpartition("\n      select source")
    return f"""{head}, z_conv as (select source{tail}),
      z_all as (select source, sum(case when converged then 1 else 0 end) as converged, count(*) as total, max(words) as words from z_conv group by source)
      select source, cast(converged as bigint) as converged, total, cast(floor(100.0 * converged / total) as bigint) as pct,
      case when floor(100.0 * converged / total) >= 90 then 'gold' when floor(100.0 * converged / total) >= 75 then 'silver' when floor(100.0 * converged / total) >= 50 and words >= 20000 then 'bronze' else 'starter' end as tier,
      case when words < 20000 or floor(100.0 * converged / total) < 50 then 'bronze' when floor(100.0 * converged / total) < 75 then 'silver' when floor(100.0 * converged / total) < 90 then 'gold' end as next_tier from z_all"""


def categories(d: Spark) -> str:
    """A5 by category: complete, good (half or more) or needs more."""
    head, _, _ = completeness(d).rpartition(",\n      z_all as")
    return f"{head} select source, category, sum(case when converged then 1 else 0 end) as converged, count(*) as total, case when sum(case when converged then 1 else 0 end) = count(*) then 'complete' when sum(case when converged then 1 else 0 end) >= 0.5 * count(*) then 'good' else 'needs_more' end as status from z_conv group by source, category"


def best_format(d: Spark) -> str:
    """Of several experiments (here the languages of documents) the one whose texts come nearest to the profile, by element."""
    head, _, _ = gaps(d).rpartition(",\n      z_rank as")
    return f"{head}, z_exp as (select s.element as element, t.lang as lang, {mean4('s.similarity')} as score from z_sim s join {{documents}} t on s.doc_id = t.doc_id group by s.element, t.lang), z_best as (select *, row_number() over (partition by element order by score desc, lang) as z_k from z_exp) select element, lang, score from z_best where z_k = 1"


def milestone(d: Spark) -> str:
    """How far a source is on its way to 20,000 words."""
    return f"""with z_w as (select source, sum({d.size(d.extract("text", "[a-zA-Z]+"))}) as words from {{documents}} where text is not null group by source)
      select source, cast(words as bigint) as words, case when words >= 20000 then 'complete' when words >= 10000 then '20k' when words >= 5000 then '10k' when words >= 2000 then '5k' else '2k' end as next_milestone,
      cast(least(100, floor(100.0 * words / case when words >= 10000 then 20000 when words >= 5000 then 10000 when words >= 2000 then 5000 else 2000 end)) as bigint) as pct from z_w"""


def _similar(a: str, b: str) -> str:
    """F2."""
    x, y = f"abs({a})", f"abs({b})"
    return f"case when {a} is null or {b} is null then 0 when {x} < 0.001 and {y} < 0.001 then 1 when {x} < 0.001 or {y} < 0.001 then 0 else least({x}, {y}) / greatest({x}, {y}) end"


def profiles(d: Spark) -> str:
    head, _, tail = averaged(d).rpartition(" select source")
    return f"{head}, z_prof as (select source{tail})"


def fidelity(d: Spark) -> str:
    """How faithful each document is to its source's profile."""
    value = lambda p: f"case when {p}.kind = 'metric' and {p}.value is not null then {p}.value else {p}.weight end"
    return profiles(d) + f""" select c.doc_id as doc_id, round(sum(cast({_similar(value("p"), value("c"))} as double) * p.weight) / greatest(sum(p.weight), 0.001), 4) as fidelity
      from z_c c join z_prof p on c.source = p.source and c.element = p.element group by c.doc_id"""


def gaps(d: Spark) -> str:
    """the ten elements of a document that are least like its source's."""
    value = lambda p: f"case when {p}.kind = 'metric' and {p}.value is not null then {p}.value else {p}.weight end"
    return profiles(d) + f""", z_sim as (select c.doc_id as doc_id, c.element as element, round(cast({_similar(value("p"), value("c"))} as double), 4) as similarity from z_c c join z_prof p on c.source = p.source and c.element = p.element),
      z_rank as (select *, row_number() over (partition by doc_id order by similarity, element) as place from z_sim) select doc_id, element, similarity, cast(place as bigint) as place from z_rank where place <= 10"""


def similarity(d: Spark) -> str:
    """Pairs of sources, compared element by element; one row for each pair of profiles (not of documents)."""
    w = "1 - abs(a.weight - b.weight)"
    metric = f"0.3 * ({w}) + 0.7 * (1 - least(1, abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1)))"
    each = f"case when a.kind = 'metric' then {metric} else 0.7 * ({w}) + 0.3 * case when a.direction = b.direction then 1 else 0.5 end end"
    s = f"round(avg(cast({each} as double)), 4)"
    return profiles(d) + f""", z_pair as (select a.source as a, b.source as b, {s} as similarity from z_prof a join z_prof b on a.element = b.element and a.source < b.source group by a.source, b.source)
      select *, case when similarity >= 0.9 then 'nearly identical' when similarity >= 0.75 then 'very similar' when similarity >= 0.5 then 'similar' when similarity >= 0.3 then 'different' else 'very different' end as label from z_pair"""


def stacked(d: Spark) -> str:
    """A1: a baseline (the first source) with all others as overlays, in order: the last to set an element wins; elements keep
    the order in which they were first seen."""
    return profiles(d) + """, z_o as (select *, row_number() over (partition by element order by source desc) as z_k from z_prof) select element, source, direction, weight, value from z_o where z_k = 1"""
