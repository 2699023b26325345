"""Sentence-level scores, and the three-tier score that they feed.

Sentences are exploded from their unit (a document or a paragraph) on the map side, scored by regular expressions, and
summed up by unit: partial sums leave one row for each unit and task, so the one shuffle moves numbers, never text.
"""

from __future__ import annotations

import re

from inkspan.functions import lexicons as L
from inkspan.functions.dialect import Spark, found, held, hits, ladder, may, severe
from inkspan.operators import document as D

Steps = dict[str, str]

def scores(d: Spark) -> Steps:
    """Steps over ``sentence`` and ``uniform``: d1 to d12, and d13, the sentence's score."""
    steps: Steps = {"z_low": "lower(sentence)", "z_tok": d.extract("z_low", r"[\p{L}\p{N}_]+"), "z_ws": d.extract("sentence", r"[^\s]+"), "z_nw": d.size("z_ws")}
    steps["z_k1"] = f"{d.size(D.buzz_tokens(d, 'z_tok', 'z_low'))} + {held(d, 'z_low', L.FILLER_PHRASES)}"
    steps["d1_buzzwords"] = f"least(90, 30 * z_k1) * {severe('z_k1')}"
    steps["d2_uniform"] = "cast(case when uniform > 30 then uniform else 0 end as double)"
    for name, k, most, each, patterns in (("d3_hedges", "z_k3", 60, 20, L.HEDGES), ("d4_transitions", "z_k4", 70, 35, L.TRANSITIONS)):
        steps[k] = hits(d, "sentence", patterns, "z_low")
        steps[name] = f"least({most}, {each} * {k}) * {severe(k)}"
    for k, pattern in (("a", L.NOT_ONLY), ("b", L.IT_IS_TO), ("c", L.TRIAD), ("d", L.SANDWICH)):
        steps[f"z_5{k}"] = f"cast({found(d, 'sentence', pattern, 'z_low')} as bigint)"
    half = f"lower({d.join(d.slice('z_ws', '1', 'cast(floor(z_nw / 2.0) as bigint)'), ' ')})"
    steps["z_5e"] = f"case when z_nw > 12 and {d.count(half, L.FRONT_LOADED)} >= 2 then 1 else 0 end"
    steps["z_k5"] = "z_5a + z_5b + z_5c + z_5d + z_5e"
    steps["d5_structure"] = f"(25 * z_5a + 15 * z_5b + 15 * z_5c + 25 * z_5d + 10 * z_5e) * {severe('z_k5')}"
    paired = f"case when {may(d, 'z_low', [L.DUAL])} then z_low else '' end"
    one, two = d.extract(paired, L.DUAL, 1), d.extract(paired, L.DUAL, 2)
    steps |= {"z_6a": one, "z_6b": two}
    both = f"{d.has(d.arr(L.DUAL_ADJECTIVES), d.at('z_6a', 'z_i'))} and {d.has(d.arr(L.DUAL_ADJECTIVES), d.at('z_6b', 'z_i'))}"
    steps["d6_dual_adjectives"] = f"cast(least(50, 25 * {d.size(d.filter(d.seq(d.size('z_6a')), 'z_i', both))}) as double)"
    steps["d7_trailing"] = ladder((found(d, "sentence", L.TRAILING, "z_low"), 20))
    for name, value, patterns in (("d8_declarations", 35, L.DECLARATIONS), ("d9_dichotomies", 30, L.DICHOTOMIES), ("d10_expositions", 30, L.EXPOSITIONS)):
        steps[name] = ladder((f"{hits(d, 'sentence', patterns, 'z_low')} > 0", value))
    steps["z_k11"] = f"case when {may(d, 'z_low', [L.ANY_PHRASE])} then {d.count('sentence', L.ANY_PHRASE)} else 0 end"
    steps["d11_phrases"] = d.half_even(f"least(90, 25 * z_k11) * {severe('z_k11')}", 1)
    for model in L.SIGNATURE_PHRASES:
        steps[f"z_12_{model}"] = f"{held(d, 'z_low', L.SIGNATURE_PHRASES[model])} + {hits(d, 'sentence', L.SIGNATURE_PATTERNS[model], 'z_low')}"
    steps["d12_fingerprint"] = "cast(15 * (" + " + ".join(f"z_12_{m}" for m in L.SIGNATURE_PHRASES) + ") as double)"
    names = [n for n in steps if n.startswith("d")]
    steps["z_hits"] = "(" + " + ".join(f"case when {n} > 0 then 1 else 0 end" for n in names) + ")"
    # least() passes over nulls, so a sentence without hits is told apart first.
    blend = d.half_even("least(100, (" + " + ".join(names) + ") / cast(greatest(z_hits, 1) as double) + least(30, 5 * z_hits))", 1)
    steps["d13_sentence"] = f"cast(case when z_hits = 0 then 0 else {blend} end as double)"
    return steps


PATTERNS = {
    "buzzword": "d1_buzzwords > 0", "uniform_length": "d2_uniform > 0", "hedge_word": "d3_hedges > 0", "ai_transition": "d4_transitions > 0", "not_only_but_also": "z_5a > 0", "it_is_adj_to": "z_5b > 0",
    "rule_of_three": "z_5c > 0", "hedging_sandwich": "z_5d > 0", "front_loaded_description": "z_5e > 0", "dual_adjective_pair": "d6_dual_adjectives > 0", "trailing_participial": "d7_trailing > 0",
    "confident_declaration": "d8_declarations > 0", "false_dichotomy": "d9_dichotomies > 0", "emotional_exposition": "d10_expositions > 0", "ai_phrase": "d11_phrases > 0", "model_fingerprint": "d12_fingerprint > 0",
}
#: Patterns that don't count as signs of a machine.
NOT_SIGNS = ("confident_declaration", "model_fingerprint")


def rows(d: Spark, table: str, key: str = "doc_id") -> str:
    """One row for each sentence: key, place, sentence, the unit's uniformity."""
    unit = D.layered(d, D.needed(D.base(d) | D.uniformity(d, "s5", "n5"), "s5 uniform"), table, f"{key}, text", f"text is not null and {d.strip('text')} <> ''")
    return f"{unit}, z_rows as ({d.explode('z_end', f'{key}, uniform', 's5', 'sentence', 'place')})"


def statement(d: Spark, wanted: list[str], table: str = "{documents}", key: str = "doc_id") -> str:
    steps = D.needed(scores(d), " ".join(wanted))
    chain, at = D.chained(steps, "z_rows", "z_s")
    return f"{rows(d, table, key)}{chain}, z_scored as (select * from {at})"


def units(d: Spark, table: str, key: str) -> str:
    """CTEs ending in z_units: for each unit the weighted mean of its sentences (C2) and which patterns it has."""
    flags = ", ".join(f"max(case when {c} then 1 else 0 end) as p_{n}" for n, c in PATTERNS.items())
    overall = "sum(d13_sentence * (1 + d13_sentence / 100)) / sum(1 + d13_sentence / 100)"
    return statement(d, ["d13_sentence", *PATTERNS.values()], table, key) + f", z_units as (select {key}, {overall} as overall, count(*) as sentences, {flags} from z_scored group by {key})"


def combined(d: Spark, signals: dict[str, str]) -> str:
    """C1 over named columns: weighted mean of those that fired, with bonuses for many and for strong ones; at most 100."""
    weight = {n: L.WEIGHTS.get(n, 0.5) for n in signals}
    on = {n: e for n, e in signals.items() if weight[n] > 0}
    add = lambda f, names: " + ".join(f"case when {on[n]} > 0 then {f(n)} else 0 end" for n in names) or "0"
    base = f"({add(lambda n: f'{weight[n]} * {on[n]}', on)}) / nullif(cast({add(lambda n: str(weight[n]), on)} as double), 0)"
    some, strong = [n for n in on if L.WEIGHTS.get(n, 0) >= 0.3], [n for n in on if L.WEIGHTS.get(n, 0) >= 0.7]
    bonus = f"least(15, 3 * greatest(0, {add(lambda n: '1', some)} - 2))"
    count = f"({add(lambda n: '1', strong)})"
    extra = f"case when {count} >= 3 and ({add(lambda n: on[n], strong)}) / cast({count} as double) > 30 then 5 else 0 end"
    return f"least(100, coalesce({base}, 0) + {bonus} + {extra})"


def composite(s: str, p: str, t: str, ns: str, np: str, nt: str) -> Steps:
    """C4: blend of three tiers, bonus for agreement, bonus for many signals."""
    tiers = f"(case when {s} > 0 then 1 else 0 end + case when {p} > 0 then 1 else 0 end + case when {t} > 0 then 1 else 0 end)"
    total, square = f"(greatest({s}, 0) + greatest({p}, 0) + greatest({t}, 0))", f"({s} * {s} + {p} * {p} + {t} * {t})"
    return {
        "c4_tiers": tiers, "c4_signals": f"{ns} + {np} + {nt}",
        "c4_var": f"{square} / nullif(cast(c4_tiers as double), 0) - {total} * {total} / nullif(cast(c4_tiers * c4_tiers as double), 0)",
        "c4_blend": f"0.45 * {s} + 0.30 * {p} + 0.25 * {t}",
        "c4_agree": "case when c4_tiers >= 2 and c4_var < 100 then least(10, (100 - c4_var) / 10) else 0 end",
        "c4_dense": "case when c4_tiers = 3 and c4_signals >= 8 then least(10, 2 * (c4_signals - 8)) when c4_tiers >= 2 and c4_signals >= 5 then least(5, c4_signals - 5) else 0 end",
        "c4_score": "least(100, c4_blend + c4_agree + c4_dense)",
    }


#: Document signals that go into the score; the others have no weight, or need more than one row (see operators.udfs).
SCORED = [n for n in D.SIGNALS if L.WEIGHTS.get(n, 0.5) > 0]


def weight_of(signal: str) -> float:
    return L.WEIGHTS.get(signal, 0.5)


def signal_steps(d: Spark) -> tuple[Steps, list[str]]:
    """All scored document signals as steps over one row, <signal>__score each; and their names."""
    steps: Steps = {}
    for n in SCORED:
        own = D.SIGNALS[n][1](d)
        names = {k: f"{n}__{k}" for k in own}
        for k, e in own.items():
            steps[names[k]] = re.sub(r"(?<![\w'])(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + r")(?![\w'(])", lambda m, names=names: names[m[1]], e)
    return steps, list(SCORED)


#: Document signals that SQL has no function for, or that need other rows: columns of the table that ``analysis`` is given.
OUTSIDE = {"compression_ratio": "x_compression_ratio", "hollow_informality": "x_hollow_informality", "semantic_monotony": "x_semantic_monotony", "chunked_consistency": "x_chunked_consistency"}


def analysis(d: Spark, table: str = "{documents}", outside: dict[str, str] | None = None, detail: bool = False, beside: str = "") -> str:
    """The whole score of every document: tiers, composite, genre damping, confidence band and class. Blank texts score 0.

    ``outside`` has further document signals as columns of the table ``beside``, one row by doc_id: they meet the scores of the
    document's own signals, so that no text is moved. ``detail`` (C17) adds how the score comes about.
    """
    steps, _ = signal_steps(d)
    steps |= {"para_texts": "paras"} | D.genre_steps(d)
    signals = {n: f"{n}__score" for n in SCORED} | (outside or {})
    steps["t_score"] = combined(d, signals)
    steps["t_count"] = " + ".join(f"case when {e} > 0 then 1 else 0 end" for e in signals.values())
    keep = ["t_score", "t_count", "genre", "n", "contractions__score", "first_person__score", "entity_density__score", "digression_absence__score", "ai_opening_phrases__score", "bullet_subheading_overuse__score", "closing_summary__score"]
    here = [*(f"{n}__score" for n in SCORED), "genre", "n"] if outside else keep
    doc = D.layered(d, D.needed(D.base(d) | steps, " ".join(here)), table, "doc_id, text", f"text is not null and {d.strip('text')} <> ''") + f" select doc_id, {', '.join(here)} from z_end"
    if outside:
        others = ", ".join(f"coalesce(nanvl(b.{c}, 0D), 0D) as {c}" for c in outside.values())
        both = f"select a.*, {others} from ({doc}) a left join {beside} b on a.doc_id = b.doc_id"
        doc = f"select doc_id, {', '.join(f'{steps[k]} as {k}' if k in ('t_score', 't_count') else k for k in keep)} from ({both}) z_both"
    para_rows = D.layered(d, D.needed(D.base(d), "paras"), table, "doc_id, text", f"text is not null and {d.strip('text')} <> ''") + " " + d.explode("z_end", "doc_id", "paras", "text", "para")
    own = {"z_pl": d.map("s5", "z_s", d.size(d.extract("z_s", r"[^\s]+"))), "z_pm": f"{d.total('z_pl')} / nullif(n5, 0)", "z_pcv": f"sqrt({d.total(d.map('z_pl', 'z_l', '(z_l - z_pm) * (z_l - z_pm)'))} / nullif(n5, 0)) / nullif(z_pm, 0)"}
    own |= {
        "g2": ladder(("n5 < 3", 0), ("z_pcv < 0.15", 40), ("z_pcv < 0.25", 20)), "g3_share": f"{d.size(d.filter('z_pl', 'z_l', 'z_l <= 3'))} / cast(nullif(n5, 0) as double)",
        "g3": ladder(("n5 < 3", 0), ("g3_share >= 0.75", 40), ("g3_share >= 0.5", 20)), "g4": ladder((f"nu > 20 and {d.size(d.distinct('u'))} / cast(nullif(nu, 0) as double) < 0.45", 25)),
        "g_specific": combined(d, {"para_sent_uniformity": "g2", "fragment_list": "g3", "para_vocab_richness": "g4"}),
    }
    para_own = D.layered(d, D.needed(D.base(d) | own, "g2 g3 g4 g_specific"), "z_paras", "doc_id, para, text", f"{d.strip('text')} <> ''") + " select doc_id, para, g2, g3, g4, g_specific from z_end"
    para_sent = units(d, "z_paras", "doc_id, para") + " select doc_id, para, overall from z_units"
    flags = [f"p_{n}" for n in PATTERNS]
    sent = units(d, table, "doc_id") + f" select doc_id, overall, {', '.join(flags)} from z_units"
    para_score = "least(100, case when o.g_specific > 0 then 0.6 * s.overall + 0.4 * o.g_specific else s.overall end)"
    para = f"select s.doc_id as doc_id, avg({d.half_even(para_score, 1)}) as p_score, max(case when g2 > 0 then 1 else 0 end) + max(case when g3 > 0 then 1 else 0 end) + max(case when g4 > 0 then 1 else 0 end) as p_count from z_psent s join z_pown o on s.doc_id = o.doc_id and s.para = o.para group by s.doc_id"
    wide = f"select a.doc_id as doc_id, a.overall as s_score, {' + '.join(f'a.{f}' for f in flags)} as s_count, {', '.join(f'a.{f} as {f}' for f in flags)}, b.p_score as p_score, b.p_count as p_count, c.t_score as t_score, c.t_count as t_count, c.genre as genre, c.n as n, {', '.join('c.' + k + ' as ' + k for k in keep[4:])} from z_sent a join z_para b on a.doc_id = b.doc_id join z_doc c on a.doc_id = c.doc_id"
    bounds = lambda k: "case genre " + " ".join(f"when '{g}' then {v[k]}" for g, v in L.GENRE_BOUNDS.items()) + " end"
    end = composite("s_score", "p_score", "t_score", "s_count", "p_count", "t_count") | {
        "ceiling": f"cast({bounds(1)} as double)", "damp": "(ceiling - 25) / 25",
        "damped": "case when ceiling > 25 and c4_score < ceiling + 10 then greatest(c4_score * (1 - 0.3 * damp), 0.7 * c4_score) else c4_score end",
        "overall_score": f"cast({d.half_even('damped', 1)} as double)",
        "margin": "15 * greatest(0.4, 1 - 0.08 * c4_signals) * greatest(0.5, 1 - n / 1000.0) * greatest(0.5, 1 - 0.4 * abs(damped - 50) / 50)",
        "tells": "6 - (case when contractions__score > 0 then 1 else 0 end + case when first_person__score > 0 then 1 else 0 end + case when entity_density__score > 0 then 1 else 0 end + case when digression_absence__score > 0 then 1 else 0 end)",
        "signs": " + ".join(f"p_{n}" for n in PATTERNS if n not in NOT_SIGNS) + " + case when ai_opening_phrases__score > 0 then 1 else 0 end + case when bullet_subheading_overuse__score > 0 then 1 else 0 end + case when closing_summary__score > 0 then 1 else 0 end",
        "category": "case when overall_score <= 20 then 'clean' when overall_score <= 30 and tells >= 3 then 'clean' when overall_score >= 40 then 'ghost_written' when overall_score >= 32 and tells < 2 and signs >= 3 then 'ghost_written' else 'ghost_touched' end",
        "confidence": "case category when 'ghost_written' then case when overall_score >= 60 then 'high' when overall_score >= 50 then 'medium' else 'low' end when 'clean' then case when overall_score <= 10 then 'high' when overall_score <= 15 then 'medium' else 'low' end else case when overall_score between 28 and 38 then 'medium' else 'low' end end",
    }
    chain = f"with z_paras as ({para_rows}), z_doc as ({doc}), z_sent as ({sent}), z_psent as ({para_sent}), z_pown as ({para_own}), z_para as ({para}), z_w as ({wide})"
    more, at = D.chained(end, "z_w", "z_e")
    chain += more
    r = lambda x: f"round(cast({x} as double), 4)"
    parts = {"sentence_weighted": "0.45 * s_score", "paragraph_weighted": "0.30 * p_score", "document_weighted": "0.25 * t_score", "agreement_bonus": "c4_agree", "density_bonus": "c4_dense", "raw_composite": "c4_score", "genre_dampening": "c4_score - damped"} if detail else {}
    more = "".join(f", {r(e)} as {n}" for n, e in parts.items())
    blank = f"select doc_id, 0 as sentence_score, 0 as paragraph_score, 0 as document_score, 0 as signal_count, 'general' as genre, 0 as overall_score, 0 as low, 0 as high, 'clean' as category, 'high' as confidence{"".join(f", 0 as {n}" for n in parts)} from {table} where text is null or {d.strip('text')} = ''"
    return f"{chain} {blank} union all select doc_id, {r('s_score')} as sentence_score, {r('p_score')} as paragraph_score, {r('t_score')} as document_score, cast(c4_signals as bigint) as signal_count, genre, overall_score, {r('greatest(0, damped - margin)')} as low, {r('least(100, damped + margin)')} as high, category, confidence{more} from {at}"
