"""Style guides from profiles: elements in words, routed to sections and rendered; rules for patterns; profile upkeep.

A profile is bounded by the number of elements, so what is grouped and rendered here are rows of profiles and not of
documents. Lists are put together in the order of categories and elements.
"""

from __future__ import annotations

from inkspan.functions import guidance as G
from inkspan.functions.dialect import Spark
from inkspan.operators import profile as P
from inkspan.operators import sentence as S

#: Words of the text that a guide is for.
TARGET_WORDS = 600
#: Elements that a new profile begins with: name, category, kind, direction, target, weight.
STARTERS = [
    ("contraction_rate", "lexical", "directional", "more", None, 0.5),
    ("avg_sentence_length", "syntactic", "metric", None, 15.0, 0.5),
    ("em_dash_usage", "idiosyncratic", "directional", "more", None, 0.5),
    ("flesch_kincaid_grade", "idiosyncratic", "metric", None, 8.0, 0.5),
    ("passive_voice_rate", "syntactic", "directional", "less", None, 0.5),
]
#: How strongly an element is asked for, by fifths of its weight.
MORE = ("occasionally", "sometimes", "moderately", "frequently", "consistently")
LESS = ("Slightly reduce", "Limit", "Minimize", "Strongly avoid", "Never use")


def rows_of(d: Spark, rows: list[tuple], names: list[str]) -> str:
    """A small table of constants."""
    lit = lambda x: "cast(null as varchar(1))" if x is None else d.lit(x) if isinstance(x, str) else f"cast({x} as double)" if isinstance(x, float) else str(x)
    return " union all ".join("select " + ", ".join(f"{lit(x)} as {n}" for x, n in zip(r, names, strict=True)) for r in rows)


def lookup(d: Spark, x: str, values: dict[str, str], otherwise: str) -> str:
    return f"case {x} " + " ".join(f"when {d.lit(k)} then {d.lit(v)}" for k, v in values.items()) + f" else {otherwise} end"


def fixed(d: Spark, x: str, digits: int) -> str:
    """A number as text with so many digits, halves to even."""
    return f"cast(cast({d.half_even(f'cast({x} as double)', digits)} as decimal(18, {digits})) as varchar(40))"


def listed(d: Spark, value: str, order: str, by: str) -> str:
    """Values of a group in the order of some columns, put together."""
    if d.name == "spark":
        return f"array_join(transform(sort_array(collect_list(struct({order}, {value} as z_t))), z_x -> z_x.z_t), {d.lit(by)})"
    return f"string_agg({value}, {d.lit(by)} order by {order})"


def instruction(d: Spark) -> str:
    """An element in words, from its weight, direction and target."""
    label = lookup(d, "element", G.ELEMENT_LABELS, "replace(element, '_', ' ')")
    fifth = lambda words: f"case when weight >= 0.8 or weight < 0 then '{words[4]}' when weight >= 0.6 then '{words[3]}' when weight >= 0.4 then '{words[2]}' when weight >= 0.2 then '{words[1]}' else '{words[0]}' end"
    near = "case when weight > 0.7 then 'closely' when weight > 0.4 then 'approximately' else 'roughly' end"
    return f"case when kind = 'metric' then concat('Target ', {near}, ' a ', {label}, ' of ', {fixed(d, 'coalesce(value, 0)', 1)}, '.') when direction = 'less' then concat({fifth(LESS)}, ' ', {label}, '.') else concat('Use ', {label}, ' ', {fifth(MORE)}, '.') end"


def count_of(d: Spark, words: int = TARGET_WORDS) -> str:
    """The number that an enforced element asks for in a text of so many words."""
    whole = lambda x: f"cast(cast({d.half_even(f'cast({x} as double)', 0)} as bigint) as varchar(20))"
    at_least = lambda x: f"cast(greatest(1, cast({d.half_even(f'cast({x} as double)', 0)} as bigint)) as varchar(20))"
    low = lambda x: f"greatest(1, cast(floor({x}) as bigint))"
    span = lambda x, end: f"concat(cast({low(x)} as varchar(20)), '-', cast({low(x)} + 1 as varchar(20)), '{end}')"
    s = f"{words} / 20.0"
    cases = {
        ("ellipsis_usage",): span(f"weight * 0.3 * ({s})", ""), ("quotation_density",): span(f"weight * 0.3 * {words} * 5 / 100", " quotes"),
        ("exclamation_rate", "parenthetical_usage", "intensifier_rate"): at_least(f"weight * ({s})"), ("hedging_language_rate",): f"concat('~', {at_least(f'weight * ({s})')})",
        ("first_person_usage",): f"concat('~', {at_least(f'weight * 0.1 * {words}')})", ("single_sentence_paragraph_ratio",): f"concat('~', {at_least(f'weight * ({s} / 4)')})",
        ("semicolon_usage",): at_least(f"weight * 0.5 * ({s})"), ("figurative_language_markers",): at_least(f"weight * 0.3 * ({s})"), ("transition_word_rate",): at_least(f"weight * 0.2 * ({s})"),
        ("narrative_vs_analytical_ratio",): f"concat('~', {whole('(1 - weight) * 100')})", ("article_rate", "named_entity_density"): f"concat('~', {fixed(d, 'weight * 100', 1)})",
        ("long_sentence_ratio", "short_sentence_ratio", "passive_voice_rate", "verb_tense_past_ratio", "verb_tense_present_ratio"): f"concat('~', {whole('weight * 100')})",
        ("topic_coherence_score",): f"concat('~', cast({d.half_even('cast(weight as double)', 2)} as varchar(20)))", ("sentence_length_stddev",): "''",
    }
    when = " ".join(f"when element in ({', '.join(map(d.lit, names))}) then {e}" for names, e in cases.items())
    return f"case {when} when weight <= 1.0 then concat('~', {whole('weight * 100')}, '%') else cast({d.half_even('cast(weight as double)', 2)} as varchar(20)) end"


def routed(d: Spark) -> str:
    """CTEs ending in z_route: profile elements with place, category, strategy (W3), words (W1) and enforced line."""
    own = P.elements(d)
    names = rows_of(d, [(e[0], e[1], k) for k, e in enumerate(own)], ["element", "category", "place"])
    template = lookup(d, "element", G.TEMPLATES, "''")
    strategy = lookup(d, "element", G.STRATEGY, "'english'")
    wins = ", ".join(map(d.lit, G.DETECTION_WINS))
    return f"""{P.profiles(d)}, z_names as ({names}),
      z_el as (select p.source as source, p.element as element, n.category as category, n.place as place, p.kind as kind, p.direction as direction, p.weight as weight, p.value as value from z_prof p join z_names n on p.element = n.element),
      z_said as (select *, {strategy} as strategy, element in ({wins}) as left_out, {instruction(d)} as words, {template} as template, {count_of(d)} as asked from z_el),
      z_route as (select *, case when left_out then 'none' when strategy in ('json', 'json_enforced') then 'json' when strategy = 'targeted_enforcement' then 'enforcement' else 'english' end as section,
        case when template = '' then words else replace(template, '{{count}}', asked) end as enforced from z_said)"""


def english(d: Spark) -> str:
    """W1."""
    return routed(d) + " select source, element, words as instruction from z_route"


def sorted_list(d: Spark) -> str:
    """All instructions of a profile, by category and then in the order of elements."""
    return routed(d) + f" select source, {listed(d, 'words', 'category, place', chr(10))} as guide, count(*) as n from z_route group by source"


def routing(d: Spark) -> str:
    """Which section an element goes to."""
    return routed(d) + " select source, element, strategy, section from z_route"


def counts(d: Spark) -> str:
    """Enforced elements with the number that is asked for."""
    return routed(d) + " select source, element, asked, enforced from z_route where section = 'enforcement'"


def sections(d: Spark) -> str:
    """The guide: targets as JSON, guidance as bullets, enforced rules as a numbered list; empty sections are left out."""
    target = f"coalesce({fixed(d, 'value', 4)}, 'null')"
    item = f"concat('  {{', chr(10), '    \"name\": \"', element, '\",', chr(10), '    \"category\": \"', category, '\",', chr(10), '    \"target_value\": ', {target}, chr(10), '  }}')"
    parts = f"""z_json as (select source, {listed(d, item, 'place', ',' + chr(10))} as body from z_route where section = 'json' group by source),
      z_eng as (select source, {listed(d, "concat('- ', words)", 'place', chr(10))} as body from z_route where section = 'english' group by source),
      z_num as (select source, place, concat(cast(row_number() over (partition by source order by place) as varchar(10)), '. ', enforced) as line from z_route where section = 'enforcement'),
      z_enf as (select source, {listed(d, 'line', 'place', chr(10))} as body from z_num group by source),
      z_any as (select distinct source from z_route)"""
    head = lambda t, u: d.lit(f"## {t}\n\n{u}\n\n")
    body = [f"case when j.body is not null then concat({head('Voice Profile — Hard Targets', 'Match these quantitative targets precisely:')}, {d.lit(chr(96) * 3 + 'json' + chr(10) + '[' + chr(10))}, j.body, {d.lit(chr(10) + ']' + chr(10) + chr(96) * 3)}) else '' end"]
    body.append(f"case when e.body is not null then concat(case when j.body is not null then {d.lit(chr(10) * 2)} else '' end, {head('Voice Profile — Style Guidance', 'Follow these voice patterns:')}, e.body) else '' end")
    body.append(f"case when f.body is not null then concat(case when j.body is not null or e.body is not null then {d.lit(chr(10) * 2)} else '' end, {head('MANDATORY Style Fingerprint Rules', 'These specific patterns are NON-NEGOTIABLE. The author' + chr(39) + 's voice depends on them.' + chr(10) + 'Verify each one before returning your text.')}, f.body) else '' end")
    return routed(d) + f", {parts} select a.source as source, concat({', '.join(body)}) as guide from z_any a left join z_json j on a.source = j.source left join z_eng e on a.source = e.source left join z_enf f on a.source = f.source"


def found_patterns(d: Spark) -> str:
    """CTEs ending in z_found: (doc_id, source, pattern, place, sentences that show it)."""
    names = list(S.PATTERNS)
    each = ("array(" if d.name == "spark" else "[") + ", ".join(f"n_{n}" for n in names) + (")" if d.name == "spark" else "]")
    sums = ", ".join(f"sum(case when {c} then 1 else 0 end) as n_{n}" for n, c in S.PATTERNS.items())
    return f"{S.statement(d, list(S.PATTERNS.values()))}, z_pat as (select doc_id, {sums} from z_scored group by doc_id), z_ps as (select doc_id, {each} as z_ns from z_pat), z_long as ({d.explode('z_ps', 'doc_id', 'z_ns', 'n', 'place')}), z_found as (select l.doc_id as doc_id, s.source as source, {d.at(d.arr(names), 'place')} as pattern, place, n from z_long l join {{documents}} s on l.doc_id = s.doc_id where n > 0)"


def pattern_rules(d: Spark) -> str:
    """C14: what to write instead of the patterns of a document; the longest key that a pattern begins with, each rule once."""
    rules = rows_of(d, [(k, v) for k, v in G.PATTERN_RULES.items()], ["rule_key", "rule"])
    starts = "startswith(f.pattern, r.rule_key)" if d.name == "spark" else "starts_with(f.pattern, r.rule_key)"
    return f"{found_patterns(d)}, z_rules as ({rules}), z_match as (select f.doc_id as doc_id, f.place as place, r.rule as rule, row_number() over (partition by f.doc_id, f.place order by length(r.rule_key) desc) as z_k from z_found f join z_rules r on {starts}) select doc_id, rule, min(place) as first_place from z_match where z_k = 1 group by doc_id, rule"


def traces(d: Spark) -> str:
    """Severity of a pattern by sentences and by documents of a source, and of both together."""
    by_count = lambda n: f"case when {n} >= 4 then 3 when {n} >= 2 then 2 when {n} = 1 then 1 else 0 end"
    named = lambda x: f"case when {x} >= 3 then 'strong' when {x} = 2 then 'warning' when {x} = 1 then 'caution' end"
    return f"{found_patterns(d)}, z_lev as (select source, pattern, {by_count('sum(n)')} as s, {by_count('count(*)')} as p from z_found group by source, pattern) select source, pattern, {named('s')} as sentence, {named('p')} as document, {named('s + p')} as compounded from z_lev where s > 0 and p > 0"


# --- consolidation of observations: each document of a source is an observation of its elements and patterns ---
def observed(d: Spark) -> str:
    """CTEs ending in z_obs: (source, seq, element, description, assessment): how a document's element compares to its profile."""
    gap = "abs(c.weight - p.weight)"
    return f"""{P.profiles(d)}, z_obs as (select c.source as source, c.seq as seq, c.element as element, concat(coalesce(c.direction, 'metric'), ' ', {fixed(d, 'c.weight', 2)}) as description,
      case when c.words_upto < 400 then 'insufficient_data' when {gap} > 0.2 then 'misleading' else 'accurate' end as assessment from z_c c join z_prof p on c.source = p.source and c.element = p.element)"""


def consensus(d: Spark) -> str:
    """K2: per element, how many observations agree, and the longest description (the first of equally long ones)."""
    longest = "max_by(description, struct(length(description), -seq))" if d.name == "spark" else "max_by(description, struct_pack(n := length(description), s := -seq))"
    yes = lambda c: f"sum(case when {c} then 1 else 0 end)"
    return observed(d) + f" select source, element, {longest} as consensus, {yes("assessment = 'accurate'")} as agreement, {yes("assessment <> 'accurate'")} as disagreement, {yes("assessment = 'misleading'")} > 0 as flagged_misleading from z_obs group by source, element"


def discovered(d: Spark) -> str:
    """K3: patterns of a source, how many documents show them, and the last that did; the commonest first."""
    return found_patterns(d) + ", z_n as (select source, pattern, count(*) as occurrences, max(doc_id) as last_doc, min(doc_id) as first_doc from z_found group by source, pattern) select source, pattern, occurrences, last_doc, row_number() over (partition by source order by occurrences desc, first_doc, pattern) as place from z_n"


def synced(d: Spark) -> str:
    """K4: the prompts of a profile are replaced by its discovered patterns that recur, numbered from 0."""
    return f"select source, pattern as prompt, row_number() over (partition by source order by place) - 1 as sort_order from ({discovered(d)}) x where occurrences >= 2"


# --- profile upkeep ---
def starters(d: Spark) -> str:
    return rows_of(d, STARTERS, ["element", "category", "kind", "direction", "value", "weight"]).replace("cast(null as varchar(1)) as value", "cast(null as double) as value")


def created(d: Spark) -> str:
    """A new profile for each source has the starters."""
    return f"select s.source as source, t.element as element, t.category as category, t.kind as kind, t.direction as direction, t.value as value, t.weight as weight from (select distinct source from {{documents}}) s join ({starters(d)}) t on true"


def reparsed(d: Spark) -> str:
    """A profile is reset to its starters and all documents are folded in again; old and new side by side."""
    return P.profiles(d) + f", z_start as ({starters(d)}), z_old as (select s.source as source, t.element as element, t.weight as weight, t.value as value from (select distinct source from z_prof) s join z_start t on true) select coalesce(p.source, o.source) as source, coalesce(p.element, o.element) as element, round(o.weight, 4) as old_weight, round(p.weight, 4) as new_weight, round(coalesce(p.weight, 0) - coalesce(o.weight, 0), 4) as moved from z_prof p full join z_old o on p.source = o.source and p.element = o.element"


def upserted(d: Spark) -> str:
    """Elements are set by name (here the starters, over each profile): what is there is overwritten, the rest is added."""
    return P.profiles(d) + f", z_start as ({starters(d)}), z_all as (select source, element, direction, weight, value, 1 as version from z_prof union all select s.source, t.element, t.direction, t.weight, t.value, 2 as version from (select distinct source from z_prof) s join z_start t on true), z_last as (select *, row_number() over (partition by source, element order by version desc) as z_k from z_all) select source, element, direction, round(weight, 4) as weight, round(value, 4) as value, version = 2 as edited from z_last where z_k = 1"


QUERIES = {
    "w01_weight_to_english": english, "w02_category_list": sorted_list, "w03_routing": routing, "w04_counts": counts, "w05_sections": sections, "c14_pattern_rules": pattern_rules, "c10_escalation": traces,
    "k02_consensus": consensus, "k03_discovered": discovered, "k04_synced_prompts": synced, "a07_reparse": reparsed, "a08_upsert_elements": upserted, "a09_new_profiles": created,
}
