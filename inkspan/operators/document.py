"""Document-level signals as SQL expressions over one row: a scan and a projection, no shuffle.

``base`` gives the columns that signals are written over; ``SIGNALS`` has for each signal a function of the dialect that
returns named steps, the last of which is ``score``. Steps may use those before them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from inkspan.functions import lexicons as L
from inkspan.functions.dialect import WORD, Spark, held, hits, ladder, mean, severe, spread, sum_of

Steps = dict[str, str]
SIGNALS: dict[str, tuple[str, Callable[[Spark], Steps]]] = {}
#: Words, characters of the shortest text that most checks look at.
MIN_WORDS, MIN_CHARS = 50, 200


def signal(id: str, name: str):
    def put(f: Callable[[Spark], Steps]) -> Callable[[Spark], Steps]:
        SIGNALS[name] = id, f
        return f

    return put


def base(d: Spark) -> Steps:
    """From text: low, t0 stripped, w letter words, u word tokens, ws white-space words, s5 sentences for scoring, s6 sentences longer
    than five characters, s0 raw sentences, pa blank-line paragraphs."""
    parts = lambda p: d.filter(d.map(d.after_stop(p), "z_q", d.strip("z_q")), "z_q", "z_q <> ''")
    lines = lambda p: d.filter(d.map(d.split(p, "\n"), "z_q", d.strip("z_q")), "z_q", "z_q <> ''")
    fall_back = f"case when {d.size(parts('z_p'))} > 1 then {parts('z_p')} when {d.contains('z_p', chr(10))} then {lines('z_p')} else {d.map(d.seq('1'), 'z_i', 'z_p')} end"
    return {
        "low": "lower(text)", "t0": d.strip("text"), "w": d.extract("low", "[a-z']+"), "u": d.extract("low", WORD), "ws": d.extract("text", r"[^\s]+"),
        "s0": d.after_stop("t0"), "s6": d.filter("s0", "z_q", d.length(d.strip("z_q")) + " > 5"),
        "paras": d.filter(d.map(d.split("t0", r"\n\s*\n"), "z_q", d.strip("z_q")), "z_q", "z_q <> ''"), "s5": d.flat(d.map("paras", "z_p", fall_back)),
        "pa": d.filter(d.map(d.split("text", chr(10) + chr(10)), "z_q", d.strip("z_q")), "z_q", "z_q <> ''"),
        "n": d.size("w"), "nu": d.size("u"), "nws": d.size("ws"), "n6": d.size("s6"), "n5": d.size("s5"),
    }


def levels(steps: Steps) -> list[Steps]:
    """Steps grouped so that each uses only steps of groups before its own."""
    depth: dict[str, int] = {}
    for name, e in steps.items():
        depth[name] = 1 + max((depth[w] for w in set(re.findall(r"\w+", e)) if w in depth), default=0)
    return [{n: steps[n] for n in steps if depth[n] == k} for k in range(1, max(depth.values(), default=0) + 1)]


def chained(steps: Steps, start: str, prefix: str) -> tuple[str, str]:
    """CTEs that add the steps to a table, a group at a time, and the last one's name.

    One select for each group: an engine that expands aliases in place would else multiply the work.
    """
    out, at = "", start
    for k, group in enumerate(levels(steps)):
        out += f", {prefix}{k} as (select *, {', '.join(f'{e} as {n}' for n, e in group.items())} from {at})"
        at = f"{prefix}{k}"
    return out, at


def layered(d: Spark, steps: Steps, table: str, columns: str, where: str = "true") -> str:
    """CTEs that add the steps to the rows of a table; the last one's name is z_end."""
    chain, at = chained(steps, "z_rows0", "z_")
    return f"with z_rows0 as (select {columns} from {table} where {where}){chain}, z_end as (select * from {at})"


def needed(steps: Steps, wanted: str) -> Steps:
    """The steps that ``wanted`` uses, directly or through others."""
    used, out = set(re.findall(r"\w+", wanted)), {}
    for name, e in reversed(steps.items()):
        if name in used:
            out[name] = e
            used |= set(re.findall(r"\w+", e))
    return dict(reversed(out.items()))


def word_counts(d: Spark, a: str = "w", n: str = "n") -> Steps:
    """c: how often each distinct member of an array occurs: run lengths of the sorted array, in one pass."""
    return {
        "z_sorted": d.sort(a),
        "z_begin": d.filter(d.seq(n), "z_i", f"z_i = 1 or {d.at('z_sorted', 'z_i')} <> {d.at('z_sorted', 'greatest(z_i - 1, 1)')}"),
        "z_types": d.size("z_begin"),
        "c": d.map(d.seq("z_types"), "z_i", f"coalesce({d.at('z_begin', 'z_i + 1')}, {n} + 1) - {d.at('z_begin', 'z_i')}"),
    }


def statement(d: Spark, steps: Steps, keep: dict[str, str], table: str = "documents", key: str = "doc_id") -> str:
    """One row for each text: what to keep of the steps over the base columns. Null counts as empty; blank texts score 0."""
    kept = ", ".join(f"case when t0 = '' then 0 else {e} end as {k}" if k == "score" else f"{e} as {k}" for k, e in keep.items())
    return layered(d, needed(base(d) | steps, kept), table, f"{key}, coalesce(text, '') as text") + f" select {key}, {kept} from z_end"


def _cv(d: Spark, a: str, n: str) -> Steps:
    return {"m": mean(d, a, n), "v": spread(d, a, n, "m"), "cv": "sqrt(v) / nullif(m, 0)"}


@signal("h01", "yules_k")
def yules_k(d: Spark) -> Steps:
    k = f"10000.0 * ({d.total(d.map('c', 'z_c', 'z_c * z_c'))} - n) / nullif(cast(n as double) * n, 0)"
    return word_counts(d) | {"k": f"cast({k} as double)", "score": ladder((f"n < {MIN_WORDS}", 0), ("k > 250", 45), ("k > 150", 25))}


@signal("h02", "hapax_legomena")
def hapax(d: Spark) -> Steps:
    return word_counts(d) | {"ratio": f"{d.size(d.filter('c', 'z_c', 'z_c = 1'))} / cast(nullif(z_types, 0) as double)", "score": ladder((f"n < {MIN_WORDS}", 0), ("ratio < 0.35", 40), ("ratio < 0.5", 20))}


@signal("h03", "function_word_deviation")
def function_words(d: Spark) -> Steps:
    each = sum_of(f"abs(cast({d.size(d.filter('w', 'z_w', f'z_w = {d.lit(w)}'))} as double) / nullif(n, 0) * 1000 - {f}) / {f}" for w, f in L.FUNCTION_WORDS.items())
    return {"dev": f"{each} / {len(L.FUNCTION_WORDS)}", "score": ladder((f"n < {MIN_WORDS}", 0), ("dev > 0.8", 40), ("dev > 0.6", 20))}


def mattr_steps(d: Spark, window: int = 50) -> Steps:
    return {
        "z_windows": d.map(d.seq(f"n - {window - 1}"), "z_i", f"{d.size(d.distinct(d.slice('w', 'z_i', str(window))))} / cast({window} as double)"),
        "windows": d.size("z_windows"),
        "mattr": mean(d, "z_windows", "windows"),
        "mattr_var": spread(d, "z_windows", "windows", "mattr"),
    }


@signal("h04", "mattr")
def mattr(d: Spark) -> Steps:
    low = ladder(("mattr < 0.65", 25), ("mattr < 0.72", 10))
    return mattr_steps(d) | {"score": f"cast(case when n < 70 then 0 else least(45, {low} + case when mattr_var < 0.001 and windows > 100 then 20 else 0 end) end as double)"}


def zipf_steps(d: Spark) -> Steps:
    f = f"ln({d.at('fc', 'z_i')})"
    total = lambda e: d.total(d.map(d.seq("z_types"), "z_i", e))
    return word_counts(d) | {
        "fc": d.falling("c"),
        "k": "cast(z_types as double)", "mx": f"{total('ln(z_i)')} / nullif(k, 0)", "my": f"{total(f)} / nullif(k, 0)",
        "sxx": total("(ln(z_i) - mx) * (ln(z_i) - mx)"), "sxy": total(f"(ln(z_i) - mx) * ({f} - my)"), "syy": total(f"({f} - my) * ({f} - my)"),
        "alpha": "-sxy / nullif(sxx, 0)", "r2": "case when syy > 0 then sxy * sxy / nullif(sxx * syy, 0) else 0 end",
    }


@signal("h05", "zipf_deviation")
def zipf(d: Spark) -> Steps:
    step = ladder(("abs(alpha - 1) > 0.3", 35), ("abs(alpha - 1) > 0.15", 15))
    return zipf_steps(d) | {"score": f"cast(case when n < {MIN_WORDS} or z_types < 10 or alpha is null then 0 else least(45, {step} + case when r2 < 0.75 and abs(alpha - 1) <= 0.15 then 10 else 0 end) end as double)"}


@signal("h07", "sentence_opener_pos")
def openers(d: Spark) -> Steps:
    first = d.map("s6", "z_s", d.rstrip(f"lower({d.at(d.extract('z_s', r'[^' + chr(92) + 's]+'), '1')})", ".,;:!?"))
    count = lambda words: d.size(d.filter("z_first", "z_x", d.member("z_x", words)))
    return {
        "z_first": first, "ai": f"{count(L.AI_OPENERS)} / cast(nullif(n6, 0) as double)", "human": f"{count(L.HUMAN_OPENERS)} / cast(nullif(n6, 0) as double)",
        "z_step": ladder(("n6 < 5", 0), ("ai > 0.4", 40), ("ai > 0.25", 20)),
        "score": "cast(case when human > 0.3 and z_step > 0 then greatest(0, z_step - 15) else z_step end as double)",
    }


@signal("h08", "word_length_distribution")
def word_lengths(d: Spark) -> Steps:
    lengths = d.map("w", "z_w", d.length("z_w"))
    middle = d.size(d.filter("z_len", "z_l", "z_l >= 5 and z_l <= 8"))
    return {"z_len": lengths} | _cv(d, "z_len", "n") | {"middle": f"{middle} / cast(nullif(n, 0) as double)", "score": f"cast(case when n < {MIN_WORDS} then 0 else case when cv < 0.45 then 20 else 0 end + case when middle > 0.45 then 15 else 0 end end as double)"}


@signal("h09", "char_ngram_profile")
def char_trigrams(d: Spark) -> Steps:
    steps = {"z_clean": d.replace("low", "[^a-z ]", ""), "z_chars": d.chars("z_clean"), "z_n": f"greatest({d.size('z_chars')} - 2, 0)", "z_codes": d.map("z_chars", "z_c", "ascii(z_c)"), "z_tri": d.map(d.seq("z_n"), "z_i", f"{d.at('z_codes', 'z_i')} * 16384 + {d.at('z_codes', 'z_i + 1')} * 128 + {d.at('z_codes', 'z_i + 2')}")}
    steps |= word_counts(d, "z_tri", "z_n")
    entropy = f"log2(nullif(z_n, 0)) - {d.total(d.map('c', 'z_c', 'z_c * log2(z_c)'))} / nullif(z_n, 0)"
    return steps | {"entropy": f"({entropy}) / case when z_types > 1 then log2(greatest(z_types, 2)) else 1 end", "score": ladder(("z_n < 98", 0), ("entropy < 0.85", 25), ("entropy < 0.9", 10))}


@signal("h10", "burrows_delta")
def delta(d: Spark) -> Steps:
    words = list(L.FUNCTION_WORDS.items())[: len(L.DELTA_SD)]
    each = sum_of(f"abs(cast({d.size(d.filter('w', 'z_w', f'z_w = {d.lit(w)}'))} as double) / nullif(n, 0) * 1000 - {f}) / {s}" for (w, f), s in zip(words, L.DELTA_SD, strict=True))
    return {"delta": f"{each} / {len(words)}", "score": ladder((f"n < {MIN_WORDS}", 0), ("delta > 2", 45), ("delta > 1.5", 25), ("delta > 1.2", 10))}


def readability_steps(d: Spark) -> Steps:
    vowels = d.extract(d.rstrip("z_w", "e"), "[aeiouy]+")
    return {
        "z_sent": d.size(d.filter(d.split("text", "[.!?]+"), "z_q", f"{d.strip('z_q')} <> ''")),
        "syllables": d.total(d.map("u", "z_w", f"greatest(1, {d.size(vowels)})")),
        "z_asl": "nu / cast(nullif(z_sent, 0) as double)", "z_asw": "syllables / nullif(nu, 0)",
        "grade": "coalesce(0.39 * z_asl + 11.8 * z_asw - 15.59, 0)", "ease": "coalesce(206.835 - 1.015 * z_asl - 84.6 * z_asw, 0)",
    }


@signal("h11", "readability")
def readability(d: Spark) -> Steps:
    return readability_steps(d) | {"score": "cast(case when nws < 30 then 0 else case when grade between 8 and 12 then 25 else 0 end + case when ease between 40 and 65 then 15 else 0 end end as double)"}


@signal("h12", "contractions")
def contractions(d: Spark) -> Steps:
    return {"short": d.count("text", L.CONTRACTIONS), "long": d.count("text", L.EXPANDABLE), "ratio": "short / cast(nullif(short + long, 0) as double)", "score": ladder(("short + long < 3", 0), ("ratio < 0.15", 50), ("ratio < 0.3", 25))}


@signal("h13", "first_person")
def first_person(d: Spark) -> Steps:
    return {"ratio": f"{d.size(d.filter('u', 'z_w', d.member('z_w', L.FIRST_PERSON)))} / cast(nullif(nu, 0) as double)", "score": ladder(("nu < 30", 0), ("ratio < 0.005", 20), ("ratio < 0.015", 10))}


@signal("h14", "passive_voice")
def passive(d: Spark) -> Steps:
    return {"ratio": f"{d.size(d.filter('s0', 'z_s', d.like('z_s', L.PASSIVE)))} / cast({d.size('s0')} as double)", "score": ladder((f"{d.size('s0')} < 3", 0), ("ratio > 0.5", 40), ("ratio > 0.35", 20))}


@signal("h15", "adverb_density")
def adverbs(d: Spark) -> Steps:
    return {
        "z_ly": d.filter("u", "z_w", f"{d.ends('z_w', 'ly')} and {d.length('z_w')} > 3 and not {d.member('z_w', L.NOT_ADVERBS)}"),
        "ratio": f"{d.size('z_ly')} / cast(nullif(nu, 0) as double)", "strong": d.size(d.filter("z_ly", "z_w", d.member("z_w", L.INTENSIFIERS))),
        "z_step": ladder(("nu < 30", 0), ("ratio > 0.06", 40), ("ratio > 0.04", 20)),
        "score": "cast(case when nu >= 30 and strong >= 2 then least(60, z_step + 20) else z_step end as double)",
    }


@signal("h16", "entity_density")
def entities(d: Spark) -> Steps:
    proper = d.map("s0", "z_s", d.size(d.filter(d.slice(d.extract("z_s", r"[^\s]+"), "2", "1000000000"), "z_w", d.like("z_w", r"^\p{Lu}\p{L}+$"))))
    return {
        "proper": d.total(proper), "numbers": d.count("text", L.NUMBERS), "specifics": d.count("text", L.SPECIFICS),
        "ratio": "(proper + numbers + specifics) / nullif(nu, 0)", "score": ladder(("nu <= 50", 0), ("ratio < 0.01", 35), ("ratio < 0.025", 15)),
    }


def _chars(d: Spark, x: str, c: str) -> str:
    return f"({d.length(x)} - {d.length(f'replace({x}, {d.lit(c)}, {d.lit(str())})')}) / {len(c)}"


@signal("h17", "punctuation_fingerprint")
def punctuation(d: Spark) -> Steps:
    odd = f"{_chars(d, 'text', '!')} + {_chars(d, 'text', '(')} + {d.count('text', r'[.]{3}|…')}"
    return {
        "commas": f"{_chars(d, 'text', ',')} / cast(nullif(nu, 0) as double)", "semis": _chars(d, "text", ";"), "odd": odd,
        "score": "cast(case when nu < 30 then 0 else least(50, case when commas > 0.08 then 15 else 0 end + case when semis >= 2 and semis / cast(nu as double) > 0.005 then 10 else 0 end + case when odd = 0 and nu > 80 then 15 else 0 end) end as double)",
    }


def runs(d: Spark, flags: str, n: str) -> Steps:
    """z_stops: places where a flag is false, with both ends; the longest run of true ones is the largest gap less one.

    An array that is only used inside a lambda would be put there by the optimiser and made again for every member; its
    size is asked for outside, so that it stays a column.
    """
    return {
        "z_flags": flags,
        "z_stops": d.concat(d.map(d.seq("1"), "z_i", "cast(0 as bigint)"), d.concat(d.filter(d.seq(d.size("z_flags")), "z_i", f"not {d.at('z_flags', 'z_i')}"), d.map(d.seq("1"), "z_i", f"{n} + 1"))),
        "longest": f"coalesce({d.most(d.map(d.seq(d.size('z_stops') + ' - 1'), 'z_i', d.at('z_stops', 'z_i + 1') + ' - ' + d.at('z_stops', 'z_i') + ' - 1'))}, 0)",
    }


@signal("h18", "hedge_clusters")
def hedge_clusters(d: Spark) -> Steps:
    steps = runs(d, d.map("s5", "z_s", f"{held(d, 'lower(z_s)', L.HEDGES_CLUSTERED)} > 0"), "n5")
    gaps = d.map(d.seq("z_k - 1"), "z_i", f"{d.at('z_at', 'z_i + 1')} - {d.at('z_at', 'z_i')}")
    steps |= {"z_at": d.filter(d.seq("n5"), "z_i", d.at("z_flags", "z_i")), "z_k": d.size("z_at"), "z_gaps": gaps} | _cv(d, "z_gaps", "(z_k - 1)")
    even = ladder(("n5 < 6 or z_k < 3", 0), ("cv < 0.3 and z_k >= 4", 40), ("cv < 0.5", 20))
    return steps | {"score": f"greatest({ladder(('longest >= 4', 45), ('longest >= 3', 25))}, {even})"}


@signal("h19", "transition_stacks")
def stacks(d: Spark) -> Steps:
    start = " or ".join(d.starts("lower(z_s)", p) for p in L.STACK_STARTERS)
    return {"ratio": f"{d.size(d.filter('s5', 'z_s', f'({start})'))} / cast(nullif(n5, 0) as double)", "score": ladder(("n5 < 3", 0), ("ratio > 0.4", 45), ("ratio > 0.25", 25))}


@signal("h20", "synonym_treadmill")
def treadmill(d: Spark) -> Steps:
    used = sum_of(f"case when {d.size(d.intersect(d.distinct('u'), d.arr(g)))} >= 3 then 1 else 0 end" for g in L.SYNONYM_GROUPS)
    return {"used": used, "score": ladder(("used >= 3", 40), ("used >= 2", 20))}


@signal("h21", "emoji_density")
def emoji(d: Spark) -> Steps:
    return {"k": d.count("text", L.EMOJI), "ratio": "k / cast(nullif(nu, 0) as double)", "score": ladder(("nu = 0", 0), ("ratio > 0.1", 30), ("ratio > 0.05 and k >= 3", 15))}


@signal("h22", "sensory_checklist")
def senses(d: Spark) -> Steps:
    return {"k": hits(d, "text", L.SENSES), "score": ladder(("k >= 4", 35), ("k >= 3", 15))}


@signal("h23", "self_contained_paragraphs")
def self_contained(d: Spark) -> Steps:
    later = d.slice("pa", "2", "1000000000")
    return {"np": d.size("pa"), "ratio": f"{d.size(d.filter(later, 'z_p', d.like('z_p', L.CONNECTORS)))} / cast(nullif(np - 1, 0) as double)", "score": ladder(("np < 4", 0), ("ratio < 0.1", 30))}


@signal("h24", "em_dash_overuse")
def em_dash(d: Spark) -> Steps:
    return {"k": f"{_chars(d, 'text', '—')} + {_chars(d, 'text', '--')}", "rate": "k / cast(nullif(n, 0) as double) * 1000", "score": ladder((f"n < {MIN_WORDS} or k < 3", 0), ("rate > 10", 40), ("rate > 5", 20))}


@signal("h25", "ai_opening_phrases")
def opening_phrases(d: Spark) -> Steps:
    any_of = " or ".join(d.like("z_s", r) for r in L.OPENING_PHRASES)
    return {"k": d.size(d.filter(d.map("s6", "z_q", d.strip("z_q")), "z_s", f"({any_of})")), "ratio": "k / cast(nullif(n6, 0) as double)", "score": ladder(("n6 < 3", 0), ("ratio > 0.2", 45), ("k >= 2", 25), ("k = 1", 10))}


@signal("h26", "closing_summary")
def closing(d: Spark) -> Steps:
    return {
        "z_close": f"lower({d.join(d.slice('s6', 'greatest(n6 - 1, 1)', '2'), ' ')})", "z_body": f"lower({d.join(d.slice('s6', '1', 'greatest(n6 - 2, 0)'), ' ')})",
        "k": hits(d, "z_close", L.CLOSINGS), "contrast": f"({d.count('z_body', L.CLOSING_NEGATIVE)} >= 2 and {d.like('z_close', L.CLOSING_ASPIRATION)})",
        "score": ladder(("n6 < 3 or k = 0", 0), ("k >= 2 and contrast", 45), ("k >= 2", 35), ("contrast", 30), otherwise=18),
    }


@signal("h27", "question_exclamation_absence")
def no_questions(d: Spark) -> Steps:
    ends = lambda c: d.size(d.filter("s6", "z_s", d.ends(d.strip("z_s"), c)))
    return {"k": f"{ends('?')} + {ends('!')}", "score": ladder(("n6 < 8", 0), ("k = 0", 25), ("k / cast(n6 as double) < 0.05 and n6 >= 10", 10))}


@signal("h28", "oxford_comma_consistency")
def oxford(d: Spark) -> Steps:
    return {"with_comma": d.count("text", r"(?i),\s+\w+,\s+and\s+"), "without": d.count("text", r"(?i),\s+\w+\s+and\s+"), "score": ladder(("with_comma + without < 3", 0), ("with_comma = 0 or without = 0", 15))}


@signal("h29", "bullet_subheading_overuse")
def bullets(d: Spark) -> Steps:
    lines = d.filter(d.map(d.split("text", "\n"), "z_q", d.strip("z_q")), "z_q", "z_q <> ''")
    marked = sum_of(d.size(d.filter("z_lines", "z_s", d.like("z_s", r))) for r in (r"^[-*•]\s+", r"^\d+[.)]\s+", r"^#{1,4}\s+"))
    return {"z_lines": lines, "k": d.size("z_lines"), "ratio": f"{marked} / cast(nullif(k, 0) as double)", "score": ladder(("k < 5", 0), ("ratio > 0.4", 35), ("ratio > 0.2", 15))}


@signal("h30", "digression_absence")
def digressions(d: Spark) -> Steps:
    return {"k": f"{hits(d, 'low', L.DIGRESSIONS)} + {d.count('text', r'[(][^)]{10,}[)]')}", "score": ladder((f"n < {MIN_WORDS}", 0), ("k = 0 and n > 100", 20), ("k / cast(nullif(n, 0) as double) * 100 < 0.2 and n > 150", 10))}


@signal("h31", "consensus_middle")
def consensus(d: Spark) -> Steps:
    return {"b": hits(d, "low", L.BALANCES), "o": hits(d, "low", L.OPINIONS), "score": ladder((f"n < {MIN_WORDS} or o > 0", 0), ("b >= 3", 35), ("b >= 2", 20), ("b >= 1 and n > 150", 10))}


@signal("h32", "ai_phrases")
def stock_phrases(d: Spark) -> Steps:
    density = "k / cast(nullif(n, 0) as double) * 100"
    raised = f"least(90, least(90, 20 * k) + case when {density} > 2 then 15 when {density} > 1 then 8 else 0 end)"
    return {"k": d.count("text", L.ANY_PHRASE), "score": f"cast(case when n < {MIN_WORDS} then 0 else {d.half_even(raised + ' * ' + severe('k'), 1)} end as double)"}


@signal("h33", "rhetorical_question_chain")
def questions(d: Spark) -> Steps:
    return runs(d, d.map("s5", "z_s", d.ends(d.strip("z_s"), "?")), "n5") | {"score": "cast(case when longest >= 2 then least(75, 25 * (longest - 1)) else 0 end as double)"}


@signal("h34", "circular_repetition")
def circular(d: Spark) -> Steps:
    fifth = "greatest(1, cast(floor(n5 / 5.0) as bigint))"
    words = lambda s: d.extract(f"lower({d.join(s, ' ')})", WORD)
    grams = lambda a: d.distinct(d.map(d.seq(d.size(a) + " - 2"), "z_i", d.join(d.slice(a, "z_i", "3"), " ")))
    return {
        "z_in": words(d.slice("s5", "1", fifth)), "z_out": words(d.slice("s5", f"greatest(1, n5 - {fifth} + 1)", fifth)), "z_gi": grams("z_in"), "z_go": grams("z_out"),
        "overlap": f"{d.size(d.intersect('z_gi', 'z_go'))} / cast(nullif(least({d.size('z_gi')}, {d.size('z_go')}), 0) as double)", "score": ladder(("n5 < 5", 0), ("overlap > 0.1", 30)),
    }


@signal("h37", "tricolon_density")
def tricolons(d: Spark) -> Steps:
    return {"k": d.size(d.filter("s5", "z_s", d.like("z_s", L.TRIAD))), "rate": "k / cast(nullif(nu, 0) as double) * 100", "score": ladder(("nu <= 50", 0), ("rate >= 1.5", 35), ("rate >= 0.8 and k >= 3", 18))}


@signal("h38", "staccato_rhythm")
def staccato(d: Spark) -> Steps:
    return {
        "z_len": d.map("s5", "z_s", d.size(d.extract("z_s", r"[^\s]+"))), "short": d.size(d.filter("z_len", "z_l", "z_l <= 3")), "long": d.size(d.filter("z_len", "z_l", "z_l >= 12")),
        "score": ladder(("n5 < 5", 0), ("short / cast(n5 as double) >= 0.3 and long >= 1 and short >= 3", 30)),
    }


def buzz_tokens(d: Spark, tokens: str, low: str) -> str:
    """Distinct buzzwords among word tokens and hyphenated words."""
    hyphened = f"case when {d.contains(low, '-')} then {low} else '' end"
    both = d.distinct(d.concat(tokens, d.extract(hyphened, r"\b\w+-\w+(?:-\w+)?\b")))
    return d.intersect(both, d.arr(L.BUZZWORDS))


@signal("h39", "buzzword_density")
def buzz_density(d: Spark) -> Steps:
    return {"k": d.size(buzz_tokens(d, "u", "low")), "rate": "k / cast(nullif(nu, 0) as double) * 100", "score": ladder(("nu <= 50", 0), ("rate >= 3", 40), ("rate >= 1.5", 20))}


@signal("h40", "paragraph_uniformity")
def paragraphs(d: Spark) -> Steps:
    return {"np": d.size("pa"), "z_len": d.map("pa", "z_p", d.size(d.extract("z_p", r"[^\s]+")))} | _cv(d, "z_len", "np") | {"score": ladder(("np <= 2", 0), ("cv < 0.2", 30), ("cv < 0.3", 15))}


@signal("h41", "vocabulary_richness")
def richness(d: Spark) -> Steps:
    return {"ttr": f"{d.size(d.distinct('u'))} / cast(nullif(nu, 0) as double)", "score": ladder(("nu <= 50", 0), ("ttr < 0.4", 25))}


def uniformity(d: Spark, sentences: str, n: str) -> Steps:
    """D2 over an array of sentences; the value holds for each of them."""
    steps = {"z_ul": d.map(sentences, "z_s", d.size(d.extract("z_s", r"[^\s]+")))}
    steps |= {"z_um": mean(d, "z_ul", n), "z_uv": spread(d, "z_ul", n, "z_um"), "z_ucv": "sqrt(z_uv) / nullif(z_um, 0)", "z_ur": f"{d.size(d.filter('z_ul', 'z_l', 'z_l between 12 and 22'))} / cast(nullif({n}, 0) as double)"}
    step = ladder(("z_ucv < 0.15", 60), ("z_ucv < 0.25", 35), ("z_ucv < 0.35", 15))
    return steps | {"uniform": f"cast(case when {n} < 3 or coalesce(z_um, 0) = 0 then 0 when z_ur > 0.7 then least(80, {step} + 20) else {step} end as double)"}


def genre_steps(d: Spark) -> Steps:
    """genre: the first of the best scores over 0.15, else general."""
    base_words = "greatest(1, least(n / 20.0, 10.0))"
    lexical = {g: f"{d.size(d.intersect(d.distinct('w'), d.arr(ws)))} / {base_words}" for g, ws in L.GENRE_WORDS.items() if ws}
    lines = d.filter(d.map(d.split("t0", "\n"), "z_q", d.strip("z_q")), "z_q", "z_q <> ''")
    dashes = f"{_chars(d, 'text', '—')} + {_chars(d, 'text', ' - ')}"
    extra = {
        "casual": f"least(0.5, {d.count('low', L.CONTRACTED)} / greatest(1, n / 50.0))",
        "memoir": f"least(0.5, {d.count('text', L.I_PAST)} / greatest(1, n / 100.0))",
        "literary": f"case when {_chars(d, 'text', ';')} > 2 or {dashes} > 3 then 0.15 else 0 end",
    }
    steps = {
        "z_gl": lines, "z_gn": d.size("z_gl"), "z_gavg": mean(d, d.map("z_gl", "z_s", d.length("z_s")), "z_gn"),
        "z_gopen": f"{d.size(d.filter('z_gl', 'z_s', 'not (' + ' or '.join(d.ends('z_s', c) for c in '.!?') + ')'))} / cast(greatest(1, z_gn) as double)",
        "g_poetry": "cast(case when z_gn = 0 then 0 else case when z_gavg < 60 and z_gn / greatest(1, n / 10.0) > 0.5 then 0.5 else 0 end + case when z_gavg < 40 then 0.3 else 0 end + case when z_gopen > 0.6 then 0.2 else 0 end end as double)",
    }
    for g in L.GENRE_WORDS:
        if g != "poetry":
            steps[f"g_{g}"] = f"cast({lexical[g]} as double)" + (f" + cast({extra[g]} as double)" if g in extra else "")
    order = list(L.GENRE_WORDS)
    steps["g_best"] = "greatest(" + ", ".join(f"g_{g}" for g in order) + ")"
    steps["genre"] = "case when n = 0 or g_best <= 0.15 then 'general' " + " ".join(f"when g_{g} = g_best then '{g}'" for g in order) + " end"
    return steps


@signal("h36", "as_you_know_exposition")
def as_you_know(d: Spark) -> Steps:
    return genre_steps(d) | {"score": ladder(("genre not in ('creative', 'literary')", 0), (d.like("text", L.AS_YOU_KNOW), 30))}
