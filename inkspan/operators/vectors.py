"""Vectors: answers of a classifier put together, products of stored vectors, topics of paragraphs by TF-IDF."""

from __future__ import annotations

from inkspan.functions.dialect import WORD, Spark
from inkspan.operators.profile import FUNCTION
from inkspan.operators.udfs import BUCKETS

#: Most terms of a text's vocabulary, the commonest first.
TERMS = 1000


def answers(d: Spark) -> str:
    """N5, N6 over logits (here the first four numbers of a vector as a chunk's, its label as the document): softmax, the weighted
    probability and its label, the mean of each bucket and the commonest one (of equally common ones the first)."""
    x = lambda k: f"cast(embedding[{k if d.name == 'spark' else k + 1}] as double)"
    names = [n.replace("-", "_") for n in BUCKETS]
    logits = ", ".join(f"{x(k)} as l{k}" for k in range(4))
    top = "greatest(l0, l1, l2, l3)"
    soft = ", ".join(f"exp(l{k} - {top}) as e{k}" for k in range(4))
    share = ", ".join(f"e{k} / (e0 + e1 + e2 + e3) as p{k}" for k in range(4))
    ai = " + ".join(f"{w} * p{k}" for k, w in enumerate(BUCKETS.values()))
    first = "case " + " ".join(f"when p{k} = greatest(p0, p1, p2, p3) then {k}" for k in range(4)) + " end"
    counts = ", ".join(f"sum(case when z_top = {k} then 1 else 0 end) as n{k}" for k in range(4))
    modal = "case " + " ".join(f"when n{k} = greatest(n0, n1, n2, n3) then '{n}'" for k, n in enumerate(names)) + " end"
    return f"""with z_l as (select label as doc_id, {logits} from {{embeddings}}), z_e as (select doc_id, {soft} from z_l), z_p as (select doc_id, {share} from z_e), z_a as (select *, {ai} as ai, {first} as z_top from z_p),
      z_g as (select doc_id, avg(ai) as ai, {', '.join(f'round(avg(p{k}), 4) as {n}' for k, n in enumerate(names))}, {counts} from z_a group by doc_id)
      select doc_id, round(ai, 4) as ai_probability, case when ai >= 0.7 then 'ai' when ai >= 0.4 then 'mixed' else 'human' end as label, {modal} as modal_bucket, {', '.join(names)} from z_g"""


def products(d: Spark) -> str:
    """Product of two unit vectors; here each vector with the next one."""
    if d.name == "spark":
        dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"
    else:
        dot = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]))"
    norm = lambda v: f"nullif(sqrt({dot(v, v)}), 0)"
    return f"select a.vec_id as vec_id, round({dot('a.embedding', 'b.embedding')} / {norm('a.embedding')} / {norm('b.embedding')}, 6) as similarity from {{embeddings}} a join {{embeddings}} b on b.vec_id = a.vec_id + 1"


def topics(d: Spark) -> str:
    """Elements 61 to 63 of texts of three and more paragraphs (here the turns of a conversation): drift between neighbours,
    coherence with the whole, and the share of the heaviest fifth of terms.

    Terms are words of two and more letters that aren't function words; the cosine of each paragraph with the mean of all is,
    averaged, that mean's length, so that no pairs are made.
    """
    stop = d.member("term", FUNCTION)
    token = d.explode("z_par", "conv_id, para", "z_words", "term", "at_w")
    return f"""with z_all as (select conv_id, row_number() over (partition by conv_id order by turn) as para, lower(text) as text from {{conversations}} where text is not null),
      z_n as (select conv_id, count(*) as n from z_all group by conv_id having count(*) >= 3), z_par as (select a.conv_id as conv_id, a.para as para, {d.extract('a.text', WORD)} as z_words from z_all a join z_n n on a.conv_id = n.conv_id),
      z_tok as ({token}), z_term as (select conv_id, para, term, count(*) as tf from z_tok where length(term) >= 2 and not {stop} group by conv_id, para, term),
      z_voc as (select conv_id, term, sum(tf) as total, count(*) as df, row_number() over (partition by conv_id order by sum(tf) desc, term) as place from z_term group by conv_id, term),
      z_w as (select t.conv_id as conv_id, t.para as para, t.term as term, n.n as n, t.tf * (ln((1 + n.n) / cast(1 + v.df as double)) + 1) as w from z_term t join z_voc v on t.conv_id = v.conv_id and t.term = v.term join z_n n on t.conv_id = n.conv_id where v.place <= {TERMS}),
      z_norm as (select conv_id, para, sqrt(sum(w * w)) as norm from z_w group by conv_id, para),
      z_u as (select w.conv_id as conv_id, w.para as para, w.term as term, w.n as n, w.w / m.norm as u from z_w w join z_norm m on w.conv_id = m.conv_id and w.para = m.para),
      z_near as (select a.conv_id as conv_id, sum(a.u * b.u) as together from z_u a join z_u b on a.conv_id = b.conv_id and a.term = b.term and b.para = a.para + 1 group by a.conv_id),
      z_sum as (select conv_id, term, max(n) as n, sum(u) as s from z_u group by conv_id, term),
      z_rank as (select *, row_number() over (partition by conv_id order by s desc, term) as place, count(*) over (partition by conv_id) as terms from z_sum),
      z_end as (select conv_id, max(n) as n, sqrt(sum(s * s)) as whole, sum(case when place <= greatest(1, floor(terms / 5.0)) then s else 0 end) / sum(s) as top from z_rank group by conv_id)
      select e.conv_id as conv_id, round(1 - coalesce(r.together, 0) / (e.n - 1), 6) as topic_drift_rate, round(e.whole / e.n, 6) as topic_coherence_score, round(e.top, 6) as vocabulary_concentration from z_end e left join z_near r on e.conv_id = r.conv_id"""


QUERIES = {"n05_bucket_means": answers, "n07_products": products, "v04_topic_elements": topics}
