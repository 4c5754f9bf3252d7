"""DuckDB SQL for every registered query (same parquet tables, pre-registered as views).

Shared fragments are plain SQL text; each query's SQL is complete and standalone.
"""

from __future__ import annotations


def norm(x: str) -> str:
    """normalize_text in DuckDB: class equal to Python's whitespace set."""
    return (r"regexp_replace(regexp_replace(lower(" + x + r"), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), "
            r"'^ | $', '', 'g')")


def norm_mask(x: str) -> str:
    return (r"regexp_replace(regexp_replace(regexp_replace(lower(" + x + r"), '\p{Nd}+', '#', 'g'), "
            r"'[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')")


MENTIONS = r"""
select p_partkey as mention_id,
       case p_partkey % 5
         when 0 then upper(p_name)
         when 1 then concat('  ', p_name, ' ')
         when 2 then replace(p_name, ' ', concat(chr(9), ' '))
         when 3 then concat(p_name, ' ', lower(p_brand))
         else concat(substring(p_name, 1, length(p_name) - 1), ' ', p_type)
       end as mention,
       p_name as entity_name,
       case when cast(floor(p_partkey / 5) as bigint) % 4 = 0 then 'test' else 'train' end as split
from part
"""

ENTITIES = r"""
select dense_rank() over (order by name) - 1 as id, name,
       dense_rank() over (order by split_part(name, ' ', 2)) - 1 as type_id,
       split_part(name, ' ', 2) as type_name
from (select distinct p_name as name from part)
"""


def grams(x: str, n: int = 3) -> str:
    """Character n-grams; a non-empty text shorter than n is one term."""
    return (f"case when length({x}) >= {n} then list_transform(range(1, length({x}) - {n - 2}), "
            f"lambda i: substring({x}, i, {n})) when length({x}) > 0 then [{x}] else [] end")


def nb_ctes(train_sql: str, test_sql: str, alpha: float = 1.0, terms: str = "word") -> str:
    """CTEs ending in ``nb_best(id, label, score)``.

    ``train_sql`` yields (text, label) with label >= 0; ``test_sql`` yields (id, text).
    Texts are raw; they are normalised here. Brute force: every test row is scored
    against every class.
    """
    if terms == "word":
        tr_terms = f"select label, unnest(string_split({norm('text')}, ' ')) as term from nb_train"
        te_terms = f"select id, unnest(string_split({norm('text')}, ' ')) as term from nb_test"
    elif terms == "char3":
        tr_terms = f"select label, unnest({grams(norm('text'))}) as term from nb_train"
        te_terms = f"select id, unnest({grams(norm('text'))}) as term from nb_test"
    else:
        raise ValueError(terms)
    a = repr(float(alpha))
    return f"""
nb_train as ({train_sql}),
nb_test as ({test_sql}),
nb_tt as ({tr_terms}),
nb_counts as (select term, label, count(*) as n_tc from nb_tt where term <> '' group by term, label),
nb_nv as (select count(distinct term) as V from nb_counts),
nb_nn as (select count(*) as N from nb_train),
nb_classes as (
  select c.label, c.n_rows, coalesce(s.n_terms, 0) as n_terms
  from (select label, count(*) as n_rows from nb_train group by label) c
  left join (select label, sum(n_tc) as n_terms from nb_counts group by label) s using (label)),
nb_cw as (select label, ln(n_rows / N) as prior, ln(n_terms + {a} * V) - ln({a}) as per_len
          from nb_classes, nb_nn, nb_nv),
nb_q as ({te_terms}),
nb_known as (select id, term from nb_q where term <> '' and term in (select term from nb_counts)),
nb_lens as (select id, count(*) as L from nb_known group by id),
nb_inc as (select k.id, c.label, sum(ln(c.n_tc + {a}) - ln({a})) as inc
           from nb_known k join nb_counts c using (term) group by k.id, c.label),
nb_sc as (
  select t.id, w.label, w.prior - coalesce(l.L, 0) * w.per_len + coalesce(i.inc, 0) as score
  from nb_test t cross join nb_cw w
  left join nb_lens l on l.id = t.id
  left join nb_inc i on i.id = t.id and i.label = w.label),
nb_best as (
  select id, label, score from (
    select id, label, score,
           row_number() over (partition by id order by round(score, 9) desc, label) as rn
    from nb_sc) where rn = 1)"""


def vocab_cte(train_rel: str) -> str:
    return (f"select dense_rank() over (order by entity_name) - 1 as label_id, entity_name "
            f"from (select distinct entity_name from {train_rel} where entity_name is not null)")


def mention_model_ctes() -> str:
    """Mentions, train/test splits, vocabulary and labelled training rows."""
    return f"""
m as ({MENTIONS}),
m_train as (select * from m where split = 'train'),
m_test as (select * from m where split = 'test'),
vocab as ({vocab_cte('m_train')}),
lab_train as (select t.mention as text, v.label_id as label from m_train t join vocab v using (entity_name))"""


def standardize_sql(test_sql: str, terms: str = "word") -> str:
    """CTEs ending in ``std(id, predicted)`` for (id, text) rows against the mention model."""
    return mention_model_ctes() + "," + nb_ctes("select * from lab_train", test_sql, terms=terms) + """,
std as (select b.id, v.entity_name as predicted from nb_best b left join vocab v on v.label_id = b.label)"""


SQL: dict[str, str] = {}

SQL["standardize_mentions_char3"] = "with " + standardize_sql(
    "select mention_id as id, mention as text from m_test", terms="char3") + """
select t.mention_id, t.mention, s.predicted
from m_test t left join std s on s.id = t.mention_id
"""

SQL["standardize_mentions"] = "with " + standardize_sql(
    "select mention_id as id, mention as text from m_test") + """
select t.mention_id, t.mention, s.predicted
from m_test t left join std s on s.id = t.mention_id
"""

_MENT = "with " + mention_model_ctes()

SQL["vocabulary"] = _MENT + "\nselect label_id, entity_name from vocab"
SQL["vocab_size"] = _MENT + "\nselect count(*) as vocab_size from vocab"

_MENT_IDS = f"""with m as ({MENTIONS}), ent as ({ENTITIES}),
mi as (select m.*, ent.id as entity_id from m join ent on ent.name = m.entity_name)"""

SQL["class_set"] = _MENT_IDS + "\nselect distinct entity_id from mi where split = 'train'"
SQL["encode_labels"] = _MENT + """
select t.mention_id, t.entity_name, coalesce(v.label_id, -1) as label
from m_test t left join vocab v using (entity_name)"""
SQL["decode_labels"] = _MENT + """,
enc as (select t.mention_id, coalesce(v.label_id, -1) as label from m_test t left join vocab v using (entity_name))
select e.mention_id, e.label, v.entity_name as decoded from enc e left join vocab v on v.label_id = e.label"""
SQL["uncovered_classes"] = _MENT_IDS + """
select entity_id from mi where split = 'test'
except
select entity_id from mi where split = 'train' and entity_id <> 0"""
SQL["classification_rows"] = _MENT + f"""
select t.mention_id, {norm('t.mention')} as text, coalesce(v.label_id, -1) as label
from m t left join vocab v using (entity_name)"""
SQL["seq_rows"] = f"""with m as ({MENTIONS})
select mention_id, {norm('mention')} as input, entity_name as output from m"""

SQL["normalize_documents"] = f"select doc_id, {norm('text')} as norm_text from documents"
SQL["normalize_mask_digits"] = f"select doc_id, {norm_mask('text')} as norm_text from documents"
SQL["term_counts"] = f"""
with occ as (select doc_id, unnest(string_split({norm('text')}, ' ')) as term from documents)
select term, count(*) as n_occ, count(distinct doc_id) as n_docs from occ where term <> '' group by term"""

PY_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
JS_WS = r"[\t\n\x0B\f\r\x{00A0}\x{FEFF}\x{2028}\x{2029}\p{Zs}]"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{JS_WS}+|{JS_WS}+$', '', 'g')"


_STRIPPED = py_strip("replace(text, '.', '')")
SQL["strip_markers"] = f"select doc_id, {_STRIPPED} as stripped from documents"
SQL["replace_sentinel_signs"] = """
select vec_id, list_transform(embedding, lambda x: case when sign(x) = -1 then 0 else sign(x)::int end) as tokens
from embeddings"""

LINES = f"""select doc_id, generate_subscripts(arr, 1) - 1 as line_no, unnest(arr) as "from"
from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {js_trim('x')}),
                                 lambda x: length(x) > 0) as arr from documents)"""
SQL["lines_to_rows"] = LINES

SQL["head_100"] = "with " + standardize_sql("select mention_id as id, mention as text from m_test") + """
select t.mention_id, t.mention, s.predicted
from (select * from m_test order by mention_id limit 100) t left join std s on s.id = t.mention_id"""

SQL["batch_infer"] = f"with m as ({MENTIONS}) select mention_id, mention, upper(mention) as pred from m"

SQL["ingest_entities"] = ENTITIES
SQL["ingest_mentions"] = _MENT_IDS + """
select concat(cast(entity_id as varchar), '-', cast(mention_id // 100 as varchar), '#',
              cast(row_number() over (partition by entity_id, mention_id // 100 order by mention_id) - 1 as varchar))
         as mention_id,
       mention, entity_id, entity_name
from mi where split = 'train'"""
SQL["ingest_test_mentions"] = _MENT_IDS + """
select cast(mention_id as varchar) as mention_id, mention, entity_id, entity_name from mi where split = 'test'"""
SQL["quarantine_unresolved"] = _MENT_IDS + """
select mention_id, mention, entity_id from mi where split_part(entity_name, ' ', 2) = 'ring'"""
SQL["csv_roundtrip"] = "select doc_id, text, lang, source, n_chars from documents"
SQL["parquet_roundtrip"] = "select doc_id, text, lang, source, n_chars from documents"


def metrics_sql(pairs_sql: str) -> str:
    """CTEs ending in ``met(accuracy, weighted_precision, weighted_recall, weighted_f1)``."""
    return f"""
pairs as ({pairs_sql}),
conf as (select y, p, count(*) as n from pairs group by y, p),
per as (
  select c, sum(support) as support, sum(tp) as tp, sum(pred) as pred from (
    select y as c, n as support, case when y = p then n else 0 end as tp, 0 as pred from conf
    union all
    select p as c, 0, 0, n from conf) group by c),
per2 as (
  select *, case when pred > 0 then tp / pred else 0.0 end as prec,
            case when support > 0 then tp / support else 0.0 end as rec from per),
per3 as (select *, case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0.0 end as f1 from per2),
met as (
  select round(sum(tp) / sum(support), 9) as accuracy,
         round(sum(support * prec) / sum(support), 9) as weighted_precision,
         round(sum(support * rec) / sum(support), 9) as weighted_recall,
         round(sum(support * f1) / sum(support), 9) as weighted_f1 from per3)"""


_BIN = "select quality as y, toxic as p from labels"
SQL["confusion"] = f"select y, p, count(*) as n from ({_BIN}) group by y, p"
SQL["classification_metrics"] = "with " + metrics_sql(_BIN) + "\nselect * from met"
REPORT_SQL = """
select 0 as line_no, repeat('*', 80) as line
union all select 1, printf('Accuracy: %.5f', accuracy) from met
union all select 2, printf('F1 Score: %.5f', weighted_f1) from met
union all select 3, printf('Precision: %.5f', weighted_precision) from met
union all select 4, printf('Recall: %.5f', weighted_recall) from met"""
SQL["metrics_report"] = "with " + metrics_sql(_BIN) + REPORT_SQL

_DOCS = f"""
d_train as (select * from documents where doc_id % 5 <> 0),
d_test as (select * from documents where doc_id % 5 = 0),
lvocab as (select dense_rank() over (order by lang) - 1 as label_id, lang
           from (select distinct lang from d_train where lang is not null)),
lab_docs as (select t.text, v.label_id as label from d_train t join lvocab v using (lang)),"""
_DOC_NB = "with " + _DOCS + nb_ctes("select * from lab_docs", "select doc_id as id, text from d_test")

SQL["nb_train"] = _DOC_NB + "\nselect term, label, n_tc from nb_counts"
SQL["nb_predict"] = _DOC_NB + """
select b.id as doc_id, b.label, v.lang as predicted from nb_best b left join lvocab v on v.label_id = b.label"""
SQL["model_roundtrip"] = SQL["nb_predict"]
SQL["nb_evaluate"] = _DOC_NB + "," + metrics_sql("""
select coalesce(v.label_id, -1) as y, b.label as p
from d_test t left join lvocab v using (lang) join nb_best b on b.id = t.doc_id""") + "\nselect * from met"


def cosine_sql(k: int, qcond: str = "true", tcond: str = "true") -> str:
    return f"""
with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 5 = 0 and {qcond}),
t as (select vec_id, embedding::double[] as e from embeddings where vec_id % 5 <> 0 and {tcond}),
s as (select q.vec_id as query_id, t.vec_id as neighbour_id,
             list_dot_product(q.e, t.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(t.e, t.e)) + 1e-8)
               as score
      from q cross join t),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, neighbour_id) as rank from s)
select query_id, neighbour_id, round(score, 6) as score, rank from r where rank <= {k}"""


SQL["cosine_top1"] = cosine_sql(1)
SQL["cosine_blocked"] = cosine_sql(1)
SQL["cosine_top3_masked"] = cosine_sql(3, "label >= 5", "label < 5")
SQL["cosine_top3_blocked"] = SQL["cosine_top3_masked"]
SQL["nn_accuracy"] = f"""
with top as ({cosine_sql(1)})
select round(avg(case when q.label = t.label then 1.0 else 0.0 end), 9) as accuracy
from top join embeddings q on q.vec_id = top.query_id join embeddings t on t.vec_id = top.neighbour_id"""


TFIDF = f"""
m as ({MENTIONS}),
m_train as (select * from m where split = 'train'),
m_test as (select * from m where split = 'test'),
ttf as (select id, term, count(*) as tf from
        (select mention_id as id, unnest({grams('mention')}) as term from m_train) group by id, term),
qtf as (select id, term, count(*) as tf from
        (select mention_id as id, unnest({grams('mention')}) as term from m_test) group by id, term),
idf as (select term, ln((n + 1.0) / (count(*) + 1.0)) as idf
        from ttf, (select count(distinct id) as n from ttf) group by term, n),
tw0 as (select id, term, tf * idf as w from ttf join idf using (term)),
qw0 as (select id, term, tf * idf as w from qtf join idf using (term)),
tw as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as w from tw0),
qw as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as w from qw0),
pairs as (select qw.id as query_id, tw.id as neighbour_id, sum(qw.w * tw.w) as score
          from qw join tw using (term) group by qw.id, tw.id),
best as (select * from (
  select *, row_number() over (partition by query_id order by round(score, 9) desc, neighbour_id) as rank
  from pairs where score > 0) where rank = 1)"""

SQL["tfidf_nearest"] = "with " + TFIDF + """
select q.mention_id as query_id, t.mention_id as neighbour_id, round(coalesce(b.score, 0), 6) as score,
  coalesce(b.rank, 1) as rank, t.entity_name as predicted
from m_test q left join best b on b.query_id = q.mention_id
join m_train t on t.mention_id = coalesce(b.neighbour_id, (select min(mention_id) from m_train))"""
SQL["nn_standardize"] = "with " + TFIDF + """
select round(avg(case when t.entity_name = n.entity_name then 1.0 else 0.0 end), 9) as accuracy
from m_test t left join best b on b.query_id = t.mention_id left join m_train n
  on n.mention_id = coalesce(b.neighbour_id, (select min(mention_id) from m_train))"""
SQL["tfidf_vectors"] = f"""
with m as ({MENTIONS}),
tf as (select id, term, count(*) as tf from
       (select mention_id as id, unnest({grams('mention')}) as term from m) group by id, term),
idf as (select term, ln((n + 1.0) / (count(*) + 1.0)) as idf
        from tf, (select count(distinct id) as n from tf) group by term, n),
w0 as (select id, term, tf * idf as w from tf join idf using (term)),
nrm as (select id, sqrt(sum(w * w)) as nm from w0 group by id)
select w0.id as mention_id, w0.term, round(w0.w / nrm.nm, 9) as weight from w0 join nrm using (id) where nrm.nm > 0"""


SQL["tfidf_nearest_indexed"] = SQL["tfidf_nearest"]
SQL["tfidf_documents_top3"] = f"""
with tf as (select id, term, count(*) as tf from
        (select doc_id as id, unnest(string_split({norm('text')}, ' ')) as term from documents) where term <> '' group by id, term),
idf as (select term, ln((n + 1.0) / (count(*) + 1.0)) as idf
        from tf, (select count(distinct id) as n from tf) group by term, n),
w0 as (select id, term, tf * idf as w from tf join idf using (term)),
tw as (select id, term, w / nullif(sqrt(sum(w * w) over (partition by id)), 0) as w from w0),
pairs as (select q.id as query_id, t.id as neighbour_id, sum(q.w * t.w) as score
          from tw q join tw t on q.term = t.term and q.id % 20 = 0 group by q.id, t.id)
select query_id, neighbour_id, round(score, 6) as score, rank from (
  select *, row_number() over (partition by query_id order by round(score, 9) desc, neighbour_id) as rank
  from pairs where score > 0) where rank <= 3"""
SQL["cosine_pruned"] = cosine_sql(1)
SQL["cells_top3"] = """
with e as (select vec_id, embedding::double[] as e from embeddings),
s as (select q.vec_id as query_id, t.vec_id as neighbour_id,
        list_dot_product(q.e, t.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(t.e, t.e)) + 1e-8) as score
      from e q cross join e t where q.vec_id % 20 = 0)
select query_id, neighbour_id, round(score, 6) as score, rank from (
  select *, row_number() over (partition by query_id order by round(score, 9) desc, neighbour_id) as rank from s) where rank <= 3"""
SQL["cells_recall"] = '''
select count(distinct embedding) as n_queries, true as recall_reached from embeddings where vec_id % 20 = 0'''


def ws_split(x: str) -> str:
    """Python str.split() in DuckDB."""
    s = py_strip(x)
    return f"case when length({s}) = 0 then []::varchar[] else string_split_regex({s}, '{PY_WS}+') end"


RULES_13A_SQL = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]


def tok13a(x: str) -> str:
    c = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = f"replace({c}, '{a}', '{b}')"
    c = f"(' ' || {c} || ' ')"
    for pat, rep in RULES_13A_SQL:
        c = f"regexp_replace({c}, '{pat}', '{rep}', 'g')"
    return c


def bleu_sql(tokenize: str) -> str:
    h = "hypothesis" if tokenize == "none" else tok13a("hypothesis")
    r = "reference" if tokenize == "none" else tok13a("reference")
    orders = "\nunion all ".join(
        f"select row, {n} as n, unnest(list_transform(range(0, len(tok) - {n - 1}), "
        f"lambda i: array_to_string(tok[i + 1:i + {n}], ' '))) as g from SIDE"
        for n in range(1, 5))
    return f"""
with pairs as (select h.text as hypothesis, r.text as reference
               from conversations h join conversations r on r.conv_id = h.conv_id and r.turn = h.turn + 1),
tok as (select row_number() over () as row, {ws_split(h)} as htok, {ws_split(r)} as rtok from pairs),
hs as (select row, htok as tok from tok), rs as (select row, rtok as tok from tok),
hg as (select row, n, g, count(*) as ch from ({orders.replace('SIDE', 'hs')}) group by row, n, g),
rg as (select row, n, g, count(*) as cr from ({orders.replace('SIDE', 'rs')}) group by row, n, g),
cl as (select n, sum(least(ch, coalesce(cr, 0))) as m from hg left join rg using (row, n, g) group by n),
st as (select sum(len(htok)) as sys_len, sum(len(rtok)) as ref_len,
              sum(greatest(len(htok) - 0, 0)) as total_1, sum(greatest(len(htok) - 1, 0)) as total_2,
              sum(greatest(len(htok) - 2, 0)) as total_3, sum(greatest(len(htok) - 3, 0)) as total_4 from tok),
c as (select coalesce(sum(m) filter (where n = 1), 0) as correct_1, coalesce(sum(m) filter (where n = 2), 0) as correct_2,
             coalesce(sum(m) filter (where n = 3), 0) as correct_3, coalesce(sum(m) filter (where n = 4), 0) as correct_4
      from cl),
z as (select *,
        (correct_1 = 0)::int as z1, (correct_1 = 0)::int + (correct_2 = 0)::int as z2,
        (correct_1 = 0)::int + (correct_2 = 0)::int + (correct_3 = 0)::int as z3,
        (correct_1 = 0)::int + (correct_2 = 0)::int + (correct_3 = 0)::int + (correct_4 = 0)::int as z4
      from st, c),
p as (select *,
        case when correct_1 > 0 then 100.0 * correct_1 / total_1 else 100.0 / (pow(2.0, z1) * total_1) end as p1,
        case when correct_2 > 0 then 100.0 * correct_2 / total_2 else 100.0 / (pow(2.0, z2) * total_2) end as p2,
        case when correct_3 > 0 then 100.0 * correct_3 / total_3 else 100.0 / (pow(2.0, z3) * total_3) end as p3,
        case when correct_4 > 0 then 100.0 * correct_4 / total_4 else 100.0 / (pow(2.0, z4) * total_4) end as p4,
        case when sys_len >= ref_len then 1.0 when sys_len = 0 then 0.0 else exp(1.0 - ref_len / sys_len) end as bp
      from z)
select round(case when (correct_1 = 0 and correct_2 = 0 and correct_3 = 0 and correct_4 = 0)
                    or total_1 = 0 or total_2 = 0 or total_3 = 0 or total_4 = 0 then 0.0
                  else bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4.0) end, 6) as bleu,
       round(bp, 9) as brevity_penalty, sys_len::bigint as sys_len, ref_len::bigint as ref_len,
       correct_1::bigint as correct_1, correct_2::bigint as correct_2, correct_3::bigint as correct_3,
       correct_4::bigint as correct_4, total_1::bigint as total_1, total_2::bigint as total_2,
       total_3::bigint as total_3, total_4::bigint as total_4
from p"""


SQL["corpus_bleu"] = bleu_sql("none")
SQL["corpus_bleu_13a"] = bleu_sql("13a")


def ibm1_ctes(iterations: int = 5) -> str:
    """CTEs ending in ``t{iterations}(s, t, p)`` over the training mentions."""
    parts = [f"""
m as ({MENTIONS}),
m_train as (select * from m where split = 'train'),
m_test as (select * from m where split = 'test'),
srcw as (select mention_id as row, s, count(*) as ms from
         (select mention_id, unnest(string_split({norm('mention')}, ' ')) as s from m_train) where s <> ''
         group by all),
tgtw as (select mention_id as row, t, count(*) as mt from
         (select mention_id, unnest({ws_split('entity_name')}) as t from m_train) group by all),
rows_ as (select * from srcw join tgtw using (row)),
t0 as (select distinct s, t, 1.0 as p from rows_)"""]
    for i in range(1, iterations + 1):
        parts.append(f"""
j{i} as (select r.row, r.s, r.t, r.mt, r.ms * x.p as w from rows_ r join t{i - 1} x using (s, t)),
e{i} as (select s, t, w / sum(w) over (partition by row, t) * mt as c from j{i}),
c{i} as (select s, t, sum(c) as c from e{i} group by s, t),
t{i} as (select s, t, c / sum(c) over (partition by s) as p from c{i})""")
    return ",".join(parts)


SQL["translate_table"] = "with " + ibm1_ctes() + "\nselect s, t, round(p, 6) as p from t5"

GEN = "with " + ibm1_ctes() + f""",
best as (select s, t, p from (
  select *, row_number() over (partition by s order by round(p, 9) desc, t) as rk from t5) where rk = 1
  and round(p, 9) >= 0.5),
toks as (select mention_id, generate_subscripts(arr, 1) as pos, unnest(arr) as s from
         (select mention_id, list_filter(string_split({norm('mention')}, ' '), lambda x: x <> '') as arr from m_test)),
em as (select k.mention_id, k.pos, b.t from toks k join best b using (s)),
firsts as (select mention_id, t, min(pos) as pos from em group by mention_id, t),
gen as (select mention_id, string_agg(t, ' ' order by pos) as generated from
        firsts group by mention_id),
g as (select t.mention_id, t.mention, t.entity_name, coalesce(gen.generated, '') as generated
      from m_test t left join gen using (mention_id))"""
SQL["generate_names"] = GEN + "\nselect mention_id, mention, generated from g"
SQL["generation_exact_match"] = GEN + """
select round(avg(case when entity_name = generated then 1.0 else 0.0 end), 9) as exact_match from g"""

SQL["map_lines"] = "with " + f"lines as ({LINES})," + standardize_sql(
    "select concat(doc_id, ':', line_no) as id, \"from\" as text from lines") + """
select l.doc_id, l.line_no, l."from", coalesce(nullif(s.predicted, ''), '(no match)') as "to"
from lines l left join std s on s.id = concat(l.doc_id, ':', l.line_no)"""

SQL["request_response"] = "with " + standardize_sql("select mention_id as id, mention as text from m_test") + """
select t.mention_id // 100 as request_id,
       to_json({'results': list(coalesce(s.predicted, '') order by t.mention_id)}) as response
from m_test t left join std s on s.id = t.mention_id group by t.mention_id // 100"""

SQL["standardize_stream"] = "with " + _DOCS + nb_ctes("select * from lab_docs", "select doc_id as id, text from documents") + """
select b.id as doc_id, b.label, v.lang as predicted from nb_best b left join lvocab v on v.label_id = b.label"""

SQL["nb_report"] = _DOC_NB + "," + metrics_sql("""
select coalesce(v.label_id, -1) as y, b.label as p
from d_test t left join lvocab v using (lang) join nb_best b on b.id = t.doc_id""") + REPORT_SQL
SQL["cosine_consecutive"] = """
select a.vec_id,
       round(list_dot_product(a.embedding::double[], b.embedding::double[])
             / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]))
                * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) + 1e-8), 6) as cosine
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"""

SKETCH = f"""
m as ({MENTIONS}),
g as (select id, unnest({grams('x')}) as term from (select mention_id as id, {norm('mention')} as x from m)),
h as (select id, cast(concat('0x', substring(md5(term), 1, 8)) as bigint) as code from g),
s as (select id, code % 64 as entry, sum(1 - 2 * ((code // 64) % 2)) as s from h group by id, entry),
z as (select id, cast(entry as integer) as entry, s / sqrt(sum(s * s) over (partition by id)) as weight from s where s <> 0)"""
SQL["sketch_entries"] = "with " + SKETCH + "\nselect id as mention_id, entry, round(weight, 9) as weight from z"
SQL["sketch_nearest"] = "with " + SKETCH + """,
p as (select q.id as query_id, t.id as neighbour_id, sum(q.weight * t.weight) / (1 + 1e-8) as score
      from z q join m a on a.mention_id = q.id and a.split = 'test'
      join z t on t.entry = q.entry join m b on b.mention_id = t.id and b.split = 'train' group by q.id, t.id),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, neighbour_id) as rank from p)
select query_id, neighbour_id, round(score, 6) as score, rank, b.entity_name as predicted
from r join m b on b.mention_id = neighbour_id where rank = 1"""

SQL["csv_roundtrip_split"] = SQL["csv_roundtrip"]
for _name in ("ingest_entities", "ingest_mentions", "ingest_test_mentions"):
    SQL[f"{_name}_document"] = SQL[_name]

# Normal equations of one-hot ridge regression, solved by Gauss-Jordan elimination on a list of rows.
RIDGE = "with recursive " + _DOCS + f"""
tk as (select doc_id, unnest(string_split({norm('text')}, ' ')) as term from documents),
hc as (select doc_id, cast(concat('0x', substring(md5(term), 1, 8)) as bigint) as code from tk where term <> ''),
hs as (select doc_id, code % 32 as entry, cast(sum(1 - 2 * ((code // 32) % 2)) as bigint) as s from hc group by doc_id, code % 32),
fx as (select doc_id, entry, cast(floor(1024 * s / sqrt(cast(sum(s * s) over (partition by doc_id) as double)) + 0.5) as bigint) as v
       from hs where s <> 0 union all select doc_id, 32, 1024 from documents),
tr as (select t.doc_id, v.label_id as label from d_train t join lvocab v using (lang)),
ft as (select f.*, t.label from fx f join tr t using (doc_id)),
gm as (select a.entry as i, b.entry as j, cast(sum(a.v * b.v) as double) / 1048576 as v
       from ft a join ft b using (doc_id) group by a.entry, b.entry),
rh as (select entry as i, 33 + label as j, cast(sum(v) as double) / 1024 as v from ft group by entry, label),
ce as (select r.i, c.j, coalesce(g.v, h.v, 0) + case when r.i = c.j then 1.0 else 0.0 end as v
       from (select unnest(range(0, 33)) as i) r
       cross join (select unnest(range(0, 33 + (select count(*) from lvocab))) as j) c
       left join gm g on g.i = r.i and g.j = c.j left join rh h on h.i = r.i and h.j = c.j),
rw as (select i, list(v order by j) as r from ce group by i),
gj as (select 0 as k, list(r order by i) as m from rw
       union all
       select k + 1, list_transform(m, lambda row, i: list_transform(row, lambda x, j:
         case when i = k + 1 then x / m[k + 1][k + 1] else x - row[k + 1] * (m[k + 1][j] / m[k + 1][k + 1]) end))
       from gj where k < 33),
wt as (select l.label_id as label, e.entry, m[e.entry + 1][34 + l.label_id] as w
       from gj, lvocab l, (select unnest(range(0, 33)) as entry) e where k = 33),
sc as (select f.doc_id, w.label, round(sum(f.v * w.w) / 1024, 9) as score
       from fx f join d_test using (doc_id) join wt w using (entry) group by f.doc_id, w.label),
rp as (select doc_id, label, score from (
         select *, row_number() over (partition by doc_id order by score desc, label) as rn from sc) where rn = 1)"""
SQL["ridge_train"] = RIDGE + "\nselect label, cast(entry as integer) as entry, round(w, 6) as weight from wt"
SQL["ridge_predict"] = RIDGE + """
select p.doc_id, p.label, round(p.score, 6) as score, v.lang as predicted from rp p join lvocab v on v.label_id = p.label"""
SQL["ridge_evaluate"] = RIDGE + "," + metrics_sql("""
select coalesce(v.label_id, -1) as y, b.label as p
from d_test t left join lvocab v using (lang) join rp b using (doc_id)""") + "\nselect * from met"

SQL["classifier_report"] = "select line from (" + SQL["nb_report"] + ")"
SQL["generation_report"] = "select printf('Exact Match: %.5f', exact_match) as line from (" + SQL["generation_exact_match"] + ")"
