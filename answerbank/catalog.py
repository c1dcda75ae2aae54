"""Registered queries (one per operator family) and their DuckDB oracle SQL.

Each query reads the driver tables through ``sources.tables`` views and
returns a DataFrame; the oracle with the same name computes the same columns
in DuckDB. Floats are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerbank import oracle as O
from answerbank.functions import rouge as R
from answerbank.functions import text as X
from answerbank.operators import blend as B
from answerbank.operators import compare as CMP
from answerbank.operators import fusion as FU
from answerbank.operators import learn as L
from answerbank.operators import sample as SM
from answerbank.operators import profile as P
from answerbank.operators import sweep as SW
from answerbank.plans.blocks import dense_topk
from answerbank.operators import similarity as sim
from answerbank.operators.tfidf import TfidfSettings
from answerbank.sources import files as FS
from answerbank.sources import tables as T
from answerbank.streaming import resume as RES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Retrieval defaults of the lexical baseline: padded-word character 3-5 grams.
BASELINE = TfidfSettings()
# Script defaults: raw character 2-4 grams, sublinear tf, 100k terms.
SCRIPT = TfidfSettings(analyzer="char", ngram_min=2, ngram_max=4, max_features=100_000, sublinear_tf=True)
# Whole documents: word unigrams and bigrams.
DOC_WORDS = TfidfSettings(analyzer="word", ngram_min=1, ngram_max=2, max_features=None)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _qa_cte(view_sql: str) -> str:
    return f"""qa as ({view_sql}),
bank as (select * from qa where split = 'bank'),
qry as (select * from qa where split = 'query')"""


def r6(c):
    return F.round(c, 6)


# --- J1/J2: global top-1 --------------------------------------------------------

def _top1_sql(view_sql: str, s: TfidfSettings) -> str:
    return f"""with {_qa_cte(view_sql)}, {O.topk_ctes(s, 'bank', 'qry', 1, [])}
select t.qid, b.id as matched_id, round(t.score, 6) as similarity, coalesce(b.answer, '') as prediction
from top t join bank b on b.pos = t.pos"""


@register("top1_match", _top1_sql(T.CONV_QA_SQL, BASELINE))
def top1_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    out = sim.top1_predict(bank, q, BASELINE)
    return out.select("qid", "matched_id", r6(F.col("similarity")).alias("similarity"), "prediction")


# --- R1-R4, A5: ROUGE -------------------------------------------------------------

@register(
    "rouge_rows",
    f"""with qa as ({T.CONV_QA_SQL}), s as ({O.rouge_select('qa', 'answer', 'question', 'id')})
select id, round(r1, 6) as rouge1, round(rl, 6) as rouge_l, round(0.5 * r1 + 0.5 * rl, 6) as weighted from s""",
)
def rouge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ROUGE of every QA pair, taking the question itself as the prediction (input-only answer)."""
    qa = T.conv_qa(spark, sf_dir)
    s = qa.select("id", R.rouge("answer", "question").alias("r"))
    return s.select(
        "id",
        r6(F.col("r.rouge1")).alias("rouge1"),
        r6(F.col("r.rouge_l")).alias("rouge_l"),
        r6(R.weighted(F.col("r"))).alias("weighted"),
    )


def score_corpus(pred: DataFrame, refs: DataFrame) -> DataFrame:
    """A5: mean ROUGE-1, ROUGE-L and weighted score of predictions joined to references by id.

    A reference without a prediction is an error (never paired by position).
    """
    j = refs.select(F.col("qid"), F.col("answer").alias("reference")).join(
        pred.select("qid", "prediction", F.lit(True).alias("__found")), "qid", "left"
    )
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.col("qid").cast("string")))
    j = j.withColumn("prediction", F.when(F.col("__found").isNull(), missing).otherwise(F.col("prediction")))
    s = j.select(R.rouge("reference", "prediction").alias("r"))
    return s.agg(
        F.coalesce(F.avg("r.rouge1"), F.lit(0.0)).alias("rouge1_f1"),
        F.coalesce(F.avg("r.rouge_l"), F.lit(0.0)).alias("rouge_l_f1"),
        F.count("*").alias("rows"),
    ).select(
        r6(F.col("rouge1_f1")).alias("rouge1_f1"),
        r6(F.col("rouge_l_f1")).alias("rouge_l_f1"),
        r6(0.5 * F.col("rouge1_f1") + 0.5 * F.col("rouge_l_f1")).alias("weighted_without_llm"),
        "rows",
    )


@register(
    "retrieval_score",
    f"""with p as ({_top1_sql(T.CONV_QA_SQL, BASELINE)}), qa as ({T.CONV_QA_SQL}),
j as (select q.answer, p.prediction from qa q join p on p.qid = q.id where q.split = 'query'),
s as ({O.rouge_select('j', 'answer', 'prediction', '1 as one')})
select round(coalesce(avg(r1), 0), 6) as rouge1_f1, round(coalesce(avg(rl), 0), 6) as rouge_l_f1,
       round(0.5 * coalesce(avg(r1), 0) + 0.5 * coalesce(avg(rl), 0), 6) as weighted_without_llm, count(*) as rows from s""",
)
def retrieval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical top-1 answers for the query split, scored against their references (the flagship)."""
    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    pred = sim.top1_predict(bank, q, BASELINE)
    return score_corpus(pred, q)


# --- A1-A4: profile ----------------------------------------------------------------

_QW = O.word_count("question")
_AW = O.word_count("answer")


@register(
    "table_profile",
    f"""with qa as ({T.CONV_QA_SQL}),
s as (select split, count(*) as rows, 6 as columns,
  sum((id is null)::bigint + (question is null)::bigint + (answer is null)::bigint + (subset is null)::bigint
      + (split is null)::bigint + (pos is null)::bigint) as missing_cells,
  round(coalesce(avg({_QW}), 0), 6) as question_words_mean, round(coalesce(quantile_cont({_QW}, 0.95), 0), 6) as question_words_p95,
  round(coalesce(avg({_AW}), 0), 6) as answer_words_mean, round(coalesce(quantile_cont({_AW}, 0.95), 0), 6) as answer_words_p95
  from qa group by split),
d as (select split, count(*) as n from (select distinct * from qa) group by split)
select s.*, s.rows - d.n as duplicate_rows from s join d using (split)""",
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(T.conv_qa(spark, sf_dir), "question", "answer", split_col="split")


@register(
    "subset_counts",
    "select coalesce(cast(lang as varchar), 'UNKNOWN') as value, count(*) as count from documents group by 1",
)
def subset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_counts(T.table(spark, sf_dir, "documents"), "lang")


# --- P1-P5, P8, P16, P17: text scalars -------------------------------------------------

@register(
    "text_scalars",
    f"""with qa as ({T.CONV_QA_SQL})
select id, length({O.norm('question')}) as q_norm_chars, {_QW} as q_words, {_AW} as a_words,
  {O.trim_words_keep('answer', 30)} as a_trim_keep_30, {O.trim_words('answer', 30)} as a_trim_30,
  {O.combine(O.trim_words('question', 10), O.trim_words('answer', 12), 'input_pred')} as combo_input_pred,
  {O.combine(O.trim_words('question', 10), O.trim_words('answer', 12), 'pred_input')} as combo_pred_input,
  {O.combine('question', 'answer', 'input_only')} as combo_input_only,
  'query: ' || coalesce(question, '') as q_prefixed,
  round({O.jaccard(f"list_distinct({O.words('question')})", f"list_distinct({O.words('answer')})")}, 6) as token_jaccard,
  round({O.overlap(f"list_distinct({O.words('question')})", f"list_distinct({O.words('answer')})")}, 6) as token_overlap,
  round({O.jaccard(O.lower_words('question'), O.lower_words('answer'))}, 6) as word_jaccard,
  round({O.jaccard(O.lower_chars('question'), O.lower_chars('answer'))}, 6) as char_jaccard,
  cast(starts_with(coalesce(answer, ''), coalesce(question, '')) as int) as starts_with_question,
  round({_AW} / greatest({_QW}, 1), 6) as a_to_q_words
from qa""",
)
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = T.conv_qa(spark, sf_dir)
    qw, aw = X.word_count("question"), X.word_count("answer")
    qs, as_ = X.token_set("question"), X.token_set("answer")
    return qa.select(
        "id",
        F.length(X.normalize_ws("question")).alias("q_norm_chars"),
        qw.alias("q_words"),
        aw.alias("a_words"),
        X.trim_words_keep("answer", 30).alias("a_trim_keep_30"),
        X.trim_words("answer", 30).alias("a_trim_30"),
        X.combine(X.trim_words("question", 10), X.trim_words("answer", 12), "input_pred").alias("combo_input_pred"),
        X.combine(X.trim_words("question", 10), X.trim_words("answer", 12), "pred_input").alias("combo_pred_input"),
        X.combine(F.col("question"), F.col("answer"), "input_only").alias("combo_input_only"),
        X.prefix("question", "query: ").alias("q_prefixed"),
        r6(X.jaccard(qs, as_)).alias("token_jaccard"),
        r6(X.overlap_ratio(qs, as_)).alias("token_overlap"),
        r6(X.jaccard(X.lower_word_set("question"), X.lower_word_set("answer"))).alias("word_jaccard"),
        r6(X.jaccard(X.lower_char_set("question"), X.lower_char_set("answer"))).alias("char_jaccard"),
        X.fill_empty("answer").startswith(X.fill_empty("question")).cast("int").alias("starts_with_question"),
        r6(X.length_ratio(aw, qw)).alias("a_to_q_words"),
    )


# --- V1-V9: vocabulary and weights -----------------------------------------------------

VOCAB_CUT = SCRIPT.with_(min_df=2, max_features=5000)


@register(
    "tfidf_vocabulary",
    f"""with {_qa_cte(T.CONV_QA_SQL)}, {O.tfidf_ctes(VOCAB_CUT, 'bank', 'qry', [])}
select term, df, cast(ctf as bigint) as ctf, round(idf, 6) as idf from voc""",
)
def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerbank.operators.tfidf import fit_vocabulary, term_counts

    bank, _ = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    counts = term_counts(bank, "pos", "question", VOCAB_CUT)
    n = bank.agg(F.count("*").alias("n"))
    v = fit_vocabulary(counts, n, VOCAB_CUT)
    return v.select("term", "df", F.col("ctf").cast("long").alias("ctf"), r6(F.col("idf")).alias("idf"))


WB_WORDS = TfidfSettings(analyzer="word", ngram_min=1, ngram_max=1, max_features=None, min_df=1, max_df=0.9,
                         smooth_idf=False, binary=True)


@register(
    "tfidf_weights",
    f"""with {_qa_cte(T.CONV_QA_SQL)}, {O.tfidf_ctes(WB_WORDS, 'bank', 'qry', [])}
select id as qid, term, round(w, 6) as w from qw""",
)
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from answerbank.operators.tfidf import fit_transform

    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    _, _, qp = fit_transform(bank, q, WB_WORDS)
    return qp.select(F.col("id").alias("qid"), "term", r6(F.col("w")).alias("w"))


# --- J3-J6: top-k, grouped, per-group settings, scope ------------------------------------------

@register(
    "topk_match",
    f"""with {_qa_cte(T.CONV_QA_SQL)}, {O.topk_ctes(SCRIPT, 'bank', 'qry', 5, [])}
select qid, pos as matched_id, rank, round(score, 6) as similarity from top""",
)
def topk_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    top = sim.topk_scores(bank, q, SCRIPT, 5)
    return top.select("qid", F.col("pos").alias("matched_id"), "rank", r6(F.col("score")).alias("similarity"))


def _grouped_sql(view_sql: str, s: TfidfSettings) -> str:
    return f"""with {_qa_cte(view_sql)},
qin as (select * from qry where subset in (select subset from bank)),
qout as (select * from qry where subset is null or subset not in (select subset from bank where subset is not null)),
{O.topk_ctes(s, 'bank', 'qin', 1, ['subset'], 'g_')},
{O.topk_ctes(s, 'bank', 'qout', 1, [], 'a_')}
select t.qid, b.id as matched_id, round(t.score, 6) as similarity, coalesce(b.answer, '') as prediction
from (select qid, pos, score from g_top union all select qid, pos, score from a_top) t join bank b on b.pos = t.pos"""


@register("grouped_top1", _grouped_sql(T.CONV_QA_SQL, BASELINE))
def grouped_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    out = sim.grouped_top1(bank, q, BASELINE, "subset")
    return out.select("qid", "matched_id", r6(F.col("similarity")).alias("similarity"), "prediction")


GROUP_OVERRIDES = {"s1": {"analyzer": "char", "ngram_min": 2, "ngram_max": 4, "sublinear_tf": True},
                   "s2": {"analyzer": "word", "ngram_min": 1, "ngram_max": 2, "max_features": None}}


def _group_settings_sql() -> str:
    parts = []
    ctes = []
    listed = ", ".join(f"'{g}'" for g in GROUP_OVERRIDES)
    ctes.append(f"q_def as (select * from qry where subset is null or subset not in ({listed}))")
    ctes.append(O.topk_ctes(BASELINE, "bank", "q_def", 1, [], "d_"))
    parts.append("select qid, pos, score from d_top")
    for i, (g, o) in enumerate(GROUP_OVERRIDES.items()):
        ctes.append(f"q_{i} as (select * from qry where subset = '{g}')")
        ctes.append(O.topk_ctes(BASELINE.with_(**o), "bank", f"q_{i}", 1, [], f"o{i}_"))
        parts.append(f"select qid, pos, score from o{i}_top")
    return f"""with {_qa_cte(T.CONV_QA_SQL)}, {', '.join(ctes)}
select t.qid, b.id as matched_id, round(t.score, 6) as similarity, coalesce(b.answer, '') as prediction
from ({' union all '.join(parts)}) t join bank b on b.pos = t.pos"""


@register("group_settings_top1", _group_settings_sql())
def group_settings_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    out = sim.group_settings_top1(bank, q, BASELINE, GROUP_OVERRIDES, "subset")
    return out.select("qid", "matched_id", r6(F.col("similarity")).alias("similarity"), "prediction")


@register(
    "scoped_topk",
    f"""with {_qa_cte(T.CONV_QA_SQL)},
qs as (select * from qry where subset = 's0'),
qa_ as (select * from qry where subset is null or subset <> 's0'),
{O.topk_ctes(SCRIPT, 'bank', 'qs', 3, ['subset'], 's_')},
{O.topk_ctes(SCRIPT, 'bank', 'qa_', 3, [], 'a_')}
select qid, pos as matched_id, rank, round(score, 6) as similarity from s_top
union all select qid, pos as matched_id, rank, round(score, 6) as similarity from a_top""",
)
def scoped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    out = sim.scoped_topk(bank, q, SCRIPT, 3, group_col="subset", default_scope="all", scopes={"s0": "same_group"})
    return out.select("qid", F.col("pos").alias("matched_id"), "rank", r6(F.col("similarity")).alias("similarity"))


@register(
    "doc_topk",
    f"""with {_qa_cte(T.DOC_SPLIT_SQL)}, {O.topk_ctes(DOC_WORDS, 'bank', 'qry', 5, [])}
select qid, pos as matched_id, rank, round(score, 6) as similarity from top""",
)
def doc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against whole documents: word 1-2 gram TF-IDF, top 5 (blocked scorer at scale)."""
    bank, q = T.bank_and_queries(T.doc_split(spark, sf_dir), keep=False)
    top = sim.topk_scores(bank, q, DOC_WORDS, 5)
    return top.select("qid", F.col("pos").alias("matched_id"), "rank", r6(F.col("score")).alias("similarity"))


# --- J7-J15: fusion ---------------------------------------------------------------------

WORDS12 = TfidfSettings(analyzer="word", ngram_min=1, ngram_max=2, max_features=None)
GENERATORS = [SCRIPT, BASELINE, WORDS12]


def _union_sql(k: int, m: int) -> str:
    ctes = [O.topk_ctes(g, "bank", "qry", k, [], f"g{i}_") for i, g in enumerate(GENERATORS)]
    union = " union all ".join(f"select qid, pos, score, {i} as gen from g{i}_top" for i in range(len(GENERATORS)))
    return f"""{_qa_cte(T.CONV_QA_SQL)}, {', '.join(ctes)},
u as (select *, max(round(score, 9)) over (partition by qid, pos) as mx from ({union})),
m as (select qid, pos, max(score) as max_score, sum(score) as score_sum, count(*) as generator_count,
      min(case when round(score, 9) = mx then gen end) as best_generator from u group by qid, pos),
r as (select *, score_sum / greatest(generator_count, 1) as mean_score,
      row_number() over (partition by qid order by round(max_score, 9) desc, pos) as rank from m qualify rank <= {m})"""


@register(
    "union_candidates",
    f"""with {_union_sql(5, 8)}
select qid, pos as matched_id, rank, round(max_score, 6) as max_score, round(score_sum, 6) as score_sum,
       generator_count, round(mean_score, 6) as mean_score, best_generator from r""",
)
def union_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    u = FU.tracked_union(bank, q, GENERATORS, 5, 8)
    return u.select(
        "qid", F.col("pos").alias("matched_id"), "rank", r6(F.col("max_score")).alias("max_score"),
        r6(F.col("score_sum")).alias("score_sum"), "generator_count", r6(F.col("mean_score")).alias("mean_score"),
        F.col("best_generator").cast("int").alias("best_generator"),
    )


_VEC_SQL = """vq as (select vec_id as qid, cast(embedding as double[]) as vec, label from embeddings where vec_id % 5 = 0),
vb as (select vec_id as pos, cast(embedding as double[]) as vec, label from embeddings where vec_id % 5 <> 0)"""


def _vec_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = T.vectors(spark, sf_dir)
    q = v.where(F.col("vid") % 5 == 0).select(F.col("vid").alias("qid"), "vec", "label")
    b = v.where(F.col("vid") % 5 != 0).select(F.col("vid").alias("pos"), "vec", "label")
    return q, b


@register(
    "dense_topk",
    f"""with {_VEC_SQL},
s as (select q.qid, b.pos, list_inner_product(q.vec, b.vec) as score from vq q join vb b on q.label = b.label)
select qid, pos as matched_id, rank, round(score, 6) as similarity from
 (select *, row_number() over (partition by qid order by round(score, 9) desc, pos) as rank from s) where rank <= 3""",
)
def dense_topk_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dot-product top-3 inside each label group (all pairs, blocked)."""
    q, b = _vec_split(spark, sf_dir)
    top = dense_topk(q, b, 3, ["label"])
    return top.select("qid", F.col("pos").alias("matched_id"), "rank", r6(F.col("score")).alias("similarity"))


@register(
    "dense_pivot_top1",
    f"""with {_VEC_SQL},
s as (select q.qid, b.pos, list_inner_product(q.vec, b.vec) as score from vq q cross join (select * from vb where label = 0) b)
select qid, pos as matched_id, round(score, 6) as similarity from
 (select *, row_number() over (partition by qid order by round(score, 9) desc, pos) as rank from s) where rank = 1""",
)
def dense_pivot_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best row of a filtered pivot bank (label 0) for every query vector."""
    q, b = _vec_split(spark, sf_dir)
    top = dense_topk(q.drop("label"), b.where(F.col("label") == 0).drop("label"), 1)
    return top.select("qid", F.col("pos").alias("matched_id"), r6(F.col("score")).alias("similarity"))


RERANK_WEIGHTS = {"s1": 0.6, "s3": 0.0}
_QAV = T.QA_VECTORS_SQL.format(qa=T.CONV_QA_SQL)


def _weight_sql(group: str) -> str:
    cases = " ".join(f"when {group} = '{g}' then {w}" for g, w in RERANK_WEIGHTS.items())
    return f"(case {cases} else 0.3 end)"


@register(
    "semantic_rerank",
    f"""with {_qa_cte(T.CONV_QA_SQL)}, {O.topk_ctes(SCRIPT, 'bank', 'qry', 10, [])},
v as ({_QAV}),
s as (select t.qid, t.pos, t.score, list_inner_product(vq.vec, vb.vec) as dense, q.subset
      from top t join v vq on vq.id = t.qid join v vb on vb.id = t.pos join qry q on q.id = t.qid),
b as (select *, (1 - {_weight_sql('subset')}) * score + {_weight_sql('subset')} * dense as blend from s),
r as (select *, row_number() over (partition by qid order by round(blend, 9) desc, round(score, 9) desc, pos) as rk from b)
select r.qid, bank.id as matched_id, round(blend, 6) as similarity, coalesce(bank.answer, '') as prediction
from r join bank on bank.pos = r.pos where rk = 1""",
)
def semantic_rerank_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical top-10 reranked with encoder vectors, per-subset blend weights."""
    qa = T.conv_qa(spark, sf_dir)
    bank, q = T.bank_and_queries(qa)
    vec = T.qa_vectors(spark, sf_dir, qa)
    top = sim.topk_scores(bank, q, SCRIPT, 10)
    best = FU.semantic_rerank(top, vec, vec, q, default_weight=0.3, weights_by_group=RERANK_WEIGHTS)
    out = sim.attach_answers(best.select("qid", "pos", F.col("similarity").alias("score")), bank)
    return out.select("qid", "matched_id", r6(F.col("similarity")).alias("similarity"), "prediction")


@register(
    "union_rerank",
    f"""with {_union_sql(5, 8)}, v as ({_QAV}),
s as (select t.qid, t.pos, t.max_score as score, list_inner_product(vq.vec, vb.vec) as dense, q.subset
      from r t join v vq on vq.id = t.qid join v vb on vb.id = t.pos join qry q on q.id = t.qid),
b as (select *, (1 - {_weight_sql('subset')}) * score + {_weight_sql('subset')} * dense as blend from s),
rr as (select *, row_number() over (partition by qid order by round(blend, 9) desc, round(score, 9) desc, pos) as rk from b)
select rr.qid, bank.id as matched_id, round(blend, 6) as similarity, coalesce(bank.answer, '') as prediction
from rr join bank on bank.pos = rr.pos where rk = 1""",
)
def union_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked union of three generators, then the semantic blend."""
    qa = T.conv_qa(spark, sf_dir)
    bank, q = T.bank_and_queries(qa)
    vec = T.qa_vectors(spark, sf_dir, qa)
    u = FU.tracked_union(bank, q, GENERATORS, 5, 8).withColumnRenamed("max_score", "score")
    best = FU.semantic_rerank(u, vec, vec, q, default_weight=0.3, weights_by_group=RERANK_WEIGHTS)
    out = sim.attach_answers(best.select("qid", "pos", F.col("similarity").alias("score")), bank)
    return out.select("qid", "matched_id", r6(F.col("similarity")).alias("similarity"), "prediction")


def _hybrid_frames(spark: SparkSession, sf_dir: str):
    qa = T.conv_qa(spark, sf_dir)
    bank, q = T.bank_and_queries(qa)
    vec = T.qa_vectors(spark, sf_dir, qa)
    qv = q.select("qid").join(vec.withColumnRenamed("id", "qid"), "qid")
    bv = bank.select("pos").join(vec.withColumnRenamed("id", "pos"), "pos")
    dense = dense_topk(qv, bv, 6)
    lexical = sim.topk_scores(bank, q, BASELINE, 4)
    return bank, q, FU.hybrid_fusion(dense, lexical, dense_weight=1.0, lexical_weight=0.15, max_candidates=5)


_HYBRID_SQL = f"""{_qa_cte(T.CONV_QA_SQL)}, {O.topk_ctes(BASELINE, 'bank', 'qry', 4, [])}, v as ({_QAV}),
ds as (select q.id as qid, b.pos, list_inner_product(vq.vec, vb.vec) as score
       from qry q join v vq on vq.id = q.id cross join bank b join v vb on vb.id = b.pos),
dt as (select * from ds qualify row_number() over (partition by qid order by round(score, 9) desc, pos) <= 6),
j as (select coalesce(d.qid, t.qid) as qid, coalesce(d.pos, t.pos) as pos,
      greatest(coalesce(d.score, 0.0), 0.0) as dense_score, greatest(coalesce(t.score, 0.0), 0.0) as tfidf_score
      from dt d full outer join top t on d.qid = t.qid and d.pos = t.pos),
f as (select *, 1.0 * dense_score + 0.15 * tfidf_score as combined_score,
      row_number() over (partition by qid order by round(1.0 * dense_score + 0.15 * tfidf_score, 9) desc, pos) as rank
      from j qualify rank <= 5)"""


@register(
    "hybrid_fusion",
    f"""with {_HYBRID_SQL}
select qid, pos as matched_id, rank, round(dense_score, 6) as dense_score, round(tfidf_score, 6) as tfidf_score,
       round(combined_score, 6) as combined_score from f""",
)
def hybrid_fusion_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense top-6 and lexical top-4 fused (missing = 0, negatives clamp to 0), best 5 kept."""
    _, _, f = _hybrid_frames(spark, sf_dir)
    return f.select(
        "qid", F.col("pos").alias("matched_id"), "rank", r6(F.col("dense_score")).alias("dense_score"),
        r6(F.col("tfidf_score")).alias("tfidf_score"), r6(F.col("combined_score")).alias("combined_score"),
    )


@register(
    "pair_rerank",
    f"""with {_HYBRID_SQL},
ps as (select f.qid, f.pos, f.rank, f.combined_score,
       {O.jaccard(f"list_distinct({O.words('q.question')})", f"list_distinct({O.words('b.question')})")} as pair_score
       from f join qry q on q.id = f.qid join bank b on b.pos = f.pos where f.rank <= 3),
w as (select *, row_number() over (partition by qid order by round(pair_score, 9) desc nulls last, rank) as rk from ps)
select qid, pos as matched_id, round(combined_score, 6) as similarity, round(pair_score, 6) as pair_score from w where rk = 1""",
)
def pair_rerank_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second stage over the first 3 fused candidates, scored by a pair-score table
    (here the token Jaccard of the two questions, standing in for a cross-encoder's output)."""
    bank, q, f = _hybrid_frames(spark, sf_dir)
    pairs = (
        f.select("qid", "pos")
        .join(q.select("qid", X.token_set("question").alias("qs")), "qid")
        .join(bank.select("pos", X.token_set("question").alias("bs")), "pos")
        .select("qid", "pos", X.jaccard(F.col("qs"), F.col("bs")).alias("pair_score"))
    )
    best = FU.pair_rerank(f, pairs, top_r=3)
    return best.select(
        "qid", F.col("pos").alias("matched_id"), r6(F.col("similarity")).alias("similarity"),
        r6(F.col("pair_score")).alias("pair_score"),
    )


def shared_words_scorer() -> FU.PairScorer:
    """A small stand-in for a cross-encoder: twice the shared distinct words over all distinct words of both texts."""

    def score(questions: list[str], answers: list[str]) -> list[float]:
        sides = [[set(text.split(" ")) - {""} for text in texts] for texts in (questions, answers)]
        return [2.0 * len(x & y) / max(1, len(x) + len(y)) for x, y in zip(*sides)]

    return score


def _distinct_words(expr: str) -> str:
    return f"list_distinct(list_filter(string_split(coalesce({expr}, ''), ' '), lambda x: x <> ''))"


@register(
    "pair_scorer",
    f"""with {_qa_cte(T.CONV_QA_SQL)}, {O.topk_ctes(BASELINE, 'bank', 'qry', 5, [])},
w as (select t.qid, t.pos, t.rank, t.score, {_distinct_words('q.question')} as x, {_distinct_words('b.answer')} as y
      from top t join qry q on q.id = t.qid join bank b on b.pos = t.pos),
s as (select *, 2.0 * len(list_intersect(x, y)) / greatest(1, len(x) + len(y)) as pair_score from w)
select qid, pos as matched_id, round(score, 6) as similarity, round(pair_score, 6) as pair_score from s
qualify row_number() over (partition by qid order by round(pair_score, 9) desc, rank) = 1""",
)
def pair_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and candidate answer scored by a function over batches of pairs, best of the lexical top 5."""
    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    top = sim.topk_scores(bank, q, BASELINE, 5).withColumnRenamed("score", "combined_score")
    pairs = top.select("qid", "pos").join(q.select("qid", "question"), "qid").join(bank.select("pos", "answer"), "pos")
    best = FU.pair_rerank(top, FU.score_pairs(pairs, shared_words_scorer))
    return best.select(
        "qid", F.col("pos").alias("matched_id"), r6(F.col("similarity")).alias("similarity"),
        r6(F.col("pair_score")).alias("pair_score"),
    )


MEMBERS = [
    (BASELINE, 1.0),
    (SCRIPT, 1.0),
    (WORDS12, 0.5),
    (TfidfSettings(analyzer="char_wb", ngram_min=2, ngram_max=4), 1.0),
]


def _ensemble_sql() -> str:
    ctes = [O.topk_ctes(s, "bank", "qry", 1, [], f"m{i}_") for i, (s, _) in enumerate(MEMBERS)]
    union = " union all ".join(
        f"select t.qid, b.id as matched_id, t.score as similarity, coalesce(b.answer, '') as prediction, {i} as member, "
        f"{w} as weight from m{i}_top t join bank b on b.pos = t.pos"
        for i, (_, w) in enumerate(MEMBERS)
    )
    return f"""with {_qa_cte(T.CONV_QA_SQL)}, {', '.join(ctes)}, u as ({union}),
g as (select qid, prediction, sum(weight) as vote_weight, sum(similarity * weight) as similarity_weight,
      max(similarity) as best_similarity, arg_min(matched_id, member) as matched_id, min(member) as first_member
      from u group by qid, prediction),
r as (select *, row_number() over (partition by qid order by round(vote_weight, 9) desc, round(similarity_weight, 9) desc,
      round(best_similarity, 9) desc, first_member) as rk from g)
select qid, matched_id, round(best_similarity, 6) as similarity, prediction from r where rk = 1"""


@register("ensemble_vote", _ensemble_sql())
def ensemble_vote_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four retrieval members vote by answer text."""
    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    members = [(sim.top1_predict(bank, q, s), w) for s, w in MEMBERS]
    out = FU.ensemble_vote(members)
    return out.select("qid", "matched_id", r6(F.col("similarity")).alias("similarity"), "prediction")


# --- J17-J22, P6, P7, P11-P13, S7/S8: blends, judge, cleaning, output --------------------

def _runs(spark: SparkSession, sf_dir: str):
    """Source rows (query split) and two prediction runs derived from them by retrieval."""
    qa = T.conv_qa(spark, sf_dir)
    bank, q = T.bank_and_queries(qa)
    source = q.select(F.col("qid").alias("ID"), "question", "answer", "subset", "pos")
    base = sim.top1_predict(bank, q, BASELINE).select(F.col("qid").alias("ID"), "prediction", "similarity")
    alt = sim.top1_predict(bank, q, SCRIPT).select(F.col("qid").alias("ID"), "prediction", "similarity")
    return source, base, alt


_RUNS_SQL = f"""rb as ({_top1_sql(T.CONV_QA_SQL, BASELINE)}), ra as ({_top1_sql(T.CONV_QA_SQL, SCRIPT)}),
src as (select id as "ID", question, answer, subset, pos from ({T.CONV_QA_SQL}) where split = 'query'),
base as (select qid as "ID", prediction, similarity from rb), alt as (select qid as "ID", prediction, similarity from ra)"""


@register(
    "coverage_join",
    f"""with {_RUNS_SQL}
select s."ID", b.prediction, coalesce(s.answer, '') as reference from src s left join base b on b."ID" = s."ID" """,
)
def coverage_join_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, base, _ = _runs(spark, sf_dir)
    j = B.coverage_join(source.select("ID", "answer"), base.select("ID", "prediction"))
    return j.select("ID", "prediction", X.fill_empty("answer").alias("reference"))


@register(
    "subset_override",
    f"""with {_RUNS_SQL}
select s."ID", case when s.subset in ('s1', 's3') then a.prediction else b.prediction end as prediction
from src s left join base b on b."ID" = s."ID" left join alt a on a."ID" = s."ID" """,
)
def subset_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, base, alt = _runs(spark, sf_dir)
    return B.override_by_subset(source, base, alt, ["s1", "s3"])


@register(
    "id_override",
    f"""with {_RUNS_SQL},
rep as (select a."ID", a.prediction from alt a join base b on a."ID" = b."ID" where round(a.similarity, 9) > round(b.similarity, 9))
select s."ID", coalesce(r.prediction, b.prediction) as prediction
from src s left join base b on b."ID" = s."ID" left join rep r on r."ID" = s."ID" """,
)
def id_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace the baseline where the second run is more confident (a replacement table by ID)."""
    source, base, alt = _runs(spark, sf_dir)
    rep = alt.alias("a").join(base.alias("b"), "ID").where(
        F.round(F.col("a.similarity"), 9) > F.round(F.col("b.similarity"), 9)
    ).select("ID", F.col("a.prediction").alias("prediction"))
    return B.override_by_id(source, base, rep)


_JC, _JF, _JR = O.parse_decision("raw")


@register(
    "judge_parse",
    f"""with j as ({T.JUDGE_RAW_SQL})
select id, {_JC} as choice, round({_JF}, 6) as confidence, {_JR} as reason from j""",
)
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13 over a table of judge replies (JSON after a think block, free text, none, other JSON)."""
    d = T.judge_raw(spark, sf_dir).select("id", X.parse_decision("raw").alias("d"))
    return d.select("id", "d.choice", r6(F.col("d.confidence")).alias("confidence"), "d.reason")


def _qa_replies(source: DataFrame) -> DataFrame:
    """Judge replies for QA rows, four reply shapes keyed by ID (the model's output table)."""
    i = F.col("ID")
    raw = (
        F.when(i % 4 == 0, F.concat(F.lit('{"choice": "B", "confidence": 0.'), F.lpad((i % 97).cast("string"), 2, "0"),
                                     F.lit(', "reason": "more direct"}')))
        .when(i % 4 == 1, F.lit("Answer B is better, confidence: 0.9"))
        .when(i % 4 == 2, F.lit("A"))
        .otherwise(F.lit('<think>compare</think>{"choice": "b", "confidence": 1.5}'))
    )
    return source.select("ID", raw.alias("raw"))


_REPLIES_SQL = """replies as (select "ID", case "ID" % 4
  when 0 then '{"choice": "B", "confidence": 0.' || lpad(cast("ID" % 97 as varchar), 2, '0') || ', "reason": "more direct"}'
  when 1 then 'Answer B is better, confidence: 0.9' when 2 then 'A'
  else '<think>compare</think>{"choice": "b", "confidence": 1.5}' end as raw from src)"""
_RC, _RF, _RR = O.parse_decision("raw")
GATE_SUBSETS = ("s0", "s2")
GATE_LIMIT = 5


def _judge_gate_sql(which: str) -> str:
    return f"""with {_RUNS_SQL}, {_REPLIES_SQL},
dec as (select "ID", {_RC} as choice, {_RF} as confidence, {_RR} as reason from replies),
j as (select s."ID", s.subset, s.pos, {O.strip('b.prediction')} as bp, {O.strip('a.prediction')} as cp
      from src s left join base b on b."ID" = s."ID" left join alt a on a."ID" = s."ID"),
e as (select *, subset in {GATE_SUBSETS} and cp <> '' and cp <> bp as elig from j),
n as (select *, case when elig then row_number() over (partition by subset, elig order by pos) end as n from e),
g as (select n.*, d.choice, d.confidence as cf, d.reason as rs, elig and {which} as judged
      from n left join dec d on d."ID" = n."ID")
select "ID", subset,
  case when judged and choice = 'B' and cf >= 0.68 then cp else bp end as prediction,
  coalesce(judged and choice = 'B' and cf >= 0.68, false) as used_candidate,
  round(case when judged then cf else 0.0 end, 6) as confidence,
  case when judged then rs when elig then 'limit_reached' else 'not_target_subset' end as decision_reason
from g"""


def _judge_gate(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    source, base, alt = _runs(spark, sf_dir)
    replies = _qa_replies(source)
    dec = replies.select("ID", X.parse_decision("raw").alias("d")).select("ID", "d.choice", "d.confidence", "d.reason")
    g = B.judge_gate(source, base, alt, dec, list(GATE_SUBSETS), limit_per_subset=limit)
    return g.select("ID", "subset", "prediction", "used_candidate", r6(F.col("confidence")).alias("confidence"),
                    "decision_reason")


@register("judge_gate", _judge_gate_sql("true"))
def judge_gate_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20 (+P13 on the replies, A9 via ``used_candidate``): base vs second run, every eligible row of two subsets judged."""
    return _judge_gate(spark, sf_dir, None)


@register("judge_gate_limited", _judge_gate_sql(f"n <= {GATE_LIMIT}"))
def judge_gate_limited_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20 with its limit option: the first ``GATE_LIMIT`` eligible rows of a subset in source order are judged."""
    return _judge_gate(spark, sf_dir, GATE_LIMIT)


def _raw_generations(source: DataFrame) -> DataFrame:
    i = F.col("ID")
    raw = (
        F.when(i % 3 == 0, F.concat(F.lit("Here is the rewritten answer:\n\n"), F.col("answer")))
        .when(i % 3 == 1, F.concat(F.col("answer"), F.lit("\n\nI removed repeated sentences.")))
        .otherwise(F.lit(""))
    )
    return source.select("ID", raw.alias("raw"))


_GEN_SQL = f"""gen as (select "ID", {O.clean_generation("raw")} as prediction from (select "ID", case "ID" % 3
  when 0 then 'Here is the rewritten answer:' || chr(10) || chr(10) || answer
  when 1 then answer || chr(10) || chr(10) || 'I removed repeated sentences.' else '' end as raw from src))"""


def _generation_override_sql(which: str) -> str:
    return f"""with {_RUNS_SQL}, {_GEN_SQL},
j as (select s."ID", s.subset, s.pos, {O.strip('b.prediction')} as bp, {O.strip('g.prediction')} as gp
      from src s left join base b on b."ID" = s."ID" left join gen g on g."ID" = s."ID"),
t as (select *, subset = 's1' and {which} as target from j)
select "ID", case when target and coalesce(gp, '') <> '' then gp else bp end as prediction from t"""


def _generation_override(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    source, base, _ = _runs(spark, sf_dir)
    gen = _raw_generations(source).select("ID", X.clean_generation("raw").alias("prediction"))
    return B.generation_override(source, base, gen, ["s1"], limit_per_subset=limit)


@register("generation_override", _generation_override_sql("true"))
def generation_override_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J21 + P11: cleaned generated answers for every row of subset s1, base elsewhere."""
    return _generation_override(spark, sf_dir, None)


@register(
    "generation_override_limited",
    _generation_override_sql("row_number() over (partition by subset = 's1', subset order by pos) <= 4"),
)
def generation_override_limited_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J21 with its limit option: the first 4 rows of subset s1 in source order."""
    return _generation_override(spark, sf_dir, 4)


@register(
    "text_cleaning",
    f"""with c as (select conv_id, turn, text, case turn % 3
   when 0 then 'Here is the rewritten answer:' || chr(10) || chr(10) || text
   when 1 then 'Rewritten answer draft' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'I removed repeated sentences.'
   else text end as graw,
 case turn % 2 when 0 then '"Translation: ' || text || '"' else 'Answer: ' || text end as traw from conversations)
select conv_id, turn, {O.clean_generation('graw')} as generation, {O.clean_translation('traw')} as translation from c""",
)
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11/P12 over every conversation turn wrapped in model-reply shapes."""
    c = T.table(spark, sf_dir, "conversations")
    t = F.col("text")
    graw = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here is the rewritten answer:\n\n"), t))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("Rewritten answer draft\n\n"), t, F.lit("\n\nI removed repeated sentences.")))
        .otherwise(t)
    )
    traw = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"Translation: '), t, F.lit('"'))).otherwise(
        F.concat(F.lit("Answer: "), t)
    )
    return c.select("conv_id", "turn", X.clean_generation(graw).alias("generation"), X.clean_translation(traw).alias("translation"))


RULES = [
    # subset, mode, cap, input_cap, prediction_cap, feature, op, threshold
    ("s0", "input_pred", 40, None, None, "pred_words", ">", 30.0),
    ("s1", "pred_input", None, 10, 20, None, None, None),
    ("s2", "input_only", None, None, None, "input_words", "<=", 25.0),
]
RULES_SCHEMA = ("subset string, mode string, cap int, input_cap int, prediction_cap int, "
                "feature string, op string, threshold double")


def _rules_sql() -> str:
    rows = []
    for sub, mode, cap, ic, pc, feat, op, th in RULES:
        def v(x):
            return "null" if x is None else (f"'{x}'" if isinstance(x, str) else str(x))
        rows.append(f"({v(sub)}, {v(mode)}, {v(cap)}, {v(ic)}, {v(pc)}, {v(feat)}, {v(op)}, {v(th)})")
    return ("rules(subset, mode, cap, input_cap, prediction_cap, feature, op, threshold) as (values "
            + ", ".join(rows) + ")")


def _rule_expr() -> str:
    q, p = "s.question", "b.prediction"
    iw, pw = O.word_count(q), O.word_count(p)
    value = f"(case r.feature when 'input_words' then {iw} when 'pred_words' then {pw} end)"
    cond = (f"(case r.op when '<=' then {value} <= r.threshold when '>=' then {value} >= r.threshold "
            f"when '<' then {value} < r.threshold when '>' then {value} > r.threshold end)")
    applies = f"(r.subset is not null and (r.feature is null or coalesce({cond}, false)))"
    split = "(r.input_cap is not null or r.prediction_cap is not null)"

    def comb(a: str, b_: str) -> str:
        sa, sb = O.strip(a), O.strip(b_)
        return (f"(case r.mode when 'input_pred' then {O.strip(f'({sa} || chr(32) || {sb})')} "
                f"when 'pred_input' then {O.strip(f'({sb} || chr(32) || {sa})')} when 'input_only' then {sa} end)")

    def tw(x: str, cap: str) -> str:
        return f"(case when {cap} is null then {O.strip(x)} else array_to_string(list_slice({O.words(x)}, 1, {cap}), ' ') end)"

    whole = tw(comb(q, p), "r.cap")
    parts = comb(tw(q, "r.input_cap"), tw(p, "r.prediction_cap"))
    return f"(case when {applies} and {split} then {parts} when {applies} then {whole} else {O.strip(p)} end)"


@register(
    "hybrid_rules",
    f"""with {_RUNS_SQL}, {_rules_sql()}
select s."ID", {_rule_expr()} as prediction from src s left join base b on b."ID" = s."ID" left join rules r on r.subset = s.subset""",
)
def hybrid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional per-subset question+prediction hybrids over the base run."""
    source, base, _ = _runs(spark, sf_dir)
    rules = spark.createDataFrame(RULES, RULES_SCHEMA)
    return B.apply_rules(source, base, rules)


CAPS = [("s0", 20), ("s1", 50)]


@register(
    "subset_trim",
    f"""with {_RUNS_SQL}, caps(subset, max_words) as (values {', '.join(f"('{a}', {b})" for a, b in CAPS)})
select s."ID", case when c.max_words is null or len({O.words('b.prediction')}) <= c.max_words then {O.strip('b.prediction')}
  else array_to_string(list_slice({O.words('b.prediction')}, 1, c.max_words), ' ') end as prediction
from src s left join base b on b."ID" = s."ID" left join caps c on c.subset = s.subset""",
)
def subset_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-subset word caps on the base run (P4a keeps spacing of texts that fit)."""
    source, base, _ = _runs(spark, sf_dir)
    caps = spark.createDataFrame(CAPS, "subset string, max_words int")
    return B.cap_by_subset(source, base, caps)


@register(
    "submission",
    f"""with {_RUNS_SQL}, {_rules_sql()},
h as (select s."ID", {_rule_expr()} as prediction from src s left join base b on b."ID" = s."ID" left join rules r on r.subset = s.subset)
select s."ID", coalesce(h.prediction, '') as "TargetRLF1", coalesce(h.prediction, '') as "TargetR1F1",
       coalesce(h.prediction, '') as "TargetLLM" from src s left join h on h."ID" = s."ID" """,
)
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validated four-column output built from the hybrid-rule predictions."""
    source, base, _ = _runs(spark, sf_dir)
    rules = spark.createDataFrame(RULES, RULES_SCHEMA)
    out = B.build_submission(source, B.apply_rules(source, base, rules))
    B.validate_submission(out)
    return out


# --- K1-K3, A8, A10, W9: sweeps ---------------------------------------------------------

def _sv(x) -> str:
    return "null::integer" if x is None else (f"'{x}'" if isinstance(x, str) else str(x))


def _tw_col(x: str, cap: str) -> str:
    return f"(case when {cap} is null then {O.strip(x)} else array_to_string(list_slice({O.words(x)}, 1, {cap}), ' ') end)"


def _rule_sweep_sql() -> str:
    specs = ", ".join(f"({i}, {_sv(m)}, {_sv(c)}, {_sv(ic)}, {_sv(pc)})" for i, m, c, ic, pc in SW.rule_specs())
    conds = ", ".join(f"('{f}', '{op}', {t})" for f, ts in SW.THRESHOLDS.items() for t in ts for op in ("<=", ">"))
    qt, pt = _tw_col("r.q", "sp.input_cap"), _tw_col("r.p", "sp.prediction_cap")
    comb = (f"(case sp.mode when 'input_only' then {qt} when 'input_pred' then {O.strip(f'({qt} || chr(32) || {pt})')} "
            f"when 'pred_input' then {O.strip(f'({pt} || chr(32) || {qt})')} end)")
    cand = _tw_col(comb, "sp.cap")
    return f"""with {_RUNS_SQL},
rows_ as (select s."ID", s.subset, coalesce(s.question, '') as q, coalesce(b.prediction, '') as p, coalesce(s.answer, '') as ref
          from src s join base b on b."ID" = s."ID"),
specs(spec_id, mode, cap, input_cap, prediction_cap) as (values {specs}),
conds(feature, op, t) as (values {conds}),
bs as (select "ID", subset, {O.word_count('q')} as iw, {O.word_count('p')} as pw, 0.5 * r1 + 0.5 * rl as base
       from ({O.rouge_select('rows_', 'ref', 'p', '"ID", subset, q, p')})),
cand as (select r."ID", sp.spec_id, {cand} as cand from rows_ r cross join specs sp),
texts as (select distinct c."ID", c.cand, r.ref from cand c join rows_ r on r."ID" = c."ID"),
scored as (select "ID", cand, 0.5 * r1 + 0.5 * rl as score from ({O.rouge_select('texts', 'ref', 'cand', '"ID", cand')})),
per_row as (select b.subset, c.spec_id, b.iw, b.pw, sc.score - b.base as d
            from cand c join scored sc on sc."ID" = c."ID" and sc.cand = c.cand join bs b on b."ID" = c."ID"),
sizes as (select subset, count(*) as n, avg(base) as base_score from bs group by subset),
allr as (select subset, spec_id, 'all' as condition, null::bigint as n_changed, sum(d) as dsum from per_row group by all),
cx as (select p.subset, p.spec_id, c.feature || c.op || cast(c.t as varchar) as condition,
       count(*) filter (where case when c.op = '<=' then (case when c.feature = 'input_words' then p.iw else p.pw end) <= c.t
                                   else (case when c.feature = 'input_words' then p.iw else p.pw end) > c.t end) as n_changed,
       coalesce(sum(d) filter (where case when c.op = '<=' then (case when c.feature = 'input_words' then p.iw else p.pw end) <= c.t
                                   else (case when c.feature = 'input_words' then p.iw else p.pw end) > c.t end), 0) as dsum
       from per_row p cross join conds c group by all),
u as (select * from allr union all select * from cx)
select u.subset, u.spec_id, sp.mode, sp.cap, sp.input_cap, sp.prediction_cap, u.condition,
       coalesce(u.n_changed, z.n) as n_changed, round(z.base_score, 6) as base_score,
       round(z.base_score + u.dsum / z.n, 6) as score, round(u.dsum / z.n, 6) as delta
from u join sizes z on z.subset = u.subset join specs sp on sp.spec_id = u.spec_id
where u.n_changed is null or (u.n_changed > 0 and u.n_changed < z.n)"""


@register("rule_sweep", _rule_sweep_sql())
def rule_sweep_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 + A10: 142 question/prediction hybrid specs x 36 length conditions, per subset, on the base run."""
    source, base, _ = _runs(spark, sf_dir)
    rows = source.join(base.select("ID", "prediction"), "ID").select(
        "ID", "subset", "question", "prediction", F.col("answer").alias("reference")
    )
    out = SW.rule_sweep(rows)
    return out.select(
        "subset", "spec_id", "mode", "cap", "input_cap", "prediction_cap", "condition",
        F.col("n_changed").cast("long").alias("n_changed"), r6(F.col("base_score")).alias("base_score"),
        r6(F.col("score")).alias("score"), r6(F.col("delta")).alias("delta"),
    )


def _depth_frames(spark: SparkSession, sf_dir: str):
    qa = T.conv_qa(spark, sf_dir)
    bank, q = T.bank_and_queries(qa)
    vec = T.qa_vectors(spark, sf_dir, qa)
    top = sim.topk_scores(bank, q, SCRIPT, max(SW.DEPTHS))
    ranked = FU.with_dense(top, vec, vec).join(
        q.select("qid", "subset", X.fill_empty("answer").alias("reference")), "qid"
    ).select("qid", "subset", "pos", "rank", F.col("score").alias("tfidf"), F.col("dense_score").alias("dense"), "reference")
    answers = bank.select("pos", X.fill_empty("answer").alias("prediction"))
    return SW.depth_weight_sweep(ranked, answers)


def _depth_sql() -> str:
    grid = ", ".join(f"({i}, {k}, cast({w} as double))" for i, (k, w) in enumerate(
        [(k, w) for k in SW.DEPTHS for w in SW.WEIGHTS]))
    return f"""with {_qa_cte(T.CONV_QA_SQL)}, {O.topk_ctes(SCRIPT, 'bank', 'qry', max(SW.DEPTHS), [])}, v as ({_QAV}),
rk as (select t.qid, q.subset, t.pos, t.rank, t.score as tfidf, list_inner_product(vq.vec, vb.vec) as dense,
       coalesce(q.answer, '') as reference
       from top t join qry q on q.id = t.qid join v vq on vq.id = t.qid join v vb on vb.id = t.pos),
grid(grid, top_k, semantic_weight) as (values {grid}),
c as (select r.*, g.grid, g.top_k, g.semantic_weight, (1 - g.semantic_weight) * tfidf + g.semantic_weight * dense as blend
      from rk r join grid g on r.rank <= g.top_k),
b as (select * from c qualify row_number() over (partition by grid, qid order by round(blend, 9) desc, round(tfidf, 9) desc, pos) = 1),
j as (select b.*, coalesce(bank.answer, '') as prediction from b join bank on bank.pos = b.pos),
s as ({O.rouge_select('j', 'reference', 'prediction', 'subset, grid, top_k, semantic_weight, qid')}),
res as (select subset, grid, top_k, semantic_weight, count(*) as n, avg(r1) as rouge1_f1, avg(rl) as rouge_l_f1,
        0.5 * avg(r1) + 0.5 * avg(rl) as weighted_without_llm from s group by all)"""


@register(
    "depth_weight_sweep",
    f"""{_depth_sql()}
select subset, top_k, semantic_weight, n, round(rouge1_f1, 6) as rouge1_f1, round(rouge_l_f1, 6) as rouge_l_f1,
       round(weighted_without_llm, 6) as weighted_without_llm from res""",
)
def depth_weight_sweep_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: 4 depths x 11 blend weights per subset over one shared lexical top-30 list."""
    res = _depth_frames(spark, sf_dir)
    return res.select(
        "subset", "top_k", "semantic_weight", "n", r6(F.col("rouge1_f1")).alias("rouge1_f1"),
        r6(F.col("rouge_l_f1")).alias("rouge_l_f1"), r6(F.col("weighted_without_llm")).alias("weighted_without_llm"),
    )


@register(
    "depth_weight_best",
    f"""{_depth_sql()},
best as (select * from res qualify row_number() over (partition by subset order by round(weighted_without_llm, 9) desc, grid) = 1)
select subset, top_k, semantic_weight, n, round(weighted_without_llm, 6) as weighted_without_llm,
       round(sum(weighted_without_llm * n) over () / sum(n) over (), 6) as weighted_subset_best from best""",
)
def depth_weight_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9 + A8: best grid point per subset (earlier point wins ties) and the row-weighted mean of the bests."""
    best = SW.weighted_mean_of_bests(SW.best_per_subset(_depth_frames(spark, sf_dir)))
    return best.select(
        "subset", "top_k", "semantic_weight", "n", r6(F.col("weighted_without_llm")).alias("weighted_without_llm"),
        r6(F.col("weighted_subset_best")).alias("weighted_subset_best"),
    )


GRID = SW.retrieval_grid_settings()


def _grid_family_ctes(p: str, listed: list) -> str:
    """CTE ``{p}cand`` (setting, qid, pos, score) of one n-gram family: terms once, a flag per vocabulary, a sum per setting."""
    one = listed[0][1]
    variants = sorted({(s.min_df, s.max_features, s.binary) for _, s in listed})
    t = f"lower({O.norm('question')})" if one.lowercase else O.norm("question")
    grams = lambda rel: (
        f"(select id, term, count(*) as tf from (select id, unnest({O.ngram_list('__u', one)}) as term "
        f"from (select id, {O.units_sql(t, one)} as __u from {rel})) group by all)")
    flag = lambda s: f"m{variants.index((s.min_df, s.max_features, s.binary))}"
    flags = ", ".join(
        f"df >= {d} and row_number() over (partition by df >= {d} order by {'df' if b else 'ctf'} desc, term) <= {m} as m{v}"
        for v, (d, m, b) in enumerate(variants))
    w = lambda s, tf: ("1.0" if s.binary else f"(1.0 + ln({tf}))" if s.sublinear_tf else f"{tf}::double") + (" * idf" if s.use_idf else "")
    total = lambda x: ", ".join(f"sum(case when {flag(s)} then {x(s)} end) as s{i}" for i, s in listed)
    norms = total(lambda s: f"({w(s, 'tf')}) * ({w(s, 'tf')})")
    scores = ", ".join(f"p.s{i} / (sqrt(nq.s{i}) * sqrt(nb.s{i}))" for i, _ in listed)
    return f"""{p}bt as materialized {grams('bank')}, {p}qt as materialized {grams('qry')},
{p}st as (select term, count(*) as df, sum(tf) as ctf from {p}bt group by term),
{p}vo as materialized (select term, ln(((select count(*) from bank) + 1.0) / (df + 1.0)) + 1.0 as idf, {flags} from {p}st),
{p}b as materialized (select * from {p}bt join {p}vo using (term)), {p}q as materialized (select * from {p}qt join {p}vo using (term)),
{p}nb as (select id, {norms} from {p}b group by id), {p}nq as (select id, {norms} from {p}q group by id),
{p}pr as (select q.id as qid, q.pos, {', '.join(f's{i}' for i, _ in listed)} from
  (select q.id, b.id as pos, {total(lambda s: f"({w(s, 'tfq')}) * ({w(s, 'tf')})")}
   from (select id, term, tf as tfq from {p}qt) q join {p}b b on q.term = b.term group by q.id, b.id) q),
{p}cand as (select qid, pos, unnest([{', '.join(str(i) for i, _ in listed)}]) as setting, unnest([{scores}]) as score
  from {p}pr p join {p}nq nq on nq.id = p.qid join {p}nb nb on nb.id = p.pos)"""


def _grid_sql() -> str:
    families: dict[tuple, list] = {}
    for i, s in enumerate(GRID):
        families.setdefault(SW._family(s), []).append((i, s))
    ctes = ", ".join(_grid_family_ctes(f"f{k}_", listed) for k, listed in enumerate(families.values()))
    union = " union all ".join(f"select setting, qid, pos, score from f{k}_cand" for k in range(len(families)))
    rows = ", ".join(
        f"({i}, '{s.analyzer}', {s.ngram_min}, {s.ngram_max}, {s.max_features}, {s.min_df}, {s.sublinear_tf}, {s.binary}, {s.use_idf})"
        for i, s in enumerate(GRID))
    return f"""with {_qa_cte(T.CONV_QA_SQL)}, {ctes},
grid(setting, analyzer, ngram_min, ngram_max, max_features, min_df, sublinear_tf, "binary", use_idf) as (values {rows}),
cand as (select setting, qid, pos, max(score) as score from ({union} union all
  select setting, qry.id, (select min(pos) from bank), 0.0 from qry, grid) group by all),
best as materialized (select * from cand qualify row_number() over (partition by setting, qid order by round(coalesce(score, 0), 9) desc, pos) = 1),
pairs as materialized (select distinct b.qid, b.pos, coalesce(q.answer, '') as reference, coalesce(k.answer, '') as prediction
  from best b join qry q on q.id = b.qid join bank k on k.pos = b.pos),
scored as materialized ({O.rouge_select('pairs', 'reference', 'prediction', 'qid, pos')}),
means as (select setting, avg(r1) as rouge1_f1, avg(rl) as rouge_l_f1 from best join scored using (qid, pos) group by setting)
select grid.*, round(coalesce(rouge1_f1, 0), 6) as rouge1_f1, round(coalesce(rouge_l_f1, 0), 6) as rouge_l_f1,
  round(coalesce(0.5 * rouge1_f1 + 0.5 * rouge_l_f1, 0), 6) as weighted_without_llm from grid left join means using (setting)"""


@register("retrieval_grid", _grid_sql())
def retrieval_grid_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: all 288 settings over the whole bank and all queries, best first."""
    bank, q = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    g = SW.retrieval_grid(spark, bank, q, GRID)
    return g.select(*[c for c in g.columns if c not in ("rouge1_f1", "rouge_l_f1", "weighted_without_llm")],
                    *[r6(F.col(c)).alias(c) for c in ("rouge1_f1", "rouge_l_f1", "weighted_without_llm")])


# --- A6, W8, E1/W7/G4: comparisons and history ---------------------------------------------

def _run_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    qa = T.conv_qa(spark, sf_dir)
    bank, q = T.bank_and_queries(qa)
    runs = None
    for name, s in (("base", BASELINE), ("alt", SCRIPT), ("words", WORDS12)):
        r = sim.top1_predict(bank, q, s).select(F.lit(name).alias("run"), F.col("qid").alias("ID"), "prediction")
        runs = r if runs is None else runs.unionByName(r)
    # a run produced only for some subsets (s0-s2) misses expected IDs and is dropped by the coverage rule
    partial_q = q.where(F.col("subset") != "s3")
    partial = sim.top1_predict(bank, partial_q, TfidfSettings(analyzer="char_wb", ngram_min=2, ngram_max=4)).select(
        F.lit("partial").alias("run"), F.col("qid").alias("ID"), "prediction")
    truth = q.select(F.col("qid").alias("ID"), "subset", X.fill_empty("answer").alias("reference"))
    return runs.unionByName(partial), truth


def _runs_compare_sql() -> str:
    members = [("base", BASELINE), ("alt", SCRIPT), ("words", WORDS12)]
    ctes = [O.topk_ctes(s, "bank", "qry", 1, [], f"{n}_") for n, s in members]
    union = " union all ".join(
        f"select '{n}' as run, t.qid as \"ID\", coalesce(b.answer, '') as prediction from {n}_top t join bank b on b.pos = t.pos"
        for n, _ in members)
    return f"""with {_qa_cte(T.CONV_QA_SQL)}, {', '.join(ctes)},
runs as ({union}),
truth as (select id as "ID", subset, coalesce(answer, '') as reference from qry),
pairs as (select distinct r."ID", r.prediction, t.reference from runs r join truth t on t."ID" = r."ID"),
ps as ({O.rouge_select('pairs', 'reference', 'prediction', '"ID", prediction')}),
sc as (select r.run, t.subset, 0.5 * ps.r1 + 0.5 * ps.rl as score from runs r join ps on ps."ID" = r."ID" and ps.prediction = r.prediction
       join truth t on t."ID" = r."ID"),
agg as (select run, subset, avg(score) as score from sc group by run, subset
        union all select run, 'ALL' as subset, avg(score) from sc group by run),
cmp as (select a.run, a.subset, a.score, a.score - b.score as delta from agg a left join agg b on b.subset = a.subset and b.run = 'base')"""


@register(
    "run_comparison",
    f"""{_runs_compare_sql()}
select run, subset, round(score, 6) as score, round(delta, 6) as delta from cmp""",
)
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 (+S4/U3 coverage): three retrieval runs and one incomplete run against the references."""
    runs, truth = _run_table(spark, sf_dir)
    c = CMP.run_comparison(runs, truth, baseline="base")
    return c.select("run", "subset", r6(F.col("score")).alias("score"), r6(F.col("delta")).alias("delta"))


@register(
    "top_runs",
    f"""{_runs_compare_sql()}
select subset, run, rank, round(score, 6) as score from
 (select *, row_number() over (partition by subset order by round(score, 9) desc, run) as rank from cmp) where rank <= 2""",
)
def top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best runs per subset (top 2 of the compared runs)."""
    runs, truth = _run_table(spark, sf_dir)
    c = CMP.top_runs_per_subset(CMP.run_comparison(runs, truth, baseline="base"), 2)
    return c.select("subset", "run", "rank", r6(F.col("score")).alias("score"))


@register(
    "history_signal",
    f"""with h as ({T.HISTORY_SQL}), s as (select * from h where score is not null),
r as (select series, count(*) as recent_n, max(score) as mx, min(score) as mn from
      (select *, row_number() over (partition by series order by seq desc) as rk from s) where rk <= 3 group by series),
b as (select series, max(score) as best_score, arg_max(id, score * 1e9 - seq) as best_id0, count(*) as scored_rows from s group by series),
bb as (select s.series, min_by(s.id, s.seq) as best_id from s join b on b.series = s.series and s.score = b.best_score group by s.series)
select b.series, b.scored_rows, bb.best_id, round(b.best_score, 6) as best_score,
  (r.recent_n >= 3 and r.mx - r.mn < 0.005) as plateaued,
  case when r.recent_n >= 3 and r.mx - r.mn < 0.005 then 'plateau' when b.best_score > 0.55 then 'lower_learning_rate'
       else 'more_epochs' end as branch
from b join r on r.series = b.series join bb on bb.series = b.series""",
)
def history_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + W7 + G4: next-step signal per score history (one series per user of ``events``)."""
    out = CMP.next_step_signal(T.history(spark, sf_dir))
    return out.select("series", "scored_rows", "best_id", r6(F.col("best_score")).alias("best_score"), "plateaued", "branch")


@register(
    "step_signals",
    f"""with h as ({T.HISTORY_SQL}),
s as (select *, row_number() over w as step, max(score) over w as best_so_far,
             max(score) over r - min(score) over r as span from h where score is not null
      window w as (partition by series order by seq, id), r as (partition by series order by seq, id rows between 2 preceding and current row)),
p as (select *, step >= 3 and span < 0.005 as plateaued from s)
select series, id, step, round(score, 6) as score, round(best_so_far, 6) as best_so_far, plateaued,
  case when plateaued then 'plateau' when best_so_far > 0.55 then 'lower_learning_rate' else 'more_epochs' end as branch from p""",
)
def step_signals_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7 + E1 at every step of every score history, long series cut into ranges."""
    out = CMP.step_signals(T.history(spark, sf_dir))
    return out.withColumns({"score": r6(F.col("score")), "best_so_far": r6(F.col("best_so_far"))})


# --- G1, G2: ordered sinks -----------------------------------------------------------------------

@register(
    "ordered_submission",
    f"""with src as (select id as "ID", answer, row_number() over (order by pos) as position from ({T.CONV_QA_SQL}) where split = 'query')
select position, cast("ID" as varchar) as "ID", coalesce(answer, '') as "TargetRLF1", coalesce(answer, '') as "TargetR1F1",
       coalesce(answer, '') as "TargetLLM" from src""",
)
def ordered_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: the reference answers of the query split as an output in source order, written as several CSV files and read again."""
    _, source = T.bank_and_queries(T.conv_qa(spark, sf_dir))
    source = source.withColumnRenamed("qid", "ID")
    out = B.build_submission(source, source.select("ID", F.col("answer").alias("prediction")))
    path = B.save_submission(out, _scratch(spark, "ordered"), "csv", source=source, rows_per_file=10_000)
    return FS.read_ordered(spark, path, "csv")


@register(
    "ordered_report",
    f"""with qa as ({T.CONV_QA_SQL}), r as (select subset, id, length(coalesce(question, '')) as n_chars from qa)
select row_number() over (order by subset, n_chars desc, id) as position, subset, id, n_chars from r""",
)
def ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with several sort keys (longest questions of each subset first), kept over a reread of several files."""
    report = T.conv_qa(spark, sf_dir).select("subset", "id", F.length(X.fill_empty("question")).cast("long").alias("n_chars"))
    order = [F.col("subset").asc(), F.col("n_chars").desc(), F.col("id").asc()]
    path = FS.write_table(report, _scratch(spark, "report"), order=order, rows_per_file=10_000)
    return FS.read_ordered(spark, path)


# --- S11: resumable results ----------------------------------------------------------------------

@register(
    "resume_pending",
    f"""with j as ({T.JUDGE_RAW_SQL})
select id as "ID", md5(raw) as result, case when id % 6 = 0 then 'retry' when id % 3 < 2 then 'first' else 'resumed' end as attempt,
  case when id % 6 = 0 then 1 when id % 3 = 0 then 0 when id % 3 = 1 then 1 else 2 end as batch from j""",
)
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies processed in batches: two committed (the second does some IDs again), one that broke off before
    its commit, then a restart that does whatever is pending; the latest result of every ID."""
    requests = T.judge_raw(spark, sf_dir).select(F.col("id").alias("ID"), "raw")
    path, schema = _scratch(spark, "resume"), "ID long, result string, attempt string"

    def done(rows: DataFrame, attempt) -> DataFrame:
        return rows.select("ID", F.md5("raw").alias("result"), attempt.alias("attempt"))

    share = F.pmod("ID", F.lit(3))
    again = F.pmod("ID", F.lit(6)) == 0
    RES.append_done(done(requests.where(share == 0), F.lit("first")), path)
    second = requests.where((share == 1) | again)
    RES.append_done(done(second, F.when(again, "retry").otherwise("first")), path)
    RES.write_batch(done(requests.where(share == 2), F.lit("broken off")), path, 2)
    rest = RES.pending(requests, RES.read_done(spark, path, schema))
    RES.append_done(done(rest, F.lit("resumed")), path)
    return RES.latest_per_id(RES.read_done(spark, path, schema)).select("ID", "result", "attempt", F.col("commit").alias("batch"))


# --- W3-W5: row selection ----------------------------------------------------------------------

@register(
    "first_rows_per_group",
    """select doc_id, lang, source from
 (select *, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 3""",
)
def first_rows_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 3 documents of every language in source order."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return SM.first_n_per_group(d, "lang", 3, order_col="doc_id")


@register(
    "seeded_sample",
    """select doc_id, lang from documents where lang in ('de', 'es')
order by md5('42:' || cast(doc_id as varchar)) limit 30""",
)
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 + P14: subset filter, then a seeded sample of 30 rows (hash order, reproducible)."""
    d = T.table(spark, sf_dir, "documents").where(F.col("lang").isin("de", "es")).select("doc_id", "lang")
    return SM.seeded_sample(d, 30, 42, id_col="doc_id")


@register(
    "stratified_cap",
    """with h as (select doc_id, lang, md5('7:' || cast(doc_id as varchar)) as h from documents),
g as (select count(distinct lang) as k from documents),
p as (select h.* from h, g qualify row_number() over (partition by lang order by h) <= greatest(1, cast(ceil(20.0 / k) as integer)))
select doc_id, lang from p order by h limit 20""",
)
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 documents, spread over languages (ceil(20 / groups) each), seed 7."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return SM.stratified_cap(d, "lang", 20, 7, id_col="doc_id")


# --- L1-L6: learned candidate selection -------------------------------------------------------

QA_CODES = {"s0": 0, "s1": 1, "s2": 2, "s3": 3}


def _candidate_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = T.conv_qa(spark, sf_dir)
    bank, q = T.bank_and_queries(qa)
    vec = T.qa_vectors(spark, sf_dir, qa)
    u = FU.tracked_union(bank, q, GENERATORS, 5, 8)
    return L.candidate_features(u, bank, q, vec, vec, codes=QA_CODES)


def _candidate_sql() -> str:
    qt = f"list_distinct({O.words('q.question')})"
    bt = f"list_distinct({O.words('b.question')})"
    at = f"list_distinct({O.words('b.answer')})"
    codes = " ".join(f"when '{k}' then {v}" for k, v in QA_CODES.items())
    return f"""with {_union_sql(5, 8)}, v as ({_QAV}),
f as (select r.qid, b.id as matched_id, r.pos, r.rank, case q.subset {codes} else -1 end as subset_code,
  1.0 / r.rank as inv_rank, r.max_score as tfidf_score, list_inner_product(vq.vec, vb.vec) as semantic_score,
  r.generator_count, r.mean_score as mean_tfidf_score, r.best_generator as best_generator_index,
  {O.word_count('q.question')} as query_words, {O.word_count('b.question')} as bank_question_words,
  {O.word_count('b.answer')} as answer_words,
  abs({O.word_count('q.question')} - {O.word_count('b.question')}) as question_word_delta,
  {O.word_count('b.answer')} / greatest({O.word_count('q.question')}, 1) as answer_to_query_ratio,
  {O.overlap(qt, bt)} as question_token_overlap, {O.jaccard(qt, bt)} as question_token_jaccard,
  {O.overlap(qt, at)} as answer_query_overlap, {O.jaccard(qt, at)} as answer_query_jaccard,
  coalesce(q.answer, '') as reference, coalesce(b.answer, '') as prediction
  from r join qry q on q.id = r.qid join bank b on b.pos = r.pos join v vq on vq.id = r.qid join v vb on vb.id = r.pos),
t as ({O.rouge_select('(select distinct reference, prediction from f)', 'reference', 'prediction', 'reference, prediction')})"""


_CF_COLS = [c for c in L.CANDIDATE_FEATURES]
_CF_INT = {"subset_code", "generator_count", "best_generator_index", "query_words", "bank_question_words",
           "answer_words", "question_word_delta"}


@register(
    "candidate_features",
    f"""{_candidate_sql()}
select f.qid, f.matched_id, f.rank,
  {', '.join((f'cast(f.{c} as bigint) as {c}' if c in _CF_INT else f'round(f.{c}, 5) as {c}') for c in _CF_COLS)},
       round(0.5 * t.r1 + 0.5 * t.rl, 5) as target
from f join t on t.reference = f.reference and t.prediction = f.prediction""",
)
def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: 16 features + R4 target per (query, candidate) over the 3-generator union with dense scores."""
    f = _candidate_frame(spark, sf_dir)
    return f.select("qid", "matched_id", "rank",
                    *[(F.col(c).cast("long") if c in _CF_INT else F.round(F.col(c).cast("double"), 5)).alias(c)
                      for c in _CF_COLS],
                    F.round(F.col("target"), 5).alias("target"))


@register("learned_rerank")
def learned_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 (+W1): grouped 3-fold out-of-fold GBT scores over candidate features, best candidate per query."""
    f = _candidate_frame(spark, sf_dir)
    best = L.cross_validated_select(
        f, id_col="qid", features=L.CANDIDATE_FEATURES, folds=3, seed=42,
        order=[F.col("model_score").desc(), F.col("semantic_score").desc(), F.col("tfidf_score").desc(), F.col("pos")],
    )
    return best.select("qid", "matched_id", "prediction", r6(F.col("model_score")).alias("model_score"))


def _selector_runs(spark: SparkSession, sf_dir: str):
    source, base, alt = _runs(spark, sf_dir)
    runs = base.select("ID", F.lit("base").alias("candidate"), "prediction").unionByName(
        alt.select("ID", F.lit("alt").alias("candidate"), "prediction")
    ).unionByName(L.synthetic_candidates(source, base.select("ID", "prediction")))
    return source, runs


def _selector_sql() -> str:
    parts = ["select \"ID\", 'base' as candidate, prediction from base",
             "select \"ID\", 'alt' as candidate, prediction from alt"]
    for cap in (40, 60, 80, 120):
        parts.append(f"select \"ID\", 'input_only_{cap}' as candidate, {O.trim_words('question', cap)} as prediction from src")
    for ic, pc in ((80, 40), (80, 60), (120, 80), (None, 80)):
        q = O.trim_words("s.question", ic)
        pp = O.trim_words("b.prediction", pc)
        parts.append(f"select s.\"ID\", 'input_pred_{ic if ic is not None else 'None'}_{pc}' as candidate, "
                     f"{O.strip(f'({q} || chr(32) || {pp})')} as prediction from src s join base b on b.\"ID\" = s.\"ID\"")
    return f"""with {_RUNS_SQL}, runs as ({' union all '.join(parts)}),
f as (select r."ID", coalesce(s.subset, '') as subset, r.candidate, coalesce(r.prediction, '') as prediction,
  {O.word_count('s.question')} as question_words, length(coalesce(s.question, '')) as question_chars,
  {O.word_count('r.prediction')} as prediction_words, length(coalesce(r.prediction, '')) as prediction_chars,
  {O.jaccard(O.lower_words('s.question'), O.lower_words('r.prediction'))} as word_jaccard,
  {O.jaccard(O.lower_chars('s.question'), O.lower_chars('r.prediction'))} as char_jaccard,
  cast(starts_with(coalesce(r.prediction, ''), coalesce(s.question, '')) as int) as starts_with_question,
  coalesce(s.answer, '') as reference
  from runs r join src s on s."ID" = r."ID"),
t as ({O.rouge_select('(select distinct reference, prediction from f)', 'reference', 'prediction', 'reference, prediction')})"""


@register(
    "selector_features",
    f"""{_selector_sql()}
select f."ID", f.subset, f.candidate, question_words, question_chars, prediction_words, prediction_chars,
  round(prediction_words / greatest(question_words, 1), 6) as pred_to_question_words,
  round(word_jaccard, 6) as word_jaccard, round(char_jaccard, 6) as char_jaccard, starts_with_question,
  round(0.5 * t.r1 + 0.5 * t.rl, 6) as target
from f join t on t.reference = f.reference and t.prediction = f.prediction""",
)
def selector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 + L3: long table over two saved runs and eight synthetic question/base hybrids."""
    source, runs = _selector_runs(spark, sf_dir)
    f = L.selector_features(source, runs)
    return f.select(
        "ID", "subset", "candidate", "question_words", "question_chars", "prediction_words", "prediction_chars",
        r6(F.col("pred_to_question_words")).alias("pred_to_question_words"), r6(F.col("word_jaccard")).alias("word_jaccard"),
        r6(F.col("char_jaccard")).alias("char_jaccard"), "starts_with_question", r6(F.col("target")).alias("target"),
    )


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, runs = _selector_runs(spark, sf_dir)
    f = L.selector_features(source, runs)
    return L.cross_validated_select(
        f, id_col="ID", features=L.SELECTOR_NUMERIC, categorical=["subset", "candidate"], folds=3, seed=42,
        stratify_col="subset", order=[F.col("model_score").desc(), F.col("candidate")],
    )


@register("learned_selector")
def learned_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5 (+W2): subset-stratified 3-fold GBT with one-hot subset/candidate, best candidate per ID."""
    return _selected(spark, sf_dir).select("ID", "subset", "candidate", "prediction",
                                           r6(F.col("model_score")).alias("selector_score"))


@register("selection_report")
def selection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each candidate was selected per subset."""
    return CMP.selection_report(_selected(spark, sf_dir))


# --- S1-S4, S9, S10, S12: files ----------------------------------------------------------------

@register(
    "role_binding",
    f"""select id as "ID", question, answer, subset from ({T.CONV_QA_SQL})""",
)
def role_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with challenge-style names (ID/input/output) bound to canonical roles."""
    qa = T.conv_qa(spark, sf_dir).select(
        F.col("id").alias("ID"), F.col("question").alias("input"), F.col("answer").alias("output"), "subset"
    )
    return FS.bind_roles(qa, require_answer=True)


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from answerbank.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register(
    "prediction_roundtrip",
    f"""with {_RUNS_SQL}
select 'base' as run, cast("ID" as varchar) as "ID", prediction from base
union all select 'alt' as run, cast("ID" as varchar) as "ID", prediction from alt""",
)
def prediction_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9/S10 then S3/S4: two runs written as CSV (one in submission layout, multi-line quoted text)
    to the shared folder and scanned back in one glob read; the folder name becomes the run."""
    source, base, alt = _runs(spark, sf_dir)
    root = _scratch(spark, "runs")
    FS.write_table(base.select("ID", "prediction"), f"{root}/base", fmt="csv")
    sub = B.build_submission(source, alt)
    B.save_submission(sub, f"{root}/alt", fmt="csv")
    return FS.scan_runs(spark, f"{root}/*/*.csv")


@register(
    "vector_cache",
    f"""with qa as ({T.CONV_QA_SQL}),
cache as (select id, sha256(case when subset = 's1' then coalesce(question, '') || ' (old)' else coalesce(question, '') end)
          as text_hash from qa where subset in ('s0', 's1'))
select q.id, sha256(coalesce(q.question, '')) as text_hash from qa q
where not exists (select 1 from cache c where c.id = q.id and c.text_hash = sha256(coalesce(q.question, '')))""",
)
def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vectors must be (re)computed against a content-keyed cache
    (the cache holds subsets s0 and s1; the s1 entries were keyed by an older text)."""
    qa = T.conv_qa(spark, sf_dir)
    old = F.when(F.col("subset") == "s1", F.concat(X.fill_empty("question"), F.lit(" (old)"))).otherwise(
        X.fill_empty("question"))
    cache = qa.where(F.col("subset").isin("s0", "s1")).select("id", F.sha2(old, 256).alias("text_hash"))
    return FS.vectors_to_encode(qa.select("id", F.col("question").alias("text")), cache).select("id", "text_hash")


# --- P9/P10, A5+A9: request texts and gate metrics ---------------------------------------------

# Template of a judge request (our wording; placeholders are filled per row).
JUDGE_TEMPLATE = ("Two answers to the same question follow. Reply with JSON keys choice (A or B), "
                  "confidence (0 to 1) and reason.\n\nQuestion:\n{question}\n\nAnswer A:\n{base}\n\n"
                  "Answer B:\n{candidate}\n\nJSON:")


def _sql_template(template: str, fields: dict[str, str]) -> str:
    import re

    parts = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if not piece:
            continue
        if piece[1:-1] in fields and piece.startswith("{"):
            parts.append(f"coalesce(cast({fields[piece[1:-1]]} as varchar), '')")
        else:
            parts.append("'" + piece.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(parts)


@register(
    "judge_requests",
    f"""with {_RUNS_SQL}
select s."ID", {_sql_template(JUDGE_TEMPLATE, {'question': 's.question', 'base': O.strip('b.prediction'), 'candidate': O.strip('a.prediction')})}
  as prompt
from src s join base b on b."ID" = s."ID" join alt a on a."ID" = s."ID"
where {O.strip('a.prediction')} <> '' and {O.strip('a.prediction')} <> {O.strip('b.prediction')}""",
)
def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the request table for a judge: one prompt per row whose two runs disagree."""
    source, base, alt = _runs(spark, sf_dir)
    j = source.join(base.select("ID", X.strip_text("prediction").alias("b")), "ID").join(
        alt.select("ID", X.strip_text("prediction").alias("a")), "ID")
    j = j.where((F.col("a") != "") & (F.col("a") != F.col("b")))
    return j.select("ID", X.render(JUDGE_TEMPLATE, {"question": "question", "base": "b", "candidate": "a"}).alias("prompt"))


@register(
    "gate_metrics",
    f"""with g as ({ORACLE['judge_gate']}), src as (select id as "ID", answer from ({T.CONV_QA_SQL}) where split = 'query'),
j as (select g.prediction, coalesce(s.answer, '') as reference, g.used_candidate from g join src s on s."ID" = g."ID"),
sc as ({O.rouge_select('j', 'reference', 'prediction', 'used_candidate')})
select round(avg(r1), 6) as rouge1_f1, round(avg(rl), 6) as rouge_l_f1, round(0.5 * avg(r1) + 0.5 * avg(rl), 6)
  as weighted_without_llm, sum(cast(used_candidate as bigint)) as switched_rows from sc""",
)
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + A9: metrics row of the judge-gated predictions, with the number of switched rows."""
    g = judge_gate_q(spark, sf_dir)
    refs = T.bank_and_queries(T.conv_qa(spark, sf_dir))[1].select(F.col("qid").alias("ID"), X.fill_empty("answer").alias("reference"))
    s = g.join(refs, "ID").select("used_candidate", R.rouge("reference", "prediction").alias("r"))
    a = s.agg(F.avg("r.rouge1").alias("r1"), F.avg("r.rouge_l").alias("rl"), B.switched_rows(s))
    return a.select(r6(F.col("r1")).alias("rouge1_f1"), r6(F.col("rl")).alias("rouge_l_f1"),
                    r6(0.5 * F.col("r1") + 0.5 * F.col("rl")).alias("weighted_without_llm"), "switched_rows")


@register("learned_apply")
def learned_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit the candidate model on the labelled subsets s0/s1, score the candidates of s2/s3
    (treated as unseen), best candidate per query, joined back to the queries by ID."""
    f = _candidate_frame(spark, sf_dir)
    train = f.where(F.col("subset").isin("s0", "s1"))
    unseen = f.where(~F.col("subset").isin("s0", "s1")).drop("target")
    best = L.fit_and_select(
        train, unseen, id_col="qid", features=L.CANDIDATE_FEATURES, seed=42,
        order=[F.col("model_score").desc(), F.col("semantic_score").desc(), F.col("tfidf_score").desc(), F.col("pos")],
    )
    q = T.bank_and_queries(T.conv_qa(spark, sf_dir))[1].where(~F.col("subset").isin("s0", "s1")).select("qid")
    return q.join(best.select("qid", "matched_id", "prediction", r6(F.col("model_score")).alias("model_score")), "qid", "left")


_NULL_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in FS.NULL_TOKENS)


@register(
    "csv_roundtrip",
    f"""select conv_id, turn, role, case when text in ({_NULL_LIST}) then null else text end as text from conversations""",
)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as CSV (quoted multi-line text) to the shared folder and read back
    with the declared schema, quote/escape rules and null tokens."""
    path = _scratch(spark, "csv")
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    FS.write_table(c, path, fmt="csv")
    return FS.load_csv(spark, path, "conv_id long, turn long, role string, text string")


@register(
    "doc_grouped_topk",
    f"""with {_qa_cte(T.DOC_SPLIT_SQL)}, {O.topk_ctes(DOC_WORDS, 'bank', 'qry', 3, ['subset'])}
select subset, qid, pos as matched_id, rank, round(score, 6) as similarity from top""",
)
def doc_grouped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents matched within their language (vocabulary and idf per language; one language
    holds most rows, so it is split into more blocks rather than one big task), top 3."""
    bank, q = T.bank_and_queries(T.doc_split(spark, sf_dir), keep=False)
    top = sim.topk_scores(bank, q, DOC_WORDS, 3, keys=["subset"])
    return top.select("subset", "qid", F.col("pos").alias("matched_id"), "rank", r6(F.col("score")).alias("similarity"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_score(spark, sf_dir)
