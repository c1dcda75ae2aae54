"""DuckDB SQL text for the correctness gate (``__spark_entry__.oracle_sql``).

These are independent, set-based formulations of the same semantics the Spark
operators implement (n-grams as list lambdas, TF-IDF as GROUP BY, similarity
as an equi-join on terms, ranking by window). Only string building happens
here; DuckDB runs them against the same Parquet tables.
"""

from __future__ import annotations

from answerbank.operators.tfidf import TfidfSettings

# Fixed value: same whitespace class as ``functions.text.WS_CLASS`` (RE2 syntax).
WS = r"[\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]{2,}"


def norm(expr: str) -> str:
    return f"trim(regexp_replace(coalesce(cast({expr} as varchar), ''), '{WS}+', ' ', 'g'))"


def strip(expr: str) -> str:
    return f"regexp_replace(coalesce(cast({expr} as varchar), ''), '^{WS}+|{WS}+$', '', 'g')"


def words(expr: str) -> str:
    n = norm(expr)
    return f"(case when {n} = '' then []::varchar[] else string_split({n}, ' ') end)"


def word_count(expr: str) -> str:
    return f"len({words(expr)})"


def units_sql(t: str, s: TfidfSettings) -> str:
    """The array an analyzer slices, computed once per row (see ``functions.ngrams``)."""
    if s.analyzer == "char":
        return f"(case when {t} = '' then []::varchar[] else string_split({t}, '') end)"
    if s.analyzer == "char_wb":
        return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"
    if s.analyzer == "word":
        return f"regexp_extract_all({t}, '{WORD}')"
    raise ValueError(s.analyzer)


def ngram_list(u: str, s: TfidfSettings) -> str:
    """N-grams of a materialised units column ``u``."""
    a, b = s.ngram_min, s.ngram_max
    if s.analyzer == "char_wb":
        p = "(' ' || w || ' ')"
        return (
            f"flatten(list_transform({u}, lambda w: "
            f"flatten(list_transform(range({a}, {b + 1}), lambda n: case "
            f"when length(w) + 2 > n then list_transform(range(1, length(w) + 2 - n + 2), lambda i: substr({p}, i, n)) "
            f"when length(w) + 2 = n or (n = {a} and length(w) + 2 < n) then [{p}] "
            f"else []::varchar[] end))))"
        )
    sep = "''" if s.analyzer == "char" else "' '"
    return (
        f"flatten(list_transform(range({a}, {b + 1}), lambda n: "
        f"list_transform(range(1, len({u}) - n + 2), lambda i: array_to_string(list_slice({u}, i, i + n - 1), {sep}))))"
    )


def _tfw(s: TfidfSettings) -> str:
    if s.binary:
        return "1.0"
    if s.sublinear_tf:
        return "(1.0 + ln(tf))"
    return "cast(tf as double)"


def _idf(s: TfidfSettings) -> str:
    if not s.use_idf:
        return "1.0"
    if s.smooth_idf:
        return "(ln((n + 1.0) / (df + 1.0)) + 1.0)"
    return "(ln(cast(n as double) / df) + 1.0)"


def tfidf_ctes(s: TfidfSettings, bank: str, queries: str, keys: list[str], prefix: str = "") -> str:
    """CTEs ``{p}voc``, ``{p}bw`` (keys, id, term, w) and ``{p}qw`` for relations with (keys, id, question)."""
    p = prefix
    k = "".join(f"{c}, " for c in keys)
    kp = ", ".join(keys) if keys else ""
    part = f"partition by {kp}" if keys else ""
    t = norm("question")
    if s.lowercase:
        t = f"lower({t})"
    ctf = "count(*)" if s.binary else "sum(tf)"
    limit = ""
    if s.max_features is not None:
        limit = f"qualify row_number() over ({part} order by ctf desc, term) <= {s.max_features}"
    using_keys = "".join(f"{c}, " for c in keys)
    nd_join = f"join {p}nd using ({kp})" if keys else f"cross join {p}nd"
    return f"""
{p}bt as (select {k}id, term, count(*) as tf from (select {k}id, unnest({ngram_list('__u', s)}) as term
   from (select *, {units_sql(t, s)} as __u from {bank})) group by all),
{p}nd as (select {k}count(*) as n from {bank} {'group by ' + kp if keys else ''}),
{p}st as (select {k}term, count(*) as df, {ctf} as ctf from {p}bt group by all),
{p}voc as (select {k}term, df, ctf, {_idf(s)} as idf from {p}st {nd_join}
   where df >= {s.min_df} and df <= {float(s.max_df)!r} * n {limit}),
{p}bw0 as (select {k}id, term, {_tfw(s)} * idf as raw from {p}bt join {p}voc using ({using_keys}term)),
{p}bw as (select {k}id, term, raw / sqrt(sum(raw * raw) over (partition by {k}id)) as w from {p}bw0),
{p}qt as (select {k}id, term, count(*) as tf from (select {k}id, unnest({ngram_list('__u', s)}) as term
   from (select *, {units_sql(t, s)} as __u from {queries})) group by all),
{p}qw0 as (select {k}id, term, {_tfw(s)} * idf as raw from {p}qt join {p}voc using ({using_keys}term)),
{p}qw as (select {k}id, term, raw / sqrt(sum(raw * raw) over (partition by {k}id)) as w from {p}qw0)"""


def topk_ctes(s: TfidfSettings, bank: str, queries: str, kk: int, keys: list[str], prefix: str = "") -> str:
    """Adds ``{p}top`` (keys, qid, pos, score, rank) to ``tfidf_ctes``; bank relation has (keys, id, pos)."""
    p = prefix
    k = "".join(f"{c}, " for c in keys)
    on_keys = "".join(f"and q.{c} = b.{c} " for c in keys)
    qk = "".join(f"q.{c}, " for c in keys)
    part = ", ".join([*keys, "qid"])
    pad_rank = f"row_number() over ({'partition by ' + ', '.join(keys) if keys else ''} order by pos)"
    return tfidf_ctes(s, bank, queries, keys, p) + f""",
{p}sc as (select {qk}q.id as qid, b.id as pos, sum(q.w * b.w) as score from {p}qw q join {p}bw b
   on q.term = b.term {on_keys} group by all),
{p}pad as (select {qk}q.id as qid, b.pos, 0.0 as score from {queries} q
   join (select {k}pos from {bank} qualify {pad_rank} <= {kk}) b on true {on_keys}),
{p}cand as (select {k}qid, pos, max(score) as score from (select * from {p}sc union all by name select * from {p}pad) group by all),
{p}top as (select *, row_number() over (partition by {part} order by round(score, 9) desc, pos) as rank
   from {p}cand qualify rank <= {kk})"""


def rouge_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), '[a-z0-9]+')"


def rouge_sql(rt: str, pt: str) -> tuple[str, str]:
    """(rouge1, rouge_l) F-measures from two token-list columns; LCS by a list_reduce over match positions.

    The DP row is non-decreasing, so the best predecessor of cell j is the last
    match position <= j: O(n * m * matches) per pair on whole texts.
    """
    ov = (
        f"coalesce(list_sum(list_transform(list_distinct({rt}), lambda t: "
        f"least(len(list_filter({rt}, lambda x: x = t)), len(list_filter({pt}, lambda x: x = t))))), 0)"
    )
    lcs = (
        f"list_reduce(list_transform({rt}, lambda x: list_filter(range(1, len({pt}) + 1), lambda jp: {pt}[jp] = x)), "
        f"lambda acc, pp: list_transform(range(0, len({pt}) + 1), lambda j: case when j = 0 then 0 else "
        f"greatest(acc[j + 1], coalesce(acc[list_max(list_filter(pp, lambda q: q <= j))] + 1, 0)) end), "
        f"list_transform(range(0, len({pt}) + 1), lambda j: 0))[len({pt}) + 1]"
    )

    def f(o: str) -> str:
        p = f"({o}) / greatest(len({pt}), 1)"
        r = f"({o}) / greatest(len({rt}), 1)"
        return (
            f"(case when len({rt}) = 0 or len({pt}) = 0 or ({o}) = 0 then 0.0 "
            f"else 2.0 * {p} * {r} / ({p} + {r}) end)"
        )

    return f(ov), f(lcs)


def rouge_select(rel: str, ref: str, pred: str, keep: str) -> str:
    """``select {keep}, r1, rl from rel`` with the token lists computed once per row."""
    r1, rl = rouge_sql("__rt", "__pt")
    return (
        f"select {keep}, {r1} as r1, {rl} as rl from "
        f"(select *, {rouge_tokens(ref)} as __rt, {rouge_tokens(pred)} as __pt from {rel})"
    )


def trim_words(expr: str, n: int | None) -> str:
    if n is None:
        return strip(expr)
    return f"array_to_string(list_slice({words(expr)}, 1, {n}), ' ')"


def trim_words_keep(expr: str, n: int | None) -> str:
    if n is None:
        return strip(expr)
    return f"(case when len({words(expr)}) <= {n} then {strip(expr)} else {trim_words(expr, n)} end)"


def combine(q: str, p: str, mode: str) -> str:
    qs, ps = strip(q), strip(p)
    if mode == "input_pred":
        return strip(f"({qs} || ' ' || {ps})")
    if mode == "pred_input":
        return strip(f"({ps} || ' ' || {qs})")
    if mode == "input_only":
        return qs
    raise ValueError(mode)


def jaccard(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(case when {u} = 0 then 0.0 else len(list_intersect({a}, {b})) / {u} end)"


def overlap(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 then 0.0 else len(list_intersect({a}, {b})) / len({a}) end)"


def lower_words(expr: str) -> str:
    return f"list_distinct({words(f'lower(coalesce({expr}, {chr(39)}{chr(39)}))')})"


def lower_chars(expr: str) -> str:
    low = f"lower(coalesce({expr}, ''))"
    return f"(case when {low} = '' then []::varchar[] else list_distinct(string_split({low}, '')) end)"


def parse_decision(raw: str) -> tuple[str, str, str]:
    """(choice, confidence, reason) SQL expressions for a reply column."""
    cleaned = strip(f"regexp_replace(coalesce({raw}, ''), '(?is)<think>.*?</think>', '', 'g')")
    obj = f"regexp_extract({cleaned}, '(?s)(\\{{.*?\\}})', 1)"
    valid = f"({obj} <> '' and coalesce(json_valid({obj}), false))"

    doc = f"(case when {valid} then {obj} end)"
    typ = lambda key: f"json_type({doc}, '$.{key}')"  # noqa: E731 - SQL null: no such key; 'NULL': a JSON null
    txt = lambda key: f"json_extract_string({doc}, '$.{key}')"
    num = strip(txt("confidence"))
    j_conf = (
        f"(case when {typ('confidence')} is null then 0.0 when {typ('confidence')} = 'BOOLEAN' then (case when {num} = 'true' then 1.0 else 0.0 end) "
        f"when {typ('confidence')} in ('NULL', 'ARRAY', 'OBJECT') then null else try_cast({num} as double) end)"
    )
    ok = f"({valid} and {j_conf} is not null)"
    f_choice = f"regexp_extract(upper({cleaned}), '\\b([AB])\\b', 1)"
    f_conf = f"regexp_extract({cleaned}, '(?i)(?:confidence|score)\\D+([01](?:\\.\\d+)?)', 1)"
    choice = f"(case when {ok} then coalesce(upper({strip(txt('choice'))}), 'A') else {f_choice} end)"
    conf = f"(case when {ok} then {j_conf} when {f_conf} = '' then 0.0 else cast({f_conf} as double) end)"
    reason = (
        f"(case when not {ok} then 'fallback_parse' when {typ('reason')} is null then 'json' when {typ('reason')} = 'NULL' then 'None' "
        f"when {typ('reason')} = 'BOOLEAN' then (case when {txt('reason')} = 'true' then 'True' else 'False' end) else {txt('reason')} end)"
    )
    return (
        f"(case when {choice} = 'B' then 'B' else 'A' end)",
        f"greatest(0.0, least(1.0, {conf}))",
        f"substr({reason}, 1, 160)",
    )


def clean_generation(raw: str) -> str:
    t = strip(raw)
    for pre in ["Here is[^\\n]*:", "Here''s[^\\n]*:", "Final answer:"]:
        t = f"regexp_replace({t}, '(?i)^{pre}{WS}*', '')"
    parts = f"list_filter(list_transform(regexp_split_to_array({t}, '\\n{WS}*\\n'), lambda x: {strip('x')}), lambda x: x <> '')"
    t2 = (
        f"(case when len({parts}) > 1 and regexp_matches(({parts})[1], '(?i)rewritten|answer|candidate') "
        f"then array_to_string(list_slice({parts}, 2, len({parts})), chr(10) || chr(10)) else {t} end)"
    )
    return strip(f"regexp_replace({t2}, '(?is)\\n*I removed\\b.*$', '')")


def clean_translation(raw: str) -> str:
    t = strip(f"regexp_replace(regexp_replace({strip(raw)}, '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')")
    for marker in ["Translation:", "Answer:", "Here is the translation:"]:
        t = f"(case when starts_with(lower({t}), '{marker.lower()}') then {strip(f'substr({t}, {len(marker) + 1})')} else {t} end)"
    return t
