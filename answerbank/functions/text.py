"""Text scalars as Column builders (JVM-side, inside whole-stage codegen).

Every function takes and returns ``pyspark.sql.Column`` so callers can fuse
them into one projection; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's ``str.split()`` treats as whitespace,
# written as an explicit class that Java regex and RE2 read the same way.
WS_CLASS = r"[\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}]"
WS_RUN = WS_CLASS + "+"

# Fixed value: word-character runs of two or more (the word analyzer's token rule).
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_empty(c: Column | str) -> Column:
    """Null text becomes the empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def normalize_ws(c: Column | str) -> Column:
    """Collapse every whitespace run to one space and strip (P1); null -> ''."""
    return F.trim(F.regexp_replace(fill_empty(c), WS_RUN, " "))


def words(c: Column | str) -> Column:
    """Whitespace tokens of a text, empty array for blank text."""
    n = normalize_ws(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words (P3); blank text counts 0."""
    n = normalize_ws(c)
    return F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " ")))


def trim_words_keep(c: Column | str, n: int | Column | None) -> Column:
    """At most ``n`` words; a text that already fits keeps its inner spacing (only stripped)."""
    stripped = strip_text(c)
    if n is None:
        return stripped
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    w = words(c)
    return F.when(n_col.isNull() | (F.size(w) <= n_col), stripped).otherwise(F.array_join(F.slice(w, 1, n_col), " "))


def trim_words(c: Column | str, n: int | Column | None) -> Column:
    """The first ``n`` words re-joined by single spaces; ``None`` (or a null cap) only strips."""
    stripped = strip_text(c)
    if n is None:
        return stripped
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return F.when(n_col.isNull(), stripped).otherwise(F.array_join(F.slice(words(c), 1, n_col), " "))


def strip_text(c: Column | str) -> Column:
    """Python ``str.strip()`` on the whitespace set of ``WS_CLASS``."""
    return F.regexp_replace(fill_empty(c), "^" + WS_RUN + "|" + WS_RUN + "$", "")


def combine(question: Column, prediction: Column, mode: Column | str) -> Column:
    """P5: ``input_pred`` / ``pred_input`` / ``input_only`` of two already-trimmed parts."""
    m = F.lit(mode) if isinstance(mode, str) else mode
    q = strip_text(question)
    p = strip_text(prediction)
    return (
        F.when(m == "input_pred", strip_text(F.concat_ws(" ", q, p)))
        .when(m == "pred_input", strip_text(F.concat_ws(" ", p, q)))
        .when(m == "input_only", q)
    )


def prefix(c: Column | str, text: str) -> Column:
    """Prepend a fixed prefix (query/passage markers of an encoder)."""
    return F.concat(F.lit(text), fill_empty(c))


def token_set(c: Column | str) -> Column:
    """P16 token set: distinct tokens of the whitespace-normalised text (case-sensitive)."""
    return F.array_distinct(words(c))


def overlap_ratio(source: Column, candidate: Column) -> Column:
    """|source ∩ candidate| / |source|, 0 for an empty source (inputs are distinct arrays)."""
    return F.when(F.size(source) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(source, candidate)) / F.size(source)
    )


def jaccard(left: Column, right: Column) -> Column:
    """|a ∩ b| / |a ∪ b| over distinct arrays; 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def lower_word_set(c: Column | str) -> Column:
    """Lower-cased distinct words of the raw text."""
    return F.array_distinct(words(F.lower(fill_empty(c))))


def lower_char_set(c: Column | str) -> Column:
    """Distinct characters (spaces included) of the lower-cased raw text."""
    low = F.lower(fill_empty(c))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(low, "")))


def length_ratio(num: Column, den: Column) -> Column:
    """``num / max(den, 1)``."""
    return num / F.greatest(den, F.lit(1))


# --- generated-text cleaning (P11, P12) -------------------------------------------

# Leading phrases removed from a generated answer, in this order.
GENERATION_PREFACES = [r"Here is[^\n]*:", r"Here's[^\n]*:", r"Final answer:"]
# Fixed value: a first paragraph mentioning one of these words is meta text.
GENERATION_META_WORDS = r"(?i)rewritten|answer|candidate"


def clean_generation(c: Column | str) -> Column:
    """Strip known prefaces, drop a leading meta paragraph, cut from "I removed" on."""
    t = strip_text(c)
    for pre in GENERATION_PREFACES:
        t = F.regexp_replace(t, "(?i)^" + pre + WS_CLASS + "*", "")
    parts = F.filter(
        F.transform(F.split(t, r"\n" + WS_CLASS + r"*\n"), lambda x: strip_text(x)), lambda x: x != ""
    )
    t = F.when(
        (F.size(parts) > 1) & F.element_at(parts, 1).rlike(GENERATION_META_WORDS),
        F.array_join(F.slice(parts, 2, 1 << 30), "\n\n"),
    ).otherwise(t)
    t = F.regexp_replace(t, r"(?is)\n*I removed\b.*$", "")
    return strip_text(t)


# Leading markers of a translation reply, removed in this order.
TRANSLATION_MARKERS = ["Translation:", "Answer:", "Here is the translation:"]


def clean_translation(c: Column | str) -> Column:
    """Strip double then single quotes, then each leading marker in turn (case-insensitive)."""
    t = strip_text(F.regexp_replace(F.regexp_replace(strip_text(c), '^"+|"+$', ""), "^'+|'+$", ""))
    for marker in TRANSLATION_MARKERS:
        t = F.when(
            F.lower(t).startswith(marker.lower()), strip_text(F.substring(t, len(marker) + 1, 1 << 30))
        ).otherwise(t)
    return t


# --- judge replies (P13) ----------------------------------------------------------

def parse_decision(raw: Column | str, reason_chars: int = 160) -> Column:
    """Reply text -> struct(choice, confidence, reason).

    ``<think>…</think>`` blocks are removed and the first ``{…}`` is read as strict JSON. Of the object a
    missing key takes its default (A, 0.0, "json"); a null reason reads "None", a boolean one "True" or "False", a boolean confidence 1 or 0,
    a confidence in quotes as its number. Any other confidence (null, list, word) makes the whole reply plain text: then the first
    standalone A/B letter and a number after "confidence"/"score" are taken. Unknown choice -> A;
    confidence clamped to [0, 1]; reason cut to ``reason_chars`` characters.
    """
    cleaned = strip_text(F.regexp_replace(fill_empty(raw), r"(?is)<think>.*?</think>", ""))
    reply = F.try_parse_json(F.regexp_extract(cleaned, r"(?s)(\{.*?\})", 1))

    def kind(key: str) -> Column:  # VOID is a JSON null; no value at all is a missing key
        return F.schema_of_variant(F.try_variant_get(reply, f"$.{key}", "variant"))

    def said(key: str) -> Column:
        return strip_text(F.try_variant_get(reply, f"$.{key}", "string"))

    number = said("confidence")
    special = number.rlike(r"(?i)^[+-]?(inf|infinity|nan)$")
    in_quotes = F.when(special, F.when(number.rlike("(?i)^-i"), 0.0).otherwise(1.0)).when(
        number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), number.try_cast("double")
    )
    j_conf = (
        F.when(kind("confidence").isNull(), 0.0)
        .when(kind("confidence") == "BOOLEAN", F.when(F.lower(number) == "true", 1.0).otherwise(0.0))
        .otherwise(in_quotes)
    )
    j_reason = (
        F.when(kind("reason").isNull(), "json")
        .when(kind("reason") == "VOID", "None")
        .when(kind("reason") == "BOOLEAN", F.initcap(said("reason")))
        .otherwise(F.try_variant_get(reply, "$.reason", "string"))
    )
    as_json = reply.isNotNull() & j_conf.isNotNull()
    letter = F.regexp_extract(F.upper(cleaned), r"\b([AB])\b", 1)
    share = F.regexp_extract(cleaned, r"(?i)(?:confidence|score)\D+([01](?:\.\d+)?)", 1)
    choice = F.when(as_json, F.upper(said("choice"))).otherwise(letter)
    conf = F.when(as_json, j_conf).otherwise(F.coalesce(share.try_cast("double"), F.lit(0.0)))
    return F.struct(
        F.when(choice == "B", "B").otherwise("A").alias("choice"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"),
        F.substring(F.when(as_json, j_reason).otherwise("fallback_parse"), 1, reason_chars).alias("reason"),
    )


# --- templates (P9, P10) ----------------------------------------------------------------

def render(template: str, fields: dict[str, Column | str]) -> Column:
    """Fill ``{name}`` placeholders from columns (null -> ''); split once on the driver into one ``concat``."""
    import re

    parts = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}") and piece[1:-1] in fields:
            parts.append(fill_empty(fields[piece[1:-1]]))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")
