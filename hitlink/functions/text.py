"""Text normalisation as built-in Column expressions.

Everything stays JVM-side (regexp_replace, lower, split, array functions), so it
runs inside whole-stage codegen; no Python UDF is involved.

Where the reference has a known defect, the default is the fixed behaviour and
``reference=True`` reproduces the original (see README, "Deliberate differences").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

J = "java"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sub(c: Column, pattern: str, repl: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(repl))


def strip(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends (plain ``trim``
    only strips spaces). ``btrim`` with the character set is ~4x cheaper than the
    equivalent regex."""
    return F.btrim(_c(c), F.lit(P.WS_STRING))


def strip_quotes_v1(c) -> Column:
    """Outer quotes, first version (asymmetric sets), then strip. Trimming character sets is ~4x cheaper than a
    regex; one final newline may follow the quotes, and the strip would drop it anyway."""
    t = F.ltrim(_c(c), F.lit(P.QUOTES_LEAD_V1))
    t = F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t)
    return strip(F.rtrim(t, F.lit(P.QUOTES_TRAIL_V1)))


def strip_quotes_v2(c) -> Column:
    """All five quote characters at both ends (no strip; callers strip)."""
    q = P.quote_class(P.QUOTES_BOTH_V2)
    return _sub(_c(c), f"^{q}+|{q}+{P.END}")


def remove_footnotes(c) -> Column:
    return _sub(_c(c), P.FOOTNOTE)


def punctuation_noise(c) -> Column:
    """T4: footnotes out, pipes out, a run of one punctuation character -> one, strip."""
    t = _sub(_c(c), f"{P.FOOTNOTE}|{P.PIPE}")  # no footnote holds a pipe: one pass finds both
    t = _sub(t, f"({P.NOT_WORD_NOT_SPACE})\\1+", "$1")
    return strip(t)


def clean_title_v1(c, reference: bool = False) -> Column:
    """T5: quotes, noise, lower, strip.

    The reference strips quotes before footnotes, which leaves a quote in front of
    a removed footnote (D8); by default footnotes go first.
    """
    t = _c(c)
    if not reference:
        t = remove_footnotes(t)
    t = punctuation_noise(strip_quotes_v1(t))
    return F.lower(t)  # already stripped; lowering adds no whitespace


def clean_title_v2(c) -> Column:
    """Strip, footnotes, outer quotes (five kinds), strip, lower."""
    t = remove_footnotes(strip(c))
    t = strip(strip_quotes_v2(t))
    return F.lower(t)


def clean_artist(c) -> Column:
    """Noise, lower, strip (the noise step already strips)."""
    return F.lower(punctuation_noise(c))


def light_clean(c) -> Column:
    """Footnotes, strip, lower."""
    return F.lower(strip(remove_footnotes(c)))


def lead_artist(c, reference: bool = False) -> Column:
    """Cut at the first featuring separator (``&`` included), strip.

    The reference has no left word boundary ("daft punk featuring x" -> "da", D1).
    """
    pat = P.ci(P.feat_cut(wide=True, word_boundary=not reference), J)
    return strip(_sub(_c(c), pat))


def lead_artist_v2(c, reference: bool = False) -> Column:
    """Cut at separators without ``&``, then at ``&``, then at the first comma."""
    a = strip(c)
    a = _sub(a, P.ci(P.feat_cut(wide=False, word_boundary=not reference), J))
    a = _sub(a, P.AMP_CUT)
    a = _sub(a, P.COMMA_CUT)
    return F.lower(strip(a))


def short_artist(c) -> Column:
    """First word, or the first two when the first is a stage-name prefix."""
    s = strip(c)
    words = F.split(s, P.SPLIT_WS)
    first = F.element_at(words, 1)
    prefixes = F.array(*[F.lit(w) for w in P.STAGE_PREFIXES])
    return (F.when(s == "", _c(c))
             .when((F.size(words) >= 2) & F.array_contains(prefixes, F.lower(first)),
                   F.concat_ws(" ", first, F.element_at(words, 2)))
             .otherwise(first))


def norm(c, role: str = "artist", reference: bool = False) -> Column:
    """Exact linkage key. lower, strip, cut the featuring clause, keep
    ``a-z0-9`` and whitespace, strip. Inner whitespace is not collapsed.

    ``role="title"`` does not cut at "with" ("stay with me" stays whole, D2) unless
    ``reference=True``.
    """
    t = strip(F.lower(_c(c)))
    include_with = reference or role != "title"
    t = _sub(t, P.ci(P.feat_cut(wide=False, word_boundary=not reference,
                                include_with=include_with), J))
    t = _sub(t, P.NON_KEY_CHARS)
    return strip(t)


def norm_base(c, role: str = "title", reference: bool = False) -> Column:
    """Base key. As ``norm`` and also drops ``(...)``/``[...]``, a trailing
    dash clause and a trailing version word (remix, live, radio ...)."""
    t = strip(F.lower(_c(c)))
    include_with = reference or role != "title"
    t = _sub(t, P.ci(P.feat_cut(wide=False, word_boundary=not reference,
                                include_with=include_with), J))
    t = _sub(t, P.BRACKET)
    t = _sub(t, P.DASH_CUT)
    t = _sub(t, P.ci(P.VERSION_CUT, J))
    t = _sub(t, P.NON_KEY_CHARS)
    return strip(t)


def first_list_item(c) -> Column:
    """First element of a stringified list (``['a', 'b']`` or ``["a"]``);
    the raw text when it is not such a list or the list is empty."""
    c = _c(c)
    sq = F.regexp_extract(c, P.LIST_FIRST_SQ, 1)
    dq = F.regexp_extract(c, P.LIST_FIRST_DQ, 1)
    return (F.when(c.rlike(P.LIST_FIRST_SQ), _sub(sq, P.UNESCAPE, "$1"))
             .when(c.rlike(P.LIST_FIRST_DQ), _sub(dq, P.UNESCAPE, "$1"))
             .otherwise(c))


def word_set(c, alnum: bool = False) -> Column:
    """Distinct ``[a-z]+`` runs (``[a-z0-9]+`` with ``alnum``) of the lowercased
    text, minus the stop words. Returned sorted so it is deterministic."""
    runs = F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]+" if alnum else "[a-z]+"), 0)
    stop = F.array(*[F.lit(w) for w in P.STOP_WORDS])
    return F.array_sort(F.array_except(F.array_distinct(runs), stop))


def jaccard(expected_words: Column, candidate_words: Column) -> Column:
    """|a ∩ b| / |a ∪ b|; 0.0 when the expected side is empty."""
    inter = F.size(F.array_intersect(expected_words, candidate_words))
    union = F.size(F.array_union(expected_words, candidate_words))
    return F.when(F.size(expected_words) == 0, F.lit(0.0)).otherwise(inter / union)


def artist_similarity(expected, candidate, alnum: bool = False) -> Column:
    return jaccard(word_set(expected, alnum), word_set(candidate, alnum))


def canonical_number_text(c) -> Column:
    """Numbers as canonical text, so 21 and 21.0 give the same key; other text stripped."""
    s = strip(_c(c).cast("string"))
    dbl = s.try_cast("double")
    return (F.when(dbl.isNotNull() & (dbl == F.floor(dbl)) & (F.abs(dbl) < 1e15),
                   dbl.cast("bigint").cast("string"))
             .otherwise(s))


def identity_key(year, rank, title_clean, title, primary_artist, artist) -> Column:
    """(year, rank, cleaned title else title, lead artist else artist), text
    parts stripped and the last two lowered."""
    return F.struct(
        canonical_number_text(year).alias("k_year"),
        canonical_number_text(rank).alias("k_rank"),
        F.lower(strip(F.coalesce(_c(title_clean), _c(title)))).alias("k_title"),
        F.lower(strip(F.coalesce(_c(primary_artist), _c(artist)))).alias("k_artist"),
    )


def list_items(c) -> Column:
    """All names of a stringified list (``['a', "b"]``); a plain string is one name."""
    c = _c(c)
    quoted = F.regexp_extract_all(c, F.lit(P.LIST_ITEM), 0)
    items = F.transform(quoted, lambda x: F.substring(x, 2, F.length(x) - 2))
    return F.when(c.rlike(P.LIST_START), items).otherwise(F.array(c))
