"""DuckDB SQL twins of ``hitlink.functions.text``, for the oracle queries only.

Each function takes a SQL expression (text) and returns a SQL expression built
from the same pattern text as the Spark version (RE2 reads it the same way; see
``functions/patterns.py``). RE2 has no back-references, so the punctuation-run
rule is written as a list filter over characters.
"""

from __future__ import annotations

from ..functions import patterns as P

R = "re2"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


def strip(x: str) -> str:
    return f"trim({x}, {lit(P.WS_STRING)})"


def strip_quotes_v1(x: str) -> str:
    pat = f"^{P.quote_class(P.QUOTES_LEAD_V1)}+|{P.quote_class(P.QUOTES_TRAIL_V1)}+{P.END}"
    return strip(sub(x, pat))


def strip_quotes_v2(x: str) -> str:
    q = P.quote_class(P.QUOTES_BOTH_V2)
    return sub(x, f"^{q}+|{q}+{P.END}")


def remove_footnotes(x: str) -> str:
    return sub(x, P.FOOTNOTE)


def collapse_runs(x: str) -> str:
    """``([^\\w\\s])\\1+`` -> ``\\1`` without back-references: drop a character equal to
    the one before it when it is neither word nor space."""
    return ("(SELECT array_to_string(list_filter(_l, lambda ch, i: i = 1 OR ch <> _l[i - 1] "
            f"OR NOT regexp_full_match(ch, {lit(P.NOT_WORD_NOT_SPACE)})), '') "
            f"FROM (SELECT string_split({x}, '') AS _l))")


def punctuation_noise(x: str) -> str:
    t = remove_footnotes(x)
    t = sub(t, P.PIPE)
    t = collapse_runs(t)
    return strip(t)


def clean_title_v1(x: str, reference: bool = False) -> str:
    t = x if reference else remove_footnotes(x)
    t = punctuation_noise(strip_quotes_v1(t))
    return strip(f"lower({t})")


def clean_title_v2(x: str) -> str:
    t = remove_footnotes(strip(x))
    t = strip(strip_quotes_v2(t))
    return f"lower({t})"


def clean_artist(x: str) -> str:
    return strip(f"lower({punctuation_noise(x)})")


def light_clean(x: str) -> str:
    return f"lower({strip(remove_footnotes(x))})"


def lead_artist(x: str, reference: bool = False) -> str:
    return strip(sub(x, P.ci(P.feat_cut(wide=True, word_boundary=not reference), R)))


def lead_artist_v2(x: str, reference: bool = False) -> str:
    a = strip(x)
    a = sub(a, P.ci(P.feat_cut(wide=False, word_boundary=not reference), R))
    a = sub(a, P.AMP_CUT)
    a = sub(a, P.COMMA_CUT)
    return f"lower({strip(a)})"


def short_artist(x: str) -> str:
    s = strip(x)
    w = f"regexp_split_to_array({s}, {lit(P.SPLIT_WS)})"
    prefixes = "[" + ", ".join(lit(p) for p in P.STAGE_PREFIXES) + "]"
    return (f"(CASE WHEN {s} = '' THEN {x} "
            f"WHEN len({w}) >= 2 AND list_contains({prefixes}, lower({w}[1])) "
            f"THEN {w}[1] || ' ' || {w}[2] ELSE {w}[1] END)")


def _feat(reference: bool, include_with: bool) -> str:
    return P.ci(P.feat_cut(wide=False, word_boundary=not reference, include_with=include_with), R)


def norm(x: str, role: str = "artist", reference: bool = False) -> str:
    t = strip(f"lower({x})")
    t = sub(t, _feat(reference, reference or role != "title"))
    t = sub(t, P.NON_KEY_CHARS)
    return strip(t)


def norm_base(x: str, role: str = "title", reference: bool = False) -> str:
    t = strip(f"lower({x})")
    t = sub(t, _feat(reference, reference or role != "title"))
    t = sub(t, P.BRACKET)
    t = sub(t, P.DASH_CUT)
    t = sub(t, P.ci(P.VERSION_CUT, R))
    t = sub(t, P.NON_KEY_CHARS)
    return strip(t)


def first_list_item(x: str) -> str:
    sq = sub(f"regexp_extract({x}, {lit(P.LIST_FIRST_SQ)}, 1)", P.UNESCAPE, "\\1")
    dq = sub(f"regexp_extract({x}, {lit(P.LIST_FIRST_DQ)}, 1)", P.UNESCAPE, "\\1")
    return (f"(CASE WHEN regexp_matches({x}, {lit(P.LIST_FIRST_SQ)}) THEN {sq} "
            f"WHEN regexp_matches({x}, {lit(P.LIST_FIRST_DQ)}) THEN {dq} ELSE {x} END)")


def word_set(x: str, alnum: bool = False) -> str:
    runs = f"regexp_extract_all(lower({x}), {lit('[a-z0-9]+' if alnum else '[a-z]+')})"
    stop = "[" + ", ".join(lit(w) for w in P.STOP_WORDS) + "]"
    return (f"list_sort(list_filter(list_distinct({runs}), "
            f"lambda w: NOT list_contains({stop}, w)))")


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE {inter} / {union} END)"


def canonical_number_text(x: str) -> str:
    s = strip(f"CAST({x} AS VARCHAR)")
    d = f"TRY_CAST({s} AS DOUBLE)"
    return (f"(CASE WHEN {d} IS NOT NULL AND {d} = floor({d}) AND abs({d}) < 1e15 "
            f"THEN CAST(CAST({d} AS BIGINT) AS VARCHAR) ELSE {s} END)")


def list_items(x: str) -> str:
    items = f"list_transform(regexp_extract_all({x}, {lit(P.LIST_ITEM)}), lambda s: s[2:-2])"
    return f"(CASE WHEN regexp_matches({x}, {lit(P.LIST_START)}) THEN {items} ELSE [{x}] END)"
