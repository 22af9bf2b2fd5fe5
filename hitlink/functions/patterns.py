"""Regex building blocks shared by the Spark expressions (Java regex) and the
DuckDB oracle (RE2).

Python's ``re`` in str mode gives ``\\s``, ``\\w``, ``.`` and ``$`` Unicode and
line-aware meanings that neither Java nor RE2 share by default, so every pattern
here spells those classes out explicitly. The same pattern text then means the
same thing in both engines:

  S     one Python ``\\s`` character (str.isspace): ASCII controls, NEL and \\p{Z}
  W     one Python ``\\w`` character: letters, numbers, underscore
  DOT   Python ``.`` without DOTALL: anything but a newline
  END   Python ``$`` where the result is stripped afterwards: an optional final
        newline, then the end of input
"""

from __future__ import annotations

WS_CHARS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\p{Z}"
WORD_CHARS = r"\p{L}\p{N}_"

S = f"[{WS_CHARS}]"
W = f"[{WORD_CHARS}]"
NOT_WORD_NOT_SPACE = f"[^{WORD_CHARS}{WS_CHARS}]"
DOT = r"[^\n]"
END = r"\n?\z"

# Python str.strip(): whitespace at both ends. As a character set (for btrim) it
# is generated from Python itself: exactly the characters of the S class above.
WS_STRING = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
STRIP = f"^{S}+|{S}+\\z"
# Python str.split() separator.
SPLIT_WS = f"{S}+"

# Wikipedia-style footnote marker: \[\w[\w\s]*\]
FOOTNOTE = f"\\[{W}[{WORD_CHARS}{WS_CHARS}]*\\]"
PIPE = r"\|"

# --- Fixed values (must equal the reference's for equal results) ---------------
# Quote characters stripped from the ends of a title.
#   first version, leading set:  " U+201C U+2018
#   first version, trailing set: " U+201D U+2019
#   second version, both ends:   " U+201C U+2018 U+2019 U+201D
QUOTES_LEAD_V1 = '"“‘'
QUOTES_TRAIL_V1 = '"”’'
QUOTES_BOTH_V2 = '"“‘’”'
# Featured-artist separators. "wide" adds the ampersand.
FEAT_WORDS = [r"featuring", r"feat\.?", r"ft\.?", r"with"]
FEAT_WORDS_WIDE = FEAT_WORDS + ["&"]
# Version words cut from a base title.
VERSION_WORDS = ["remix", "mix", "edit", "version", "instrumental", "karaoke", "live",
                 "reprise", "remaster", "acoustic", "radio", "extended", "club", "single",
                 "unplugged"]
# Dash characters that start a trailing qualifier: hyphen, en dash, em dash.
DASHES = "-–—"
# Stop words dropped from artist word sets.
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "feat", "ft", "featuring", "with"]
# Stage-name prefixes kept together with the next word.
STAGE_PREFIXES = ["dj", "lil", "young", "big", "rich", "mac", "jack", "dr", "mr", "ms",
                  "post", "bad", "pop", "slim"]
# Negative-sampling search terms.
SEARCH_TERMS = ["pop", "hip hop", "rock", "r&b", "dance", "indie", "country", "electronic",
                "soul", "alternative"]
# -------------------------------------------------------------------------------


def ci(pattern: str, engine: str) -> str:
    """Case-insensitive flag: Java needs ``u`` for Unicode folding, RE2 folds by default."""
    return ("(?iu)" if engine == "java" else "(?i)") + pattern


def quote_class(chars: str) -> str:
    return "[" + "".join("\\x{%04X}" % ord(c) for c in chars) + "]"


def feat_cut(wide: bool, word_boundary: bool, include_with: bool = True) -> str:
    """Pattern removing a featured-artist clause and everything after it.

    ``word_boundary=False`` reproduces the reference, whose ``\\s*`` prefix lets
    ``ft`` match inside a word ("daft punk featuring x" -> "da"). Otherwise the
    word stands at the start or after a character that is no word character; that
    character, such as the bracket of "(feat. X)", goes too. Without
    ``include_with`` a plain "with" stays ("stay with me") and a bracketed one is
    still cut.
    """
    words = list(FEAT_WORDS_WIDE if wide else FEAT_WORDS)
    if not word_boundary:
        if not include_with:
            words.remove("with")
        return f"{S}*(?:{'|'.join(words)}){S}+{DOT}*{END}"
    if include_with:
        return f"(?:^|[^{WORD_CHARS}])(?:{'|'.join(words)}){S}+{DOT}*{END}"
    words.remove("with")
    return f"(?:(?:^|[^{WORD_CHARS}])(?:{'|'.join(words)})|[(\\[]{S}*with){S}+{DOT}*{END}"


BRACKET = f"{S}*[\\(\\[]{DOT}*?[\\)\\]]"
DASH_CUT = f"{S}*[{DASHES}]{S}+{DOT}*{END}"
# \b after the keyword, spelled as "no word character follows".
VERSION_CUT = f"{S}+(?:{'|'.join(VERSION_WORDS)})(?:[^{WORD_CHARS}\\n]{DOT}*)?{END}"
NON_KEY_CHARS = f"[^a-z0-9{WS_CHARS}]"
AMP_CUT = f"{S}*&{S}+{DOT}*{END}"
COMMA_CUT = f",{DOT}*{END}"

# First element of a stringified list: ['a', ...] or ["a", ...]
LIST_FIRST_SQ = f"^\\[{S}*'((?:[^'\\\\\\n]|\\\\{DOT})*)'{S}*[,\\]]"
LIST_FIRST_DQ = f"^\\[{S}*\"((?:[^\"\\\\\\n]|\\\\{DOT})*)\"{S}*[,\\]]"
UNESCAPE = r"\\(.)"
LIST_START = f"^\\[{S}*['\"]"
LIST_ITEM = "'[^'\\n]*'|\"[^\"\\n]*\""
