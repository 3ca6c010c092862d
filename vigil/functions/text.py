"""Text expressions: cleaning, tokenising, stop words, n-grams, lengths.

All of it is built from Spark SQL string and higher-order functions, so it runs inside
the JVM, in whole-stage code generation where Spark supports it, on whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values (must equal the monitored system's preprocessing) -------------------
# Whitespace as Python's str.isspace() defines it, written as a regex character class.
PY_SPACE = r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
URL_PATTERN = rf"http[^{PY_SPACE}]+"  # step 1: http followed by non-space
HTTP_PATTERN = "http"  # step 2: the bare word, case-sensitive
HANDLE_PATTERN = rf"@[^{PY_SPACE}]+"  # step 3: @ followed by non-space
KEEP_CLASS = r'''[^A-Za-z0-9(),!?@'`"_\n]'''  # step 4: anything else becomes a space
TOKEN_PATTERN = r"\b[A-Za-z][A-Za-z]+\b"  # tokens: two or more ASCII letters
NGRAM_RANGE = (1, 3)
# Spark MLlib's English stop words, in its order.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
    hers herself it its itself they them their theirs themselves what which who whom this that these
    those am is are was were be been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where
    why how all any both each few more most other some such no nor not only own same so than too very s
    t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
    they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
    weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
    couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
    would
    """.split()
)
# ---------------------------------------------------------------------------------------

# TOKEN_PATTERN in lower-case text of any characters: its word boundaries are those of cleaned (ASCII) text.
LOWER_TOKEN = r"(?<![a-z0-9_])[a-z]{2,}+(?![a-z0-9_])"
LOWERED_TO_ASCII = ("\u0130", "\u212a")  # the only other characters whose lower case has an ASCII letter
JAVA_SPACE = r"[ \t\n\x{0B}\f\r]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text) -> Column:
    """The seven-step cleaner, in order: drop URLs, drop 'http', drop @handles, map every
    character outside the kept class to a space, '@' -> ' at ', lower case, then trim and
    collapse whitespace."""
    t = _c(text)
    t = F.regexp_replace(t, URL_PATTERN, "")
    t = F.regexp_replace(t, HTTP_PATTERN, "")
    t = F.regexp_replace(t, HANDLE_PATTERN, "")
    t = F.regexp_replace(t, KEEP_CLASS, " ")
    t = F.replace(t, F.lit("@"), F.lit(" at "))
    t = F.lower(t)
    return F.trim(F.regexp_replace(t, JAVA_SPACE, " "))


def tokens(cleaned) -> Column:
    """All matches of the token pattern, in order (ARRAY<STRING>)."""
    return F.regexp_extract_all(_c(cleaned), F.lit(TOKEN_PATTERN), 0)


def default_stop_words() -> tuple[str, ...]:
    """Spark MLlib's English stop-word list (``StopWordsRemover.loadDefaultStopWords``)."""
    return ENGLISH_STOP_WORDS


def remove_stop_words(toks, stop_words: tuple[str, ...] | None = None) -> Column:
    """Drop stop words, keeping order and duplicates (not ``array_except``, which dedupes)."""
    words = list(stop_words or default_stop_words())  # isin over literals becomes a hash set
    return F.filter(_c(toks), lambda t: ~F.lower(t).isin(words))


def ngrams(toks, n: int) -> Column:
    """Space-joined n-grams of a token array (empty when there are fewer than n tokens).

    Built by zipping n shifted slices of the array: one pass, no per-position sub-array."""
    t = _c(toks)
    if n == 1:
        return t
    k = F.greatest(F.size(t) - F.lit(n - 1), F.lit(0))
    out = F.slice(t, 1, k)
    for j in range(2, n + 1):
        out = F.zip_with(out, F.slice(t, j, k), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def ngram_terms(toks, lo: int = NGRAM_RANGE[0], hi: int = NGRAM_RANGE[1]) -> Column:
    """Unigrams .. hi-grams, concatenated (n-gram order, then position)."""
    return F.concat(*[ngrams(toks, n) for n in range(lo, hi + 1)])


def char_length(text) -> Column:
    """Length in characters (code points)."""
    return F.length(_c(text))


def word_count(text) -> Column:
    """Number of whitespace-separated words (empty pieces dropped); null for null text."""
    t = _c(text)
    return F.when(t.isNotNull(), F.size(F.filter(F.split(t, JAVA_SPACE), lambda w: w != "")))


def clean_tokens(text) -> Column:
    """``tokens(clean_text(text))`` without the cleaned text in between. URLs and handles are looked for
    only where a text has their first characters. What the cleaner maps to a space ends a token all the same,
    but for the two letters beyond ASCII whose lower case is ASCII; runs of spaces and the ends hold none."""
    t = _c(text)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, URL_PATTERN, ""), HTTP_PATTERN, ""), HANDLE_PATTERN, "")
    marked = F.contains(t, F.lit(HTTP_PATTERN)) | F.contains(t, F.lit("@"))
    t = F.when(marked, F.replace(bare, F.lit("@"), F.lit(" at "))).otherwise(t)
    for letter in LOWERED_TO_ASCII:
        t = F.replace(t, F.lit(letter), F.lit(" "))
    return F.regexp_extract_all(F.lower(t), F.lit(LOWER_TOKEN), 0)


def analyzed_tokens(text) -> Column:
    """clean -> tokens -> stop words: the vectoriser's token list per text.

    Project this into a column before calling `ngram_terms` on it: an expression used
    inside a lambda is re-evaluated for every element, so the n-gram lambdas must read a
    column, not the cleaning expression."""
    return remove_stop_words(clean_tokens(text))


def _raw(pattern: str) -> str:
    """A Spark SQL raw literal for a regex (the apostrophe written as a regex escape)."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def clean_text_sql(col: str) -> str:
    """`clean_text` as Spark SQL text, for SQLTransformer stages that are saved with a model."""
    t = f"regexp_replace({col}, {_raw(URL_PATTERN)}, '')"
    t = f"regexp_replace({t}, {_raw(HTTP_PATTERN)}, '')"
    t = f"regexp_replace({t}, {_raw(HANDLE_PATTERN)}, '')"
    t = f"regexp_replace({t}, {_raw(KEEP_CLASS)}, ' ')"
    t = f"lower(replace({t}, '@', ' at '))"
    return f"trim(regexp_replace({t}, {_raw(JAVA_SPACE)}, ' '))"


def tokens_sql(col: str) -> str:
    """`clean_tokens` as Spark SQL text."""
    bare = col
    for pattern in (URL_PATTERN, HTTP_PATTERN, HANDLE_PATTERN):
        bare = f"regexp_replace({bare}, {_raw(pattern)}, '')"
    t = f"if(contains({col}, '{HTTP_PATTERN}') OR contains({col}, '@'), replace({bare}, '@', ' at '), {col})"
    for letter in LOWERED_TO_ASCII:
        t = f"replace({t}, '{letter}', ' ')"
    return f"regexp_extract_all(lower({t}), {_raw(LOWER_TOKEN)}, 0)"
