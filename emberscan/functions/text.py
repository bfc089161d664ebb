"""Text clean-up as column expressions. Whole texts, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, and the emoji ranges to drop.
SPACE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NON_SPACE = "[^" + SPACE[1:]
EMOJI = (r"[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}\x{2190}-\x{21ff}\x{2b00}-\x{2bff}\x{1f1e6}-\x{1f1ff}"
         r"\x{fe00}-\x{fe0f}\x{200d}]")
DOT_MARK, DASH_MARK = "", ""

# (pattern, replacement) in order: links, handles, tags, emoji, protected dots
# and hyphens, punctuation and symbols.
NORMALISE_STEPS = [
    (r"(?i)https?://" + NON_SPACE + "+", " URL "),
    (r"(?i)\bwww\." + NON_SPACE + "+", " URL "),
    (f"(^|{SPACE})@([A-Za-z0-9_]+)", "$1$2"),
    (f"(^|{SPACE})#([A-Za-z0-9_]+)", "$1$2"),
    (EMOJI, ""),
    (r"([A-Za-z0-9_])\.([A-Za-z0-9_])", "$1" + DOT_MARK + "$2"),
    (r"([A-Za-z0-9_])-([A-Za-z0-9_])", "$1" + DASH_MARK + "$2"),
    (r"[\p{P}\p{S}]", " "),
]

_WORD = "[A-Za-z0-9_]"
# The same steps for Java's matcher, which tries a pattern at every position: each begins with a character that few positions have.
# Its \b counts any letter and RE2's only ASCII, hence the lookbehind. Of "a.b.c" only the first dot is taken, as the first match has
# the b; so a match goes on over a second dot. Punctuation and white space go in one pass, which leaves single blanks alone.
_BLANKS = r"\p{P}\p{S}" + SPACE[1:-1]
JVM_STEPS = [
    (r"[hH](?i:ttps?)://" + NON_SPACE + "+", " URL "),
    (r"[wW](?<!\w[wW])(?i:ww)\." + NON_SPACE + "+", " URL "),
    (f"[@#](?<=(?:^|{SPACE})[@#])(?={_WORD})", ""),
    (r"[\x{200d}-\x{10ffff}&&" + EMOJI + "]", ""),
    (rf"\.(?<={_WORD}\.)({_WORD}\.?)", DOT_MARK + "$1"),
    (rf"-(?<={_WORD}-)({_WORD}-?)", DASH_MARK + "$1"),
    (rf"[\x00-\x1f!-/:-@\[-`{{-\x{{10ffff}}&&[{_BLANKS}]][{_BLANKS}]*| [{_BLANKS}]+", " "),
]

# Entities decoded after tags are removed, in this order.
HTML_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x2F;", "/"), ("&#39;", "'"), ("&nbsp;", " ")]


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    runs = rf"[\x09-\x1f\x{{a0}}-\x{{feff}}&&{SPACE}]{SPACE}*| {SPACE}+"  # all but single blanks, which stay
    return F.trim(F.regexp_replace(text, runs, " "))


def normalise(text: Column) -> Column:
    """Canonical form used for content hashes."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in JVM_STEPS:
        out = F.regexp_replace(out, pattern, to)
    for mark, char in ((DOT_MARK, "."), (DASH_MARK, "-")):
        out = F.replace(out, F.lit(mark), F.lit(char))  # ``translate`` makes a string of every character
    return F.trim(F.lower(out))


def tokens(text: Column) -> Column:
    """Lower-cased white-space tokens without links, in text order."""
    bare = F.regexp_replace(F.lower(text), r"https?://" + NON_SPACE + "+", " ")
    plain = F.regexp_replace(bare, rf"[\x09-\x1f\x{{a0}}-\x{{feff}}&&{SPACE}]", " ")
    return F.filter(F.split(plain, " "), lambda t: F.length(t) > 0)  # one plain character is split without a matcher


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(text)))


def shingles(words: Column, k: int = 5) -> Column:
    """Distinct k-word shingles; texts with fewer words use pairs of characters, empty ones have none."""
    n = F.size(words)
    joined = F.array_join(words, " ")
    by_word = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (k - 1))), lambda i: F.array_join(F.slice(words, i, k), " "))
    chars = F.length(joined)
    by_char = F.when(chars >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), chars - 1)), lambda i: F.substring(joined, i, 2))).when(chars == 1, F.array(joined)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.when(n >= k, by_word).otherwise(by_char)))


def content_hash(external_id: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", external_id.cast("string"), normalise(text)))


def mention_id(source: Column, external_id: Column) -> Column:
    return F.concat_ws(":", source, external_id.cast("string"))


def strip_html(html: Column) -> Column:
    """Drop tags, decode the common entities, collapse white space."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def sanitise(text: Column) -> Column:
    """Unwrap code fences and back-ticks, unescape quotes, drop tags."""
    out = F.regexp_replace(text, r"```(?:json)?[\t\n\f\r ]*([\s\S]*?)```", "$1")
    out = F.regexp_replace(out, "`([^`]+)`", "$1")
    out = F.replace(F.replace(out, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))
    return collapse(F.regexp_replace(out, "<[^>]+>", ""))


def mask_key(key: Column) -> Column:
    """First five and last four characters stay visible."""
    return F.concat(F.substring(key, 1, 5), F.lit("…"), F.right(key, F.lit(4)))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host; no query, fragment or trailing slash."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    tail = F.regexp_replace(F.substring(bare, F.length(head) + 1, F.length(bare)), "/+$", "")
    return F.concat(F.lower(head), tail)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def parse_date(raw: Column) -> Column:
    """RFC-822, ISO-8601, compact UTC or epoch seconds; epoch zero otherwise."""
    rfc = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|Z)$", " +0000")
    # JVM date formats are only tried on values of the right outline, so a bad
    # value ends in the fallback and never in an error.
    forms = [
        (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", rfc, "d MMM yyyy HH:mm:ss Z"),
        (r"^\d{8}T\d{6}Z?$", F.regexp_replace(raw, "Z$", ""), "yyyyMMdd'T'HHmmss"),
    ]
    out = F.lit(None).cast("timestamp")
    for outline, value, form in forms:
        out = F.coalesce(out, F.when(value.rlike(outline) | raw.rlike(outline), F.try_to_timestamp(value, F.lit(form))))
    epoch = F.when(raw.rlike(r"^\d{1,11}$"), F.timestamp_seconds(raw.try_cast("bigint")))
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), raw.try_cast("timestamp"))
    return F.coalesce(out, epoch, iso, F.lit("1970-01-01 00:00:00").cast("timestamp")).cast("timestamp_ntz")


def community(source: Column, url: Column, subreddit: Column) -> Column:
    """Stable community id: sub-forum, instance or feed host, ``hn``; else the source."""
    host = F.nullif(url_host(url), F.lit(""))
    return F.coalesce(
        F.when(source == "reddit", F.nullif(F.lower(subreddit), F.lit(""))).when(source == "hn", F.lit("hn"))
        .when(source.isin("bluesky", "rss", "gdelt"), host),
        source)
