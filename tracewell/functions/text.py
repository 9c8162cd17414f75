"""Text rules as Spark expressions: normalised words, phrases, hidden characters, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number names and the digits they are compared as.
NUMBER_NAMES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety"
).split()
NUMBER_VALUES = [*range(21), *range(30, 100, 10)]
#: Most bytes and most words of a query.
MAX_QUERY_BYTES, MAX_QUERY_WORDS = 256, 16
SEP = "\u0001"
#: Java's letters-or-digits by Unicode property.
WORD = r"[\p{IsAlphabetic}\p{N}]"
#: Ranges of code points that are not seen or only steer how others are shown.
HIDDEN_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x0600, 0x0605), (0x061C, 0x061C), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891),
    (0x08E2, 0x08E2), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x2028, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD),
    (0x13430, 0x1343F), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
HIDDEN = "[" + "".join(f"\\x{{{first:X}}}-\\x{{{last:X}}}" for first, last in HIDDEN_RANGES) + "]"


def normalise_words(text: Column) -> Column:
    """``array<string>``: lower-case words of letters and digits.

    A comma before exactly three digits and a hyphen inside a word vanish, a point
    between digits stays and trailing zeros after it don't count, number names are
    digits; everything else separates. Accents are kept. Null stays null.
    """
    t = F.lower(text)
    # each pattern begins with the character that it is about, which Java looks for fast
    t = F.regexp_replace(t, r",(?<=[0-9],)(?=[0-9]{3}(?![0-9]))", "")
    t = F.regexp_replace(t, f"-(?<={WORD}-)(?={WORD})", "")
    t = F.regexp_replace(t, r"\.(?<![0-9]\.)|\.(?![0-9])|[^\p{IsAlphabetic}\p{N}.]+", " ")
    names = F.create_map(*[F.lit(x) for pair in zip(NUMBER_NAMES, map(str, NUMBER_VALUES), strict=True) for x in pair])
    decimal = r"^[0-9]+\.[0-9]+$"
    plain = lambda w: F.regexp_replace(F.regexp_replace(w, "0+$", ""), r"\.$", "")
    value = lambda w: F.when(w.contains(".") & w.rlike(decimal), plain(w)).when(w.isin(*NUMBER_NAMES), F.try_element_at(names, w)).otherwise(w)
    return F.transform(F.filter(F.split(t, " +"), lambda w: w != ""), value)


def query_problem(text: Column) -> Column:
    """Why a query can't be searched for, null if it can: ``too_long``, ``control_character``, ``empty`` or ``too_many_terms``."""
    n = F.size(normalise_words(text))
    return (
        F.when(F.octet_length(text) > MAX_QUERY_BYTES, "too_long").when(text.rlike(r"\p{Cc}"), "control_character")
        .when(F.coalesce(n, F.lit(0)) <= 0, "empty").when(n > MAX_QUERY_WORDS, "too_many_terms")
    )


def phrase_pattern(words: Column) -> Column:
    """The pattern of a phrase: its letters run on, a word end allowed between any two, and words begin and end it."""
    letters = F.filter(F.split(F.array_join(words, ""), ""), lambda c: c != "")
    escaped = F.transform(letters, lambda c: F.when(c == ".", r"\.").otherwise(c))
    return F.concat(F.lit(f"(^|{SEP})"), F.array_join(escaped, f"{SEP}?"), F.lit(f"({SEP}|$)"))


def phrase_match(words: Column, query: Column) -> Column:
    """Whether some whole words run together are the query's words run together."""
    return (F.size(query) > 0) & F.call_function("rlike", F.array_join(words, SEP), phrase_pattern(query))


def all_terms_match(words: Column, terms: Column) -> Column:
    """Whether every term is one of the words."""
    return (F.size(terms) > 0) & (F.size(F.array_except(terms, words)) == 0)


def match_tier(words: Column, query: Column) -> Column:
    """1 for the phrase, 2 for all terms in any order, null for neither."""
    return F.when(phrase_match(words, query), 1).when(all_terms_match(words, query), 2)


def _code(character: Column) -> Column:
    """The character's code point, four hexadecimal digits or more."""
    digits = F.conv(F.hex(F.encode(character, "UTF-32")), 16, 16)
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def is_hidden(text: Column) -> Column:
    return text.rlike(HIDDEN)


def render_hidden(text: Column) -> Column:
    """Each hidden character as ``<U+XXXX>``."""
    shown = lambda c: F.when(c.rlike(HIDDEN), F.concat(F.lit("<U+"), _code(c), F.lit(">"))).otherwise(c)
    return F.when(is_hidden(text), F.array_join(F.transform(F.split(text, ""), shown), "")).otherwise(text)


def sanitize(text: Column, max_bytes: int) -> Column:
    """Control characters as U+FFFD, cut before the character that would pass ``max_bytes``."""
    clean = F.regexp_replace(text, r"\p{Cc}", "\ufffd")
    cut = F.aggregate(
        F.split(clean, ""), F.struct(F.lit(0).alias("n"), F.lit("").alias("t")),
        lambda a, c: F.struct((a["n"] + F.octet_length(c)).alias("n"), F.when(a["n"] + F.octet_length(c) <= max_bytes, F.concat(a["t"], c)).otherwise(a["t"]).alias("t")),
        lambda a: a["t"],
    )
    return F.when(F.octet_length(clean) <= max_bytes, clean).otherwise(cut)


def strip_markup(text: Column, webvtt: bool = False) -> Column:
    """Tags of at most 256 characters out, and of SubRip the ``{\\...}`` blocks; WebVTT references by their characters."""
    out = F.regexp_replace(text, r"</?[A-Za-z][^<>]{0,254}>" if not webvtt else r"<[^<>]{0,254}>", "")
    if not webvtt:
        return F.regexp_replace(out, r"\{\\[^{}]{0,253}\}", "")
    for name, character in (("lt", "<"), ("gt", ">"), ("nbsp", " "), ("lrm", "\u200e"), ("rlm", "\u200f"), ("amp", "&")):
        out = F.regexp_replace(out, f"&{name};", character)
    return out


def voice_label(payload: Column) -> Column:
    """The one speaker of a WebVTT payload's voice spans, null if none or several."""
    voices = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(payload, F.lit(r"<v[.\w]*[ \t]+([^<>]{1,254})>"), 1), F.trim), lambda v: v != ""))
    return F.when(F.size(voices) == 1, voices[0])


def one_line(text: Column) -> Column:
    """White-space controls as one blank, other control characters as ``<U+XXXX>``."""
    spaced = F.regexp_replace(text, r"[\t\n\x0b\f\r\u0085\u2028\u2029]+", " ")
    shown = F.array_join(F.transform(F.split(spaced, ""), lambda c: F.when(c.rlike(r"\p{Cc}"), F.concat(F.lit("<U+"), _code(c), F.lit(">"))).otherwise(c)), "")
    return F.when(spaced.rlike(r"\p{Cc}"), shown).otherwise(spaced)


def subrip_text(text: Column) -> Column:
    """One line in which no arrow can pass for a timing line."""
    return F.regexp_replace(one_line(text), "--+>", "->")


def seam_words(text: Column) -> Column:
    """Words between white space, letters and digits alone, lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}\s]+", "")), r"\s+"), lambda w: w != "")


def derive_id(prefix: str, domain: str, *parts: Column) -> Column:
    """``prefix_`` and 32 hexadecimal digits of a digest of the domain and the parts, each with its length."""
    sized = [F.concat(F.octet_length(p.cast("string")), F.lit(":"), p.cast("string")) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.left(F.sha2(F.concat_ws("|", F.lit(domain), *sized), 256), F.lit(32)))


def milliseconds(time_us: Column, mark: str = ",") -> Column:
    """``HH:MM:SS,mmm`` of a time in microseconds."""
    ms = F.floor(time_us / 1000).cast("long")
    return F.concat(
        F.lpad(F.floor(ms / 3_600_000).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((F.floor(ms / 60_000) % 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"),
    )
