"""Words that facts are matched by: numbers in words are read as numbers, units have one name, clock times two spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import NUMBER_NAMES, WORD

SMALL = {name: i for i, name in enumerate(NUMBER_NAMES[:20])}
TENS = {name: 10 * i for i, name in enumerate(NUMBER_NAMES[20:], 2)}
#: Units and the name they are compared by.
UNITS = {"milliseconds": "ms", "millisecond": "ms", "seconds": "s", "second": "s"}
#: What each number word is: S below 20, T a ten, U a ten and a unit in one word, H hundred, K thousand, A and.
KINDS = (
    {name: ("S", n) for name, n in SMALL.items()} | {name: ("T", n) for name, n in TENS.items()}
    | {ten + unit: ("U", n + m) for ten, n in TENS.items() for unit, m in SMALL.items() if 1 <= m <= 9}
    | {"hundred": ("H", 100), "thousand": ("K", 1000), "and": ("A", 0)}
)


def tokens(text: Column) -> Column:
    """``array<string>``: lower-case words; a hyphen inside a word and a comma between digits vanish, a point between digits stays, zeros at a decimal's end don't count."""
    t = F.regexp_replace(F.lower(text), f"-(?<={WORD}-)(?={WORD})", "")
    t = F.regexp_replace(t, r",(?<=[0-9],)(?=[0-9])", "")
    t = F.regexp_replace(t, r"\.(?<![0-9]\.)|\.(?![0-9])|[^\p{IsAlphabetic}\p{N}.]+", " ")
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    plain = lambda w: F.when(w.contains("."), F.regexp_replace(F.regexp_replace(w, "0+$", ""), r"\.$", "")).otherwise(w)
    word = lambda w: F.when(w.isin(*UNITS), F.try_element_at(units, w)).otherwise(plain(w))
    return F.transform(F.filter(F.split(t, " +"), lambda w: w != ""), word)


def _continues(a: Column, x: Column) -> Column:
    """Whether the word ``x`` goes on with the number that ``a`` has open."""
    number, after = x["k"].isin("S", "T", "U"), a["k"]
    return (after != "") & (
        (number & (after.isin("H", "K", "A") | ((after == "T") & (x["k"] == "S") & x["v"].between(1, 9))))
        | ((x["k"] == "H") & after.isin("S", "T", "U") & ~a["hundred"] & a["now"].between(1, 99))
        | ((x["k"] == "K") & after.isin("S", "T", "U", "H") & (a["thousands"] == 0) & (a["now"] > 0))
        | ((x["k"] == "A") & after.isin("H", "K") & x["next"])
    )


def _read(marked: Column) -> Column:
    """The words of an array of (w, k, v), each number of them as one."""
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    state = lambda out, k, thousands, now, hundred: F.struct(out.alias("out"), k.alias("k"), thousands.alias("thousands"), now.alias("now"), hundred.alias("hundred"))
    rows = F.transform(marked, lambda x, i: F.struct(x["w"].alias("w"), x["k"].alias("k"), x["v"].alias("v"), F.coalesce(F.get(marked, i + 1)["k"].isin("S", "T", "U"), F.lit(False)).alias("next")))
    # a word that closes the last number and adds nothing
    end = F.array(F.struct(F.lit("").alias("w"), F.lit("").alias("k"), zero.alias("v"), F.lit(False).alias("next")))

    def step(a: Column, x: Column) -> Column:
        begins = x["k"].isin("S", "T", "U")
        grown = state(
            a["out"], x["k"], F.when(x["k"] == "K", a["now"] * 1000).otherwise(a["thousands"]),
            F.when(x["k"] == "K", zero).when(x["k"] == "H", a["now"] * 100).otherwise(a["now"] + x["v"]), F.when(x["k"] == "K", False).when(x["k"] == "H", True).otherwise(a["hundred"]),
        )
        closed = F.when(a["k"] == "", none).otherwise(F.array((a["thousands"] + a["now"]).cast("string")))
        out = F.concat(a["out"], closed, F.when(begins | (x["w"] == ""), none).otherwise(F.array(x["w"])))
        fresh = state(out, F.when(begins, x["k"]).otherwise(""), zero, F.when(begins, x["v"]).otherwise(zero), F.lit(False))
        return F.when(_continues(a, x), grown).otherwise(fresh)

    return F.aggregate(F.concat(rows, end), state(none, F.lit(""), zero, zero, F.lit(False)), step, lambda a: a["out"])


def fact_words(text: Column) -> Column:
    """``array<string>``: :func:`tokens`, with each longest number in words, up to 999,999, as its digits. Null stays null.

    A number is one below 100 (a ten and a unit may stand apart), that many hundreds
    and an optional rest, or as many thousands and a rest; "and" joins only what
    follows hundred or thousand. Digits are never joined, and "one two" are two
    numbers. One pass over the words carries the number that is open; a text without
    number words isn't gone through.
    """
    table = F.create_map(*[x for name, (kind, n) in KINDS.items() for x in (F.lit(name), F.struct(F.lit(kind).alias("k"), F.lit(n).cast("long").alias("v")))])
    kind = lambda w: F.when(w.isin(*KINDS), F.try_element_at(table, w))
    mark = lambda w: F.struct(w.alias("w"), F.coalesce(kind(w)["k"], F.lit("")).alias("k"), F.coalesce(kind(w)["v"], F.lit(0).cast("long")).alias("v"))
    marked = F.transform(tokens(text), mark)
    # the marked words as the variable of a transform over one, so that they are worked out once
    some = lambda m: F.when(F.exists(m, lambda x: x["k"].isin("S", "T", "U")), _read(m)).otherwise(F.transform(m, lambda x: x["w"]))
    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(marked), some), 1))


def time_alternative(term: Column) -> Column:
    """The term with a full stop for the colon of each clock time (H:MM or HH:MM); null if it has none."""
    dotted = F.regexp_replace(term, r":(?<=(?<![0-9A-Za-z])[0-9]{1,2}:)(?=[0-5][0-9](?![0-9]))", ".")
    return F.when(dotted != term, dotted)


def contains_sequence(words: Column, phrase: Column) -> Column:
    """Whether the words of ``phrase`` (at least one) stand in ``words`` one after another."""
    spaced = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(phrase) > 0) & F.call_function("contains", spaced(words), spaced(phrase))


def states(text: Column, term: Column) -> Column:
    """Whether a text states a term: its words, or those with its clock times dotted, in one run."""
    words, other = fact_words(text), time_alternative(term)
    # only a term with a clock time has a second way, for which the text's words are worked out again
    return contains_sequence(words, fact_words(term)) | F.coalesce(F.when(other.isNotNull(), contains_sequence(words, fact_words(other))), F.lit(False))
