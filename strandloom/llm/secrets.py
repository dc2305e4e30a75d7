"""Secrets in texts: fixed patterns and sliding-window entropy, in SQL expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, how many characters a match needs, and of which group.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 12), ("access", r"AKIA[A-Z0-9]+", 18), ("hex", r"[0-9a-f]{16,}", 16)]

#: name, candidate strings, alphabet, window, least bits a character, marks that a candidate must hold
CLASSES = [
    ("entropy_hex", r"[0-9A-Fa-f]{32,}", "0123456789abcdefABCDEF", 32, 3.2, [r"[0-9]", r"[A-Fa-f]"]),
    ("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0, [r"[A-Z]", r"[a-z]", r"[0-9]"]),
    ("entropy_lower", r"[a-z0-9]{24,}", "abcdefghijklmnopqrstuvwxyz0123456789", 24, 3.75, [r"[g-z]", r"[0-9]"]),
    ("entropy_upper", r"[A-Z0-9]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 24, 3.75, [r"[G-Z]", r"[0-9]"]),
    ("entropy_letters", r"[A-Za-z]{32,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 32, 4.4, [r"[A-Z]", r"[a-z]"]),
]
ANY = r"[A-Za-z0-9+/_=-]{24,}"  # what candidates of every class are part of
#: Allow-list: of whole candidates, and of the segments that these marks part them into.
ALLOWED = [r"^sha(1|256|384|512)-", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^(.)\1*$"]
ALLOWED_SEGMENTS = r"(?i)example|placeholder"
SEGMENTS = r"[^/_=+.-]+|[/_=+.-]+"

SPAN = "struct<kind:string,start:int,end:int,found:string>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once: inside a lambda it is a variable."""
    return F.transform(F.array(value), use)[0]


def running_totals(numbers: Column) -> Column:
    """Inclusive running sums of an array, in as many passes as its size has binary digits."""
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(numbers) + F.lit(1))).cast("int"), F.lit(0)))

    def step(sums: Column, k: Column) -> Column:
        reach = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - reach), F.lit(0)))

    return F.aggregate(passes, numbers, step)


def matches(text: Column, kind: str, pattern: str) -> Column:
    """The leftmost non-overlapping matches as an array of SPAN, in code points.

    Spark extracts matches but not their places. Splitting at the same pattern
    gives the text between them, and running sums of both lengths the places.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def spans(found: Column) -> Column:
        between = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda gap: F.char_length(gap))
        steps = F.zip_with(between, found, lambda gap, hit: gap + F.char_length(hit))
        return F.zip_with(running_totals(steps), found, lambda end, hit: F.struct(F.lit(kind).alias("kind"), (end - F.char_length(hit)).alias("start"), end.alias("end"), hit.alias("found")))

    return F.when(F.regexp_like(text, F.lit(pattern)), bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    """Matches of the base patterns that are long enough, by kind.

    A maximal run of 16 or more hex digits is matched by either form of the hex
    pattern, so the shorter runs, of which texts are full, are not collected.
    """

    def long_enough(kind: str, pattern: str, least: int) -> Column:
        own = lambda hit: F.regexp_extract(hit, pattern, 1) if kind == "assign" else hit
        return F.filter(matches(text, kind, pattern), lambda s: F.char_length(own(s["found"])) >= least)

    return [long_enough(*base) for base in BASE]


SCALE = 1 << 40  # terms c * log2(c) are whole numbers of this fineness, so that sums never drift
ZERO = 48  # the character that stands for a count of zero


def blanked(candidate: Column, allowed: str = ALLOWED_SEGMENTS) -> Column:
    """The candidate with blanks for the segments that the allow-list has; nothing else moves."""
    hide = lambda part: F.when(F.regexp_like(part, F.lit(allowed)), F.repeat(F.lit(" "), F.char_length(part))).otherwise(part)
    return F.when(F.regexp_like(candidate, F.lit(allowed)), F.array_join(F.transform(F.regexp_extract_all(candidate, F.lit(SEGMENTS), F.lit(0)), hide), "")).otherwise(candidate)


def high_runs(candidate: Column, alphabet: str, window: int, bits: float) -> Column:
    """[(first, last)]: maximal runs of overlapping windows of high entropy, by the ends, from 1, of their first and last window.

    The fold keeps the counts, as one string with a character for each member
    of the class, and the sum of c * log2(c). A step reads and overlays two
    counts, that of the entering character and that of the leaving one, so its
    cost depends neither on the candidate's length nor on the window's; entropy
    is log2(window) less the sum over the window's size. A character that is
    not of the class, such as a blank, begins the window anew.
    """
    terms = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c > 1 else 0).cast("long") for c in range(window + 2)])
    most = math.floor(((math.log2(window) - bits) * window + 1e-9) * SCALE)
    empty = F.lit(chr(ZERO) * len(alphabet))
    start = F.struct(empty.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit("").alias("runs"))
    count = lambda counts, place: F.ascii(F.substring(counts, place, F.lit(1))) - ZERO
    put = lambda counts, place, n: F.overlay(counts, F.char(n + ZERO), place, F.lit(1))

    def step(state: Column, move: Column) -> Column:
        i = state["i"] + 1

        def leave(s: Column) -> Column:  # the leaving character, where the window is full
            falls = bound(count(s["counts"], move["leaves"]), lambda c: F.struct(put(s["counts"], move["leaves"], c - 1).alias("counts"), (s["sum"] - F.get(terms, c) + F.get(terms, c - 1)).alias("sum"), (state["n"] - 1).alias("n")))
            return F.when(state["n"] == window, falls).otherwise(s)

        def enter(s: Column) -> Column:
            rises = bound(count(s["counts"], move["enters"]), lambda c: F.struct(put(s["counts"], move["enters"], c + 1).alias("counts"), (s["sum"] + F.get(terms, c + 1) - F.get(terms, c)).alias("sum"), (s["n"] + 1).alias("n")))
            return F.when(move["enters"] > 0, rises).otherwise(F.struct(empty.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")))

        def judge(s: Column) -> Column:
            high = (s["n"] == window) & (s["sum"] <= most)
            apart = high & (state["first"] > 0) & (i - window >= state["last"])
            runs = F.when(apart, F.concat(state["runs"], state["first"].cast("string"), F.lit(":"), state["last"].cast("string"), F.lit(","))).otherwise(state["runs"])
            first = F.when(high & (apart | (state["first"] == 0)), i).otherwise(state["first"])
            return F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), s["n"].alias("n"), i.alias("i"), first.alias("first"), F.when(high, i).otherwise(state["last"]).alias("last"), runs.alias("runs"))

        return bound(bound(leave(F.struct(state["counts"].alias("counts"), state["sum"].alias("sum"), state["n"].alias("n"))), enter), judge)

    def ends(s: Column) -> Column:
        last = F.when(s["first"] > 0, F.concat(s["first"].cast("string"), F.lit(":"), s["last"].cast("string"))).otherwise(F.lit(""))
        pairs = F.filter(F.split(F.concat(s["runs"], last), ","), lambda x: x != "")
        return F.transform(pairs, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("int").alias("first"), F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("last")))

    def fold(places: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(0), window), F.slice(places, 1, F.greatest(F.size(places) - window, F.lit(0))))
        moves = F.zip_with(places, F.slice(leaving, 1, F.size(places)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
        return F.aggregate(moves, start, step, ends)

    return bound(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c)), fold)


def entropy_spans(text: Column, classes=CLASSES, allowed=ALLOWED, allowed_segments=ALLOWED_SEGMENTS) -> Column:
    """Spans of every class; a text without a candidate of any is looked at once."""

    def of_class(kind: str, pattern: str, alphabet: str, window: int, bits: float, marks: list[str]) -> Column:
        def runs(s: Column) -> Column:
            def span(r: Column) -> Column:
                first = r["first"] - window
                return F.struct(F.lit(kind).alias("kind"), (s["start"] + first).alias("start"), (s["start"] + r["last"]).alias("end"), F.substring(s["found"], first + 1, r["last"] - first).alias("found"))

            return F.transform(high_runs(blanked(s["found"], allowed_segments), alphabet, window, bits), span)

        has = lambda s: reduce(and_, [F.regexp_like(s["found"], F.lit(m)) for m in marks], F.lit(True))
        is_allowed = lambda s: reduce(or_, [F.regexp_like(s["found"], F.lit(a)) for a in allowed], F.lit(False))
        found = F.filter(matches(text, kind, pattern), lambda s: has(s) & ~is_allowed(s))
        return F.filter(F.flatten(F.transform(found, runs)), has)

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(F.regexp_like(text, F.lit(ANY)), F.concat(*[of_class(*c) for c in classes])).otherwise(none)


def in_order(spans: Column) -> Column:
    """By start, then by kind as listed: base kinds first, then the classes."""
    kinds = [k for k, *_ in BASE] + [k for k, *_ in CLASSES]
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("nth"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(in_order(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """(doc_id, assign, access, hex, added) of every row: arrays of SPAN, no shuffle.

    assign, access and hex are the matches of the base patterns. added are
    maximal runs of overlapping windows of high entropy in candidate strings of
    each character class. An allow-list pattern suppresses a whole candidate,
    or of one parted by / _ = + . and - the segments that hold an allowed word;
    what stands beside these is still looked at. The allow-list never takes
    base matches away.

    A null text counts as empty. Repeated rows and null ids are read like any
    other; other columns are not looked at; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign, access, digits = base_spans(text)
    return docs.select(F.col(id_col).alias("doc_id"), assign.alias("assign"), access.alias("access"), digits.alias("hex"), entropy_spans(text, classes, allowed).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, "added")).alias("spans"),
    )
