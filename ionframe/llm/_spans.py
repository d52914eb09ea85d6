"""Spans of regular expressions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string>>"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a lambda evaluates an outer expression anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, start: Column, join, run: int = 64) -> Column:
    """For each value of an array what `join` makes of start and all values before it; join must be associative.
    Runs of values are joined first, then each run's own, so a long array costs some 32 steps a value and no more."""

    def scan(xs: Column, first: Column, of) -> Column:
        zero = F.struct(first.alias("now"), F.array_except(F.array(first), F.array(first)).alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(join(acc["now"], of(x)).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))["out"]

    def in_runs(runs: Column) -> Column:
        heads = scan(runs, start, lambda r: F.aggregate(r, start, join))
        return F.flatten(F.transform(F.arrays_zip(runs.alias("r"), heads.alias("h")), lambda p: scan(p["r"], p["h"], lambda x: x)))

    def cut(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / run).cast("int")), lambda k: F.slice(xs, k * run + 1, run))
        return F.when(F.size(xs) > run, let(runs, in_runs)).otherwise(scan(xs, start, lambda x: x))

    return let(values, cut)


def spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a pattern, as structs (start, end, hit) in code
    points, end exclusive. Texts without a match cost one pass of the pattern."""
    none = F.expr(f"cast(array() as {SPAN})")

    def one(p: Column) -> Column:
        first = p["at"] + F.char_length(p["pair"]["gap"])
        return F.struct(first.alias("start"), (first + F.char_length(p["pair"]["hit"])).alias("end"), p["pair"]["hit"].alias("hit"))

    def placed(pairs: Column) -> Column:
        at = before(F.transform(pairs, lambda p: F.char_length(p["gap"]) + F.char_length(p["hit"])), F.lit(0), lambda x, y: x + y)
        return F.transform(F.arrays_zip(at.alias("at"), pairs.alias("pair")), one)

    def found(hits: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"))
        return F.when(F.size(hits) > 0, let(pairs, placed)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def up_to(keys: Column, held: Column, start: Column, join) -> Column:
    """For each key of an array what `join` makes of start and the values `v` of all held structs (at, v) whose `at` is the
    key or less: one sort of both arrays and a running join in place of a test of each with each."""

    def sided(both: Column) -> Column:
        k, h = both["k"], both["h"]
        order = F.array_sort(F.concat(F.transform(h, lambda x: F.struct(x["at"].alias("at"), F.lit(0).alias("own"), F.lit(-1).alias("i"), x["v"].alias("v"))), F.transform(k, lambda x, i: F.struct(x.alias("at"), F.lit(1).alias("own"), i.alias("i"), start.alias("v")))))
        picked = let(order, lambda o: F.filter(F.arrays_zip(o.alias("o"), before(F.transform(o, lambda x: x["v"]), start, join).alias("v")), lambda p: p["o"]["own"] == 1))
        return F.transform(F.array_sort(F.transform(picked, lambda p: F.struct(p["o"]["i"].alias("i"), p["v"].alias("v")))), lambda p: p["v"])

    return let(F.struct(keys.alias("k"), held.alias("h")), sided)


FAR = 2147483647


def _ends(found: Column, held: Column) -> Column:
    """For each span the largest end of the held spans that start at or before it."""
    return up_to(F.transform(found, lambda s: s["start"]), F.transform(held, lambda s: F.struct(s["start"].alias("at"), s["end"].alias("v"))), F.lit(-1), lambda x, y: F.greatest(x, y))


def clear_of(found: Column, held: Column) -> Column:
    """The spans of found that overlap none of held; both are arrays of structs with start and end."""

    def tested(both: Column) -> Column:
        f, h = both["f"], both["h"]
        following = up_to(F.transform(f, lambda s: -s["start"]), F.transform(h, lambda s: F.struct((-s["start"]).alias("at"), s["start"].alias("v"))), F.lit(FAR), lambda x, y: F.least(x, y))
        seen = F.arrays_zip(f.alias("s"), _ends(f, h).alias("reach"), following.alias("next"))
        free = F.transform(F.filter(seen, lambda p: (p["reach"] <= p["s"]["start"]) & (p["next"] >= p["s"]["end"])), lambda p: p["s"])
        return F.when((F.size(f) > 0) & (F.size(h) > 0), free).otherwise(f)

    return let(F.struct(found.alias("f"), held.alias("h")), tested)


def outside(found: Column, held: Column) -> Column:
    """The spans of found that lie whole in none of held."""

    def tested(both: Column) -> Column:
        f, h = both["f"], both["h"]
        kept = F.transform(F.filter(F.arrays_zip(f.alias("s"), _ends(f, h).alias("reach")), lambda p: p["reach"] < p["s"]["end"]), lambda p: p["s"])
        return F.when((F.size(f) > 0) & (F.size(h) > 0), kept).otherwise(f)

    return let(F.struct(found.alias("f"), held.alias("h")), tested)


def islands(found: Column) -> Column:
    """Runs of spans, in order of start, that hang together by overlap: an array of arrays. found: structs that begin with start."""

    def cut(order: Column) -> Column:
        ends = before(F.transform(order, lambda s: s["end"]), F.lit(-1), lambda x, y: F.greatest(x, y))
        marked = F.transform(F.arrays_zip(order.alias("s"), ends.alias("e")), lambda p, i: F.when(p["s"]["start"] >= p["e"], i))
        firsts = F.filter(marked, lambda i: i.isNotNull())
        return let(firsts, lambda f: F.transform(f, lambda at, j: F.slice(order, at + 1, F.coalesce(F.get(f, j + 1), F.size(order)) - at)))

    return let(F.array_sort(found), cut)


def with_context(text: Column, found: Column, width: int = 40, run: int = 64) -> Column:
    """Spans (start, end, hit; in order) with `lead`, the text of at most width code points before each; cut from one stretch for each run of spans."""

    def whole(f: Column) -> Column:
        n = F.size(f)

        def stretch(k: Column) -> Column:
            own = F.slice(f, k * run + 1, run)
            base = F.greatest(F.lit(0), F.get(f, k * run)["start"] - width)
            cut = F.struct(base.alias("base"), F.substring(text, base + 1, F.get(f, F.least(k * run + run - 1, n - 1))["start"] - base).alias("text"))
            lead = lambda b, s: F.substring(b["text"], F.greatest(F.lit(0), s["start"] - width) - b["base"] + 1, F.least(s["start"], F.lit(width)))
            return let(cut, lambda b: F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), lead(b, s).alias("lead"))))

        return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int")), lambda k: n > 0), stretch))

    return let(found, whole)


def replaced(text: Column, pieces: Column, run: int = 64) -> Column:
    """text with each piece (start, end, put; in order, apart) replaced by what it puts. The text is cut into one stretch for
    each run of pieces first, so that no cut goes through the whole text for one piece."""

    def whole(p: Column) -> Column:
        n = F.size(p)
        end = lambda i: F.coalesce(F.get(p, i)["end"], F.lit(0))
        last = lambda k: F.least(k * run + run - 1, n - 1)

        def stretch(k: Column) -> Column:
            own = F.struct(end(k * run - 1).alias("base"), F.substring(text, end(k * run - 1) + 1, end(last(k)) - end(k * run - 1)).alias("text"))
            one = lambda b, i: F.concat(F.substring(b["text"], end(i - 1) - b["base"] + 1, F.get(p, i)["start"] - end(i - 1)), F.get(p, i)["put"])
            return let(own, lambda b: F.array_join(F.transform(F.sequence(k * run, last(k)), lambda i: one(b, i)), ""))

        made = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int")), stretch)
        return F.when(n > 0, F.concat(F.array_join(made, ""), F.substring(text, end(n - 1) + 1, F.lit(FAR)))).otherwise(text)

    return let(pieces, whole)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(number, F.char_length(number) - i + 1, 1)) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), step) % 10 == 0


def joined(found: Column) -> Column:
    """kind:start:end of structs that are in order, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))
