"""Secrets: fixed base patterns, and weak candidates that complementary parts nearby confirm.

Column expressions only; nothing is shuffled, since a scope never leaves its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spans import FAR, clear_of, joined, let, outside, spans, up_to

KINDS = ("assign", "access", "hex")
_VALUE = "[A-Za-z0-9+/_.=-]"
# The contract's patterns; possessive repeats and a start at the start of a run keep them linear.
BASE = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+{_VALUE}++",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
# Parts of a credential: who (access identifiers), what (secrets), where (endpoints). Values have no upper length: possessive repeats over one class.
PARTS = {
    "who": r"(?i:(?<![a-z0-9_])(?:user(?:name)?|login|account|client_?id|key_?id)[\"']?+\x20?[:=]\x20?[\"']?[a-z0-9@._-]{3,}+)|(?<![A-Z0-9])(?:ASIA|AKIA|AIza)[A-Za-z0-9_-]{8,}+",
    "what": r"(?i:(?<![a-z0-9_])(?:pwd|pass|passphrase|auth|bearer|credential|private_?key)[\"']?+\x20?[:=]\x20?[\"']?)[^\s\"',;]{4,}+",
    "where": r"(?i)(?<![a-z])(?:https?|jdbc:[a-z]{2,}+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s?ftp|ssh|ldaps?)://[^\s\"'<>]{3,}+|(?<![a-z0-9_])(?:host(?:name)?|endpoint|bucket|database|dsn)[\"']?+\x20?[:=]\x20?[\"']?[a-z0-9.:/_-]{3,}+",
}
# A secret without a keyword: a whole run of token characters that has a digit and both cases, wherever in it.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])"
# Where a block of text ends: at a blank line. A block on one line also ends at a long gap.
BREAK = r"\n[\x20\t\r]*+\n|(?<!\s)\s{%d,}+"


def base_spans(text: Column, kind: str) -> Column:
    found = spans(text, BASE[kind])
    if kind == "assign":
        value = lambda s: F.regexp_extract(s["hit"], rf"(?:(?i:password|passwd|secret|token|api_?key))[\"']?+\x20*+[:=]\x20*+[\"']?+({_VALUE}++)$", 1)
        return F.filter(found, lambda s: F.char_length(value(s)) >= 6)
    return F.filter(found, lambda s: F.char_length(s["hit"]) >= 20) if kind == "access" else found


def _plain(found: Column, nth: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _in_blocks(parts: Column, breaks: Column) -> Column:
    """Parts with the number of block ends before them: structs (part, block)."""
    number = up_to(F.transform(parts, lambda s: s["start"] - 1), F.transform(breaks, lambda at: F.struct(at.alias("at"), F.lit(1).alias("v"))), F.lit(0), lambda x, y: x + y)
    return F.transform(F.arrays_zip(parts.alias("p"), number.alias("n")), lambda z: F.struct(z["p"].alias("part"), z["n"].alias("block")))


def _near(parts: Column, others: Column, reach: int) -> Column:
    """The parts with one of the others, apart from them, in their block or less than `reach` away. The others on each side that end or
    start nearest, and whose block is nearest, decide."""
    value = lambda at, to, block: F.struct(at.alias("at"), F.struct(to.alias("to"), block.alias("block")).alias("v"))
    most = lambda x, y: F.struct(F.greatest(x["to"], y["to"]).alias("to"), F.greatest(x["block"], y["block"]).alias("block"))
    first = F.struct(F.lit(-FAR).alias("to"), F.lit(-FAR).alias("block"))

    def tested(both: Column) -> Column:
        p, o = both["p"], both["o"]
        left = up_to(F.transform(p, lambda s: s["part"]["start"]), F.transform(o, lambda s: value(s["part"]["end"], s["part"]["end"], s["block"])), first, most)
        right = up_to(F.transform(p, lambda s: -s["part"]["end"]), F.transform(o, lambda s: value(-s["part"]["start"], -s["part"]["start"], -s["block"])), first, most)
        seen = F.arrays_zip(p.alias("s"), left.alias("l"), right.alias("r"))
        long = lambda c: c.cast("long")
        held = lambda z: (long(z["s"]["part"]["start"]) - z["l"]["to"] < reach) | (z["l"]["block"] == z["s"]["block"]) | (-long(z["r"]["to"]) - z["s"]["part"]["end"] < reach) | (-z["r"]["block"] == z["s"]["block"])
        return F.transform(F.filter(seen, held), lambda z: z["s"])

    return let(F.struct(parts.alias("p"), others.alias("o")), tested)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, linked of every row of docs.

    Base spans follow the contract's patterns and checks. Weak parts are access identifiers (who), secrets (what)
    and endpoints (where). A weak secret or identifier is reported, as kind `what` or `who`, only
    if the complement lies within its scope: a secret needs an identifier or an endpoint, an identifier needs a secret, in
    the same block of text (up to a blank line, or `reach` code points of white space) at any distance, or else
    with less than `reach` code points between the end of one and the start of the other. Base `access` spans count as
    identifiers, base `assign` and `hex` spans as secrets; weak parts that overlap a base span give
    way. Parts and complements are joined as intervals, by a sort of both and the nearest on each side, so a text
    with very many of them costs no pairs. linked counts the reported parts. spans orders by start, then assign,
    access, hex, who, what.

    A null text is an empty one; texts are read whole. Rows are independent, so repeats, ties and null ids
    need no rule. Other columns are ignored. Empty input gives no rows.
    """
    text = F.col("text")
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    df = df.withColumns({k: base_spans(text, k) for k in KINDS})
    df = df.withColumn("base", F.concat(*[_plain(F.col(k), i, k) for i, k in enumerate(KINDS)]))
    free = lambda p, n, k, ok=lambda s: F.lit(True): clear_of(_plain(F.filter(spans(text, p), ok), n, k), F.col("base"))
    df = df.withColumns({"who": free(PARTS["who"], 3, "who"), "named": free(PARTS["what"], 4, "what"), "where": free(PARTS["where"], 5, "where")})
    mixed = lambda s: s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Z]") & s["hit"].rlike("[a-z]")
    df = df.withColumn("what", F.concat("named", outside(free(TOKEN, 4, "what", mixed), F.col("named"))))
    ids = F.concat(F.col("who"), _plain(F.col("access"), 1, "access"))
    df = df.withColumns({"keys": F.concat(F.col("what"), _plain(F.col("assign"), 0, "assign"), _plain(F.col("hex"), 2, "hex")), "places": F.concat(ids, F.col("where"))})
    both = (F.size("keys") > 0) & (F.size("places") > 0)
    none = F.filter("named", lambda p: F.lit(False))
    df = df.withColumn("breaks", F.when(both, F.transform(spans(text, BREAK % reach), lambda s: s["start"])).otherwise(F.expr("cast(array() as array<int>)")))
    df = df.withColumns({k: F.when(both, _in_blocks(F.col(k), F.col("breaks"))) for k in ("who", "what", "keys", "places")})
    weak = F.concat(_near(F.col("who"), F.col("keys"), reach), _near(F.col("what"), F.col("places"), reach))
    df = df.withColumn("weak", F.when(both, F.transform(weak, lambda s: s["part"])).otherwise(none))
    df = df.withColumn("base", F.array_sort("base"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "weak"))).alias("spans"), F.size("weak").cast("long").alias("linked"))
