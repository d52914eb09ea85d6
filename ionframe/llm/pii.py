"""Personal data: fixed base patterns, and boosted trees over high-recall candidate spans.

Everything on the main path is a column expression. The trees are grown on the driver from a small
synthetic sample whose features come from the same expressions, and are turned into CASE expressions.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spans import clear_of, digits, islands, joined, luhn, replaced, spans, with_context

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
# The contract's patterns, with possessive repeats and a start only where a run starts or the last match
# ended: the same matches without backtracking, on texts of any length.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Candidate generators: loose forms of the same kinds, which overlap each other.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?[a-z0-9-]{2,}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[a-z0-9-]{2,}+)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){2}[\x20._/-]{1,3}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9.+])(?:00[0-9]{1,3}+[\x20.-]?)?+\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}[0-9]{2,5}+){1,4}+(?![0-9])",
}
CUES = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": r"\bip\b|addr|host|server|login from",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel|call|mobile|fax|whatsapp|anruf|appel|llama",
}
AGAINST = r"version|order|invoice|isbn|page|chapter|total|price|\bno\b|eur|usd|build|section"
FEATURES = ("kind", "n_digits", "n_chars", "separators", "luhn", "cue", "against", "marked", "year", "decimals", "groups")


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a base kind that pass its check."""
    found = spans(text, BASE[kind])
    if kind == "ip":
        ok = lambda s: F.forall(F.split(s["hit"], r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    elif kind == "card":
        ok = lambda s: F.char_length(digits(s["hit"])).between(13, 19) & luhn(digits(s["hit"]))
    elif kind == "phone":
        ok = lambda s: F.char_length(digits(s["hit"])).between(9, 15)
    else:
        return found
    return F.filter(found, ok)


def _features(s: Column, kind: str) -> list[Column]:
    hit, number = s["hit"], digits(s["hit"])
    before = F.lower(s["lead"])
    n = F.char_length(number)
    flag = lambda c: c.cast("double")
    return [
        F.lit(float(KINDS.index(kind))),
        flag(n),
        flag(F.char_length(hit)),
        flag(F.char_length(F.regexp_replace(hit, "[A-Za-z0-9]", ""))),
        flag(F.when(n.between(12, 19), luhn(number)).otherwise(F.lit(False))),
        flag(before.rlike(CUES[kind])),
        flag(before.rlike(AGAINST)),
        flag(hit.rlike(r"(?i)^00|^\(|\(at\)|\[at\]|\{at\}|@|\[\.\]")),
        flag(hit.rlike(r"^(?:19|20)[0-9]{2}(?![0-9])")),
        flag(hit.rlike(r"^[0-9]+[.,][0-9]+$")),
        flag(F.size(F.split(hit, r"[^A-Za-z0-9]+"))),
    ]


def candidates(text: Column, kind: str, base: Column | None = None) -> Column:
    """A generator's spans that overlap none of base, with their features: structs (start, end, f)."""
    found = spans(text, LOOSE[kind])
    free = found if base is None else clear_of(found, base)
    return F.transform(with_context(text, free), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(*_features(s, kind)).alias("f")))


def sample(n: int = 1200, seed: int = 6) -> list[tuple[str, int, str]]:
    """Invented snippets (kind, label, text): personal data in loose forms, and look-alikes."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(3, 8)))
    cue = {"email": ["mail", "e-mail:", "contact", "write to"], "ip": ["ip", "host", "server", "address"], "card": ["card", "visa", "credit card", "payment"], "phone": ["phone", "tel.", "call", "fax", "mobile"]}
    anti = ["version", "order", "invoice", "isbn", "page", "chapter", "total", "price", "build"]
    out = []
    for _ in range(n):
        kind, good = r.choice(KINDS), r.random() < 0.5
        lead = r.choice(cue[kind] if r.random() < (0.75 if good else 0.08) else (anti if r.random() < (0.02 if good else 0.6) else [word()]))
        if kind == "email":
            at, dot = r.choice([("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), ("{at}", "."), (" @ ", ".")])
            hit = f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}" if good else f"{word()} at {word()}. {word()}"
        elif kind == "ip":
            hit = r.choice(["[.]", " . ", "(.)"]).join(str(r.randint(1, 255)) for _ in range(4)) if good else r.choice([". ", " ."]).join(num(r.randint(1, 3)) for _ in range(4))
        elif kind == "card":
            body = [int(x) for x in num(15)]
            total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(body))
            full = "".join(map(str, body)) + str(-total % 10 if good else (1 - total) % 10)
            hit = r.choice([".", " - ", "/", "_"]).join(full[i : i + 4] for i in range(0, 16, 4))
        elif good:
            hit = r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"00{r.randint(30, 49)} {num(3)} {num(4)}", f"0{num(3)} {num(3)} {num(3)}", f"{num(3)}-{num(3)}-{num(4)}"])
        else:
            hit = r.choice([f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{num(3)}.{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)} {num(3)}", f"{num(4)}-{num(4)}-{num(5)}-{num(3)}"])
        out.append((kind, int(good), f"{word()} {lead} {hit} {word()}"))
    return out


def grow(x: list[list[float]], y: list[int], trees: int = 24, depth: int = 3, rate: float = 0.3) -> list:
    """Gradient-boosted regression trees for the logistic loss; a tree is a leaf value or
    (feature, threshold, tree at or below, tree above)."""
    import numpy as np

    x, y = np.array(x, float), np.array(y, float)
    score, out = np.zeros(len(y)), []

    def split(rows, g, h, left):
        value = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        if not left or len(rows) < 8:
            return value
        best, gain0 = None, g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):  # every threshold of every feature, by running sums
            order = rows[np.argsort(x[rows, f], kind="stable")]
            ends = np.flatnonzero(np.diff(x[order, f]) > 0)
            if len(ends):
                gl, hl = np.cumsum(g[order])[ends], np.cumsum(h[order])[ends]
                gains = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - gain0
                at = int(gains.argmax())
                if best is None or gains[at] > best[0] + 1e-12:
                    t = x[order[ends[at]], f]
                    best = (float(gains[at]), f, float(t), rows[x[rows, f] <= t], rows[x[rows, f] > t])
        if best is None or best[0] < 1e-6:
            return value
        return (best[1], best[2], split(best[3], g, h, left - 1), split(best[4], g, h, left - 1))

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = split(np.arange(len(y)), y - p, p * (1 - p), depth)
        out.append(tree)
        score += np.array([value(tree, row) for row in x])
    return out


def forest_sql(trees: list, f: Column) -> Column:
    """The sum of the trees' values at an array of features, as CASE expressions."""

    def case(tree) -> Column:
        return F.lit(float(tree)) if not isinstance(tree, tuple) else F.when(f[tree[0]] <= F.lit(tree[1]), case(tree[2])).otherwise(case(tree[3]))

    total = case(trees[0])
    for t in trees[1:]:
        total = total + case(t)
    return total


def train(spark: SparkSession, precision: float = 0.95) -> tuple[list, dict[str, float]]:
    """Trees, and for each kind the lowest score whose candidates in the second half of the sample
    have at least the wanted precision (none if no score has)."""
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(sample())], "i int, kind string, label int, text string")
    found = None
    for kind in KINDS:
        part = rows.where(F.col("kind") == kind).select("i", "kind", "label", F.explode(candidates(F.col("text"), kind)).alias("c")).select("i", "kind", "label", "c.f")
        found = part if found is None else found.unionAll(part)
    got = sorted(found.collect(), key=lambda r: (r["i"], r["f"]))
    half = [r for r in got if r["i"] % 2 == 0]
    trees = grow([r["f"] for r in half], [r["label"] for r in half])

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    bounds = {}
    for kind in KINDS:
        scored = sorted(((sum(value(t, r["f"]) for t in trees), r["label"]) for r in got if r["i"] % 2 and r["kind"] == kind), reverse=True)
        bounds[kind], right = float("inf"), 0
        for n, (s, label) in enumerate(scored, 1):
            right += label
            if right >= precision * n and (n == len(scored) or scored[n][0] < s):
                bounds[kind] = max(0.0, s)  # never below even odds
    return trees, bounds


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple | None = None) -> DataFrame:
    """doc_id, the base kinds' counts, base_sha256, spans, redacted of every row of docs.

    Base spans follow the contract's patterns and checks. A candidate is added if its score reaches its
    kind's threshold, it overlaps no base span, and no better candidate (equal ones: no earlier)
    overlaps it. redacted is the text with each span's characters replaced by its kind in brackets, spans that
    overlap one before them left to it. A null text is an empty one; texts are read whole. Rows
    are independent, so repeats, ties and null ids need no rule. Other columns are ignored. Empty
    input gives no rows.
    """
    trees, bounds = model or train(docs.sparkSession)
    text = F.col("text")
    df = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    df = df.withColumns({k: base_spans(text, k) for k in KINDS})
    kept = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(KINDS.index(k)).alias("nth"), s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    df = df.withColumn("base", F.concat(*map(kept, KINDS)))
    clash = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def scored(k: str) -> Column:
        graded = F.transform(candidates(text, k, F.col("base")), lambda c: F.struct(c["start"].alias("start"), forest_sql(trees, c["f"]).alias("score"), F.lit(KINDS.index(k)).alias("nth"), c["end"].alias("end"), F.lit(k).alias("kind")))
        return F.filter(graded, lambda c: c["score"] >= F.lit(bounds[k])) if bounds[k] < float("inf") else F.filter(graded, lambda c: F.lit(False))

    df = df.withColumn("more", F.concat(*map(scored, KINDS)))
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["nth"] < b["nth"]))))
    best = lambda run: F.filter(run, lambda c: ~F.exists(run, lambda o: clash(o, c) & better(o, c)))
    added = F.when(F.size("more") > 0, F.flatten(F.transform(islands(F.col("more")), best))).otherwise(F.col("more"))
    added = F.transform(added, lambda c: F.struct(c["nth"].alias("nth"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    df = df.withColumn("all", F.array_sort(F.concat(F.col("base"), added)))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), _redacted(text, F.col("all")).alias("redacted"))


def _redacted(text: Column, found: Column) -> Column:
    ordered = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    piece = lambda run: F.struct(F.get(run, F.lit(0))["start"].alias("start"), F.array_max(F.transform(run, lambda s: s["end"])).alias("end"), F.concat(F.lit("["), F.upper(F.get(run, F.lit(0))["kind"]), F.lit("]")).alias("put"))
    return F.when(F.size(found) > 0, replaced(text, F.transform(islands(ordered), piece))).otherwise(text)
