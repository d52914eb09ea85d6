"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

The sketch fills its bins in rounds: in round i < t every shingle is thrown by a fresh hash into one
of t bins with a value in [i, i+1), in rounds t..2t-1 into bin i - t, and each bin keeps its
smallest value. The first t rounds fill all bins with high probability, the last t surely, so every
coordinate exists, two sets agree on a coordinate with probability equal to their Jaccard similarity, and
the number of agreements is concentrated as with t independent hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunks, components, mix64, only, stored

T = 160  # coordinates; 40 bands of 4, each packed into one long
ROWS = 4
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; words are what ASCII white space
    parts, with A-Z lower-cased. Fewer words than width: their whole sequence is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h = h * _K + w[i : len(w) - k + 1 + i]
    return np.unique(mix64(h + np.uint64(k)))


def sketch(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """One row of t coordinates per set; no set may be empty."""
    sizes = np.array([len(s) for s in sets])
    x, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * t):
        h = mix64(x ^ mix64(np.array([i + 1], np.uint64) * _K))
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        np.minimum.at(out, doc * t + bins, (h & np.uint64(0xFFFFFFFF)) | np.uint64(i) << np.uint64(32))
        open_ = (out.reshape(-1, t) == np.iinfo(np.uint64).max).any(1)
        if not open_.any():
            break
        if i < 8 or i % 8 == 0:  # sets that are full need no further round
            keep = open_[doc]
            x, doc = x[keep], doc[keep]
    return out.reshape(-1, t)


def bands(sk: np.ndarray) -> np.ndarray:
    """Runs of four coordinates as longs of four 16-bit lanes: a band's identity, and its coordinates."""
    return np.ascontiguousarray(sk.astype(np.uint16)).view(np.int64)


def bits(sk: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, packed into longs; equal coordinates agree, others half the time."""
    packed = np.packbits((sk & np.uint64(1)).astype(np.uint8), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.int64)


def _digests(batches, t, width):
    for batch in batches:
        for part in chunks(batch, "text", 4 << 20):
            sets = [shingles(x, width) for x in part.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            lists: list = [None] * len(sets)
            low: list = [None] * len(sets)
            if full:
                sk = sketch([sets[i] for i in full], t)
                for i, row, few in zip(full, bands(sk), bits(sk), strict=True):
                    lists[i], low[i] = row, few
                    keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands", "bits"],
            )


def _verify(batches, num, den):
    """Rows come sorted by (pivot, salt, role): the pivot's sets (role 0), then its partners'."""
    at, pivots = None, []
    for batch in batches:
        found: tuple[list, list] = ([], [])
        for part in chunks(batch, "members"):
            for pivot, salt, role, other, members in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                s = np.frombuffer(members, np.uint64)
                if (pivot, salt) != at:
                    at, pivots = (pivot, salt), []
                if role == 0:
                    pivots.append(s)
                    continue
                for p in pivots:
                    both = np.concatenate([p, s])
                    both.sort(kind="stable")
                    same = int(np.count_nonzero(both[1:] == both[:-1]))
                    if den * same >= num * (len(both) - same):
                        found[0].append(pivot)
                        found[1].append(other)
                        break
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def _verify_blocks(batches, num, den):
    """Rows come sorted by (bucket, run, part, role): a block of heads (role 0), then the rows that they are compared with.
    One link for each head and component of the others: intersections of an other with all heads at once, by an index of the heads' shingles."""
    at, heads, index, known = None, [], None, set()
    for batch in batches:
        found: tuple[list, list] = ([], [])
        for part in chunks(batch, "members"):
            for *key, role, node, comp, members in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                s = np.frombuffer(members, np.uint64)
                if key != at:
                    at, heads, index, known = key, [], None, set()
                if role == 0:
                    heads.append((node, comp, s))
                    continue
                if index is None:
                    sizes = np.array([len(h) for _, _, h in heads])
                    flat = np.concatenate([h for _, _, h in heads])
                    order = flat.argsort(kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) > 0]))
                    index = flat[order][first], first, np.diff(np.append(first, len(flat))), np.repeat(np.arange(len(heads)), sizes)[order], sizes, np.array([c for _, c, _ in heads])
                keys, start, run, owner, sizes, comps = index
                place = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                place = place[keys[place] == s]
                n = run[place]
                spread = np.repeat(start[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
                same = np.bincount(owner[spread], minlength=len(heads))
                for i in np.flatnonzero((den * same >= num * (sizes + len(s) - same)) & (comps != comp)):
                    if (i, comp) not in known:
                        known.add((i, comp))
                        found[0].append(heads[i][0])
                        found[1].append(node)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def _linked_blocks(live: DataFrame, sets: DataFrame, num: int, den: int, heads: int = 128, rows: int = 512) -> DataFrame:
    """Links (a, b) between rows of different components of a bucket: those outside its largest component, in blocks of about `heads`,
    against all of its rows, in parts of about `rows`. Sets go along; pairs that fail are never written."""
    runs, parts = F.ceil(F.col("others") / heads).cast("int"), F.ceil(F.col("size") / rows).cast("int")
    own = live.join(sets.select("node", "members"), "node")
    number = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    head = own.where("comp <> main").select("bucket", number(runs, 1).alias("run"), each(parts).alias("part"), F.lit(0).alias("role"), "node", "comp", "members")
    other = own.select("bucket", each(runs).alias("run"), number(parts, 2).alias("part"), F.lit(1).alias("role"), "node", "comp", "members")
    dealt = head.unionAll(other).repartition("bucket", "run", "part").sortWithinPartitions("bucket", "run", "part", "role")
    return dealt.mapInArrow(lambda b: _verify_blocks(b, num, den), "a long, b long")


def _sets(batches, width):
    """Candidates' sets, without rows that carry the same id and another set of shingles."""
    for batch in batches:
        for part in chunks(batch, "text"):
            rows = []
            for node, key, text in zip(*(part.column(c).to_pylist() for c in ("node", "set_key", "text")), strict=True):
                raw = shingles(text, width).tobytes()
                if xxhash.xxh3_128_digest(raw) == key:
                    rows.append((node, raw))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())], names=["node", "members"])


def _least_agreements(t: int, share: float, miss: float = 1e-6) -> int:
    """The largest k for which a set pair of that similarity agrees in fewer than k of t coordinates
    with probability miss at most."""
    total, k = 0.0, 0
    while total <= miss:
        total += math.comb(t, k) * share**k * (1 - share) ** (t - k)
        k += 1
    return k - 1


def _agreements(a: str, b: str) -> Column:
    """How many coordinates two packed sketches share: lanes that are zero after exclusive or."""
    x = F.zip_with(a, b, lambda u, v: u.bitwiseXOR(v))
    for shift, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x000F000F000F000F), (2, 0x0003000300030003), (1, 0x0001000100010001)):
        x = F.transform(x, _fold(shift, mask))
    return ROWS * F.size(a) - F.aggregate(x, F.lit(0), lambda total, v: total + F.bit_count(v.bitwiseAND(F.lit(0x0001000100010001))))


def _fold(shift: int, mask: int):
    return lambda v: v.bitwiseOR(F.shiftrightunsigned(v, shift).bitwiseAND(F.lit(mask)))


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int, salt_rows: int) -> DataFrame:
    """The pairs (pivot, other) that pass on full sets, as (a, b). A pivot's set is read once per salted run of its partners."""
    fans = stored(pairs.groupBy("pivot").agg(F.count("*").alias("k")), "fans")
    runs = F.ceil(F.col("k") / salt_rows).cast("int")
    salted = pairs.join(fans, "pivot").select("pivot", "other", F.pmod(F.xxhash64("other"), runs).cast("int").alias("salt"))
    partners = salted.join(sets.withColumnRenamed("node", "other"), "other").select("pivot", "salt", F.lit(1).alias("role"), "other", "members")
    heads = fans.select("pivot", F.explode(F.sequence(F.lit(0), runs - 1)).alias("salt")).join(sets.withColumnRenamed("node", "pivot"), "pivot").select("pivot", "salt", F.lit(0).alias("role"), F.lit(None).cast("long").alias("other"), "members")
    dealt = heads.unionAll(partners).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    return dealt.mapInArrow(lambda b: _verify(b, num, den), "a long, b long")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after new links: only the components that the links touch are contracted again."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("component").alias(f"r{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = stored(components(ends), "merged")
    up = merged.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = roots.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return old.unionAll(merged.join(roots.select("node"), "node", "left_anti"))


def _shingle_rows(batches):
    """(node, comp, shingle) of sets of hashes."""
    for batch in batches:
        for part in chunks(batch, "members", 1 << 20):
            sets = [np.frombuffer(m, np.int64) for m in part.column("members").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            ids = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("node", "comp")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(np.concatenate(sets))], names=["node", "comp", "shingle"])


def _open(members: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component, with the bucket's number of live rows and its largest component."""
    parts = members.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    full = parts.groupBy("bucket").agg(F.sum("k").alias("size"), F.max(F.struct("k", (-F.col("comp")).alias("c"))).alias("m"), F.count("*").alias("parts")).where("parts > 1")
    full = stored(full.select("bucket", "size", (-F.col("m.c")).alias("main"), (F.col("size") - F.col("m.k")).alias("others")), "open")
    return members.drop("size", "main", "others").join(full, "bucket")


def _salted(left: DataFrame, right: DataFrame, per: str, rows: int) -> DataFrame:
    """left joined to right on bucket. Both carry `per`, a count of the bucket's rows: left's rows are dealt over one salt for each `rows` of
    them and right's repeated for each salt, so that no bucket is one task's work."""
    runs = F.ceil(F.col(per) / rows).cast("int")
    dealt = left.withColumn("salt", F.pmod(F.xxhash64("node"), runs).cast("int"))
    return dealt.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), runs - 1))).drop(per), ["bucket", "salt"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100, t: int = T, salt_rows: int = 256, few: int = 32) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if den * intersection >= num * union of their shingle sets. Equal sets are
    one node from the start, whatever the number of copies. Nodes that share a band are candidates:
    two sets at the bound miss each other in all 40 bands with probability 3e-7. Before two sets are compared they must agree
    in enough of all coordinates, and before that in enough of their lowest bits: by the sketch's concentration a pair at
    the bound falls short of either with probability 1e-6 at most, a pair above it with less.

    No bucket is expanded into its pairs, and every candidate pair is verified or known to be connected:

    1. In a bucket of at most `few` rows each member is verified against the most central one. In a larger bucket sixteen
       members are pivots, and a node is verified against one of all its buckets' pivots only, that with the nearest sketch.
       Links contract to components. This repeats with fresh pivots in large buckets that hold several components,
       as long as it links a twentieth of their nodes outside the largest component.
    2. From what is left of the large buckets nodes go that can't have a link outside their component: those with
       too few shingles that another component's node holds at all. Documents that share a passage, or that lie
       outside a group of near copies, go here, by counts of shingles and exactly. The others that lie outside their bucket's largest
       component are compared with the bucket in blocks, on full sets and by an index of a block's shingles; a pair that fails is never written.
    3. In small buckets that still hold several components, rows outside the largest one meet the others in a join whose condition holds the size
       and bit tests, so that only likely pairs leave it.

    A pivot's partners are dealt out in salted runs; the reader holds one pivot at a time.

    Null or empty texts, or texts of white space, have n_shingles 0 and link with nothing. A null id keeps its row
    with component_id null and kept true. Rows that repeat an id count as one document: links of either bind
    the id. Ties need no rule (components have none). Empty input gives no rows. Other
    columns are ignored, whatever their names.
    """
    docs = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    digests = stored(docs.mapInArrow(lambda b: _digests(b, t, width), "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>"), "digests")
    nodes = digests.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    nodes = stored(nodes, "nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("nth", "band")).select("node", F.xxhash64("nth", "band").alias("bucket"))
    shared = stored(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    held = stored(keyed.join(shared, "bucket"), "members")
    central = stored(held.groupBy("node").agg(F.sum("size").alias("central"), F.max("size").alias("widest")), "central")
    words = [f"w{i}" for i in range((t + 63) // 64)]
    facts = nodes.select("node", "n", *[F.col("bits")[i].alias(w) for i, w in enumerate(words)])
    members = stored(held.join(central.drop("widest"), "node").join(facts, "node").withColumn("comp", F.col("node")), "members")

    def apart(a, b) -> Column:
        return sum((F.bit_count(a(w).bitwiseXOR(b(w))) for w in words), F.lit(0))

    def likely(a, b) -> Column:
        return (den * F.least(a("n"), b("n")) >= num * F.greatest(a("n"), b("n"))) & (apart(a, b) <= t - _least_agreements(t, (1 + num / den) / 2))

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs (pivot, other) whose whole sketches agree in enough coordinates."""
        of = lambda end, c: nodes.select(F.col("node").alias(end), F.col("bands").alias(c))
        met = pairs.join(of("other", "a"), "other").join(of("pivot", "b"), "pivot")
        return stored(met.where(_agreements("a", "b") >= _least_agreements(t, num / den)).select("pivot", "other"), "pairs")

    here, there = (lambda c: F.col(c)), (lambda c: F.col(f"p{c}"))
    fields = ["n", *words]

    def nearest_pivots(live: DataFrame, turn: int, slots: int = 16) -> DataFrame:
        """(pivot, other): each node of large buckets with the pivot whose sketch is nearest, of another component."""
        rank = F.struct(*([(-F.col("central")).alias("c")] if turn == 0 else [F.xxhash64("node", "bucket", F.lit(turn)).alias("c")]), F.col("node").alias("pivot"), F.col("comp").alias("pcomp"), *[F.col(c).alias(f"p{c}") for c in fields])
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(slots))
        best = live.groupBy("bucket", "size", slot.alias("slot")).agg(F.min(rank).alias("p"))
        pivots = stored(best.groupBy("bucket", "size").agg(F.collect_list("p").alias("ps")), "pivots")  # at most `slots` each
        met = _salted(live, pivots, "size", 4096)
        fit = F.filter("ps", lambda p: (p["pcomp"] != F.col("comp")) & likely(here, lambda c: p[f"p{c}"]))
        near = F.array_min(F.transform(fit, lambda p: F.struct(apart(here, lambda c: p[f"p{c}"]).alias("d"), p["pivot"].alias("pivot"))))
        return met.select(F.col("node").alias("other"), near.alias("near")).where("near is not null").groupBy("other").agg(F.min("near").alias("m")).select("m.pivot", "other")

    # the first round: the pivot of each small bucket, the nearest pivot of all large ones
    small = members.where(F.col("size") <= few)
    rank = F.struct((-F.col("central")).alias("c"), F.col("node").alias("pivot"), *[F.col(c).alias(f"p{c}") for c in fields])
    first = small.groupBy("bucket").agg(F.min(rank).alias("p")).select("bucket", "p.pivot", *[f"p.p{c}" for c in fields])
    met = small.join(first, "bucket").where(F.col("node") != F.col("pivot")).where(likely(here, there)).select("pivot", F.col("node").alias("other"))
    large = members.where(F.col("size") > few)
    pairs = close(met.unionByName(nearest_pivots(large, 0)).distinct())
    wanted = central.where("widest > 2").select("node").unionAll(pairs.select(F.col("pivot").alias("node"))).unionAll(pairs.select("other")).distinct()
    wanted = stored(wanted.join(nodes.select("node", "set_key"), "node"), "wanted")
    sets = stored(docs.hint("merge").join(wanted.withColumn("doc_id", F.col("node")), "doc_id").select("node", "set_key", "text").mapInArrow(lambda b: _sets(b, width), "node long, members binary"), "sets")
    linked = lambda pairs: stored(_linked(pairs, sets, num, den, salt_rows), "links")
    roots = stored(components(linked(pairs)), "components")
    of_now = lambda rows: rows.drop("comp").join(roots, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")

    # fresh pivots in large buckets that hold several components
    turn = 0
    while True:
        live = stored(_open(of_now(large)), "live")
        rest = live.where("comp <> main").select("node").distinct().count()
        if not rest:
            break
        turn += 1
        new = linked(close(nearest_pivots(live, turn)))
        bound = new.count()
        if bound:
            roots = stored(_joined(roots, new), "components")
        if 20 * bound < rest:
            break

    # large buckets: nodes that share too few shingles with other components to have a link go; the rest is compared in blocks
    if rest:
        live = stored(_open(of_now(live)), "live")
        least = live.groupBy("bucket").agg(F.min("n").alias("low"))
        ends = stored(live.join(least, "bucket").groupBy("node", "comp", "n").agg(F.min("low").alias("low")), "ends")
        held = stored(sets.join(ends.select("node", "comp"), "node").select("node", "comp", "members").mapInArrow(_shingle_rows, "node long, comp long, shingle long"), "shingles")
        several = held.groupBy("shingle").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("shingle")
        common = held.join(several, "shingle").groupBy("node").agg(F.count("*").alias("k"))
        partner = F.greatest(F.col("low"), F.ceil(F.col("n") * num / den))  # the size that a partner has at least
        able = stored(ends.join(common, "node").where((num + den) * F.col("k") >= num * (F.col("n") + partner)).select("node"), "able")
        new = stored(_linked_blocks(stored(_open(live.join(able, "node")), "live"), sets, num, den), "links")
        if not new.isEmpty():
            roots = stored(_joined(roots, new), "components")

    # small buckets: rows outside the largest component against those of others, pairs that pass the sketches' tests
    live = stored(_open(of_now(small.where("size > 2"))), "live")
    if not live.isEmpty():
        mates = live.select("bucket", F.col("node").alias("pivot"), F.col("comp").alias("pcomp"), *[F.col(c).alias(f"p{c}") for c in fields])
        once = (F.col("pcomp") == F.col("main")) | (F.col("node") < F.col("pivot"))
        met = live.where("comp <> main").join(mates, "bucket").where((F.col("comp") != F.col("pcomp")) & once & likely(here, there))
        new = linked(close(met.select("pivot", F.col("node").alias("other")).distinct()))
        if not new.isEmpty():
            roots = stored(_joined(roots, new), "components")

    label = stored(nodes.join(roots, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id")), "labels")
    out = digests.drop("bands", "bits").hint("merge").join(label, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs of which near_duplicates keeps the document, with all their columns; of
    rows that repeat an id one stays, rows with a null id all stay."""
    from pyspark.sql import Window

    kept = stored(near_duplicates(docs, id_col, text_col, **how).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct(), "kept")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    joined = plain.where(own.isNotNull()).hint("merge").join(kept, own == F.col("_kept"))
    one = joined.withColumn("_nth", F.row_number().over(Window.partitionBy("_kept").orderBy(F.xxhash64(text)))).where("_nth = 1").select(*plain.columns)
    return one.unionAll(plain.where(own.isNull())).toDF(*names)
