"""Peptide and fragment expressions; native columns unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import LOSS_MASS, MASS_TAGS, MODIFICATION_MASS, PROTON, RESIDUE_ATOMS, RESIDUE_MASS, SUBSTITUTE, WATER

RESIDUE = r"[A-Z](?:\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\])*"
MOD = r"\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]"


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def residues(seq: Column) -> Column:
    """A peptide's residues with their modifications, which may hold one level of brackets. A leading
    modification stays with the first residue's position: it is its own first token."""
    lead = F.regexp_extract(seq, rf"^((?:{MOD})+)", 1)
    rest = F.regexp_extract_all(F.regexp_replace(seq, rf"^(?:{MOD})+", ""), F.lit(RESIDUE), F.lit(0))
    return F.when(lead != "", F.concat(F.array(lead), rest)).otherwise(rest)


def modifications(residue: Column) -> Column:
    """Names of the modifications of one residue token."""
    return F.transform(F.regexp_extract_all(residue, F.lit(MOD), F.lit(0)), lambda m: F.substring(m, F.lit(2), F.char_length(m) - 2))


def stripped(seq: Column) -> Column:
    """The bare residue letters."""
    return F.regexp_replace(seq, MOD, "")


def untagged(seq: Column, tag: str) -> Column:
    """A sequence without one tag's channel marks."""
    return F.regexp_replace(seq, rf"\({tag}-[^)]*\)", "")


def precursor_key(seq: Column, charge: Column) -> Column:
    return F.concat_ws("_", seq, charge.cast("int").cast("string"))


def split_fragment(name: Column) -> Column:
    """(ion, idx, loss, charge, iso) of `<ion><idx>[-<loss>]_<charge>[_iso<k>]`; null parts where absent."""
    part = lambda i: F.regexp_extract(name, r"^([a-z])(\d+)(?:-([A-Za-z0-9]+))?_(\d+)(?:_iso(\d+))?$", i)
    number = lambda i: F.nullif(part(i), F.lit("")).cast("int")
    return F.struct(F.nullif(part(1), F.lit("")).alias("ion"), number(2).alias("idx"), F.nullif(part(3), F.lit("")).alias("loss"), number(4).alias("charge"), F.coalesce(number(5), F.lit(0)).alias("iso"))


def fragment_name(ion: Column, idx: Column, loss: Column, charge: Column) -> Column:
    """The inverse of split_fragment; unknown, noloss and empty losses are none."""
    lost = F.when(loss.isNull() | F.lower(loss).isin("", "unknown", "noloss"), F.lit("")).otherwise(F.concat(F.lit("-"), loss))
    return F.concat(ion, idx.cast("int").cast("string"), lost, F.lit("_"), charge.cast("int").cast("string"))


def from_bracket_charge(name: Column) -> Column:
    """y7(2+) -> y7_2; without a charge 1."""
    return F.when(name.rlike(r"\(\d+\+\)$"), F.regexp_replace(name, r"\((\d+)\+\)$", "_$1")).otherwise(F.concat(name, F.lit("_1")))


def reverse_decoy(tokens: Column) -> Column:
    """All tokens but the last in reverse."""
    n = F.size(tokens)
    return F.when(n > 1, F.concat(F.reverse(F.slice(tokens, 1, n - 1)), F.slice(tokens, n, 1))).otherwise(tokens)


def reverse_decoy_tagged(tokens: Column, tag: str) -> Column:
    """reverse_decoy where the tag's marks stay at their positions while other modifications move."""
    mark = rf"\({tag}-[^)]*\)"
    marks = F.transform(tokens, lambda t: F.array_join(F.regexp_extract_all(t, F.lit(mark), F.lit(0)), ""))
    bare = reverse_decoy(F.transform(tokens, lambda t: F.regexp_replace(t, mark, "")))
    return F.zip_with(bare, marks, lambda b, m: F.concat(b, m))


def substitute_decoy(tokens: Column) -> Column:
    """Every residue exchanged for its look-alike; modifications and tags stay where they are."""
    swap = lambda t: F.concat(F.translate(F.substring(t, 1, 1), "".join(SUBSTITUTE), "".join(SUBSTITUTE.values())), F.substring(t, F.lit(2), F.char_length(t)))
    return F.transform(tokens, lambda t: F.when(t.rlike("^[A-Z]"), swap(t)).otherwise(t))


def token_mass(token: Column) -> Column:
    """A residue token's mass; null where a residue or one of its modifications is unknown. A modification may be its mass, as in C[+57.02]."""
    known = F.map_concat(_map(MODIFICATION_MASS), _map({f"{t}-{c}": base + d for t, (_, base, chans) in MASS_TAGS.items() for c, d in chans.items()}))
    mods = F.aggregate(modifications(token), F.lit(0.0), lambda a, m: a + F.coalesce(F.try_element_at(known, m), m.try_cast("double")))
    letter = F.regexp_extract(token, r"^([A-Z])", 1)
    return F.when(letter == "", mods).otherwise(F.try_element_at(_map(RESIDUE_MASS), letter) + mods)


def peptide_mz(seq: Column, charge: Column) -> Column:
    total = F.aggregate(residues(seq), F.lit(WATER), lambda a, t: a + token_mass(t))
    return total / charge + F.lit(PROTON)


def fragment_mz(tokens: Column, ion: Column, idx: Column, charge: Column, loss: Column) -> Column:
    """m/z of a b or y ion; null for other ions, for an index that the peptide hasn't, and for unknown losses."""
    n = F.size(tokens)
    part = F.when(ion == "b", F.slice(tokens, F.lit(1), idx)).when(ion == "y", F.slice(tokens, F.greatest(F.lit(1), n - idx + 1), idx))
    lost = F.when(loss.isNull(), F.lit(0.0)).otherwise(F.try_element_at(_map(LOSS_MASS), loss))
    neutral = F.aggregate(part, F.lit(0.0), lambda a, t: a + token_mass(t)) + F.when(ion == "y", F.lit(WATER)).otherwise(F.lit(0.0)) - lost
    return F.when((idx >= 1) & (idx <= n), neutral / charge + F.lit(PROTON))


def named_peaks(seq: Column, mz: Column, intensity: Column, rel: float = 20e-6, charges: tuple[int, ...] = (1, 2)) -> Column:
    """Fragments (mz, intensity, name) for the b and y ions of a peptide that have a peak within the tolerance, each with its nearest one; the order is by m/z."""
    tokens, peaks = residues(seq), F.arrays_zip(mz.alias("mz"), intensity.alias("intensity"))
    none = F.lit(None).cast("string")

    def ion(kind: str, i: Column, z: int) -> Column:
        return F.struct(fragment_mz(tokens, F.lit(kind), i, F.lit(z), none).alias("at"), F.concat(F.lit(kind), i.cast("string"), F.lit(f"_{z}")).alias("name"))

    places = F.when(F.size(tokens) > 1, F.sequence(F.lit(1), F.size(tokens) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    ions = F.filter(F.flatten(F.transform(places, lambda i: F.array(*[ion(k, i, z) for k in "by" for z in charges]))), lambda x: x["at"].isNotNull())

    def nearest(x: Column) -> Column:
        near = F.filter(peaks, lambda p: F.abs(p["mz"] - x["at"]) <= rel * x["at"])
        return F.array_min(F.transform(near, lambda p: F.struct(F.abs(p["mz"] - x["at"]).alias("d"), p["mz"].alias("mz"), p["intensity"].alias("intensity"), x["name"].alias("name"))))

    hits = F.filter(F.transform(ions, nearest), lambda h: h.isNotNull())
    return F.array_sort(F.transform(hits, lambda h: F.struct(h["mz"].alias("mz"), h["intensity"].alias("intensity"), h["name"].alias("name"))))


def tag_positions(tokens: Column, rules: str) -> Column:
    """How many tags each token takes: rule n is the first token, a letter its residues."""
    letters = rules.replace("n", "")
    first = lambda i: F.when(F.lit("n" in rules) & (i == 0), F.lit(1)).otherwise(F.lit(0))
    return F.transform(tokens, lambda t, i: first(i) + (F.when(F.regexp_extract(t, r"^([A-Z])", 1).isin(*letters), F.lit(1)).otherwise(F.lit(0)) if letters else F.lit(0)))


def channels(spark: SparkSession, tag: str) -> DataFrame:
    """(tag, channel, mass) rows of a tag: a handful, so safe to broadcast."""
    _, base, shifts = MASS_TAGS[tag]
    return spark.createDataFrame([(tag, c, base + d) for c, d in shifts.items()], "tag string, channel string, mass double")


def tag_library(fragments: DataFrame, tag: str) -> DataFrame:
    """One row per fragment and channel: m/z of the precursor and of b and y ions move by the tags that
    they hold. Columns used: mod_seq, charge, prec_mz, name, mz."""
    rules = MASS_TAGS[tag][0]
    df = fragments.withColumn("_t", residues(F.col("mod_seq"))).withColumn("_n", tag_positions(F.col("_t"), rules)).withColumn("_f", split_fragment(F.col("name")))
    df = df.join(F.broadcast(channels(fragments.sparkSession, tag)), how="cross")  # at most nine channels
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    size = F.size("_n")
    held = F.when(F.col("_f.ion") == "b", total(F.slice("_n", F.lit(1), F.col("_f.idx")))).otherwise(total(F.slice("_n", F.greatest(F.lit(1), size - F.col("_f.idx") + 1), F.col("_f.idx"))))
    mark = F.concat(F.lit(f"({tag}-"), F.col("channel"), F.lit(")"))
    seq = F.array_join(F.zip_with("_t", "_n", lambda t, k: F.concat(t, F.repeat(mark, k))), "")
    return df.withColumns({"untag_seq": F.col("mod_seq"), "prec_mz": F.col("prec_mz") + F.col("mass") * total(F.col("_n")) / F.col("charge"), "mz": F.col("mz") + F.col("mass") * held / F.col("_f.charge"), "mod_seq": seq}).drop("_t", "_n", "_f", "mass", "tag")


def sibling_channels(precursors: DataFrame, tag: str) -> DataFrame:
    """Each tagged precursor (mod_seq, charge, prec_mz, others kept) once for every channel of its tag: `channel` is its own, `sibling`
    the other (or the same), and mod_seq and prec_mz are the sibling's. Sequences without the tag have no rows."""
    mark = rf"\({tag}-([^)]*)\)"
    own = channels(precursors.sparkSession, tag).select(F.col("channel"), F.col("mass").alias("_own"))
    other = channels(precursors.sparkSession, tag).select(F.col("channel").alias("sibling"), F.col("mass").alias("_other"))
    df = precursors.withColumn("channel", F.nullif(F.regexp_extract("mod_seq", mark, 1), F.lit(""))).join(F.broadcast(own), "channel")
    df = df.join(F.broadcast(other), how="cross")  # a handful of channels
    held = F.size(F.regexp_extract_all("mod_seq", F.lit(mark), F.lit(0)))
    moved = F.regexp_replace("mod_seq", F.lit(mark), F.concat(F.lit(f"({tag}-"), F.col("sibling"), F.lit(")")))
    return df.withColumns({"prec_mz": F.col("prec_mz") + (F.col("_other") - F.col("_own")) * held / F.col("charge"), "mod_seq": moved}).drop("_own", "_other")


def without_low_ions(frags: Column, b: int = 2, y: int = 3) -> Column:
    """Fragments (structs with a name) without b1..b<b> and y1..y<y>, which most peptides share."""

    def high(f: Column) -> Column:
        part = split_fragment(f["name"])
        return ~(((part["ion"] == "b") & (part["idx"] <= b)) | ((part["ion"] == "y") & (part["idx"] <= y)))

    return F.filter(frags, high)


def digest(protein: Column, missed: int = 2, shortest: int = 5, longest: int = 50) -> Column:
    """Tryptic peptides: cuts after K or R but not before P, up to `missed` cuts left out."""
    parts = F.filter(F.split(protein, r"(?<=[KR])(?!P)"), lambda p: p != "")
    n = F.size(parts)
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(missed)), lambda k: F.when(n > k, F.transform(F.sequence(F.lit(1), n - k), lambda i: F.array_join(F.slice(parts, i, k + 1), ""))).otherwise(F.expr("cast(array() as array<string>)"))))
    return F.when(n > 0, F.array_distinct(F.filter(runs, lambda p: F.char_length(p).between(shortest, longest)))).otherwise(F.expr("cast(array() as array<string>)"))


def composition(seq: Column) -> Column:
    """(C, H, N, O, S) of a peptide with its water, modifications of the fixed table included; null where a residue or
    modification has no known composition. Mass tags are left out: see untagged."""
    from .constants import MOD_ATOMS

    atoms = {k: F.create_map(*[F.lit(x) for r, v in (RESIDUE_ATOMS | MOD_ATOMS).items() for x in (r, v[i])]) for i, k in enumerate("CHNOS")}
    letters = F.regexp_extract_all(stripped(seq), F.lit("[A-Z]"), F.lit(0))
    parts = F.concat(letters, F.flatten(F.transform(residues(seq), modifications)))
    water = {"H": 2, "O": 1}

    def total(k: str) -> Column:
        return F.aggregate(parts, F.lit(water.get(k, 0)), lambda a, p: a + F.try_element_at(atoms[k], p))

    return F.when(total("C").isNotNull(), F.struct(*[total(k).alias(k) for k in atoms]))


def join_numbers(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ";")


def split_numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ";"), lambda p: p != ""), lambda p: p.try_cast("double"))


def one_hot(seq: Column, length: int = 30, alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> Column:
    """length rows of len(alphabet) zeros and ones; longer sequences are cut, others padded with zeros."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.transform(F.array(*map(F.lit, alphabet)), lambda a: (F.substring(seq, i, F.lit(1)) == a).cast("int")))
