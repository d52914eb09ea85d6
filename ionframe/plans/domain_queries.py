"""Queries that call peptide, quantity, feature and file operators on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import peptide
from ..functions.constants import ISOTOPES, PROTON, RESIDUE_ATOMS, RESIDUE_MASS, SUBSTITUTE, WATER
from ..operators import features, joins, probes, quant, scoring, spectra, traces
from ..shared import shared_dir
from ..sources import readers, writers
from .queries import micros, query, t

# A peptide from a part's key: its digits as residues, between M and K.
LETTERS = "ACDEFGHKRP"
SEQ = f"'M' || translate(CAST(p_partkey*7919 AS VARCHAR), '0123456789', '{LETTERS}') || 'K'"
_MASSES = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in RESIDUE_MASS.items()) + "}"
_MASS = f"list_transform(string_split(seq, ''), lambda c: map_extract({_MASSES}, c)[1])"  # of a sequence's letters


def parts(spark, sf_dir):
    seq = F.concat(F.lit("M"), F.translate((F.col("p_partkey") * 7919).cast("string"), "0123456789", LETTERS), F.lit("K"))
    return t(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size", seq.alias("seq"))


def spread(df):
    """df over all cores: a table of few bytes is read by one task, whatever its rows cost later."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT p_partkey, round((list_sum({_MASS}) + {WATER})/2 + {PROTON}, 6) AS mz FROM (SELECT p_partkey, {SEQ} AS seq FROM part) x")
def peptide_masses(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", F.round(peptide.peptide_mz(F.col("seq"), F.lit(2)), 6).alias("mz"))


@query(f"""SELECT p_partkey, round(list_sum(({_MASS})[1:3]) + {PROTON}, 6) AS b3, round((list_sum(({_MASS})[len(seq)-1:len(seq)]) + {WATER} - 17.0265491015)/2 + {PROTON}, 6) AS y2
  FROM (SELECT p_partkey, {SEQ} AS seq FROM part) x""")
def fragment_masses(spark, sf_dir):
    tokens, none = peptide.residues(F.col("seq")), F.lit(None).cast("string")
    b = peptide.fragment_mz(tokens, F.lit("b"), F.lit(3), F.lit(1), none)
    y = peptide.fragment_mz(tokens, F.lit("y"), F.lit(2), F.lit(2), F.lit("NH3"))
    return parts(spark, sf_dir).select("p_partkey", F.round(b, 6).alias("b3"), F.round(y, 6).alias("y2"))


@query(f"""SELECT p_partkey, translate(seq, '{"".join(SUBSTITUTE)}', '{"".join(SUBSTITUTE.values())}') AS decoy FROM (SELECT p_partkey, {SEQ} AS seq FROM part) x""")
def decoy_substitute(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", F.array_join(peptide.substitute_decoy(peptide.residues(F.col("seq"))), "").alias("decoy"))


@query(f"""SELECT p_partkey, {", ".join(f"list_sum(list_transform(string_split(seq, ''), lambda c: map_extract(MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {v[i]}' for k, v in RESIDUE_ATOMS.items())}}}, c)[1]))::INT + {w} AS {a.lower()}" for i, (a, w) in enumerate(zip("CHNOS", (0, 2, 0, 1, 0), strict=True)))}
  FROM (SELECT p_partkey, {SEQ} AS seq FROM part) x""")
def compositions(spark, sf_dir):
    return parts(spark, sf_dir).withColumn("k", peptide.composition(F.col("seq"))).select("p_partkey", *[F.col(f"k.{a}").alias(a.lower()) for a in "CHNOS"])


@query(f"""SELECT p_partkey, unnest(list_distinct(list_filter(string_split(replace(regexp_replace(seq, '([KR])', '\\1|', 'g'), '|P', 'P'), '|'), lambda x: len(x) BETWEEN 2 AND 50))) AS peptide FROM (SELECT p_partkey, {SEQ} AS seq FROM part) x""")
def digest_parts(spark, sf_dir):
    """By expressions; sql_digest is the table function."""
    return parts(spark, sf_dir).select("p_partkey", F.explode(peptide.digest(F.col("seq"), 0, 2, 50)).alias("peptide"))


_SHARES = {a: v for a, v in ISOTOPES.items()}
_COUNT = {a: f"list_sum(list_transform(string_split(seq, ''), lambda c: map_extract(MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {v[i]}' for k, v in RESIDUE_ATOMS.items())}}}, c)[1])) + {w}" for i, (a, w) in enumerate(zip("CHNOS", (0, 2, 0, 1, 0), strict=True))}
_MONO = " * ".join(f"pow({_SHARES[a][0]!r}::DOUBLE, {c})" for a, c in _COUNT.items())
_FIRST = " + ".join(f"({c}) * {_SHARES[a][1]!r}::DOUBLE / {_SHARES[a][0]!r}::DOUBLE" for a, c in _COUNT.items())
_TWO = f"""WITH x AS (SELECT p_partkey, {SEQ} AS seq FROM part), y AS (SELECT p_partkey, {_MONO} AS m, {_FIRST} AS f FROM x)
  SELECT p_partkey, 0 AS iso, round(m, 6) AS share FROM y UNION ALL SELECT p_partkey, 1, round(m*f, 6) FROM y"""


@query(_TWO)
def isotope_patterns(spark, sf_dir):
    """The first two isotopes of parts' peptides, which have a closed form."""
    from ..functions.isotopes import patterns

    got = patterns(parts(spark, sf_dir).select("p_partkey", peptide.composition(F.col("seq")).alias("c")), "c")
    return got.select("p_partkey", F.posexplode(F.slice("isotopes", 1, 2)).alias("iso", "share")).select("p_partkey", "iso", F.round("share", 6).alias("share"))


@query(_TWO)
def sql_isotopes(spark, sf_dir):
    """The same by the registered table function."""
    from ..functions.registered import register

    register(spark)
    return spark.sql("SELECT p_partkey, i.iso, round(i.share, 6) AS share FROM {parts} p, LATERAL isotope_pattern(p.seq, 2) i", parts=spread(parts(spark, sf_dir).select("p_partkey", "seq")))


@query(f"""WITH x AS (SELECT p_partkey, list_filter(string_split(replace(regexp_replace({SEQ}, '([KR])', '\\1|', 'g'), '|P', 'P'), '|'), lambda x: x <> '') AS w FROM part),
  y AS (SELECT p_partkey, i, k, array_to_string(w[i:i+k], '') AS peptide, array_to_string(w[:i-1], '') AS before FROM x, range(0, 3) s(k), unnest(range(1, len(w)-k+1)) r(i))
  SELECT p_partkey, len(before)::INT + 1 AS start, k::INT AS missed, peptide FROM y WHERE len(peptide) BETWEEN 2 AND 50""")
def sql_digest(spark, sf_dir):
    """The registered table function, with missed cuts and places."""
    from ..functions.registered import register

    register(spark)
    return spark.sql("SELECT p_partkey, d.start, d.missed, d.peptide FROM {parts} p, LATERAL digest(p.seq, 2, 2, 50) d", parts=spread(parts(spark, sf_dir).select("p_partkey", "seq")))


@query(f"""WITH x AS (SELECT p_partkey, p_retailprice, p_size, {SEQ} AS seq FROM part), c(channel, mass) AS (VALUES ('0', 140.0949630177::DOUBLE), ('4', 144.1020624177::DOUBLE), ('8', 148.1091618309::DOUBLE)),
  n AS (SELECT *, 1 + len(seq) - len(replace(seq, 'K', '')) AS k, 1 + len(seq[1:2]) - len(replace(seq[1:2], 'K', '')) AS b FROM x)
  SELECT p_partkey, channel, replace('M(mTRAQ-' || channel || ')' || seq[2:], 'K', 'K(mTRAQ-' || channel || ')') AS mod_seq, round(p_retailprice + mass*k/2, 4) AS prec_mz, round(p_size + mass*b, 4) AS mz FROM n, c""")
def tag_library(spark, sf_dir):
    rows = parts(spark, sf_dir).select("p_partkey", F.col("seq").alias("mod_seq"), F.lit(2).alias("charge"), F.col("p_retailprice").alias("prec_mz"), F.lit("b2_1").alias("name"), F.col("p_size").cast("double").alias("mz"))
    return peptide.tag_library(rows, "mTRAQ").select("p_partkey", "channel", "mod_seq", F.round("prec_mz", 4).alias("prec_mz"), F.round("mz", 4).alias("mz"))


@query(f"""WITH x AS (SELECT p_partkey, p_retailprice, {SEQ} AS seq FROM part), c(channel, mass) AS (VALUES ('0', 140.0949630177::DOUBLE), ('4', 144.1020624177::DOUBLE), ('8', 148.1091618309::DOUBLE))
  SELECT p_partkey, '4' AS channel, c.channel AS sibling, replace(seq, 'K', 'K(mTRAQ-' || c.channel || ')') AS mod_seq, round(p_retailprice + (mass - 144.1020624177)*(len(seq) - len(replace(seq, 'K', '')))/2, 4) AS prec_mz FROM x, c""")
def sibling_channels(spark, sf_dir):
    rows = parts(spark, sf_dir).select("p_partkey", F.replace("seq", F.lit("K"), F.lit("K(mTRAQ-4)")).alias("mod_seq"), F.lit(2).alias("charge"), F.col("p_retailprice").alias("prec_mz"))
    return peptide.sibling_channels(rows, "mTRAQ").select("p_partkey", "channel", "sibling", "mod_seq", F.round("prec_mz", 4).alias("prec_mz"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag='N' THEN 'y' ELSE 'b' END AS ion, l_linenumber AS idx, CASE WHEN l_linestatus='O' THEN 'H2O' END AS loss, 1 + l_linenumber % 2 AS charge
  FROM lineitem WHERE NOT (l_returnflag='N' AND l_linenumber <= 3) AND NOT (l_returnflag<>'N' AND l_linenumber <= 2)""")
def fragment_names(spark, sf_dir):
    ion = F.when(F.col("l_returnflag") == "N", "y").otherwise("b")
    name = peptide.fragment_name(ion, F.col("l_linenumber"), F.when(F.col("l_linestatus") == "O", "H2O").otherwise("noloss"), 1 + F.col("l_linenumber") % 2)
    one = F.array(F.struct(name.alias("name")))
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(peptide.without_low_ions(one)).alias("f")).withColumn("s", peptide.split_fragment(F.col("f.name")))
    return rows.select("l_orderkey", "l_linenumber", "s.ion", "s.idx", "s.loss", "s.charge")


@query("""WITH r AS (SELECT l_orderkey, l_returnflag, l_extendedprice/sum(l_extendedprice) OVER (PARTITION BY l_orderkey) v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) k FROM lineitem)
  SELECT l_orderkey, round(sum(v),6) AS matched, count(*) FILTER (k<=10) AS n_top FROM r WHERE l_returnflag<>'N' GROUP BY l_orderkey
  HAVING sum(v)>0.5 AND count(*) FILTER (k<=10)>2 AND count(*) FILTER (k=1)>=1 AND count(*) FILTER (k<=3)>=2""")
def first_search_acceptance(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_num"), F.lit(0).alias("prec_id"), "l_linenumber", "l_returnflag", "l_extendedprice")
    rows = spectra.normalised(spectra.top_ranks(rows, [F.desc("l_extendedprice"), "l_linenumber"], ["scan_num"]), "l_extendedprice", ["scan_num"]).where("l_returnflag <> 'N'")  # ranks first: their sort serves the sums too
    return spectra.first_search_accepted(rows, 0.5, 2).select(F.col("scan_num").alias("l_orderkey"), F.round("matched", 6).alias("matched"), "n_top")


@query("""SELECT s_suppkey AS feature_id, p_partkey AS prec_id FROM supplier JOIN part ON p_size % 3 = s_nationkey % 3 AND abs(p_retailprice - s_acctbal)/s_acctbal < 0.002::DOUBLE WHERE s_acctbal > 0""")
def feature_candidates(spark, sf_dir):
    f = t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("feature_id"), F.col("s_acctbal").alias("mz"), (F.col("s_nationkey") % 3).alias("charge"))
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("prec_id"), F.col("p_retailprice").alias("prec_mz"), (F.col("p_size") % 3).alias("charge"))
    return spectra.feature_candidates(f, p, 0.002).select("feature_id", "prec_id")


@query("""WITH h AS (SELECT s_suppkey, p_retailprice p, s_acctbal c FROM supplier JOIN part ON p_size % 3 = s_nationkey % 3 AND abs(p_retailprice - s_acctbal) <= 0.01::DOUBLE*s_acctbal WHERE s_acctbal > 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(p-c), p DESC) k FROM h) SELECT s_suppkey, p AS peak, round((p-c)/c, 9) AS rel_error FROM r WHERE k=1""")
def nearest_match(spark, sf_dir):
    c = t(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") % 3).alias("k"))
    p = t(spark, sf_dir, "part").select(F.col("p_retailprice").alias("peak"), (F.col("p_size") % 3).alias("k"))
    return joins.nearest_match(c, ["s_suppkey"], "s_acctbal", p, "peak", 0.01, ["k"], []).select("s_suppkey", "peak", F.round("rel_error", 9).alias("rel_error"))


@query("""WITH q AS (SELECT event_id, user_id, value FROM events WHERE event_type<>'error'), e AS (SELECT DISTINCT user_id, value v FROM events WHERE event_type='error'),
  r AS (SELECT q.event_id, q.value, e.v, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(e.v-q.value), e.v DESC) k FROM q LEFT JOIN e USING (user_id))
  SELECT event_id, CASE WHEN abs(v - value) <= 0.2::DOUBLE*value THEN round(v - value, 6) END AS diff FROM r WHERE k=1""")
def signed_nearest(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    got = joins.signed_nearest(e.where("event_type <> 'error'").select("event_id", "user_id", "value"), e.where("event_type = 'error'").select("user_id", "value"), "value", ["user_id"], 0.2)
    return got.select("event_id", F.round("diff", 6).alias("diff"))


@query("""WITH h AS (SELECT p_partkey, s_suppkey, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(s_nationkey - p_size), s_suppkey) k FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 250 AND s_acctbal + 250)
  SELECT p_partkey, s_suppkey FROM h WHERE k=1""")
def feature_spectrum(spark, sf_dir):
    f = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("mz"), F.col("p_size").alias("rt_apex"))
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scan_num"), F.col("s_nationkey").alias("rt"), (F.col("s_acctbal") - 250).alias("win_lo"), (F.col("s_acctbal") + 250).alias("win_hi"))
    return joins.feature_spectrum(f, s).select(F.col("feature_id").alias("p_partkey"), F.col("scan_num").alias("s_suppkey"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)*0.5,6) AS area FROM events")
def moving_area(spark, sf_dir):
    return traces.moving_area(t(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 0.5, 5).select("event_id", F.round("area", 6).alias("area"))


@query("SELECT l_suppkey, 'y' || l_linenumber AS fragment, count(*) AS n, round(sum(l_quantity),4) AS total FROM lineitem GROUP BY 1, 2")
def fragment_traces(spark, sf_dir):
    arr = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount", "l_quantity")))
    psm = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_orderkey").alias("scan_num")).agg(arr.alias("a"))
    psm = psm.select("l_suppkey", "scan_num", F.transform("a", lambda x: F.concat(F.lit("y"), x["l_linenumber"])).alias("frag_names"), F.col("a.l_discount").alias("frag_mz"), F.col("a.l_quantity").alias("obs_int"))
    return traces.fragment_traces(psm, ["l_suppkey"]).select("l_suppkey", "fragment", F.size("trace").cast("long").alias("n"), F.round(F.aggregate("trace", F.lit(0.0), lambda s, x: s + x["obs"]), 4).alias("total"))


@query("""WITH r AS (SELECT l_orderkey, l_extendedprice o, l_quantity*1000 p, l_quantity coeff, count(*) OVER (PARTITION BY l_orderkey, l_linenumber % 3) shared, 1e6::DOUBLE tic FROM lineitem)
  SELECT l_orderkey, round(sum(o/shared)/1e6,12) AS frac_int_matched, round(sum(p)/1e6,12) AS frac_int_pred, round(sum(p)/sum(o/shared),12) AS frac_int_matched_pred, round(coalesce(sum(p) FILTER (coeff>1),0)/sum(o/shared),12) AS frac_int_matched_pred_sigcoeff FROM r GROUP BY 1""")
def scan_shares(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", F.col("l_linenumber") % 3)
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_num"), F.col("l_extendedprice").alias("o"), (F.col("l_quantity") * 1000).alias("p"), F.col("l_quantity").alias("coeff"), F.count("*").over(w).alias("shared"), F.lit(1e6).alias("tic"))
    got = features.scan_shares(rows)
    return got.select(F.col("scan_num").alias("l_orderkey"), *[F.round(c, 12).alias(c) for c in got.columns[1:]])


@query("""SELECT l_orderkey, round(sum(l_extendedprice*l_quantity)/(sqrt(sum(l_extendedprice*l_extendedprice))*sqrt(sum(l_quantity*l_quantity))),8) AS frag_cosine,
  CASE WHEN count(*)>1 AND stddev_pop(l_quantity)>0 THEN round(corr(l_extendedprice, l_quantity),4) END AS frag_pearson FROM lineitem GROUP BY l_orderkey HAVING count(*)>2""")
def fragment_cosines(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_num"), F.lit(0).alias("prec_id"), F.col("l_extendedprice").alias("o"), F.col("l_quantity").alias("v"))
    many = rows.groupBy("scan_num").agg(F.count("*").alias("n")).where("n > 2").select("scan_num")
    return features.fragment_cosines(rows.join(many, "scan_num")).select(F.col("scan_num").alias("l_orderkey"), F.round("frag_cosine", 8).alias("frag_cosine"), F.round("frag_pearson", 4).alias("frag_pearson"))


@query("""WITH q AS (SELECT event_id, user_id, epoch_us(ts) dt FROM events WHERE event_type<>'error'), e AS (SELECT user_id, epoch_us(ts) dt FROM events WHERE event_type='error')
  SELECT q.event_id, arg_min(e.dt, abs(e.dt-q.dt)*2 + CASE WHEN e.dt>q.dt THEN 1 ELSE 0 END) AS ms1_rt FROM q LEFT JOIN e USING(user_id) GROUP BY q.event_id""")
def nearest_survey(spark, sf_dir):
    scans = t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run"), F.when(F.col("event_type") == "error", 1).otherwise(2).alias("ms_level"), micros().alias("rt"))
    return quant.nearest_survey(scans).select("event_id", "ms1_rt")


@query("""WITH h AS (SELECT o_orderkey, l_extendedprice p, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(l_extendedprice - o_totalprice/4), l_extendedprice DESC) k, abs(l_extendedprice - o_totalprice/4) d FROM orders JOIN lineitem ON l_orderkey=o_orderkey)
  SELECT o_orderkey, CASE WHEN d <= 5000 THEN p END AS peak FROM h WHERE k=1""")
def nearest_peak(spark, sf_dir):
    peaks = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity")))).alias("peaks"))
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 4).alias("at")).join(peaks, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", quant.nearest_peak(F.col("at"), F.col("peaks"), F.lit(5000.0))["mz"].alias("peak"))


@query("""WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events WHERE event_type='error'), a AS (SELECT user_id, max(p) ap FROM m GROUP BY user_id)
  SELECT m.user_id, m.event_id FROM m JOIN a ON m.user_id=a.user_id AND m.p BETWEEN a.ap-2 AND a.ap+2""")
def survey_neighbourhood(spark, sf_dir):
    e = t(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("run"), F.lit(1).alias("ms_level"), F.col("ts").alias("rt"), F.col("event_id").alias("scan_num"), F.array(F.lit(0.0)).alias("peaks"))
    apex = e.groupBy("run").agg(F.max_by("scan_num", F.struct("rt", "scan_num")).alias("ms1_scan")).withColumn("prec_id", F.lit(1))
    return quant.survey_neighbourhood(apex, e, 2).select(F.col("run").alias("user_id"), F.col("scan_num").alias("event_id"))


@query("""SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) k FROM lineitem WHERE l_quantity > 1) x WHERE k=1""")
def strong_precursors(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("coeff"), F.struct("l_orderkey", "l_linenumber").alias("scan_num"))
    return scoring.strong_precursors(rows, ["l_suppkey", "l_partkey"]).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey AS scan_num, l_suppkey AS prec_id, -1 AS row, round(sum(l_discount),6) AS v FROM lineitem WHERE l_returnflag='N' GROUP BY 1,2""")
def unmatched_in_one_row(spark, sf_dir):
    f = t(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("scan_num"), F.col("l_suppkey").alias("prec_id"), F.col("l_discount").alias("v"))
    return probes.unmatched_rows(f, "a").select("scan_num", "prec_id", "row", F.round("v", 6).alias("v"))


@query("""SELECT l_orderkey AS scan_num, l_suppkey AS prec_id, -row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber, l_discount) AS row, round(l_discount,6) AS v FROM lineitem WHERE l_returnflag='N' AND l_discount>1e-10""")
def unmatched_by_fragment(spark, sf_dir):
    f = t(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("scan_num"), F.col("l_suppkey").alias("prec_id"), F.col("l_linenumber").alias("name"), F.col("l_discount").alias("v"))
    return probes.unmatched_rows(f, "c").select("scan_num", "prec_id", F.col("row").cast("long").alias("row"), F.round("v", 6).alias("v"))


@query("""WITH h AS (SELECT user_id, event_type, event_id, epoch_us(ts)/6e7 m, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts)) - 1 c, epoch_us(ts)/6e7 - min(epoch_us(ts)/6e7) OVER (PARTITION BY user_id, event_type) o FROM events),
  n AS (SELECT c, round(o) b, count(*) k FROM h GROUP BY 1,2), d AS (SELECT c, b, row_number() OVER (PARTITION BY c ORDER BY k DESC, b) r FROM n)
  SELECT h.event_id, h.c AS channel FROM h JOIN d ON h.c=d.c AND d.r=1 WHERE abs(h.o-d.b) <= 30""")
def consistent_offsets(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (micros() / F.lit(6e7)).alias("m"))
    return probes.consistent_offsets(e, ["user_id", "event_type"], "m", 30.0).select("event_id", F.col("time_channel").cast("long").alias("channel"))


_LIBRARY = """WITH f AS (SELECT translate(CAST(l_orderkey AS VARCHAR), '0123456789', 'ACDEFGHKRP') AS mod_seq, l_linenumber, l_extendedprice mz, l_quantity i FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_quantity DESC) = 1),
  r AS (SELECT *, i/sum(i) OVER (PARTITION BY mod_seq) s, row_number() OVER (PARTITION BY mod_seq ORDER BY i DESC, mz, l_linenumber) k FROM f)"""


@query(_LIBRARY + " SELECT mod_seq, 'y' || l_linenumber || '_1' AS name, mz, round(s, 8) AS norm_int, k AS top_rank FROM r")
def library_table(spark, sf_dir):
    """A library written as a table, read again and laid out by fragment."""
    seq = F.translate(F.col("l_orderkey").cast("string"), "0123456789", "ACDEFGHKRP")
    frag = F.struct(F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"), F.concat(F.lit("y"), "l_linenumber", F.lit("_1")).alias("name"))
    own = t(spark, sf_dir, "lineitem").groupBy(seq.alias("mod_seq")).agg(F.array_sort(F.collect_list(frag)).alias("frags"))
    none = [F.lit(None).cast("string").alias(c) for c in ("im", "protein_group", "protein_name", "genes")]
    at = folder(spark, "library")
    writers.write_library(own.select("mod_seq", F.col("mod_seq").alias("seq"), F.lit(2).alias("charge"), F.lit(500.5).alias("prec_mz"), F.lit(1.5).alias("irt"), *none, "frags"), at)
    got = readers.library_fragments(readers.read_any_library(spark, at).withColumn("prec_id", F.xxhash64("mod_seq")))
    return got.select("mod_seq", "name", "mz", F.round("norm_int", 8).alias("norm_int"), F.col("top_rank").cast("long").alias("top_rank"))


@query("""SELECT l_orderkey AS spec_id, count(*) AS n, round(sum(l_extendedprice),2) AS total, 'AAK' || min(l_suppkey) AS seq, min(l_suppkey) % 2 = 0 AS decoy FROM lineitem GROUP BY 1""")
def result_rows(spark, sf_dir):
    """Result rows written as headerless CSV and read again."""
    seq = F.concat(F.when(F.min("l_suppkey") % 2 == 0, F.lit("Decoy_")).otherwise(F.lit("")), F.lit("AAK"), F.min("l_suppkey"))
    psm = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("spec_id")).agg(seq.alias("seq"), F.collect_list("l_extendedprice").alias("obs_int"), F.collect_list(F.concat(F.lit("y"), "l_linenumber")).alias("frag_names"))
    at = folder(spark, "results")
    writers.write_result_rows(psm, at)
    got = readers.read_results(spark, at)
    return got.select("spec_id", F.size("frag_names").cast("long").alias("n"), F.round(F.aggregate("obs_int", F.lit(0.0), lambda s, x: s + x), 2).alias("total"), F.replace("seq", F.lit("Decoy_")).alias("seq"), "decoy")


@query("SELECT p_retailprice AS mz, p_size % 5 AS charge, p_size/2.0 AS rt_apex, p_size/4.0 AS rt_start, CAST(p_size AS DOUBLE) AS rt_end, p_retailprice*2 AS intensity_apex FROM part")
def feature_table(spark, sf_dir):
    at, s = folder(spark, "features"), F.col("p_size")
    t(spark, sf_dir, "part").select(F.col("p_retailprice").alias("mz"), (s % 5).alias("charge"), (s / 2).alias("rtApex"), (s / 4).alias("rtStart"), s.alias("rtEnd"), (F.col("p_retailprice") * 2).alias("intensityApex"), F.col("p_name").alias("more")).write.csv(at, sep="\t", header=True)
    return readers.read_features(spark, at)


@query(f"SELECT 'A' || p_partkey AS accession, {SEQ} AS sequence FROM part WHERE p_size % 7 <> 0")
def fasta_entries(spark, sf_dir):
    """Entries of a FASTA file, sequences on two lines; those without an accession are left out."""
    at = folder(spark, "fasta")
    head = F.when(F.col("p_size") % 7 == 0, F.lit(">plain")).otherwise(F.concat(F.lit(">sp|A"), "p_partkey", F.lit("|P_TEST one")))
    parts(spark, sf_dir).select(F.concat(head, F.lit("\n"), F.substring("seq", 1, 3), F.lit("\n"), F.expr("substring(seq, 4)")).alias("value")).write.text(at)
    return readers.read_fasta(spark, at).select("accession", "sequence")


@query("""SELECT event_type AS channel, count(DISTINCT user_id) AS precursors FROM events WHERE event_type <> 'error' AND value < 100 GROUP BY 1""")
def result_outputs(spark, sf_dir):
    """Outputs of identified rows, written and read again: targets below the threshold."""
    ids = t(spark, sf_dir, "events").select(F.col("user_id").alias("untag_prec"), F.col("event_type").alias("channel"), (F.col("event_type") == "error").alias("decoy"), F.col("value").alias("qvalue"), F.col("value").alias("best_channel_qvalue"))
    at = folder(spark, "outputs")
    writers.write_results(ids, at, 100)
    return spark.read.parquet(f"{at}/filtered_ids").groupBy("channel").agg(F.countDistinct("untag_prec").alias("precursors"))


@query("""SELECT CAST(floor(epoch_us(ts)/600000000) AS BIGINT) AS slot, event_type, count(*) AS n, round(sum(value),2) AS total FROM events GROUP BY 1, 2""")
def windowed_stream(spark, sf_dir):
    """All windows of a file stream of events, kept in the stream's state, after one available-now run."""
    from ..streaming.scans import read_stream, windowed, write_windows

    at = folder(spark, "stream")
    t(spark, sf_dir, "events").select("ts", "event_type", "value").write.parquet(f"{at}/in")
    stream = read_stream(spark, f"{at}/in", "ts timestamp_ntz, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    write_windows(windowed(stream, "ts", ["event_type"], "value"), f"{at}/out", f"{at}/state", closed_only=False).awaitTermination()
    got = spark.read.parquet(f"{at}/out")
    return got.select((F.unix_micros("start") / 600_000_000).cast("long").alias("slot"), "event_type", "n", F.round("total", 2).alias("total"))


@query()
def retention_times(spark, sf_dir):
    """A part's price predicted from its peptide by the model that is fitted on all parts."""
    from ..operators import retention

    own = spread(parts(spark, sf_dir).select("p_partkey", "seq", "p_retailprice"))
    model = retention.fit(own, "seq", "p_retailprice", 1.0)
    return own.select("p_partkey", F.round(model(F.col("seq")), 3).alias("predicted"))
