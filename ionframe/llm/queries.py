"""The registered opN_ queries: each operator with production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_texts

    return main_texts(_table(spark, sf_dir, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find

    return find(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digests

    return digests(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import digests

    return digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_html_text, op3_minhash_near_dedup, op4_quality, op5_language, op6_pii, op7_secrets, op8_line_dedup, op9_packing, op10_embedding_near_dedup, op11_pieces, op12_collocations, op13_periodic_runs)}
_WORDS = "list_filter(regexp_split_to_array(translate({0},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

# Recursive reachability over the links (x, y) that hold both directions; least node reached.
_REACH = "reach AS (SELECT {0} AS x, {0} AS y FROM {1} UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x), c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)"

ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM d, unnest(range(1, greatest(len(w)-3, 2))) t(i) WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100*k >= 75*(a.n + b.n - k)), {_REACH.format("doc_id", "documents")}
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id""",
    "op8_line_dedup": f"""WITH parts AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents),
  l AS (SELECT doc_id, i-1 AS k, doc_id*10000000 + i AS pos, p[i] AS line, {_WORDS.format("p[i]")} AS ws FROM parts, unnest(range(1, len(p)+1)) t(i)),
  m AS (SELECT *, len(ws) AS n, array_to_string(ws, ' ') AS f FROM l),
  v AS (SELECT pos, n, j, array_to_string(list_concat(ws[:j-1], ws[j+1:]), ' ') AS g FROM m, unnest(range(1, n+1)) t(j) WHERE n >= 5),
  ff AS (SELECT f, min(pos) AS first FROM m WHERE n >= 5 GROUP BY f), fg AS (SELECT g, min(pos) AS first FROM v GROUP BY g),
  gone AS (SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY f) AS first FROM m WHERE n >= 5) WHERE first < pos
    UNION SELECT pos FROM (SELECT pos, min(pos) OVER (PARTITION BY n, j, g) AS first FROM v) WHERE first < pos
    UNION SELECT v.pos FROM v JOIN ff ON v.g = ff.f WHERE ff.first < v.pos
    UNION SELECT m.pos FROM m JOIN fg ON m.f = fg.g WHERE m.n >= 5 AND fg.first < m.pos)
  SELECT m.doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (gone.pos IS NULL), '') AS text, count(*) AS n_lines, count(gone.pos) AS n_removed FROM m LEFT JOIN gone ON gone.pos = m.pos GROUP BY m.doc_id""",
    "op12_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
  v AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
  n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM v GROUP BY lang),
  g AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase, count(*) AS f FROM v, range(1, 6) s(k), unnest(range(1, greatest(len(w)-k+2, 1))) t(i) GROUP BY ALL HAVING count(*) >= 100),
  c AS (SELECT g.lang, g.k, g.phrase, g.f FROM g WHERE k >= 2 AND NOT EXISTS (SELECT 1 FROM g h WHERE h.lang = g.lang AND h.k > g.k AND contains(' ' || h.phrase || ' ', ' ' || g.phrase || ' ') AND 100*h.f >= 100*g.f)),
  x AS (SELECT c.*, i, array_to_string(string_split(phrase, ' ')[:i], ' ') AS head, array_to_string(string_split(phrase, ' ')[i+1:], ' ') AS tail FROM c, unnest(range(1, k)) t(i)),
  y AS (SELECT x.lang, x.phrase, x.f AS a, i, lg.f AS l, rg.f AS r, n.n, ((1000::HUGEINT*x.f*n.n) // (lg.f::HUGEINT*rg.f))::BIGINT AS score FROM x JOIN g lg ON lg.lang = x.lang AND lg.phrase = x.head JOIN g rg ON rg.lang = x.lang AND rg.phrase = x.tail JOIN n ON n.lang = x.lang),
  z AS (SELECT lang, phrase, a, l, r, n, score FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank <= 2000""",
    "op10_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
  l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  n AS (SELECT x, count(*) AS n FROM l GROUP BY x), {_REACH.format("vec_id", "embeddings")}
  SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e LEFT JOIN n ON n.x = e.vec_id JOIN c ON c.x = e.vec_id""",
}
