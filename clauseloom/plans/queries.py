"""Queries over the clause views: name -> function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import ids
from clauseloom.functions import text as tx
from clauseloom.operators import generate, links, markdown, relations, tree, vectors
from clauseloom.plans import fixtures as fx
from clauseloom.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- tree ------------------------------------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {fx.TREE_SQL}, up AS (
  SELECT id AS ancestor, w FROM tree
  UNION ALL SELECT regexp_replace(ancestor, '\\.[^.]*$', ''), w FROM up WHERE contains(ancestor, '.'))
SELECT ancestor, count(*) AS tree_size, CAST(sum(w) AS BIGINT) AS tree_weight FROM up GROUP BY ancestor""")
def subtree_sums(s: SparkSession, d: str) -> DataFrame:
    return tree.subtree_sums(fx.clause_tree(s, d), weight=F.col("w"))


@query(f"""WITH {fx.TREE_SQL}, c AS (SELECT id AS child_id, regexp_replace(id, '\\.[^.]*$', '') AS parent_id FROM tree WHERE contains(id, '.'))
SELECT parent_id, child_id FROM c WHERE parent_id IN (SELECT id FROM tree)""")
def clause_edges(s: SparkSession, d: str) -> DataFrame:
    c = fx.clause_tree(s, d).select(F.col("id").alias("clause_id"), (ids.depth(F.col("id")) + 1).alias("level"))
    return tree.attach(c)[0]


@query(f"""WITH {fx.IDS_SQL}, c AS (SELECT 'IEC61508' AS series, regexp_extract(clause_id, '-(\\d*):', 1) AS part, clause_id FROM ids)
SELECT series, count(*) + count(DISTINCT part) + 1 AS size, CAST(sum(length(clause_id)) AS BIGINT) AS weight FROM c GROUP BY series""")
def series_sums(s: SparkSession, d: str) -> DataFrame:
    c = fx.clause_ids(s, d).select("clause_id", ids.clause_id_parts(F.col("clause_id")).alias("p")).select("clause_id", "p.series", "p.part")
    return tree.series_sums(c, F.length("clause_id"))


@query(f"""WITH {fx.IDS_SQL}, t AS (SELECT DISTINCT 'IEC61508' AS series, regexp_extract(clause_id, '-(\\d*):', 1) AS part FROM ids)
SELECT 'IEC61508' AS clause_id, 'x' AS type, 'Root Clause for IEC61508' AS title UNION ALL SELECT series || '-' || part, 'x', 'Part ' || part || ' Clause for ' || series FROM t""")
def root_clauses(s: SparkSession, d: str) -> DataFrame:
    c = fx.clause_ids(s, d).select(F.split("clause_id", r"\.")[0].alias("clause_id")).distinct()
    p = ids.clause_id_parts(F.col("clause_id"))
    return tree.roots(c.select("clause_id", p["series"].alias("series"), p["part"].alias("part"), p["level"].alias("level")))[0]


@query(f"""WITH {fx.TREE_SQL} SELECT id AS clause_id, list_reduce(list_transform(range(1, len(string_split(id, '.')) + 1), lambda k: 'H ' || array_to_string(list_slice(string_split(id, '.'), 1, k), '.')), lambda a, b: a || '->' || b) AS path FROM tree""")
def context_paths(s: SparkSession, d: str) -> DataFrame:
    return tree.context_paths(fx.clause_tree(s, d).select(F.col("id").alias("clause_id"), F.concat(F.lit("H "), "id").alias("heading")))


# --- ids --------------------------------------------------------------------------------------------------------------
@query(f"""WITH {fx.IDS_SQL} SELECT o_orderkey, clause_id, md5(clause_id) AS hash, 'IEC61508' AS series, regexp_extract(clause_id, '-(\\d*):', 1) AS part,
  regexp_extract(clause_id, ':\\d{{4}} (.*)$', 1) AS chapter, CAST(2 AS INTEGER) AS level, regexp_replace(clause_id, '\\.[^.]*$', '') AS parent FROM ids""")
def clause_ids(s: SparkSession, d: str) -> DataFrame:
    p = ids.clause_id_parts(F.col("clause_id"))
    return fx.clause_ids(s, d).select("o_orderkey", "clause_id", F.md5("clause_id").alias("hash"), p["series"].alias("series"), p["part"].alias("part"), p["chapter"].alias("chapter"), p["level"].alias("level"), ids.parent_id(F.col("clause_id"), p["level"]).alias("parent"))


@query("""SELECT c_custkey, 'ISO 26262-' || (c_custkey % 3 + 1) || ':2018 ' || k || '.' || i AS clause_id FROM (SELECT c_custkey, c_custkey % 9 + 1 AS k, unnest(range(1, c_custkey % 4 + 2)) AS i FROM customer)""")
def expanded_items(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    v = fx.table(s, d, "customer").select(
        "c_custkey", F.lit("ISO 26262").alias("name"), F.lit("2018").alias("year"), F.lit(2011).alias("original_year"), F.lit(11).alias("digits"), F.lit(0).alias("part_shift"), F.lit(2).alias("part_digits"),
        F.concat(k % 3 + 1, F.lit("-r"), k % 9 + 1, F.lit(".{1.."), k % 4 + 1, F.lit("}")).alias("items"),
    )
    return ids.parse_items(ids.expand_items(v)).select("c_custkey", "clause_id")


@query("""SELECT DISTINCT 1 + (c_custkey % 3) AS part, lpad(CAST(1 + c_custkey % 3 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0') || '0000' AS uid,
  (1 + c_custkey % 3) || '.' || (c_custkey % 12 + 1) || '.' || (c_custkey % 40) AS level0 FROM customer""")
def item_uids(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    v = fx.table(s, d, "customer").select((k % 3 + 1).alias("p"), (k % 12 + 1).alias("c"), (k % 40).alias("x")).distinct()
    v = v.select(F.lit("A 12345").alias("name"), F.lit("2018").alias("year"), F.lit(2011).alias("original_year"), F.lit(11).alias("digits"), F.lit(0).alias("part_shift"), F.lit(2).alias("part_digits"), "p", F.concat("p", F.lit("-c"), "c", F.lit(".+"), "x").alias("item"))
    return ids.parse_items(v).select(F.col("p").alias("part"), "uid", F.regexp_replace("level", "^0", "").alias("level0"))


_TITLES = """n AS (SELECT p_partkey, 'IEC 61508-1:2010 ' || p_partkey AS clause_id, p_name, p_size, CASE WHEN p_size % 3 = 0 THEN 'r' ELSE 'u' END AS type FROM part),
t AS (SELECT clause_id, p_name AS heading, CASE WHEN p_size % 5 = 0 THEN upper(type) ELSE type END AS marker FROM n WHERE p_size % 7 <> 0)"""


@query(f"""WITH {_TITLES} SELECT n.clause_id, md5(n.clause_id) AS hash, coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE t.heading END, CASE type WHEN 'r' THEN 'REQUIREMENT' ELSE 'TOC' END) AS title,
  type AS marker, substr(coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE t.heading END, CASE type WHEN 'r' THEN 'REQUIREMENT' ELSE 'TOC' END), 1, 40) AS header FROM n LEFT JOIN t USING (clause_id)""")
def item_titles(s: SparkSession, d: str) -> DataFrame:
    p = fx.table(s, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "r").otherwise("u")
    cid = F.concat(F.lit("IEC 61508-1:2010 "), "p_partkey")
    parsed = p.select(F.lit("IEC61508").alias("std_key"), cid.alias("clause_id"), F.md5(cid).alias("hash"), F.md5(F.concat(F.lit("old"), cid)).alias("legacy_hash"), kind.alias("type"), F.lit("0").alias("uid"), F.lit("1").alias("level"))
    toc = p.filter("p_size % 7 <> 0").select(F.lit("IEC61508").alias("std_key"), F.md5(cid).alias("hash"), F.col("p_name").alias("heading"), F.when(F.col("p_size") % 5 == 0, F.upper(kind)).otherwise(kind).alias("marker"), F.lit(False).alias("is_local"))
    texts = toc.select("std_key", "hash", F.lit("").alias("headline"), F.lit("").alias("text"), "is_local").limit(0)
    return ids.join_titles(parsed, toc, texts, basic=True).select("clause_id", "hash", "title", "marker", "header")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'B' WHEN p_size % 4 = 1 THEN 'C' WHEN p_size % 4 = 2 THEN p_name ELSE 'TOC' END AS heading, p_size % 4 <> 3 AS is_specific FROM part")
def best_headings(s: SparkSession, d: str) -> DataFrame:
    alt = lambda *xs: F.array(*[F.struct(F.lit(h).alias("heading"), F.lit(st).alias("status"), F.lit("").alias("source")) for h, st in xs])
    k = F.col("p_size") % 4
    a = F.when(k == 0, alt(("A", "generated"), ("B", "selected"), ("C", "generated"))).when(k == 1, alt(("A", "generated"), ("C", "generated"))).otherwise(F.filter(alt(("", "")), lambda x: F.lit(False)))
    p = fx.table(s, d, "part").select("p_partkey", F.when(k == 2, F.col("p_name")).otherwise("TOC").alias("display"), a.alias("alternatives"))
    return p.select("p_partkey", tx.best_heading(F.col("display"), F.col("alternatives")).alias("heading"), tx.is_specific(F.col("display"), F.col("alternatives")).alias("is_specific"))


# --- text -------------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS BIGINT) AS n_words, md5(text) AS hash FROM documents")
def word_counts(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"), F.md5("text").alias("hash"))


@query("""SELECT doc_id, h AS hinted FROM (SELECT doc_id, unnest([CASE WHEN regexp_matches(text, '(?i)shall') THEN 'r' END, CASE WHEN regexp_matches(text, '(?i)objective') THEN 'o' END, CASE WHEN regexp_matches(text, '(?i)scope') THEN 's' END]) AS h FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' It SHALL.' WHEN doc_id % 3 = 1 THEN ' Objective and scope.' ELSE '' END AS text FROM documents)) WHERE h IS NOT NULL""")
def type_report(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    c = fx.table(s, d, "documents").select(F.col("doc_id").alias("clause_id"), F.lit("u").alias("type"), F.concat("text", F.when(k == 0, " It SHALL.").when(k == 1, " Objective and scope.").otherwise("")).alias("text"))
    return markdown.type_report(c).select(F.col("clause_id").alias("doc_id"), "hinted")


@query()
def sentence_counts(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n_sentences"))


_SEG = f"""{fx.LINES_SQL}, {fx.CHAPTERS_SQL},
h AS (SELECT l.*, regexp_extract(line, '^#+\\s+([1-9A-Z][0-9.]*)\\s(.*)', 1) AS chapter FROM lines l),
m AS (SELECT h.*, CASE WHEN c.chapter IS NOT NULL THEN h.series || ' ' || c.chapter END AS clause_id FROM h LEFT JOIN chapters c ON h.series = c.series AND starts_with(line, '#') AND h.chapter = c.chapter),
r AS (SELECT *, last_value(clause_id IGNORE NULLS) OVER (PARTITION BY series ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM m)"""


@query(f"""WITH {_SEG} SELECT cur AS clause_id, count(*) AS n_lines, md5(string_agg(rtrim(line), chr(10) ORDER BY line_no)) AS text_md5 FROM r WHERE NOT starts_with(line, '#') AND cur IS NOT NULL GROUP BY cur""")
def markdown_segments(s: SparkSession, d: str) -> DataFrame:
    texts = markdown.segment(fx.document_lines(s, d), fx.chapters(s, d))[0]
    return texts.select("clause_id", F.size("text").cast("long").alias("n_lines"), F.md5(F.array_join("text", "\n")).alias("text_md5"))


@query(f"""WITH {_SEG} SELECT c.series, c.chapter FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.clause_id = c.series || ' ' || c.chapter)""")
def missed_headings(s: SparkSession, d: str) -> DataFrame:
    rows, known = fx.document_lines(s, d), fx.chapters(s, d)
    return markdown.missed(known, markdown.segment(rows, known)[1], rows).select("series", "chapter")


@query(f"""WITH {_SEG} SELECT series, line_no, chapter FROM m WHERE starts_with(line, '#') AND clause_id IS NULL""")
def dropped_headings(s: SparkSession, d: str) -> DataFrame:
    return markdown.segment(fx.document_lines(s, d), fx.chapters(s, d))[2].select("series", F.col("line_no").cast("long").alias("line_no"), "chapter")


# --- relations --------------------------------------------------------------------------------------------------------
_FUSED = f"""{fx.VECTORS_SQL},
near AS (SELECT q.vec_id AS qid, n.domain, n.vec_id AS nid, q.clause_id, q.sent_no, q.domain AS own, n.clause_id AS peer_id, list_dot_product(q.vec, n.vec) * CASE WHEN q.type = n.type THEN 2 ELSE 1 END AS s,
  row_number() OVER (PARTITION BY q.vec_id, n.domain ORDER BY list_dot_product(q.vec, n.vec) DESC, n.vec_id) AS rk FROM sv q, sv n),
b AS (SELECT clause_id, sent_no, own, domain, peer_id, max(s) AS s FROM near WHERE rk <= 10 GROUP BY ALL),
a AS (SELECT *, avg(s) OVER w AS mean, max(s) OVER w - avg(s) OVER w AS sig FROM b WINDOW w AS (PARTITION BY clause_id, sent_no, domain)),
f AS (SELECT * FROM a WHERE s >= mean - 1e-9),
w0 AS (SELECT clause_id, sent_no, count(*) AS n, max(sig) AS sig FROM f WHERE domain = own GROUP BY ALL),
wt AS (SELECT clause_id, sent_no, n / avg(n) OVER (PARTITION BY clause_id) AS scat, sig / nullif(avg(sig) OVER (PARTITION BY clause_id), 0) AS sign FROM w0),
p AS (SELECT f.clause_id, own, domain, peer_id, round(sum(s * coalesce(sign, 1)), 6) AS score, count(*) AS hits FROM f LEFT JOIN wt USING (clause_id, sent_no) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY clause_id, domain ORDER BY score DESC, peer_id) AS rk FROM p),
rel AS (SELECT clause_id AS src, peer_id AS dst, score, domain FROM k WHERE rk <= 3 AND domain <> own),
par AS (SELECT *, regexp_replace(src, '\\.[^.]*$', '') AS parent, regexp_replace(dst, '\\.[^.]*$', '') AS peer_parent FROM rel),
cl AS (SELECT parent, peer_parent, domain, list_sort(list_distinct(list(src))) AS members FROM par GROUP BY ALL HAVING count(DISTINCT src) >= 3)"""


def _fused(s: SparkSession, d: str) -> DataFrame:
    sv = fx.sentence_vectors(s, d)
    found = vectors.top_k(sv.select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec")), sv.select(F.col("vec_id").alias("nid"), "domain", F.col("vec").alias("nvec")), 10)
    q = sv.select(F.col("vec_id").alias("qid"), "clause_id", "sent_no", F.col("type").alias("clause_type"), F.col("domain").alias("own"))
    n = sv.select(F.col("vec_id").alias("nid"), F.col("clause_id").alias("peer_id"), F.col("type").alias("peer_type"))
    return relations.fused(found.join(q, "qid").join(n, "nid"))


def _peers(s: SparkSession, d: str) -> DataFrame:
    f = _fused(s, d)
    return relations.peers(f, relations.weights(f))


def _relations(s: SparkSession, d: str) -> DataFrame:
    return relations.relate(_peers(s, d))


def _domains(s: SparkSession, d: str) -> DataFrame:
    return fx.sentence_vectors(s, d).select("clause_id", "domain").distinct()


@query(f"WITH {_FUSED} SELECT qid, CAST(domain AS INTEGER) AS domain, nid, CAST(rk AS INTEGER) AS rank FROM near WHERE rk <= 10")
def top_k_nodes(s: SparkSession, d: str) -> DataFrame:
    sv = fx.sentence_vectors(s, d)
    return vectors.top_k(sv.select(F.col("vec_id").alias("qid"), F.col("vec").alias("qvec")), sv.select(F.col("vec_id").alias("nid"), "domain", F.col("vec").alias("nvec")), 10).select("qid", "domain", "nid", "rank")


@query(f"WITH {_FUSED} SELECT clause_id, CAST(sent_no AS INTEGER) AS sent_no, round(scat, 6) AS scat, round(sign, 6) AS sign FROM wt")
def sentence_weights(s: SparkSession, d: str) -> DataFrame:
    return relations.weights(_fused(s, d)).select("clause_id", "sent_no", F.round("scat", 6).alias("scat"), F.round("sign", 6).alias("sign"))


@query(f"WITH {_FUSED} SELECT src, dst, score FROM rel")
def mined_relations(s: SparkSession, d: str) -> DataFrame:
    return _relations(s, d)


@query(f"WITH {_FUSED}, t AS (SELECT clause_id, clause_id = peer_id AS hit FROM k WHERE domain = own AND rk = 1), g AS (SELECT regexp_extract(clause_id, '^(D\\d)', 1) AS series, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM t GROUP BY ALL) SELECT series, hits, misses, round(hits / (hits + misses), 6) AS accuracy FROM g")
def self_identification(s: SparkSession, d: str) -> DataFrame:
    return relations.accuracy(relations.self_identification(_peers(s, d)), F.substring_index("clause_id", "-", 1))


@query(f"WITH {_FUSED}, u AS (SELECT regexp_replace(clause_id, '\\.[^.]*$', '') AS parent, own, domain, regexp_replace(peer_id, '\\.[^.]*$', '') AS peer_parent, round(sum(score), 6) AS score FROM p GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY parent, domain ORDER BY score DESC, peer_parent) AS rk FROM u) SELECT parent, CAST(domain AS INTEGER) AS domain, peer_parent, CASE WHEN domain = own THEN parent = peer_parent END AS hit FROM t WHERE rk = 1")
def level_up(s: SparkSession, d: str) -> DataFrame:
    return relations.level_up(_peers(s, d)).select("parent", "domain", "peer_parent", "hit")


@query(f"WITH {_FUSED}, i AS (SELECT dst AS clause_id, sum(score) AS impulse FROM rel GROUP BY dst) SELECT clause_id, round(impulse / avg(impulse) OVER (), 6) AS resonance FROM i")
def resonance(s: SparkSession, d: str) -> DataFrame:
    return relations.resonance(_relations(s, d)).drop("impulse")


@query(f"WITH {_FUSED} SELECT parent, peer_parent, CAST(domain AS INTEGER) AS domain, array_to_string(members, ',') AS members FROM cl")
def sibling_clusters(s: SparkSession, d: str) -> DataFrame:
    return relations.clusters(_relations(s, d), _domains(s, d), 3).withColumn("members", F.array_join("members", ","))


@query(f"WITH {_FUSED}, rc AS (SELECT * FROM cl x WHERE EXISTS (SELECT 1 FROM cl y WHERE y.parent = x.peer_parent AND y.peer_parent = x.parent)), m AS (SELECT parent, peer_parent, unnest(members) AS src FROM rc) SELECT m.parent, m.peer_parent, m.src AS member, par.dst AS peer, par.score, coalesce(v.score, 0) AS revscore FROM m JOIN par ON m.src = par.src AND m.peer_parent = par.peer_parent LEFT JOIN rel v ON v.src = par.dst AND v.dst = par.src")
def reciprocal_clusters(s: SparkSession, d: str) -> DataFrame:
    rel = _relations(s, d)
    return relations.cluster_rows(relations.reciprocal(relations.clusters(rel, _domains(s, d), 3)), rel)


@query(f"WITH {_FUSED} SELECT DISTINCT least(parent, peer_parent) AS first, greatest(parent, peer_parent) AS second FROM cl")
def cluster_comparisons(s: SparkSession, d: str) -> DataFrame:
    found = relations.clusters(_relations(s, d), _domains(s, d), 3)
    parents = _domains(s, d).select(ids.parent_path(F.col("clause_id")).alias("clause_id"), F.col("domain").cast("string").alias("domain")).distinct()
    return relations.comparisons(found, parents, ["0", "1", "2"])


@query(f"WITH {_FUSED} SELECT a.src, a.dst FROM rel a JOIN rel b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def bijective_links(s: SparkSession, d: str) -> DataFrame:
    rel = _relations(s, d)
    uids = _domains(s, d).select("clause_id", F.substring(F.md5("clause_id"), 1, 8).alias("uid"))
    return links.bijective(rel, uids).select("src", "dst")


@query(f"WITH {fx.VECTORS_SQL} SELECT vec_id, lag(vec_id) OVER w AS previous, lead(vec_id) OVER w AS next FROM sv WINDOW w AS (PARTITION BY clause_id ORDER BY sent_no)")
def neighbour_texts(s: SparkSession, d: str) -> DataFrame:
    sv = fx.sentence_vectors(s, d).select("vec_id", "clause_id", "sent_no", F.col("vec_id").alias("sentence"))
    return vectors.neighbours(sv, 1).select("vec_id", F.get("previous_texts", F.lit(0)).alias("previous"), F.get("next_texts", F.lit(0)).alias("next"))


# --- links ------------------------------------------------------------------------------------------------------------
@query("""SELECT p.p_partkey, lpad(CAST(p.p_partkey AS VARCHAR), 8, '0') AS from_uid, 'P ' || p.p_partkey AS from_clause, CASE WHEN s.s_suppkey IS NOT NULL THEN 'S ' || s.s_suppkey END AS to_clause FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey % 150""")
def curated_links(s: SparkSession, d: str) -> DataFrame:
    p, sup = fx.table(s, d, "part"), fx.table(s, d, "supplier")
    rows = p.select("p_partkey", F.lit("P").alias("from_std"), F.lit("S").alias("to_std"), F.col("p_partkey").cast("string").alias("from_uid"), (F.col("p_partkey") % 150).cast("string").alias("to_uid"))
    uids = p.select(F.lit("P").alias("std_key"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("uid"), F.concat(F.lit("P "), "p_partkey").alias("clause_id"))
    uids = uids.unionByName(sup.select(F.lit("S").alias("std_key"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("uid"), F.concat(F.lit("S "), "s_suppkey").alias("clause_id")))
    digits = s.createDataFrame([("P", 8), ("S", 8)], "std_key string, digits int")
    return links.curated(rows, uids, digits).select("p_partkey", "from_uid", "from_clause", "to_clause")


_REFS = "r AS (SELECT o_orderkey, 'IEC 61508-' || (o_custkey % 7) || ':2010 ' || (o_orderkey % 9 + 1) || '.' || (o_orderkey % 13) AS ref, o_custkey % 7 < 5 AS ok FROM orders)"


def _refs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = fx.clause_ids(s, d).select(F.lit("notes.md").alias("file"), F.col("o_orderkey").alias("line_no"), F.concat(F.lit("see "), "clause_id", F.lit(", and more")).alias("line"))
    known = fx.clause_ids(s, d).select("clause_id").distinct().filter(F.regexp_extract("clause_id", r"-(\d)", 1).isin(*"01234"))
    return rows, known.select("clause_id", F.lit("IEC61508").alias("std_key"), F.concat(F.lit("IEC61508-"), F.substring(F.md5("clause_id"), 1, 8)).alias("uid"))


@query(f"WITH {_REFS} SELECT o_orderkey AS line_no, ref, ok AS resolved, CASE WHEN ok THEN '[' || ref || '](../requirements/IEC61508.html#IEC61508-' || substr(md5(ref), 1, 8) || ')' ELSE '>>' || ref || '<<' END AS link FROM r")
def resolved_references(s: SparkSession, d: str) -> DataFrame:
    return links.resolve(*_refs(s, d)).select("line_no", "ref", "resolved", "link")


@query(f"WITH {_REFS} SELECT o_orderkey AS line_no, 'see ' || CASE WHEN ok THEN '[' || ref || '](../requirements/IEC61508.html#IEC61508-' || substr(md5(ref), 1, 8) || ')' ELSE '>>' || ref || '<<' END || ', and more' AS line FROM r")
def rewritten_lines(s: SparkSession, d: str) -> DataFrame:
    return links.rewrite(*_refs(s, d)).select("line_no", "line")


@query(f"WITH {_REFS} SELECT ref AS keyword, o_orderkey AS line_no FROM r WHERE ok")
def pattern_references(s: SparkSession, d: str) -> DataFrame:
    rows, known = _refs(s, d)
    return links.find_keywords(rows, known.select(F.col("clause_id").alias("keyword")), r"\.md$").select("keyword", "line_no")


# --- sources and sinks ------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey % 7 <> 0 AS accepted FROM orders")
def structure_rows(s: SparkSession, d: str) -> DataFrame:
    cid = F.when(F.col("o_custkey") % 7 == 0, "ISO/TS 5083:2025 1").otherwise(F.concat(F.lit("IEC 61508-1:2010 "), F.col("o_orderkey") % 9 + 1))
    kept, rejects = files.split_structure(fx.table(s, d, "orders").select("o_orderkey", cid.alias("clause_id")))
    return kept.select("o_orderkey", F.lit(True).alias("accepted")).unionByName(rejects.select("o_orderkey", F.lit(False).alias("accepted")))


@query("SELECT s_suppkey AS line_no, 's' || s_suppkey AS src, 's' || (s_suppkey * 3) AS dst, s_suppkey * 3 <= (SELECT max(s_suppkey) FROM supplier) AS known FROM supplier WHERE s_suppkey % 2 = 0")
def known_relations(s: SparkSession, d: str) -> DataFrame:
    sup = fx.table(s, d, "supplier")
    rows = sup.select(F.col("s_suppkey").alias("line_no"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("s"), "s_suppkey")).otherwise("nobody").alias("src"), F.concat(F.lit("s"), F.col("s_suppkey") * 3).alias("dst"))
    kept, rejects = files.known_relations(rows, sup.select(F.concat(F.lit("s"), "s_suppkey").alias("clause_id")))
    return kept.withColumn("known", F.lit(True)).unionByName(rejects.withColumn("known", F.lit(False)))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'unknown clause' WHEN p_size % 2 = 1 THEN 'length mismatch' ELSE 'ok' END AS status FROM part")
def weight_findings(s: SparkSession, d: str) -> DataFrame:
    p = fx.table(s, d, "part")
    rows = files.parse_weights(p.select(F.col("p_partkey").alias("clause_id"), F.lit("[1, 2]").alias("scatter"), F.lit("[0.5,0.5]").alias("significance")))
    counts = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("clause_id"), (F.col("p_size") % 2 + 2).alias("sentences"))
    return files.check_weights(rows, counts).select(F.col("clause_id").alias("p_partkey"), "status")


@query("SELECT 'S 1.' || p_partkey AS clause_id, 'TOC;' || md5('S 1.' || p_partkey) || ';S 1.' || p_partkey || ';' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Gen' END || ';' || CASE WHEN p_size % 2 = 0 THEN 'r' ELSE 'R' END AS line FROM part")
def heading_lines(s: SparkSession, d: str) -> DataFrame:
    alt = F.array(F.struct(F.lit("Gen").alias("heading"), F.lit("generated").alias("status"), F.lit("m").alias("source")))
    named = F.col("p_size") % 2 == 0
    c = fx.table(s, d, "part").select(F.concat(F.lit("S 1."), "p_partkey").alias("clause_id"), F.lit("r").alias("type"), F.when(named, F.col("p_name")).otherwise("TOC").alias("display"), alt.alias("alternatives"))
    return sinks.heading_dump(c.withColumn("dfs_key", F.col("clause_id"))).select(F.col("dfs_key").alias("clause_id"), "line")


@query("SELECT p_partkey, [CAST(p_size AS DOUBLE), 1.5::DOUBLE] AS scat FROM part")
def parsed_weights(s: SparkSession, d: str) -> DataFrame:
    rows = fx.table(s, d, "part").select(F.col("p_partkey").alias("clause_id"), F.concat(F.lit("[ "), "p_size", F.lit(", 1.5]")).alias("scatter"), F.lit("[1]").alias("significance"))
    return files.parse_weights(rows).select(F.col("clause_id").alias("p_partkey"), "scat")


@query("SELECT 'TEXT;' || md5('P' || p_partkey) || ';P' || p_partkey || ';' || p_name || ';\"' || p_type || '~' || p_brand || '\"' AS line FROM part")
def text_rows(s: SparkSession, d: str) -> DataFrame:
    return sinks.text_dump(fx.table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("clause_id"), F.col("p_name").alias("heading"), F.array("p_type", "p_brand").alias("text"))).select("line")


@query("SELECT p_brand AS series, md5(string_agg('# ' || p_partkey || ' ' || p_name || chr(10) || p_type, chr(10) ORDER BY p_partkey)) AS body_md5 FROM part GROUP BY p_brand")
def regenerated_markdown(s: SparkSession, d: str) -> DataFrame:
    c = fx.table(s, d, "part").select(F.col("p_brand").alias("series"), F.lit("").alias("part"), F.col("p_partkey").cast("string").alias("chapter"), F.col("p_name").alias("title"), F.array("p_type").alias("text"))
    return sinks.regenerated(c).select("series", F.md5("body").alias("body_md5"))


@query("""WITH w AS (SELECT doc_id, lower(unnest(x)) AS w, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '\\p{L}{4,}') AS x FROM documents)),
b AS (SELECT doc_id, w, count(*) AS n, min(i) AS i FROM w GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS rk FROM b)
SELECT CAST(doc_id AS VARCHAR) AS clause_id, string_agg(upper(w[1]) || w[2:], ' ' ORDER BY i) AS heading, 'generated' AS status, 'extractive' AS source FROM t WHERE rk <= 3 GROUP BY doc_id""")
def generated_headings(s: SparkSession, d: str) -> DataFrame:
    empty = F.filter(F.array(F.struct(F.lit("").alias("heading"), F.lit("").alias("status"), F.lit("").alias("source"))), lambda x: F.lit(False))
    c = fx.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("clause_id"), F.lit("TOC").alias("display"), empty.alias("alternatives"), "text")
    return generate.headings(c)


@query(f"WITH {fx.TREE_SQL} SELECT id AS clause_id, 'Clause ' || id || '.' AS summary FROM tree")
def clause_summaries(s: SparkSession, d: str) -> DataFrame:
    c = fx.clause_tree(s, d).select(F.col("id").alias("clause_id"), (ids.depth(F.col("id")) + 1).alias("level"), F.col("id").alias("ord"), F.concat(F.lit("Clause "), "id", F.lit(". More.")).alias("value"))
    return generate.summaries(c.withColumn("parent_id", ids.parent_id(F.col("clause_id"), F.col("level"))))


@query()
def embedded_sentences(s: SparkSession, d: str) -> DataFrame:
    docs = fx.table(s, d, "documents").select(F.col("doc_id").alias("clause_id"), "text")
    return vectors.sentence_nodes(docs).select("clause_id", "sent_no", F.size("vec").alias("dim"))


# --- files ------------------------------------------------------------------------------------------------------------
@query("SELECT 'STD' || s_suppkey AS std_key, 2 + s_suppkey % 9 AS digits, CASE WHEN s_suppkey % 2 = 0 THEN 2011 ELSE 0 END AS original_year, s_name AS name, unnest(range(2)) AS vol_idx, unnest(['2018', '2020']) AS year, unnest(['c1 c2', 's' || s_suppkey]) AS items FROM supplier")
def standard_volumes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    body = F.concat(F.lit("parent=REQ\ndigits="), 2 + k % 9, F.lit('\nname="'), "s_name", F.lit('"\n'), F.when(k % 2 == 0, "oyr=2011\n").otherwise("# none\n"), F.lit('structure=(\n"2018 c1 c2"\n"2020 s'), k, F.lit('"\n)\n'))
    found = files.parse_standards(fx.table(s, d, "supplier").select(F.concat(F.lit("STD"), k).alias("std_key"), body.alias("value")))
    return files.volumes(found).select("std_key", "digits", "original_year", "name", F.col("vol_idx").cast("long").alias("vol_idx"), "year", "items")


@query("SELECT 'STD' || k AS std_key, CASE WHEN s_suppkey IS NULL THEN 3 ELSE 5 END AS digits, CASE WHEN s_suppkey IS NULL THEN 'ROOT' ELSE 'REQ' END AS parent, s_suppkey IS NULL AS missing FROM (SELECT unnest(range(1, 6)) * 7 AS k) LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 20) ON k = s_suppkey")
def missing_standards(s: SparkSession, d: str) -> DataFrame:
    body = fx.table(s, d, "supplier").filter("s_suppkey > 0 and s_suppkey < 20 and s_suppkey % 7 = 0").select(F.concat(F.lit("STD"), "s_suppkey").alias("std_key"), F.lit('parent=REQ\ndigits=5\nstructure=(\n"2018 c1"\n)\n').alias("value"))
    every = files.with_missing(files.parse_standards(body), [f"STD{7 * k}" for k in range(1, 6)], "ROOT")
    return every.select("std_key", "digits", "parent", (F.size("volumes") == 0).alias("missing"))


_RECORDS = "SELECT 'STD' || p_size % 3 AS std_key, md5('P' || p_partkey) AS hash, 'P' || p_partkey AS clause_id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'TOC' ELSE 'TEXT' END AS tag, p_size % 5 = 0 AS is_local FROM part WHERE p_size % 7 <> 0"


def _records(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cid = F.concat(F.lit("P"), "p_partkey")
    tag = F.when(F.col("p_size") % 7 == 0, "NOTE").when(F.col("p_size") % 2 == 0, "TOC").otherwise("TEXT")
    rows = fx.table(s, d, "part").select(F.concat(F.lit("STD"), F.col("p_size") % 3).alias("std_key"), F.concat_ws(";", tag, F.md5(cid), cid, "p_name", F.lit("r"), F.lit("")).alias("value"), (F.col("p_size") % 5 == 0).alias("is_local"))
    return files.parse_records(rows)


@query(f"SELECT std_key, hash, clause_id, title AS heading, 'r' AS marker, is_local FROM ({_RECORDS}) WHERE tag = 'TOC'")
def toc_records(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d)[0]


@query(f"SELECT std_key, hash, clause_id, title AS headline, 'r' AS text, is_local FROM ({_RECORDS}) WHERE tag = 'TEXT'")
def text_records(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d)[1]


@query("SELECT CAST(n_nationkey AS VARCHAR) AS series, CASE WHEN n_regionkey > 2 THEN n_regionkey || '-x' ELSE '' END AS part, 0 AS line_no, n_name AS line FROM nation")
def markdown_names(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("file:/a b/"), "n_nationkey", F.when(F.col("n_regionkey") > 2, F.concat(F.lit("-"), "n_regionkey", F.lit("-x"))).otherwise(""), F.lit(".md"))
    return files.parse_markdown(fx.table(s, d, "nation").select(name.alias("path"), F.lit(0).alias("line_no"), F.col("n_name").alias("line")))


@query("SELECT 'A' AS from_std, 'B' || n_nationkey AS to_std, 'equal' AS type, 'n ' || n_name AS note, CAST(n_nationkey AS VARCHAR) AS from_uid, n_name AS from_label, 'to' AS to_label, '07' AS to_uid FROM nation")
def mapping_rows(s: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit('from="A"\nto=B'), "n_nationkey", F.lit('\ntype=equal\nnote="n '), "n_name", F.lit('"\nno row;here\n'), "n_nationkey", F.lit(" ; "), "n_name", F.lit(";to; 07\n"))
    return files.parse_mappings(fx.table(s, d, "nation").select(body.alias("value")))


_CACHED = "SELECT 'C ' || n_nationkey AS clause_id, CASE WHEN n_regionkey = 1 THEN ['1. **' || n_name || '**'] ELSE ['1. **' || n_name || '**', '2. **Other ' || n_regionkey || '**', 'chatter'] END AS lines FROM nation"


def _cache(s: SparkSession, d: str) -> DataFrame:
    n, top = fx.table(s, d, "nation"), F.concat(F.lit("# C "), "n_nationkey")
    first = F.concat(F.lit("1. **"), "n_name", F.lit("**"))
    body = F.when(F.col("n_regionkey") == 1, F.array(F.lit("stray"), top, F.lit(""), first)).otherwise(F.array(F.lit("stray"), top, first, F.concat(F.lit("2. **Other "), "n_regionkey", F.lit("**")), F.lit(" "), F.lit("chatter")))
    return n.select(F.col("n_nationkey").alias("path"), F.posexplode(body).alias("line_no", "line"))


@query(f"SELECT clause_id, array_to_string(lines, '|') AS lines FROM ({_CACHED})")
def cached_summaries(s: SparkSession, d: str) -> DataFrame:
    return files.cached_texts(_cache(s, d)).withColumn("lines", F.array_join("lines", "|"))


# the numbered form's own set of characters holds the asterisk, so the last but one of those that close a heading stays
@query(f"SELECT clause_id, regexp_extract(l, '\\*\\*(.*)\\*', 1) AS heading FROM (SELECT clause_id, unnest(lines) AS l FROM ({_CACHED})) WHERE l <> 'chatter'")
def cached_headings(s: SparkSession, d: str) -> DataFrame:
    return generate.cached_headings(files.blocks(_cache(s, d)), "nemotron").select("clause_id", "heading")


@query("SELECT 'U' || s_suppkey AS uid, 'S ' || s_suppkey AS clause_id, md5('S ' || s_suppkey) AS hash FROM supplier WHERE s_suppkey % 3 <> 0")
def uid_rows_known(s: SparkSession, d: str) -> DataFrame:
    cid, sup = F.concat(F.lit("S "), "s_suppkey"), fx.table(s, d, "supplier")
    rows = sup.select(F.md5(cid).alias("hash"), F.concat(F.lit("U"), "s_suppkey").alias("uid"), cid.alias("clause_id"))
    return files.known_uids(rows, sup.filter("s_suppkey % 3 <> 0").select(cid.alias("clause_id")))


# --- catalogue --------------------------------------------------------------------------------------------------------
def _titled(s: SparkSession, d: str) -> DataFrame:
    """Titles from data, from a former id, from a local overlay, or from the headline, by size modulo 4."""
    p, k = fx.table(s, d, "part"), F.col("p_size") % 4
    std, cid, old = F.when(k == 2, "L").otherwise("D"), F.concat(F.lit("IEC 61508-1:2010 "), "p_partkey"), F.concat(F.lit("old "), "p_partkey")
    parsed = p.select(std.alias("std_key"), cid.alias("clause_id"), F.md5(cid).alias("hash"), F.md5(old).alias("legacy_hash"), F.lit("r").alias("type"), F.col("p_partkey").cast("string").alias("uid"), F.lit("1").alias("level"))
    none = F.lit("")
    toc = p.filter(k != 3).select(std.alias("std_key"), F.when(k == 1, F.md5(old)).otherwise(F.md5(cid)).alias("hash"), F.when(k == 2, "from data").otherwise(F.col("p_name")).alias("heading"), F.lit("r").alias("marker"), F.lit(False).alias("is_local"))
    toc = toc.unionByName(p.filter(k == 2).select(std.alias("std_key"), F.md5(cid).alias("hash"), F.concat(F.lit("local "), "p_name").alias("heading"), F.lit("O").alias("marker"), F.lit(True).alias("is_local")))
    texts = p.filter(k == 3).select(std.alias("std_key"), F.md5(cid).alias("hash"), F.col("p_brand").alias("headline"), F.concat(F.lit('"one~'), "p_type", F.lit('"')).alias("text"), F.lit(False).alias("is_local"))
    texts = texts.unionByName(p.filter(k == 2).select(std.alias("std_key"), F.md5(cid).alias("hash"), none.alias("headline"), F.lit("kept").alias("text"), F.lit(True).alias("is_local")))
    return ids.join_titles(parsed, toc, texts)


_TITLED = """SELECT p_partkey, 'IEC 61508-1:2010 ' || p_partkey AS clause_id, CASE p_size % 4 WHEN 2 THEN 'local ' || p_name WHEN 3 THEN p_brand ELSE p_name END AS title,
  CASE p_size % 4 WHEN 2 THEN '    kept' WHEN 3 THEN '    one' || chr(10) || '    ' || p_type ELSE '    REQUIREMENT' END AS text, CASE p_size % 4 WHEN 2 THEN 'R' ELSE 'r' END AS marker, CASE WHEN p_size % 4 = 2 THEN 'L' ELSE 'D' END AS std_key FROM part"""


@query(f"SELECT clause_id, title, text, marker, CAST(p_partkey AS VARCHAR) AS locator, marker = 'R' AS marker_mismatch FROM ({_TITLED})")
def overlaid_titles(s: SparkSession, d: str) -> DataFrame:
    return _titled(s, d).select("clause_id", "title", "text", "marker", "locator", "marker_mismatch")


@query(f"SELECT std_key, 'TOC;' || md5(clause_id) || ';' || clause_id || ';' || title || ';' || marker AS line FROM ({_TITLED})")
def heading_file_lines(s: SparkSession, d: str) -> DataFrame:
    return sinks.heading_data(_titled(s, d))


@query(f"SELECT std_key, md5(clause_id) || ';' || std_key || '-' || p_partkey || ';' || clause_id AS line FROM ({_TITLED})")
def uid_file_lines(s: SparkSession, d: str) -> DataFrame:
    return sinks.uid_rows(_titled(s, d))


@query(f"""SELECT std_key, CAST(p_partkey AS VARCHAR) AS uid, '1' AS level, 'r' AS type, substr(title, 1, 40) AS header, text, clause_id AS name, CAST(p_partkey AS VARCHAR) AS num_id, md5(clause_id) AS ref_id, clause_id AS keyword FROM ({_TITLED})""")
def item_bodies(s: SparkSession, d: str) -> DataFrame:
    field = lambda path: F.get_json_object("body", path)
    return sinks.items(_titled(s, d)).select("std_key", "uid", "level", *[field(f"$.{n}").alias(a) for n, a in (("type", "type"), ("header", "header"), ("text", "text"), ("name", "name"), ("numID", "num_id"), ("refID", "ref_id"), ("reference.keyword", "keyword"))])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'too many levels' WHEN c_custkey % 3 = 1 AND c_custkey % 40 > 9 THEN 'multi-digit sub-level' END AS warning, CASE WHEN c_custkey % 3 = 2 THEN 'A.' || (c_custkey % 40) || '.2' WHEN c_custkey % 3 = 0 THEN '1.2.3.4.5.6' ELSE '1.2.3.4.' || (c_custkey % 40) END AS index, CASE WHEN c_custkey % 3 = 2 THEN '26.' || (c_custkey % 40) || '.2' END AS annex_level FROM customer")
def item_warnings(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    item = F.when(k % 3 == 2, F.concat(F.lit("u26:A."), k % 40, F.lit(".2"))).when(k % 3 == 0, F.lit("1.2.3.4.5.6.7")).otherwise(F.concat(F.lit("1.2.3.4."), k % 40))
    item = F.regexp_replace(item, "^u", "")
    v = fx.table(s, d, "customer").select("c_custkey", F.lit("A 12345").alias("name"), F.lit("2018").alias("year"), F.lit(2011).alias("original_year"), F.lit(11).alias("digits"), F.lit(0).alias("part_shift"), F.lit(2).alias("part_digits"), item.alias("item"))
    return ids.parse_items(v).select("c_custkey", "warning", "index", F.when(F.col("enum").isNotNull(), F.col("level")).alias("annex_level"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'is top level content' WHEN 1 THEN 'is a subclause of clause \"' || n_name || '\"' ELSE 'is contained in subclause \"' || n_name || '\" under \"TOP\"' END AS context FROM nation")
def context_sentences(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "nation").select("n_nationkey", ids.context_sentence(F.col("n_name"), F.col("n_regionkey"), F.col("n_name"), F.lit("TOP")).alias("context"))


@query("SELECT n_nationkey, unnest(['a', 'C', 'm', 'o', 'R', 's', 't', 'u', 'x']) AS type, unnest(['abbreviation', 'clause', 'technique / measure', 'objective', 'requirement', 'scope', 'term', 'text', 'root']) AS name, unnest([NULL, 'clause', NULL, 'objective', 'requirement', 'scope definition', 'term definition', 'text', NULL]) AS heading_name FROM nation")
def type_names(s: SparkSession, d: str) -> DataFrame:
    n = fx.table(s, d, "nation").select("n_nationkey", F.explode(F.split(F.lit("a C m o R s t u x"), " ")).alias("type"))
    return n.select("n_nationkey", "type", ids.type_name(F.col("type")).alias("name"), ids.type_name(F.col("type"), True).alias("heading_name"))


# --- Markdown and headings --------------------------------------------------------------------------------------------
@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 2 = 0 THEN p_brand ELSE 'none' END AS effective, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'mismatch' WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'overridden' ELSE 'none' END AS finding FROM part")
def title_findings(s: SparkSession, d: str) -> DataFrame:
    p = fx.table(s, d, "part")
    heads = p.select(F.col("p_partkey").alias("clause_id"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("").alias("title"))
    listed = p.select(F.col("p_partkey").alias("clause_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("TOC").alias("title"))
    return markdown.title_findings(heads, listed).select(F.col("clause_id").alias("p_partkey"), "effective", "finding")


@query("SELECT p_partkey, unnest(range(4)) AS pos, unnest(['Dr. ' || p_brand || ' costs 3.5 units.', 'See example.com or U.S. law!', 'Is it \"ok?\"', 'Yes (Acme Inc. of ' || p_size || ')']) AS sentence FROM part")
def split_sentences(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Dr. "), "p_brand", F.lit(" costs 3.5 units. See example.com\nor U.S. law! Is it \"ok?\" Yes (Acme Inc. of "), "p_size", F.lit(")"))
    return fx.table(s, d, "part").select("p_partkey", F.posexplode(tx.sentences(text)).alias("pos", "sentence")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "sentence")


@query("SELECT p_partkey, 'A|B|' || p_name AS kept, CASE WHEN p_size % 2 = 0 THEN 'B' ELSE 'Own' END AS display, 'parsed' AS state FROM part")
def heading_alternatives(s: SparkSession, d: str) -> DataFrame:
    alt = F.array(*[F.struct(F.lit(h).alias("heading"), F.lit(st).alias("status"), F.lit("").alias("source")) for h, st in (("A", "generated"), ("B", "parsed"), ("A", "selected"))], F.struct(F.col("p_name").alias("heading"), F.lit("generated").alias("status"), F.lit("").alias("source")))
    p = fx.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "TOC").otherwise("Own").alias("shown"), alt.alias("a"))
    p = p.withColumn("display", tx.display_heading(F.col("shown"), F.col("a")))
    return p.select("p_partkey", F.array_join(F.transform(tx.distinct_alternatives(F.col("a")), lambda x: x["heading"]), "|").alias("kept"), "display", tx.heading_state(F.col("display"), F.col("a")).alias("state"))


@query("SELECT p_partkey, p_name || '*' AS numbered, p_brand AS quoted, 'Body ' || p_size || '|end' AS trimmed FROM part")
def model_replies(s: SparkSession, d: str) -> DataFrame:
    numbered = F.concat(F.lit("Sure:\n1. **"), "p_name", F.lit("**\nbye"))
    quoted = F.concat(F.lit('Here: "'), "p_brand", F.lit('".\nplain'))
    summary = F.concat(F.lit("Here is a Summary of it:\n\nBody "), "p_size", F.lit("\nend\n"))
    text = lambda c: F.array_join(c, "|")
    return fx.table(s, d, "part").select("p_partkey", text(tx.reply_headings(numbered, "nemotron")).alias("numbered"), text(tx.reply_headings(quoted, "llama3.1")).alias("quoted"), text(tx.trimmed_reply(summary, "llama3.1")).alias("trimmed"))


@query("SELECT n_nationkey AS clause_id, 'Gamma Alpha Beta' AS heading, 'generated' AS status, 'extractive' AS source FROM nation WHERE n_regionkey > 0")
def heading_offers(s: SparkSession, d: str) -> DataFrame:
    none = F.filter(F.array(F.struct(F.lit("").alias("heading"), F.lit("").alias("status"), F.lit("").alias("source"))), lambda x: F.lit(False))
    c = fx.table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("clause_id"), F.when(F.col("n_regionkey") > 0, "TOC").otherwise("Listed").alias("display"), none.alias("alternatives"), F.lit("gamma is alpha, alpha or beta: beta gamma and delta").alias("text"))
    return generate.headings(c).withColumn("clause_id", F.col("clause_id").cast("int"))


@query("SELECT n_nationkey AS clause_id, unnest(['A', 'B']) AS heading, CASE WHEN n_regionkey = 2 THEN unnest(['generated', 'selected']) ELSE 'generated' END AS status FROM nation")
def chosen_headings(s: SparkSession, d: str) -> DataFrame:
    n = fx.table(s, d, "nation")
    offers = n.select(F.col("n_nationkey").alias("clause_id"), F.explode(F.split(F.lit("A B"), " ")).alias("heading"), F.lit("generated").alias("status"))
    return generate.select(offers, n.filter("n_regionkey = 2").select(F.col("n_nationkey").alias("clause_id"), F.lit("B").alias("heading")))


@query("SELECT r_regionkey || '|x' AS clause_id, r_name || ' is here.' AS reply FROM region")
def compared_clusters(s: SparkSession, d: str) -> DataFrame:
    pairs = fx.table(s, d, "region").select(F.col("r_regionkey").cast("string").alias("first"), F.lit("x").alias("second"), F.concat("r_name", F.lit(" is here. More.")).alias("first_text"), F.lit("Other text.").alias("second_text"))
    return generate.compare(pairs)


@query(f"""WITH {fx.TREE_SQL}, leaf AS (SELECT id, regexp_replace(id, '\\.[^.]*$', '') AS p FROM tree WHERE w = 3), n AS (SELECT t.id, regexp_replace(t.id, '\\.[^.]*$', '') AS p, 'Clause ' || t.id || coalesce(' Leaf ' || min(leaf.id) || '!', '') AS v FROM tree t LEFT JOIN leaf ON leaf.p = t.id WHERE w = 2 GROUP BY t.id),
r AS (SELECT t.id, 'Clause ' || t.id || coalesce(' ' || arg_min(v, n.id), '') AS v FROM tree t LEFT JOIN n ON n.p = t.id WHERE w = 1 GROUP BY t.id)
SELECT id AS clause_id, 'Leaf ' || id || '!' AS summary FROM leaf UNION ALL SELECT id, v FROM n UNION ALL SELECT id, v FROM r""")
def folded_summaries(s: SparkSession, d: str) -> DataFrame:
    c = fx.clause_tree(s, d).select(F.col("id").alias("clause_id"), (ids.depth(F.col("id")) + 1).alias("level"), F.col("id").alias("ord"))
    c = c.withColumn("value", F.when(F.col("level") == 3, F.concat(F.lit("Leaf "), "clause_id", F.lit("! More."))).otherwise(F.concat(F.lit("Clause "), "clause_id")))
    return generate.summaries(c.withColumn("parent_id", ids.parent_id(F.col("clause_id"), F.col("level"))))


@query(f"""WITH {fx.TREE_SQL}, n AS (SELECT t.id, t.w, coalesce(string_agg(c.id || '()', ',' ORDER BY c.id), '') AS kids FROM tree t LEFT JOIN tree c ON regexp_replace(c.id, '\\.[^.]*$', '') = t.id AND c.w = 3 AND t.w = 2 GROUP BY t.id, t.w),
r AS (SELECT t.id, string_agg(n.id || '(' || n.kids || ')', ',' ORDER BY n.id) AS kids FROM tree t LEFT JOIN n ON regexp_replace(n.id, '\\.[^.]*$', '') = t.id AND n.w = 2 WHERE t.w = 1 GROUP BY t.id)
SELECT id AS clause_id, md5(id || '(' || kids || ')') AS result FROM n WHERE w > 1 UNION ALL SELECT id, md5(id || '(' || coalesce(kids, '') || ')') FROM r""")
def folded_trees(s: SparkSession, d: str) -> DataFrame:
    c = fx.clause_tree(s, d).select(F.col("id").alias("clause_id"), ids.depth(F.col("id")).alias("level"), F.col("id").alias("ord"), F.col("id").alias("value"))
    done = tree.fold_up(c.withColumn("parent_id", ids.parent_path(F.col("clause_id"))), lambda v, kids: F.concat(v, F.lit("("), F.array_join(kids, ","), F.lit(")")))
    return done.select("clause_id", F.md5("result").alias("result"))


# --- tree, sinks ------------------------------------------------------------------------------------------------------
@query(f"WITH {fx.TREE_SQL} SELECT DISTINCT string_split(id, '.')[1] AS series FROM tree WHERE w = 3")
def listed_documents(s: SparkSession, d: str) -> DataFrame:
    return tree.documents(fx.clause_tree(s, d).select(F.when(F.col("w") == 3, F.substring_index("id", ".", 1)).alias("series")))


@query(f"WITH {fx.TREE_SQL}, k AS (SELECT id, string_split(id, '.') AS x FROM tree) SELECT id AS clause_id, row_number() OVER (ORDER BY x[1], coalesce(CAST(x[2] AS INTEGER), -1), coalesce(CAST(x[3] AS INTEGER), -1)) AS place FROM k")
def traversal_order(s: SparkSession, d: str) -> DataFrame:
    rows = tree.traverse(fx.clause_tree(s, d), "id").select(F.col("id").alias("clause_id"), "dfs_key")
    # a running number for the comparison only; a traversal is sorted by its key, not numbered in one task
    at = F.aggregate("dfs_key", F.lit(""), lambda a, x: F.concat(a, F.lpad(F.when(x["n"] < 2**31 - 1, x["n"].cast("string")).otherwise(x["s"]), 8, "0"), F.lit("/")))
    from pyspark.sql import Window

    return rows.select("clause_id", F.row_number().over(Window.orderBy(at)).cast("long").alias("place"))


@query(f"WITH {fx.TREE_SQL} SELECT regexp_replace(id, '\\.[^.]*$', '') || ';' || id AS line FROM tree WHERE contains(id, '.')")
def edge_lines(s: SparkSession, d: str) -> DataFrame:
    c = fx.clause_tree(s, d).select(F.col("id").alias("clause_id"), (ids.depth(F.col("id")) + 1).alias("level"))
    return sinks.edge_dump(tree.attach(c)[0])


@query("SELECT 'P' || p_partkey AS clause_id, repeat('#', 1 + p_size % 3) || ' P' || p_partkey || ' ' || p_name || chr(10) || chr(10) || p_type || chr(10) || p_brand AS body FROM part")
def printed_texts(s: SparkSession, d: str) -> DataFrame:
    return sinks.text_print(fx.table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("clause_id"), (1 + F.col("p_size") % 3).alias("level"), F.col("p_name").alias("heading"), F.array("p_type", "p_brand").alias("text")))


@query("SELECT 'P' || p_partkey AS clause_id, '{\"clause_id\":\"P' || p_partkey || '\",\"size\":' || p_size || ',\"title\":\"' || p_name || '\"}' AS body FROM part")
def json_bodies(s: SparkSession, d: str) -> DataFrame:
    return sinks.json_rows(fx.table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("clause_id"), F.col("p_size").alias("size"), F.col("p_name").alias("title")))


@query(f"""SELECT id AS clause_id, id || ';' || CASE WHEN listed THEN name ELSE 'Gen' END || ';' || CASE WHEN listed THEN substr('ucxrotsma', k + 1, 1) ELSE upper(substr('ucxrotsma', k + 1, 1)) END || ';' ||
  CASE k WHEN 0 THEN '(215,95,0,255)' WHEN 1 THEN '(215,95,0,255)' WHEN 2 THEN '(215,0,0,255)' WHEN 3 THEN '(215,135,255,255)' WHEN 4 THEN '(215,215,0,255)' WHEN 5 THEN '(135,135,255,255)' WHEN 6 THEN '(95,135,0,255)' WHEN 7 THEN '(255,255,0,255)' ELSE '' END ||
  ';(' || z || ',' || z || ',' || z || ')' AS line FROM (SELECT 'P' || p_partkey AS id, p_name AS name, p_size % 9 AS k, p_size % 2 = 0 AS listed, CASE WHEN p_size > 4 THEN CAST(CAST(p_size AS DOUBLE) / 4 AS VARCHAR) ELSE '1' END AS z FROM part)""")
def node_rows(s: SparkSession, d: str) -> DataFrame:
    alt = F.array(F.struct(F.lit("Gen").alias("heading"), F.lit("generated").alias("status"), F.lit("m").alias("source")))
    kind = F.expr("substring('ucxrotsma', p_size % 9 + 1, 1)")
    c = fx.table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("clause_id"), kind.alias("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("TOC").alias("display"), alt.alias("alternatives"), (F.col("p_size") / 4).alias("resonance"))
    return sinks.node_dump(c)


@query("SELECT 'R' || n_regionkey AS parent, 'Q' || n_regionkey AS peer_parent, md5('| Clause | Score | RevScore | Peer |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ' | ' || (n_nationkey + 0.5) || ' | 0.25 | ' || n_name || ' |', chr(10) ORDER BY n_nationkey)) AS body_md5 FROM nation GROUP BY n_regionkey")
def cluster_tables(s: SparkSession, d: str) -> DataFrame:
    rows = fx.table(s, d, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.concat(F.lit("Q"), "n_regionkey").alias("peer_parent"), F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("member"), F.col("n_name").alias("peer"), (F.col("n_nationkey") + F.lit(0.5).cast("double")).alias("score"), F.lit(0.25).cast("double").alias("revscore"))
    return sinks.cluster_report(rows).select("parent", "peer_parent", F.md5("body").alias("body_md5"))


# --- vectors, relations, links ----------------------------------------------------------------------------------------
@query("SELECT 'P' || p_partkey AS clause_id, 'S' AS series, 'r' AS type, p_name AS heading, p_type || ' ' || p_brand AS text FROM part")
def ingested_documents(s: SparkSession, d: str) -> DataFrame:
    return vectors.documents(fx.table(s, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("clause_id"), F.lit("S").alias("series"), F.lit("r").alias("type"), F.col("p_name").alias("heading"), F.array(F.concat("p_type", F.lit("\0")), "p_brand").alias("text")))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END AS score, CASE WHEN p_size % 3 = 0 THEN '-' ELSE p_name END AS doc_id FROM part")
def retrieved_chunks(s: SparkSession, d: str) -> DataFrame:
    return vectors.chunks(fx.table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 1, F.col("p_size").cast("double")).alias("score"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("doc_id")))


@query(f"""WITH {_FUSED}, own AS (SELECT clause_id FROM k WHERE domain = own AND rk = 1 AND clause_id = peer_id), done AS (SELECT DISTINCT clause_id, (domain + 1) % 3 AS domain FROM sv WHERE vec_id % 5 = 0),
q AS (SELECT *, row_number() OVER (PARTITION BY clause_id, domain ORDER BY score DESC, peer_id) AS r FROM p WHERE domain <> own AND clause_id IN (SELECT clause_id FROM own) AND (clause_id, domain) NOT IN (SELECT (clause_id, domain) FROM done))
SELECT clause_id AS src, peer_id AS dst, score FROM q WHERE r <= 3""")
def relations_by_rule(s: SparkSession, d: str) -> DataFrame:
    peers = _peers(s, d)
    done = fx.sentence_vectors(s, d).filter("vec_id % 5 = 0").select("clause_id", ((F.col("domain") + 1) % 3).alias("domain"))
    return relations.relate(peers, relations.self_identification(peers), done)


@query("SELECT 's' || (s_suppkey % 10) AS src, 'd' || (s_suppkey % 3) AS dst, CAST(arg_max(s_suppkey * 2, s_suppkey) AS DOUBLE) AS score FROM supplier GROUP BY ALL")
def memorized_relations(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return relations.memorized(fx.table(s, d, "supplier").select(F.concat(F.lit("s"), k % 10).alias("src"), F.concat(F.lit("d"), k % 3).alias("dst"), (k * 2).cast("double").alias("score"), k.alias("line_no")))


@query(f"WITH {_FUSED}, m AS (SELECT parent, peer_parent, unnest(members) AS src FROM cl) SELECT m.src AS member, m.peer_parent, arg_max(dst, (score, dst)) AS peer, max(score) AS score FROM (SELECT DISTINCT src, peer_parent FROM m) m JOIN par USING (src, peer_parent) GROUP BY ALL")
def cluster_scores(s: SparkSession, d: str) -> DataFrame:
    rel = _relations(s, d)
    return relations.cluster_scores(relations.clusters(rel, _domains(s, d), 3), rel)


_CONTEXTS = "SELECT 'R' || n_regionkey AS first, 'Q' || n_regionkey AS second, n_nationkey AS k, n_name FROM nation"


@query(f"""SELECT first, second, md5(string_agg('Head' || chr(10) || n_name, chr(10) || chr(10) ORDER BY 'A' || lpad(CAST(k AS VARCHAR), 2, '0'))) AS first_md5, md5(string_agg('Head' || chr(10) || lower(n_name), chr(10) || chr(10) ORDER BY 'B' || lpad(CAST(k AS VARCHAR), 2, '0'))) AS second_md5 FROM ({_CONTEXTS}) GROUP BY ALL""")
def cluster_contexts(s: SparkSession, d: str) -> DataFrame:
    n, two = fx.table(s, d, "nation"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    first, second, member, peer = F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("Q"), "n_regionkey"), F.concat(F.lit("A"), two), F.concat(F.lit("B"), two)
    rows = n.select(first.alias("parent"), second.alias("peer_parent"), member.alias("member"), peer.alias("peer"))
    known = n.select(member.alias("clause_id"), F.lit("Head").alias("heading"), F.col("n_name").alias("text")).unionByName(n.select(peer.alias("clause_id"), F.lit("Head").alias("heading"), F.lower("n_name").alias("text")))
    told = relations.contexts(n.select(first.alias("first"), second.alias("second")).distinct(), rows, known)
    return told.select("first", "second", F.md5("first_text").alias("first_md5"), F.md5("second_text").alias("second_md5"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'pattern' WHEN 1 THEN 'file' ELSE 'invalid' END AS kind FROM part")
def reference_kinds(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    return links.reference_kinds(fx.table(s, d, "part").select("p_partkey", F.when(k == 0, F.col("p_name")).alias("pattern"), F.when(k < 2, F.lit("a/b")).alias("path"))).select("p_partkey", "kind")
