"""Queries of the note graph, entities, verification, memory, evaluation and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators import budget, documents, entities, evaluate, extraction, graph, memory, ranking, verify
from paperlake.operators.common import kept, micro, small, top
from paperlake.plans.tables import query, rows, table, texts, values

# entities and relations in the table of parts: a name's spelling, type and relation follow from
# its row, and so do batches
TYPES = [*entities.ENTITY_TYPES, "Author"]
KINDS = [*entities.RELATION_TYPES, "Cites"]
POLICY = {"red widget": "Crimson Widget"}
DULL = ["small ring", *entities.GENERIC]
PART_ENTITIES = f"(SELECT p_size AS batch, p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN upper(replace(p_name, ' ', '-')) ELSE p_name END AS name, {TYPES}[1 + p_partkey % {len(TYPES)}] AS type FROM part)"
PART_RELATIONS = f"(SELECT p_size AS batch, p_partkey AS ord, p_name AS src, {KINDS}[1 + p_partkey % {len(KINDS)}] AS rel, lead(p_name) OVER (PARTITION BY p_size ORDER BY p_partkey) AS dst, p_type || ' ' || p_brand AS ev FROM part)"


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise(F.col("p_name"))
    return p.select(F.col("p_size").alias("batch"), k.alias("ord"), name.alias("name"), F.get(F.lit(TYPES), (k % len(TYPES)).cast("int")).alias("type"))


def part_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    dst = F.lead("p_name").over(Window.partitionBy("p_size").orderBy("p_partkey"))
    return p.select(F.col("p_size").alias("batch"), k.alias("ord"), F.col("p_name").alias("src"), F.get(F.lit(KINDS), (k % len(KINDS)).cast("int")).alias("rel"), dst.alias("dst"), F.concat("p_type", F.lit(" "), "p_brand").alias("ev"))


# graph


def _conv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), (F.lead("conv_id").over(Window.partitionBy("conv_id").orderBy("turn")) * 1000 + F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).alias("dst")).where("dst is not null")


CONV = "c AS (SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations), e AS (SELECT src, dst FROM c WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM c WHERE dst IS NOT NULL)"


@query(f"""WITH {CONV}, g AS (SELECT src, count(*) AS deg FROM e GROUP BY 1), s0 AS (SELECT DISTINCT src AS node, 1.0 AS x FROM e WHERE src % 1000 = 0),
s1 AS (SELECT node, sum(x) AS x FROM (SELECT dst AS node, 0.425 * x / deg AS x FROM s0 JOIN e ON node = src JOIN g USING (src) UNION ALL SELECT node, 0.425 * x FROM s0 UNION ALL SELECT node, 0.15 * x FROM s0) GROUP BY 1),
s2 AS (SELECT node, sum(x) AS x FROM (SELECT dst AS node, 0.425 * x / deg AS x FROM s1 JOIN e ON node = src JOIN g USING (src) UNION ALL SELECT node, 0.425 * x FROM s1 UNION ALL SELECT node, 0.15 * x FROM s0) GROUP BY 1)
SELECT node, CAST(floor(x * 1e9 + 0.5) AS BIGINT) AS score_nano FROM s2""")
def note_graph_ppr2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _conv_edges(spark, sf_dir)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = both.where("src % 1000 = 0").select(F.col("src").alias("node"), F.lit(1.0).alias("seed")).distinct()
    return graph.expand(both, seeds).select("node", F.floor(F.col("score") * 1e9 + 0.5).cast("long").alias("score_nano"))


@query(f"WITH {CONV} SELECT DISTINCT dst AS node FROM e WHERE src % 1000 = 0 AND dst % 1000 <> 0")
def one_hop_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _conv_edges(spark, sf_dir)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.neighbours(both, both.where("src % 1000 = 0").select(F.col("src").alias("node")).distinct())


SHARED = """pc AS (SELECT DISTINCT s_nationkey AS paper_id, l_partkey AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49),
w AS (SELECT x.paper_id AS a, y.paper_id AS b, count(*) AS weight FROM pc x JOIN pc y ON x.c = y.c AND x.paper_id < y.paper_id GROUP BY 1, 2 HAVING count(*) >= 2)"""


def concepts_of(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Nations as papers, parts delivered as their concepts."""
    li = lineitem.select("l_partkey", "l_suppkey")
    return li.join(small(supplier.select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("paper_id"), F.col("l_partkey").cast("string").alias("concept"))


#: Both over full loads only; they test the operators on those rows. Without the filter they are
#: the queries' own.
SHARED_SQL = f"WITH {SHARED} SELECT * FROM w"
CONCEPT_PAPERS_SQL = "WITH pc AS (SELECT DISTINCT s_nationkey AS paper_id, CAST(l_partkey AS VARCHAR) AS concept FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49), n AS (SELECT concept, count(*) AS papers FROM pc GROUP BY 1 HAVING count(*) >= 2) SELECT * FROM n ORDER BY papers DESC, concept LIMIT 50"


@query(SHARED_SQL.replace(" WHERE l_quantity >= 49", ""))
def paper_shared_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shared_concepts(concepts_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")))


@query(CONCEPT_PAPERS_SQL.replace(" WHERE l_quantity >= 49", ""))
def concept_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.concept_papers(concepts_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")))


#: Components of the thinned graph only; over all rows the recursion is quadratic.
THIN_COMPONENTS_SQL = """WITH RECURSIVE o AS (SELECT DISTINCT o_custkey AS src, 1000000000 + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 50 AND l_discount >= 0.09),
e AS (SELECT src, dst FROM o UNION ALL SELECT dst, src FROM o),
r(node, root) AS (SELECT src, src FROM e UNION SELECT e.dst, r.root FROM r JOIN e ON r.node = e.src WHERE e.dst > r.root OR TRUE)
SELECT node, min(root) AS component FROM r GROUP BY 1"""


def order_edges(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_suppkey")
    e = li.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return e.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst"))


@query()
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperlake.plans.tables import ensure_checkpoints

    ensure_checkpoints(spark)
    return graph.components(order_edges(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")))


FIELD = "pc AS (SELECT DISTINCT l_suppkey % 200 AS paper_id, l_partkey AS c FROM lineitem), w AS (SELECT x.paper_id AS a, y.paper_id AS b, count(*) AS weight FROM pc x JOIN pc y ON x.c = y.c AND x.paper_id < y.paper_id GROUP BY 1, 2 HAVING count(*) >= 2)"


def _field(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Papers (groups of suppliers) and their weighted edges by common parts."""
    from paperlake.plans.tables import ensure_checkpoints

    ensure_checkpoints(spark)
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 200).alias("paper_id"), F.col("l_partkey").cast("string").alias("concept"))
    edge = graph.shared_concepts(li).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").checkpoint()
    return li.select(F.col("paper_id").alias("node")).distinct(), edge


@query()
def field_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest edges that hold papers together; sorted union-find tests it."""
    return graph.spanning_forest(_field(spark, sf_dir)[1])


@query(f"""WITH RECURSIVE {FIELD}, m AS (SELECT quantile_disc(weight, 0.9) AS m FROM w), e AS (SELECT a AS src, b AS dst FROM w, m WHERE weight >= m UNION ALL SELECT b, a FROM w, m WHERE weight >= m),
n AS (SELECT DISTINCT paper_id AS node FROM pc), r(node, root) AS (SELECT node, node FROM n UNION SELECT e.dst, r.root FROM r JOIN e ON r.node = e.src) SELECT node, min(root) AS cluster FROM r GROUP BY 1""")
def field_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers held together by the heaviest tenth of the edges, from the forest alone."""
    nodes, edge = _field(spark, sf_dir)
    least = evaluate.upper_rank(edge, "weight", 0.9).first()
    return graph.clusters(graph.spanning_forest(edge), nodes, least[0] if least else 0)


def note_links(docs: DataFrame) -> DataFrame:
    """(id, other, n, kind) of ``docs`` (doc_id, text): each copy of a text hangs on the text's
    smallest id ("copy"), and these link as notes do ("link"); n keywords are common."""
    docs = docs.select("doc_id", X.blank(F.col("text")).alias("text"))
    of = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    first = of.groupBy("h").agg(F.min("doc_id").alias("id"))
    copies = of.join(first, "h").where("doc_id <> id").select(F.col("doc_id").alias("copy"), "id")
    own = docs.join(first.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    words = own.select(F.col("doc_id").alias("id"), F.explode(X.keyword_tokens(F.col("text"))).alias("w"))
    ranked = top(words.groupBy("id", "w").agg(F.count("*").alias("n")), ["id"], [F.desc("n"), F.asc("w")], 12)
    notes = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]).alias("keywords")).checkpoint()
    k = notes.select("id", F.array_distinct(F.transform("keywords", F.lower)).alias("k"))
    pairs = graph.link_candidates(notes).join(k, "id").join(k.select(F.col("id").alias("other"), F.col("k").alias("l")), "other")
    links = top(pairs.where(graph.should_link(F.col("k"), F.col("l"))), ["id"], [F.asc("other")], 6).select("id", "other", F.size(F.array_intersect("k", "l")).alias("n"), F.lit("link").alias("kind"))
    members = copies.join(k, "id", "left").select(F.col("copy").alias("id"), F.col("id").alias("other"), F.when(F.col("k").isNull(), 0).otherwise(F.size("k")).alias("n"), F.lit("copy").alias("kind"))
    return links.unionByName(members)


@query()
def near_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all documents by the rule of notes, with its 12 candidates and 6 links from a
    note; no links to a note are dropped. SQL would repeat five operators; brute force tests it."""
    from paperlake.plans.tables import ensure_checkpoints

    ensure_checkpoints(spark)
    return note_links(table(spark, sf_dir, "documents"))


# entities


@query("""WITH w AS (SELECT source AS paper_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]{2,}|\\d+(?:\\.\\d+)?')) AS term FROM documents),
s AS (SELECT paper_id, term, count(*)::DOUBLE AS weight FROM w WHERE length(trim(term)) >= 2 AND lower(term) NOT IN (%s) GROUP BY 1, 2),
r AS (SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY weight DESC, term) AS INTEGER) AS rank, term AS concept, weight FROM s) SELECT * FROM r WHERE rank <= 18""" % ", ".join(f"'{w}'" for w in sorted({*X.STOP, *X.KEYWORD_STOP, *entities.GENERIC, *entities.GENERIC_CONCEPTS})))
def concepts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.explode(X.keyword_tokens(F.col("text"))).alias("term"))
    none = words.limit(0)
    return entities.concepts(words, none, entities.alias_table(spark))


POLICY_SQL = "al AS (SELECT * FROM " + values(sorted({**entities.ALIASES, **POLICY}.items()), "alias, canonical") + ")"
ALIAS_SQL = "al AS (SELECT * FROM " + values(sorted(entities.ALIASES.items()), "alias, canonical") + ")"


@query(f"WITH {ALIAS_SQL} SELECT p_partkey, coalesce(canonical, trim(p_brand)) AS brand FROM part LEFT JOIN (SELECT * FROM al UNION ALL VALUES ('brand#13', 'Brand-XIII'), ('brand#21', 'Brand-XXI')) ON lower(trim(p_brand)) = alias")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = entities.alias_table(spark, {"Brand#13": "Brand-XIII"}, {"brand#21": "Brand-XXI"})
    return entities.resolve(table(spark, sf_dir, "part"), a, "p_brand", "brand").select("p_partkey", "brand")


ENTITY_SQL = f"""{POLICY_SQL}, x AS {PART_ENTITIES}, y AS (SELECT x.*, coalesce(canonical, trim(name)) AS can FROM x LEFT JOIN al ON lower(trim(name)) = alias),
z AS (SELECT *, CASE WHEN type NOT IN ({', '.join(f"'{t}'" for t in entities.ENTITY_TYPES)}) THEN 'schema' WHEN lower(can) IN ({', '.join(f"'{t}'" for t in DULL)}) THEN 'generic' END AS bad, regexp_replace(lower(can), '[^a-z0-9]+', '', 'g') AS k FROM y),
ent AS (SELECT batch, ord, name, type, can AS canonical, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY batch, bad, k ORDER BY ord) > 1 THEN 'merged' ELSE 'kept' END) AS verdict, k FROM z)"""


@query(f"WITH {ENTITY_SQL} SELECT batch, ord, name, type, canonical, verdict FROM ent")
def entity_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.sanitize_entities(part_entities(spark, sf_dir), entities.alias_table(spark, POLICY), DULL)


@query(f"""WITH {ENTITY_SQL}, r AS {PART_RELATIONS},
q AS (SELECT r.batch, r.ord, a.canonical AS src, rel, b.canonical AS dst, ev FROM r LEFT JOIN al s ON lower(trim(src)) = s.alias LEFT JOIN al t ON lower(trim(dst)) = t.alias
 JOIN ent a ON a.batch = r.batch AND a.verdict = 'kept' AND a.k = regexp_replace(lower(coalesce(s.canonical, trim(src))), '[^a-z0-9]+', '', 'g') JOIN ent b ON b.batch = r.batch AND b.verdict = 'kept' AND b.k = regexp_replace(lower(coalesce(t.canonical, trim(dst))), '[^a-z0-9]+', '', 'g') WHERE rel IN ({', '.join(f"'{t}'" for t in entities.RELATION_TYPES)}))
SELECT batch, src, rel, dst, arg_min(ev, ord) AS ev FROM q GROUP BY 1, 2, 3, 4""")
def relation_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = entities.alias_table(spark, POLICY)
    return entities.sanitize_relations(part_relations(spark, sf_dir), entities.sanitize_entities(part_entities(spark, sf_dir), a, DULL), a)


@query("""WITH r AS (VALUES ('the', 'tion'), ('le', 'la'), ('der', 'zebra'), ('of', 'and')) SELECT doc_id AS draft_id, col0 AS src, col1 AS dst FROM documents, r WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || col0 || '($|[^a-z0-9])') AND regexp_matches(lower(text), '(^|[^a-z0-9])' || col1 || '($|[^a-z0-9])')""")
def contradiction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = rows(spark, [("the", "tion", "Contradicts"), ("le", "la", "Contradicts"), ("der", "zebra", "Contradicts"), ("of", "and", "Contradicts"), ("of", "the", "Requires")], "src string, dst string, rel string")
    return entities.contradictions(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("draft_id"), "text"), rel)


#: Frequent words of the documents as names, and what hints at a relation in their sentences.
WORDS = [("the", "Algorithm/Model"), ("tion", "Problem/Task"), ("of", "Algorithm/Model"), ("der", "Dataset/Benchmark"), ("die", "Evaluation Metric"), ("de", "Algorithm/Model"), ("la", "Problem/Task"), ("que", "Evaluation Metric"), ("on", "Theoretical Component")]
SIGNS = [("Improves_Upon", "ingly|lichkeit"), ("Evaluated_On", "ción|eaux"), ("Requires", "ing|lich|ado")]


def _said(words: list[tuple[str, str]]):
    """An extractor that finds words between blanks; of some texts its first answer, and of some
    each answer, breaks the rules."""

    def extract(text: str, attempt: int) -> dict:
        has = set(text.lower().split(" "))
        names = [(w, t) for w, t in words if w in has]
        found = [{"name": w, "type": t} for w, t in names]
        if len(text) % 5 == 0 and attempt == 0 or len(text) % 7 == 0:
            found.append({"name": "?", "type": "Author"})
        return {"entities": found, "relations": [{"from": a, "rel": "Requires", "to": b} for (a, _), (b, _) in zip(names, names[1:])]}

    return extract


EXTRACTED = f"""w AS (SELECT * FROM {values([(i, *w) for i, w in enumerate(WORDS)], 'o, name, type')}), t AS (SELECT doc_id, source, left(coalesce(text, ''), 15000) AS t FROM documents),
f AS (SELECT doc_id, source, o, name, type, length(t) AS n FROM t, w WHERE list_contains(string_split(lower(t), ' '), name)),
g AS (SELECT doc_id, count(*) AS k FROM f GROUP BY 1), s AS (SELECT doc_id, CASE WHEN k IS NULL AND length(t) % 5 <> 0 AND length(t) % 7 <> 0 THEN 'MANUAL_REVIEW' WHEN length(t) % 7 = 0 OR k IS NULL THEN 'MANUAL_REVIEW' WHEN length(t) % 5 = 0 THEN 'RETRY_ACCEPTED' ELSE 'ACCEPTED' END AS status FROM t LEFT JOIN g USING (doc_id))"""


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = texts(spark, sf_dir).select("doc_id", F.lit(1).alias("ord"), "text")
    return extraction.extracted(parts, _said(WORDS), "doc_id")


@query(f"""WITH {EXTRACTED} SELECT doc_id, status, CASE WHEN status = 'MANUAL_REVIEW' THEN 0 ELSE k END AS entities, CASE WHEN status = 'MANUAL_REVIEW' THEN 0 ELSE k - 1 END AS relations FROM s LEFT JOIN g USING (doc_id)""")
def extracted_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table function extracts from documents; answers are taken or refused as a whole."""
    return _extracted(spark, sf_dir).groupBy("doc_id", "status").agg(F.count_if(F.col("kind") == "entity").alias("entities"), F.count_if(F.col("kind") == "relation").alias("relations"))


@query(f"""WITH {EXTRACTED}, b AS (SELECT source AS paper_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]{{2,}}|\\d+(?:\\.\\d+)?')) AS term, 1.0 AS w FROM documents),
m AS (SELECT paper_id, term, w FROM b WHERE lower(term) NOT IN ({', '.join(f"'{w}'" for w in sorted({*X.STOP, *X.KEYWORD_STOP}))}) UNION ALL SELECT source, name, 3.0 FROM f JOIN s USING (doc_id) WHERE status <> 'MANUAL_REVIEW'),
c AS (SELECT paper_id, term AS concept, sum(w)::DOUBLE AS weight FROM m WHERE length(trim(term)) >= 2 AND lower(term) NOT IN ({', '.join(f"'{w}'" for w in sorted({*entities.GENERIC, *entities.GENERIC_CONCEPTS}))}) GROUP BY 1, 2),
r AS (SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY weight DESC, concept) AS INTEGER) AS rank, concept, weight FROM c) SELECT * FROM r WHERE rank <= 18""")
def remembered_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of sources: keywords count 1, entities that were extracted 3."""
    docs = texts(spark, sf_dir)
    words = docs.select(F.col("source").alias("paper_id"), F.explode(X.keyword_tokens(F.col("text"))).alias("term"))
    found, _ = extraction.items_of(_extracted(spark, sf_dir), "doc_id")
    memory_ = found.join(docs.select(F.col("doc_id").alias("batch"), F.col("source").alias("paper_id")), "batch").select("paper_id", F.col("name").alias("term"))
    return entities.concepts(words, memory_, entities.alias_table(spark))


@query()
def merged_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of the documents of a source as names, merged at a similarity of .6; the plain
    fold tests it."""
    line = F.left(F.split_part(X.blank(F.col("text")), F.lit("\n"), F.lit(1)), F.lit(80))
    names = texts(spark, sf_dir).select(F.col("source").alias("batch"), F.col("doc_id").alias("ord"), line.alias("canonical")).where("batch is not null")
    return entities.merge_similar(names, 0.6)


@query()
def rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the sentences of all documents; a plain loop tests it, as lookbehind keeps it
    from DuckDB's expressions."""
    return entities.rule_relations(texts(spark, sf_dir), "doc_id", names=WORDS, hints=SIGNS)


# verification

# drafts are documents with citations where sentences end; sections and items come from ids and
# lengths, the cited works from the sources, some of them in capitals
DRAFTS = """(SELECT doc_id AS draft_id, CASE WHEN doc_id % 10 = 1 THEN replace(t, ', ', ' [Ref: ' || s || ', Sec ' || n || ', Fig ' || f % 4 || '], ') ELSE t END AS text
FROM (SELECT doc_id, s, n, f, replace(replace(text, '.' || chr(10), ' 【Ref：' || s || '，Fig ' || f % 3 || '】.' || chr(10)), '. ', ' [Ref: ' || s || ', Sec ' || n || ']. ') AS t
FROM (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN upper(source) ELSE source END AS s, doc_id % 5 AS n, n_chars AS f FROM documents)))"""
TRUTH = "(SELECT DISTINCT source || '_' || doc_id % 4 AS key FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT source || '_fig' || n_chars % 3 FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL)"
FIGURES = "(SELECT DISTINCT source || '_' || doc_id % 4 AS seckey, 'fig' || n_chars % 3 AS item FROM documents WHERE n_chars % 3 < 2 AND source NOT LIKE '%9')"
CIT_SQL = r"""dr AS (SELECT * FROM %s), ct AS (SELECT draft_id, unnest(range(0, len(c0))) AS no, c0, c1, c2 FROM (SELECT draft_id, regexp_extract_all(text, '(?i)[\[【]\s*ref\s*[:：]\s*([^,\]】，]+?)\s*[,，]\s*([^\]】]+?)\s*[\]】]', 0) AS c0, regexp_extract_all(text, '(?i)[\[【]\s*ref\s*[:：]\s*([^,\]】，]+?)\s*[,，]\s*([^\]】]+?)\s*[\]】]', 1) AS c1, regexp_extract_all(text, '(?i)[\[【]\s*ref\s*[:：]\s*([^,\]】，]+?)\s*[,，]\s*([^\]】]+?)\s*[\]】]', 2) AS c2 FROM dr)),
cx AS (SELECT draft_id, CAST(no AS INTEGER) AS no, c0[no + 1] AS citation, c1[no + 1] AS ref, list_transform(string_split_regex(c2[no + 1], '[,，]'), lambda p: trim(p)) AS parts FROM ct),
cy AS (SELECT draft_id, no, citation, ref, list_filter(parts, lambda p: NOT regexp_matches(p, '(?i)^(fig|tab)')) AS ss, list_transform(list_filter(parts, lambda p: regexp_matches(p, '(?i)^(fig|tab)')), lambda p: lower(left(p, 3)) || regexp_extract(p, '\d+')) AS items FROM cx),
cz AS (SELECT draft_id, no, citation, ref, CASE WHEN len(ss) > 0 THEN regexp_replace(ss[-1], '(?i)^sec\s*', '') END AS sec, items[1] AS item, (len(items) >= 2 OR len(ss) >= 2) AS many FROM cy)""" % DRAFTS


def cited_drafts(docs: DataFrame) -> DataFrame:
    i, f = F.col("doc_id"), F.col("n_chars")
    who = F.when(i % 7 == 0, F.upper("source")).otherwise(F.col("source"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    t = F.replace("text", F.lit(".\n"), said(" 【Ref：", who, "，Fig ", f % 3, "】.\n"))
    t = F.replace(t, F.lit(". "), said(" [Ref: ", who, ", Sec ", i % 5, "]. "))
    t = F.when(i % 10 == 1, F.replace(t, F.lit(", "), said(" [Ref: ", who, ", Sec ", i % 5, ", Fig ", f % 4, "], "))).otherwise(t)
    return docs.select(i.alias("draft_id"), t.alias("text"))


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    drafts = cited_drafts(texts(spark, sf_dir))
    return drafts, verify.citations(drafts)


@query(f"WITH {CIT_SQL} SELECT * FROM cz")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir)[1].select("draft_id", "no", "citation", "ref", "sec", "item", "many")


GATE_SQL = f"""{CIT_SQL}, tr AS (SELECT * FROM {TRUTH}), fg AS (SELECT *, regexp_replace(lower(seckey), '_[^_]*$', '') AS paper FROM {FIGURES}),
ck AS (SELECT *, CASE WHEN sec IS NOT NULL THEN ref || '_' || sec ELSE ref || '_' || item END AS k FROM cz),
cr AS (SELECT draft_id, no, citation, CASE WHEN many THEN 'UNVERIFIED' WHEN k IS NULL THEN 'UNVERIFIED' WHEN lower(k) NOT IN (SELECT lower(key) FROM tr) THEN 'UNVERIFIED' WHEN k NOT IN (SELECT key FROM tr) THEN 'NEEDS_REVIEW'
 WHEN sec IS NOT NULL AND item IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fg WHERE lower(seckey) = lower(k) AND fg.item = ck.item) THEN 'UNVERIFIED' WHEN sec IS NULL AND lower(ref) NOT IN (SELECT paper FROM fg) THEN 'NEEDS_REVIEW'
 WHEN sec IS NULL AND NOT EXISTS (SELECT 1 FROM fg WHERE fg.paper = lower(ck.ref) AND fg.item = ck.item) THEN 'UNVERIFIED' ELSE 'PASS' END AS status FROM ck)"""


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    drafts, cited = _cited(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").where("source is not null")
    place = lambda kind, n: F.concat("source", F.lit(kind), n.cast("string"))
    sections = docs.select(place("_", F.col("doc_id") % 4).alias("key")).union(docs.where("n_chars is not null").select(place("_fig", F.col("n_chars") % 3))).distinct()
    items = docs.where("n_chars % 3 < 2 and source not like '%9'").select(place("_", F.col("doc_id") % 4).alias("seckey"), F.concat(F.lit("fig"), (F.col("n_chars") % 3).cast("string")).alias("item")).distinct()
    found = verify.existence(cited, sections.select("key", F.col("key").alias("text")), items)
    return drafts, verify.banded(found.withColumn("score", F.lit(0.9)), "score")


@query(f"WITH {GATE_SQL} SELECT draft_id, no, status FROM cr")
def citation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir)[1].select("draft_id", "no", "status")


@query(f"""WITH {GATE_SQL}, du AS (SELECT draft_id, count(*) AS k FROM (SELECT draft_id, citation FROM cr GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT dr.draft_id, CASE WHEN count(status) = 0 THEN 'NO_CITATION' WHEN bool_or(status = 'UNVERIFIED') THEN 'DIRTY' WHEN bool_or(status = 'NEEDS_REVIEW') THEN 'NEEDS_REVIEW' ELSE 'CLEAN' END AS status, count(status) AS n, coalesce(any_value(k), 0) AS duplicates FROM dr LEFT JOIN cr USING (draft_id) LEFT JOIN du USING (draft_id) GROUP BY 1""")
def citation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts, rows_ = _gated(spark, sf_dir)
    return verify.draft_status(drafts, kept(rows_.select("draft_id", "citation", "status"), "gated"))


@query("SELECT verdict_id, bool_and(coalesce(length(quote) >= 12 AND contains(e.text, quote), FALSE)) AS valid FROM (SELECT doc_id // 3 AS verdict_id, doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS evidence_id, substr(text, 5, 10 + doc_id % 7) AS quote FROM documents) q LEFT JOIN documents e ON e.doc_id = q.evidence_id GROUP BY 1")
def quote_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents as quotes; every fifth names the next document."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    quotes = docs.select(F.floor(i / 3).alias("verdict_id"), (i + F.when(i % 5 == 0, 1).otherwise(0)).alias("evidence_id"), F.substring("text", F.lit(5), (10 + i % 7).cast("int")).alias("quote"))
    return verify.quotes_hold(quotes, docs.select(i.alias("evidence_id"), "text"))


#: The claims against the documents whose ids are divisible by 50: a part of the query's rows.
SUPPORT_SQL = """WITH k AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]{2,}|\\d+(?:\\.\\d+)?')) AS t FROM benchmark), f AS (SELECT item_id, t, count(*) AS n FROM k WHERE lower(t) NOT IN (%s) GROUP BY 1, 2),
r AS (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, t) AS r FROM f), g AS (SELECT item_id, doc_id, count(*) AS n, count(CASE WHEN contains(lower(text), lower(t)) THEN 1 END) AS h FROM r, documents WHERE r <= 8 AND doc_id %% 50 = 0 GROUP BY 1, 2)
SELECT item_id, doc_id, coalesce(h >= 0.34 * n, FALSE) AS supported FROM (SELECT item_id, doc_id FROM benchmark, documents WHERE doc_id %% 50 = 0) LEFT JOIN g USING (item_id, doc_id)""" % ", ".join(f"'{w}'" for w in [*X.STOP, *X.KEYWORD_STOP])


@query(SUPPORT_SQL.replace(" AND doc_id % 50 = 0", "").replace(" WHERE doc_id % 50 = 0", ""))
def claim_lexical_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All claims against all documents, a stated set in blocks."""
    docs = texts(spark, sf_dir).select("doc_id", F.col("text").alias("context"))
    return verify.supported(docs, table(spark, sf_dir, "benchmark").select("item_id", verify.support_words(F.col("text")).alias("words")))


# memory


@query("SELECT count(*) AS notes, count(DISTINCT conv_id) AS papers, count(CASE WHEN role = 'user' THEN 1 END) AS active, count(CASE WHEN role = 'assistant' THEN 1 END) AS candidate, 0::BIGINT AS contested, 0::BIGINT AS rejected, count(CASE WHEN role NOT IN ('user', 'assistant') THEN 1 END) AS superseded FROM conversations")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("role") == "user", "active").when(F.col("role") == "assistant", "candidate").otherwise("superseded")
    return memory.statistics(table(spark, sf_dir, "conversations").withColumn("status", status), "conv_id")


@query("SELECT id, kept FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY source, lang, left(text, 160)) AS kept, count(*) OVER (PARTITION BY source, lang, left(text, 160)) AS n FROM documents) WHERE n > 1")
def consolidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("paper_id"), F.col("lang").alias("kind"), F.col("text").alias("content"))
    return memory.consolidated(notes)


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.latest_status(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orphan_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.orphans(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_orderkey")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS)")
def review_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    last = e.agg(F.max("ts").alias("last"))
    recent = e.crossJoin(F.broadcast(last)).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 24 HOURS")).select("user_id")
    return e.select("user_id").distinct().join(recent, "user_id", "left_anti")


@query("SELECT event_type AS term, CAST(floor(least(3.0, 1.0 + 0.3 * count(*)) * pow(0.5, greatest(0.0, (1800000000.0 - epoch(max(ts))) / 86400.0) / 30.0) * 1e6 + 0.5) AS BIGINT) AS weight_micro FROM events GROUP BY 1")
def preference_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ranking.preferences(table(spark, sf_dir, "events").select(F.col("event_type").alias("term"), "ts"))
    seen = F.unix_micros(F.col("updated").cast("timestamp")) / 1e6
    return p.select("term", micro(ranking.decayed(F.col("weight"), seen, F.lit(1_800_000_000.0))).alias("weight_micro"))


@query("SELECT user_id, max(ts) AS last_access, count(*) AS access_count FROM events GROUP BY 1")
def access_reinforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.touched(table(spark, sf_dir, "events"), "user_id", "ts")


# evaluation and budgets


@query("""WITH s AS (SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL), r AS (SELECT y, avg(r) OVER (PARTITION BY s) AS r FROM (SELECT s, y, row_number() OVER (ORDER BY s) AS r FROM s))
SELECT sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives, CAST(floor((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) * 1e6 + 0.5) AS BIGINT) AS auc_micro FROM r""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    a = evaluate.roc_auc(s)
    return a.select("positives", "negatives", micro(F.col("auc")).alias("auc_micro"))


@query("""WITH s AS (SELECT least(1.0, (n_chars % 1000) / 1000.0 * 0.5 + quality * 0.5) AS s, quality AS y FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
t AS (SELECT DISTINCT s AS t FROM s UNION SELECT 1.0), m AS (SELECT t, count(CASE WHEN s >= t AND y = 1 THEN 1 END) / (SELECT count(*) FROM s WHERE y = 1)::DOUBLE AS recall, count(CASE WHEN s >= t AND y = 0 THEN 1 END) / (SELECT count(*) FROM s WHERE y = 0)::DOUBLE AS fpr FROM t, s GROUP BY 1)
SELECT CAST(floor(t * 1e6 + 0.5) AS BIGINT) AS pass_micro, CAST(floor(recall * 1e6 + 0.5) AS BIGINT) AS recall_micro, CAST(floor(fpr * 1e6 + 0.5) AS BIGINT) AS fpr_micro FROM m WHERE fpr <= 0.05 ORDER BY recall DESC, fpr, t LIMIT 1""")
def calibrate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id")
    s = s.select(F.least(F.lit(1.0), (F.col("n_chars") % 1000) / 1000.0 * 0.5 + F.col("quality") * 0.5).alias("score"), F.col("quality").alias("label"))
    return evaluate.calibrate(s).select(micro(F.col("pass_th")).alias("pass_micro"), micro(F.col("recall")).alias("recall_micro"), micro(F.col("fpr")).alias("fpr_micro"))


ASCII = "regexp_replace(left(text, 200), '[^ -~]', '', 'g')"


#: Scores of the first 200 characters, which are the query's where no text is longer.
PREFIX_SCORE_SQL = f"SELECT a.item_id, CAST(floor(greatest(0.0, 1 - levenshtein(a.t, b.t) / length(a.t)::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS score_micro FROM (SELECT item_id, {ASCII} AS t FROM benchmark) a JOIN (SELECT item_id - 1 AS item_id, {ASCII} AS t FROM benchmark) b USING (item_id)"


@query()
def levenshtein_text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, their white space made single; DuckDB's distance counts bytes."""
    t = table(spark, sf_dir, "benchmark").select("item_id", X.normal_text(F.col("text")).alias("t"))
    return t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u")), "item_id").select("item_id", micro(X.text_score(F.col("t"), F.col("u"))).alias("score_micro"))


CELLS = """(SELECT l_orderkey AS table_id, l_linenumber AS r, 0 AS c, CAST(l_returnflag AS VARCHAR) AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM lineitem)""", """(SELECT l_orderkey AS table_id, l_linenumber AS r, 0 AS c, ' ' || CASE WHEN l_partkey % 5 = 0 THEN l_linestatus ELSE l_returnflag END AS value FROM lineitem WHERE l_suppkey % 11 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, 1 + CAST(l_suppkey % 13 = 0 AS INTEGER), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) FROM lineitem)"""


@query(f"SELECT table_id, avg(CASE WHEN trim(g.value) = trim(f.value) THEN 1.0 ELSE 0.0 END) AS score FROM {CELLS[0]} g FULL JOIN {CELLS[1]} f USING (table_id, r, c) GROUP BY 1")
def table_cell_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables; what was found lacks cells, has others and some in a wrong column."""
    li, s = table(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    cell = lambda rows, col, value: rows.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), col.alias("col"), value.alias("value"))
    amount = F.col("l_quantity").cast("int").cast("string")
    gold = cell(li, F.lit(0), F.col("l_returnflag")).union(cell(li, F.lit(1), amount))
    flag = F.concat(F.lit(" "), F.when(F.col("l_partkey") % 5 == 0, F.col("l_linestatus")).otherwise(F.col("l_returnflag")))
    return evaluate.cell_scores(gold, cell(li.where(s % 11 != 0), F.lit(0), flag).union(cell(li, 1 + (s % 13 == 0).cast("int"), amount)))


@query("""WITH g AS (SELECT p_partkey % 60 AS m, min(p_brand) AS c FROM part GROUP BY 1), f AS (SELECT p_partkey % 60 AS m, max(p_brand) AS c FROM part GROUP BY 1)
SELECT count(*) AS cases, CAST(floor(avg(CASE WHEN g.c = f.c THEN 1.0 ELSE 0.0 END) * 1e6 + 0.5) AS BIGINT) AS accuracy_micro, 0::BIGINT AS outside, avg(CASE WHEN g.c = f.c THEN 1.0 ELSE 0.0 END) >= 0.97 AND count(*) >= 50 AS passed FROM g JOIN f USING (m)""")
def alias_accuracy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 60).alias("mention")).agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b"))
    kind = F.lit("Algorithm/Model").alias("type")
    r = evaluate.alias_gate(g.select("mention", F.col("a").alias("canonical"), kind), g.select("mention", F.col("b").alias("canonical"), kind), entities.GENERIC, entities.ENTITY_TYPES)
    return r.select("cases", micro(F.col("accuracy")).alias("accuracy_micro"), "outside", "passed")


@query("""WITH x AS (SELECT doc_id, toxic = 1 AS e, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality = 0 END AS f FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL), y AS (SELECT count(CASE WHEN e THEN 1 END) AS positives, count(CASE WHEN NOT e THEN 1 END) AS negatives, count(CASE WHEN e AND coalesce(f, NOT e) THEN 1 END) AS tp, count(CASE WHEN NOT e AND coalesce(f, NOT e) THEN 1 END) AS fp FROM x)
SELECT positives, negatives, CAST(floor(tp / positives::DOUBLE * 1e6 + 0.5) AS BIGINT) AS recall_micro, CAST(floor(fp / negatives::DOUBLE * 1e6 + 0.5) AS BIGINT) AS fpr_micro, positives >= 20 AND negatives >= 10 AND tp / positives::DOUBLE >= 0.9 AND fp / negatives::DOUBLE <= 0.1 AS passed FROM y""")
def contradiction_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").where("toxic is not null and quality is not null")
    r = evaluate.flag_gate(lab.select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("expected")), lab.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("flagged")))
    return r.select("positives", "negatives", micro(F.col("recall")).alias("recall_micro"), micro(F.col("fpr")).alias("fpr_micro"), "passed")


@query("""WITH t AS (SELECT source AS run_id, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 3.5) AS INTEGER)) END) AS total FROM documents GROUP BY 1)
SELECT run_id, CAST(total AS BIGINT) AS total, total <= 12000 AS passed FROM t""")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), F.lit("read").alias("stage"), F.lit("text").alias("kind"), X.estimated_tokens(F.col("text")).cast("long").alias("tokens"), F.lit(False).alias("cached"))
    return budget.check(usage).select("run_id", "total", "passed")


@query("SELECT doc_id, sha256(text) AS source_sha256 FROM documents WHERE doc_id % 3 <> 0")
def run_signature_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that no earlier run (ids divisible by three, here) has with equal content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_sha256"))
    return budget.to_run(docs, docs.where("doc_id % 3 = 0"), ["doc_id", "source_sha256"])


@query("""WITH v AS (SELECT user_id AS key, event_id AS ts, event_type AS content FROM events), n AS (SELECT key, ts, sha256(content) AS content_sha FROM v QUALIFY lag(content) OVER (PARTITION BY key ORDER BY ts) IS DISTINCT FROM content)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY ts) AS INTEGER) AS version, CAST(nullif(row_number() OVER (PARTITION BY key ORDER BY ts) - 1, 0) AS INTEGER) AS parent, content_sha FROM n""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.versions(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ts"), F.col("event_type").alias("content")))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_md5 FROM pages")
def html_strip_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("text_md5"))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1")
def p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.upper_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.95, ["l_returnflag"])


@query("WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, v AS p90 FROM r WHERE i = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.9, ["l_returnflag"])


# documents


@query()
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of every sentence; tested by cutting the texts at them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentence_spans(F.col("text"))).alias("no", "s")).select("doc_id", "no", "s.start", "s.end", F.length("s.sentence").alias("n"))


SECTIONED = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, 'Abstract' || chr(10) || left(t, 300) AS a, '1. Introduction' || chr(10) || t AS i, 'Conclusion' || chr(10) || right(t, 300) AS c FROM d),
s AS (SELECT doc_id, 1 AS ord, 'abstract' AS name, '0' AS sec, 0.65 AS conf, a AS body FROM b UNION ALL SELECT doc_id, 2, 'intro', '1', 0.9, i FROM b UNION ALL SELECT doc_id, 3, 'conclusion', '4', 0.65, c FROM b)
SELECT doc_id, ord, name, sec, CASE WHEN length(regexp_replace(body, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) < 200 THEN least(conf, 0.5) ELSE conf END AS confidence, FALSE AS downgrade FROM s"""


def with_headings(docs: DataFrame) -> DataFrame:
    """Documents under given headings: their beginning, all of it, their end."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.concat(F.lit("Abstract\n"), F.left(text, F.lit(300)), F.lit("\n1. Introduction\n"), text, F.lit("\nConclusion\n"), F.right(text, F.lit(300))).alias("text"))


@query(SECTIONED)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.sections(with_headings(texts(spark, sf_dir)), "doc_id").select("doc_id", F.col("ord").cast("int").alias("ord"), "name", "sec", "confidence", "downgrade")


@query()
def chunk_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequential fold over each text; tested against a plain loop."""
    docs = texts(spark, sf_dir).select("doc_id", F.lit("0").alias("sec"), "text")
    return documents.chunks(docs, "doc_id").select("doc_id", "chunk_no", "chunk_id", F.length("text").alias("n"))


@query()
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of sentences with frequent words; a plain loop tests it."""
    return documents.extractive(texts(spark, sf_dir), "doc_id", must_have=F.lit([w for w, _ in WORDS]))


@query("""WITH s AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM s) SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(line) AS line_md5 FROM r WHERE upto - 1 <= 2000""")
def context_quota_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sentences of one section each, so the whole budget is its quota."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.lit("method").alias("name"), F.posexplode(F.split("text", "\n")).alias("pos", "sentence"), F.lit(0).alias("overlap"))
    return documents.context_fit(lines, 2000, "doc_id").select("doc_id", "pos", F.md5("sentence").alias("line_md5"))


@query("SELECT DISTINCT event_id, event_type FROM events")
def file_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events folder as a stream, drained once, repeats dropped within the watermark."""
    from paperlake.plans.tables import shared_path
    from paperlake.streaming import ingest

    out, state = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as the table may be one file or a folder
    stream = ingest.files(spark, f"{sf_dir}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    ingest.drain(ingest.distinct_within(stream, "ts", ["event_id"], "60 days").select("event_id", "event_type"), state, ingest.idempotent_sink(out))
    return spark.read.parquet(out).select("event_id", "event_type")
