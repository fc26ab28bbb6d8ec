"""Queries over whole tables, against brute force."""

import re
from collections import Counter, defaultdict

import duckdb

from paperlake import plans
from paperlake.functions import text as X
from paperlake.plans import knowledge


def _note_links(docs):
    """Every pair of notes is looked at."""
    first, out, notes = {}, set(), {}
    for i, t in sorted(docs):
        r = first.setdefault(t or "", i)
        if r == i:
            stop = {*X.STOP, *X.KEYWORD_STOP}
            n = Counter(w for w in re.findall(r"[A-Za-z][A-Za-z\-]{2,}|\d+(?:\.\d+)?", t or "") if w.lower() not in stop)
            notes[i] = [w.lower() for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:12]]
    out = {(i, first[t or ""], len(set(notes[first[t or ""]])), "copy") for i, t in docs if first[t or ""] != i}
    to = defaultdict(list)
    for i in sorted(notes):
        k = set(notes[i])
        near = [o for o in sorted(notes) if o < i and set(notes[i][:6]) & set(notes[o])][:12]
        if not near and len(notes[i]) >= 2:
            near = [o for o in sorted(notes) if o < i and notes[o]][-12:]
        good = [o for o in near if any(len(w) >= 5 for w in k & set(notes[o])) or len(k & set(notes[o])) >= 2 or len(k & set(notes[o])) / len(k | set(notes[o])) >= 0.28]
        for o in good[:6]:
            to[o].append(i)
    return out | {(i, o, len(set(notes[i]) & set(notes[o])), "link") for o, all_ in to.items() for i in all_}


def test_near_duplicate_links(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in plans.QUERIES["near_duplicate_links"](spark, sf_dir).select("id", "other", "n", "kind").collect()]
    assert len(got) == len(set(got)) and set(got) == _note_links(docs)


def test_links_of_many_copies_and_frequent_words(spark):
    docs = [(i, "zebra crossing") for i in range(60)] + [(100 + i, f"zebra number{i}") for i in range(40)] + [(200, None), (201, ""), (202, None)]
    got = {tuple(r) for r in knowledge.note_links(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _note_links(docs)
    assert sum(r[3] == "copy" for r in got) == 61


def _duck(sf_dir, sql):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "lineitem", "orders", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return {tuple(r) for r in con.execute(sql).fetchall()}


def test_claims_meet_all_documents(spark, sf_dir):
    from pyspark.sql import functions as F

    from paperlake.operators import verify

    got = {(r["item_id"], r["doc_id"]): r["supported"] for r in plans.QUERIES["claim_lexical_support"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", verify.support_words(F.col("text")).alias("w")).collect()
    for d in docs:
        low = (d["text"] or "").lower()
        for i in items:
            n = sum(w.lower() in low for w in i["w"])
            assert got.pop((i["item_id"], d["doc_id"])) == (len(i["w"]) > 0 and n >= 0.34 * len(i["w"]))
    assert not got


def test_claims_equal_sql_on_its_part(spark, sf_dir):
    rows = plans.QUERIES["claim_lexical_support"](spark, sf_dir).where("doc_id % 50 = 0").select("item_id", "doc_id", "supported").collect()
    assert {tuple(r) for r in rows} == _duck(sf_dir, knowledge.SUPPORT_SQL)


def test_terms_of_all_documents(spark, sf_dir):
    from decimal import ROUND_HALF_UP, Decimal

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ratio_micro"] for r in plans.QUERIES["term_consistency"](spark, sf_dir).collect()}

    def ratio(text):
        found = re.findall(r"(?i)(?<![A-Za-z0-9])the(?![A-Za-z0-9])", text or "")
        share = Decimal(repr(found.count("THE") / len(found))) if found else Decimal(1)
        return int(share.quantize(Decimal("0.0001"), ROUND_HALF_UP) * 10**6)

    assert got == {i: ratio(t) for i, t in docs.items()}
    assert _duck(sf_dir, plans.writing.ASCII_CONSISTENCY_SQL) == {(i, got[i]) for i, t in docs.items() if t.isascii()}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_text_scores_of_whole_texts(spark, sf_dir):
    t = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {r["item_id"]: r["score_micro"] for r in plans.QUERIES["levenshtein_text_score"](spark, sf_dir).collect()}
    clean = {i: " ".join(x.split()) for i, x in t.items()}
    assert max(map(len, clean.values())) > 200
    assert got == {i: int(max(0.0, 1 - _distance(clean[i], clean[i + 1]) / len(clean[i])) * 1e6 + 0.5) for i in clean if i + 1 in clean}
    plain = {i for i, x in t.items() if re.fullmatch("[ -~]*", x) and x == clean[i]}
    short = {i for i in got if max(len(t[i]), len(t[i + 1])) <= 200 and {i, i + 1} <= plain}
    assert short and {(i, got[i]) for i in short} == {r for r in _duck(sf_dir, knowledge.PREFIX_SCORE_SQL) if r[0] in short}


def test_components_and_concepts_of_all_rows(spark, sf_dir):
    li, orders, supplier = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "supplier"))
    customer = {r["o_orderkey"]: r["o_custkey"] for r in orders.collect()}
    nation = {r["s_suppkey"]: r["s_nationkey"] for r in supplier.collect()}
    rows, near, papers = li.collect(), defaultdict(set), defaultdict(set)
    for r in rows:
        if r["l_orderkey"] in customer:
            a, b = customer[r["l_orderkey"]], r["l_suppkey"] + 10**9
            near[a].add(b)
            near[b].add(a)
        if r["l_suppkey"] in nation:
            papers[str(r["l_partkey"])].add(nation[r["l_suppkey"]])
    root = {}
    for start in sorted(near):
        todo = [start] if start not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    assert {tuple(r) for r in plans.QUERIES["connected_components"](spark, sf_dir).select("node", "component").collect()} == set(root.items())
    pairs = Counter((a, b) for p in papers.values() for a in p for b in p if a < b)
    assert {tuple(r) for r in plans.QUERIES["paper_shared_concepts"](spark, sf_dir).select("a", "b", "weight").collect()} == {(*k, n) for k, n in pairs.items() if n >= 2}
    most = sorted((-len(p), c) for c, p in papers.items() if len(p) >= 2)[:50]
    assert {tuple(r) for r in plans.QUERIES["concept_papers"](spark, sf_dir).select("concept", "papers").collect()} == {(c, -n) for n, c in most}


def test_operators_equal_sql_on_its_rows(spark, sf_dir):
    from paperlake.operators import graph

    li, orders, supplier = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "supplier"))
    edges = knowledge.order_edges(li.where("l_quantity >= 50 and l_discount >= 0.09"), orders)
    assert {tuple(r) for r in graph.components(edges).collect()} == _duck(sf_dir, knowledge.THIN_COMPONENTS_SQL)
    concepts = knowledge.concepts_of(li.where("l_quantity >= 49"), supplier)
    assert {tuple(r) for r in graph.shared_concepts(concepts).collect()} == _duck(sf_dir, knowledge.SHARED_SQL)
    assert {tuple(r) for r in graph.concept_papers(concepts).collect()} == _duck(sf_dir, knowledge.CONCEPT_PAPERS_SQL)


def test_outlines_of_short_empty_and_null_texts(spark, tmp_path):
    docs = [(1, "A short text.", 13), (2, "", 0), (3, None, None), (4, "No count. " * 50, None)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = defaultdict(set)
    for r in plans.QUERIES["outline_drafts"](spark, str(tmp_path)).collect():
        got[r["doc_id"]].add(r["ord"])
    assert got.keys() == {1, 2, 3, 4} and got[2] == got[3]


def test_rules_equal_a_loop(spark, sf_dir):
    """Names in sentences that hint at a relation, in order, twelve pairs a text."""
    from pyspark.sql import functions as F

    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.sentences(F.col("text")).alias("s")).collect()
    names = [w for w, _ in knowledge.WORDS]
    want, stopped = set(), 0
    for r in texts:
        found, n = {}, 0
        for s in r["s"] or []:
            rel = next((k for k, p in knowledge.SIGNS if re.search(p, s, re.I)), None)
            has = [w for w in names if re.search(rf"(?<![a-z0-9]){w}(?![a-z0-9])", s.lower())]
            if rel is None:
                continue
            for a in has:
                if n >= 12:
                    stopped += 1
                    break
                for b in has:
                    if a != b:
                        n += 1
                        found.setdefault((a, rel, b), s[:160])
        want |= {(r["doc_id"], *k, ev) for k, ev in list(found.items())[:12]}
    got = {tuple(r) for r in plans.QUERIES["rule_extraction"](spark, sf_dir).select("doc_id", "src", "rel", "dst", "ev").collect()}
    assert got == want and len(want) > 200 and stopped


def test_terms_are_unified(spark, sf_dir):
    import hashlib

    from paperlake.plans.writing import NAMES

    def unified(t):
        for alias in sorted(NAMES, key=lambda a: (-len(a), a)):
            t = re.sub(rf"(?i)(?<![A-Za-z0-9]){re.escape(alias)}(?![A-Za-z0-9])", NAMES[alias], t)
        return t

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text_md5"] for r in plans.QUERIES["unify_terms"](spark, sf_dir).collect()}
    assert got == {i: None if t is None else hashlib.md5(unified(t).encode()).hexdigest() for i, t in docs.items()}


def test_supported_reads_each_text_once(spark):
    """No join of texts with claims; words within words, across signs, repeated and empty ones."""
    from paperlake.operators import verify

    texts = [(1, "Deep-learning of tracks, 12.5 m; 模型训练"), (1, "deep"), (2, None), (None, "ing 2.5 训练 learn")]
    claims = [(7, ["deep", "Deep", "absent"]), (8, ["learning", "2.5", "训练", "p-l"]), (9, []), (None, ["ing", "xyz", "q"]), (10, ["", "zzz"])]
    docs = spark.createDataFrame(texts, "doc_id long, context string")
    got = verify.supported(docs, spark.createDataFrame(claims, "item_id long, words array<string>"))
    want = [(i, d, bool(ws) and sum(w.lower() in (t or "").lower() for w in ws) >= 0.34 * len(ws)) for d, t in texts for i, ws in claims]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_fused_queries_are_read_to_their_end(spark, tmp_path):
    """Of a query with many words the last ones count too: only they lead to the third document."""
    words = [chr(97 + i // 26) + chr(97 + i % 26) + "x" for i in range(40)]
    tables = {
        "documents": spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words[:3], words[5:7], words[30:38], ["zz"], ["yy"], ["vv"], ["uu"]))], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(1, " ".join(words)), (2, None)], "item_id long, text string"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {(r["doc_id"], r["rank"]): r["rrf_nano"] for r in plans.QUERIES["rrf_fusion"](spark, str(tmp_path)).collect()}
    want = {(d, k): n for _, k, d, n in con.execute("SELECT item_id, rank, doc_id, rrf_nano FROM (" + plans.ORACLE["rrf_fusion"] + ")").fetchall()}
    # first in both lists
    assert got == want and got[2, 1] == int(2e9 / 61 + 0.5)
