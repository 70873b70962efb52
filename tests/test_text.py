"""Sentences, headings, replies, Markdown, links, readers, sinks."""

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import text as tx
from clauseloom.operators import generate, links, markdown, relations, tree, vectors
from clauseloom.sources import files, sinks
from clauseloom.streaming import ingest

ALT = "array<struct<heading:string,status:string,source:string>>"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("One. Two? Three!", ["One.", "Two?", "Three!"]),
        ("Dr. Who met Mr. X. They left.", ["Dr. Who met Mr. X. They left."]),
        ("It is 3.5 m. Go to example.com now. Done", ["It is 3.5 m. Go to example.com now.", "Done"]),
        ("Wait... what", ["Wait...", "what"]),
        ("She has a Ph.D. in law. Good.", ["She has a Ph.D. in law.", "Good."]),
        ("Acme Inc. grew. Acme Inc. They said.", ["Acme Inc. grew.", "Acme Inc.", "They said."]),
        ('He said "No." Then left.', ['He said "No."', "Then left."]),
        ("first\nline. next", ["first line.", "next"]),
        ("   ", []),
        (None, None),
    ],
)
def test_sentences(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.sentences(F.col("t")).alias("s")).first().s == expected


def test_headings(spark):
    g, sel, par = (lambda h: (h, "generated", "")), (lambda h: (h, "selected", "")), (lambda h: (h, "parsed", ""))
    rows = [("TOC", [g("A"), sel("B"), g("C")]), ("TOC", [g("A"), g("C")]), ("TOC", []), ("Scope of it", [g("A")]), ("TOC", [par("P"), g("A"), par("P")]), ("", [])]
    df = spark.createDataFrame(rows, f"d string, a {ALT}")
    got = df.select(tx.best_heading(F.col("d"), F.col("a")).alias("b"), tx.is_specific(F.col("d"), F.col("a")).alias("s"), tx.display_heading(F.col("d"), F.col("a")).alias("p"), F.size(tx.distinct_alternatives(F.col("a"))).alias("n"), tx.heading_state(F.col("d"), F.col("a")).alias("st")).collect()
    assert [r.b for r in got] == ["B", "C", "TOC", "Scope of it", "A", ""] and [r.s for r in got] == [True, True, False, True, True, False]
    assert got[4].p == "P" and got[4].n == 2 and [r.st for r in got][:4] == ["best selected", "best generated", "loaded", "loaded"]


def test_replies(spark):
    r = spark.range(1).select(tx.reply_headings(F.lit("1. **Some Heading**\nchatter\n2. *Other*"), "unknown").alias("h"), tx.trimmed_reply(F.lit("Here is a summary:\n\nText a\n\nText b\n\n"), "llama3.1").alias("t")).first()
    assert r.h == ["Some Heading*", "Other"] and r.t == ["Text a", "", "Text b"]


def test_segments(spark):
    lines = ["before", "# 1 Scope", "a", "# Unknown heading", "b", "# 9 Nowhere", "c", "## 1.1. ", "d  ", "# Annex A Title", "e"]
    df = spark.createDataFrame([("S", "", i, x) for i, x in enumerate(lines)], "series string, part string, line_no int, line string")
    ch = spark.createDataFrame([("S", "", c, f"S {c}") for c in ("1", "1.1", "A", "2")] + [("S", "7", "1", "S-7 1")], "series string, part string, chapter string, clause_id string")
    texts, heads, dropped = markdown.segment(df, ch)
    assert {r.clause_id: r.text for r in texts.collect()} == {"S 1": ["a", "b", "c"], "S 1.1": ["d"], "S A": ["e"]}
    assert {(r.clause_id, r.title) for r in heads.collect()} == {("S 1", "Scope"), ("S 1.1", ""), ("S A", "Title")} and dropped.count() == 2
    assert [r.chapter for r in markdown.missed(ch, heads, df).collect()] == ["2"]
    cat = spark.createDataFrame([("S 1", "Range"), ("S 1.1", "Sub"), ("S A", "TOC")], "clause_id string, title string")
    assert {r.clause_id: (r.effective, r.finding) for r in markdown.title_findings(heads, cat).collect()} == {"S 1": ("Scope", "mismatch"), "S 1.1": ("Sub", "overridden"), "S A": ("Title", None)}


def test_links(spark):
    uids = spark.createDataFrame([("IEC 61508-1:2010 7.2.1", "IEC61508", "IEC61508-1"), ("ISO 26262-8:2018 10.4", "ISO26262", "ISO26262-9")], "clause_id string, std_key string, uid string")
    rows = spark.createDataFrame([("a.md", 0, "See IEC 61508-1:2010 7.2.1. And ISO 26262-8:2018 10.4, EN 50129:2018 5"), ("a.md", 1, "none"), ("a.md", 2, None)], "file string, line_no int, line string")
    plain = {r.line_no: r.line for r in links.rewrite(rows, uids).collect()}
    assert plain[0] == "See >>IEC 61508-1:2010 7.2.1.<< And [ISO 26262-8:2018 10.4](../requirements/ISO26262.html#ISO26262-9), >>EN 50129:2018 5<<" and plain[1] == "none" and plain[2] is None
    assert links.rewrite(rows, uids, trim_dot=True).filter("line_no = 0").first().line.startswith("See [IEC 61508-1:2010 7.2.1](../requirements/IEC61508.html#IEC61508-1). And")
    assert links.resolve(spark.createDataFrame([("a", 0, "ISO PAS 8926:2024 4")], "file string, line_no int, line string"), uids, strict=True).count() == 0
    kinds = spark.createDataFrame([("x", None), (None, "p"), (None, None)], "pattern string, path string")
    assert [r.kind for r in links.reference_kinds(kinds).collect()] == ["pattern", "file", "invalid"]


def test_relations(spark):
    rel = spark.createDataFrame([("a", "b", 1.0, 0), ("a", "b", 3.0, 1), ("b", "c", 2.0, 2), ("b", "a", 1.0, 3)], "src string, dst string, score double, line_no int")
    assert {(r.src, r.dst): r.score for r in relations.memorized(rel).collect()}["a", "b"] == 3.0
    res = {r.clause_id: r for r in relations.resonance(rel).collect()}
    assert res["b"].impulse == 4.0 and sum(r.resonance for r in res.values()) / len(res) == pytest.approx(1, abs=1e-5)
    uids = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "clause_id string, uid string")
    pairs = links.bijective(rel, uids)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", "1", "2")] and {r.src: r.links for r in links.adjacency(pairs).collect()} == {"a": ["b"], "b": ["a"]}
    hits = spark.createDataFrame([("A 12345:2020 1", False), ("A 12345:2020 2", False)], "clause_id string, hit boolean")
    assert relations.accuracy(hits).first().accuracy == 0.0
    kids = spark.createDataFrame([(f"P.{i}", f"Q.{i}", 1.0 + i) for i in range(6)] + [("Q.1", "P.1", 9.0)], "src string, dst string, score double")
    dom = spark.createDataFrame([(f"{p}.{i}", d) for p, d in (("P", "industry"), ("Q", "automotive")) for i in range(6)], "clause_id string, domain string")
    found = relations.clusters(kids, dom)
    assert [(r.parent, r.peer_parent, len(r.members)) for r in found.collect()] == [("P", "Q", 6)] and relations.reciprocal(found).count() == 0
    rows = relations.cluster_rows(found, kids)
    assert {(r.member, r.revscore) for r in rows.collect()} >= {("P.1", 9.0), ("P.2", 0.0)} and relations.cluster_scores(found, kids).count() == 6
    heads = spark.createDataFrame([("P", "industry"), ("Q", "automotive")], "clause_id string, domain string")
    both = relations.comparisons(found, heads)
    assert [tuple(r) for r in both.collect()] == [("Q", "P")]
    told = relations.contexts(both, rows, dom.select("clause_id", F.lit("H").alias("heading"), F.col("clause_id").alias("text")))
    assert told.first().second_text.startswith("H\nP.0") and generate.compare(told).first().reply.startswith("H") and "| P.1 |" in sinks.cluster_report(rows).first().body


def test_tree(spark):
    c = spark.createDataFrame([("1", 1, "x"), ("1.1", 2, "yy"), ("1.2", 2, "z"), ("3.1", 2, "lost")], "clause_id string, level int, value string")
    edges, orphans = tree.attach(c)
    assert edges.count() == 2 and [r.child_id for r in orphans.collect()] == ["3.1"]
    from clauseloom.functions import ids

    t = c.withColumn("parent_id", ids.parent_id(F.col("clause_id"), F.col("level"))).withColumn("ord", F.col("clause_id"))
    done = tree.fold_up(t, lambda v, kids: F.concat(v, F.lit("("), F.array_join(kids, ","), F.lit(")")))
    assert {r.clause_id: r.result for r in done.collect()}["1"] == "x(yy(),z())"
    summed = {r.ancestor: (r.tree_size, r.tree_weight) for r in tree.subtree_sums(c, "clause_id", F.length("value"), [F.lit("root")]).collect()}
    assert summed["1"] == (3, 4) and summed["root"] == (4, 8)
    old = spark.createDataFrame([("1.1", "Cached.")], "clause_id string, summary string")
    assert {r.clause_id: r.summary for r in generate.summaries(t, cached=old).collect()}["1.1"] == "Cached."


def test_headings_are_generated_where_none_says_anything(spark):
    c = spark.createDataFrame([("1", "TOC", [], "alpha beta alpha gamma beta delta"), ("2", "Clear", [], "text")], f"clause_id string, display string, alternatives {ALT}, text string")
    made = generate.headings(c)
    assert [(r.clause_id, r.heading) for r in made.collect()] == [("1", "Alpha Beta Delta")]
    assert generate.select(made, made).first().status == "selected"
    assert generate.generate(c, "x", lambda p, t: "").first().tries == generate.ATTEMPTS


def test_retrieval_in_blocks(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(60, 8)).astype("float32")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(20)], "qid long, qvec array<float>")
    n = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(60)], "nid long, domain int, nvec array<float>")
    exact = {(i, d): [j for j, _ in sorted(((j, float(v[i].astype(float) @ v[j].astype(float))) for j in range(60) if j % 2 == d), key=lambda x: (-x[1], x[0]))[:5]] for i in range(20) for d in (0, 1)}
    for block, scores in ((7, 1 << 20), (4096, 1 << 20), (None, 50), (40, 1)):
        monkeypatch.setattr(vectors, "SCORES", scores)
        got = {}
        for r in vectors.top_k(q, n, 5, block).orderBy("rank").collect():
            got.setdefault((r.qid, r.domain), []).append(r.nid)
        assert got == exact


def test_files(spark, tmp_path):
    std = tmp_path / "std"
    std.mkdir()
    (std / "N1").write_text('parent=""\ndigits=8\npartShift=1\npartDigits=0\nname="N 12345"\noyr=2001\n\nstructure=(\n "2020 1-1 1-r1.{1..2}"\n "2021 2-1"\n)\nreturn 0;\nTOC;h;N 12345-1:2020 1;Scope;u\nTEXT;h;N 12345-1:2020 1;Head;a~b\n')
    found = files.standards(spark, str(std))
    assert found.first().name == "N 12345" and [r.year for r in files.volumes(found).orderBy("vol_idx").collect()] == ["2020", "2021"]
    assert files.with_missing(found, ["N1", "N2"]).filter("std_key = 'N2'").first().digits == 3
    toc, texts = files.records(spark, str(std))
    assert toc.first().heading == "Scope" and texts.first().text == "a~b"
    md = tmp_path / "md"
    md.mkdir()
    (md / "EN1-2.md").write_text("# 1 A\nx")
    (md / "EN1.md ").write_text("not read")
    assert [(r.series, r.part, r.line) for r in files.markdown(spark, str(md)).orderBy("line_no").collect()] == [("EN1", "2", "# 1 A"), ("EN1", "2", "x")]
    cache = tmp_path / "cache.txt"
    cache.write_text("lost\n# c 1\n1. **One**\n\n# c 2\nx\ny\n")
    rows = files.lines(spark, str(cache))
    assert {r.clause_id: r.lines for r in files.cached_texts(rows).collect()} == {"c 1": ["1. **One**"], "c 2": ["x", "y"]}
    assert [r.heading for r in generate.cached_headings(files.blocks(rows), "nemotron").collect()] == ["One*"]
    m = tmp_path / "mapping1"
    m.write_text('from="A"\nto="B"\ntype="t"\nnote="n"\n12;x;y;034\n')
    maps = files.mappings(spark, str(m))
    uids = spark.createDataFrame([("A", "0012", "A 1"), ("B", "0034", "B 1")], "std_key string, uid string, clause_id string")
    assert tuple(links.curated(maps, uids, spark.createDataFrame([("A", 4), ("B", 4)], "std_key string, digits int")).select("from_clause", "to_clause").first()) == ("A 1", "B 1")
    w = tmp_path / "w.csv"
    w.write_text("c;[1.0, 2];[0.5,0.5]\nd;[1];[1]\n")
    counts = spark.createDataFrame([("c", 2)], "clause_id string, sentences int")
    assert {r.clause_id: r.status for r in files.check_weights(files.weights(spark, str(w)), counts).collect()} == {"c": "ok", "d": "unknown clause"}
    r = tmp_path / "r.csv"
    r.write_text("a;b;1.5\na;zz;1\nzz;a;1\n")
    kept, bad = files.known_relations(files.relations(spark, str(r)), spark.createDataFrame([("a",), ("b",)], "clause_id string"))
    assert kept.first().score == 1.5 and [x.dst for x in bad.collect()] == ["zz"]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([("S 1", "r", "TOC", [("Gen", "generated", "")], [1]), ("S 2", "c", "Named", [], [2])], f"clause_id string, type string, display string, alternatives {ALT}, dfs_key array<int>")
    assert [r.line.split(";")[3:] for r in sinks.heading_dump(c).orderBy("dfs_key").collect()] == [["Gen", "R"], ["Named", "c"]]
    t = spark.createDataFrame([("1", 2, "H", ["a", "b", ""])], "clause_id string, level int, heading string, text array<string>")
    assert sinks.text_print(t).first().body.startswith("## 1 H\n\na\nb")
    rows = sinks.text_dump(t).select("line").withColumn("std", F.lit("x"))
    for _ in range(2):
        sinks.write_lines(rows, str(tmp_path / "out"), "std")
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    assert sinks.json_rows(t).first().body == '{"clause_id":"1","heading":"H","level":2,"text":["a","b",""]}'
    assert [r.line for r in sinks.edge_dump(spark.createDataFrame([("a", "b")], "parent_id string, child_id string")).collect()] == ["a;b"]


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("One. Two.")
    run = lambda: ingest.ingest(ingest.markdown_stream(spark, str(src)), str(tmp_path / "idx"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert ingest.latest(spark, str(tmp_path / "idx")).count() == 2
    (src / "b.md").write_text("Three.")
    run()
    assert ingest.latest(spark, str(tmp_path / "idx")).count() == 3


def test_nodes_and_neighbours(spark, tmp_path):
    docs = vectors.documents(spark.createDataFrame([("c", "S", "r", "H", ["A one.", "B two. C three."])], "clause_id string, series string, type string, heading string, text array<string>"))
    nodes = vectors.sentence_nodes(docs).withColumn("domain", F.lit("d"))
    assert [r.sentence for r in nodes.orderBy("sent_no").collect()] == ["A one.", "B two.", "C three."]
    near = {r.sent_no: r for r in vectors.neighbours(nodes).collect()}
    assert near[2].previous_texts == ["B two.", "A one."] and near[0].next_texts == ["B two.", "C three."]
    vectors.save_index(nodes, str(tmp_path / "i"))
    assert vectors.load_index(spark, str(tmp_path / "i"), "d").count() == 3
    assert vectors.chunks(spark.createDataFrame([(None, None)], "score double, doc_id string")).first().doc_id == "-"


def test_summaries_ask_once_for_each_clause_however_deep(spark, tmp_path):
    """A tree of 12 levels: every clause is there, and the generator is called once for each of them."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def counting(prompt, text):
        import uuid

        (calls / uuid.uuid4().hex).write_text(text)
        return text.split(" ")[0]

    rows = [(f"c{k}", f"c{k - 1}" if k else None, k, "a", f"v{k}") for k in range(12)] + [("d", "c0", 1, "b", "vd")]
    c = spark.createDataFrame(rows, "clause_id string, parent_id string, level int, ord string, value string")
    got = {r.clause_id: r.summary for r in generate.summaries(c, counting).collect()}
    assert got == {r[0]: r[4] for r in rows} and len(list(calls.iterdir())) == 13
    cached = spark.createDataFrame([("c5", "known")], "clause_id string, summary string")
    again = {r.clause_id: r.summary for r in generate.summaries(c, counting, cached).collect()}
    assert again["c5"] == "known" and len(list(calls.iterdir())) == 13 + 12
    folded = tree.fold_up(c, lambda v, kids: F.concat(v, F.array_join(kids, "")))
    assert {r.clause_id: r.result for r in folded.collect()}["c0"] == "v0" + "".join(f"v{k}" for k in range(1, 12)) + "vd" and folded.count() == 13
