"""Whole runs over small invented files, through the command line."""

import hashlib

from clauseloom.__main__ import main


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_runs(spark, tmp_path):
    data, md, notes = tmp_path / "data", tmp_path / "md", tmp_path / "notes"
    for d in (data, md, notes):
        d.mkdir()
    one, two = "IEC 61508-1:2010", "ISO 26262-2:2018"
    (data / "IEC61508").write_text(f'parent=""\ndigits=9\npartShift=0\npartDigits=0\nname="IEC 61508"\noyr=2005\n\nstructure=(\n "2010 1-1 1-r1.{{1..2}}"\n)\n\nTOC;{md5(one + " 1")};{one} 1;Widgets;u\n')
    main(["catalogue", str(data), "--standards", "IEC61508", "NONE", "--readable", "--out", str(tmp_path / "cat")])
    rows = {r.clause_id: r for r in spark.read.parquet(str(tmp_path / "cat/catalogue")).collect()}
    assert rows[f"{one} 1"].title == "Widgets" and rows[f"{one} 1.2"].title == "REQUIREMENT" and rows[f"{one} 1"].locator == f"{one} 1"
    assert spark.read.parquet(str(tmp_path / "cat/items")).count() == 3

    content = tmp_path / "content.csv"
    ids = [f"{s} {c}" for s in (one, two) for c in ("1", "1.1", "1.2")] + ["ISO/TS 5083:2025 1"]
    content.write_text("".join(f"TOC;{md5(i)};{i};{'REQUIREMENT' if '.' in i[-3:] else 'Top'};{'r' if '.' in i[-3:] else 'u'}\n" for i in ids))
    (md / "IEC61508-1.md").write_text("# 1 Top\nAbout brakes.\n# 1.1 Brakes\nThe brake shall stop the wheel. It shall be red.\n# 7 Other\nMore.\n")
    (md / "ISO26262-2.md").write_text("# 1 Top\nAbout wheels.\n# 1.1\nThe brake shall stop the wheel. Always.\n")
    rel, ref = tmp_path / "rel.csv", tmp_path / "ref.csv"
    rel.write_text("".join(f"{a};{b};1.5\n" for a, b in ((ids[1], ids[4]), (ids[4], ids[1]), (ids[1], "nowhere"))))
    ref.write_text("".join(f"{md5(i)};{'IEC61508' if 'IEC' in i else 'ISO26262'}-{k};{i}\n" for k, i in enumerate(ids)))
    main(["knowledge", str(content), str(md), "--relations", str(rel), "--refmap", str(ref), "--out", str(tmp_path / "k")])
    read = lambda n: spark.read.parquet(str(tmp_path / n)).collect()
    full = {r.clause_id: r for r in read("k/clauses")}
    assert full[ids[1]].text == ["The brake shall stop the wheel. It shall be red.", "More.", ""] and full[ids[1]].domain == "industry"
    assert full[ids[1]].context == 'is a subclause of clause "Top"' and len(read("k/rejects")) == 1 and {r.chapter for r in read("k/missed")} == {"1.2"}
    assert [r.dst for r in read("k/unknown_targets")] == ["nowhere"] and {r.clause_id: r.resonance for r in read("k/resonance")} == {ids[1]: 1.0, ids[4]: 1.0}

    main(["mine", str(content), str(md), "--out", str(tmp_path / "m")])
    best = {r.src: r.dst for r in read("m/relations")}
    assert best[ids[4]] == ids[1] or ids[1] in {r.dst for r in read("m/relations") if r.src == ids[4]}

    (notes / "n.md").write_text(f"See {ids[1]} and EN 50129:2018 5")
    main(["references", str(notes), str(ref), "--out", str(tmp_path / "r")])
    assert read("r/lines")[0].line == f"See [{ids[1]}](../requirements/IEC61508.html#IEC61508-1) and >>EN 50129:2018 5<<"
    main(["links", str(rel), str(ref), "--out", str(tmp_path / "l")])
    assert [(r.src, r.dst) for r in read("l/pairs")] == [(ids[1], ids[4])]

    main(["summaries", str(content), str(md), "--out", str(tmp_path / "s")])
    told = {r.clause_id: r.summary for r in read("s/summaries")}
    assert len(told) == 6 and told[ids[0]] == "About brakes." and told[ids[1]] == "The brake shall stop the wheel." and told[ids[5]] == ""
    cache = tmp_path / "cache.md"
    cache.write_text(f"# {ids[1]}\nKnown\n")
    main(["summaries", str(content), str(md), "--cache", str(cache), "--out", str(tmp_path / "s2")])
    assert {r.clause_id: r.summary for r in read("s2/summaries")} == told | {ids[1]: "Known"}
    main(["headings", str(content), str(md), "--out", str(tmp_path / "h")])
    assert {r.clause_id for r in read("h/headings")} == {ids[1], ids[4]} and {r.status for r in read("h/headings")} == {"generated"}
    main(["headings", str(content), str(md), "--cache", str(cache), "--out", str(tmp_path / "h2")])
    assert ("Known", ids[1]) in {(r.heading, r.clause_id) for r in read("h2/headings")} and len(read("h2/headings")) == len(read("h/headings"))
    main(["compare", str(content), str(md), "--relations", str(rel), "--least", "1", "--out", str(tmp_path / "c")])
    (pair,) = read("c/contexts")
    assert (pair.first, pair.second) == (ids[3], ids[0]) and pair.first_text == "REQUIREMENT\nThe brake shall stop the wheel. Always." and pair.second_text.startswith("REQUIREMENT\nThe brake shall stop the wheel. It")
    assert [(r.clause_id, r.reply) for r in read("c/comparisons")] == [(f"{ids[3]}|{ids[0]}", "REQUIREMENT\nThe brake shall stop the wheel.")]

    (data / "ISO26262").write_text('parent=""\ndigits=2\nname="ISO 26262"\n')
    mapping = tmp_path / "mapping"
    mapping.write_text('from="IEC61508"\nto="ISO26262"\ntype="t"\nnote="n"\n000000001;x;y;4\n7;x;y;04\n')
    ref.write_text(f"{md5(ids[1])};IEC61508-000000001;{ids[1]}\n{md5(ids[4])};ISO26262-04;{ids[4]}\n")
    main(["curated", str(mapping), str(ref), str(data), "--out", str(tmp_path / "cu")])
    assert {(r.from_uid, r.from_clause, r.to_uid, r.to_clause) for r in read("cu/curated")} == {("000000001", ids[1], "04", ids[4]), ("000000007", None, "04", ids[4])}
