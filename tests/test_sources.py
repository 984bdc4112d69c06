"""File sources and sinks on small files."""

import json

import pytest

from evloom.sources import files, providers


def test_scan_folder_keeps_one_row_per_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "sub" / "b.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "c.xml").write_bytes(b"<article/>")
    (tmp_path / "d.txt").write_bytes(b"no")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.pdf", "c.xml"} and rows["a.pdf"]["copies"] == 2 and rows["a.pdf"]["is_pdf"] and not rows["c.xml"]["is_pdf"]
    assert all(r["reason"] is None for r in rows.values())
    known = spark.createDataFrame([(rows["a.pdf"]["sha256"],)], "sha256 string")
    assert files.scan_folder(spark, str(tmp_path), known).count() == 1


def test_large_files_are_listed_with_a_reason(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_BYTES", 10)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1" * 9)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert rows["a.pdf"]["reason"] == "too large" and rows["a.pdf"]["sha256"] is None and rows["b.pdf"]["reason"] is None


def test_ocr_words(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    (tmp_path / "o.tsv").write_text("\n".join([head, "5\t1\t1\t1\t1\t1\t10\t20\t5\t6\t91.5\t7", "5\t1\t1\t1\t1\t2\t10\t20\t5\t6\t40\tlow", "5\t1\t1\t1\t1\t3\t1\t2\t5\t6\t99\t "]))
    rows = files.ocr_words(spark, str(tmp_path)).collect()
    assert [(r["text"], r["box"]) for r in rows] == [("7", [10.0, 20.0, 15.0, 26.0])]


def test_dataset_version(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"schema_version": 2, "name": "x"}))
    bad.write_text(json.dumps({"schema_version": 1, "name": "x"}))
    assert files.read_dataset(spark, str(good), "name string").first()["name"] == "x"
    with pytest.raises(ValueError):
        files.read_dataset(spark, str(bad), "name string")


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", None, [1]), ("plain", 2, [])], "b string, a int, c array<int>")
    for fmt in ("json", "csv", "parquet"):
        files.export_rows(df, str(tmp_path / fmt), fmt)
    csv = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert csv.columns == ["a", "b", "c"] and {r["b"] for r in csv.collect()} == {"'=1+1", "plain"} and csv.where("a is null").count() == 1
    with pytest.raises(ValueError):
        files.export_rows(df, str(tmp_path / "x"), "html")


def test_articles_are_refused_with_a_reason(spark):
    bad = [("e", '<!DOCTYPE a [<!ENTITY x "y">]><article/>'), ("d", '<article><p id="a"/><p id="a"/></article>'), ("x", "<article>"), ("n", "<book/>")]
    rows = files.article_elements(spark.createDataFrame(bad, "document_hash string, content string")).collect()
    assert {r["document_hash"] for r in rows} == {"e", "d", "x", "n"} and all(r["kind"] == "rejected" for r in rows)


def test_article_rows_leave_a_task_in_frames(monkeypatch):
    body = "<article>" + "<p>word</p>" * 7 + "</article>"
    monkeypatch.setattr(files, "FRAME_ROWS", 3)
    read = []
    frames = files._frames((read.append(k) or k, body) for k in "abcd")
    first = next(frames)
    assert first.num_rows == 3 and read == ["a"]  # nothing of the next article is held yet
    rows = [r for f in (first, *frames) for r in f.to_pylist()]
    assert len(rows) == 32 and {r["document_hash"] for r in rows} == set("abcd") and sum(r["text"] == "word" for r in rows) == 28
    monkeypatch.setattr(files, "FRAME_CHARS", 4)
    assert max(f.num_rows for f in files._frames([("a", body)])) <= 2


def test_article_elements(spark):
    body = ('<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><article-id pub-id-type="doi">10.1234/X</article-id><title-group><article-title>On <i>x</i></article-title></title-group>'
            '<abstract><p id="p1">Short</p></abstract></article-meta></front><body><sec><title>Results</title><p>Size <b>7</b> um</p></sec><p>Narrative</p></body>'
            '<floats-group><table-wrap id="t1"><caption><p>Sizes</p></caption><table><tr/><tr><th>n</th><td id="v" rowspan="2">42</td></tr></table></table-wrap>'
            '<fig id="f1"><caption><title>Fig</title></caption><graphic xlink:href="a.png"/></fig></floats-group></article>')
    e = files.article_elements(spark.createDataFrame([("h", body)], "document_hash string, content string"))
    rows = e.collect()
    cell = next(r for r in rows if r["kind"] == "cell" and r["tag"] == "td")
    assert (cell["locator"], cell["table_locator"], cell["row_no"], cell["rowspan"], cell["text"], cell["unit_element"]) == ("id:v", "t1", 1, "2", "42", "/article/floats-group[1]")
    assert {(r["locator"], r["asset_ref"]) for r in rows if r["kind"] == "asset"} == {("id:f1", "a.png")}
    assert {r["caption"] for r in rows if r["tag"] == "table-wrap"} == {"Sizes"} and {r["caption"] for r in rows if r["tag"] == "fig" and r["kind"] == "figure"} == {"Fig"}
    assert "/article/body[1]/sec[1]/p[1]" in {r["locator"] for r in rows if r["tag"] == "p"}
    head = files.article_identifiers(e).first()
    assert (head["doi"], head["title"]) == ("10.1234/x", "On x")
    units = {r["unit_element"]: r["text"] for r in files.unit_texts(e).collect()}
    assert units["/article/body[1]"] == "Size 7 um\nNarrative" and units["/article/floats-group[1]"] == "Sizes\nSizes n 42\nFig"


def test_landed_pages(spark, tmp_path):
    page = {"message": {"items": [{"DOI": "10.1234/N", "type": "posted-content", "update-to": [{"type": "retraction", "DOI": "10.1234/T"}]}]}}
    (tmp_path / "p.json").write_text(json.dumps(page))
    items = providers.read_json_pages(spark, str(tmp_path / "p.json"), providers.CROSSREF_ITEM, "message.items")
    r = providers.crossref(items).first()
    assert (r["doi"], r["is_preprint"], r["status"], r["title"]) == ("10.1234/n", True, "active", "Untitled record")
    assert r["update_relations"][0]["target_doi"] == "10.1234/t"
    (tmp_path / "p.xml").write_text('<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>999</PMID><Article><ArticleTitle>Retraction</ArticleTitle></Article><CommentsCorrectionsList>'
                                    '<CommentsCorrections RefType="RetractionOf"><PMID>123</PMID></CommentsCorrections></CommentsCorrectionsList></MedlineCitation></PubmedArticle></PubmedArticleSet>')
    x = providers.pubmed(providers.read_xml_records(spark, str(tmp_path / "p.xml"), providers.PUBMED_ARTICLE, "PubmedArticle", "article")).first()
    assert (x["pmid"], x["status"]) == ("999", "active") and x["update_relations"][0]["target_pmid"] == "123"
