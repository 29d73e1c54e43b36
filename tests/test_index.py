import zipfile

import pytest

from scrivia.operators import catalog, evals, reading
from scrivia.plans.api import Tools
from scrivia.plans.index import backfill_embeddings, build_index, open_index, set_meta
from scrivia.streaming.ingest import append_stream

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{NS}"><w:body>{body}</w:body></w:document>')


def _p(text, style=None, num=False):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_build_and_query(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    table = "<w:tbl>" + "".join(f"<w:tr>{''.join(f'<w:tc>{_p(c)}</w:tc>' for c in r)}</w:tr>" for r in (("part", "n"), ("bolt", "4"))) + "</w:tbl>"
    _docx(corpus / "BOM-055 - Parts list_A.docx", _p("Scope", "Heading1") + _p("leakage test per ECR-577") + _p("item", num=True) + table)
    _docx(corpus / "BOM-055 - Parts list_B_Obsolete.docx", _p("old text"))
    _docx(corpus / "ECR-577 - Change of bolt_A.docx", _p("see BOM-055 and PLN-001"))
    _docx(corpus / "ECR-577 - Change of bolt_A(1).docx", _p("see BOM-055 and PLN-001"))
    _docx(corpus / "PLN-002 - Nothing.docx", "")
    (corpus / "~$M-055.docx").write_bytes(b"lock")
    path = str(tmp_path / "index")
    stats = build_index(spark, str(corpus), path)
    assert (stats["files"], stats["documents"], stats["duplicates_skipped"], stats["empty_docs"], stats["dangling_refs"]) == (5, 4, 1, 1, 1)
    set_meta(spark, path, "embed_model", "m")
    index = open_index(spark, path)
    assert dict((r.key, r.value) for r in index["meta"].collect())["embed_model"] == "m"
    tools = Tools(index)
    assert tools.search_catalog(doc_type="bom")["count"] == 1
    assert tools.search_catalog("bill of materails")["documents"][0]["doc_id"] == "BOM-055"
    assert tools.search_catalog("510(k) summary")["count"] == 0
    assert tools.search_content("leakage bolt", include_superseded=True)["count"] >= 1
    assert "| bolt | 4 |" in tools.read_document("bom 55")["text"] and "- item" in tools.read_document("BOM-055")["text"]
    assert tools.read_document("PLN-002")["is_empty"]
    assert [r["doc_id"] for r in tools.get_references("ecr577", "out")["references"]] == ["BOM-055", "PLN-001"]
    assert "error" in tools.search_content("?!") and "error" in tools.search_content("x", mode="semantic")
    # the index and the query are stemmed alike
    assert tools.search_content("tested leakages", include_superseded=True)["count"] == tools.search_content("testing", include_superseded=True)["count"] == 1
    assert tools.read_document("BOM-055", "Z")["error"] and tools.read_document("nothing 9")["error"]
    assert "sections" in tools.read_document("BOM-055", section="absent") and "leakage" in tools.read_document("BOM-055", "a", section="sco")["text"]
    with pytest.raises(FileNotFoundError):
        open_index(spark, str(tmp_path / "none"))


def test_stream_appends_once(spark, tmp_path):
    corpus, path = tmp_path / "corpus", str(tmp_path / "index")
    corpus.mkdir()
    _docx(corpus / "BOM-055 - Parts list_A.docx", _p("Scope", "Heading1") + _p("leakage test"))
    build_index(spark, str(corpus), path)
    _docx(corpus / "ECR-577 - Change of bolt_A.docx", _p("quixotic bolt"))
    _docx(corpus / "ECR-577 - Change of bolt_A(1).docx", _p("quixotic bolt"))
    _docx(corpus / "no identifier.docx", _p("lost"))
    (corpus / "~$M-055.docx").write_bytes(b"lock")
    # the second query has its own checkpoint: it reads every file again
    for run in ("a", "b"):
        append_stream(spark, str(corpus), path, str(tmp_path / run)).awaitTermination()
        index = open_index(spark, path)
        assert sorted((r.doc_id, r.revision) for r in index["documents"].collect()) == [("BOM-055", "A"), ("ECR-577", "A")]
        assert (index["chunks"].count(), index["figures"].first().total, index["defaults"].count()) == (2, 2, 2)
        assert index["postings"].where("chunk_id = 'ECR-577@A#0'").count() == 2
    assert Tools(index).search_content("quixotic")["count"] == 1


def test_a_failed_build_leaves_the_index(spark, tmp_path):
    corpus, path = tmp_path / "corpus", str(tmp_path / "index")
    corpus.mkdir()
    _docx(corpus / "BOM-055 - Parts list_A.docx", _p("one"))
    build_index(spark, str(corpus), path)
    names = [f"no identifier {i:02d}.docx" for i in range(25)]
    for n in names:
        _docx(corpus / n, _p("x"))
    with pytest.raises(ValueError) as e:
        build_index(spark, str(corpus), path)
    assert all(n in str(e.value) for n in names)
    assert open_index(spark, path)["documents"].count() == 1


def test_merged_cells_and_unreadable_files(spark, tmp_path):
    corpus, path = tmp_path / "corpus", str(tmp_path / "index")
    corpus.mkdir()
    tc = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{_p(text)}</w:tc>"
    inner = f"<w:tc><w:tbl><w:tr>{tc('inside')}</w:tr></w:tbl>{_p('outer')}</w:tc>"
    rows = (tc("a", '<w:vMerge w:val="restart"/>') + tc("b"), tc("", "<w:vMerge/>") + tc("c"), tc("wide", '<w:gridSpan w:val="2"/>'), inner + tc("d"))
    _docx(corpus / "BOM-055 - Parts_A.docx", "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>")
    (corpus / "ECR-001 - Broken_A.docx").write_bytes(b"no archive")
    (corpus / "PLN-001 - Plan_A.docx").write_bytes(b"no archive")
    _docx(corpus / "PLN-001 - Plan_A(1).docx", _p("the copy can be read"))
    stats = build_index(spark, str(corpus), path)
    index = open_index(spark, path)
    assert index["chunks"].where("doc_id = 'BOM-055'").first().text.split("\n")[2:] == ["| a | c |", "| wide | wide |", "| outer | d |"]
    assert (stats["files"], stats["documents"], stats["unreadable"]) == (4, 2, 2)
    assert {r.filename: r.outcome for r in index["files"].collect()}["PLN-001 - Plan_A(1).docx"] == "kept"
    assert index["files"].where("error is not null").count() == 2


def test_exact_identifier_among_many_siblings(spark):
    rows = [(f"ECR-P{i:02d}-007", "A", "t", "ECR", False, False, False, None) for i in range(1, 40)]
    ddl = "doc_id string, revision string, title string, type_prefix string, is_signed boolean, is_obsolete boolean, is_empty boolean, sw_version string"
    c = catalog.chains(spark.createDataFrame(rows, ddl))
    assert reading.locate(c, "ecr p39 007").first()["doc_id"] == "ECR-P39-007"
    assert reading.locate(c, "ecr 7").first()["outcome"] == "unknown"


def test_embeddings_are_filled_in_once(spark, tmp_path):
    corpus, path = tmp_path / "corpus", str(tmp_path / "index")
    corpus.mkdir()
    _docx(corpus / "BOM-055 - Parts_A.docx", _p("bolt bolt"))
    _docx(corpus / "ECR-001 - Change_A.docx", _p("screw"))
    build_index(spark, str(corpus), path)

    def embed(texts):
        return [[float(t.count("bolt")), float(t.count("screw")) + 0.1] for t in texts]

    assert backfill_embeddings(spark, path, embed, "count") == 2
    assert backfill_embeddings(spark, path, embed, "count") == 0
    with pytest.raises(ValueError):
        backfill_embeddings(spark, path, embed, "other")
    index = open_index(spark, path)
    assert index["embeddings"].count() == 2
    got = Tools(index, embed).search_content("bolt", mode="semantic")
    assert [r["doc_id"] for r in got["results"]] == ["BOM-055", "ECR-001"]


def test_cases(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("- {id: one, query: bolts, expect: {count: 3}}\n- {id: two, query: q}\n")
    got = evals.load_cases(spark, str(tmp_path / "*.yaml")).collect()
    assert [(r.id, r.query, r.expect) for r in got] == [("one", "bolts", '{"count": 3}'), ("two", "q", None)]
    assert evals.load_cases(spark, str(tmp_path / "none*.yaml")).count() == 0
