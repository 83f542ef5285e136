"""The command line over a small index."""

import json

from corpusmill.__main__ import main


def test_index_search_evaluate_report(spark, tmp_path, capsys):
    ddl = "doc_id string, page_number int, text string, tables array<string>, headings array<string>, char_count int, text_quality double, source_file string"
    rows = [("d1", 1, "Revenue grew because apples sold well in every region this year.", ["| a | b |\n| - | - |\n| many long cells | with numbers 12 |"], ["Revenue"], 64, 1.0, "/in/a.pdf"), ("d2", 1, "Costs of bananas and cherries fell while transport became dearer again.", [], [], 70, 1.0, "/in/b.pdf")]
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "pages"))
    where = str(tmp_path / "index")
    assert main(["index", str(tmp_path / "pages"), where]) == 0
    assert "3 points" in capsys.readouterr().out
    assert main(["search", where, "apples", "--strategy", "bm25"]) == 0
    out = capsys.readouterr().out
    assert "[a.pdf, p. 1, Revenue]" in out and "apples" in out
    assert main(["search", where, "unheard", "--strategy", "bm25"]) == 1
    assert "no results" in capsys.readouterr().out
    assert main(["search", where]) == 2
    gold = tmp_path / "gold.json"
    from corpusmill.operators import index

    cid = index.open_index(spark, where).where("doc_id = 'd2'").first()["chunk_id"]
    gold.write_text(json.dumps({"queries": [{"query": "bananas", "relevant_chunk_ids": [cid], "note": ""}]}))
    assert main(["evaluate", where, str(gold), "--strategy", "bm25", "--ks", "1,3", "--out", str(tmp_path / "report.json"), "--text", str(tmp_path / "report.txt")]) == 0
    out = capsys.readouterr().out
    assert "    1   1.000      1.000" in out and out.strip() == (tmp_path / "report.txt").read_text().strip()
    saved = json.loads((tmp_path / "report.json").read_text())
    assert saved["retrieval_settings"]["strategy"] == "bm25" and saved["mean_recall"] == {"1": 1.0, "3": 1.0} and saved["mean_mrr"] == 1.0
    assert [(q["query"], q["retrieved_chunk_ids"], q["recall_at_k"]) for q in saved["per_query"]] == [("bananas", [cid], {"1": 1.0, "3": 1.0})]
    assert main(["report", where]) == 0
    assert "d1" in capsys.readouterr().out
    assert main(["token-limits", where]) == 0 and main(["smoke", where]) == 0
    assert "3 points, 0 broken, a text finds itself: True" in capsys.readouterr().out
    assert main(["compare", str(tmp_path / "pages"), "--size", "100"]) == 0
    assert "structure_aware" in capsys.readouterr().out
    assert main(["erase", where, "d1"]) == 0
    assert "2 points deleted" in capsys.readouterr().out
    assert {r["doc_id"] for r in index.open_index(spark, where).collect()} == {"d2"}
    assert main(["erase", where, "d1"]) == 0 and "0 points" in capsys.readouterr().out


def test_ingest_of_a_folder(spark, tmp_path, capsys):
    from tests.test_pdf import sample

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(sample())
    (tmp_path / "in" / "deep" / "copy.PDF").write_bytes(sample())
    (tmp_path / "in" / "broken.pdf").write_bytes(b"no file of this kind")
    (tmp_path / "in" / "locked.pdf").write_bytes(sample(b"/Encrypt 9 0 R"))
    pages = str(tmp_path / "pages")
    assert main(["ingest", str(tmp_path / "in"), pages]) == 1
    got = capsys.readouterr()
    assert "processed:, 2 files" in got.out and "failed:, 2 files" in got.out and "not a PDF" in got.err and "encrypted" in got.err
    rows = spark.read.parquet(pages).orderBy("page_number").collect()
    assert [r["page_number"] for r in rows] == [1, 2] and rows[0]["tables"] == ["| Item | 2023 | 2022 |\n| --- | --- | --- |\n| Sales | 10 | 9 |"]
    assert rows[0]["headings"] == ["First part"] and "Quarterly figures" not in rows[0]["text"] and "joined words" in rows[0]["text"]
    assert main(["ingest", str(tmp_path / "in"), pages]) == 1
    assert "skipped:, 2 files" in capsys.readouterr().out
    assert spark.read.parquet(pages).count() == 2
    assert main(["index", pages, str(tmp_path / "index")]) == 0
