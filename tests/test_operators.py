"""Pinned values and small references for single operators."""

import hashlib
import math
import random
import re
import uuid
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.packing import Packer, QuarterTokens
from corpusmill.operators import chunking, embed, evaluate, evidence, headings, index, layout, provider, reports, retrieval, service
from corpusmill.sources import files
from corpusmill.streaming import incremental

DOC = "doc_" + "a" * 64
PAGE_DDL = "doc_id string, page_number int, text string, tables array<string>, headings array<string>, text_quality double"


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    return row.select(column.alias("v")).first()["v"]


def pages(spark, *rows):
    return spark.createDataFrame([(DOC, n, t, tables, heads, q) for n, t, tables, heads, q in rows], PAGE_DDL)


@pytest.fixture(scope="module")
def trio(spark):
    rows = [("c1", "doc_a", "red apple", "text"), ("c2", "doc_a", "blue berry", "text"), ("c3", "doc_b", "lemon orange", "text")]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, chunk_type string")


def ask(spark, *queries):
    return spark.createDataFrame([(str(k), q) for k, q in enumerate(queries)], "query_id string, query string")


def test_bm25_pin(spark, trio):
    hit = retrieval.bm25(ask(spark, "apple"), trio).collect()
    assert len(hit) == 1 and hit[0]["score"] == pytest.approx(0.9808292530117263)
    assert retrieval.bm25(ask(spark, "apple berry"), trio).count() == 2
    assert retrieval.bm25(ask(spark, "apple berry"), trio, min_score=2.0).count() == 0
    assert retrieval.bm25(ask(spark, "unknown"), trio).count() == 0


def test_bm25_statistics_follow_the_filter(spark, trio):
    hit = retrieval.bm25(ask(spark, "apple"), trio, doc_id="doc_a").first()
    assert hit["score"] == pytest.approx(math.log(1 + 1.5 / 1.5))


def test_bm25_ties_by_id(spark):
    rows = spark.createDataFrame([("b", "same words"), ("a", "same words")], "chunk_id string, text string")
    assert [r["chunk_id"] for r in retrieval.bm25(ask(spark, "words"), rows).orderBy("rank").collect()] == ["a", "b"]


@pytest.mark.parametrize("bad", [0, 101, True, 2.0])
def test_top_k_is_checked(bad):
    with pytest.raises(ValueError):
        retrieval.validate_top_k(bad)


def test_fusion_ties_and_scale(spark):
    one = spark.createDataFrame([("q", "d", 1)], "query_id string, chunk_id string, rank int")
    two = spark.createDataFrame([("q", "b", 1)], "query_id string, chunk_id string, rank int")
    rows = retrieval.fuse(one, two).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["b", "d"]  # a missing dense rank sorts first
    assert rows[0]["score"] == pytest.approx(60 / 61)


def test_rerank_pin_and_bad_scores(spark):
    hits = spark.createDataFrame([("q", "x", 2), ("q", "y", 1)], "query_id string, chunk_id string, rank int")
    q = spark.createDataFrame([("q", "q")], "query_id string, query string")
    texts = spark.createDataFrame([("x", "txt_0"), ("y", "txt_1")], "chunk_id string, text string")
    rows = retrieval.rerank(hits, q, texts, retrieval.RerankConfig()).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["y", "x"] and rows[0]["score"] == pytest.approx(142.85714285714286)
    with pytest.raises(Exception, match="finite"):
        retrieval.rerank(hits, q, texts, retrieval.RerankConfig(), lambda a, b: F.lit(float("nan"))).collect()


def test_dense_plan_ranks_within_groups(spark):
    points = spark.createDataFrame([(str(k), [float(k), 1.0]) for k in range(30)], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    got = retrieval.dense(q, points, top_k=3)
    assert [r["chunk_id"] for r in got.orderBy("rank").collect()] == ["29", "28", "27"]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_metric_pins(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    ranking = spark.createDataFrame([("a", "c1", 1), ("b", "c3", 1), ("b", "c2", 2), ("b", "c1", 3)], "query_id string, chunk_id string, rank int")
    gold = spark.createDataFrame([("a", "c1"), ("a", "c2"), ("b", "c1")], "query_id string, chunk_id string")
    got = {(r["query_id"], r["k"]): (r["precision"], r["recall"]) for r in evaluate.at_k(q, ranking, gold, (2, 3)).collect()}
    assert got["a", 2] == (1.0, 0.5) and got["b", 2] == (0.0, 0.0) and got["c", 3] == (0.0, 0.0)
    mrr = {r["query_id"]: r["reciprocal_rank"] for r in evaluate.reciprocal_ranks(q, ranking, gold).collect()}
    assert mrr == {"a": 1.0, "b": pytest.approx(1 / 3), "c": 0.0}


def test_point_ids_are_uuid5(spark):
    assert value(spark, X.point_id(F.col("x")), x="chunk_é") == str(uuid.uuid5(uuid.UUID("00000000-0000-0000-0000-000000000001"), "chunk_é"))


@pytest.mark.parametrize(("text", "mid"), [("", False), ("  ", False), ("This is a", True), ('He said "yes."', False), ('He said "', True), ('")', True)])
def test_sentence_completeness(spark, text, mid):
    assert value(spark, X.ends_mid_sentence(F.col("x")), x=text) is mid


def test_quality(spark):
    assert value(spark, X.quality(F.col("x")), x="") == 1.0
    assert 0 < value(spark, X.quality(F.col("x")), x="text (cid:123) �\x01") < 1


def test_clean_text(spark):
    assert value(spark, X.clean(F.col("x")), x="ﬁve inter-\n national\u00ad  x\ue000") == "five international x"


@pytest.mark.parametrize(("path", "name"), [("/a/b.pdf", "b.pdf"), ("C:\\raw\\x.pdf", "x.pdf"), ("x.pdf", "x.pdf"), ("", "")])
def test_source_names(spark, path, name):
    assert value(spark, X.source_file(F.col("x")), x=path) == name


@pytest.mark.parametrize(("name", "safe"), [("a.pdf", True), ("A b.PDF", True), ("con.pdf", False), ("../a.pdf", False), (".a.pdf", False), ("a.txt", False), (" a.pdf", False), ("a" * 120 + ".pdf", False)])
def test_filenames(spark, name, safe):
    assert value(spark, X.is_safe_filename(F.col("x")), x=name) is safe


def test_citations(spark):
    row = spark.createDataFrame([("f.pdf", 7, 8, "Revenue"), ("f.pdf", 3, 1, ""), ("f.pdf", 2, 2, None)], "f string, a int, b int, h string")
    got = [r[0] for r in row.select(X.citation(F.col("f"), F.col("a"), F.col("b"), F.col("h"))).collect()]
    assert got == ["[f.pdf, pp. 7-8, Revenue]", "[f.pdf, p. 3]", "[f.pdf, p. 2]"]


def test_chunks_are_bounded_and_repeatable(spark):
    page = pages(spark, (1, "A short sentence. " * 200, None, None, 1.0), (2, "�" * 50, ["| a |\n| - |\n| b |"], None, 0.1))
    for strategy in chunking.STRATEGIES:
        rows = chunking.chunk_pages(page, strategy, 100, 10, 10).orderBy("chunk_index").collect()
        assert rows == chunking.chunk_pages(page, strategy, 100, 10, 10).orderBy("chunk_index").collect()
        # fixed_size adds up rounded-down counts of sentences, so the estimate of the whole may be a little more
        assert len(rows) > 1 and max(r["token_count"] for r in rows) <= (125 if strategy == "fixed_size" else 100) and {r["page_start"] for r in rows} == {1}
        assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    with pytest.raises(ValueError, match="unknown"):
        chunking.chunk_pages(page, "other")


def test_table_chunks_repeat_the_header():
    table = "\n".join(["| a | b |", "| --- | --- |", *(f"| row {k} | {k * k} |" for k in range(100))])
    got = Packer(100, 10, 10).table(table)
    assert len(got) > 1 and all(c.startswith("| a | b |\n| --- | --- |\n") for c in got)
    assert sum(c.count("| row") for c in got) == 100
    assert Packer(100, 10, 3).table("| one line table |") == ["| one line table |"]


def test_oversized_end_is_given_twice():
    text = "x" * 900
    assert Packer(100, 10, 10).by_sentence(text) == [text, text[:400], text[400:800], text[800:]]


def test_merge_keeps_a_large_first_part():
    p = Packer(100, 10, 10)
    assert p.merge(["y" * 1000, "tail of text that is long enough to count as a chunk."])[0] == "y" * 1000


def test_zero_overlap_carries_everything():
    p = Packer(20, 0, 1)
    first, second = "a" * 76 + ".", "b" * 40 + "."
    assert p.by_sentence(f"{first} {second}")[1].startswith(first)
    assert QuarterTokens().tail("abcdefgh", 1) == "efgh"


def test_sections():
    p = Packer(100, 10, 1)
    text = "Preamble text here.\nFIRST SECTION\nBody of it.\nORPHAN HEADING\n"
    assert p.sections(text) == [(None, "Preamble text here."), ("FIRST SECTION", "FIRST SECTION\n\nBody of it.")]
    flat = "Before Risk Factors after"
    assert p.sections(flat, ["Risk Factors"]) == [("Risk Factors", "Risk Factors\n\nBefore\nafter")]


def test_coalesce():
    p = Packer(100, 10, 10)
    assert p.coalesce(["a" * 80, "tiny"]) == ["a" * 80 + "\n\ntiny"]
    assert p.coalesce(["tiny", "a" * 80]) == ["tiny\n\n" + "a" * 80]
    assert p.coalesce(["tiny"]) == []


def attach(spark, page_rows, chunk_rows):
    chunks = spark.createDataFrame([(f"k{n}", DOC, t, "text", page, page, None, None, 1, 1.0, n) for n, (page, t) in enumerate(chunk_rows)], "chunk_id string, doc_id string, text string, chunk_type string, page_start int, page_end int, section_heading string, subheading string, token_count int, text_quality double, chunk_index int")
    got = headings.attach_headings(chunks, pages(spark, *page_rows)).orderBy("chunk_index").collect()
    return [(r["section_heading"], r["subheading"]) for r in got]


def test_headings_carry_forward(spark):
    assert attach(spark, [(1, "Overview body one", [], ["Overview"], 1.0), (2, "body two", [], [], 1.0)], [(1, "Overview body one"), (2, "body two")]) == [("Overview", None)] * 2


def test_no_heading_before_the_first(spark):
    rows = [(1, "plain start", [], [], 1.0), (2, "Item 1. Business text", [], ["Item 1. Business"], 1.0)]
    assert attach(spark, rows, [(1, "plain start"), (2, "Item 1. Business text")]) == [(None, None), ("Item 1. Business", None)]


def test_item_structure_and_subheading(spark):
    rows = [(1, "Item 1. Business text Item 2. Properties more", [], ["Item 1. Business", "Item 2. Properties"], 1.0), (2, "Item 3. Legal then Competition and rest of the page", [], ["Item 3. Legal", "Competition"], 1.0)]
    got = attach(spark, rows, [(1, "Item 1. Business text Item 2. Properties more"), (2, "and rest of the page")])
    assert got == [("Item 2. Properties", None), ("Item 3. Legal", "Competition")]


@pytest.mark.parametrize("bad", ["Balance Sheets Data:", "(a) Notes", "(In thousands)", "2013 and 2012", "x" * 61, "NPS INC."])
def test_rejected_headings(spark, bad):
    assert attach(spark, [(1, f"{bad} body", [], [bad], 1.0)], [(1, "body")]) == [(None, None)]


def test_page_quality_of_chunks(spark):
    p = pages(spark, (1, "a", [], [], 0.5), (2, "b", [], [], 1.0))
    chunks = spark.createDataFrame([("k", DOC, 1, 2, 0.9), ("m", "other", 1, 1, 0.9)], "chunk_id string, doc_id string, page_start int, page_end int, text_quality double")
    assert {r["chunk_id"]: r["text_quality"] for r in chunking.with_page_quality(chunks, p).collect()} == {"k": 0.75, "m": 0.9}


def test_token_stats_pins(spark):
    rows = spark.createDataFrame([(k,) for k in range(1, 101)], "token_count int")
    got = embed.token_stats(rows, []).first()
    assert (got["median"], got["p95"], got["p99"]) == (51, 96, 100)
    got = embed.token_stats(spark.createDataFrame([(3,), (2,), (600,)], "token_count int"), []).first()
    assert (got["n_over"], got["p99"]) == (1, 600)


@pytest.mark.parametrize(("grid", "usable"), [([["prose"], ["more"]], False), ([["a", None, None, None], ["b", "", None, None], ["c", None, None, None]], False), ([["a", "b"], [None, "c"]], True), ([["a", "b", "c", "d"], ["e", "f", None, None]], True)])
def test_usable_tables(spark, grid, usable):
    row = spark.createDataFrame([(grid,)], "g array<array<string>>")
    assert row.select(layout.is_usable_table(F.col("g"))).first()[0] is usable


def test_markdown(spark):
    row = spark.createDataFrame([([["a", "b|c"], ["d"]],)], "g array<array<string>>")
    assert row.select(layout.markdown(F.col("g"))).first()[0] == "| a | b\\|c |\n| --- | --- |\n| d |  |"


def test_page_numbers_at_edges(spark):
    for text, is_number in (("Page 3", True), ("3 of 10", True), ("4/10", True), ("3 apples", False)):
        assert value(spark, X.is_page_number(X.frequency_key(F.col("x"))), x=text) is is_number


def test_sync_converges(spark):
    fields = "id string, doc_id string, source_file string, subheading string"
    target = spark.createDataFrame([("1", "d", "new.pdf", None), ("2", "d", "new.pdf", "")], fields)
    stored = spark.createDataFrame([("1", "d", "old.pdf", ""), ("3", "d", "x", None)], fields)
    names = ["source_file", "subheading"]
    assert {r["id"]: r["action"] for r in index.sync_actions(target, stored, names).collect()} == {"1": "patch", "2": "upsert", "3": "delete"}
    assert index.sync_counts(target, stored, names).first().asDict() == {"upserted": 1, "deleted": 1, "skipped": 1, "payload_updated": 1}
    again = index.sync_counts(target, target, names).first().asDict()
    assert again == {"upserted": 0, "deleted": 0, "skipped": 2, "payload_updated": 0}


def test_index_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("1", "d", "text", [1.0, 2.0])], "id string, doc_id string, chunk_type string, vector array<float>")
    index.write_index(points, str(tmp_path / "i"), 2, "hash")
    assert index.open_index(spark, str(tmp_path / "i"), 2, "hash").count() == 1
    with pytest.raises(ValueError, match="dimension"):
        index.open_index(spark, str(tmp_path / "i"), 3)


def test_binary_scan_and_reader_plugin(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a_b.PDF").write_bytes(b"%PDF-good")
    (tmp_path / "in/bad.pdf").write_bytes(b"nope")
    (tmp_path / "in/no.txt").write_bytes(b"x")
    found = files.discover_pdfs(spark, str(tmp_path / "in"))
    assert {r["stem"] for r in found.collect()} == {"a_b", "bad"}

    def reader():
        def read(content):
            if not content.startswith(b"%PDF-"):
                raise ValueError("corrupt")
            return [{"page_number": 2, "text": "hello", "font_sizes": [10.0], "has_bold_span": False}]

        return read

    got = {r["status"]: r for r in files.read_blocks(found, reader).collect()}
    assert got["processed"]["page_number"] == 2 and "corrupt" in got["failed"]["error"]


def test_gold_and_query_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"queries": [{"query": "q", "relevant_chunk_ids": ["b", "a", "b"], "note": ""}]}')
    row = files.read_gold_set(spark, str(tmp_path / "g.json")).first()
    assert row["relevant_chunk_ids"] == ["a", "b"] and re.fullmatch("[0-9a-f]{12}", row["version"])
    (tmp_path / "q.txt").write_text("# no\n\n  one \ntwo\n")
    assert [r["query"] for r in files.read_query_file(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]


def test_reply_parsing(spark):
    good = '{"status": "answered", "selections": [{"evidence_id": "E1", "quote": "x"}]}'
    bad = ['{"status": "other", "selections": []}', '{"status": "answered", "selections": [], "more": 1}', "not json", '{"status": "answered"}', '{"status": "answered", "selections": [{"evidence_id": "", "quote": "x"}]}']
    rows = spark.createDataFrame([(str(k), r) for k, r in enumerate([good, *bad])], "query_id string, reply string")
    assert {r["query_id"] for r in evidence.parsed(rows).where("valid").collect()} == {"0"}


def test_conflicting_duplicates_are_an_error(spark):
    fields = "query_id string, chunk_id string, doc_id string, source_file string, page_start int, page_end int, text string, section_heading string, rank int"
    hits = spark.createDataFrame([("q", "c", "d", "f", 1, 1, "one", None, 1), ("q", "c", "d", "f", 1, 1, "two", None, 2)], fields)
    with pytest.raises(Exception, match="conflicting"):
        evidence.labelled(hits).collect()


def test_limiter_window_begins_with_the_first_attempt(spark):
    rows = spark.createDataFrame([(k, "u", float(t)) for k, t in enumerate((0, 1, 2, 9, 10, 11))], "event_id long, key string, at double")
    got = {r["event_id"]: r["allowed"] for r in incremental.limit_attempts(rows, 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_streaming_sync(spark, tmp_path):
    fields = "id string, doc_id string, text string"
    spark.createDataFrame([("1", "d", "one"), ("2", "e", "two")], fields).write.parquet(str(tmp_path / "in"))
    state = {"points": spark.createDataFrame([("0", "d", "old", [0.0])], f"{fields}, vector array<float>")}

    def store(df):
        df.write.mode("overwrite").parquet(str(tmp_path / "out"))
        state["points"] = spark.read.parquet(str(tmp_path / "out"))

    stream = spark.readStream.schema(fields).parquet(str(tmp_path / "in"))
    q = incremental.sync_stream(stream, lambda: state["points"], store, embed.hash_embedding, str(tmp_path / "cp"), ["text"], availableNow=True)
    q.awaitTermination(120)
    assert {r["id"] for r in state["points"].collect()} == {"1", "2"}


PAYLOAD = "chunk_id string, doc_id string, source_file string, page_start int, page_end int, section_heading string, subheading string, chunk_type string, text string"


@pytest.fixture(scope="module")
def points(spark):
    rows = [("c1", "d", "a.pdf", 1, 2, "Revenue", None, "text", "apple banana revenue rose"), ("c2", "d", "a.pdf", 3, 3, None, None, "text", "banana cherry costs fell"), ("c3", "e", "b.pdf", 1, 1, "", None, "table", "durian")]
    return spark.createDataFrame(rows, PAYLOAD).withColumn("vector", embed.hash_embedding(F.col("text")))


def test_retrieve_by_strategy(spark, points):
    q = ask(spark, " banana ").withColumn("vector", embed.hash_embedding(F.col("query")))
    for strategy in service.RETRIEVERS:
        hits = service.retrieve(q, points, service.Request(strategy, top_k=2)).orderBy("rank").collect()
        assert [h["rank"] for h in hits] == [1, 2] and {h["retriever"] for h in hits} == {strategy}
    hits = service.retrieve(q, points, service.Request("bm25", top_k=1, rerank=True)).collect()
    assert len(hits) == 1 and hits[0]["retriever"] == "reranked"
    assert service.retrieve(q, points, service.Request("bm25", chunk_type="table")).count() == 0
    with pytest.raises(ValueError, match="strategy"):
        service.Request("other")
    with pytest.raises(ValueError, match="candidates"):
        service.Request("bm25", top_k=30, rerank=True)
    with pytest.raises(Exception, match="blank"):
        service.retrieve(ask(spark, "  "), points).collect()


def test_answers(spark, points):
    import json

    q = ask(spark, "banana revenue", "durian", "nothing here", "cherry")
    hits = service.retrieve(q, points, service.Request("bm25"))

    def client():
        def reply(system, user):
            body = json.loads(user)
            first = body["evidence"][0]
            if "durian" in body["question"]:
                return json.dumps({"status": "insufficient_evidence", "selections": []})
            quote = "not in it" if "cherry" in body["question"] else first["text"][:5]
            return json.dumps({"status": "answered", "selections": [{"evidence_id": first["evidence_id"], "quote": quote}]})

        return reply

    got = {r["query_id"]: r for r in service.answer(q, hits, client).collect()}
    assert got["0"]["status"] == "answered" and got["0"]["answer"] == 'The retrieved documents state:\n\n"apple" [a.pdf, pp. 1-2, Revenue]'
    assert (got["1"]["status"], got["1"]["reason"]) == ("insufficient_evidence", "model_abstained")
    assert (got["2"]["status"], got["2"]["reason"]) == ("insufficient_evidence", "no_evidence")
    assert (got["3"]["status"], got["3"]["answer"]) == ("invalid_response", None)


def test_document_states(spark):
    def log(doc, *events):
        return [(doc, k, e) for k, e in enumerate(events)]

    rows = [*log("a", "accept", "start", "parsed", "indexed"), *log("b", "accept", "accept", "start", "error", "accept"), *log("c", "accept", "delete", "indexed"), *log("d", "accept", "start", "parsed", "uncertain"), *log("e", "indexed")]
    got = {r["doc_id"]: (r["status"], r["readable"]) for r in service.document_states(spark.createDataFrame(rows, "doc_id string, seq int, event string")).collect()}
    assert got == {"a": ("ready", True), "b": ("queued", True), "c": ("deleting", False), "d": ("cleanup_required", False), "e": ("none", True)}


def test_grids_become_page_tables(spark):
    content = spark.createDataFrame([("d", bytearray(b"x")), ("e", bytearray(b"bad"))], "doc_id string, content binary")

    def reader():
        def read(data):
            if data == b"bad":
                raise ValueError("no tables")
            return [(1, [["a", "b"], ["c", None]]), (1, [["prose"]])]

        return read

    grids = files.read_grids(content, reader)
    assert grids.where("error is not null").select("doc_id").first()[0] == "e"
    assert files.page_tables(grids).first()["tables"] == ["| a | b |\n| --- | --- |\n| c |  |"]


def test_model_token_summary(spark):
    rows = spark.createDataFrame([("d", "text", 10, 12), ("d", "text", 20, 18), ("d", "table", 1, 900)], "doc_id string, chunk_type string, token_count int, model_tokens int")
    got = reports.model_token_summary(rows, ["doc_id"], 15).first()
    assert (got["n"], got["n_over"], got["median_model_tokens"], got["median_ratio"]) == (2, 1, 15.0, pytest.approx(1.05))


def test_dense_with_many_queries_equals_dense_with_few(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").cast("string").alias("chunk_id"), embed.hash_embedding(F.col("id").cast("string"), 8).alias("vector"))
    asked = rows.where("cast(chunk_id as int) % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    want = sorted(map(str, retrieval.dense(asked, rows, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert sorted(map(str, retrieval.dense(asked, rows, 4).collect())) == want


class HalfScorer:
    """Scores by length, a batch at a time; one too few where told to."""

    def __init__(self, short=False):
        self.short = short

    def load(self):
        def predict(pairs):
            assert len(pairs) <= 2
            return [1.0 / (len(q) + len(t)) for q, t in pairs][: len(pairs) - self.short]

        return predict


def test_cross_encoder_in_batches(spark):
    q = spark.createDataFrame([("q", "ab")], "query_id string, query string")
    index = spark.createDataFrame([(str(k), "x" * (9 - k)) for k in range(7)], "chunk_id string, text string")
    hits = spark.createDataFrame([("q", str(k), 1.0, k + 1) for k in range(7)], "query_id string, chunk_id string, score double, rank int")
    config = retrieval.RerankConfig(7, 3, batch_size=2)
    assert [r["chunk_id"] for r in retrieval.rerank(hits, q, index, config, HalfScorer()).orderBy("rank").collect()] == ["6", "5", "4"]
    with pytest.raises(Exception, match="scores for"):
        retrieval.rerank(hits, q, index, config, HalfScorer(short=True)).collect()


def test_rerank_settings_come_from_those_given_then_the_environment(monkeypatch):
    monkeypatch.delenv("RERANKER_MODEL", raising=False)
    assert retrieval.RerankConfig().model_name == retrieval.RERANKER and retrieval.RerankConfig(model_name=" own ").model_name == "own"
    monkeypatch.setenv("RERANKER_MODEL", "other")
    monkeypatch.setenv("RERANKER_TOP_K", "no number")
    monkeypatch.setenv("RERANKER_BATCH_SIZE", "8")
    assert retrieval.RerankConfig(model_name="  ").model_name == "other"
    got = retrieval.RerankConfig.from_env(top_k=3)
    assert (got.top_k, got.batch_size, got.model_name, got.candidate_count) == (3, 8, "other", 20)
    with pytest.raises(ValueError, match="invalid literal"):
        retrieval.RerankConfig.from_env()
    for bad in ({"top_k": 0}, {"candidate_count": 2}, {"batch_size": 0}, {"model_name": 3}):
        with pytest.raises(ValueError, match="must"):
            retrieval.RerankConfig(**bad)


class Vectors:
    dimension, model_name = 2, "test"

    def __init__(self, wrong=""):
        self.wrong = wrong

    def load(self):
        def encode(texts, is_query):
            assert len(texts) <= 3 and all(t.startswith("find: ") == is_query for t in texts)
            rows = [[3.0, 4.0] for _ in texts]
            return rows[1:] if self.wrong == "count" else [r + [1.0] for r in rows] if self.wrong == "dimension" else [[float("nan"), 1.0] for _ in texts] if self.wrong == "nan" else rows

        return encode


def test_embedders_are_checked_and_normalised(spark):
    df = spark.createDataFrame([(f"t{k}",) for k in range(7)] + [(None,)], "t string").coalesce(1)
    for is_query in (False, True):
        got = df.select(embed.embedding_udf(Vectors(), is_query, 3, "find: ")("t").alias("v")).collect()
        assert len(got) == 8 and all(r["v"] == pytest.approx([0.6, 0.8]) for r in got)
    assert df.select(embed.embedding_udf(Vectors(), normalise=False, batch=3)("t").alias("v")).first()["v"] == [3.0, 4.0]
    for wrong in ("count", "dimension", "nan"):
        with pytest.raises(Exception, match="no . finite vectors"):
            df.select(embed.embedding_udf(Vectors(wrong), batch=3)("t")).collect()


def test_generation_settings():
    ok = provider.GenerationConfig("m")
    assert provider.GenerationConfig.from_env({"RAG_LLM_MODEL": "m"}) == ok
    got = provider.GenerationConfig.from_env({"RAG_LLM_MODEL": "m", "RAG_MAX_EVIDENCE_CHUNKS": "5", "RAG_LLM_TIMEOUT_SECONDS": "1.5", "RAG_LLM_PROVIDER": "local"})
    assert (got.max_chunks, got.timeout_seconds, got.provider) == (5, 1.5, "local")
    bad = [{"model": ""}, {"model": " m"}, {"provider": "x"}, {"timeout_seconds": 0}, {"timeout_seconds": float("inf")}, {"timeout_seconds": float("nan")}, {"max_chunks": 0}, {"max_chunks": 101}, {"max_chunks": True}, {"max_output_tokens": 63}, {"max_response_bytes": 1 << 21}, {"max_evidence_chars": 1.5}]
    bad += [{"base_url": u} for u in ("ftp://h", "http://", "http://u:p@h", "http://h/x", "http://h?q", "http://h#f", "h:1")]
    for more in bad:
        with pytest.raises(ValueError):  # noqa: PT011
            provider.GenerationConfig(**({"model": "m"} | more))


def test_replies_of_a_service(spark):
    import http.server
    import json
    import threading

    seen = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(302 if "away" in str(seen[-1]) else 200)
            self.send_header("Location", "http://127.0.0.1:1/")
            self.end_headers()
            self.wfile.write(json.dumps({"done": True, "message": {"role": "assistant", "content": "hi"}}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = provider.GenerationConfig("m", base_url=f"http://127.0.0.1:{server.server_port}", max_response_bytes=1024)
    ask = provider.chat_client(config, {"type": "object"})()
    assert ask("s", "u") == "hi" and seen[0]["model"] == "m" and seen[0]["format"] == {"type": "object"} and [m["role"] for m in seen[0]["messages"]] == ["system", "user"]
    with pytest.raises(provider.ProviderError, match="cannot be asked"):
        ask("s", "away")
    server.shutdown()
    fine = {"done": True, "message": {"role": "assistant", "content": "x"}}
    for raw, why in ((b"{", "not JSON"), (b"x" * 1025, "longer"), ({**fine, "done": False}, "complete"), ({**fine, "done_reason": "length"}, "token limit"), ({"done": True}, "no text"), ({"done": True, "message": {"role": "user", "content": "x"}}, "no text"), ({"done": True, "message": {"role": "assistant", "content": " "}}, "no text"), ([], "complete")):
        with pytest.raises(provider.ProviderError, match=why):
            provider.read_envelope(raw if isinstance(raw, bytes) else json.dumps(raw).encode(), config)


def test_chunking_driver_leaves_poor_pages_out(spark):
    ddl = "doc_id string, page_number int, text string, tables array<string>, headings array<string>, char_count int, text_quality double"
    text = "Plain words that fill a page. " * 10
    rows = [("d", 1, f"Item 1. Business\n{text}", [], ["Item 1. Business"], 1, 1.0), ("d", 2, "bad " * 50, ["| a | b |\n| - | - |\n| c | d |"], ["Item 2. Bad"], 1, 0.5), ("d", 3, text, [], [], 1, 0.95)]
    chunks, skipped = chunking.chunk_documents(spark.createDataFrame(rows, ddl), "structure_aware", 60, 5, 5)
    got = chunks.orderBy("chunk_index").collect()
    assert {r["page_start"] for r in got} == {1, 3} and {r["section_heading"] for r in got} == {"Item 1. Business"}
    assert {(r["page_start"], r["text_quality"]) for r in got} == {(1, 1.0), (3, 0.95)}
    assert [tuple(r) for r in skipped.collect()] == [("d", 1)]


def test_chunks_that_contain_a_query(spark):
    docs = spark.createDataFrame([("a", "one two three four"), ("b", "xone two threex"), ("c", "one, two three"), ("d", None), ("e", "two"), ("f", "twofold")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "one two three"), ("q2", "two"), ("q3", "e two t"), ("q4", None)], "query_id string, query string")
    got = sorted(map(tuple, evaluate.containing(asked, docs).collect()))
    rows = [(r["chunk_id"], r["text"] or "") for r in docs.collect()]
    assert got == sorted((q["query_id"], k) for q in asked.collect() if q["query"] for k, t in rows if q["query"] in t)


def test_record_table_replaces_documents(spark, tmp_path):
    path = str(tmp_path / "records")
    for rows in ([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], [("a", 1, "new")], [("c", 1, "w")]):
        files.write_pages(spark.createDataFrame(rows, "doc_id string, page_number int, text string"), path)
    got = sorted((r["doc_id"], r["page_number"], r["text"]) for r in files.read_pages(spark, path).collect())
    assert got == [("a", 1, "new"), ("b", 1, "z"), ("c", 1, "w")]


def test_states_of_a_hot_document_stream(spark):
    rows = [("d", k, e) for k, e in enumerate(["accept", "start", "parsed", "indexed", "delete", "erased", "accept"] * 200)] + [("e", 0, None), ("e", 1, "start")]
    got = {r["doc_id"]: (r["status"], r["readable"]) for r in service.document_states(spark.createDataFrame(rows, "doc_id string, seq int, event string")).collect()}
    assert got == {"d": ("queued", True), "e": ("none", True)}


def test_bm25_finds_terms_once_a_scan(spark, trio):
    """A scan for lengths, and postings whose two uses share a shuffle; no branch finds the terms again."""
    plan = retrieval.bm25(spark.createDataFrame([("q", "apple berry")], "query_id string, query string"), trio)
    plan.collect()
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower(coalesce(text") == 3
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_model_token_counts(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("",), ("one",)], "t string").coalesce(1)
    count = embed.model_token_counts(lambda: lambda texts: [len(t.split()) for t in texts], 2)
    assert [r["n"] for r in df.select(count("t").alias("n")).collect()] == [3, 0, 0, 1]
    with pytest.raises(Exception, match="counts for"):
        df.select(embed.model_token_counts(lambda: lambda texts: [1])("t")).collect()


def bm25_by_hand(asked, rows, top_k):
    """query_id, chunk_id, rank and rounded score, from the postings (chunk, length, term) of rows."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    posts, lengths = Counter((k, len(words(t)), w) for k, t in rows for w in words(t)), [len(words(t)) for _, t in rows]
    df, mean, out = Counter(w for _, _, w in posts), sum(lengths) / len(lengths), []
    for q in sorted({q for q, _ in asked}):
        terms, scores = {w for i, t in asked if i == q for w in words(t)}, Counter()
        for (k, n, w), tf in posts.items():
            if w in terms:
                scores[k] += math.log1p((len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
        best = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0] or ""))[:top_k]
        out += [(q, k, r + 1, round(s, 6)) for r, (k, s) in enumerate(best)]
    return out


@pytest.mark.parametrize("block, vocabulary", [(4096, 2**15), (2, 2**15), (4096, 0)])
def test_bm25_scores_chunks_in_place(spark, monkeypatch, block, vocabulary):
    """Equal to the formula for repeated and null ids, copies, null texts and several blocks; no row is a pair of query and chunk, or of term and chunk."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "VOCABULARY", vocabulary)
    pick = random.Random(3)
    text = lambda n: " ".join(pick.choice("apple berry cherry dune élan fig 7 _x".split()) for _ in range(n))
    rows = [(f"c{k:02}", text(pick.randint(0, 9))) for k in range(40)] + [(f"d{k}", "fig fig 7") for k in range(12)]
    rows += [("c00", rows[0][1]), ("c00", "fig"), ("c00", "7"), (None, "apple"), (None, "apple berry"), ("n", None), ("e", "")]
    asked = [("q1", "Apple berry"), ("q1", "apple"), ("q2", "fig 7 7"), ("q3", "ÉLAN zzz"), ("q4", "unknown"), ("q5", None)]
    got = retrieval.bm25(spark.createDataFrame(asked, "query_id string, query string"), spark.createDataFrame(rows, "chunk_id string, text string"), 6)
    assert sorted(((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 6)) for r in got.collect()), key=str) == sorted(bm25_by_hand(asked, rows, 6), key=str)
    plan = re.sub(r"#\d+L?", "", got._jdf.queryExecution().executedPlan().toString())
    assert "hashpartitioning(query_id, chunk_id" not in plan and "hashpartitioning(term, chunk_id" not in plan


def test_bm25_scorer_in_small_pieces(spark, monkeypatch):
    """Pieces, batches that cut a chunk, and many equal scores change nothing; few rows stay in memory."""
    ids = pa.table({"id": ["q"], "terms": [["a", "b"]], "idf": [[1.0, 2.0]], "mean": [2.0]})
    rows = pa.RecordBatch.from_pydict({"id": [f"{k // 2:04}" for k in range(4000)], "terms": [["a"] if k % 6 else ["a", "b", "x"] for k in range(4000)], "length": [2] * 4000})

    def best(size):
        scorer = retrieval._Scorer(ids, 3)
        for k in range(0, 4000, size):
            scorer.add(rows.slice(k, size))
        assert sum(map(len, scorer.found)) <= retrieval.PIECE // 4 + size
        return sorted((-r["score"], r["chunk_id"]) for b in scorer.end() for r in b.to_pylist())[:3]

    want = best(4000)
    assert [k for _, k in want] == ["0000", "0003", "0006"]
    monkeypatch.setattr(retrieval, "PIECE", 64)
    assert best(7) == want == best(4000)


@pytest.fixture
def no_small_tables(spark):
    """No join sends a table to all workers unless it is told to, as with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_that_contain_a_query_stay_in_place(spark, no_small_tables, monkeypatch):
    docs = spark.createDataFrame([("a", "one two three four"), ("b", "two"), ("a", "one two three"), (None, "one two three"), ("d", None)], "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "one two three"), ("q2", "two"), ("q3", None)], "query_id string, query string")
    got, want = evaluate.containing(asked, docs), [("q1", "a"), ("q1", None), ("q2", "a"), ("q2", "b"), ("q2", None)]
    assert "SortMergeJoin" not in plan_of(got) and "Exchange hashpartitioning" not in plan_of(got)
    assert {tuple(r) for r in got.collect()} == set(want)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    many = evaluate.containing(asked, docs)
    assert "SortMergeJoin" in plan_of(many) and {tuple(r) for r in many.where("chunk_id is not null").collect()} == {r for r in want if r[1]}


def test_payloads_stay_in_place(spark, no_small_tables, monkeypatch):
    index = spark.createDataFrame([("a", "d", "f.pdf", 1, 2, "H", None, "text", "body")], "chunk_id string, doc_id string, source_file string, page_start int, page_end int, section_heading string, subheading string, chunk_type string, text string")
    hits, q = spark.createDataFrame([("0", "a", 1.0, 1)], "query_id string, chunk_id string, score double, rank int"), ask(spark, "q")
    got = retrieval.with_payload(hits, index, "bm25", q)
    assert "hashpartitioning(chunk_id" not in plan_of(got)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 0)
    for many in (retrieval.with_payload(hits, index, "bm25", q), retrieval.with_payload(hits, index, "bm25")):
        assert "hashpartitioning(chunk_id" in plan_of(many) and many.collect() == got.collect()


def test_hash_embedding_finds_the_digest_once(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string").select(embed.hash_embedding(F.col("t"), 40).alias("v"))
    assert "transform(array(sha2(" in df._jdf.queryExecution().optimizedPlan().toString()
    digest = hashlib.sha256(b"a").digest()
    assert [r["v"] for r in df.collect()] == [[digest[k % 32] / 255 for k in range(40)], [None] * 40]


def test_rerank_leaves_texts_in_place(spark, no_small_tables, monkeypatch):
    texts = spark.createDataFrame([("a", "long text of a"), ("b", "b"), ("c", "other")], "chunk_id string, text string")
    hits = spark.createDataFrame([("0", "a", 1.0, 1), ("0", "b", 0.5, 2)], "query_id string, chunk_id string, score double, rank int")
    got = retrieval.rerank(hits, ask(spark, "q"), texts, retrieval.RerankConfig())
    assert "hashpartitioning(chunk_id" not in plan_of(got)
    want = [tuple(r) for r in got.orderBy("rank").collect()]
    assert [r[1] for r in want] == ["b", "a"]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 0)
    many = retrieval.rerank(hits, ask(spark, "q"), texts, retrieval.RerankConfig())
    assert "hashpartitioning(chunk_id" in plan_of(many) and [tuple(r) for r in many.orderBy("rank").collect()] == want


def test_bm25_deals_one_part_to_each_task(spark, trio):
    plan = retrieval.bm25(ask(spark, "apple berry"), trio)
    assert "hashpartitioning(block" not in plan_of(plan)
    assert sorted(r["chunk_id"] for r in plan.collect()) == ["c1", "c2"]


def test_evaluation_reads_the_gold_set_once(spark, no_small_tables):
    docs = spark.createDataFrame([("a", "one two three four"), ("b", "two"), ("a", "one two three"), (None, "one two three"), ("d", None)], "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "one two three"), ("q2", "two"), ("q3", None)], "query_id string, query string")
    ranking = spark.createDataFrame([("q1", None, 1), ("q1", "a", 2), ("q2", "d", 1), ("q3", "a", 1), (None, "a", 1)], "query_id string, chunk_id string, rank int")
    gold = evaluate.containing(asked, docs)
    at, means = evaluate.at_k(asked, ranking, gold, (1, 2)), evaluate.summary(asked, ranking, gold, (2,))
    # a null id is relevant and is no hit
    assert {(r["query_id"], r["k"]): (r["precision"], r["recall"]) for r in at.collect()} == {(q, k): (0.5, 0.5) if (q, k) == ("q1", 2) else (0.0, 0.0) for q in ("q1", "q2", "q3") for k in (1, 2)}
    assert [tuple(r) for r in means.collect()] == [(2, pytest.approx(1 / 6), pytest.approx(1 / 6), pytest.approx(1 / 6))]
    for got in (at, means):
        assert plan_of(got).split("Initial Plan")[0].count("Generate explode(array(regexp_extract_all(lower(text") == 1
