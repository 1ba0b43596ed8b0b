"""Readers, writers, streaming and the command line."""

import html
import re
import time

import pytest

from loomtext import queries
from loomtext.config import SkipConfig
from loomtext.operators import analysis, index
from loomtext.sources import binary, documents
from loomtext.streaming import incremental

XML = "<event><id>{0}</id><name>n</name><time>t</time><venue><name>v</name></venue><description>{1}</description></event>"


def test_events(spark, tmp_path):
    files = {
        "PastEvent1.xml": XML.format("7", "Tom &amp;amp; &lt;b&gt;Jerry&lt;/b&gt;&lt;br/&gt;end"), "PastEvent2.XML": XML.format("8", ""), "PastEvent3.xml": "<event><id>", "Other.xml": XML.format("9", "no"),
        "PastEvent4.xml": XML.format("7", "later"), "PastEvent5.xml": XML.format("", "no id"),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    events = documents.read_events(spark, str(tmp_path))
    got = {r["file_name"]: r["description"] for r in events.collect()}
    assert got == {"PastEvent1.xml": "Tom & Jerry\nend", "PastEvent4.xml": "later", "PastEvent5.xml": "no id"}
    assert [tuple(r) for r in documents.event_documents(events).collect()] == [(7, "later")]
    assert documents.read_events(spark, str(tmp_path), 1).count() <= 1


def test_xml_events_cover_all_documents(spark, tmp_path):
    texts = [
        "plain", "Tom &amp; <b>Jerry</b><br/>end", "a\n \n\n\n b\n", "&nbsp;a&nbsp;\n&nbsp;\n\nb&nbsp;", "&lt;p&gt;x&lt;/p&gt;", "&amp;lt;i&amp;gt;", "1 < 2 & 3 > 2", "<b\n>x</b", "<p>a<br / >b<BR>",
        "<b></b>", "a ]]> b", "caf\u00e9 &eacute; \U0001f600", "a\r\nb", "a\x01b", None, "",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def by_hand(text):
        text = html.unescape(text)
        for pattern, new in ((r"<br\s*/?>", "\n"), ("<p>", "\n"), ("</p>", "\n"), (r"<[^>]+>", ""), (r"\n\s*\n\s*\n+", "\n\n")):
            text = re.sub(pattern, new, text)
        return text.strip()

    got = {r["doc_id"]: r["n_chars"] for r in queries.QUERIES["xml_events"](spark, str(tmp_path)).collect()}
    assert got == {i: len(by_hand(t)) for i, t in enumerate(texts) if t}


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c"])], "doc_id long, tokens array<string>")
    documents.write_token_files(docs, str(tmp_path / "t"))
    (tmp_path / "t" / "event_3.txt").write_text(" x \n\ny\n")
    (tmp_path / "t" / "4.txt").write_text("")
    (tmp_path / "t" / "mwe_phrases.txt").write_text("a b")
    got = {r["doc_id"]: r["tokens"] for r in documents.read_token_files(spark, str(tmp_path / "t")).collect()}
    assert got == {1: ["b", "a", "b"], 2: ["c"], 3: ["x", "y"]}


def test_text_index_and_phrases(spark, tmp_path):
    docs = spark.createDataFrame([(10, ["b", "a", "b"]), (2, ["b", "c"])], "doc_id long, tokens array<string>")
    lists = index.index_lists(index.postings(docs))
    documents.write_text_index(lists, str(tmp_path / "i"))
    assert sorted((r["term"], r["doc_ids"]) for r in documents.read_text_index(spark, str(tmp_path / "i")).collect()) == [("a", [10]), ("b", [2, 10]), ("c", [2])]
    documents.write_positional_text(index.positional_postings(docs), str(tmp_path / "p"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "p")).collect()) == ["a 1; 10:2", "b 3; 2:1; 10:1,3", "c 1; 2:2"]
    documents.write_phrases(spark, ["b c", "a b c", "a b"], str(tmp_path / "m"))
    assert documents.read_phrases(spark, str(tmp_path / "m")) == ["a b c", "a b", "b c"]


def test_binary_files(spark, tmp_path):
    rows = [("a", [1, 5, 9, 12, 40]), ("b", [7]), ("c" * 25, [2, 3])]
    lists = spark.createDataFrame([(t, len(d), d) for t, d in rows], "term string, df long, doc_ids array<long>")
    for encode, read in ((binary.encode_ids, binary.read_list), (binary.encode_gaps, binary.read_vb_list), (binary.encode_at, lambda *a: binary.read_skip_list(*a)[0])):
        binary.export_index(lists, str(tmp_path / "d.bin"), str(tmp_path / "l.bin"), encode)
        entries = binary.read_dictionary(spark, str(tmp_path / "d.bin")).collect()
        assert {e["term"]: read(str(tmp_path / "l.bin"), e["pointer"], e["doc_freq"]) for e in entries} == {t[:20]: d for t, d in rows}
    binary.export_index(lists, str(tmp_path / "d.bin"), str(tmp_path / "l.bin"))
    assert binary.read_index(spark, str(tmp_path / "d.bin"), str(tmp_path / "l.bin")).count() == 3
    assert SkipConfig().marker_binary == 0xFFFFFFFF


@pytest.mark.parametrize(("form", "encode"), [("plain", binary.encode_positions), ("vb", binary.encode_positions_vb)])
def test_positional_files(spark, tmp_path, form, encode):
    docs = spark.createDataFrame([(3, ["a", "b", "a"]), (500, ["b" * 30, "a"]), (70000, ["b" * 25, "c"])], "doc_id long, tokens array<string>")
    paths = str(tmp_path / "x" / "d.bin"), str(tmp_path / "x" / "l.bin")
    binary.export_positions(index.positional_postings(docs), *paths, encode)
    got = sorted((r["term"], r["at"], r["doc_id"], r["tf"], tuple(r["positions"])) for r in binary.read_positions(spark, *paths, form, every=True).collect())
    assert got == [("a", 0, 3, 2, (1, 3)), ("a", 0, 500, 1, (2,)), ("b", 1, 3, 1, (2,)), ("b" * 20, 2, 70000, 1, (1,)), ("b" * 20, 3, 500, 1, (1,)), ("c", 4, 70000, 1, (2,))]
    # Of equal cut terms the last wins.
    last = {r["term"]: r["doc_id"] for r in binary.read_positions(spark, *paths, form).collect() if r["term"].startswith("bb")}
    assert last == {"b" * 20: 500}


def test_streaming_matches_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma beta")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = incremental.stream_documents(spark, str(tmp_path / "in"), docs.schema)
    incremental.append_frequencies(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "term", "tf").collect()}
    assert got == {tuple(r) for r in index.term_frequencies(analysis.analyze(docs)).select("doc_id", "term", "tf").collect()}


def test_cli(spark, tmp_path, capsys, monkeypatch):
    from loomtext import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma beta")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    path = str(tmp_path / "index")
    assert cli.main(["search", path, "alpha"]) == 1
    assert cli.main(["build", path, "--documents", str(tmp_path / "docs")]) == 0
    for command, query in (("search", "alpha"), ("boolean", "alpha AND NOT gamma"), ("phrase", "beta gamma")):
        assert cli.main([command, path, query]) == 0
    assert cli.main(["stats", path]) == 0
    out = capsys.readouterr().out
    assert "alpha AND NOT gamma: 1: [1]" in out and "beta gamma: 1: [2]" in out


def test_binary_files_by_tasks_and_volumes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)
    rows = [(f"t{i:03d}", sorted({i, 7 * i % 50, 300 + i % 5, 4000 + i})) for i in range(90)]
    lists = spark.createDataFrame([(t, len(d), d) for t, d in rows], "term string, df long, doc_ids array<long>").repartition(5)
    for form, encode in (("plain", binary.encode_ids), ("vb", binary.encode_gaps), ("skips", binary.encode_at)):
        paths = str(tmp_path / form / "d.bin"), str(tmp_path / form / "l.bin")
        binary.export_index(lists, *paths, encode, volume_bytes=500)
        assert (tmp_path / form / "l.bin.1").exists() and not list((tmp_path / form).glob("*.part*"))
        got = sorted((r["at"], r["term"], r["df"], r["doc_ids"]) for r in binary.read_index(spark, *paths, form, every=True).collect())
        assert got == [(i, t, len(d), d) for i, (t, d) in enumerate(rows)]
    # In one file, places are those of the file.
    paths = str(tmp_path / "one" / "d.bin"), str(tmp_path / "one" / "l.bin")
    binary.export_index(lists, *paths, binary.encode_at)
    at, expected = 0, b""
    for _, ids in rows:
        expected += binary.encode_at(ids, at)
        at = len(expected)
    assert (tmp_path / "one" / "l.bin").read_bytes() == expected


@pytest.mark.parametrize(("form", "encode"), [("plain", binary.encode_positions), ("vb", binary.encode_positions_vb)])
def test_positional_files_by_tasks(spark, tmp_path, monkeypatch, form, encode):
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)
    monkeypatch.setattr(binary, "READ_BYTES", 64)
    docs = {t: [(3 + 11 * i, [1 + i, 130 + i, 70000][: 1 + i % 2]) for i in range(n)] for t, n in (("a", 40), ("b", 1), ("c", 300), ("d", 2))}
    rows = spark.createDataFrame([(t, d, len(p), p) for t, x in docs.items() for d, p in x], "term string, doc_id long, tf long, positions array<long>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # lists go on over batches
    try:
        paths = str(tmp_path / "d.bin"), str(tmp_path / "l.bin")
        binary.export_positions(rows, *paths, encode)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (tmp_path / "l.bin").read_bytes() == b"".join(encode(x) for x in docs.values())
    got = sorted((r["at"], r["doc_id"], r["tf"], r["positions"]) for r in binary.read_positions(spark, *paths, form, every=True).collect())
    assert got == [(i, d, len(p), p) for i, x in enumerate(docs.values()) for d, p in x]


def test_compressed_dictionary_is_read_in_time_and_volumes(spark, tmp_path):
    entries = [(f"{i:06d}", i, 3 * i) for i in range(100_000)]
    binary.write_compressed_dictionary(entries, str(tmp_path / "terms.bin"))
    began = time.perf_counter()
    assert binary.read_compressed_dictionary(str(tmp_path / "terms.bin")) == {t: (f, p) for t, f, p in entries}
    assert time.perf_counter() - began < 5
    table = spark.createDataFrame([(i + 1, *e) for i, e in enumerate(entries[:500])], "ordinal long, term string, freq long, ptr long")
    paths = binary.export_compressed_dictionary(table, str(tmp_path / "v"), volume_chars=100)
    assert len(paths) > 30
    assert sorted(map(tuple, binary.read_compressed_dictionaries(spark, paths).collect())) == entries[:500]


def test_token_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "t"
    docs = spark.createDataFrame([(i, ["b", f"w{i}"]) for i in range(1, 60)] + [(60, []), (61, None)], "doc_id long, tokens array<string>")
    documents.write_token_files(docs, str(folder))
    (folder / "_9.txt").write_text("hidden")
    (folder / "62.text").write_text("other")
    (folder / "event_63.txt").write_bytes(b"caf\xc3\xa9\n")
    (folder / "a+b c.txt").write_text("x")
    read = documents.read_token_files(spark, f"file:{folder}")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" not in plan and plan.count("MapInArrow") == 2  # the driver holds no list of files
    got = {r["doc_id"]: r["tokens"] for r in read.collect()}
    assert {i: t for i, t in got.items() if i < 100} == {i: ["b", f"w{i}"] for i in range(1, 60)} | {63: ["café"]} and len(got) == 61
    # A store that Arrow doesn't know gives the same.
    monkeypatch.setattr(documents, "store", lambda path: pytest.fail("Arrow") if path.startswith("/") else (_ for _ in ()).throw(ValueError(path)))
    assert {r["doc_id"]: r["tokens"] for r in documents.read_token_files(spark, f"file:{folder}").collect()} == got
